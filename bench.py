"""Times of the headline queries: one JSON line. BENCH_SF_DIR names the tables, BENCH_CPUS the cores."""

from __future__ import annotations

import glob
import json
import os
import statistics
import sys
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

HEADLINE = [
    "ws_top_tokens", "space_tokenize", "char_tokenize", "line_tokenize", "whitespace_tokenize", "wordpunct_tokenize", "regexp_tokenize_words", "xml_escape", "string_span_tokenize", "regexp_span_tokenize", "align_tokens",
    "word_tokenize_line", "word_tokenize", "sent_tokenize", "casual_tokenize_reduced", "toktok_tokenize", "nist_tokenize", "nist_international_tokenize", "mwe_tokenize", "detokenize",
    "sexpr_tokenize", "legal_onsets", "sonority_tokenize", "texttiling_tokenize", "vocabulary",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", cpus)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from textloom.queries import queries

    found, times = queries(), {}
    # a table of one row group is read by one task: before any clock starts, each is dealt into files for all cores
    with tempfile.TemporaryDirectory(prefix="textloom-bench-") as dealt:
        for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
            spark.read.parquet(path).repartition(2 * int(cpus)).write.parquet(f"{dealt}/{os.path.basename(path)}")
        timed(spark, found, dealt, times)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


def timed(spark: SparkSession, found: dict, sf_dir: str, times: dict) -> None:
    """Adds the median seconds of each headline query."""

    def once(name: str) -> float:
        start = time.perf_counter()
        df = found[name](spark, sf_dir)
        df.agg(F.count("*"), F.sum(F.hash(*df.columns).cast("long"))).collect()
        return time.perf_counter() - start

    runs = int(os.environ.get("BENCH_RUNS", "3"))
    for name in HEADLINE:
        once(name)
        times[name] = round(statistics.median(once(name) for _ in range(runs)), 3)


if __name__ == "__main__":
    main()
