"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from statistics import median

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

from textquarry import plans  # noqa: E402
from textquarry.functions.analysis import UNSTEMMED  # noqa: E402
from textquarry.operators import index, query  # noqa: E402
from textquarry.plans import catalogue  # noqa: E402

DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def timed(run, repeats: int = 3) -> float:
    """Median of warm runs, after one that is not counted."""
    run()
    out = []
    for _ in range(repeats):
        began = time.perf_counter()
        run()
        out.append(time.perf_counter() - began)
    return median(out)


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    names = ("analyzed_tokens_nostem", "analyzed_tokens_stemmed", "postings_nostem", "postings_stemmed", "term_buckets", "merge_segments", "incremental_append", "html_text", "page_index", "page_links", "search_results", "batch_phrase", "crawl_bfs")
    for name in names:
        times[name] = round(timed(lambda q=plans.queries()[name]: drain(q(spark, DIR))), 3)
    with tempfile.TemporaryDirectory() as folder:
        index.write(index.postings(spark.read.parquet(f"{DIR}/documents.parquet"), "doc_id", "text", UNSTEMMED), f"{folder}/p", parts=16)
        stored = spark.read.parquet(f"{folder}/p")
        terms = ["thanedble", "anea", "eriner"]
        times["stored_phrase_lookup"] = round(timed(lambda: drain(query.match(index.lookup(stored, terms, 16), terms))), 3)
        times["stored_batch_phrase"] = round(timed(lambda: drain(query.batch(stored, catalogue._slots(spark, DIR)))), 3)
    print(json.dumps({"metric": "total of headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(DIR.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
