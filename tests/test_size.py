"""What a query ships, and to where, read from its plan."""

import re

from textquarry import plans
from textquarry.operators import index, query
from textquarry.sources import store
from textquarry.streaming import ingest

DIR = "/root/testdata/sf0.001"
SCHEMA = "term string, doc_id long, positions array<int>, tf long"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pages_are_read_once(spark):
    """A page's links come from one reading of it, by one function."""
    for name in ("page_links", "html_struct", "page_title", "html_words", "html_text"):
        assert plan(plans.queries()[name](spark, DIR)).count("ArrowEvalPython") == 1
    assert plan(plans.queries()["page_index"](spark, DIR)).count("ArrowEvalPython") == 2  # pages, then stems and groups


def test_the_walk_brings_no_pages_to_the_driver(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(store.Pages, "list_paginated", None)
    monkeypatch.setattr(store, "RANGE", 7)
    rows = spark.createDataFrame([(f"{i * 37 % 101:03d}", f"u{i}") for i in range(101)], "_id string, url string").repartition(5)
    for limit in (1, 10, 1000):
        got = sorted((r["_id"], r["batch"]) for r in store.paged(rows, "_id", limit).collect())
        assert got == [(f"{i:03d}", i // limit) for i in range(101)]
    assert plan(store.paged(rows, "_id", 10)).count("SinglePartition") == 0
    assert store.paged(rows.limit(0), "_id", 10).count() == 0
    assert plans.queries()["page_walk"](spark, DIR).count() == spark.read.parquet(f"{DIR}/pages.parquet").count()


def test_positions_are_gathered_where_they_meet(spark):
    """A merge deals its rows out before it gathers, so no task that reads sorts what it read."""
    rows = spark.createDataFrame([("a", 1, [0], 1)], SCHEMA)
    lines = plan(index.merge(rows, rows)).splitlines()
    last = max(i for i, line in enumerate(lines) if "collect_list" in line)
    assert last < min(i for i, line in enumerate(lines) if "Exchange" in line)


def test_buckets_carry_what_is_asked_for(spark):
    rows = spark.createDataFrame([("a", d, [0], 1) for d in range(25)], SCHEMA)
    got = index.buckets(rows.select("term", "doc_id"), 10)
    assert "positions" not in got.columns and [tuple(r) for r in got.orderBy("bucket").collect()] == [("a", i, 10 if i < 2 else 5, list(range(10 * i, min(10 * i + 10, 25)))) for i in range(3)]
    old = index.assign_buckets(rows.where("doc_id < 15").select("term", "doc_id"), 10)
    out = index.append(old, rows.where("doc_id >= 15").select("term", "doc_id"), 10)
    assert out.columns == ["term", "doc_id", "bucket"] and all(r["bucket"] == r["doc_id"] // 10 for r in out.collect())
    for name in ("bucket_rows", "incremental_append"):
        assert "positions" not in plan(plans.queries()[name](spark, DIR))


def test_documents_that_came_once_are_not_joined_by_shuffling(spark):
    rows = spark.createDataFrame([("a", 1, [0], 1, 0), (None, 1, None, None, 0), (None, 1, None, None, 2), ("b", 2, [3], 1, 1), ("a", 2, [1], 1, 1)], SCHEMA + ", version long")
    now = ingest.current(rows)
    assert sorted(tuple(r)[:2] for r in now.collect()) == [("a", 2), ("b", 2)] and "SortMergeJoin" not in plan(now)


def test_a_stream_with_one_id_under_two_keys(spark, tmp_path):
    """Rows of one id are merged where the key is another column, and a page without terms leaves its mark once."""
    spark.createDataFrame([(1, "u", "pear plum"), (1, "v", "pear"), (2, "w", "")], "_id long, url string, html_body string").coalesce(1).write.parquet(f"{tmp_path}/src")
    shape = spark.read.parquet(f"{tmp_path}/src").schema
    ingest.index_stream(ingest.page_stream(spark, f"{tmp_path}/src", shape), f"{tmp_path}/seg", f"{tmp_path}/ck").awaitTermination()
    rows = spark.read.parquet(f"{tmp_path}/seg")
    assert sorted((r["term"] or "", r["doc_id"], r["positions"], r["tf"]) for r in rows.collect()) == [("", 1, None, None), ("", 2, None, None), ("pear", 1, [0, 0], 2), ("plum", 1, [1], 1)]


def test_a_batch_looks_slots_up_in_the_documents_of_its_rarest_terms(spark):
    rows = spark.createDataFrame([(t, d, [i], 1) for d in range(20) for i, t in enumerate(("common", "rare" if d == 3 else "other", "last"))], SCHEMA)
    slots = spark.createDataFrame([(1, 0, "common"), (1, 1, "rare"), (1, 2, "last"), (2, 0, "rare")], "query_id long, slot int, term string")
    got = query.batch(rows, slots)
    assert sorted(tuple(r) for r in got.collect()) == [(1, 3), (2, 3)]
    assert not re.search(r"SortMergeJoin \[term", plan(got))


def test_a_written_merge_is_dealt_out_once(spark, tmp_path, monkeypatch):
    """The merge and the layer that it is written as share one shuffle; equal rows of one or several tables become one."""
    from pyspark.sql import DataFrameWriter

    a = spark.createDataFrame([("a", 1, [5, 1], 2), ("b", 1, [0], 1), ("a", 1, [3], 1)], SCHEMA)
    b = spark.createDataFrame([("a", 1, [4], 1), ("a", 2, [7], 1)], SCHEMA)
    plans_, partition_by = [], DataFrameWriter.partitionBy
    monkeypatch.setattr(DataFrameWriter, "partitionBy", lambda self, *c: (plans_.append(plan(self._df)), partition_by(self, *c))[1])
    index.write_merged([a, b], f"{tmp_path}/layer", parts=2)
    got = {(r["term"], r["doc_id"]): (r["positions"], r["tf"]) for r in spark.read.parquet(f"{tmp_path}/layer").collect()}
    assert got == {("a", 1): ([1, 3, 4, 5], 4), ("b", 1): ([0], 1), ("a", 2): ([7], 1)}
    assert len(plans_) == 1 and plans_[0].count("Exchange") == 1
