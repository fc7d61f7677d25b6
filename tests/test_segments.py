import re

import pytest
from pyspark.sql import functions as F

from textquarry.operators.index import buckets
from textquarry.sources.segments import Store, remaining

SCHEMA = "term string, doc_id string, positions array<int>"


def made(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("tf", F.size("positions").cast("long"))


def test_merge_of_segments(spark, tmp_path):
    with pytest.raises(RuntimeError):
        Store.get()
    store = Store.init_global(spark, str(tmp_path))
    assert Store.get() is store and store.ping() and store.segments.merge() == 0
    docs = [f"{i:024x}" for i in range(40)]
    for k in range(6):  # shared documents in all segments
        store.segments.add(f"s{k}", made(spark, [("shared", d, [10 * k, 10 * k + 1]) for d in docs] + [(f"own{k}", docs[k], [k])]), capacity=10)
    assert store.segments.merge(parts=4) == 6 and store.segments.names() == [] and store.checkpoints.count() == 0
    rows = store.segments.index()
    shared = rows.where("term = 'shared'").orderBy("doc_id").collect()
    assert [r["doc_id"] for r in shared] == docs and all(r["positions"] == sorted(r["positions"]) and r["tf"] == 12 for r in shared)
    assert rows.count() == 46 and {r["document_frequency"] for r in buckets(rows.where("term = 'shared'").select("term", "doc_id", "positions", "tf"), 10).collect()} == {10}
    store.segments.add("more", made(spark, [("shared", "f" * 24, [1])]))
    store.segments.merge(parts=4)
    assert store.segments.index().where("term = 'shared'").count() == 41


def test_resume(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.segments.add("s", made(spark, [(t, "0" * 24, [0]) for t in ("apple", "banana", "cherry")]))
    store.checkpoints.get_or_create("s")
    store.checkpoints.progress("s", "apple", 0)
    store.segments.merge(parts=2)
    assert sorted(r["term"] for r in store.segments.index().collect()) == ["banana", "cherry"]
    rows = spark.createDataFrame([("a", 0), ("b", 0), ("b", 1), ("c", 0)], "term string, bucket int")
    assert [tuple(r) for r in remaining(rows, "b", 0).orderBy("term").collect()] == [("b", 1), ("c", 0)]
    assert remaining(rows, None).count() == 4


class Stop(Exception):
    pass


def everything(store):
    return sorted((r["term"], r["doc_id"], tuple(r["positions"])) for r in store.segments.index().collect())


def test_merge_survives_a_failure_at_every_step(spark, tmp_path, monkeypatch):
    """A merge is cut off before its 1st, 2nd, ... durable step; the next one ends with every row once."""
    from textquarry.sources import segments, store as tables

    def filled(base):
        made_store = Store(spark, str(base))
        made_store.segments.add("a", made(spark, [(t, f"{i:024x}", [i]) for t in ("apple", "pear", "plum") for i in range(3)]))
        made_store.segments.merge(parts=2, steps=2)
        made_store.segments.add("b", made(spark, [(t, f"{i:024x}", [i]) for t in ("apple", "quince") for i in range(3, 6)]))
        made_store.segments.add("c", made(spark, [("plum", f"{1:024x}", [9]), ("zest", f"{7:024x}", [0])]))
        return made_store

    whole = filled(tmp_path / "whole")
    whole.segments.merge(parts=2, steps=2)
    want = everything(whole)
    assert len(want) == 9 + 6 + 1

    step = 0
    while True:
        broken = filled(tmp_path / f"at{step}")
        left = [step]

        def counted(f):
            def run(*args, **kwargs):
                if left[0] == 0:
                    left[0] = -1
                    raise Stop
                left[0] -= 1
                return f(*args, **kwargs)

            return run

        with monkeypatch.context() as m:
            for owner, name in ((tables.Versions, "commit"), (tables.Table, "_write"), (segments.Segments, "_write"), (segments.Segments, "_remove")):
                m.setattr(owner, name, counted(getattr(owner, name)))
            try:
                broken.segments.merge(parts=2, steps=2)
                stopped = False
            except Stop:
                stopped = True
        again = Store(spark, str(tmp_path / f"at{step}"))
        again.segments.merge(parts=2, steps=2)
        assert everything(again) == want, step
        assert again.segments.names() == [] and again.checkpoints.count() == 0
        if not stopped:
            break
        step += 3 if step % 2 else 2  # enough of the steps for a test
    assert step > 12


def test_merge_goes_on_where_it_was(spark, tmp_path, monkeypatch):
    """Ranges of terms that were durable before the failure are not written again, and checkpoints tell how far it came."""
    from textquarry.sources import segments

    store = Store(spark, str(tmp_path))
    store.segments.add("s", made(spark, [(f"t{i:03d}", "0" * 24, [0]) for i in range(40)]))
    write, steps = segments.Segments._write, []

    def failing(self, rows, parts, folder=None, step=0):
        if step == 2 and 2 not in steps:
            steps.append(2)
            raise Stop
        steps.append(step)
        return write(self, rows, parts, folder, step)

    monkeypatch.setattr(segments.Segments, "_write", failing)
    with pytest.raises(Stop):
        store.segments.merge(parts=2, steps=4)
    reached = store.checkpoints.find_one(F.col("collection_name") == "s")
    assert reached["last_merged_term"] is not None and not reached["completed"] and store.segments.index().count() == 0
    store.segments.add("later", made(spark, [("new", "1" * 24, [5])]))
    store.segments.merge(parts=2, steps=4)
    assert steps[:5] == [0, 1, 2, 2, 3] and store.segments.index().count() == 41


def test_small_segments_leave_large_layers(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.segments.add("large", made(spark, [(f"t{i}", "0" * 24, [0]) for i in range(100)]))
    store.segments.merge(parts=2, steps=1)
    first = store.segments.layers.read()["folders"]
    store.segments.add("small", made(spark, [("t1", "0" * 24, [7]), ("t1", "1" * 24, [2])]))
    store.segments.merge(parts=2, steps=1)
    assert store.segments.layers.read()["folders"][0] == first[0] and len(store.segments.layers.read()["folders"]) == 2
    assert {r["doc_id"][0]: (r["positions"], r["tf"]) for r in store.lookup(["t1"]).collect()} == {"0": ([0, 7], 2), "1": ([2], 1)}
    plan = store.lookup(["t1"])._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"PartitionFilters: \[[^\]]*term_part#\d+ = \d", plan)) == 2  # both layers are pruned
    store.segments.add("more", made(spark, [(f"u{i}", "0" * 24, [0]) for i in range(60)]))
    store.segments.merge(parts=2, steps=1)
    assert len(store.segments.layers.read()["folders"]) == 1 and store.segments.index().count() == 161


def test_replace_takes_emptied_documents_out(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "doc_id string")
    store.segments.replace(made(spark, [("a", "1", [0]), ("b", "1", [1]), ("a", "2", [0])]), ids("1", "2"), parts=2)
    store.segments.replace(made(spark, [("c", "3", [0])]), ids("1", "3"), parts=2)  # document 1 has no terms any more
    store.segments.replace(made(spark, [("c", "3", [0])]), ids("1", "3"), parts=2)
    assert everything(store) == [("a", "2", (0,)), ("c", "3", (0,))]
    assert store.segments.layers.numbers() and store.segments.merge() == 0


def test_readers_keep_their_version(spark, tmp_path):
    """A table read before a change still shows what it was; a change that fails leaves no trace."""
    from textquarry.sources.store import CHECKPOINTS, Conflict, Table

    table = Table(spark, str(tmp_path / "t"), CHECKPOINTS)
    row = lambda name: spark.createDataFrame([(name, None, -1, None, False)], CHECKPOINTS)
    table.insert(row("a"))
    table.insert(row("b"))
    before = table.read()
    assert table.update(F.col("collection_name") == "a", {"last_merged_term": "x"}) == 1
    assert [r["last_merged_term"] for r in before.collect()] == [None, None] and table.count(F.col("last_merged_term") == "x") == 1
    now = table.versions.read()
    table.insert(row("c"))
    with pytest.raises(Conflict):
        table.versions.commit(now, [])
    folder = table._write(row("lost"))  # written, never committed
    assert table.count() == 3 and (tmp_path / "t" / folder).exists()
    table.versions.vacuum()
    assert table.count() == 3 and not (tmp_path / "t" / folder).exists()
    table.compact()
    assert table.count() == 3 and len(table.versions.read()["folders"]) == 1
