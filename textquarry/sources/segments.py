"""Index segments waiting to be merged, the layers of the stored index, and one handle on all tables of a base path.

The stored index is a list of layers, folders of postings by hash of the term.
A merge takes segments together with the layers that are not much larger than
they are, so a posting is written again about once for every fourfold growth of
the index, not for every segment. The layers are named by a numbered file as in
``store``; that file also names the segments that are in them. It is committed
first, and only then are segments marked and removed, so a merge that fails
anywhere runs again without losing or doubling a row.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.index import CAPACITY, assign_buckets, lookup, write, write_merged
from .store import POSTINGS, Checkpoints, Pages, Table, Versions, few

LAYER = "term string, doc_id string, positions array<int>, tf long, term_part int"
#: Folders by hash of the term; a layer joins a merge of rows that are at least a FANOUTth of its own; a merge goes in STEPS ranges of terms.
PARTS, FANOUT, STEPS = 256, 4, 8
#: Terms that are sampled to cut the ranges.
SAMPLE = 10_000


def remaining(rows: DataFrame, last_term: str | None, last_bucket: int = -1) -> DataFrame:
    """Rows (term, bucket) after the place that a merge had reached."""
    if last_term is None:
        return rows
    later: Column = (F.col("term") > last_term) | ((F.col("term") == last_term) & (F.col("bucket") > last_bucket))
    return rows.where(later)


class Segments:
    """Postings written by name under ``base/segments`` and merged into the layers under ``base/postings``."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        self.checkpoints = Checkpoints(spark, base)
        self.layers = Versions(spark, f"{self.base}/postings")
        #: Ranges of an unfinished merge that are durable already.
        self.staged = Versions(spark, f"{self.base}/postings-staged")

    def _table(self, name: str) -> Table:
        return Table(self.spark, f"{self.base}/segments/{name}", POSTINGS)

    def _content(self, name: str) -> str:
        """The name with what it stands for now: a segment that is replaced is another one."""
        return "/".join([name, *self._table(name).versions.read()["folders"]])

    def add(self, name: str, rows: DataFrame, capacity: int = CAPACITY) -> None:
        """Writes a segment with its buckets, sorted by term; the same name again replaces it."""
        self.checkpoints.delete(F.col("collection_name") == name)
        rows = assign_buckets(rows.withColumn("doc_id", F.col("doc_id").cast("string")), capacity)
        self._table(name).overwrite(rows.sortWithinPartitions("term", "bucket"))

    def _remove(self, name: str) -> None:
        path, fs = self.layers._at(f"../segments/{name}")
        fs.delete(path, True)

    def names(self) -> list[str]:
        path, fs = self.layers._at("../segments")
        found = sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []
        return [name for name in found if self._table(name).versions.numbers()]

    def read(self, name: str) -> DataFrame:
        return self._table(name).read()

    def _read(self, folders: list[str]) -> DataFrame:
        rows = self.spark.createDataFrame([], LAYER)
        for i, folder in enumerate(folders):
            layer = self.spark.read.schema(LAYER + ", step int").parquet(f"{self.base}/postings/{folder}").drop("step")
            rows = rows.unionByName(layer) if i else layer
        return rows

    def index(self) -> DataFrame:
        """All layers as one table; a filter on terms reaches every layer's files.

        It has ``term_part`` where that is the hash that ``operators.index.lookup``
        expects; ``lookup`` below knows any number of parts.
        """
        rows = self._all()
        return rows if self.layers.read().get("parts", PARTS) == PARTS else rows.drop("term_part")

    def lookup(self, terms: list[str]) -> DataFrame:
        """Rows of the given terms, from the folders of their hashes only."""
        return lookup(self._all(), terms, self.layers.read().get("parts", PARTS))

    def _all(self) -> DataFrame:
        folders = self.layers.read()["folders"]
        rows = self._read(folders)
        if len(folders) < 2:
            return rows
        grouped = rows.groupBy("term", "doc_id", "term_part").agg(F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"))
        return grouped.select("term", "doc_id", "positions", F.size("positions").cast("long").alias("tf"), "term_part")

    def _write(self, rows: DataFrame | list[DataFrame], parts: int, folder: str | None = None, step: int = 0) -> str:
        """Writes a layer, or a step of one; of several tables their merge."""
        folder = folder or f"v-{uuid.uuid4().hex}"
        (write_merged if isinstance(rows, list) else write)(rows, f"{self.base}/postings/{folder}/step={step}", parts)
        return folder

    def _joining(self, rows: int, layers: dict) -> tuple[list[str], dict[str, int]]:
        """(layers to write again with so many new rows, rows of those that stay)."""
        sizes = layers.get("rows", {})
        taken: list[str] = []
        for folder in sorted(layers["folders"], key=lambda f: sizes[f]):
            if sizes[folder] > FANOUT * rows:
                break
            taken.append(folder)
            rows += sizes[folder]
        return taken, {f: sizes[f] for f in layers["folders"] if f not in taken}

    def _commit(self, layers: dict, stay: dict[str, int], new: list[str], merged: list[str], parts: int) -> None:
        sizes = stay | {f: n for f in new if (n := self._read([f]).count())}
        self.layers.commit(layers, list(sizes), rows=sizes, merged=merged, parts=parts)

    def _bounds(self, rows: list[DataFrame], steps: int) -> list[str]:
        """Terms that cut the rows into about equal ranges, from a sample of bounded size."""
        terms = [r.select("term") for r in rows]
        both = terms[0]
        for t in terms[1:]:
            both = both.union(t)
        share = min(1.0, SAMPLE / max(both.count(), 1))
        found = sorted(r["term"] for r in both.where(F.rand(7) < share).limit(4 * SAMPLE).collect())
        return sorted({found[len(found) * i // steps] for i in range(1, steps)}) if found else []

    def _begin(self, names: list[str], layers: dict, steps: int) -> dict:
        """Plans a merge and makes the plan durable."""
        since = {n: [c["last_merged_term"], c["last_merged_bucket"]] for n in names for c in [self.checkpoints.get_or_create(n)]}
        segments = [remaining(self.read(n), *since[n]) for n in names]
        taken, stay = self._joining(sum(s.count() for s in segments), layers)
        bounds = self._bounds([*segments, self._read(taken)], steps)
        plan = {"names": names, "contents": [self._content(n) for n in names], "since": since, "taken": taken, "stay": stay}
        self.staged.commit(self.staged.read(), [], **plan, bounds=bounds, layers=layers["number"], layer=f"v-{uuid.uuid4().hex}", done=0)
        return self.staged.read()

    def _go_on(self, plan: dict, layers: dict, parts: int) -> None:
        """Merges the ranges of a plan that are not durable yet, then makes them the index."""
        rows = [self._read(plan["taken"]), *[remaining(self.read(n), *plan["since"][n]) for n in plan["names"]]]
        edges = [None, *plan["bounds"], None]
        for step in range(plan["done"], len(edges) - 1):
            low, high = edges[step], edges[step + 1]
            inside = F.lit(True) if low is None else F.col("term") > low
            inside = inside if high is None else inside & (F.col("term") <= high)
            self._write([r.where(inside) for r in rows], parts, plan["layer"], step)
            self.staged.commit(plan, [], **{k: v for k, v in plan.items() if k not in ("number", "folders", "done")}, done=step + 1)
            plan = self.staged.read()
            if high is not None:
                self.checkpoints.progress(plan["names"], high, (1 << 31) - 1)
        # segments of an earlier merge that are not removed yet stay named
        there = {self._content(n) for n in self.names()}
        self._commit(layers, plan["stay"], [plan["layer"]], plan["contents"] + [c for c in layers.get("merged", []) if c in there], parts)

    def _drop_plan(self, plan: dict) -> None:
        """Forgets a plan that can't go on, with its ranges and the progress of its segments."""
        for name, (term, bucket) in plan.get("since", {}).items():
            self.checkpoints.update((F.col("collection_name") == name) & ~F.col("completed"), {"last_merged_term": term, "last_merged_bucket": bucket})
        path, fs = self.layers._at(plan["layer"])
        fs.delete(path, True)
        self.staged.commit(plan, [])

    def merge(self, parts: int = PARTS, steps: int = STEPS) -> int:
        """Merges the waiting segments from where their checkpoints are, then removes them; returns their number.

        The merge goes in ranges of terms. Each is durable, and the checkpoints
        name its last term, before the next begins; a merge that failed goes on
        with the range that it had reached.
        """
        names = self.names()
        parts = self.layers.read().get("parts", parts)  # the first merge decides
        plan = self.staged.read()
        if plan.get("names"):  # a merge that did not come to its end
            layers = self.layers.read()
            committed = set(plan["contents"]) <= set(layers.get("merged", []))
            if not committed and layers["number"] == plan["layers"] and plan["contents"] == [self._content(n) for n in plan["names"]]:
                self._go_on(plan, layers, parts)
                self.staged.commit(self.staged.read(), [])
            elif committed:
                self.staged.commit(plan, [])
            else:
                self._drop_plan(plan)
        layers = self.layers.read()
        there = set(layers.get("merged", []))
        waiting = [n for n in names if self._content(n) not in there and not self.checkpoints.get_or_create(n)["completed"]]
        if waiting:
            self._go_on(self._begin(waiting, layers, steps), layers, parts)
            self.staged.commit(self.staged.read(), [])
        if names:
            self.checkpoints.complete(names)
        for name in names:
            self._remove(name)
        self.checkpoints.delete_completed()
        return len(names)

    def replace(self, rows: DataFrame, ids: DataFrame, parts: int = PARTS) -> None:
        """Puts ``rows`` (term, doc_id, positions) in place of all postings of the documents in ``ids`` (doc_id).

        A document whose new text has no terms is in ``ids`` and has no rows.
        Layers without such a document stay as they are. Repeating the call
        gives the same index.
        """
        layers = self.layers.read()
        parts = layers.get("parts", parts)
        ids = few(ids.select(F.col("doc_id").cast("string").alias("doc_id")).distinct())
        fresh = self._write(rows.withColumn("doc_id", F.col("doc_id").cast("string")).select("term", "doc_id", "positions", "tf"), parts)
        sizes = dict(layers.get("rows", {}))
        touched = [f for f in layers["folders"] if not self._read([f]).join(ids, "doc_id", "left_semi").isEmpty()]
        taken, stay = self._joining(self._read([fresh]).count(), {"folders": [f for f in layers["folders"] if f not in touched], "rows": sizes})
        new = [fresh]
        if touched or taken:
            old = self._read([*touched, *taken]).join(ids, "doc_id", "left_anti")
            new = [self._write([old, self._read([fresh])], parts)]
        self._commit(layers, stay, new, layers.get("merged", []), parts)
        if new != [fresh]:
            path, fs = self.layers._at(fresh)
            fs.delete(path, True)


class Store:
    """Session, base path and the tables under it."""

    _current: Store | None = None

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        self.pages, self.segments, self.checkpoints = Pages(spark, base), Segments(spark, base), Checkpoints(spark, base)

    def ping(self) -> bool:
        """Whether the session answers."""
        return self.spark.range(1).count() == 1

    def lookup(self, terms: list[str]) -> DataFrame:
        return self.segments.lookup(terms)

    @classmethod
    def init_global(cls, spark: SparkSession, base: str) -> Store:
        cls._current = cls(spark, base)
        return cls._current

    @classmethod
    def get(cls) -> Store:
        if cls._current is None:
            raise RuntimeError("no store was initialised")
        return cls._current
