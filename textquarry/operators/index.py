"""The positional inverted index as flat tables.

Canonical form: ``postings(term, doc_id, positions)``, one row for each term of
a document, so that no row grows with the number of documents that share a
term. Buckets of bounded size are a view of it. Segments are postings tables
that only grow; a merge is a union and one aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.analysis import DEFAULT, Analyzer
from ..sources.scratch import Scratch

#: Document ids in a bucket.
CAPACITY = 100_000
#: Ranges of ids in which a hot term is numbered in parallel, and the rows that make a term hot.
RANGES, HOT = 64, 1_000_000
#: Ids of a hot term that are sampled to cut the ranges; offsets (24 bytes each) up to this many are broadcast.
SAMPLE, OFFSET_LIMIT = 10_000, 500_000


def postings(docs: DataFrame, doc_id: str, text: str, analyzer: Analyzer = DEFAULT, unique: bool = False) -> DataFrame:
    """term, doc_id, positions (ascending), tf for every row of ``docs``.

    A row's terms are grouped inside the row. Where ids are ``unique`` to their
    rows nothing is shuffled; else the rows of an id are merged.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.explode_outer(grouped(analyzer.analyze(F.col(text)))).alias("g"))
    rows = rows.where("g.term is not null").select("g.term", "doc_id", "g.positions", F.size("g.positions").cast("long").alias("tf"))
    return rows if unique else merge(rows)


GROUPS = T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("positions", T.ArrayType(T.IntegerType()))]))
_GROUP = pa.struct([("term", pa.string()), ("positions", pa.list_(pa.int32()))])
#: Terms that are sorted at once.
SORTED = 250_000


def _group(lists: pa.Array) -> pa.Array:
    """Arrays of (term, positions) for arrays of terms, none of them null: one stable sort by row and term."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    words = lists.flatten().dictionary_encode()
    codes, known = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(words.dictionary)
    pos = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    key = np.repeat(np.arange(len(sizes)), sizes) * max(known, 1) + codes
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    positions = pa.ListArray.from_arrays(pa.array(np.append(first, len(key)), pa.int32()), pa.array(pos[order], pa.int32()))
    terms = words.dictionary.take(pa.array(key[first] % max(known, 1))).cast(pa.string())
    ends = np.cumsum(np.bincount(key[first] // max(known, 1), minlength=len(sizes)))
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.StructArray.from_arrays([terms, positions], fields=list(_GROUP)))


@F.arrow_udf(GROUPS)
def _grouped(lists: pa.Array) -> pa.Array:
    ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    out, at = [pa.array([], pa.list_(_GROUP))], 0
    while at < len(lists):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SORTED, side="right")))
        out.append(_group(lists.slice(at, upto - at)))
        at = upto
    return pa.concat_arrays(out)


def grouped(terms: Column) -> Column:
    """Array of (term, positions) of an array of terms."""
    return _grouped(terms)


def invert(rows: DataFrame) -> DataFrame:
    """Groups token rows (doc_id, pos, term); a group is one document's uses of one term."""
    grouped = rows.groupBy("term", "doc_id").agg(F.sort_array(F.collect_list("pos")).alias("positions"))
    return grouped.withColumn("tf", F.size("positions").cast("long"))


def _union(segments: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [s.select("term", "doc_id", "positions") for s in segments])


def merge(*segments: DataFrame) -> DataFrame:
    """One postings table from several: equal (term, doc_id) rows join their positions, sorted."""
    rows = _union(segments)
    # dealt out first: to gather positions before that would sort every task's rows, and few of them meet there
    grouped = rows.repartition("term", "doc_id").groupBy("term", "doc_id").agg(F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"))
    return grouped.withColumn("tf", F.size("positions").cast("long"))


def document_frequency(index: DataFrame) -> DataFrame:
    """term, document_frequency (documents), n_positions."""
    return index.groupBy("term").agg(F.count("*").alias("document_frequency"), F.sum("tf").alias("n_positions"))


def _numbered(index: DataFrame) -> DataFrame:
    """``index`` with ``__n``, the place of the document among those of its term, from 0.

    The rows are written once. The ids of a hot term are cut into ranges; a
    range is numbered by itself and starts after the rows of the ranges before
    it, so a term in a third of all documents is dealt over RANGES tasks.
    """
    scratch = Scratch(index.sparkSession, "numbered")
    rows = scratch.keep(index)
    hot = scratch.keep(rows.groupBy("term").agg(F.count("*").alias("c")).where(F.col("c") >= HOT))
    if hot.isEmpty():
        scratch.drop(2)
        place = F.row_number().over(Window.partitionBy("term").orderBy("doc_id")) - 1
        return rows.withColumn("__n", place)
    # a term has at least HOT rows, so there are few of them
    hot = hot.select(F.col("term").alias("__hot"))
    rows = rows.join(F.broadcast(hot) if hot.count() <= OFFSET_LIMIT else hot, F.col("term") == F.col("__hot"), "left")
    ids = rows.where("__hot is not null").select("doc_id")
    share = min(1.0, SAMPLE / max(ids.count(), 1))
    found = sorted(r["doc_id"] for r in ids.where(F.rand(11) < share).limit(4 * SAMPLE).collect())
    bounds = sorted({found[len(found) * i // RANGES] for i in range(1, RANGES)}) if found else []
    kind = index.schema["doc_id"].dataType
    cuts = F.array(*[F.lit(b).cast(kind) for b in bounds]) if bounds else F.array().cast(f"array<{kind.simpleString()}>")
    part = F.when(F.col("__hot").isNotNull(), F.size(F.filter(cuts, lambda b: b < F.col("doc_id")))).otherwise(0)
    rows = rows.withColumn("__part", part)
    counts = rows.where("__hot is not null").groupBy("term", "__part").agg(F.count("*").alias("__rows"))
    before = F.sum("__rows").over(Window.partitionBy("term").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    counts = scratch.keep(counts.select(F.col("term").alias("__of"), F.col("__part").alias("__in"), F.coalesce(before, F.lit(0)).alias("__before")))
    counts = F.broadcast(counts) if counts.count() <= OFFSET_LIMIT else counts
    inside = F.row_number().over(Window.partitionBy("term", "__part").orderBy("doc_id")) - 1
    numbered = rows.withColumn("__n", inside).join(counts, (F.col("term") == F.col("__of")) & (F.col("__part") == F.col("__in")), "left")
    return numbered.select(*[F.col(c) for c in index.columns], (F.coalesce("__before", F.lit(0)) + F.col("__n")).alias("__n"))


def assign_buckets(index: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``index`` with ``bucket``: documents of a term in id order, ``capacity`` to a bucket."""
    return _numbered(index).withColumn("bucket", F.floor(F.col("__n") / capacity).cast("int")).drop("__n")


def buckets(index: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """term, bucket, document_frequency (of the bucket), postings (ids, ascending), positions (id -> positions, if ``index`` has them).

    A bucket gathers at most ``capacity`` documents into a row.
    """
    rows = assign_buckets(index, capacity)
    if "positions" not in index.columns:
        # the rows of a term are in one task, or a hot term's in a few; what is gathered is an id for each row
        rows = rows.groupBy("term", "bucket").agg(F.sort_array(F.collect_list("doc_id")).alias("postings"))
        return rows.select("term", "bucket", F.size("postings").cast("long").alias("document_frequency"), "postings")
    rows = rows.groupBy("term", "bucket").agg(F.sort_array(F.collect_list(F.struct("doc_id", "positions"))).alias("rows"))
    return rows.select(
        "term", "bucket", F.size("rows").cast("long").alias("document_frequency"),
        F.transform("rows", lambda r: r["doc_id"]).alias("postings"),
        F.map_from_entries(F.transform("rows", lambda r: F.struct(r["doc_id"].cast("string"), r["positions"]))).alias("positions"),
    )


def bucket_sizes(bucketed: DataFrame) -> DataFrame:
    """term, bucket, document_frequency of rows that carry a bucket."""
    return bucketed.groupBy("term", "bucket").agg(F.count("*").alias("document_frequency"))


def last_bucket(sizes: DataFrame) -> DataFrame:
    """term with its last bucket and that bucket's document frequency."""
    return sizes.groupBy("term").agg(F.max("bucket").alias("bucket"), F.max_by("document_frequency", "bucket").alias("document_frequency"))


def append(existing: DataFrame, new: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``existing`` (with buckets) and the rows of ``new`` that it lacks, which go on filling each term's last bucket.

    Both may be without positions and tf; then the result is too.
    Rows of documents that are in the index already belong to ``replace``.
    """
    columns = [c for c in ("term", "doc_id", "positions", "tf") if c in existing.columns and c in new.columns]
    fresh = _numbered(new.select(*columns))
    last = last_bucket(bucket_sizes(existing)).select("term", (F.col("bucket") * capacity + F.col("document_frequency")).alias("__start"))
    fresh = fresh.join(last, "term", "left").withColumn("bucket", F.floor((F.coalesce("__start", F.lit(0)) + F.col("__n")) / capacity).cast("int"))
    return existing.select(*columns, "bucket").unionByName(fresh.select(*columns, "bucket"))


def replace(existing: DataFrame, new: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Postings in which the documents of ``ids`` (doc_id) have only their rows of ``new``.

    ``ids`` are all documents that were read again. Without them those of
    ``new`` are taken, which misses documents whose new text has no terms.
    """
    ids = (new if ids is None else ids).select("doc_id").distinct()
    old = existing.join(ids, "doc_id", "left_anti")
    return old.select("term", "doc_id", "positions", "tf").unionByName(new.select("term", "doc_id", "positions", "tf"))


def write(index: DataFrame, path: str, parts: int = 256, mode: str = "overwrite") -> None:
    """Writes postings so that a lookup of few terms reads few row groups.

    ``term_part`` is a hash of the term; a lookup names its value as a literal,
    which prunes folders, and rows are sorted by term inside files, so min/max
    statistics skip the rest. A hot term is dealt over several files by id.
    """
    part = F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int")
    rows = index.withColumn("term_part", part)
    rows = rows.repartition(F.col("term_part"), F.pmod(F.xxhash64("doc_id"), F.lit(4))).sortWithinPartitions("term_part", "term", "doc_id")
    rows.write.mode(mode).partitionBy("term_part").parquet(path)


def write_merged(segments: Sequence[DataFrame], path: str, parts: int = 256, mode: str = "overwrite") -> None:
    """``write`` of ``merge``: equal rows meet where they are written, so the rows are dealt out and sorted once."""
    keys = ("term_part", "__deal", "term", "doc_id")
    deal = {"term_part": F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int"), "__deal": F.pmod(F.xxhash64("doc_id"), F.lit(4))}
    equal = Window.partitionBy(*keys).orderBy("doc_id")
    found = F.collect_list("positions").over(equal.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = _union(segments).withColumns(deal).repartition("term_part", "__deal")
    rows = rows.withColumns({"__all": found, "__n": F.row_number().over(equal)}).where("__n = 1")
    rows = rows.select("term", "doc_id", F.sort_array(F.flatten("__all")).alias("positions"), "term_part")
    rows = rows.select("term", "doc_id", "positions", F.size("positions").cast("long").alias("tf"), "term_part")
    rows.write.mode(mode).partitionBy("term_part").parquet(path)


def lookup(index: DataFrame, terms: list[str], parts: int = 256) -> DataFrame:
    """Rows of the given terms; prunes by ``term_part`` where the table has it."""
    found = index.where(F.col("term").isin(*terms)) if terms else index.where("false")
    if terms and "term_part" in index.columns:
        hashed = index.sparkSession.range(1).select(*[F.pmod(F.xxhash64(F.lit(t)), F.lit(parts)).cast("int") for t in terms]).first()
        found = found.where(F.col("term_part").isin(*{*hashed}))
    return found
