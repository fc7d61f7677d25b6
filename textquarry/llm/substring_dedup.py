"""Operator 10: removal of repeated passages by winnowed seeds extended both ways.

Every window of 50 words picks as seed the smallest 20-word gram inside it
(winnowing), so equal windows pick equal seeds, about one seed for 16 words.
Seeds that only one document holds are left. Around every other seed the match
is extended to both sides as far as any window with this seed reaches (its
span). Extension never pairs occurrences: equal spans meet by one hash, whose
smallest document owns them, and only the first holder of each distinct span
has its windows compared one by one, again through the smallest document of
each. A passage in m documents costs m rows, not m * m pairs. Consecutive
repeated windows join into maximal repeats, which are cut.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .text import RunHashes, WordHashes, slices

LENGTH = 50
GRAM = 20


def seeds(runs: RunHashes, n: int, length: int = LENGTH, gram: int = GRAM):
    """(seed hash, first window, last window) of the windows of an n-word text, grouped by seed."""
    if n < length:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none
    at = np.arange(n - gram + 1)
    grams = runs.of(at, at + gram)
    reach = length - gram + 1
    place = np.lib.stride_tricks.sliding_window_view(grams, reach).argmin(axis=1) + np.arange(n - length + 1)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    last = np.concatenate([first[1:], [len(place)]]) - 1
    return grams[place[first]], first, last


def _words(text: bytes | None) -> list[bytes]:
    return (text or b"").split()


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def _named(docs: DataFrame) -> DataFrame:
    """doc_id, row, text of the rows with an id; ``row`` tells texts under one id apart."""
    return docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("row"), "text")


def _spans(docs: DataFrame, length: int) -> DataFrame:
    """seed, span, doc_id, row, lo, hi: every seed with the hash of all words its windows cover."""

    def find(batches):
        hashes = WordHashes()
        for batch in slices(batches):
            ids, rows, seed, span, lo, hi = [], [], [], [], [], []
            for doc_id, row, text in zip(batch.column("doc_id").to_pylist(), batch.column("row").to_pylist(), _texts(batch)):
                words = _words(text)
                if len(words) < length:
                    continue
                runs = RunHashes(hashes.of(words))
                s, first, last = seeds(runs, len(words), length)
                seed.append(s)
                span.append(runs.of(first, last + length))
                ids.append(np.full(len(s), doc_id, np.int64))
                rows.append(np.full(len(s), row, np.int64))
                lo.append(first)
                hi.append(last)
            if ids:
                yield pa.RecordBatch.from_pydict({
                    "seed": np.concatenate(seed).view(np.int64), "span": np.concatenate(span).view(np.int64), "doc_id": np.concatenate(ids), "row": np.concatenate(rows),
                    "lo": np.concatenate(lo).astype(np.int32), "hi": np.concatenate(hi).astype(np.int32),
                })

    return _named(docs).mapInArrow(find, "seed long, span long, doc_id long, row long, lo int, hi int")


def _windows(docs: DataFrame, chosen: DataFrame, length: int) -> DataFrame:
    """seed, run, doc_id, row, lo: each window of the chosen spans with the hash of its words."""
    lists = chosen.groupBy("doc_id", "row").agg(F.collect_list(F.struct("seed", "lo", "hi")).alias("spans"))

    def open_up(batches):
        hashes = WordHashes()
        for batch in slices(batches):
            ids, rows, seed, run, lo = [], [], [], [], []
            for doc_id, row, text, spans in zip(batch.column("doc_id").to_pylist(), batch.column("row").to_pylist(), _texts(batch), batch.column("spans").to_pylist()):
                words = _words(text)
                runs = RunHashes(hashes.of(words))
                starts = np.concatenate([np.arange(s["lo"], s["hi"] + 1) for s in spans])
                marks = np.concatenate([np.full(s["hi"] + 1 - s["lo"], s["seed"], np.int64) for s in spans])
                ids.append(np.full(len(starts), doc_id, np.int64))
                rows.append(np.full(len(starts), row, np.int64))
                seed.append(marks)
                run.append(runs.of(starts, starts + length))
                lo.append(starts)
            if ids:
                yield pa.RecordBatch.from_pydict({
                    "seed": np.concatenate(seed), "run": np.concatenate(run).view(np.int64),
                    "doc_id": np.concatenate(ids), "row": np.concatenate(rows), "lo": np.concatenate(lo).astype(np.int32),
                })

    joined = _named(docs).join(lists, ["doc_id", "row"]).select("doc_id", "row", "text", "spans")
    return joined.mapInArrow(open_up, "seed long, run long, doc_id long, row long, lo int")


def _smallest(rows: DataFrame, keys: list[str], scratch: Scratch) -> DataFrame:
    """``rows`` held by several documents, with ``first``, the smallest that holds the same keys.

    The smallest are written before they are joined, so that the join deals
    both sides out itself and adaptive execution may split a hot key.
    """
    first = rows.groupBy(*keys).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    first = scratch.keep(first.where("first < last").drop("last"))
    return rows.join(first, keys)


def repeats(docs: DataFrame, scratch: Scratch, length: int = LENGTH) -> DataFrame:
    """doc_id, row, ranges: word ranges [lo, hi) of windows that a smaller document has too (they may overlap)."""
    spans = scratch.keep(_spans(docs, length))
    shared = spans.groupBy("seed").agg(F.min("doc_id").alias("d0"), F.max("doc_id").alias("d1"), F.min("span").alias("s0"), F.max("span").alias("s1"))
    shared = scratch.keep(shared.where("d0 <> d1").select("seed", (F.col("s0") != F.col("s1")).alias("differ")))
    held = scratch.keep(spans.join(shared, "seed"))
    whole = _smallest(held, ["seed", "span"], scratch).where("doc_id > first").select("doc_id", "row", "lo", (F.col("hi") + length).alias("hi"))
    # the first holder of every span that has a seed in common with another span
    place = F.struct("doc_id", "row", "lo", "hi")
    chosen = held.where("differ").groupBy("seed", "span").agg(F.min(place).alias("p")).select("seed", "p.*")
    windows = scratch.keep(_windows(docs, chosen, length))
    single = _smallest(windows, ["seed", "run"], scratch).where("doc_id > first").select("doc_id", "row", "lo", (F.col("lo") + length).alias("hi"))
    return scratch.finish(whole.union(single).groupBy("doc_id", "row").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges")))


def joined_ranges(ranges: list[dict] | None) -> list[tuple[int, int]]:
    """Ranges that touch or overlap as one, in order: the maximal repeats."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted((r["lo"], r["hi"]) for r in ranges or ()):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def _kept(n: int, ranges: list[dict] | None) -> np.ndarray:
    """Which of ``n`` words stay."""
    stays = np.ones(n, bool)
    for lo, hi in joined_ranges(ranges):
        if hi > n:
            raise ValueError(f"a repeat ends at word {hi} of {n}")
        stays[lo:hi] = False
    return stays


def _with_ranges(docs: DataFrame, length: int) -> DataFrame:
    docs = docs.withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")})
    found = repeats(docs.select("doc_id", "text"), Scratch(docs.sparkSession, "substring"), length)
    found = found.select(F.col("doc_id").alias("__of"), F.col("row").alias("__row"), F.col("ranges").alias("__ranges"))
    mine = (F.col("doc_id") == F.col("__of")) & (F.xxhash64("text") == F.col("__row"))
    return docs.join(found, mine, "left").drop("__of", "__row")


def maximal_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, lo, hi, passage: the words lo <= i < hi of a row that documents with smaller ids have too.

    Every word of a passage lies in a run of ``length`` words that also stands
    in a smaller document; passages of a row neither touch nor overlap. Rows
    without one give none. Nulls, repeats and empty tables are as in ``removals``.
    """

    def cut(batches):
        for batch in slices(batches):
            out = []
            for doc_id, text, ranges in zip(batch.column("doc_id").to_pylist(), _texts(batch), batch.column("__ranges").to_pylist()):
                words = _words(text)
                out += [(doc_id, lo, hi, b" ".join(words[lo:hi]).decode()) for lo, hi in joined_ranges(ranges)]
            columns = zip(*out) if out else ((),) * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.string()))], names=["doc_id", "lo", "hi", "passage"])

    rows = _with_ranges(docs.select("doc_id", "text"), length).where("__ranges is not null").select("doc_id", "text", "__ranges")
    return rows.mapInArrow(cut, "doc_id long, lo int, hi int, passage string")


def removals(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row of ``docs`` (columns doc_id, text).

    Null, empty and blank texts have no words and keep nothing; texts under
    ``length`` words lose nothing. Rows with a null id neither lose words nor
    take any from others. Rows that repeat an id take nothing from each other,
    none being smaller, and each loses only what it has in common with smaller
    ids itself. Extra columns are ignored. An empty table gives an empty result.
    """

    def digest(batches):
        for batch in slices(batches):
            out = []
            for text, ranges in zip(_texts(batch), batch.column("__ranges").to_pylist()):
                words = _words(text)
                if ranges:
                    stays = _kept(len(words), ranges)
                    left = [w for w, ok in zip(words, stays.tolist()) if ok]
                else:
                    left = words
                out.append((len(words), len(words) - len(left), hashlib.sha256(b" ".join(left)).hexdigest()))
            n, gone, sha = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept_sha256": pa.array(sha, pa.string()),
            })

    rows = _with_ranges(docs.select("doc_id", "text"), length)
    return rows.select("doc_id", "text", "__ranges").mapInArrow(digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def cut_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with the repeated passages cut out of ``text`` and ``n_chars`` counted anew where it exists.

    Texts that lose nothing stay as they are. In the others the kept words
    stand with the white space that preceded them. All columns and rows stay;
    null, empty and repeated rows are as in ``removals``. An empty table gives
    an empty result.
    """
    schema = docs.schema

    def cut(batches):
        import re

        word = re.compile(rb"[^\x20\x09-\x0D]+")
        for batch in slices(batches):
            texts = _texts(batch)
            for i, ranges in enumerate(batch.column("__ranges").to_pylist()):
                if ranges:
                    text = texts[i] or b""
                    spans = [m.span() for m in word.finditer(text)]
                    stays = _kept(len(spans), ranges).tolist()
                    parts, end = [], 0
                    for (a, b), ok in zip(spans, stays):
                        if ok:
                            parts.append(text[end:b] if parts or end == 0 else text[a:b])
                        end = b
                    texts[i] = b"".join(parts)
            columns = {name: batch.column(name) for name in batch.schema.names if name != "__ranges"}
            columns["text"] = pa.array([None if t is None else t.decode() for t in texts], pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    rows = _with_ranges(docs, length)
    out = rows.select(*[F.col(f"`{c}`") for c in docs.columns], "__ranges")
    wide = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.drop("__ranges").schema)
    out = out.mapInArrow(cut, wide)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast(schema["n_chars"].dataType)))
    return out
