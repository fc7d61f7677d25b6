"""Operator 9: exact n-gram Jaccard join by prefixes under several global orders.

A document is the set of its distinct five-word shingles (64-bit hashes). Two
sets with Jaccard similarity t or more share an element among the first
n - ceil(t n) + 1 elements of either, whatever order all elements are put in,
provided the order is the same for both. So every order is a filter without
misses, and a candidate has to pass several of them:

* the first order puts shingles that occur in many documents last (found on a
  hash sample of documents; it only shapes the order, so it drops nothing) and
  is used as an inverted index;
* further orders are independent permutations; each document of a candidate
  pair carries its prefixes under them, and a pair goes on to the exact count
  only if every order lets it pass.

Documents with equal sets form one class. Only classes are compared, and links
inside a known component are not looked for. A posting list of more than
``SMALL_LIST`` classes never gives all its pairs: in each round a few members
(pivots) are compared with the members of other components, the found links are
contracted, and the round repeats with PIVOTS times as many pivots for the lists
that still hold several components. A pivot has then met every member, so the
rounds end with exactly the components of the full link graph.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import contract
from .scratch import Scratch
from .text import WordHashes, give_back, mix, shingle_hashes, slices

WIDTH = 5
PERCENT = 75
#: Lists up to this many classes give all their pairs that the places allow at once.
SMALL_LIST = 16
#: Each round compares so many times more pivots of a list than the one before.
PIVOTS = 32
#: One document in SAMPLE tells which shingles are frequent; HOT_COUNT of them make one so.
SAMPLE, HOT_COUNT = 16, 6
#: Most frequent shingles that the first order knows (8 bytes each are broadcast).
HOT_LIMIT = 500_000
#: Ids up to this many are broadcast (8 bytes each), and pivots up to a quarter; beyond, Spark joins by shuffling.
ID_LIMIT = 2_000_000
#: Posting rows, and candidate pairs, that a task holds at once when it groups lists.
BLOCK = 200_000
#: Seeds of the further orders.
ORDERS = (0x51ED270B, 0xB5297A4D)


def _u64(seed: int) -> np.uint64:
    return np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64))


def shingle_set(text: bytes | None, hashes: WordHashes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct shingle hashes of a text (none for a null or blank one)."""
    found = np.sort(shingle_hashes(hashes.of((text or b"").lower().split()), width))
    return found[np.concatenate([[True], found[1:] != found[:-1]])] if len(found) else found


def set_digest(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def class_key(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def prefix_length(n: int, percent: int = PERCENT) -> int:
    """First elements that hold a common one for every set that is similar enough."""
    return n - -(-percent * n // 100) + 1 if n else 0


def overlap_possible(n_a, n_b, at_a, at_b, percent: int = PERCENT):
    """Whether sets whose first common element stands at these places can be similar enough (arrays or columns)."""
    return ((n_a - at_a) * (100 + percent) >= percent * (n_a + n_b)) & ((n_b - at_b) * (100 + percent) >= percent * (n_a + n_b))


def sketch(tokens: np.ndarray, percent: int = PERCENT) -> list[np.ndarray]:
    """For each further order the prefix of the set, as the sorted upper halves of its keys."""
    length = prefix_length(len(tokens), percent)
    out = []
    for seed in ORDERS:
        keys = (mix(tokens ^ _u64(seed)) >> np.uint64(32)).astype(np.uint32)  # mix() wraps silently
        out.append(np.sort(keys)[:length])
    return out


def may_link(n_a: int, sketch_a: list[np.ndarray], n_b: int, sketch_b: list[np.ndarray], percent: int = PERCENT) -> bool:
    """Filters of the further orders: a shared prefix element, and not too many elements known to be missing.

    An element of one prefix that lies before the end of the other prefix and
    is not in it is missing from the other set for certain.
    """
    if not n_a or not n_b:
        return False
    least = -(-percent * (n_a + n_b) // (100 + percent))
    for x, y in zip(sketch_a, sketch_b):
        common = len(np.intersect1d(x, y))
        if not common:
            return False
        end = min(x[-1], y[-1])
        # truncated keys may repeat, so only distinct ones are counted as missing
        if len(np.unique(x[x < end])) - common > n_a - least or len(np.unique(y[y < end])) - common > n_b - least:
            return False
    return True


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """The exact test on two sets."""
    if not len(a) or not len(b):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _binary(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    return batch.column(name).cast(pa.binary()).to_pylist()


def frequent_shingles(docs: DataFrame) -> np.ndarray:
    """Shingles of many sampled documents, most frequent first up to HOT_LIMIT."""

    def tokens(batches):
        hashes = WordHashes()
        for batch in slices(batches):
            for text in _binary(batch, "text"):
                yield pa.RecordBatch.from_pydict({"token": shingle_set(text, hashes).view(np.int64)})

    sampled = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0).select("text")
    counts = sampled.mapInArrow(tokens, "token long").groupBy("token").count().where(F.col("count") >= HOT_COUNT)
    rows = counts.orderBy(F.desc("count"), "token").limit(HOT_LIMIT).select("token").toArrow()
    return np.sort(rows.column("token").to_numpy().view(np.uint64))


def signatures(docs: DataFrame, hot: np.ndarray, percent: int = PERCENT) -> DataFrame:
    """doc_id, n, class key, digest of the set, and its prefix in the first order (frequent ones last)."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def sign(batches):
        hashes, hot = WordHashes(), shared.value
        for batch in slices(batches):
            digests, keys, sizes, cold, warm = [], [], [], [], []
            for text in _binary(batch, "text"):
                s = shingle_set(text, hashes)
                digest = set_digest(s)
                at = np.minimum(np.searchsorted(hot, s), max(len(hot) - 1, 0))
                known = hot[at] == s if len(hot) else np.zeros(len(s), bool)
                length = prefix_length(len(s), percent)
                first = s[~known][:length]
                rest = s[known][: length - len(first)]
                digests.append(digest)
                keys.append(class_key(digest))
                sizes.append(len(s))
                cold.append(first.tobytes())
                warm.append(rest.tobytes())
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "n": pa.array(sizes, pa.int64()), "key": pa.array(keys, pa.int64()),
                "digest": pa.array(digests, pa.binary()), "cold": pa.array(cold, pa.binary()), "warm": pa.array(warm, pa.binary()),
            })

    return docs.select("doc_id", "text").mapInArrow(sign, "doc_id long, n long, key long, digest binary, cold binary, warm binary")


def _postings(signed: DataFrame, column: str) -> DataFrame:
    """(token, key, n, at) rows of the prefixes, ``at`` being the place in the set's order; copies within a task give one."""
    skip = F.lit(0) if column == "cold" else (F.octet_length("cold") / 8).cast("long")

    def explode(batches):
        seen = set()
        for batch in slices(batches):
            tokens, keys, sizes, places = [], [], [], []
            rows = zip(*(batch.column(c).to_pylist() for c in ("key", "n", "skip", column)))
            for key, n, skipped, blob in rows:
                if not blob or key in seen:
                    continue
                if len(seen) < 200_000:
                    seen.add(key)
                tokens.append(np.frombuffer(blob, np.int64))
                count = len(tokens[-1])
                keys.append(np.full(count, key, np.int64))
                sizes.append(np.full(count, n, np.int32))
                places.append(np.arange(skipped, skipped + count, dtype=np.int32))
            if tokens:
                yield pa.RecordBatch.from_pydict({"token": np.concatenate(tokens), "key": np.concatenate(keys), "n": np.concatenate(sizes), "at": np.concatenate(places)})

    return signed.select("key", "n", skip.alias("skip"), column).mapInArrow(explode, "token long, key long, n int, at int")


class _Lists:
    """Posting rows in token order -> pairs of short lists and rows of longer ones, a bounded block at a time."""

    def __init__(self, percent: int):
        self.percent = percent
        self.rest = [np.zeros(0, np.int64)] * 4  # rows of the last token so far: token, key, n, at
        self.long: int | None = None  # the last token, once it is known to have a longer list
        self.found: list[np.ndarray] = []  # pairs, with repeats
        self.size = 0

    def take(self, columns: list[np.ndarray], last: bool = False):
        """Record batches for what is complete with these rows."""
        columns = [np.concatenate([x, y]) for x, y in zip(self.rest, columns)]
        self.rest = [x[:0] for x in columns]
        if self.long is not None:
            more = columns[0] == self.long
            yield from self._rows([x[more] for x in columns])
            columns = [x[~more] for x in columns]
        if not len(columns[0]):
            return
        order = np.lexsort((columns[1], columns[0]))
        columns = [x[order] for x in columns]
        fresh = np.concatenate([[True], (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1])])
        columns = [x[fresh] for x in columns]
        if not last:
            tail = columns[0] == columns[0][-1]
            if tail.sum() > SMALL_LIST:
                self.long = int(columns[0][-1])
            else:
                self.rest = [x[tail] for x in columns]
                columns = [x[~tail] for x in columns]
        token, key, n, at = columns
        starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
        sizes = np.diff(np.concatenate([starts, [len(token)]]))
        for size in range(2, SMALL_LIST + 1):
            first = starts[sizes == size]
            for i in range(size if len(first) else 0):
                for j in range(i + 1, size):
                    x, y = first + i, first + j
                    ok = overlap_possible(n[x], n[y], at[x], at[y], self.percent)
                    self.found.append(np.stack([key[x[ok]], key[y[ok]]], axis=1))
                    self.size += len(self.found[-1])
        if self.size > 4 * BLOCK:
            self._distinct()
            if self.size > 2 * BLOCK:
                yield from self.flush()
        if last:
            yield from self.flush()
        longer = np.repeat(sizes > SMALL_LIST, sizes)
        yield from self._rows([x[longer] for x in columns])

    @staticmethod
    def _rows(columns: list[np.ndarray]):
        token, key, n, at = columns
        if len(token):
            yield pa.RecordBatch.from_pydict({"token": token, "key": key, "n": n.astype(np.int32), "at": at.astype(np.int32), "other": pa.nulls(len(token), pa.int64())})

    def _distinct(self) -> None:
        pairs = np.concatenate(self.found)
        pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
        pairs = pairs[np.concatenate([[True], (pairs[1:] != pairs[:-1]).any(axis=1)])] if len(pairs) else pairs
        self.found, self.size = [pairs], len(pairs)

    def flush(self):
        if self.size:
            self._distinct()
            pairs, self.found, self.size = self.found[0], [], 0
            none, none32 = pa.nulls(len(pairs), pa.int64()), pa.nulls(len(pairs), pa.int32())
            yield pa.RecordBatch.from_pydict({"token": none, "key": pa.array(pairs[:, 0]), "n": none32, "at": none32, "other": pa.array(pairs[:, 1])})


def _cold_lists(postings: DataFrame, percent: int) -> DataFrame:
    """Groups the rare tokens: pairs of short lists (token null, key and other), rows of longer lists (other null).

    Spark sorts (and spills); the function sees each list's rows one after the
    other and holds a block of rows, a short list and a block of pairs.
    """

    def group(batches):
        give_back()
        lists, held, size = _Lists(percent), [], 0
        none = [np.zeros(0, np.int64)] * 4
        for batch in batches:
            held.append([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("token", "key", "n", "at")])
            size += batch.num_rows
            if size >= BLOCK:
                yield from lists.take([np.concatenate(c) for c in zip(*held)])
                held, size = [], 0
        yield from lists.take([np.concatenate(c) for c in zip(*held)] if held else none, last=True)
        yield from lists.flush()

    return postings.repartition("token").sortWithinPartitions("token").mapInArrow(group, "token long, key long, n int, at int, other long")


def _with_own_keys(signed: DataFrame, scratch: Scratch) -> DataFrame:
    """``signed`` with one key for each digest: where two sets have the same key, they get others until none have."""
    rounds = 0
    while True:
        other = F.xxhash64("digest")
        shared = signed.groupBy("key").agg(F.min(other).alias("lo"), F.max(other).alias("hi")).where("lo <> hi")
        shared = scratch.keep(shared.select("key", F.lit(True).alias("shared")))
        n = shared.count()
        if not n:
            return signed
        rounds += 1
        joined = signed.join(F.broadcast(shared) if n <= ID_LIMIT else shared, "key", "left")
        key = F.when(F.col("shared"), F.xxhash64("digest", F.lit(rounds))).otherwise(F.col("key"))
        signed = scratch.keep(joined.withColumn("key", key).select(*signed.columns))


def _small(rows: DataFrame, limit: int) -> DataFrame:
    """A written table, to be broadcast if it has no more rows than ``limit``."""
    return F.broadcast(rows) if rows.count() <= limit else rows


def _sketches(docs: DataFrame, ids: DataFrame, percent: int) -> DataFrame:
    """key, n, sketch, text for the documents of ``ids`` (doc_id, key, digest of the set)."""

    def build(batches):
        hashes = WordHashes()
        for batch in slices(batches):
            sizes, blobs, same = [], [], []
            for digest, text in zip(batch.column("digest").to_pylist(), _binary(batch, "text")):
                s = shingle_set(text, hashes)
                sizes.append(len(s))
                blobs.append(b"".join(x.tobytes() for x in sketch(s, percent)))
                same.append(set_digest(s) == digest)  # another row may have the same id
            out = pa.RecordBatch.from_pydict({"key": batch.column("key"), "n": pa.array(sizes, pa.int32()), "sketch": pa.array(blobs, pa.binary()), "text": batch.column("text")})
            yield out.filter(pa.array(same, pa.bool_()))

    chosen = docs.select("doc_id", "text").join(_small(ids, ID_LIMIT // 4), "doc_id").select("key", "digest", "text")
    return chosen.mapInArrow(build, "key long, n int, sketch binary, text string")


def _both(pairs: DataFrame, sets: DataFrame, *columns: str) -> DataFrame:
    """The pairs (a, b) with the named columns of both sides, as a_<name> and b_<name>."""
    for side in ("b", "a"):
        part = sets.select(F.col("key").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in columns])
        pairs = pairs.join(part, side)
    return pairs.select("a", "b", *[f"{side}_{c}" for side in ("a", "b") for c in columns])


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are similar enough: filters of the further orders first, then the exact count."""

    def halves(blob: bytes) -> list[np.ndarray]:
        return np.split(np.frombuffer(blob, np.uint32), len(ORDERS))

    def screen(batches):
        for batch in slices(batches):
            rows = zip(*(batch.column(c).to_pylist() for c in ("a_n", "a_sketch", "b_n", "b_sketch")))
            ok = [may_link(n, halves(x), m, halves(y), percent) for n, x, m, y in rows]
            kept = batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))
            if kept.num_rows:
                yield kept

    def verify(batches):
        hashes = WordHashes()
        for batch in slices(batches):
            rows = zip(_binary(batch, "a_text"), _binary(batch, "b_text"))
            ok = [similar(shingle_set(x, hashes), shingle_set(y, hashes), percent) for x, y in rows]
            kept = batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))
            if kept.num_rows:
                yield kept

    left = _both(pairs, sets, "n", "sketch").mapInArrow(screen, "a long, b long")
    return _both(left, sets, "text").mapInArrow(verify, "a long, b long")


def class_components(docs: DataFrame, scratch: Scratch, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(signed, labels): doc_id, n, key, digest of all documents; ``node, label`` of class keys with a link to another class."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    begin = scratch.n
    signed = _with_own_keys(scratch.keep(signatures(docs, frequent_shingles(docs), percent)), scratch)
    lists = scratch.keep(_cold_lists(_postings(signed, "cold"), percent))
    prefixes = range(begin + 1, scratch.n + 1)
    opened = lists.where("token is not null").select("token", "key", "n", "at")
    opened = scratch.keep(opened.union(_postings(signed, "warm")).distinct())
    pairs = scratch.keep(lists.where("token is null").select(F.col("key").alias("a"), F.col("other").alias("b")).distinct())

    sizes = opened.groupBy("token").agg(F.count("*").alias("c")).where("c > 1")
    weight = opened.join(sizes, "token").groupBy("key").agg(F.sum("c").alias("weight"))
    opened = scratch.keep(opened.join(sizes.select("token"), "token", "left_semi").join(weight, "key"))

    met = pairs.select(F.explode(F.array("a", "b")).alias("key")).union(opened.select("key")).distinct()
    firsts = signed.where("n > 0").join(met, "key", "left_semi").groupBy("key", "digest").agg(F.min("doc_id").alias("doc_id"))
    sets = scratch.keep(_sketches(docs, scratch.keep(firsts.where("doc_id is not null").select("doc_id", "key", "digest")), percent))
    signed = scratch.keep(signed.select("doc_id", "n", "key", "digest"))
    scratch.drop(*prefixes)  # the tables with the prefixes of all documents, which are large, have been read

    labels = docs.sparkSession.createDataFrame([], "node long, label long")
    tested, links, rounds = None, None, 0
    while True:
        # lists that still hold several components
        named = opened.join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))
        active = scratch.keep(named.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("token"))
        named = scratch.keep(named.join(_small(active, ID_LIMIT), "token", "left_semi"))
        if not named.isEmpty():
            part = F.pmod(F.xxhash64("key", F.lit(rounds)), F.lit(PIVOTS**rounds))
            pivots = named.groupBy("token", part.alias("part")).agg(F.max(F.struct("weight", "key", "label", "n", "at")).alias("p"))
            pivots = scratch.keep(pivots.select("token", F.col("p.key").alias("pivot"), F.col("p.label").alias("other"), F.col("p.n").alias("pn"), F.col("p.at").alias("pat")))
            star = named.join(_small(pivots, ID_LIMIT // 4), "token").where(F.col("label") != F.col("other"))
            star = star.where(overlap_possible(F.col("n"), F.col("pn"), F.col("at"), F.col("pat"), percent))
            star = star.select(F.least("key", "pivot").alias("a"), F.greatest("key", "pivot").alias("b"))
            pairs = star if pairs is None else pairs.union(star)
            used = _small(pivots.select("token", F.col("pivot").alias("key")), ID_LIMIT // 4)
            opened = named.select("token", "key", "weight", "n", "at").join(used, ["token", "key"], "left_anti")
        elif pairs is None:
            break
        pairs = pairs.distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = scratch.keep(pairs)
        found = scratch.keep(_linked(pairs, sets, percent))
        tested = pairs if tested is None else tested.union(pairs)
        if not found.isEmpty():
            links = found if links is None else links.union(found)
            labels = contract(links, scratch)
        if named.isEmpty():
            break
        pairs, rounds = None, rounds + 1
    return signed, labels


def components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs`` (columns doc_id, text).

    Null, empty and blank texts have no shingles and are linked with nothing.
    Repeated rows give repeated rows; rows that share an id but not the text
    are sets of their own under that id. A row with a null id belongs to the
    component of the rows with the same shingles, links nothing by itself, and
    has a null ``component_id`` where no such row has an id. Extra columns are
    ignored. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    signed, labels = class_components(docs, scratch, percent)
    named = signed.join(labels.withColumnRenamed("node", "key"), "key", "left")
    # a class without links to others keeps its whole digest as name
    name = F.when(F.col("label").isNull(), F.col("digest")).otherwise(F.col("label").cast("string").cast("binary"))
    named = named.select("doc_id", "n", F.when(F.col("n") > 0, name).alias("group"))
    # both sides of the join are written, so that adaptive execution may split the rows of a hot group
    named = scratch.keep(named)
    smallest = scratch.keep(named.where("n > 0").groupBy("group").agg(F.min("doc_id").alias("first")))
    first = F.when(F.col("n") > 0, F.col("first")).otherwise(F.col("doc_id"))
    return scratch.finish(named.join(smallest, "group", "left").select("doc_id", F.col("n").alias("n_shingles"), first.alias("component_id")))


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` whose id names their component; all columns stay.

    Rows that repeat an id are one document and share its fate; rows with a
    null id stay.
    """
    away = components(docs, percent).where("doc_id <> component_id").select(F.col("doc_id").alias("__away")).distinct()
    return docs.join(away, F.col("doc_id") == F.col("__away"), "left_anti")
