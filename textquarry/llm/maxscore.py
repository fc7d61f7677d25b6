"""Operator 5: exact top-k inner products by MaxScore over shards.

Components become whole numbers. Every component is a query term whose posting
list holds each vector of a shard with an impact: the distance of its product
from the least that the shard's range allows, so impacts are never negative and
their bound is the range times the weight. A query puts its terms in the order
of their bounds. The last terms, whose bounds together leave a score under the
current k-th one, are non-essential: the postings of the essential terms are
traversed, the others are probed, a few at a time, only for vectors that can
still enter the top k.

A task goes through its vectors shard by shard and keeps each query's k best,
whose last is the floor for the next shard; a window merges the tasks' winners.
Vectors stay where they are read. The queries come to them in chunks of at most
about ``CHUNK_BYTES``, broadcast one after the other.

Scores are exact: sums are taken in floating point where they stay under 2**53,
otherwise floating point with its error bound only rules candidates out, and
whole numbers of any size score those that are left.
"""

from __future__ import annotations

from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

K = 20
#: Vectors met at once; sums held at once; vectors that give a first floor; terms probed at once.
SHARD, SUMS, SEED, STEP = 8_192, 2_000_000, 1_024, 8
#: While more than one vector in so many is competitive, they are probed together, with so many steps at once.
MANY = 4
#: Bytes of query components that are broadcast at once (a hash deals them, so chunks vary a little).
CHUNK_BYTES = 1 << 25
LONG_MIN, LONG_MAX = -(1 << 63), (1 << 63) - 1


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Components as rows, shorter vectors filled up with zeros."""
    sizes, flat = column.value_lengths().to_numpy(zero_copy_only=False), column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == dims).all():
        return flat.reshape(len(sizes), dims)
    out = np.zeros((len(sizes), dims))
    out[np.arange(dims) < sizes[:, None]] = flat
    return out


def whole(x: np.ndarray) -> np.ndarray:
    """floor(64 x); infinite where that is no double."""
    with np.errstate(over="ignore"):
        return np.floor(64.0 * x)


def exact_row(x: np.ndarray) -> list[int]:
    """floor(64 x) as whole numbers of any size."""
    return [int(w) if np.isfinite(w) else int(v) * 64 for v, w in zip(x.tolist(), whole(x).tolist())]


def _scaled(x: np.ndarray) -> tuple[np.ndarray, int]:
    """floor(64 x) / 2**e with values within one, and e."""
    w = whole(x)
    top = np.abs(w).max(initial=0.0)
    e = int(np.frexp(top)[1]) if np.isfinite(top) else int(np.frexp(np.abs(x).max())[1]) + 7
    return np.where(np.isfinite(w), np.ldexp(w, -e), np.ldexp(x, 6 - e)), e


def _kth(values: np.ndarray, k: int) -> float:
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else -np.inf


def search(queries: np.ndarray, owns: np.ndarray, ids: np.ndarray, vectors: np.ndarray, floors: np.ndarray, k: int = K, slack: float = 0.0, most: float = np.inf):
    """(row, places, scores) for each query: the vectors of a shard that can be among its k best, with ties.

    ``floors`` are scores under which a vector is not wanted (or -inf). ``slack``
    bounds the error of a sum; scores beyond ``most`` or its negative are alike.
    """
    n, dims = vectors.shape
    low, high = vectors.min(axis=0), vectors.max(axis=0)

    def bounded(score):
        score = np.minimum(score - slack, most)
        return np.where(score <= -most, -np.inf, score)

    for begin in range(0, len(queries), max(1, SUMS // n)):
        rows = slice(begin, begin + max(1, SUMS // n))
        q, own, least = queries[rows], owns[rows], bounded(floors[rows])
        m = len(q)
        new = np.flatnonzero(np.isneginf(least))
        if len(new) and n >= k:
            some = q[new] @ vectors[:SEED].T
            some[own[new, None] == ids[None, :SEED]] = -np.inf
            least[new] = bounded(np.partition(some, some.shape[1] - k, axis=1)[:, some.shape[1] - k])

        bounds = np.abs(q) * (high - low)
        worst = np.where(q > 0, q * low, q * high)
        base = worst.sum(axis=1)
        order = np.argsort(-bounds, axis=1, kind="stable")
        rest = np.zeros((m, dims + 1), bounds.dtype)
        rest[:, :dims] = np.cumsum(np.take_along_axis(bounds, order, axis=1)[:, ::-1], axis=1)[:, ::-1]
        under = base[:, None] + rest < least[:, None]
        essential = np.where(under.any(axis=1), under.argmax(axis=1), dims)

        def terms_between(begin, end) -> np.ndarray:
            mask = np.zeros((m, dims), bool)
            place = np.arange(dims)
            np.put_along_axis(mask, order, (place >= begin[:, None]) & (place < end[:, None]), axis=1)
            return mask

        mask = terms_between(np.zeros(m, np.int64), essential)
        used = np.flatnonzero(mask.any(axis=0))
        postings = vectors if len(used) == dims else vectors[:, used]
        lower = (q * mask)[:, used] @ postings.T + (base - (worst * mask).sum(axis=1))[:, None]
        mine = np.flatnonzero(np.isin(own, ids))
        lower[mine] = np.where(own[mine, None] == ids[None, :], -np.inf, lower[mine])
        probed = essential
        while True:
            competitive = lower + rest[np.arange(m), probed][:, None] >= least[:, None]
            if MANY * competitive.sum() <= competitive.size or (probed == dims).all():
                break
            # while most vectors are competitive, they are all probed at once
            if n >= k:
                least = np.maximum(least, bounded(np.partition(lower, n - k, axis=1)[:, n - k]))
            further = np.minimum(probed + MANY * STEP, dims)
            mask = terms_between(probed, further)
            lower += (q * mask) @ vectors.T - (worst * mask).sum(axis=1)[:, None]
            probed = further

        for j in range(m):
            alive = np.flatnonzero(competitive[j])
            score, at, floor = lower[j, alive], int(probed[j]), least[j]
            while len(alive):
                # what is still to come never lowers a score, so the k-th best so far is a floor
                floor = max(floor, bounded(_kth(score, k)))
                going = score + rest[j, at] >= floor
                alive, score = alive[going], score[going]
                if at >= dims:
                    break
                terms = order[j, at : at + STEP]
                score = score + (vectors[alive[:, None], terms] @ q[j, terms] - worst[j, terms].sum())
                at += len(terms)
            found = score > -np.inf
            yield begin + j, alive[found], score[found]


class Best:
    """The k best scores of each query so far; ties go to the smaller id."""

    def __init__(self, n: int, k: int):
        self.k, self.size = k, np.zeros(n, np.int64)
        self.scores, self.ids = np.full((n, k), LONG_MIN, np.int64), np.zeros((n, k), np.int64)

    def floors(self, rows: np.ndarray) -> np.ndarray:
        last = self.scores[rows, self.k - 1]
        return np.where((self.size[rows] == self.k) & (last > LONG_MIN), last.astype(float), -np.inf)

    def add(self, row: int, scores: np.ndarray, ids: np.ndarray) -> None:
        n = self.size[row]
        scores, ids = np.concatenate([self.scores[row, :n], scores]), np.concatenate([self.ids[row, :n], ids])
        order = np.lexsort((ids, ~scores))[: self.k]  # ~x falls as x grows, also at the ends
        n = self.size[row] = len(order)
        self.scores[row, :n], self.ids[row, :n] = scores[order], ids[order]


class Queries:
    """A chunk of queries with what all shards need of them."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        self.ids, self.values, self.whole = ids, values, whole(values)
        dims = values.shape[1]
        #: Vectors and queries with components up to this have sums under 2**53, their differences included.
        self.narrow = float(int((2.0**51 / max(dims, 1)) ** 0.5))
        small = np.abs(self.whole).max(axis=1, initial=0.0) <= self.narrow
        self.small, self.wide = np.flatnonzero(small), np.flatnonzero(~small)

    def meet(self, best: Best, ids: np.ndarray, values: np.ndarray) -> None:
        """Takes the vectors of a shard into ``best``."""
        w = whole(values)
        small = np.abs(w).max(axis=1, initial=0.0) <= self.narrow
        if small.any() and len(self.small):
            q, v = self.whole[self.small], w[small]
            if 4 * max(v.shape[1], 1) * np.abs(q).max(initial=0.0) * np.abs(v).max(initial=0.0) < 1 << 24:
                q, v = q.astype(np.float32), v.astype(np.float32)  # still exact
            near = ids[small]
            for row, at, scores in search(q, self.ids[self.small], near, v, best.floors(self.small), best.k):
                best.add(self.small[row], scores.astype(np.int64), near[at])
        if small.any() and len(self.wide):
            self._meet_wide(best, self.wide, ids[small], values[small])
        if not small.all():
            self._meet_wide(best, np.arange(len(self.ids)), ids[~small], values[~small])

    def _meet_wide(self, best: Best, rows: np.ndarray, ids: np.ndarray, values: np.ndarray) -> None:
        (q, e), (v, f) = _scaled(self.values[rows]), _scaled(values)
        slack = 16.0 * v.shape[1] ** 2 * 2.0**-53
        exact: dict[int, list[int]] = {}
        found = search(q, self.ids[rows], ids, v, np.ldexp(best.floors(rows), -e - f), best.k, slack, float(np.ldexp(1.0, 63 - e - f)))
        for row, at, _ in found:
            mine = exact_row(self.values[rows[row]])
            for place in at.tolist():
                if place not in exact:
                    exact[place] = exact_row(values[place])
            scores = [min(max(sum(map(mul, mine, exact[place])), LONG_MIN), LONG_MAX) for place in at.tolist()]
            best.add(rows[row], np.array(scores, np.int64), ids[at])


def top_k(embeddings: DataFrame, queries: DataFrame | None = None, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score for the query rows against all other rows of ``embeddings`` (vec_id, embedding).

    The default queries are the rows whose vec_id is divisible by 20. Rows with
    a null id, a null vector or a null or non-finite component take no part.
    Shorter vectors count as filled up with zeros. Rows that share the query's
    id are its own row; other repeated rows each take their rank, a tie going to
    the smaller vec_id. Equal query rows count once, different ones under one id
    rank their finds together. Scores are exact for all finite components; one
    beyond the range of a long counts as the nearer end of that range. Extra
    columns are ignored; an empty table gives an empty result.
    """
    spark, scratch = embeddings.sparkSession, Scratch(embeddings.sparkSession, "maxscore")
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))

    def usable(rows: DataFrame) -> DataFrame:
        rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        return rows.where("vec_id is not null and embedding is not null").where(fine)

    vectors = usable(embeddings)
    asked = scratch.keep((vectors.where("vec_id % 20 = 0") if queries is None else usable(queries)).dropDuplicates())
    facts = asked.agg(F.count("*").alias("n"), F.sum(F.size("embedding")).alias("components"), F.max(F.size("embedding")).alias("dims")).first()
    dims = max(facts["dims"] or 0, vectors.agg(F.max(F.size("embedding"))).first()[0] or 0)
    chunks = max(1, -(-8 * facts["n"] * dims // CHUNK_BYTES))
    if vectors.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:
        vectors = vectors.repartition(spark.sparkContext.defaultParallelism)

    def winners(chunk: int) -> DataFrame:
        mine = asked.where(F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(chunks)) == chunk).toArrow().combine_chunks()
        values = matrix(mine.column("embedding").combine_chunks(), dims) if mine.num_rows else np.zeros((0, dims))
        shared = spark.sparkContext.broadcast((mine.column("vec_id").to_numpy().astype(np.int64), values))

        def run(batches):
            asked = Queries(*shared.value)
            best = Best(len(asked.ids), k)
            for batch in batches:
                for begin in range(0, batch.num_rows if len(asked.ids) else 0, SHARD):
                    part = batch.slice(begin, SHARD)
                    asked.meet(best, part.column("vec_id").to_numpy(zero_copy_only=False), matrix(part.column("embedding"), dims))
            for begin in range(0, len(asked.ids), SHARD):
                row, place = np.nonzero(np.arange(k) < best.size[begin : begin + SHARD, None])
                row += begin
                yield pa.RecordBatch.from_pydict({"query_id": asked.ids[row], "vec_id": best.ids[row, place], "score": best.scores[row, place]})

        found = scratch.keep(vectors.mapInArrow(run, "query_id long, vec_id long, score long"))
        shared.unpersist()
        return found

    found = winners(0)
    for chunk in range(1, chunks):
        found = found.unionByName(winners(chunk))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
