"""Operator 7: packing of documents into windows by Karmarkar-Karp multiway differencing.

A document's ids are cut into full windows, which need no company, and a rest
that is cut into pieces of at most ``PIECE`` ids. Pieces are dealt by hash into
groups of about ``GROUP_WINDOWS`` windows. In a group every piece begins as a
partial partition with one non-empty part; the two partitions with the largest
spread are merged, the largest parts of one with the smallest of the other,
until one is left, whose parts are the windows. They come out near equal; when
one exceeds the capacity the group is done again with one window more.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import QuickBpe, default_vocabulary, memory
from .scratch import Scratch
from .text import slices

CAPACITY = 2048
PIECE = 512
END_ID = 1
GROUP_WINDOWS = 256


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Indexes of ``sizes`` in k parts with near-equal sums."""
    # (minus spread, number, sums from the largest, their members); parts with sum 0 are not listed
    heap = [(-size, i, [size], [[i]]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    number = len(heap)
    while len(heap) > 1:
        _, _, sums, members = heapq.heappop(heap)
        _, _, more, others = heapq.heappop(heap)
        over = len(sums) + len(more) - k
        if over > 0:
            # the last ``over`` parts of one meet those of the other, largest with smallest
            met = [a + b for a, b in zip(sums[-over:], more[-over:][::-1])]
            joined = [a + b for a, b in zip(members[-over:], others[-over:][::-1])]
            sums, members = sums[:-over] + more[:-over] + met, members[:-over] + others[:-over] + joined
        else:
            sums, members = sums + more, members + others
        order = sorted(range(len(sums)), key=sums.__getitem__, reverse=True)
        sums, members = [sums[i] for i in order], [members[i] for i in order]
        if len(sums) == k and sums[-1]:
            least = sums[-1]
            sums = [x - least for x in sums]
        heapq.heappush(heap, (-(sums[0] - (sums[-1] if len(sums) == k else 0)), number, sums, members))
        number += 1
    parts = heap[0][3] if heap else []
    return parts + [[] for _ in range(k - len(parts))]


def windows(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Parts of at most ``capacity``, as few as differencing can fill evenly."""
    if not sizes:
        return []
    k = -(-sum(sizes) // capacity)
    while True:
        parts = difference(sizes, k)
        if all(sum(sizes[i] for i in part) <= capacity for part in parts):
            return [part for part in parts if part]
        k += 1


def pieces(docs: DataFrame, vocabulary: str, capacity: int, piece: int) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of the cuts of every document."""

    def cut(batches):
        packed = memory("bytes", vocabulary, QuickBpe, lambda bpe, ids: np.array(ids, "<u4").tobytes())
        bpe = packed.bpe
        end = np.array([END_ID], "<u4").tobytes()
        for batch in slices(batches, keep=("bytes", vocabulary)):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = b"".join(map(packed.__getitem__, bpe.parts(text or ""))) + end
                n = len(ids) // 4
                full = n - n % capacity
                starts = [*range(0, full, capacity), *range(full, n, piece)]
                for start, stop in zip(starts, [*starts[1:], n]):
                    rows.append((doc_id, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop]), n))
            columns = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def packed(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, piece: int = PIECE) -> DataFrame:
    """The pieces of all rows of ``docs`` (doc_id, text) with sequence_id and offset.

    Null and empty texts are one end id. Repeated rows are packed each. Null
    ids stay null. Extra columns are ignored and an empty table gives an empty
    result. Every id of a document lies in exactly one piece and offsets in a
    sequence have no gap.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    cuts = scratch.keep(pieces(docs, vocabulary or default_vocabulary(), capacity, piece))
    rest = cuts.agg(F.sum(F.when(F.col("length") < capacity, F.col("length"))).alias("rest"), F.count("*").alias("n")).first()
    groups = max(1, round((rest["rest"] or 0) / (capacity * GROUP_WINDOWS)), (rest["n"] or 0) // 20_000)

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        group = table.column("group")[0].as_py()
        sizes = table.column("length").to_pylist()
        small = [i for i, x in enumerate(sizes) if x < capacity]
        parts = [[small[j] for j in part] for part in windows([sizes[i] for i in small], capacity)]
        parts += [[i] for i, x in enumerate(sizes) if x >= capacity]
        sequence, offset = [0] * len(sizes), [0] * len(sizes)
        for number, part in enumerate(parts):
            at = 0
            for i in sorted(part):
                sequence[i], offset[i] = group << 32 | number, at
                at += sizes[i]
        out = table.drop_columns(["group"])
        return out.append_column("sequence_id", pa.array(sequence, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    dealt = cuts.withColumn("group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups)).cast("long"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return dealt.groupBy("group").applyInArrow(pack, schema)
