"""Operator 2: document likelihood over a lattice of subwords.

The pieces of an existing vocabulary file and their scores span a lattice over
each word (marked at its start); a forward recursion in log space sums all
segmentations. Scores that are log probabilities are taken as they are; merge
ranks, which the file of the query has, enter as a Zipf-like prior,
log p = -log(200 + rank). One expectation step over all training words turns
them into probabilities, for each class of documents (training value of
``lang``) by itself. A training word is a piece too, whose only edge goes from
the start of its lattice to the end: with c occurrences among N tokens and V
words of a class the pieces of the file share a weight of d V / N, and

    p(word) = sum over segmentations = (max(c - d, 0) + d V p_pieces(word)) / N,

    p(end) = ends / N and p(text) = sum over classes of share * product over tokens,

so the model is a proper distribution over texts. Lattice sums are computed
once for each distinct word of the corpus. Scores of the ``HOT`` most frequent
words are broadcast; the other words of each document are joined by word.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .text import fold

HELD_OUT = 10
HOT = 400_000
#: Training languages that get a class of their own, from the most frequent; the others share one (a parameter of ``likelihoods``).
CLASSES = 12
LONGEST = 16
#: Mass of characters that no piece spells, spread evenly over the values of their bytes.
UNKNOWN = 1e-4
START = "▁"
_BASE = np.uint64(0x100000001B3)
NEVER = -1e30


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def read_pieces(path: str) -> tuple[list[str], np.ndarray]:
    """(pieces, log prior) of a sentencepiece model, without control, unknown and byte pieces, or of a .vocab file of lines "piece TAB score".

    Scores that are all whole numbers are ranks, others log probabilities.
    """
    if path.endswith(".vocab"):
        with open(path, encoding="utf-8") as f:
            found = [(p, float(x)) for p, x in (line.rstrip("\n").split("\t") for line in f)]
        found = [(p, x) for p, x in found if not (p.startswith("<") and p.endswith(">"))]
    else:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        found = [
            (model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
        ]
    found = [(p, x) for p, x in found if 0 < len(p) <= LONGEST and x > -1e8]
    scores = np.array([x for _, x in found])
    prior = -np.log(200.0 - scores) if (scores == np.round(scores)).all() else scores
    top = prior.max()
    return [p for p, _ in found], prior - top - np.log(np.exp(prior - top).sum())


def _points(word: str) -> np.ndarray:
    return np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32)


class Lattice:
    """Sums over the segmentations of many words at once."""

    def __init__(self, pieces: list[str]):
        self.pieces = pieces
        self.by_length: list[tuple[np.ndarray, np.ndarray]] = []
        self.filter = np.zeros(1 << 20, bool)
        for length in range(1, LONGEST + 1):
            at = np.array([i for i, p in enumerate(pieces) if len(p) == length], np.int64)
            with np.errstate(over="ignore"):
                h = np.zeros(len(at), np.uint64)
                for place in range(length):
                    h = h * _BASE + np.array([ord(pieces[i][place]) for i in at], np.uint64)
            order = np.argsort(h)
            self.by_length.append((h[order], at[order]))
            self.filter[self._bit(h)] = True

    @staticmethod
    def _bit(h: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)

    def edges(self, points: np.ndarray) -> list[np.ndarray]:
        """For each length the piece (or -1) at every start, for words of one length as rows."""
        out, h = [], np.zeros(points.shape, np.uint64)
        wide = points.astype(np.uint64)
        for length in range(1, min(LONGEST, points.shape[1]) + 1):
            with np.errstate(over="ignore"):
                h = h[:, : points.shape[1] - length + 1] * _BASE + wide[:, length - 1 :]
            keys, names = self.by_length[length - 1]
            found = np.full(h.shape, -1, np.int64)
            if len(keys):
                maybe = self.filter[self._bit(h)]
                x = h[maybe]
                at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
                found[maybe] = np.where(keys[at] == x, names[at], -1)
            out.append(found)
        return out

    @staticmethod
    def spelled(points: np.ndarray) -> np.ndarray:
        """Log probability of each character when no piece spells it."""
        size = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        return math.log(UNKNOWN) - size * math.log(256)

    def forward(self, points: np.ndarray, edges: list[np.ndarray], scores: np.ndarray) -> np.ndarray:
        """Log sums (words, length + 1, classes); ``scores`` is (pieces + 1, classes), last row NEVER."""
        n, length = points.shape
        alpha = np.full((n, length + 1, scores.shape[1]), NEVER)
        alpha[:, 0] = 0
        spell = self.spelled(points)
        for end in range(1, length + 1):
            terms = [alpha[:, end - k] + scores[edges[k - 1][:, end - k]] for k in range(1, min(end, LONGEST) + 1)]
            terms.append(alpha[:, end - 1] + spell[:, end - 1, None])
            stack = np.stack(terms)
            top = stack.max(axis=0)
            alpha[:, end] = top + np.log(np.exp(stack - top).sum(axis=0))
        return alpha

    def expect(self, points: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, piece, expected uses) under one column of scores."""
        edges = self.edges(points)
        n, length = points.shape
        alpha = self.forward(points, edges, scores)[:, :, 0]
        beta = np.full((n, length + 1), NEVER)
        beta[:, length] = 0
        spell, flat = self.spelled(points), scores[:, 0]
        for start in range(length - 1, -1, -1):
            terms = [beta[:, start + k] + flat[edges[k - 1][:, start]] for k in range(1, min(length - start, LONGEST) + 1)]
            terms.append(beta[:, start + 1] + spell[:, start])
            stack = np.stack(terms)
            top = stack.max(axis=0)
            beta[:, start] = top + np.log(np.exp(stack - top).sum(axis=0))
        words, names, uses = [], [], []
        for k, found in enumerate(edges, 1):
            row, start = np.nonzero(found >= 0)
            piece = found[row, start]
            p = np.exp(alpha[row, start] + flat[piece] + beta[row, start + k] - alpha[row, length])
            words.append(row)
            names.append(piece)
            uses.append(p)
        return np.concatenate(words), np.concatenate(names), np.concatenate(uses)

    def expect_long(self, points: np.ndarray, flat: np.ndarray, step: int = 4096) -> np.ndarray:
        """Expected uses of every piece in one very long word, in steps of ``step`` starts with carried sums.

        The edges of one step are held at a time; over all places only the forward sums.
        """
        length, spell = len(points), self.spelled(points)
        alpha, uses = np.zeros(length + 1), np.zeros(len(self.pieces))

        def step_edges(begin: int):
            """(start, length, piece) of the edges that start in a step, by start."""
            size = min(step, length - begin)
            found = self.edges(points[None, begin : begin + size + LONGEST - 1])
            at = [np.flatnonzero(f[0, :size] >= 0) for f in found]
            starts = np.concatenate(at)
            sizes = np.repeat(np.arange(1, len(found) + 1), [len(x) for x in at])
            names = np.concatenate([f[0, x] for f, x in zip(found, at)])
            order = np.argsort(starts, kind="stable")
            return size, starts[order], sizes[order], names[order]

        def log_sum(terms: list[float]) -> float:
            top = max(terms)
            return top + math.log(sum([math.exp(t - top) for t in terms]))

        # terms of the places from the current one on, as a ring
        ring: list[list[float]] = [[] for _ in range(LONGEST + 1)]
        ring[0].append(0.0)
        for begin in range(0, length, step):
            size, starts, sizes, names = step_edges(begin)
            bounds, ks, logs = np.searchsorted(starts, np.arange(size + 1)).tolist(), sizes.tolist(), flat[names].tolist()
            spelled = spell[begin : begin + size].tolist()
            for i in range(size):
                place = begin + i
                here = ring[place % (LONGEST + 1)]
                a = alpha[place] = log_sum(here)
                here.clear()
                ring[(place + 1) % (LONGEST + 1)].append(a + spelled[i])
                for e in range(bounds[i], bounds[i + 1]):
                    ring[(place + ks[e]) % (LONGEST + 1)].append(a + logs[e])
        total = log_sum(ring[length % (LONGEST + 1)])
        after = [0.0]  # backward sums of the places behind the current step
        for begin in range((length - 1) // step * step, -1, -step):
            size, starts, sizes, names = step_edges(begin)
            bounds, ks, logs = np.searchsorted(starts, np.arange(size + 1)).tolist(), sizes.tolist(), flat[names].tolist()
            spelled = spell[begin : begin + size].tolist()
            beta = [0.0] * size + after
            for i in range(size - 1, -1, -1):
                beta[i] = log_sum([beta[i + 1] + spelled[i], *[beta[i + ks[e]] + logs[e] for e in range(bounds[i], bounds[i + 1])]])
            p = np.exp(alpha[begin + starts] + flat[names] + np.array(beta)[starts + sizes] - total)
            uses += np.bincount(names, weights=p, minlength=len(self.pieces))
            after = beta[:LONGEST]
        return uses

    def groups(self, words: list[str], most: int = 2048):
        """(indexes, code points as rows) of words of equal length, in blocks of bounded size."""
        points = [_points(START + w) for w in words]
        sizes = np.array([len(p) for p in points])
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            step = max(1, min(most, 2_000_000 // int(size)))
            for i in range(0, len(at), step):
                part = at[i : i + step]
                yield part, np.stack([points[j] for j in part])

    def log_sums(self, words: list[str], scores: np.ndarray) -> np.ndarray:
        out = np.zeros((len(words), scores.shape[1]))
        for at, points in self.groups(words):
            if points.shape[1] > 4096:  # one very long run: in steps, so that no table over all places is held
                out[at] = self._long(points, scores)
            else:
                out[at] = self.forward(points, self.edges(points), scores)[:, -1]
        return out

    def marginals(self, words: list[str], scores: np.ndarray, pieces: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Log probability of each word in each class over all segmentations.

        ``pieces`` is the log weight of the file's pieces in a class, ``own``
        the log weight of the edge that is the whole word, from start to end.
        """
        return np.logaddexp(pieces + self.log_sums(words, scores), own)

    def _long(self, points: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """Forward sums for very long words, keeping the last LONGEST places only."""
        out = np.zeros((len(points), scores.shape[1]))
        for w, row in enumerate(points):
            tail, step = [np.zeros(scores.shape[1])], 4096
            for begin in range(0, len(row), step):
                low = max(0, begin - LONGEST + 1)
                part = row[None, low : begin + step]
                edges, spell = self.edges(part), self.spelled(part)[0]
                for end in range(begin + 1, min(begin + step, len(row)) + 1):
                    terms = [tail[-1] + spell[end - 1 - low]]
                    for k in range(1, min(LONGEST, end, len(tail)) + 1):
                        if end - k >= low:
                            terms.append(tail[-k] + scores[edges[k - 1][0, end - k - low]])
                    stack = np.stack(terms)
                    top = stack.max(axis=0)
                    tail = [*tail[-LONGEST + 1 :], top + np.log(np.exp(stack - top).sum(axis=0))]
            out[w] = tail[-1]
        return out


def _with_never(scores: np.ndarray) -> np.ndarray:
    return np.vstack([scores, np.full((1, scores.shape[1]), NEVER)])


def _words(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def _class_counts(rows: DataFrame, classes: int) -> DataFrame:
    """word, c0..: training occurrences of every word of the corpus in each class (0 for held-out documents)."""
    names = [f"c{k}" for k in range(classes)]

    def count(batches):
        tables = [Counter() for _ in range(classes)]
        unseen: set[bytes] = set()
        size = 0

        def flush():
            words = list(unseen.union(*tables))
            columns = {"word": pa.array(words, pa.binary()).cast(pa.string())}
            columns |= {n: pa.array([t.get(w, 0) for w in words], pa.int64()) for n, t in zip(names, tables)}
            for t in tables:
                t.clear()
            unseen.clear()
            return pa.RecordBatch.from_pydict(columns)

        for batch in batches:
            for text, k, held in zip(_texts(batch), batch.column("class").to_pylist(), batch.column("held_out").to_pylist()):
                words = _words(text)
                if held:
                    unseen.update(words)
                else:
                    tables[k].update(words)
            size = len(unseen) + sum(map(len, tables))
            if size > 600_000:
                yield flush()
                size = 0
        if size:
            yield flush()

    schema = "word string, " + ", ".join(f"{n} long" for n in names)
    return rows.select("class", "held_out", "text").mapInArrow(count, schema).groupBy("word").agg(*[F.sum(n).alias(n) for n in names])


def _piece_scores(table: DataFrame, vocabulary: str, classes: int) -> np.ndarray:
    """(pieces, classes) log probabilities after one expectation step over all training words, each word once."""
    names = [f"c{k}" for k in range(classes)]

    def expect(batches):
        pieces, prior = read_pieces(vocabulary)
        lattice, scores = Lattice(pieces), _with_never(prior[:, None])
        total = np.zeros((len(pieces), classes))
        for batch in batches:
            words = batch.column("word").to_pylist()
            inside = np.stack([batch.column(n).to_numpy(zero_copy_only=False) > 0 for n in names], axis=1).astype(float)
            for at, points in lattice.groups(words):
                if points.shape[1] > 512:  # a whole sentence or more, in scripts without spaces: in steps, so that no table over all places is held
                    for j, word in zip(at, points):
                        total += np.outer(lattice.expect_long(word, scores[:, 0]), inside[j])
                    continue
                row, piece, uses = lattice.expect(points, scores)
                for k in range(classes):
                    total[:, k] += np.bincount(piece, weights=uses * inside[at[row], k], minlength=len(pieces))
        piece, k = np.nonzero(total)
        yield pa.RecordBatch.from_pydict({"piece": piece.astype(np.int32), "class": k.astype(np.int32), "uses": total[piece, k]})

    found = table.mapInArrow(expect, "piece int, class int, uses double").groupBy("piece", "class").agg(F.sum("uses").alias("uses")).toArrow()
    pieces, _ = read_pieces(vocabulary)
    total = np.full((len(pieces), classes), 0.01)
    np.add.at(total, (found.column("piece").to_numpy(), found.column("class").to_numpy()), found.column("uses").to_numpy())
    return np.log(total / total.sum(axis=0)) + math.log(1 - UNKNOWN)


def _most_frequent(weighed: DataFrame) -> DataFrame:
    """The words above the lowest count class that leaves at most HOT of them; nothing is sorted for it."""
    level = F.floor(F.log2(F.col("c") + 1) * 16)
    sizes = {r["level"]: r["count"] for r in weighed.groupBy(level.alias("level")).count().collect()}
    cut, total = None, 0
    for x in sorted(sizes, reverse=True):
        total += sizes[x]
        if total > HOT:
            break
        cut = x
    return weighed.where(level >= cut) if cut is not None else weighed.where("false")


def likelihoods(docs: DataFrame, vocabulary: str | None = None, most_classes: int = CLASSES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs`` (doc_id, text, lang).

    The ``most_classes`` most frequent values of lang, null being one, have a
    class each (ties by name), and all others together are one class more; every
    word of every training document counts in its class.
    Null and empty texts are the end token alone. Without training documents
    every count is 0 and the lattice alone scores. Rows that repeat an id are
    scored each; null ids are kept (their fold is that of ''); extra columns
    are ignored and an empty table gives an empty result.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "lm")
    vocabulary = vocabulary or default_vocabulary()
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"),
        (fold(F.col("doc_id"), HELD_OUT) == 0).alias("held_out"),
    )
    ends = {r["lang"]: r["count"] for r in rows.where("not held_out").groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_classes).collect()}
    total_ends = rows.where("not held_out").count()
    langs = list(ends)
    ends = [ends[x] for x in langs]
    if sum(ends) < total_ends or not langs:
        ends.append(total_ends - sum(ends))
    classes = len(ends)
    named = F.lit(classes - 1)
    for k, lang in enumerate(langs):
        named = F.when(F.col("lang").eqNullSafe(F.lit(lang)), k).otherwise(named)
    rows = rows.withColumn("class", named.cast("int"))

    table = scratch.keep(_class_counts(rows, classes))
    names = [f"c{k}" for k in range(classes)]
    known = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    facts = table.agg(
        F.sum(known).alias("n"), F.sum((known > 0).cast("long")).alias("v"),
        *[F.sum(n).alias(f"n_{n}") for n in names], *[F.sum((F.col(n) > 0).cast("long")).alias(f"v_{n}") for n in names],
        *[F.sum((F.col(n) == i).cast("long")).alias(f"o{i}_{n}") for n in names for i in (1, 2)],
    ).first().asDict()
    facts = {k: v or 0 for k, v in facts.items()}
    n_all, v_all = facts["n"] + total_ends, facts["v"] + (total_ends > 0)
    base_total = 0.1 * (v_all + 1) + n_all
    n = np.array([facts[f"n_{c}"] for c in names]) + np.array(ends)
    v = np.array([facts[f"v_{c}"] for c in names])
    o1, o2 = (np.array([facts[f"o{i}_{c}"] for c in names], float) for i in (1, 2))
    d = np.where(v > 0, np.clip(o1 / np.maximum(o1 + 2 * o2, 1), 0.1, 0.95), 0.0)
    empty = v == 0  # a class without words: half its mass is the pieces, half the end
    of_pieces = np.where(empty, np.log(0.5), np.log(np.maximum(d * v, 1e-300)) - np.log(np.maximum(n, 1)))
    scores = _piece_scores(table.where(known > 0), vocabulary, classes)
    shared = spark.sparkContext.broadcast(scores)

    def weigh(batches):
        pieces, _ = read_pieces(vocabulary)
        lattice, scores = Lattice(pieces), _with_never(shared.value)
        for batch in batches:
            c = np.stack([batch.column(x).to_numpy(zero_copy_only=False) for x in names], axis=1)
            with np.errstate(divide="ignore"):
                own = np.log(np.maximum(c - d, 0)) - np.log(np.maximum(n, 1))
            logs = lattice.marginals(batch.column("word").to_pylist(), scores, of_pieces, own) / math.log(10)
            total = c.sum(axis=1)
            out = {"word": batch.column("word"), "c": pa.array(total), "base": pa.array(np.log10((total + 0.1) / base_total))}
            yield pa.RecordBatch.from_pydict(out | {f"s{k}": pa.array(np.ascontiguousarray(logs[:, k])) for k in range(classes)})

    sums = [f"s{k}" for k in range(classes)]
    doubles = ", ".join(f"{s} double" for s in sums)
    weighed = scratch.keep(table.mapInArrow(weigh, f"word string, c long, base double, {doubles}"))
    hot = _most_frequent(weighed).toArrow()
    words = hot.column("word").cast(pa.binary()).to_pylist()
    values = np.stack([hot.column(x).to_numpy() for x in ("base", *sums)], axis=1) if words else np.zeros((0, classes + 1))
    seen = hot.column("c").to_numpy() > 0
    with np.errstate(divide="ignore"):
        end = np.where(empty, np.log10(0.5), np.log10(np.maximum(np.array(ends), 1e-9) / np.maximum(n, 1)))
    end_values = np.concatenate([[math.log10((total_ends + 0.1) / base_total)], end])
    small = spark.sparkContext.broadcast((words, values, seen))

    def first(batches):
        words, values, seen = small.value
        place = {w: i for i, w in enumerate(words)}
        for batch in batches:
            sums_, known_, tokens, owner, rest, times = [], [], [], [], [], []
            for key, text in zip(batch.column("key").to_pylist(), _texts(batch)):
                counts = Counter(_words(text))
                at, tf = [], []
                for word, f in counts.items():
                    i = place.get(word)
                    if i is None:
                        owner.append(key)
                        rest.append(word)
                        times.append(f)
                    else:
                        at.append(i)
                        tf.append(f)
                f = np.array(tf, float)
                sums_.append(f @ values[at] + end_values if at else end_values)
                known_.append(int(f @ seen[at] if at else 0) + (total_ends > 0))
                tokens.append(sum(counts.values()) + 1)
            s = np.array(sums_).reshape(-1, classes + 1)
            none = len(owner)
            row = {"key": batch.column("key"), "doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "n_tokens": pa.array(tokens, pa.int64()), "n_known": pa.array(known_, pa.int64())}
            row |= {x: pa.array(np.ascontiguousarray(s[:, i])) for i, x in enumerate(("base", *sums))}
            yield pa.RecordBatch.from_pydict(row | {"word": pa.nulls(len(tokens), pa.string()), "tf": pa.nulls(len(tokens), pa.int32())})
            if none:
                row = {"key": pa.array(owner, pa.int64()), "doc_id": pa.nulls(none, pa.int64()), "held_out": pa.nulls(none, pa.bool_()), "n_tokens": pa.nulls(none, pa.int64()), "n_known": pa.nulls(none, pa.int64())}
                row |= {x: pa.nulls(none, pa.float64()) for x in ("base", *sums)}
                yield pa.RecordBatch.from_pydict(row | {"word": pa.array(rest, pa.binary()).cast(pa.string()), "tf": pa.array(times, pa.int32())})

    keyed = rows.select(F.monotonically_increasing_id().alias("key"), "doc_id", "held_out", "text")
    schema = f"key long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, {doubles}, word string, tf int"
    parts = scratch.keep(keyed.mapInArrow(first, schema))
    tail = parts.where("word is not null").select("key", "word", "tf")
    weights = weighed.select("word", (F.col("c") > 0).alias("known"), "base", *sums)
    more = tail.join(weights, "word").groupBy("key").agg(
        F.sum(F.when(F.col("known"), F.col("tf")).otherwise(0)).alias("m_known"), *[F.sum(F.col("tf") * F.col(x)).alias(f"m_{x}") for x in ("base", *sums)]
    )
    out = parts.where("word is null").drop("word", "tf").join(more, "key", "left")

    def both(name: str) -> Column:
        return F.col(name) + F.coalesce(F.col(f"m_{name}"), F.lit(0.0))

    shares = [(e / total_ends) if total_ends else 1.0 for e in ends]
    logs = F.array(*[both(s) + math.log10(max(share, 1e-300)) for s, share in zip(sums, shares)])
    out = out.withColumn("__logs", logs).withColumn("__top", F.array_max("__logs"))
    total = F.aggregate("__logs", F.lit(0.0), lambda acc, x: acc + F.pow(F.lit(10.0), x - F.col("__top")))
    return scratch.finish(out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("m_known", F.lit(0))).alias("n_known"),
        F.lit(int(n_all)).cast("long").alias("train_tokens"), both("base").alias("base_score"), (F.col("__top") + F.log10(total)).alias("score"),
    ))
