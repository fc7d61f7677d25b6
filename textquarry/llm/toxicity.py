"""Operator 3: toxicity by a counterfactually regularised linear classifier.

A text is the set of its letter words and their first four and five letters.
The features that differ most between the classes (chi-square) enter a logistic
regression with an l1 penalty and a counterfactual penalty: in labelled texts
that mention an identity term the term is swapped for others, and the squared
change of the score is added to the loss, so that the terms themselves carry no
weight. A few neutral sentences that only mention a group add their swaps to
this penalty, since a corpus may hold none; they have no label and no part in
the loss of the labels.

The classifier is fitted on a hash sample of about ``POSITIVES`` and
``NEGATIVES`` labelled documents of the training folds; every text is scored.
Features are counted and chosen where the rows are; the driver gets the places
of at most ``FEATURES`` chosen features of each sampled row.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .text import fold, slices

POSITIVES, NEGATIVES = 4_000, 10_000
FEATURES = 4_096
HELD_OUT = 5
SWAPS = 3
#: Rows that a chosen feature occurs in at least, and its least chi-square.
LEAST_ROWS, LEAST_CHI = 3, 12.0
L1, COUNTERFACTUAL, STEPS = 3e-4, 1.0, 400
#: Longer runs without white space are not remembered, so that a memory of many is small.
REMEMBERED = 64

# Identity terms, and neutral sentences that mention one.
IDENTITY = (
    "women", "men", "girls", "boys", "gay", "lesbian", "straight", "bisexual", "transgender", "muslim", "christian",
    "jewish", "hindu", "buddhist", "atheist", "black", "white", "asian", "african", "european", "american", "mexican",
    "arab", "immigrant", "refugee", "disabled", "deaf", "blind", "old", "young",
)
NEUTRAL = (
    "my {} neighbour helped me with the garden",
    "the {} community opened a new library today",
    "she wrote a book about the history of {} people",
    "we met a {} family on the train",
    "i am {} and i work as a teacher",
)
_LETTERS = regex.compile(r"\p{L}+")


def word_features(word: str) -> list[int]:
    """Hashes of a lower-case word, and of its beginnings."""
    out = [zlib.crc32(f"w{word}".encode())]
    if len(word) > 4:
        out.append(zlib.crc32(f"p{word[:4]}".encode()))
    if len(word) > 5:
        out.append(zlib.crc32(f"p{word[:5]}".encode()))
    return out


def text_words(text: str | None) -> set[str]:
    words: set[str] = set()
    for chunk in set((text or "").lower().split()):
        words.update(_LETTERS.findall(chunk))
    return words


def text_features(words: set[str]) -> np.ndarray:
    return np.unique(np.array([x for w in words for x in word_features(w)], dtype=np.uint32))


def swapped(words: set[str], salt: int = 0) -> list[set[str]]:
    """Up to SWAPS versions of the word set, each with all its identity terms turned to others."""
    found = [t for t in IDENTITY if t in words]
    out = []
    for k in range(SWAPS if found else 0):
        new = {IDENTITY[(IDENTITY.index(t) + 1 + (salt + k * 7) % (len(IDENTITY) - 1)) % len(IDENTITY)] for t in found}
        out.append((words - set(found)) | new)
    return out


def chi_square(df, positive, n, p):
    """Chi-square of a feature in ``df`` of n rows, ``positive`` of the p of class 1 (arrays or columns)."""
    expected = df * p / n
    variance = expected * (1 - p / n) * (1 - df / n)
    return (positive - expected) * (positive - expected) / (variance + 1e-9)


class _Rows:
    """Sparse binary rows, given as the places of their features."""

    def __init__(self, rows: list[np.ndarray], width: int):
        self.sizes = np.array([len(row) for row in rows], np.int64)
        self.index = np.concatenate(rows).astype(np.int64) if rows else np.zeros(0, np.int64)
        self.row = np.repeat(np.arange(len(rows)), self.sizes)
        self.shape = (len(rows), width)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.index], minlength=self.shape[0])

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.index, weights=g[self.row], minlength=self.shape[1])


class Problem:
    """The smooth part of the loss: class-balanced logistic loss and mean squared score change of the swaps.

    ``rows`` are places of features with labels ``y``; ``pairs`` are the places
    that a text has and its swapped version lacks, and the other way round.
    """

    def __init__(self, rows: list[np.ndarray], y: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]], width: int):
        self.x, self.y, self.pairs = _Rows(rows, width), y, len(pairs)
        self.left, self.right = _Rows([a for a, _ in pairs], width), _Rows([b for _, b in pairs], width)
        p = y.sum()
        self.weight = np.where(y > 0, 0.5 / max(p, 1), 0.5 / max(len(y) - p, 1))  # both classes count alike

    def loss(self, w: np.ndarray, b: float) -> float:
        z = self.x.dot(w) + b
        fit = (self.weight * (np.logaddexp(0, z) - self.y * z)).sum()
        change = self.left.dot(w) - self.right.dot(w)
        return float(fit + (COUNTERFACTUAL * (change @ change) / self.pairs if self.pairs else 0.0))

    def gradient(self, w: np.ndarray, b: float) -> tuple[np.ndarray, float]:
        error = self.weight * (1 / (1 + np.exp(-np.clip(self.x.dot(w) + b, -50, 50))) - self.y)
        out = self.x.back(error)
        if self.pairs:
            change = COUNTERFACTUAL * 2 * (self.left.dot(w) - self.right.dot(w)) / self.pairs
            out = out + self.left.back(change) - self.right.back(change)
        return out, float(error.sum())

    def curvature(self) -> np.ndarray:
        """A bound of the second derivatives' row sums, one for each feature."""
        out = 0.25 * self.x.back(self.weight * np.maximum(self.x.sizes, 1))
        if self.pairs:
            both = 2 * COUNTERFACTUAL / self.pairs * (self.left.sizes + self.right.sizes)
            out = out + self.left.back(both) + self.right.back(both)
        return out


def fit(rows: list[np.ndarray], y: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]], width: int) -> tuple[np.ndarray, float]:
    """(weights, bias) by accelerated proximal gradient steps, for rows and pairs as in ``Problem``.

    With one class only, or no rows, the weights are 0 and the bias gives the
    share of that class, smoothed.
    """
    n, p = len(rows), float(y.sum())
    if not width or not 0 < p < n:
        return np.zeros(width), float(np.log((p + 0.5) / (n - p + 0.5)))
    problem = Problem(rows, y, pairs, width)
    rate = 1.0 / (problem.curvature() + 1e-3)  # one step size for each feature, from its share of the curvature
    w, b, v, c, t = np.zeros(width), 0.0, np.zeros(width), 0.0, 1.0
    for _ in range(STEPS):
        gradient, gradient_b = problem.gradient(v, c)
        new = v - rate * gradient
        new = np.sign(new) * np.maximum(np.abs(new) - rate * L1, 0)
        new_b = c - gradient_b
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, c = new + (t - 1) / t_new * (new - w), new_b + (t - 1) / t_new * (new_b - b)
        w, b, t = new, new_b, t_new
    return w, float(b)


def _places(features: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Where the chosen (sorted) features stand that are among ``features``."""
    at = np.searchsorted(chosen, features)
    return at[chosen[np.minimum(at, len(chosen) - 1)] == features] if len(chosen) else at[:0]


def swap_change(words: set[str], other: set[str], chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places that the words have and the swapped words lack, and the other way round."""
    a, b = _places(text_features(words), chosen), _places(text_features(other), chosen)
    return np.setdiff1d(a, b), np.setdiff1d(b, a)


def _sampled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """toxic, text: a hash sample of the labelled documents of the training folds.

    An id that several rows share is learned once for each of its labels, from
    its smallest text.
    """
    known = labels.where("toxic is not null and doc_id is not null").select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic"))
    known = known.where(fold(F.col("doc_id"), HELD_OUT) != 0).distinct()
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    shares = {1: POSITIVES / max(counts.get(1, 0), 1), 0: NEGATIVES / max(counts.get(0, 0), 1)}
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = known.where(place < F.when(F.col("toxic") == 1, shares[1]).otherwise(shares[0]))
    # at most about POSITIVES + NEGATIVES rows are broadcast
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")
    return rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("toxic", "text")


def choose(rows: DataFrame, limit: int = FEATURES) -> np.ndarray:
    """The features (sorted hashes) of ``rows`` (toxic, text) with the largest chi-square between the classes."""

    def features(batches):
        for batch in slices(batches):
            for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist()):
                found = text_features(text_words(text)).astype(np.int64)
                yield pa.RecordBatch.from_pydict({"feature": found, "toxic": np.full(len(found), toxic, np.int32)})

    n, p = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < p < n:
        return np.zeros(0, np.uint32)
    counts = rows.mapInArrow(features, "feature long, toxic int").groupBy("feature").agg(F.count("*").alias("df"), F.sum("toxic").alias("positive"))
    chi = counts.where(F.col("df") >= LEAST_ROWS).withColumn("chi", chi_square(F.col("df"), F.col("positive"), float(n), float(p)))
    best = chi.where(F.col("chi") > LEAST_CHI).orderBy(F.desc("chi"), "feature").limit(limit).select("feature").toArrow()
    return np.sort(best.column("feature").to_numpy().astype(np.uint32))


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """(features, weights, bias) fitted on a hash sample of the labelled rows of the training folds."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    rows = scratch.keep(_sampled(docs, labels))
    chosen = choose(rows)

    def placed(batches):
        for batch in slices(batches):
            mine, less, more = [], [], []
            for text in batch.column("text").to_pylist():
                words = text_words(text)
                changes = [swap_change(words, x, chosen) for x in swapped(words, len(words))]
                mine.append(_places(text_features(words), chosen).astype(np.uint16).tobytes())
                less.append([a.astype(np.uint16).tobytes() for a, _ in changes])
                more.append([b.astype(np.uint16).tobytes() for _, b in changes])
            lists = pa.list_(pa.binary())
            yield pa.RecordBatch.from_pydict({"toxic": batch.column("toxic"), "mine": pa.array(mine, pa.binary()), "less": pa.array(less, lists), "more": pa.array(more, lists)})

    # two bytes for each chosen feature of a sampled row
    table = rows.mapInArrow(placed, "toxic int, mine binary, less array<binary>, more array<binary>").toArrow()
    scratch.drop(1)
    read = lambda blob: np.frombuffer(blob, np.uint16)
    x, y = [read(b) for b in table.column("mine").to_pylist()], np.array(table.column("toxic").to_pylist(), float)
    pairs = [(read(a), read(b)) for less, more in zip(table.column("less").to_pylist(), table.column("more").to_pylist()) for a, b in zip(less, more)]
    for i, sentence in enumerate(NEUTRAL):
        for term in IDENTITY:
            words = text_words(sentence.format(term))
            pairs += [swap_change(words, s, chosen) for s in swapped(words, i)]
    weights, bias = fit(x, y, pairs, len(chosen))
    return chosen[weights != 0], weights[weights != 0], bias


def scored(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """``docs`` with ``__score``, from 0 to 1; null and empty texts get the score of a text without features."""
    chosen, weights, bias = model
    known = dict(zip(chosen.tolist(), weights.tolist()))
    shared = docs.sparkSession.sparkContext.broadcast((known, bias))

    def run(batches):
        known, bias = shared.value
        memory: dict[str, tuple] = {}
        for batch in slices(batches):
            out = []
            for text in batch.column("__text").to_pylist():
                hits = set()
                for chunk in set((text or "").lower().split()):
                    found = memory.get(chunk)
                    if found is None:
                        found = tuple(x for w in _LETTERS.findall(chunk) for x in word_features(w) if x in known)
                        if len(chunk) <= REMEMBERED:
                            if len(memory) >= 300_000:
                                memory.clear()
                            memory[chunk] = found
                    if found:
                        hits.update(found)
                z = bias + sum(known[x] for x in sorted(hits))
                out.append(1 / (1 + np.exp(-np.clip(z, -50, 50))))
            columns = [batch.column(i) for i in range(batch.num_columns - 1)] + [pa.array(out, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "__score"])

    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(*columns, F.col("text").cast("string").alias("__text"))
    wide = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return rows.mapInArrow(run, f"{wide}, __score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text).

    Rows are scored each by its own text, so repeated rows and null ids are
    kept. Documents without labels, or no labels at all, give scores from the
    bias alone. Extra columns are ignored; an empty table gives an empty result.
    """
    out = scored(docs.select("doc_id", "text"), train(docs, labels))
    return out.select(
        "doc_id", (fold(F.col("doc_id"), HELD_OUT) == 0).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted")
    )


def keep_civil(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` scored under 0.5, with all their columns.

    Null and empty texts have the score of a text without features; repeated
    rows share their text's fate and a score of 0.5 rejects. Without labels
    nothing tells the classes apart and the bias alone decides. An empty table
    gives an empty result.
    """
    return scored(docs, train(docs, labels)).where("__score < 0.5").drop("__score")
