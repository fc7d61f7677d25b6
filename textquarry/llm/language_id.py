"""Operator 8: language identification by sparse multinomial logistic regression.

A text is the TF-IDF vector of its letter n-grams (one to three code points,
other signs count as one space), hashed to ``BUCKETS`` places and scaled to
length one. Document frequencies are counted over all training documents; the
weights are fitted by follow-the-regularised-leader with elastic-net penalties
on a hash sample of about ``SAMPLE`` of them, in which every language has about
``QUOTA`` rows at least, or all where it has fewer; a fifth of the sample is kept
back to fit the temperature that calibrates the scores.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import fold, slices

BUCKETS = 1 << 15
SAMPLE = 5_000
#: Training rows of a language that the sample holds at least (about), however rare the language is.
QUOTA = 200
HELD_OUT = (4, 2)
EPOCHS = 3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.02, 0.1
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def ngrams(text: str | None) -> np.ndarray:
    """Buckets of all n-grams of a text, with repeats; none if it has no letter."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return np.zeros(0, np.int64)
    points = np.where(letter, points, 32).astype(np.uint64)
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]
    points = np.concatenate([[32], points[keep], [32]]).astype(np.uint64)
    out = []
    with np.errstate(over="ignore"):
        rolled = np.zeros(len(points), np.uint64)
        for n in range(1, 4):
            rolled = rolled[: len(points) - n + 1] * np.uint64(0x100000001B3) + points[n - 1 :]
            out.append(((rolled + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 15))
    return np.concatenate(out).astype(np.int64)


def _frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """(documents that hold each bucket, documents), over all of ``docs``."""

    def count(batches):
        df, n = np.zeros(BUCKETS + 1, np.int64), 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                df[np.flatnonzero(np.bincount(ngrams(text), minlength=BUCKETS))] += 1
                n += 1
        df[BUCKETS] = n
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"bucket": used.astype(np.int32), "df": df[used]})

    table = docs.select("text").mapInArrow(count, "bucket int, df long").groupBy("bucket").agg(F.sum("df").alias("df")).toArrow()
    out = np.zeros(BUCKETS + 1, np.int64)
    out[table.column("bucket").to_numpy()] = table.column("df").to_numpy()
    return out[:BUCKETS], int(out[BUCKETS])


def inverse_frequency(df: np.ndarray, n: int) -> np.ndarray:
    return np.where(df > 0, np.log((1 + n) / (1 + df)) + 1, 0.0)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Ftrl:
    """Multinomial logistic regression with per-coordinate FTRL-proximal steps."""

    def __init__(self, classes: int):
        self.z = np.zeros((BUCKETS + 1, classes))
        self.n = np.zeros((BUCKETS + 1, classes))

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = _softmax(x @ w)
        p[label] -= 1
        g = x[:, None] * p
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], classes: int, seed: int = 0) -> tuple[np.ndarray, float]:
    """(weights with the bias in the last row, temperature)."""
    model, random = Ftrl(classes), np.random.default_rng(seed)
    rows = [(np.append(at, BUCKETS), np.append(x, 1.0)) for at, x in rows]
    back = np.arange(len(rows)) % 5 == 4
    use = np.flatnonzero(~back)
    for _ in range(EPOCHS):
        for i in random.permutation(use):
            model.learn(rows[i][0], rows[i][1], labels[i])
    weights = model.weights()
    if not back.any():
        return weights, 1.0
    z = np.stack([rows[i][1] @ weights[rows[i][0]] for i in np.flatnonzero(back)])
    y = np.array([labels[i] for i in np.flatnonzero(back)])

    def loss(log_t: float) -> float:
        p = _softmax(z / np.exp(log_t))
        return -np.log(p[np.arange(len(y)), y] + 1e-12).mean()

    low, high, golden = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - golden * (high - low), low + golden * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return weights, float(np.exp((low + high) / 2))


def _vector(grams: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.bincount(grams, minlength=BUCKETS) * idf
    length = np.sqrt(v @ v)
    return v / length if length > 0 else v


def train(docs: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray, float]:
    """(languages, idf, weights, temperature) from the training folds of ``docs`` (doc_id, text, lang)."""
    known = docs.where("lang is not null and text is not null").where(fold(F.col("doc_id"), HELD_OUT[0]) != HELD_OUT[1])
    idf = inverse_frequency(*_frequencies(known))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    languages = sorted(counts)
    share = SAMPLE / max(sum(counts.values()), 1)
    rare = {lang: QUOTA / n for lang, n in counts.items() if QUOTA / n > share}
    shares = F.lit(share)
    if rare:
        shares = F.coalesce(F.create_map(*[F.lit(x) for item in rare.items() for x in item])[F.col("lang")], shares)
    place = F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(1 << 30)) / float(1 << 30)

    def vectors(batches):
        for batch in batches:
            at, count = [], []
            for text in batch.column("text").to_pylist():
                a, c = np.unique(ngrams(text), return_counts=True)
                at.append(a.astype(np.uint16).tobytes())
                count.append(c.astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_pydict({"lang": batch.column("lang"), "at": pa.array(at, pa.binary()), "count": pa.array(count, pa.binary())})

    table = known.where(place < shares).select("lang", "text").mapInArrow(vectors, "lang string, at binary, count binary").toArrow()
    rows, labels = [], []
    for lang, at, count in zip(*(table.column(c).to_pylist() for c in ("lang", "at", "count"))):
        a = np.frombuffer(at, np.uint16).astype(np.int64)
        x = np.frombuffer(count, np.uint32) * idf[a]
        if len(a):
            rows.append((a, x / max(np.sqrt(x @ x), 1e-12)))
            labels.append(languages.index(lang))
    weights, temperature = fit(rows, labels, max(len(languages), 1))
    return languages, idf, weights, temperature


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs`` (doc_id, text, lang).

    Null texts and texts without a letter are ``und`` with score 0, as is
    everything when no document names a language. Equal scores go to the
    language that sorts first. Rows are judged each by its own text, so repeated
    rows and null ids are kept; extra columns are ignored and an empty table
    gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    languages, idf, weights, temperature = train(rows)
    shared = docs.sparkSession.sparkContext.broadcast((languages, idf, weights, temperature))

    def predict(batches):
        languages, idf, weights, temperature = shared.value
        for batch in slices(batches):
            names, scores = [], []
            for text in batch.column("text").to_pylist():
                grams = ngrams(text)
                if not len(grams) or not languages:
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                p = _softmax((_vector(grams, idf) @ weights[:BUCKETS] + weights[BUCKETS]) / temperature)
                best = int(p.argmax())
                names.append(languages[best])
                scores.append(float(p[best]))
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "lang_pred": pa.array(names, pa.string()), "score": pa.array(scores, pa.float64()),
            })

    held = (fold(F.col("doc_id"), HELD_OUT[0]) == HELD_OUT[1]).alias("held_out")
    return rows.select("doc_id", held, "text").mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double")
