"""Operator 4: quality rules with cutoffs certified on labelled holdouts.

Every text gets four rule scores (higher is worse). A rule may reject a text
only above a cutoff, one for each stratum, and a cutoff is used only if the
labelled good texts of the stratum prove that it rejects few of them: the exact
binomial test of "the share of good texts above the cutoff is RISK or more" has
to fall below DELTA divided by the number of tests (all rules, strata and
cutoffs of the grid). So with probability 1 - DELTA every rule rejects under
RISK of the good texts in every stratum at once. Among the certified cutoffs
the rule takes the one that catches the most labelled bad texts net of ten
times the good ones, then the largest.

Everything is DataFrame and SQL functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .text import WORD_SPACE

MIN_WORDS = 50
RISK = 0.01
DELTA = 0.05
#: Rule scores are whole numbers per thousand (word length: tenths of a code point).
RULES = {
    "symbols": "1000 * n_symbols div greatest(word_chars, 1)",
    "dup_lines": "1000 * n_dup_lines div greatest(n_lines, 1)",
    "repeats": "1000 * n_repeat_words div greatest(n_words, 1)",
    "word_length": "10 * word_chars div greatest(n_words, 1)",
}
GRID = (10, 20, 30, 50, 75, 100, 150, 200, 250, 300, 400, 500, 600, 700, 800, 900)
#: Labelled ids up to this many are broadcast (8 bytes each); beyond, Spark joins by shuffling.
ID_LIMIT = 2_000_000
#: A good text rejected weighs as much as so many bad texts caught.
GOOD_WEIGHT = 10

_SPACES = " \t\n\x0b\x0c\r"


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once for a row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def word_array(text: Column) -> Column:
    """Words of a text; none for null, empty and blank ones."""
    trimmed = F.btrim(text, F.lit(_SPACES))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, WORD_SPACE)).otherwise(F.array().cast("array<string>"))


def _repeat_words(words: Column) -> Column:
    """Words inside the three-word windows that occur twice or more in the text."""

    def covered(grams: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            twice = lambda x, i: (
                ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | ((i < F.size(s) - 1) & (F.get(s, i + 1)["h"] == x["h"]))
            )
            starts = F.transform(F.filter(s, twice), lambda x: x["i"])
            places = F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2)))
            return F.size(F.array_distinct(places))

        pairs = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(_let(pairs, of_sorted))

    def grams(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(_let(words, lambda w: _let(grams(w), covered)))


def _measures(text: Column) -> Column:
    """Struct of all measures of a text."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    symbols = F.coalesce(F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")), F.lit(0))

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            symbols.cast("long").alias("n_symbols"),
            _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("l"),
            _repeat_words(w).cast("long").alias("n_repeat_words"),
        )

    return _let(word_array(text), of_words)


def measures(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` with the column ``__q``: all measures of the text, base_failed and the rule scores."""
    m = rows.withColumn("__q", _measures(F.col(text).cast("string")))
    flat = {c: F.col(f"__q.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_repeat_words")}
    flat |= {c: F.col(f"__q.l.{c}") for c in ("n_lines", "n_dup_lines")}
    failed = (flat["n_words"] < MIN_WORDS) | (100 * flat["n_repeat_words"] > 50 * flat["n_words"])
    base = F.struct(*[c.alias(n) for n, c in flat.items()], failed.alias("base_failed"))
    m = m.withColumn("__q", base)
    scores = {}
    for rule, sql in RULES.items():
        for c in flat:
            sql = sql.replace(c, f"__q.{c}")
        scores[rule] = F.expr(sql).cast("long")
    return m.withColumn("__r", F.struct(*[c.alias(n) for n, c in scores.items()]))


def _stirling_rest(n: Column) -> Column:
    """log n! less Stirling's formula, for whole n from 1: a table below 16, then the series (error under 1e-14)."""
    small = [0.0] + [math.lgamma(i + 1) - (i + 0.5) * math.log(i) + i - 0.5 * math.log(2 * math.pi) for i in range(1, 16)]
    inverse = 1 / (n * n)
    series = (1 / 12 - (1 / 360 - (1 / 1260 - inverse / 1680) * inverse) * inverse) / n
    return F.when(n < 16, F.get(F.array(*[F.lit(x) for x in small]), n.cast("int"))).otherwise(series)


def _deviance(x: Column, mean: Column) -> Column:
    """x log(x / mean) + mean - x without cancellation near the mean."""
    d = (x - mean) / mean
    return mean * ((1 + d) * F.log1p(d) - d)


def _log_term(k: Column, n: Column, p: float) -> Column:
    """log P(X = k) for X ~ Binomial(n, p) and 0 < k < n, by its saddle point."""
    rest = n - k
    logs = _stirling_rest(n) - _stirling_rest(k) - _stirling_rest(rest) - _deviance(k, n * F.lit(p)) - _deviance(rest, n * F.lit(1 - p))
    return logs + 0.5 * F.log(n / (k * rest * F.lit(2 * math.pi)))


def _tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p) and k <= n p, at any n.

    The term of k comes from its logarithm; the terms below it follow as shares
    of it. For k <= n p the share of term k - i is under exp(-i (i - 1) / 2 k),
    so the terms more than 12 sqrt(k) + 2 below k add nothing to a double.
    """
    k, n = k.cast("double"), n.cast("double")
    below = F.sequence(F.lit(1).cast("long"), F.least(k, F.ceil(12 * F.sqrt(k)) + 2).cast("long"))
    start = F.struct(F.lit(1.0).alias("share"), F.lit(1.0).alias("sum"))

    def step(acc: Column, i: Column) -> Column:
        share = acc["share"] * (k - i + 1) / (n - k + i) * F.lit((1 - p) / p)
        return F.struct(share.alias("share"), (acc["sum"] + share).alias("sum"))

    shares = F.aggregate(below, start, step, lambda acc: acc["sum"])
    return F.when(k < 1, F.exp(n * F.lit(math.log1p(-p)))).otherwise(F.exp(_log_term(k, n, p) + F.log(shares)))


def cutoffs(scored: DataFrame, labels: DataFrame, stratum: str, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """stratum, rule, cutoff: the certified cutoffs; rules without one in a stratum have no row.

    ``scored`` has doc_id, the stratum column, ``__q`` and ``__r``; ``labels`` has
    doc_id and quality (1 good, 0 bad; null labels and ids are left out). A
    document that has several labels counts once for each.
    """
    held = scored.where(~F.col("__q.base_failed")).join(labels.where("quality is not null").select("doc_id", "quality"), "doc_id")
    scores = F.array(*[F.struct(F.lit(rule).alias("rule"), F.col(f"__r.{rule}").alias("score")) for rule in RULES])
    long = held.select(F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), "quality", F.explode(scores).alias("s"))
    long = long.select("stratum", F.col("s.rule").alias("rule"), "quality", F.col("s.score").alias("score"))
    # each score is counted once, at the number of grid cutoffs below it, then summed from the top
    below = F.size(F.filter(F.array(*[F.lit(g) for g in GRID]), lambda g: g < F.col("score")))
    counts = long.groupBy("stratum", "rule", below.alias("below")).agg(
        F.sum((F.col("quality") == 1).cast("long")).alias("good"), F.sum((F.col("quality") != 1).cast("long")).alias("bad")
    )
    grid = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("at"), F.lit(g).cast("long").alias("cutoff")) for i, g in enumerate(GRID)]))
    tests = counts.select("stratum", "rule", "below", "good", "bad", grid.alias("g"))
    tests = tests.select("stratum", "rule", "below", "good", "bad", F.col("g.at").alias("at"), F.col("g.cutoff").alias("cutoff"))
    tests = tests.groupBy("stratum", "rule", "at", "cutoff").agg(
        F.sum("good").alias("n"),
        F.sum(F.when(F.col("below") >= F.col("at"), F.col("good")).otherwise(0)).alias("k"),
        F.sum(F.when(F.col("below") >= F.col("at"), F.col("bad")).otherwise(0)).alias("caught"),
    )
    strata = max(tests.select("stratum").distinct().count(), 1)
    # a share over the risk already in the sample can't be certified, and its tail needn't be summed
    hopeful = F.col("k") <= F.col("n") * risk
    p = F.when(hopeful, _tail(F.col("k"), F.col("n"), risk)).otherwise(1.0)
    certified = tests.where(p <= F.lit(delta / (strata * len(RULES) * len(GRID)))).where("caught > 0")
    best = F.max_by("cutoff", F.struct(F.col("caught") - GOOD_WEIGHT * F.col("k"), "cutoff"))
    gain = F.max(F.col("caught") - GOOD_WEIGHT * F.col("k"))
    return certified.groupBy("stratum", "rule").agg(best.alias("cutoff"), gain.alias("gain")).where("gain > 0").select("stratum", "rule", "cutoff")


def _verdict(scored: DataFrame, cut: DataFrame, stratum: str) -> DataFrame:
    """``scored`` with the boolean ``__kept``, by certified cutoffs."""
    cut = cut.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("__cut"))
    key = F.coalesce(F.col(stratum).cast("string"), F.lit(""))
    joined = scored.withColumn("__stratum", key).join(cut.withColumnRenamed("stratum", "__stratum"), "__stratum", "left")
    over = [F.coalesce(F.col(f"__r.{rule}") > F.col("__cut")[rule], F.lit(False)) for rule in RULES]
    rejected = over[0]
    for x in over[1:]:
        rejected = rejected | x
    # one expression over both sides, so that no part of it moves below the join, where it would compute the measures again
    return joined.withColumn("__kept", F.when(F.col("__q.base_failed"), False).otherwise(~rejected))


def judged(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """doc_id, the base measures, base_failed and kept for every row of ``docs`` (doc_id, text, stratum).

    Null and empty texts have no words and fail the base rules. A null stratum
    is a stratum of its own, ''. Without labels no cutoff is certified and only
    the base rules reject. Rows that repeat an id are judged each by its own
    text. Extra columns are ignored; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    scored = scratch.keep(measures(docs.select("doc_id", "text", stratum)).drop("text"))
    out = _verdict(scored, cutoffs(scored, labels, stratum, risk, delta), stratum)
    base = [F.col(f"__q.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")]
    return out.select("doc_id", *base, F.col("__kept").alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """The rows of ``docs`` that all rules keep, with all their columns."""
    scratch = Scratch(docs.sparkSession, "quality")
    ids = labels.where("quality is not null").select("doc_id").distinct()
    if ids.count() <= ID_LIMIT:
        ids = F.broadcast(ids)
    held = scratch.keep(measures(docs.select("doc_id", "text", stratum).join(ids, "doc_id", "left_semi")).drop("text"))
    cut = scratch.finish(cutoffs(held, labels, stratum, risk, delta))
    out = _verdict(measures(docs), cut, stratum).where("__kept")
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
