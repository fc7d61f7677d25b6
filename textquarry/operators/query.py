"""Conjunctive proximity queries over postings.

The slots of a query are its analysed terms in order; the pivot is the first
slot whose term has the fewest documents. A document matches when some position
p of the pivot term has, for every other slot i, a position x of that slot's
term with 0 < |x - p| <= |i - pivot|. With one slot, having the term is enough.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.analysis import DEFAULT, Analyzer
from ..sources.scratch import Scratch
from ..sources.store import few
from .index import lookup


def intersect(left: DataFrame, right: DataFrame) -> DataFrame:
    """doc_ids of both postings."""
    return left.select("doc_id").join(right.select("doc_id"), "doc_id", "left_semi").distinct()


def positional_intersect(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """doc_id, position1, position2: the pairs with 0 < |position1 - position2| <= k in common documents.

    The position arrays of a document meet once for each distance, by hashing,
    so a document costs k times its positions, not their product.
    """
    a = left.select("doc_id", F.col("positions").alias("__a"))
    b = right.select("doc_id", F.col("positions").alias("__b"))
    steps = F.filter(F.sequence(F.lit(-k), F.lit(k)), lambda d: d != 0)

    def at_distance(d: Column) -> Column:
        met = F.array_intersect(F.transform("__a", lambda x: x + d), F.col("__b"))
        return F.transform(met, lambda y: F.struct((y - d).alias("position1"), y.alias("position2")))

    pairs = a.join(b, "doc_id").select("doc_id", F.explode(F.flatten(F.transform(steps, at_distance))).alias("p"))
    return pairs.select("doc_id", "p.position1", "p.position2")


def all_terms_present(index: DataFrame, terms: list[str]) -> DataFrame:
    """doc_ids that hold every distinct term."""
    wanted = sorted(set(terms))
    rows = lookup(index, wanted).groupBy("doc_id").agg(F.count_distinct("term").alias("n"))
    return rows.where(F.col("n") == len(wanted)).select("doc_id")


def term_frequencies(index: DataFrame, terms: list[str]) -> dict[str, int]:
    rows = lookup(index, sorted(set(terms))).groupBy("term").agg(F.count("*").alias("df")).collect()
    return {r["term"]: r["df"] for r in rows}


def pivot_slot(terms: list[str], frequency: dict[str, int]) -> int | None:
    """First slot with the fewest documents; None when a term has none."""
    if not terms or any(t not in frequency for t in terms):
        return None
    return min(range(len(terms)), key=lambda i: (frequency[terms[i]], i))


def near(positions: list[Column], pivot: int) -> Column:
    """The match predicate, on one array of positions for each slot."""

    def within(p: Column, k: int):
        return lambda x: F.abs(x - p).between(1, k)

    def holds(p: Column) -> Column:
        ok = F.lit(True)
        for i, other in enumerate(positions):
            if i != pivot:
                ok = ok & F.exists(other, within(p, abs(i - pivot)))
        return ok

    return F.exists(positions[pivot], holds)


def in_order(positions: list[Column]) -> Column:
    """An exact phrase: consecutive positions in the order of the slots."""
    first, *rest = positions

    def holds(p: Column) -> Column:
        ok = F.lit(True)
        for i, other in enumerate(rest, 1):
            ok = ok & F.array_contains(other, p + i)
        return ok

    return F.exists(first, holds)


def match(index: DataFrame, terms: list[str], strict: bool = False) -> DataFrame:
    """doc_id of the documents that match analysed terms (``strict``: exact phrases only), in no order."""
    if not terms:
        return index.select("doc_id").limit(0)
    if len(terms) == 1:
        return lookup(index, terms).select("doc_id").distinct()
    pivot = pivot_slot(terms, term_frequencies(index, terms))
    if pivot is None:
        return index.select("doc_id").limit(0)
    distinct = sorted(set(terms))
    rows = lookup(index, distinct).where(F.size("positions") > 0)
    held = rows.groupBy("doc_id").agg(*[F.flatten(F.collect_list(F.when(F.col("term") == t, F.col("positions")))).alias(f"p{i}") for i, t in enumerate(distinct)])
    slots = [F.col(f"p{distinct.index(t)}") for t in terms]
    return held.where(in_order(slots) if strict else near(slots, pivot)).select("doc_id")


def phrase(index: DataFrame, text: str, analyzer: Analyzer = DEFAULT, strict: bool = False) -> DataFrame:
    """doc_id of the documents that match a query string, analysed like the documents."""
    return match(index, analyzer.terms(index.sparkSession, text), strict)


def batch(index: DataFrame, slots: DataFrame) -> DataFrame:
    """query_id, doc_id: the matches of many queries (query_id, slot, term) at once.

    The pivot's positions are explored outwards: each slot's postings meet the
    pivot's on the document, a slot counts for a pivot position once, and a
    position for which all slots count is a match.
    """
    terms = few(slots.select("term").distinct())
    rows = index.select("term", "doc_id", "positions").join(terms, "term", "left_semi")
    frequency = rows.groupBy("term").agg(F.count("*").alias("df"))
    known = slots.join(frequency, "term", "left")
    order = Window.partitionBy("query_id").orderBy(F.col("df").asc_nulls_first(), "slot")
    by_query = Window.partitionBy("query_id")
    known = known.withColumns({"__place": F.row_number().over(order), "n": F.count("*").over(by_query), "missing": F.sum(F.col("df").isNull().cast("int")).over(by_query)})
    scratch = Scratch(index.sparkSession, "batch")
    known = scratch.keep(known.where("missing = 0").select("query_id", "slot", "term", "n", "__place"))
    pivots = few(known.where("__place = 1").select("query_id", F.col("term"), F.col("slot").alias("pivot"), "n"))
    hits = scratch.keep(rows.join(pivots, "term").select("query_id", "pivot", "n", "doc_id", F.col("positions").alias("at")))
    single = hits.where("n = 1").select("query_id", "doc_id")
    # a slot's postings are looked up in the documents of the query's rarest term only
    others = few(known.where("__place > 1").select("query_id", "slot", "term"))
    wanted = hits.where("n > 1").select("query_id", "doc_id").join(others, "query_id").select("query_id", "slot", "term", "doc_id")
    met = rows.join(few(wanted), ["term", "doc_id"]).select("query_id", "slot", "doc_id", "positions").join(hits, ["query_id", "doc_id"])
    close = F.filter("at", lambda p: F.exists("positions", lambda x: F.abs(x - p).between(1, F.abs(F.col("slot") - F.col("pivot")))))
    met = met.select("query_id", "doc_id", "n", "slot", F.explode(close).alias("p"))
    full = met.groupBy("query_id", "doc_id", "p", "n").agg(F.count("*").alias("c")).where("c = n - 1")
    return single.unionByName(full.select("query_id", "doc_id")).distinct()
