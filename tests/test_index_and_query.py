import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textquarry.functions.analysis import DEFAULT, PLAIN, UNSTEMMED
from textquarry.operators import index, query, search

SCHEMA = "term string, doc_id long, positions array<int>"


def made(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("tf", F.size("positions").cast("long"))


def ids(df):
    return sorted(r["doc_id"] for r in df.collect())


@pytest.mark.parametrize("p1, p2, k, expected", [
    ({1: [10]}, {1: [9, 11, 13]}, 1, {(1, 10, 9), (1, 10, 11)}),
    ({7: [5, 10]}, {7: [4, 6, 9, 12]}, 1, {(7, 5, 4), (7, 5, 6), (7, 10, 9)}),
    ({4: [10]}, {4: [12]}, 2, {(4, 10, 12)}),
    ({4: [10, 200]}, {4: [50, 150, 260]}, 100, {(4, 10, 50), (4, 200, 150), (4, 200, 260)}),
    ({1: [1, 2], 2: [1, 10], 4: [100]}, {2: [2, 9], 3: [1], 4: [98, 101, 105]}, 1, {(2, 1, 2), (2, 10, 9), (4, 100, 101)}),
    ({1: [1], 2: [10, 30], 3: [100]}, {1: [50], 2: [9, 29, 31], 3: [1000]}, 1, {(2, 10, 9), (2, 30, 29), (2, 30, 31)}),
    ({}, {1: [1]}, 3, set()),
    ({1: [5]}, {1: [5]}, 3, set()),
])
def test_positional_intersect(spark, p1, p2, k, expected):
    a, b = (made(spark, [("t", d, p) for d, p in x.items()]) for x in (p1, p2))
    assert {tuple(r) for r in query.positional_intersect(a, b, k).collect()} == expected


def test_queries(spark):
    rows = [("eleph", d, []) for d in (0, 2, 4)]
    assert ids(query.match(made(spark, rows), ["eleph"])) == [0, 2, 4]
    rows = [("run", 3, [1]), ("jump", 3, [2]), ("run", 5, [7]), ("jump", 5, [6]), ("run", 6, [1]), ("jump", 6, [9])]
    rows = made(spark, rows)
    assert ids(query.phrase(rows, "Running JUMPING!", DEFAULT)) == [3, 5]
    assert ids(query.match(rows, ["run", "jump"], strict=True)) == [3]
    assert ids(query.match(rows, ["run", "absent"])) == []
    assert ids(query.phrase(rows, "  \t\n ", DEFAULT)) == []
    assert ids(query.match(made(spark, [("alpha", 1, [0, 1])]), ["alpha", "alpha"])) == [1]
    assert ids(query.match(made(spark, [("alpha", 1, [0])]), ["alpha", "alpha"])) == []


def test_pivot_decides(spark):
    """c a b matches a b c when a is the rarest term."""
    rows = made(spark, [("c", 1, [0]), ("a", 1, [1]), ("b", 1, [2]), ("b", 2, [0]), ("c", 2, [0])])
    assert ids(query.match(rows, ["a", "b", "c"])) == [1]


def brute(docs, terms):
    df = {t: sum(t in d for d in docs.values()) for t in terms}
    if not terms or any(v == 0 for v in df.values()):
        return []
    pivot = min(range(len(terms)), key=lambda i: (df[terms[i]], i))
    out = []
    for d, words in docs.items():
        if len(terms) == 1:
            ok = terms[0] in words
        else:
            at = {t: [i for i, w in enumerate(words) if w == t] for t in terms}
            ok = any(all(any(0 < abs(x - p) <= abs(i - pivot) for x in at[t]) for i, t in enumerate(terms) if i != pivot) for p in at[terms[pivot]])
        if ok:
            out.append(d)
    return sorted(out)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from("abcd"), max_size=9), min_size=1, max_size=6), st.lists(st.lists(st.sampled_from("abcd"), min_size=1, max_size=4), min_size=1, max_size=4))
def test_match_and_batch_agree_with_brute_force(spark, docs, queries):
    docs = dict(enumerate(docs))
    rows = spark.createDataFrame([(d, i, w) for d, ws in docs.items() for i, w in enumerate(ws)], "doc_id long, pos int, term string")
    rows = index.invert(rows).persist()
    slots = spark.createDataFrame([(q, i, t) for q, ts in enumerate(queries) for i, t in enumerate(ts)], "query_id long, slot int, term string")
    got = {}
    for r in query.batch(rows, slots).collect():
        got.setdefault(r["query_id"], []).append(r["doc_id"])
    for q, terms in enumerate(queries):
        assert sorted(got.get(q, [])) == brute(docs, terms)
    assert ids(query.match(rows, queries[0])) == brute(docs, queries[0])


def test_buckets(spark):
    rows = made(spark, [("hot", d, [0]) for d in range(501)] + [("b", d, [1]) for d in range(100)] + [("c", d, [1]) for d in range(101)])
    got = index.buckets(rows, 100).collect()
    sizes = {(r["term"], r["bucket"]): r["document_frequency"] for r in got}
    assert sizes == {**{("hot", i): 100 for i in range(5)}, ("hot", 5): 1, ("b", 0): 100, ("c", 0): 100, ("c", 1): 1}
    first = next(r for r in got if (r["term"], r["bucket"]) == ("hot", 0))
    assert first["postings"] == list(range(100)) and first["positions"]["7"] == [0]
    assert {r["term"]: (r["bucket"], r["document_frequency"]) for r in index.last_bucket(index.bucket_sizes(index.assign_buckets(rows, 100))).collect()} == {"hot": (5, 1), "b": (0, 100), "c": (1, 1)}


def test_append_fills_the_last_bucket(spark):
    old = index.assign_buckets(made(spark, [("a", d, [0]) for d in range(150)]), 100)
    out = index.append(old, made(spark, [("a", d, [0]) for d in range(150, 260)] + [("n", 1, [4])]), 100)
    assert {(r["term"], r["bucket"]): r["count"] for r in out.groupBy("term", "bucket").count().collect()} == {("a", 0): 100, ("a", 1): 100, ("a", 2): 60, ("n", 0): 1}


def test_merge(spark):
    a, b = made(spark, [("t", 1, [5, 1]), ("t", 2, [0])]), made(spark, [("t", 1, [3]), ("u", 9, [1])])
    assert {(r["term"], r["doc_id"]): r["positions"] for r in index.merge(a, b).collect()} == {("t", 1): [1, 3, 5], ("t", 2): [0], ("u", 9): [1]}
    whole = [(f"t{d % 7}", d, [d]) for d in range(200)]
    random.Random(1).shuffle(whole)
    assert index.merge(*[made(spark, whole[i::6]) for i in range(6)]).count() == 200


def test_write_and_lookup(spark, tmp_path):
    rows = made(spark, [(f"t{d % 50}", d, [d]) for d in range(500)])
    index.write(rows, str(tmp_path / "p"), parts=16)
    found = index.lookup(spark.read.parquet(str(tmp_path / "p")), ["t3", "t4"], parts=16)
    assert ids(found) == sorted(d for d in range(500) if d % 50 in (3, 4))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*term_part#\d+ IN \(", plan)


def test_search(spark):
    text = "<p>" + "quick brown fox " * 30 + "</p>"
    pages = spark.createDataFrame([("a", "http://x", "T", text, "", 0), ("b", "http://y", "U", "<p>slow fox</p>", "slow fox", 1)], "_id string, url string, title string, html_body string, cleaned_content string, depth int")
    rows = index.postings(pages, "_id", "html_body")
    answer = search.search(pages, rows, "foxes").collect()
    assert answer["total_results"] == 2 and answer["highlighted_terms"] == ["foxes"]
    assert answer["results"][0]["snippet"] == text[:200] + "..." and answer["results"][1]["snippet"] == "slow fox"
    with pytest.raises(ValueError):
        search.search(pages, rows, " \n ")
    marked = pages.select(search.highlight(F.lit("Fox, foxy <b> fox"), ["fox,", "FOX"]).alias("h")).first()["h"]
    assert marked == "<mark><mark>Fox</mark></mark>, foxy &lt;b&gt; <mark><mark>fox</mark></mark>"
    assert pages.select(search.strip_tags(F.lit("<p>a<script>x</script>b</p>")).alias("h")).first()["h"] == "ab"


def test_analyzers_on_plain_text(spark):
    rows = spark.createDataFrame([(1, "The quick foxes, running!"), (2, None), (3, "")], "doc_id long, text string")
    assert [(r["doc_id"], r["term"]) for r in index.postings(rows, "doc_id", "text", PLAIN).orderBy("term").collect()] == [(1, "fox"), (1, "quick"), (1, "run")]
    assert index.postings(rows, "doc_id", "text", UNSTEMMED).count() == 3


@pytest.mark.parametrize("kind", ["long", "string"])
def test_hot_terms_are_numbered_in_ranges(spark, monkeypatch, kind):
    """Terms over the limit are cut into ranges of ids of any type; buckets are as if numbered in one go."""
    monkeypatch.setattr(index, "HOT", 40)
    monkeypatch.setattr(index, "RANGES", 7)
    rows = [("hot", d) for d in random.Random(2).sample(range(1000), 333)] + [("warm", d) for d in range(41)] + [("cold", d) for d in range(5)]
    docs = spark.createDataFrame([(t, d if kind == "long" else f"{d:05d}", [0]) for t, d in rows], f"term string, doc_id {kind}, positions array<int>").withColumn("tf", F.lit(1).cast("long"))
    numbered = index.assign_buckets(docs, 10)
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    assert "__part" in plan  # the window is dealt by term and range
    want = {}
    for term in ("hot", "warm", "cold"):
        for n, d in enumerate(sorted(d for t, d in rows if t == term)):
            want[term, d if kind == "long" else f"{d:05d}"] = n // 10
    assert {(r["term"], r["doc_id"]): r["bucket"] for r in numbered.collect()} == want


def test_grouping_inside_rows_equals_grouping_by_shuffle(spark):
    texts = ["b a b c a b", "", None, "x", "a a a a", " ".join(random.Random(3).choices("abcdefgh", k=400)), "the of and"]
    docs = spark.createDataFrame([(i, " ".join(w + w for w in (t or "").split()) if t is not None else None) for i, t in enumerate(texts)], "doc_id long, text string")
    as_set = lambda df: {(r["term"], r["doc_id"], tuple(r["positions"]), r["tf"]) for r in df.collect()}
    inside = index.postings(docs, "doc_id", "text", UNSTEMMED, unique=True)
    assert as_set(inside) == as_set(index.postings(docs, "doc_id", "text", UNSTEMMED)) and inside.count() > 10
    assert "Exchange" not in inside._jdf.queryExecution().executedPlan().toString()


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sets(st.integers(0, 30)), st.sets(st.integers(0, 30))), min_size=1, max_size=5), st.integers(1, 6))
def test_positional_pairs_equal_brute_force(spark, docs, k):
    one = spark.createDataFrame([(i, sorted(a)) for i, (a, _) in enumerate(docs)], "doc_id long, positions array<int>")
    two = spark.createDataFrame([(i, sorted(b)) for i, (_, b) in enumerate(docs)], "doc_id long, positions array<int>")
    got = sorted(tuple(r) for r in query.positional_intersect(one, two, k).collect())
    assert got == sorted((i, x, y) for i, (a, b) in enumerate(docs) for x in a for y in b if 0 < abs(x - y) <= k)


def test_replace_with_documents_that_lost_all_terms(spark):
    old = made(spark, [("a", 1, [0]), ("a", 2, [0]), ("b", 1, [1])])
    new = made(spark, [("c", 2, [0])])
    both = spark.createDataFrame([(1,), (2,)], "doc_id long")
    assert {(r["term"], r["doc_id"]) for r in index.replace(old, new, both).collect()} == {("c", 2)}
    assert {(r["term"], r["doc_id"]) for r in index.replace(old, new).collect()} == {("a", 1), ("b", 1), ("c", 2)}


def test_pages_of_an_answer(spark):
    pages = spark.createDataFrame([(f"p{i}", f"http://{i}", "T", "<p>foxes</p>", "", 0) for i in range(5)], "_id string, url string, title string, html_body string, cleaned_content string, depth int")
    rows = index.postings(pages, "_id", "html_body").persist()
    seen, after = [], None
    while True:
        answer = search.search(pages, rows, "fox").collect(limit=2, after=after)
        seen.append([r["id"] for r in answer["results"]])
        assert answer["total_results"] == 5
        after = answer.get("next")
        if after is None:
            break
    assert seen == [["p0", "p1"], ["p2", "p3"], ["p4"]]
    assert "next" not in search.search(pages, rows, "fox").collect()
