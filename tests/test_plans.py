import duckdb
import pytest

import __spark_entry__ as entry
from textquarry import plans

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def rows(frame):
    cols = sorted(frame.columns)
    return cols, sorted(map(tuple, frame[cols].astype(str).values))


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_oracle(spark, duck, name):
    assert rows(plans.queries()[name](spark, DIR).toPandas()) == rows(duck.sql(plans.oracle_sql()[name]).df())


def test_entry(spark):
    assert entry.entry(spark).columns == ["id", "title", "url", "snippet", "depth"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_lookup_of_few_columns(spark):
    """A search reads only the columns it needs."""
    plan = plans.queries()["term_df"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<text:string>" in plan


def test_batch_passages_equal_brute_force(spark, tmp_path):
    """Every term of a passage is a slot: a text with only its first two words is no match."""
    passage = "amber birch cedar dunes ember fjord"
    texts = [passage, "amber birch other words", "zinc " + passage + " amber", "ember fjord dunes cedar birch amber", "amber birch cedar dunes ember", "amber xenon yacht zonal birch xenon yacht zonal cedar dunes ember fjord", ""]
    items = [(1, passage), (2, "birch"), (3, "cedar dunes cedar"), (4, "amber missing"), (5, "")]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = {t: sum(t in x.split() for x in texts) for t in " ".join(texts).split()}
    want = set()
    for item, text in items:
        terms = text.split()
        if not terms or any(t not in df for t in terms):
            continue
        pivot = min(range(len(terms)), key=lambda i: (df[terms[i]], i))
        for doc, words in ((d, x.split()) for d, x in enumerate(texts)):
            near = lambda p, i: any(words[x] == terms[i] and 0 < abs(x - p) <= abs(i - pivot) for x in range(len(words)))
            if any(words[p] == terms[pivot] and all(i == pivot or near(p, i) for i in range(len(terms))) for p in range(len(words))):
                want.add((item, doc))
    got = [tuple(r) for r in plans.queries()["batch_passages"](spark, str(tmp_path)).select("query_id", "doc_id").collect()]
    assert len(got) == len(set(got)) and set(got) == want and (1, 0) in want and (1, 1) not in want


def same_as_sql(spark, tmp_path, name, **tables):
    """Whether a query and its SQL give the same rows over tables of a test."""
    c = duckdb.connect()
    for t, frame in tables.items():
        frame.write.mode("overwrite").parquet(f"{tmp_path}/{t}.parquet")
        c.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    return rows(plans.queries()[name](spark, str(tmp_path)).toPandas()) == rows(c.sql(plans.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", ["upsert_by_url", "page_upsert", "upsert_all_by_url"])
def test_pages_that_share_an_address(spark, tmp_path, name):
    """Addresses that occur twice among old pages, among new ones, among both, and between them."""
    shared = {2: "a", 4: "a", 3: "b", 9: "b", 6: "c", 12: "c", 8: "d", 15: "d", 5: "e", 7: "e"}
    pages = [(i, "http://" + shared.get(i, f"own{i}"), "<p>x</p>") for i in range(20)]
    assert same_as_sql(spark, tmp_path, name, pages=spark.createDataFrame(pages, "page_id long, url string, html string"))


@pytest.mark.parametrize("name", ["page_title", "html_struct"])
def test_titles_cut_inside_a_reference(spark, tmp_path, name):
    pages = [(i, f"http://h/{i}", f'<html><head><title>{t}</title></head><body><h1>{t}</h1><a href="/{i}">{t}</a></body></html>') for i, t in enumerate(["a &amp;&amp", "a&lt", "b &quot;&#x27", "c&amp;lt;", "d & e"])]
    assert same_as_sql(spark, tmp_path, name, pages=spark.createDataFrame(pages, "page_id long, url string, html string"))
