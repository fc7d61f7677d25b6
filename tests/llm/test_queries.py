import duckdb

import corpus_pipeline
from textquarry.llm import queries

DIR = "/root/testdata/sf0.001"


def test_names_and_columns(spark):
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(queries.queries())


def test_oracles(spark):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels", "benchmark", "conversations"):
        c.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        a, b = queries.queries()[name](spark, DIR).toPandas(), c.sql(sql).df()
        cols = sorted(a.columns)
        assert cols == sorted(b.columns) and sorted(map(tuple, a[cols].astype(str).values)) == sorted(map(tuple, b[cols].astype(str).values)), name


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, DIR).columns == docs.columns, name
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_duplicates", "passages", "packing"]
    out = corpus_pipeline.run(spark, DIR)
    assert out.count() > 0 and out.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0
