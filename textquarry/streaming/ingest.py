"""Index building over a stream of pages.

A micro-batch becomes one segment, written under its batch number: a batch
that runs again after a failure replaces its own files, so nothing is counted
twice and a page is only behind the stream's checkpoint once its postings are
durable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.analysis import DEFAULT, Analyzer
from ..operators.index import GROUPS, grouped, merge
from ..sources.store import few


def page_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files of pages as they arrive."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def index_stream(
    pages: DataFrame, segments: str, checkpoint: str, doc_id: str = "_id", text: str = "html_body", key: str = "url", analyzer: Analyzer = DEFAULT, once: bool = True
) -> StreamingQuery:
    """Starts the stream; every batch writes ``segments/batch=N`` (term, doc_id, positions, tf, version).

    A page that occurs twice in a batch counts with its larger id. Every page
    of a batch has a row without a term too, so that a page whose new text has
    no terms takes the place of its old version. ``once`` ends the query when
    all files present have been read.
    """

    def write(batch: DataFrame, number: int) -> None:
        # dealt out first, so that texts are sorted in many small tasks, not in those that read the files
        newest = batch.select(doc_id, text, key).repartition(key).groupBy(key).agg(F.max_by(F.struct(doc_id, text), doc_id).alias("r")).select("r.*")
        groups = F.coalesce(grouped(analyzer.analyze(F.col(text))), F.array().cast(GROUPS))
        none = F.array(F.lit(None).cast(GROUPS.elementType))
        rows = newest.select(F.col(doc_id).alias("doc_id"), F.explode(F.concat(groups, none)).alias("g"))
        rows = rows.select("g.term", "doc_id", "g.positions")
        # where ids are the key, no two rows have the same one
        rows = rows.withColumn("tf", F.when(F.col("term").isNotNull(), F.size("positions").cast("long"))) if key == doc_id else _merged(rows)
        rows = rows.withColumn("version", F.lit(number).cast("long"))
        rows.sortWithinPartitions("term").write.mode("overwrite").parquet(f"{segments}/batch={number}")

    writer = pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if once else writer.start()


def _merged(rows: DataFrame) -> DataFrame:
    """Equal (term, doc_id) rows as one; a row without a term has no positions."""
    rows = merge(rows)
    return rows.withColumns({c: F.when(F.col("term").isNotNull(), F.col(c)) for c in ("positions", "tf")})


def current(segments: DataFrame) -> DataFrame:
    """Postings of all segments in which each document has only the rows of its last version."""
    versions = segments.groupBy("doc_id").agg(F.max("version").alias("__last"), F.min("version").alias("__first"))
    # only documents that came again have rows that don't count; where they are few, nothing else is shuffled
    again = versions.where(F.col("__last") > F.col("__first")).select("doc_id", "__last")
    rows = segments.where("term is not null").join(few(again), "doc_id", "left")
    return rows.where(F.coalesce(F.col("version") == F.col("__last"), F.lit(True))).select("term", "doc_id", "positions", "tf")


def compact(spark: SparkSession, segments: str, out: str) -> None:
    """Writes the current postings of all segments as one, sorted by term; a hot term goes to several tasks by ranges of ids."""
    rows = current(spark.read.parquet(segments))
    rows.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(out)
