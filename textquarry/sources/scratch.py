"""Intermediate tables in the folder that all executors share.

The folder is ``spark.checkpoint.dir`` of the session. Where the session has
none, a folder of this machine is used if the master is local (tests, one
machine); on a cluster the executors would write to disks of their own, so
that is an error. A table written here cuts the lineage and survives the loss
of executors. A caller removes what its result no longer reads; the table
that the result itself is read from goes when the application ends.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="textquarry-")
    return _OWN[app]


class Scratch:
    """Tables of one call, each under a fresh path."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/textquarry/{name}-{uuid.uuid4().hex}"
        self.n = 0
        path, fs = self._at(self.root)
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def _at(self, path: str):
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        found = jvm.org.apache.hadoop.fs.Path(path)
        return found, found.getFileSystem(conf)

    def keep(self, df: DataFrame) -> DataFrame:
        """Writes ``df`` and returns the written table."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *numbers: int) -> None:
        """Removes the tables with these numbers (from 1, in the order of ``keep``)."""
        for i in numbers:
            path, fs = self._at(f"{self.root}/{i}")
            fs.delete(path, True)

    def finish(self, df: DataFrame) -> DataFrame:
        """Writes ``df`` as the last table and removes all others, which it no longer needs."""
        last = self.keep(df)
        self.drop(*range(1, self.n))
        return last
