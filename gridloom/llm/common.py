"""What the operators of this subpackage share: tables, scratch space, words."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: With this set, a query's shuffle files go when the query ends, instead of when the driver next collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    A local session that names none, as in tests, gets a new folder of this machine; on a cluster none is an error.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="gridloom-"))
        found = sc.getCheckpointDir()
    return found


def helper(name: str) -> str:
    """A column name that no table of a user has."""
    return f"_{name}_{uuid.uuid4().hex}"


class Scratch:
    """Tables in the shared folder that cut lineage, so that a lost executor costs one stage.

    ``keep`` writes a frame and reads it back; ``drop`` removes a table which nothing lazy needs any more. What is
    left goes when the driver ends, as results may read it until then.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        fs, p = self._at(self.root)
        fs.deleteOnExit(p)

    def _at(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    @contextmanager
    def _shuffles_go(self):
        old = self.spark.conf.get(_CLEANUP, "false")
        self.spark.conf.set(_CLEANUP, "true")
        try:
            yield
        finally:
            self.spark.conf.set(_CLEANUP, old)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        with self._shuffles_go():
            df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            fs, p = self._at(self.path(name))
            fs.delete(p, True)


def hashed_sample(df: DataFrame, key: str, most: int) -> DataFrame:
    """The ``most`` rows whose keys have the least hashes: spread evenly, and the same however the table is dealt."""
    rank = F.xxhash64(F.col(key), F.lit(7))
    every = max(1, df.count() // max(1, 2 * most))  # only about twice as many rows are ranked
    near = df.where(F.pmod(F.shiftrightunsigned(rank, 20), F.lit(every)) == 0)
    return near.orderBy(rank, F.hash(key)).limit(most)


def partitions_for(spark: SparkSession, least: int = 8) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def utf8_bytes(text: str = "text") -> Column:
    """Bytes of a text in UTF-8; a null has none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
