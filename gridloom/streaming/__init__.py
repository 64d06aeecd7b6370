"""Cells that arrive as a stream, appended to a sparse matrix."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridloom.model import TYPES, ArrayMeta, is_nonzero
from gridloom.sources.store import Files, publish

_DATA = "data-stream"


def append_stream(cells: DataFrame, meta: ArrayMeta, path: str, checkpoint: str) -> StreamingQuery:
    """Write the cells (i1, i2, val) of a stream below path, each once, as they come; zeros are left out.

    The matrix can be opened once :func:`gridloom.sources.store.stored` finds its manifest, which :func:`finish` writes.
    """
    ready = cells.select(*meta.axes, cells["val"].cast(TYPES[meta.type]).alias("val")).where(is_nonzero(F.col("val"), meta.type))
    return ready.writeStream.format("parquet").option("path", f"{path}/{_DATA}").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def finish(spark: SparkSession, meta: ArrayMeta, path: str, expected: int | None = None) -> None:
    """Publish the matrix when all columns are there: an error if cells are outside the extents or stand twice, or are not as many as expected."""
    data = spark.read.parquet(f"{path}/{_DATA}")
    inside = " AND ".join(f"{a} BETWEEN 1 AND {d}" for a, d in zip(meta.axes, meta.dim, strict=True))
    got = data.agg(F.count("*").alias("n"), F.count_if(~F.expr(inside)).alias("out")).first()
    twice = not data.groupBy(*meta.axes).count().where("count > 1").isEmpty()
    if got.out or twice or expected is not None and got.n != expected:
        raise ValueError(f"{path}: {got.n} cells came, {got.out} of them outside {meta.dim}" + ", some twice" * twice)
    publish(Files(spark), path, replace(meta, data=(_DATA,), labels=None))
