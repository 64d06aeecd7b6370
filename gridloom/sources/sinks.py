"""Arrays that are written block by block.

Blocks are written where they belong as they come, each by its own Spark job; :meth:`close` checks them and publishes the array. Until then there
is no manifest, and so no array. A sink that is given up leaves a folder without one.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gridloom.model import TYPES, ArrayMeta, GridArray
from gridloom.operators.select import densify
from gridloom.sources.store import Files, open_array, publish, write_array


class DenseSink:
    """A dense array whose blocks come in any order and at any place; where blocks overlap, the later one holds."""

    def __init__(self, spark: SparkSession, path: str, dim: Sequence[int], kind: str = "double", chunkdim: Sequence[int] | None = None, level: int = 6):
        self.spark, self.path, self.chunkdim, self.level = spark, path, chunkdim, level
        self.meta, self.blocks, self.closed = ArrayMeta(tuple(dim), kind), 0, False
        self.aside = f"{path}/blocks-{uuid.uuid4().hex}"
        if Files(spark).exists(f"{path}/_array.json"):
            raise FileExistsError(path)

    def write_block(self, offset: Sequence[int], block: GridArray) -> None:
        """Write a block whose first cell stands ``offset`` (from 0) into the array."""
        if self.closed or block.meta.rank != self.meta.rank or any(o < 0 or o + b > d for o, b, d in zip(offset, block.dim, self.meta.dim, strict=True)):
            raise ValueError(f"no block of {block.dim} at {tuple(offset)} of {self.meta.dim}")
        moved = [(F.col(a) + F.lit(o)).alias(a) for a, o in zip(self.meta.axes, offset, strict=True)]
        cells = densify(block).cells.select(*moved, F.col("val").cast(TYPES[self.meta.type]).alias("val"), F.lit(self.blocks).alias("_turn"))
        cells.write.mode("append").parquet(self.aside)
        self.blocks += 1

    def close(self) -> GridArray:
        """The array; an error if a cell was never written."""
        schema = f"{', '.join(f'{a} long' for a in self.meta.axes)}, val {TYPES[self.meta.type]}, _turn int"
        cells = self.spark.read.schema(schema).parquet(self.aside) if self.blocks else self.spark.createDataFrame([], schema)
        cells = cells.groupBy(*self.meta.axes).agg(F.max_by("val", "_turn").alias("val"))
        if (n := cells.count()) != self.meta.length:
            raise ValueError(f"{self.path}: {n} of {self.meta.length} cells were written")
        self.closed = True
        out = write_array(GridArray(self.meta, cells), self.path, self.chunkdim, self.level)
        Files(self.spark).delete(self.aside)
        return out


class ColumnSink:
    """A sparse matrix whose full columns come one block behind the other."""

    def __init__(self, spark: SparkSession, path: str, dim: tuple[int, int], kind: str = "double"):
        self.spark, self.path, self.written, self.closed = spark, path, 0, False
        self.meta = ArrayMeta(tuple(dim), kind, is_sparse=True, layout="csc", labels=None)
        self.parts: list[str] = []
        if Files(spark).exists(f"{path}/_array.json"):
            raise FileExistsError(path)

    def write_block(self, first: int, block: GridArray) -> float:
        """Write full columns from column ``first`` (from 1), which has to be the next one; returns the block's sparsity."""
        if self.closed or block.meta.rank != 2 or block.dim[0] != self.meta.dim[0] or first != self.written + 1 or self.written + block.dim[1] > self.meta.dim[1]:
            raise ValueError(f"columns from {first} on are not the next of {self.meta.dim}, of which {self.written} are written")
        name = f"data-{uuid.uuid4().hex}"
        cells = block.as_sparse().cells.select("i1", (F.col("i2") + F.lit(self.written)).alias("i2"), F.col("val").cast(TYPES[self.meta.type]).alias("val"))
        cells.sortWithinPartitions("i2", "i1").write.parquet(f"{self.path}/{name}")
        self.parts.append(name)
        self.written += block.dim[1]
        held = self.spark.read.parquet(f"{self.path}/{name}").count()
        return 1 - held / max(1, block.meta.length)

    def close(self) -> GridArray:
        """The matrix; an error unless all columns were written."""
        if self.written != self.meta.dim[1]:
            raise ValueError(f"{self.path}: {self.written} of {self.meta.dim[1]} columns were written")
        self.closed = True
        publish(Files(self.spark), self.path, replace(self.meta, data=tuple(self.parts)))
        return open_array(self.spark, self.path)


def realize(x: GridArray, path: str, backend: str = "files", level: int = 6) -> GridArray:
    """The array computed now: in files at path, or kept in the executors' memory (what does not fit goes to their disks)."""
    if backend == "files":
        return write_array(x, path, level=level)
    if backend != "memory":
        raise ValueError(f"backend {backend!r}: files or memory")
    cells = x.cells.persist()
    cells.count()
    return GridArray(x.meta, cells, x.labels)
