"""Sparse matrices: stored values by column or row, pointers, sparsity."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.model import GridArray
from gridloom.operators.select import BROADCAST_POSITIONS, positions_of
from gridloom.plans.selection import check_selection, dense_enough


def _normal(x: GridArray, along: int, at: Sequence[float | str] | None) -> list[int] | None:
    if at is None:
        return None
    if at and isinstance(at[0], str):
        return positions_of(x, along, at)
    check_selection([x.dim[along - 1]], [at])
    return [round(p) for p in at]


def nonzero_by(x: GridArray, along: int, at: Sequence[float | str] | None = None) -> DataFrame:
    """(ord, pos, vals): the stored values of each column (along = 2) or row (1) asked for, in that order, repeats and empty ones included.

    Positions that fill at least a fifth of their stretch are read by its ends, others one by one. The order within vals is by the other axis.
    """
    if x.meta.rank != 2:
        raise ValueError("a matrix has two axes")
    axis, other = f"i{along}", f"i{3 - along}"
    wanted_at = _normal(x, along, at)
    spark = x.cells.sparkSession
    if wanted_at is None:
        wanted = spark.range(1, x.dim[along - 1] + 1).select(F.col("id").alias("ord"), F.col("id").alias("pos"))
        cells = x.cells
    else:
        wanted = spark.createDataFrame(list(enumerate(wanted_at, 1)), "ord long, pos long")
        cells = x.cells
        if wanted_at and dense_enough(wanted_at):
            cells = cells.where(F.col(axis).between(min(wanted_at), max(wanted_at)))
        distinct = wanted.select("pos").distinct()
        cells = cells.join(F.broadcast(distinct) if len(wanted_at) <= BROADCAST_POSITIONS else distinct, F.col(axis) == F.col("pos"), "left_semi")
    held = cells.groupBy(F.col(axis).alias("pos")).agg(F.array_sort(F.collect_list(F.struct(F.col(other).alias("k"), "val"))).alias("s"))
    vals = F.coalesce(F.transform("s", lambda s: s["val"]), F.array())
    return wanted.join(held, "pos", "left").select("ord", "pos", vals.alias("vals"))


def counts_along(x: GridArray, along: int) -> DataFrame:
    """(pos, n): stored values of every column or row, empty ones included."""
    n = x.cells.groupBy(F.col(f"i{along}").alias("pos")).agg(F.count("*").alias("n"))
    return x.cells.sparkSession.range(1, x.dim[along - 1] + 1).select(F.col("id").alias("pos")).join(n, "pos", "left").select("pos", F.coalesce("n", F.lit(0)).alias("n"))


def pointers(x: GridArray, along: int = 2, block: int = 1 << 16) -> DataFrame:
    """(pos, start, n): where each column's stored values begin (from 0) if they stand one after another.

    Sums of blocks of positions come first, so that no task holds more than a block, and the block sums.
    """
    n = counts_along(x, along).withColumn("_b", F.floor((F.col("pos") - 1) / block))
    sums = n.groupBy("_b").agg(F.sum("n").alias("_t"))
    before = sums.select("_b", F.coalesce(F.sum("_t").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_s"))
    inside = F.sum("n").over(Window.partitionBy("_b").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return n.join(before, "_b").select("pos", (F.col("_s") + inside - F.col("n")).alias("start"), "n")


def sparsity(x: GridArray) -> DataFrame:
    """One row: the share of cells without a stored value."""
    return x.cells.agg((1 - F.count("*") / F.lit(float(max(1, x.meta.length)))).alias("sparsity"))


def transpose(x: GridArray) -> GridArray:
    """Axes in reverse, labels too; only names change."""
    n = x.meta.rank
    cells = x.cells.select(*(F.col(f"i{n - k}").alias(f"i{k + 1}") for k in range(n)), "val")
    turn = lambda t: None if t is None else tuple(reversed(t))
    layout = {"csc": "csr", "csr": "csc"}.get(x.meta.layout, x.meta.layout)
    labels = None if x.labels is None else x.labels.withColumn("axis", (F.lit(n + 1) - F.col("axis")).cast("int"))
    return GridArray(replace(x.meta, dim=turn(x.dim), chunkdim=turn(x.meta.chunkdim), layout=layout, axis_labels=turn(x.meta.axis_labels)), cells, labels)


def to_local_csc(x: GridArray, limit: int = 50_000_000):
    """The matrix as a local compressed one, if it has at most ``limit`` stored values."""
    from pyspark.ml.linalg import SparseMatrix

    if (n := x.cells.count()) > limit:
        raise ValueError(f"{n} stored values; a local matrix may have {limit}")
    import numpy as np

    t = x.cells.orderBy("i2", "i1").toPandas()
    ends = np.concatenate([[0], np.cumsum(np.bincount(t["i2"] - 1, minlength=x.dim[1]))])
    return SparseMatrix(x.dim[0], x.dim[1], ends, t["i1"] - 1, t["val"].astype(float))
