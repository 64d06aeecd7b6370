"""Reshaping by joining neighbouring axes, and binding along an axis."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from functools import reduce
from math import prod

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.model import GridArray, linear_index
from gridloom.operators.select import densify, select
from gridloom.plans.selection import Positions, axes_to_collapse


def reshape(x: GridArray, new_dim: Sequence[int]) -> GridArray:
    """The array with one group of neighbouring axes joined to one, in column-major order; nothing is moved."""
    group = axes_to_collapse(x.dim, new_dim)
    if group is None:
        return x
    a, z = group
    joined = linear_index([F.col(f"i{k + 1}") for k in range(a, z + 1)], x.dim[a : z + 1])
    cols = [F.col(f"i{k + 1}") for k in range(a)] + [joined] + [F.col(f"i{k + 1}") for k in range(z + 1, x.meta.rank)]
    cells = x.cells.select(*(c.alias(f"i{k + 1}") for k, c in enumerate(cols)), "val")
    labels = x.labels
    if labels is not None:  # the joined axis has no labels
        axis = F.when(F.col("axis") <= a, F.col("axis")).otherwise(F.col("axis") - (z - a)).cast("int")
        labels = labels.where((F.col("axis") <= a) | (F.col("axis") > z + 1)).withColumn("axis", axis)
    chunk = None
    if x.meta.chunkdim is not None:
        chunk = (*x.meta.chunkdim[:a], prod(x.meta.chunkdim[a : z + 1]), *x.meta.chunkdim[z + 1 :])
    return GridArray(replace(x.meta, dim=tuple(new_dim), chunkdim=chunk, axis_labels=None, layout="dense" if len(new_dim) != 2 else x.meta.layout), cells, labels)


def select_reshaped(x: GridArray, new_dim: Sequence[int], index: Sequence[Positions]) -> GridArray:
    return select(reshape(x, new_dim), index)


def bind(parts: Sequence[GridArray], axis: int) -> GridArray:
    """Arrays one after another along an axis (from 1); the others' extents must agree."""
    first, at, moved, starts = parts[0], 0, [], []
    for p in parts:
        if p.meta.rank != first.meta.rank or any(a != b for k, (a, b) in enumerate(zip(p.dim, first.dim, strict=True)) if k != axis - 1):
            raise ValueError(f"{p.dim} does not go with {first.dim} along axis {axis}")
        p = p.cast(first.type)
        moved.append(p.cells.withColumn(f"i{axis}", F.col(f"i{axis}") + F.lit(at)))
        starts.append(at)
        at += p.dim[axis - 1]
    dim = tuple(at if k == axis - 1 else d for k, d in enumerate(first.dim))
    sparse = all(p.is_sparse for p in parts)
    if not sparse:
        moved = [densify(p).cells.withColumn(f"i{axis}", F.col(f"i{axis}") + F.lit(b)) if p.is_sparse else m for p, m, b in zip(parts, moved, starts, strict=True)]
    return GridArray(replace(first.meta, dim=dim, chunkdim=None, is_sparse=sparse), reduce(lambda a, b: a.unionByName(b), moved), _bound_labels(parts, starts, axis))


def _bound_labels(parts: Sequence[GridArray], starts: Sequence[int], axis: int) -> DataFrame | None:
    """Labels of the bound axis one after another, of the other axes from the first array that has any."""
    held = [(p.labels, b) for p, b in zip(parts, starts, strict=True) if p.labels is not None]
    if not held:
        return None
    along = [df.where(F.col("axis") == axis).withColumn("pos", F.col("pos") + F.lit(b)) for df, b in held]
    return reduce(lambda a, b: a.unionByName(b), [held[0][0].where(F.col("axis") != axis), *along])
