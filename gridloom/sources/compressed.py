"""Matrices as compressed vectors: aligned data and indices with pointers, and the two folder conventions built on them.

    <group>/_group.json       shape, shape_order, layout (csc or csr), type, names of label tables; written last
    <group>/elements/         Parquet; k (from 0), index (from 0), and the values: ``data``, and more columns for other values at the same places
    <group>/indptr/           Parquet; pos (from 0), value; one more than columns (rows)
    <group>/<labels>/         Parquet; pos (from 1), label

A single-cell matrix of genes by cells is such a group with ``genes`` and ``barcodes``. An annotated table of observations is a
folder with ``X``, ``layers/<name>``, ``obs`` and ``var``; it is opened transposed, variables by observations.
"""

from __future__ import annotations

import json
import warnings
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.model import TYPES, ArrayMeta, GridArray, is_nonzero
from gridloom.operators.sparse import pointers, transpose
from gridloom.sources.store import Files, open_array, probe, write_array

COMPONENTS = ("data", "indices", "indptr", "shape")


def is_group(spark: SparkSession, path: str) -> bool:
    return Files(spark).exists(f"{path}/_group.json")


def _group(spark: SparkSession, path: str) -> dict:
    if not is_group(spark, path):
        raise FileNotFoundError(f"{path}: no compressed matrix")
    return json.loads(Files(spark).read(f"{path}/_group.json"))


def layout_of(group: dict, dim: tuple[int, int] | None = None, layout: str | None = None) -> tuple[tuple[int, int], str]:
    """Extents and layout of a group: as asked for, else as the group's attributes say (older names of them as well)."""
    if dim is None:
        found = group.get("shape") or group.get("h5sparse_shape")
        if found is None:
            raise ValueError("the group does not say its extents")
        dim = tuple(int(d) for d in found)
    if layout is None:
        said = group.get("layout") or group.get("encoding-type") or group.get("h5sparse_format") or "csc"
        layout = said.removesuffix("_matrix")
    if layout not in ("csc", "csr"):
        raise ValueError(f"layout {layout!r}")
    return dim, layout


def write_compressed(x: GridArray, path: str, labels: tuple[str, str] | None = None, layout: str = "csc") -> None:
    """Write a sparse matrix as a group; labels: the names of the tables of row and column labels."""
    if x.meta.rank != 2:
        raise ValueError("a matrix has two axes")
    files = Files(x.cells.sparkSession)
    if files.exists(f"{path}/_group.json"):
        raise FileExistsError(path)
    x, along = x.as_sparse(), 2 if layout == "csc" else 1
    axis, other = f"i{along}", f"i{3 - along}"
    ends = pointers(x, along)
    # Elements are numbered within their column, a window that holds one column, and moved by the column's pointer.
    inside = F.row_number().over(Window.partitionBy(axis).orderBy(other)) - 1
    numbered = x.cells.where(is_nonzero(F.col("val"), x.type)).withColumn("_n", inside)
    rows = numbered.join(ends.select(F.col("pos").alias(axis), "start"), axis).select((F.col("start") + F.col("_n")).alias("k"), (F.col(other) - 1).alias("index"), F.col("val").alias("data"))
    rows.repartitionByRange("k").sortWithinPartitions("k").write.mode("overwrite").parquet(f"{path}/elements")
    last = ends.agg(F.sum("n").alias("value")).select(F.lit(x.dim[along - 1]).cast("long").alias("pos"), F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    ends.select((F.col("pos") - 1).alias("pos"), F.col("start").cast("long").alias("value")).union(last).write.mode("overwrite").parquet(f"{path}/indptr")
    for k, name in enumerate(labels or (), 1):
        held = None if x.labels is None else x.labels.where(F.col("axis") == k).select("pos", "label")
        if held is not None:
            held.write.mode("overwrite").parquet(f"{path}/{name}")
    files.write(f"{path}/_group.json", json.dumps({"shape": list(x.dim), "layout": layout, "type": x.type}))


def component(spark: SparkSession, path: str, name: str, start: int | None = None, count: int | None = None) -> DataFrame:
    """(k, value) of one vector of a group, or of ``count`` values from the 1-based place ``start``. Indices are 1-based, as arrays count."""
    if name not in COMPONENTS:
        raise ValueError(f"component {name!r}: one of {', '.join(COMPONENTS)}")
    group = _group(spark, path)
    if name == "shape":
        df = spark.createDataFrame(list(enumerate(layout_of(group)[0])), "k long, value long")
    elif name == "indptr":
        df = spark.read.parquet(f"{path}/indptr").select(F.col("pos").alias("k"), "value")
    else:
        df = spark.read.parquet(f"{path}/elements").select("k", F.col("data").alias("value") if name == "data" else (F.col("index") + 1).alias("value"))
    if start is not None:
        df = df.where(F.col("k") >= start - 1)
        if count is not None:
            df = df.where(F.col("k") < start - 1 + count)
    return df.withColumn("k", F.col("k") + 1)


def from_compressed(elements: DataFrame, indptr: DataFrame, dim: tuple[int, int], layout: str = "csc", what: str = "vectors") -> GridArray:
    """A matrix of aligned vectors (k, index, value), from 0, and pointers (pos, value), from 0 and one more than columns (rows)."""
    major = dim[1] if layout == "csc" else dim[0]
    n = elements.agg(F.count("value").alias("v"), F.count("index").alias("i"), F.max("k").alias("k"), F.count("*").alias("n")).first()
    ends = indptr.agg(F.min_by("value", "pos").alias("first"), F.max_by("value", "pos").alias("last"), F.count("*").alias("n")).first()
    if ends.n != major + 1 or ends.first != 0 or ends.last != n.n or n.i != n.n or (n.n and n.k != n.n - 1):
        raise ValueError(f"{what}: {ends.n} pointers from {ends.first} to {ends.last}, {n.n} values and {n.i} indices do not go together")
    after = indptr.select((F.col("pos") - 1).alias("pos"), F.col("value").alias("end"))
    runs = indptr.join(after, "pos").select((F.col("pos") + 1).alias("_j"), F.col("value").alias("_a"), F.col("end").alias("_z"))
    if not runs.where("_z < _a").isEmpty():
        raise ValueError(f"{what}: pointers descend")
    held = runs.where("_z > _a").select("_j", F.explode(F.sequence("_a", F.col("_z") - 1)).alias("k"))
    kind = next(k for k, t in TYPES.items() if t == elements.schema["value"].dataType.simpleString())
    minor = F.col("index").cast("long") + 1
    i, j = (minor, F.col("_j")) if layout == "csc" else (F.col("_j"), minor)
    return GridArray(ArrayMeta(tuple(dim), kind, is_sparse=True, layout=layout), elements.join(held, "k").select(i.alias("i1"), j.alias("i2"), F.col("value").alias("val")))


def open_compressed(spark: SparkSession, path: str, subdata: str = "data", dim: tuple[int, int] | None = None, layout: str | None = None, labels: tuple[str, str] | None = None) -> GridArray:
    """The matrix of a group, checked: first pointer 0, last one the number of values and of indices, none less than the one before.

    subdata: which of the vectors of values. dim and layout override what the group says.
    """
    group, files = _group(spark, path), Files(spark)
    dim, layout = layout_of(group, dim, layout)
    elements, indptr = spark.read.parquet(f"{path}/elements"), spark.read.parquet(f"{path}/indptr")
    if subdata not in elements.columns:
        raise ValueError(f"{path} has no values {subdata!r}")
    x = from_compressed(elements.select("k", "index", F.col(subdata).alias("value")), indptr, dim, layout, what=path)
    parts = []
    for k, name in enumerate(labels or (), 1):
        if files.exists(f"{path}/{name}"):
            held = spark.read.schema("pos long, label string").parquet(f"{path}/{name}")
            if (found := held.count()) != dim[k - 1]:
                raise ValueError(f"{path}/{name}: {found} labels for an extent of {dim[k - 1]}")
            parts.append(held.select(F.lit(k).alias("axis"), "pos", "label"))
    names = None if not parts else parts[0] if len(parts) == 1 else parts[0].union(parts[1])
    return replace(x, labels=names)


def write_cells_matrix(x: GridArray, path: str, group: str = "matrix") -> None:
    """Genes by cells, as a group with ``genes`` and ``barcodes``."""
    write_compressed(x, f"{path}/{group}", ("genes", "barcodes"))


def open_cells_matrix(spark: SparkSession, path: str, group: str = "matrix") -> GridArray:
    return open_compressed(spark, f"{path}/{group}", labels=("genes", "barcodes"))


def write_annotated(x: GridArray, path: str, layers: dict[str, GridArray] | None = None, layout: str | None = "csr") -> None:
    """Variables by observations, as an annotated table of observations. layout None: dense arrays."""
    if x.labels is not None:
        for axis, name in ((1, "var"), (2, "obs")):
            x.labels.where(F.col("axis") == axis).select("pos", F.col("label").alias("index")).write.mode("overwrite").parquet(f"{path}/{name}")
    for at, a in (("X", x), *((f"layers/{k}", v) for k, v in (layers or {}).items())):
        if a.dim != x.dim:
            raise ValueError(f"{at} has extents {a.dim}, not {x.dim}")
        turned = transpose(a)
        if layout is None:
            write_array(replace(turned, labels=None), f"{path}/{at}", as_sparse=False)
        else:
            write_compressed(turned, f"{path}/{at}", layout=layout)


def open_annotated(spark: SparkSession, path: str, layer: str | None = None) -> GridArray:
    """``X`` or a layer of an annotated table, variables by observations, with the names in ``var`` and ``obs`` as labels."""
    files, at = Files(spark), f"{path}/X" if layer is None else f"{path}/layers/{layer}"
    if is_group(spark, at):
        x = open_compressed(spark, at)
    elif probe(spark, at) == "array":
        x = open_array(spark, at)
        if x.meta.rank != 2:
            raise ValueError(f"{at} has {x.meta.rank} axes, not 2")
    else:
        raise FileNotFoundError(at)
    x, parts = replace(transpose(x), labels=None), []
    for axis, name in ((1, "var"), (2, "obs")):
        if files.exists(f"{path}/{name}"):
            parts.append(spark.read.schema("pos long, index string").parquet(f"{path}/{name}").select(F.lit(axis).alias("axis"), "pos", F.col("index").alias("label")))
    if not parts:
        warnings.warn(f"{path} has no names of variables or observations", stacklevel=2)
        return x
    return replace(x, labels=parts[0] if len(parts) == 1 else parts[0].union(parts[1]))
