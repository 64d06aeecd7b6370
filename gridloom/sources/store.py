"""Arrays in folders: chunked tables with a manifest that is written last.

    <array>/data-<id>/    Parquet; dense: chunks (c1.., off, ext, vals) sorted by chunk id; sparse: cells sorted by the compressed axis
    <array>/dimnames-<id>/ Parquet; axis, pos, label
    <array>/_array.json   the metadata with the names of these folders; an array without it is not there

A new version is written beside the old one; it holds once the manifest names it, and the old one is deleted after that.

All files go through Hadoop's file systems, so local, HDFS and object store paths are alike.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.model import TYPES, ArrayMeta, GridArray, is_nonzero
from gridloom.operators.select import cells_of_chunks, chunk_filter, densify, select
from gridloom.plans.geometry import CHUNK_LENGTH, chunk_shape
from gridloom.plans.selection import Positions, plan_axis

#: Cells of a chunk that is a whole array: a chunk is one row, made by one task.
ONE_CHUNK = 20_000_000
CODECS = {0: "uncompressed", **{k: "snappy" for k in (1, 2, 3)}, **{k: "zstd" for k in (4, 5, 6, 7, 8, 9)}}


class Files:
    """The few file operations that are needed, on any of Hadoop's file systems."""

    def __init__(self, spark: SparkSession):
        self.spark, self.jvm, self.conf = spark, spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def is_dir(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p) and fs.getFileStatus(p).isDirectory()

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def make(self, path: str) -> None:
        fs, p = self._at(path)
        fs.mkdirs(p)

    def rename(self, old: str, new: str) -> None:
        fs, p = self._at(old)
        if not fs.rename(p, self.jvm.org.apache.hadoop.fs.Path(new)):
            raise OSError(f"{old} was not renamed to {new}")

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        s = fs.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(s, "UTF-8")
        finally:
            s.close()

    def write(self, path: str, text: str) -> None:
        """Written beside its place and renamed into it, so that it is there as a whole or not at all."""
        fs, p = self._at(path)
        aside = f"{path}.{uuid.uuid4().hex}"
        s = fs.create(self.jvm.org.apache.hadoop.fs.Path(aside), True)
        try:
            s.write(bytearray(text.encode()))
        finally:
            s.close()
        if fs.exists(p):
            fs.delete(p, False)
        self.rename(aside, path)


def normal_name(name: str) -> str:
    """An array's name below a folder: leading slashes are one; the empty name is an error."""
    if not isinstance(name, str) or not name:
        raise ValueError("an array needs a name")
    return "/" + name.lstrip("/")


def to_chunks(x: GridArray, chunkdim: Sequence[int]) -> DataFrame:
    """Chunks of a dense array. The chunk is the unit of the shuffle; each holds at most its extents' cells."""
    n = x.meta.rank
    ids = [F.floor((F.col(f"i{k + 1}") - 1) / chunkdim[k]).cast("int").alias(f"c{k + 1}") for k in range(n)]
    where, step = F.lit(0).cast("long"), F.lit(1).cast("long")
    for k in range(n):
        ext = F.least(F.lit(chunkdim[k]), F.lit(x.dim[k]) - F.col(f"c{k + 1}") * chunkdim[k])
        where, step = where + ((F.col(f"i{k + 1}") - 1) % chunkdim[k]) * step, step * ext
    rows = x.cells.select(*ids, *x.meta.axes, "val").withColumn("_p", where)
    keys = [f"c{k + 1}" for k in range(n)]
    packed = rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "val"))), lambda s: s["val"]).alias("vals"))
    off = F.array(*[F.col(c).cast("long") * chunkdim[k] for k, c in enumerate(keys)])
    ext = F.array(*[F.least(F.lit(chunkdim[k]).cast("long"), F.lit(x.dim[k]).cast("long") - F.col(c).cast("long") * chunkdim[k]).cast("int") for k, c in enumerate(keys)])
    return packed.select(*keys, off.alias("off"), ext.alias("ext"), "vals")


def write_array(
    x: GridArray, path: str, chunkdim: Sequence[int | None] | int | None = None, level: int = 6, as_sparse: bool | None = None, with_labels: bool = True, replace_old: bool = False
) -> GridArray:
    """Write the array and open it where it now is. None in chunkdim: the whole extent; chunkdim 0: one chunk, for arrays of ONE_CHUNK cells at most."""
    spark, files = x.cells.sparkSession, Files(x.cells.sparkSession)
    if level not in CODECS:
        raise ValueError(f"compression level {level}: 0 to 9")
    if files.exists(f"{path}/_array.json") and not replace_old:
        raise FileExistsError(path)
    sparse = x.is_sparse if as_sparse is None else as_sparse
    writer = lambda df: df.write.option("compression", CODECS[level])
    version = uuid.uuid4().hex
    data, names = f"data-{version}", f"dimnames-{version}"
    if sparse:
        axis = "i1" if x.meta.layout == "csr" else f"i{x.meta.rank}"
        rest = [a for a in x.meta.axes if a != axis]
        cells = x.cells.where(is_nonzero(F.col("val"), x.type)).select(*x.meta.axes, "val")
        writer(cells.repartitionByRange(axis, *rest).sortWithinPartitions(axis, *rest)).parquet(f"{path}/{data}")
        layout = x.meta.layout if x.meta.layout in ("csc", "csr") else "csc" if x.meta.rank == 2 else "dense"
        meta = replace(x.meta, is_sparse=True, layout=layout, chunkdim=None)
    else:
        x = densify(x)
        if chunkdim == 0:
            if x.meta.length > ONE_CHUNK:
                raise ValueError(f"{x.meta.length} cells; one chunk may have {ONE_CHUNK}")
            shape = tuple(max(1, d) for d in x.dim)
        elif chunkdim is None:
            shape = x.meta.chunkdim or chunk_shape(x.dim)
        else:
            shape = tuple(max(1, d) if c is None else c for c, d in zip(chunkdim, x.dim, strict=True))
            if any(c < 1 or c > max(1, d) for c, d in zip(shape, x.dim, strict=True)):
                raise ValueError(f"chunks {shape} of extents {x.dim}")
        keys = [f"c{k + 1}" for k in range(x.meta.rank)]
        chunks = to_chunks(x, shape)
        writer(chunks.repartitionByRange(*reversed(keys)).sortWithinPartitions(*reversed(keys))).parquet(f"{path}/{data}")
        meta = replace(x.meta, is_sparse=False, layout="dense", chunkdim=shape)
    with_labels = with_labels and x.labels is not None
    if with_labels:
        writer(x.labels.select("axis", "pos", "label")).parquet(f"{path}/{names}")
    publish(files, path, replace(meta, data=(data,), labels=names if with_labels else None))
    return open_array(spark, path)


def publish(files: Files, path: str, meta: ArrayMeta) -> None:
    """Write the manifest, and delete what only an older one named."""
    files.write(f"{path}/_array.json", meta.to_json())
    for name in files.names(path):
        if name not in (*meta.data, meta.labels) and name.startswith(("data", "dimnames")):
            files.delete(f"{path}/{name}")


@dataclass(frozen=True)
class StoredArray:
    """An array in a folder: its metadata, and its data as a frame that no one has read."""

    spark: SparkSession
    path: str
    meta: ArrayMeta

    @property
    def data(self) -> DataFrame:
        n, kind = self.meta.rank, TYPES[self.meta.type]
        if self.meta.is_sparse:
            schema = ", ".join(f"i{k + 1} long" for k in range(n)) + f", val {kind}"
        else:
            schema = ", ".join(f"c{k + 1} int" for k in range(n)) + f", off array<bigint>, ext array<int>, vals array<{kind}>"
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{d}" for d in self.meta.data])

    @property
    def labels(self) -> DataFrame | None:
        if self.meta.labels is None or not Files(self.spark).exists(f"{self.path}/{self.meta.labels}"):
            return None
        return self.spark.read.schema("axis int, pos long, label string").parquet(f"{self.path}/{self.meta.labels}")

    def array(self) -> GridArray:
        cells = self.data if self.meta.is_sparse else cells_of_chunks(self.data, self.meta.rank)
        if self.meta.type == "character" and self.meta.as_na:
            cells = cells.withColumn("val", F.nullif("val", F.lit("NA")))
        return GridArray(self.meta, cells, self.labels)

    def select(self, index: Sequence[Positions], counts: Sequence[Positions] | None = None) -> GridArray:
        """A selection that reads only the chunks it touches."""
        counts = counts or [None] * self.meta.rank
        x = self.array()
        if not self.meta.is_sparse:
            chunks = self.meta.chunkdim or self.meta.dim
            plans = [plan_axis(d, c, p, k) for d, c, p, k in zip(self.meta.dim, chunks, index, counts, strict=True)]
            x = replace(x, cells=cells_of_chunks(chunk_filter(self.data, plans), self.meta.rank))
        return select(x, index, counts)


def stored(spark: SparkSession, path: str) -> StoredArray:
    files = Files(spark)
    if not files.exists(f"{path}/_array.json"):
        raise FileNotFoundError(f"{path}: no array")
    return StoredArray(spark, path, ArrayMeta.from_json(files.read(f"{path}/_array.json")))


def open_array(spark: SparkSession, path: str, as_sparse: bool | None = None, kind: str | None = None) -> GridArray:
    """The array at path; as_sparse takes a dense one by its nonzero cells, kind casts after reading."""
    x = stored(spark, path).array()
    if as_sparse:
        x = x.as_sparse()
    return x if kind is None else x.cast(kind)


def describe(spark: SparkSession, path: str) -> DataFrame:
    m = stored(spark, path).meta
    row = [(path, m.type, TYPES[m.type], list(m.dim), None if m.chunkdim is None else list(m.chunkdim), m.layout, m.is_sparse, m.as_na, m.format_version)]
    return spark.createDataFrame(row, "path string, type string, spark_type string, dim array<bigint>, chunkdim array<bigint>, layout string, is_sparse boolean, as_na boolean, format_version int")


def list_arrays(spark: SparkSession, root: str, recursive: bool = True, details: bool = False) -> DataFrame:
    """(name, kind): groups and arrays below a folder; with details also type, dim, chunkdim and is_sparse of arrays."""
    files, rows, todo = Files(spark), [], [""]
    while todo:
        at = todo.pop()
        for name in files.names(f"{root}{at}"):
            full = f"{at}/{name}"
            kind = probe(spark, f"{root}{full}")
            if kind == "array":
                m = stored(spark, f"{root}{full}").meta
                rows.append((full, kind, m.type, list(m.dim), None if m.chunkdim is None else list(m.chunkdim), m.is_sparse))
            elif kind == "group":
                rows.append((full, kind, None, None, None, None))
                todo += [full] * recursive
    out = spark.createDataFrame(rows, "name string, kind string, type string, dim array<bigint>, chunkdim array<bigint>, is_sparse boolean")
    return out if details else out.select("name", "kind")


def same_geometry(x: StoredArray, what: str) -> str | None:
    """None if the manifest fits the data, else what does not."""
    if x.meta.is_sparse:
        top = x.data.agg(*[F.max(a).alias(a) for a in x.meta.axes], *[F.min(a).alias(f"{a}_lo") for a in x.meta.axes]).first()
        bad = any(top[a] is not None and (top[a] > d or top[f"{a}_lo"] < 1) for a, d in zip(x.meta.axes, x.meta.dim, strict=True))
    else:
        ends = [F.max(F.get("off", F.lit(k)) + F.get("ext", F.lit(k))).alias(f"e{k}") for k in range(x.meta.rank)]
        got = x.data.agg(*ends, F.sum(F.size("vals")).alias("n")).first()
        bad = (got.n or 0) != x.meta.length or x.meta.length > 0 and any(got[f"e{k}"] != d for k, d in enumerate(x.meta.dim))
    return f"{what}: the data have not the extents {x.meta.dim}" if bad else None


def probe(spark: SparkSession, path: str) -> str | None:
    """What is at path: ``array``, ``group`` (another folder), or None."""
    files = Files(spark)
    return "array" if files.exists(f"{path}/_array.json") else "group" if files.is_dir(path) else None


def first_value(x: StoredArray) -> object:
    """The value of the first cell (a zero that is not stored is None)."""
    got = x.select([[1]] * x.meta.rank).cells.first() if x.meta.length else None
    return None if got is None else got["val"]


def move(x: StoredArray, path: str) -> StoredArray:
    """The handle at another place, which must hold an array of the same extents and, if dense, the same first value."""
    y = stored(x.spark, path)
    if y.meta.dim != x.meta.dim:
        raise ValueError(f"{path} has extents {y.meta.dim}, not {x.meta.dim}")
    if x.meta.is_sparse:
        if path.rstrip("/") != x.path.rstrip("/"):
            raise ValueError("a sparse array stays where it is")
        return x
    a, b = first_value(x), first_value(y)
    if a != b and not (a != a and b != b):
        raise ValueError(f"the array at {path} begins with {b!r}, not {a!r}")
    return y


def _appended(x: GridArray, old: StoredArray, axis: int) -> None:
    """Cells that continue old along an axis: a data folder more, which readers see with the manifest that names it."""
    files, name = Files(old.spark), f"data-{uuid.uuid4().hex}"
    moved = x.cells.withColumn(f"i{axis}", F.col(f"i{axis}") + F.lit(old.meta.dim[axis - 1])).withColumn("val", F.col("val").cast(TYPES[old.meta.type]))
    moved.select(*old.meta.axes, "val").sortWithinPartitions(*reversed(old.meta.axes)).write.parquet(f"{old.path}/{name}")
    dim = tuple(d + x.dim[k] if k == axis - 1 else d for k, d in enumerate(old.meta.dim))
    publish(files, old.path, replace(old.meta, dim=dim, data=(*old.meta.data, name)))


def append_columns(x: GridArray, path: str) -> None:
    """Add full columns to a sparse matrix at path, right behind those it has."""
    old = stored(x.cells.sparkSession, path)
    if not old.meta.is_sparse or old.meta.layout != "csc" or x.dim[0] != old.meta.dim[0]:
        raise ValueError("only full columns go behind a matrix by columns")
    _appended(x.as_sparse(), old, 2)


def append_values(x: GridArray, path: str) -> None:
    """Add values behind those of a one-dimensional array at path; a dense one gets chunks of its own size from where it ends."""
    spark = x.cells.sparkSession
    old = stored(spark, path)
    if old.meta.rank != 1 or x.meta.rank != 1:
        raise ValueError("values go behind those of one axis")
    if old.meta.is_sparse:
        _appended(x.as_sparse(), old, 1)
        return
    whole = densify(x)
    chunk = (old.meta.chunkdim or (CHUNK_LENGTH,))[0]
    held, n = old.meta.dim[0], old.meta.dim[0] + x.dim[0]
    # The chunk that the old values end in, if they do not fill it, is written anew with what it now holds.
    full = held // chunk
    rest = old.array().cells.where(F.col("i1") > full * chunk) if held % chunk else None
    cells = whole.cells.select((F.col("i1") + held).alias("i1"), F.col("val").cast(TYPES[old.meta.type]).alias("val"))
    cells = cells if rest is None else rest.unionByName(cells)
    name = f"data-{uuid.uuid4().hex}"
    chunks = to_chunks(GridArray(replace(old.meta, dim=(n,)), cells), (chunk,))
    if rest is not None:
        chunks = old.data.where(F.col("c1") < full).unionByName(chunks)
    chunks.write.parquet(f"{path}/{name}")
    publish(Files(spark), path, replace(old.meta, dim=(n,), data=(name,) if rest is not None else (*old.meta.data, name)))


def dense_from_rows(df: DataFrame, row: str, values: str, width: int, rows: int, kind: str = "double") -> GridArray:
    """A matrix of rows that are arrays: row is the 1-based position."""
    cells = df.select(F.col(row).cast("long").alias("i1"), F.posexplode(values).alias("_p", "_v")).select("i1", (F.col("_p") + 1).cast("long").alias("i2"), F.col("_v").cast(TYPES[kind]).alias("val"))
    return GridArray(ArrayMeta((rows, width), kind), cells)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


