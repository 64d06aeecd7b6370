"""What an array is here: a small record of metadata and a lazy table.

Sparse arrays are tables of cells ``(i1, ..., in, val)`` with 1-based positions; a cell that has no row is zero. Dense arrays are
tables of chunks ``(c1, ..., cn, off, ext, vals)`` with values in column-major order, or cells of which none is missing.
NULL is a missing value (NA), NaN is itself, and neither is a zero.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: In-memory types of arrays and the Spark types that hold them.
TYPES = {"logical": "boolean", "integer": "int", "long": "bigint", "double": "double", "character": "string", "raw": "smallint", "complex": "struct<re:double,im:double>"}
FORMAT_VERSION = 2


class UnsupportedTypeError(TypeError):
    """A stored type that arrays cannot have."""


@dataclass(frozen=True)
class ArrayMeta:
    dim: tuple[int, ...]
    type: str = "double"
    chunkdim: tuple[int, ...] | None = None
    is_sparse: bool = False
    layout: str = "dense"  # dense, csc or csr
    as_na: bool = False
    axis_labels: tuple[str | None, ...] | None = None
    first_val: object = None
    #: Folders of a stored array's data, and of its labels, below its own.
    data: tuple[str, ...] = ("data",)
    labels: str | None = "dimnames"
    format_version: int = FORMAT_VERSION

    def __post_init__(self) -> None:
        if not self.dim or any(d < 0 for d in self.dim):
            raise ValueError(f"extents {self.dim}")
        if self.type not in TYPES:
            raise UnsupportedTypeError(f"type {self.type!r}: an array has one of {', '.join(TYPES)}")
        if self.chunkdim is not None:
            if len(self.chunkdim) != len(self.dim) or any(c < 1 and d > 0 for c, d in zip(self.chunkdim, self.dim, strict=True)):
                raise ValueError(f"chunks {self.chunkdim} of extents {self.dim}")
            object.__setattr__(self, "chunkdim", tuple(min(c, max(d, 1)) for c, d in zip(self.chunkdim, self.dim, strict=True)))
        if self.layout not in ("dense", "csc", "csr"):
            raise ValueError(f"layout {self.layout!r}")

    @property
    def rank(self) -> int:
        return len(self.dim)

    @property
    def length(self) -> int:
        return math.prod(self.dim)

    @property
    def axes(self) -> list[str]:
        return [f"i{k + 1}" for k in range(self.rank)]

    def to_json(self) -> str:
        return json.dumps(asdict(self), default=str)

    @classmethod
    def from_json(cls, text: str) -> ArrayMeta:
        d = upgraded(json.loads(text))
        for k in ("dim", "chunkdim", "axis_labels", "data"):
            d[k] = None if d.get(k) is None else tuple(d[k])
        return cls(**d)


def upgraded(d: dict) -> dict:
    """A manifest of an older format as one of the present format."""
    d = dict(d)
    version = d.get("format_version", 1)
    if version > FORMAT_VERSION:
        raise ValueError(f"format {version} is newer than {FORMAT_VERSION}")
    if version < 2:  # the first format knew neither layouts nor axis labels
        d.setdefault("layout", "csc" if d.get("is_sparse") else "dense")
        d.setdefault("axis_labels", None)
    d.setdefault("data", ("data",))  # once the only place
    d.setdefault("labels", "dimnames")
    d["format_version"] = FORMAT_VERSION
    return d


def is_nonzero(val: Column, kind: str) -> Column:
    """Missing values and NaN count as nonzero; zero, FALSE and the empty string do not."""
    if kind == "logical":
        return val.isNull() | val
    if kind == "character":
        return val.isNull() | (val != "")
    if kind == "double":
        return val.isNull() | F.isnan(val) | (val != 0)
    return val.isNull() | (val != 0)


def zero_of(kind: str) -> Column:
    return {"logical": F.lit(False), "character": F.lit("")}.get(kind, F.lit(0)).cast(TYPES[kind])


@dataclass(frozen=True)
class GridArray:
    """A lazy array: metadata, its cells, and the labels of axes (axis, pos, label) if it has any."""

    meta: ArrayMeta
    cells: DataFrame
    labels: DataFrame | None = None
    #: Gives the cells whose positions are in the given runs of each axis (None: all), where a source can find those faster.
    prune: Callable[[Sequence[Sequence[tuple[int, int]] | None]], DataFrame] | None = None

    def __repr__(self) -> str:
        size = " x ".join(map(str, self.meta.dim))
        return f"<{size} {'sparse ' if self.meta.is_sparse else ''}{self.meta.type} array>"

    @property
    def dim(self) -> tuple[int, ...]:
        return self.meta.dim

    @property
    def type(self) -> str:
        return self.meta.type

    @property
    def chunkdim(self) -> tuple[int, ...] | None:
        """Dense: as stored. By columns: one whole column; by rows: one whole row."""
        if self.meta.layout == "csc":
            return (self.dim[0], min(self.dim[1], 1))
        if self.meta.layout == "csr":
            return (min(self.dim[0], 1), self.dim[1])
        return self.meta.chunkdim

    @property
    def is_sparse(self) -> bool:
        return self.meta.is_sparse

    def with_cells(self, cells: DataFrame, **changes: object) -> GridArray:
        return GridArray(replace(self.meta, **changes), cells, self.labels)

    def with_labels(self, labels: DataFrame | Sequence[Sequence[str] | None] | None) -> GridArray:
        """Other labels (axis, pos, label), or a list of labels an axis, or none; nothing is read or written."""
        if labels is not None and not isinstance(labels, DataFrame):
            if len(labels) != self.meta.rank or any(v is not None and len(v) != d for v, d in zip(labels, self.dim, strict=True)):
                raise ValueError(f"labels do not go with extents {self.dim}")
            rows = [(k, p, v) for k, axis in enumerate(labels, 1) if axis is not None for p, v in enumerate(axis, 1)]
            labels = self.cells.sparkSession.createDataFrame(rows, "axis int, pos long, label string")
        return replace(self, labels=labels)

    def as_sparse(self, sparse: bool = True) -> GridArray:
        """The same cells taken for those of a sparse array, zeros left out, or (of a dense one) not."""
        if self.is_sparse and not sparse:
            raise ValueError("a sparse array stays one; densify it")
        if not sparse or self.is_sparse:
            return self
        return GridArray(replace(self.meta, is_sparse=True), self.cells.where(is_nonzero(F.col("val"), self.type)), self.labels)

    def cast(self, kind: str, strict: bool = True) -> GridArray:
        """Another type; doubles are cut towards zero. Not strict: what does not fit is missing."""
        if kind == self.type:
            return self
        if kind == "integer" and self.type == "character":
            import warnings

            warnings.warn("strings are not made integers", stacklevel=2)
            return self
        to = F.col("val").cast(TYPES[kind]) if strict else F.col("val").try_cast(TYPES[kind])
        return self.with_cells(self.cells.withColumn("val", to), type=kind)


def linear_index(axes: Sequence[Column], dim: Sequence[int]) -> Column:
    """The 1-based position in column-major order."""
    total, step = F.lit(1).cast("long"), 1
    for a, d in zip(axes, dim, strict=True):
        total, step = total + (a - 1) * F.lit(step).cast("long"), step * d
    return total


def from_linear(index: Column, dim: Sequence[int]) -> list[Column]:
    rest, out = index - 1, []
    for d in dim[:-1]:
        out.append((rest % d + 1).cast("long"))
        rest = F.call_function("div", rest, F.lit(d).cast("long"))  # in whole numbers, whatever the extents
    return [*out, (rest + 1).cast("long")]
