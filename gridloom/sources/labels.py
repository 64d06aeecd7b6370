"""Axis labels: written and read whole, shared between arrays by name, and names of axes."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.sources.store import Files, publish, stored, union_all

_SCHEMA = "axis int, pos long, label string"


def _check(dim: Sequence[int], labels: Sequence[Sequence[str] | None]) -> None:
    if len(labels) != len(dim):
        raise ValueError(f"labels for {len(labels)} of {len(dim)} axes")
    for k, (d, x) in enumerate(zip(dim, labels, strict=True), 1):
        if x is not None and len(x) != d:
            raise ValueError(f"{len(x)} labels on axis {k} of extent {d}")


def labels_frame(spark: SparkSession, labels: Sequence[Sequence[str] | None]) -> DataFrame:
    rows = [(k, p, None if v is None else str(v)) for k, x in enumerate(labels, 1) if x is not None for p, v in enumerate(x, 1)]
    return spark.createDataFrame(rows, _SCHEMA)


def write_labels(spark: SparkSession, path: str, labels: Sequence[Sequence[str] | None], axis_names: Sequence[str | None] | None = None) -> None:
    """Set the labels of an array that has none; all checks come before anything is written."""
    x = stored(spark, path)
    _check(x.meta.dim, labels)
    if x.labels is not None or any(v for v in scales(spark, path).values()):
        raise ValueError(f"{path} has labels")
    if axis_names is not None:
        set_axis_names(spark, path, axis_names)
    name = f"dimnames-{uuid.uuid4().hex}"
    labels_frame(spark, labels).write.parquet(f"{path}/{name}")
    publish(Files(spark), path, replace(stored(spark, path).meta, labels=name))


def read_labels(spark: SparkSession, path: str) -> DataFrame | None:
    """(axis, pos, label) or None, shared label sets included."""
    x = stored(spark, path)
    parts = [] if x.labels is None else [x.labels]
    for axis, name in scales(spark, path).items():
        if name:
            shared = spark.read.schema("pos long, label string").parquet(name)
            parts.append(shared.select(F.lit(axis).alias("axis"), "pos", "label"))
    return union_all(parts) if parts else None


def write_label_set(spark: SparkSession, path: str, labels: Sequence[str]) -> None:
    """A set of labels that arrays can share."""
    spark.createDataFrame(list(enumerate(labels, 1)), "pos long, label string").write.mode("errorifexists").parquet(path)


def _all_scales(spark: SparkSession, path: str) -> dict[str, dict[int, str]]:
    files = Files(spark)
    found = json.loads(files.read(f"{path}/_scales.json")) if files.exists(f"{path}/_scales.json") else {}
    return {k: {int(a): n for a, n in v.items()} for k, v in found.items()}


def scales(spark: SparkSession, path: str, scale: str = "") -> dict[int, str]:
    """The label set attached to each axis under a scale's name."""
    stored(spark, path)
    return _all_scales(spark, path).get(scale, {})


def is_scale(spark: SparkSession, name: str, arrays: Sequence[str]) -> bool:
    """Whether a label set is attached to an axis of one of the arrays."""
    return any(name in held.values() for path in arrays for held in _all_scales(spark, path).values())


def attach_scales(spark: SparkSession, path: str, sets: Sequence[str | None], scale: str = "", dry_run: bool = False) -> list[bool]:
    """Attach label sets to axes (None leaves an axis as it is); says which axes change. Everything is checked first; no change, no write."""
    x, files = stored(spark, path), Files(spark)
    if len(sets) != x.meta.rank:
        raise ValueError(f"{len(sets)} label sets for {x.meta.rank} axes")
    every = _all_scales(spark, path)
    now, changed = dict(every.get(scale, {})), []
    for axis, name in enumerate(sets, 1):
        changed.append(name is not None and now.get(axis) != name)
        if not changed[-1]:
            continue
        if axis in now:
            raise ValueError(f"axis {axis} has {now[axis]} already")
        if not files.exists(name):
            raise FileNotFoundError(name)
        if (n := spark.read.parquet(name).count()) != x.meta.dim[axis - 1]:
            raise ValueError(f"{name} has {n} labels, axis {axis} an extent of {x.meta.dim[axis - 1]}")
        now[axis] = name
    if any(changed) and not dry_run:
        files.write(f"{path}/_scales.json", json.dumps({**every, scale: now}))
    return changed


def axis_names(spark: SparkSession, path: str) -> tuple[str | None, ...] | None:
    """Names of the axes; None if none has one."""
    names = stored(spark, path).meta.axis_labels
    return None if names is None or not any(names) else names


def set_axis_names(spark: SparkSession, path: str, names: Sequence[str | None]) -> None:
    x = stored(spark, path)
    if len(names) != x.meta.rank:
        raise ValueError(f"{len(names)} names for {x.meta.rank} axes")
    Files(spark).write(f"{path}/_array.json", replace(x.meta, axis_labels=tuple(names)).to_json())
