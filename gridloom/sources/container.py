"""Experiments of several arrays with row and column data, in one folder that can be moved.

    <dir>/<prefix>experiment.json            the shell: assays with relative links, and operations not yet carried out
    <dir>/<prefix>assay001-<id>/ ...         one array an assay, without labels
    <dir>/<prefix>rowdata-<id>/, coldata-..  Parquet

A version is there once the shell names it; what only the shell before named is deleted after that.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.model import GridArray
from gridloom.operators.select import select
from gridloom.sources.store import Files, open_array, same_geometry, stored, write_array


@dataclass(frozen=True)
class Experiment:
    assays: dict[str, GridArray]
    rowdata: DataFrame | None = None  # pos and more
    coldata: DataFrame | None = None
    home: tuple[str, str] | None = None  # folder and prefix it was loaded from
    index: tuple[tuple[int, ...] | None, tuple[int, ...] | None] = field(default=(None, None))  # what was selected since

    def subset(self, rows: Sequence[int] | None = None, cols: Sequence[int] | None = None) -> Experiment:
        """Selected rows and columns; nothing is read."""

        def chain(old: tuple[int, ...] | None, new: Sequence[int] | None) -> tuple[int, ...] | None:
            return old if new is None else tuple(new) if old is None else tuple(old[k - 1] for k in new)

        def pick(df: DataFrame | None, at: Sequence[int] | None) -> DataFrame | None:
            if df is None or at is None:
                return df
            wanted = df.sparkSession.createDataFrame([(p, k) for k, p in enumerate(at, 1)], "pos long, _ord long")
            return df.join(wanted, "pos").withColumn("pos", F.col("_ord")).drop("_ord")

        assays = {k: select(a, [rows, cols]) for k, a in self.assays.items()}
        return replace(self, assays=assays, rowdata=pick(self.rowdata, rows), coldata=pick(self.coldata, cols), index=(chain(self.index[0], rows), chain(self.index[1], cols)))


def check_folder(spark: SparkSession, folder: str, prefix: str = "", replace_old: bool = False) -> None:
    """Whether an experiment may be written: without a prefix the folder must be new, with one the shell must be, or be replaced."""
    files = Files(spark)
    if not replace_old and (files.exists(f"{folder}/{prefix}experiment.json") or not prefix and files.exists(folder)):
        raise FileExistsError(f"{folder}/{prefix}experiment.json")


def short_link(path: str, folder: str) -> str:
    """An array's path as seen from its experiment's folder."""
    return path.removeprefix(f"{folder}/")


def full_link(link: str, folder: str) -> str:
    return link if link.startswith("/") or ":" in link else f"{folder}/{link}"


def write_assays(x: Experiment, folder: str, prefix: str = "", chunkdim: Sequence[int | None] | int | None = None, level: int = 6, as_sparse: bool | None = None) -> dict[str, str]:
    """Write each assay as an array without labels; returns the short links."""
    links = {}
    for k, (name, a) in enumerate(x.assays.items(), 1):
        path = f"{folder}/{prefix}assay{k:03d}-{uuid.uuid4().hex}"
        write_array(a, path, chunkdim, level, as_sparse, with_labels=False)
        links[name] = short_link(path, folder)
    return links


def _write_data(x: Experiment, folder: str, prefix: str) -> dict[str, str | None]:
    links: dict[str, str | None] = {}
    for name, df in (("rowdata", x.rowdata), ("coldata", x.coldata)):
        links[name] = None if df is None else f"{prefix}{name}-{uuid.uuid4().hex}"
        if df is not None:
            df.write.parquet(f"{folder}/{links[name]}")
    return links


def _published(spark: SparkSession, folder: str, prefix: str, assays: dict[str, str], data: dict[str, str | None], index: tuple) -> Experiment:
    """Write the shell, delete what only the one before named, and load."""
    files, at = Files(spark), f"{folder}/{prefix}experiment.json"
    old = json.loads(files.read(at)) if files.exists(at) else {"assays": {}}
    files.write(at, json.dumps({"format_version": 2, "assays": assays, **data, "index": index}))
    for link in (*old["assays"].values(), old.get("rowdata"), old.get("coldata")):
        if isinstance(link, str) and link not in (*assays.values(), *data.values()):
            files.delete(full_link(link, folder))
    return load(spark, folder, prefix)


def save(x: Experiment, folder: str, prefix: str = "", replace_old: bool = False, chunkdim: Sequence[int | None] | int | None = None, level: int = 6, as_sparse: bool | None = None) -> Experiment:
    """Write everything. An experiment that is there already is an error, or is replaced when the new one is whole."""
    spark = next(iter(x.assays.values())).cells.sparkSession
    if len({a.dim for a in x.assays.values()}) > 1:
        raise ValueError("assays of different extents")
    check_folder(spark, folder, prefix, replace_old)
    if x.home and x.home[0] == folder and not prefix:
        raise ValueError("an experiment cannot replace the folder that it reads")
    Files(spark).make(folder)
    return _published(spark, folder, prefix, write_assays(x, folder, prefix, chunkdim, level, as_sparse), _write_data(x, folder, prefix), (None, None))


def load(spark: SparkSession, folder: str, prefix: str = "", check_data: bool = False) -> Experiment:
    """The experiment in a folder; extents are compared by the manifests, with check_data also by a scan of all data."""
    files, at = Files(spark), f"{folder}/{prefix}"
    try:
        shell = json.loads(files.read(f"{at}experiment.json"))
        assays = {}
        for name, link in shell["assays"].items():
            path = full_link(link, folder)
            x = stored(spark, path)
            if problem := same_geometry(x, name) if check_data else None:
                raise ValueError(problem)
            if assays and x.meta.dim != next(iter(assays.values())).dim:
                raise ValueError(f"{name} has other extents")
            assays[name] = open_array(spark, path)
        data = [spark.read.parquet(f"{folder}/{shell[k]}") if shell[k] else None for k in ("rowdata", "coldata")]
    except Exception as e:
        raise ValueError(f"{folder}: no experiment with prefix {prefix!r} was saved here, or it is damaged ({e})") from e
    index = [None if k is None else tuple(k) for k in shell["index"]]
    return Experiment({k: select(a, index) if any(i is not None for i in index) else a for k, a in assays.items()}, *data, (folder, prefix), tuple(index))


def quick_resave(x: Experiment) -> Experiment:
    """Write the shell anew: selections are kept as what they are, and no array is written. Only for what was loaded from one folder."""
    if x.home is None:
        raise ValueError("the experiment was not loaded from a folder")
    folder, prefix = x.home
    spark = next(iter(x.assays.values())).cells.sparkSession
    links = json.loads(Files(spark).read(f"{folder}/{prefix}experiment.json"))["assays"]
    if set(x.assays) - set(links):
        raise ValueError("an assay has no array in the folder")
    return _published(spark, folder, prefix, {k: links[k] for k in x.assays}, _write_data(x, folder, prefix), x.index)
