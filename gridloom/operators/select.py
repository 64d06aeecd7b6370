"""Gathers: orthogonal selections in any order and with repeats, blocks, and chunks to cells."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.model import TYPES, ArrayMeta, GridArray, from_linear, is_nonzero, linear_index, zero_of
from gridloom.plans.selection import MAX_RUNS, AxisPlan, Positions, SelectionError, plan_axis

#: Selected positions of an axis that are sent to all executors at most; more are joined by a shuffle.
BROADCAST_POSITIONS = 1_000_000
#: Cells of a strip, the piece of an array that is made dense at once, positions of a line in it (a multiple of 8, as files pack them by 8), and about how many cells a task makes in all.
STRIP = 1 << 16
LINE = 1 << 8
TASK_CELLS = 1 << 25


def between(column: Column, runs: Sequence[tuple[int, int]]) -> Column:
    return reduce(lambda a, b: a | b, [column == s if n == 1 else column.between(s, s + n - 1) for s, n in runs], F.lit(False))


def chunk_filter(chunks: DataFrame, plans: Sequence[AxisPlan]) -> DataFrame:
    """Only touched chunks, by predicates on the stored chunk ids, so that files and row groups are skipped."""
    for k, plan in enumerate(plans):
        if plan.chunks is not None:
            few = plan.chunks if len(plan.chunks) <= MAX_RUNS else ((plan.chunks[0][0], plan.chunks[-1][0] + plan.chunks[-1][1] - plan.chunks[0][0]),)
            chunks = chunks.where(between(F.col(f"c{k + 1}"), few)) if plan.chunks else chunks.where(F.lit(False))
    return chunks


def cells_of_chunks(chunks: DataFrame, rank: int) -> DataFrame:
    """Cells of chunks (c1.., off, ext, vals), values in column-major order."""
    flat = chunks.select("off", "ext", F.posexplode("vals").alias("_p", "val"))
    rest, cols = F.col("_p").cast("long"), []
    for k in range(rank):
        e = F.col("ext")[k]
        cols.append((F.col("off")[k] + (rest % e if k < rank - 1 else rest) + 1).alias(f"i{k + 1}"))
        rest = F.floor(rest / e)
    return flat.select(*cols, "val")


def wanted_positions(spark, plan: AxisPlan) -> DataFrame:
    """(pos, _ord): the positions of a plan and their places in the selection. Runs are written out where the frame is computed."""
    if plan.order is not None:
        return spark.createDataFrame([(p, k) for k, p in enumerate(plan.order, 1)], "pos long, _ord long")
    rows, at = [], 1
    for s, n in plan.runs:
        rows.append((s, s + n - 1, at - s))
        at += n
    runs = spark.createDataFrame(rows, "a long, z long, by long")
    return runs.select(F.explode(F.sequence("a", "z")).alias("pos"), "by").select("pos", (F.col("pos") + F.col("by")).alias("_ord"))


def select(x: GridArray, index: Sequence[Positions], counts: Sequence[Positions] | None = None, method: int = 0) -> GridArray:
    """The cells at the given positions of each axis (None: all), at their places in the selection.

    method is the number of a read strategy, 0 to 7; strategies differ in speed where files are read by hand, here in nothing.
    """
    if method not in range(8):
        raise ValueError(f"method {method}")
    if len(index) != x.meta.rank:
        raise SelectionError(f"{len(index)} indices for {x.meta.rank} axes")
    counts = counts or [None] * len(index)
    plans = [plan_axis(d, None, p, c) for d, p, c in zip(x.dim, index, counts, strict=True)]
    cells = x.prune([p.runs if p.runs is not None and len(p.runs) <= MAX_RUNS else None for p in plans]) if x.prune else x.cells
    for axis, plan in zip(x.meta.axes, plans, strict=True):
        if plan.runs is None:
            continue
        if len(plan.runs) <= MAX_RUNS:
            cells = cells.where(between(F.col(axis), plan.runs))
        if plan.order is None and len(plan.runs) == 1:
            cells = cells.withColumn(axis, F.col(axis) - F.lit(plan.runs[0][0] - 1))  # one run in order: a shift
            continue
        wanted = wanted_positions(x.cells.sparkSession, plan).withColumnRenamed("pos", axis)
        cells = cells.join(F.broadcast(wanted) if plan.extent <= BROADCAST_POSITIONS else wanted, axis).withColumn(axis, F.col("_ord")).drop("_ord")
    dim = tuple(d if p.extent is None else p.extent for d, p in zip(x.dim, plans, strict=True))
    labels = x.labels
    if labels is not None:
        for k, plan in enumerate(plans):
            if plan.runs is not None:
                of_axis = labels.where(F.col("axis") == k + 1)
                if len(plan.runs) <= MAX_RUNS:
                    of_axis = of_axis.where(between(F.col("pos"), plan.runs))
                moved = of_axis.join(wanted_positions(labels.sparkSession, plan), "pos").select("axis", F.col("_ord").alias("pos"), "label")
                labels = labels.where(F.col("axis") != k + 1).union(moved)
    chunk = None if x.meta.chunkdim is None else tuple(min(c, max(d, 1)) for c, d in zip(x.meta.chunkdim, dim, strict=True))
    return GridArray(replace(x.meta, dim=dim, chunkdim=chunk, first_val=None), cells.select(*x.meta.axes, "val"), labels)


def read_block(x: GridArray, offset: Sequence[int], extent: Sequence[int]) -> GridArray:
    """A rectangular block, with positions counted from its corner (offset from 0)."""
    return select(x, [[o + 1] for o in offset], [[e] for e in extent])


def drop_axes(x: GridArray) -> GridArray:
    """Without the axes of extent one (of a single cell the first axis stays)."""
    keep = [k for k, d in enumerate(x.dim) if d != 1] or [0]
    cols = [F.col(f"i{k + 1}").alias(f"i{n}") for n, k in enumerate(keep, 1)]
    labels = None
    if x.labels is not None:
        to = F.create_map(*[F.lit(v) for n, k in enumerate(keep, 1) for v in (k + 1, n)])
        labels = x.labels.where(F.col("axis").isin([k + 1 for k in keep])).select(to[F.col("axis")].alias("axis"), "pos", "label")
    chunk = None if x.meta.chunkdim is None else tuple(x.meta.chunkdim[k] for k in keep)
    names = None if x.meta.axis_labels is None else tuple(x.meta.axis_labels[k] for k in keep)
    return GridArray(replace(x.meta, dim=tuple(x.dim[k] for k in keep), chunkdim=chunk, axis_labels=names, layout="dense" if len(keep) != 2 else x.meta.layout), x.cells.select(*cols, "val"), labels)


def densify(x: GridArray, limit: int | None = None) -> GridArray:
    """All cells, zeros included; an error if they are more than ``limit``, if one is given.

    The longest axis is cut into bands, and a band into strips of some lines; a strip's cells come line by line. Only stored values are moved, each to its
    strip; the zeros between them are written out where the strip is. A task so holds a strip at a time, and as many tasks as there are cells for share
    the work. A task has neighbouring strips: its positions are few and come in the same short order again and again, so that files of them stay small
    (a band as long as the axis takes four bytes a cell for positions alone, for positions that are all different do not compress).
    """
    if not x.is_sparse:
        return x
    spark, n = x.cells.sparkSession, x.meta.length
    if limit is not None and n > limit:
        raise ValueError(f"{n} cells; a dense result may have {limit}")
    meta = replace(x.meta, is_sparse=False, layout="dense")
    if not n:
        return GridArray(meta, x.cells.select(*x.meta.axes, "val").where(F.lit(False)), x.labels)
    long = max(range(x.meta.rank), key=lambda k: x.dim[k])
    axis, extent = x.meta.axes[long], x.dim[long]
    others = [(a, d) for k, (a, d) in enumerate(zip(x.meta.axes, x.dim, strict=True)) if k != long] or [(None, 1)]
    lines = n // extent
    band = min(extent, LINE if lines > 1 else STRIP)  # positions of a line in a strip
    deep = max(1, STRIP // band)  # lines of a strip
    across = -(-lines // deep)  # strips of a band
    strips = -(-extent // band) * across
    each = -(-strips // min(strips, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // TASK_CELLS))))  # strips of a task
    div = lambda a, b: F.call_function("div", a, F.lit(b).cast("long"))
    at, line = F.col(axis) - 1, linear_index([F.lit(1) if a is None else F.col(a) for a, _ in others], [d for _, d in others]) - 1
    value = F.struct(((line % deep) * band + at % band).cast("int").alias("p"), F.lit(True).alias("h"), F.col("val").alias("v")).alias("_c")
    held = x.cells.select((div(at, band) * across + div(line, deep)).alias("_s"), value)
    empty = spark.range(strips).select(F.col("id").alias("_s"), F.lit(None).cast(held.schema["_c"].dataType).alias("_c"))  # strips without a stored value are there too
    rows = held.unionByName(empty).withColumn("_t", div(F.col("_s"), each).cast("int")).repartitionById(-(-strips // each), "_t")
    rows = rows.groupBy("_t", "_s").agg(F.collect_list("_c").alias("_c"))
    rows = rows.select("_c", (div(F.col("_s"), across) * band).alias("_from"), (F.col("_s") % across * deep).alias("_line"))
    rows = rows.select("*", F.least(F.lit(band).cast("long"), extent - F.col("_from")).cast("int").alias("_w"), F.least(F.lit(deep).cast("long"), lines - F.col("_line")).cast("int").alias("_n"))
    # A run is a stored value, or the start of a line, with the zeros behind it up to the next one of the line.
    none = F.lit(None).cast(held.schema["_c"].dataType["v"].dataType)
    starts = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda k: F.struct((k * band).alias("p"), F.lit(False).alias("h"), none.alias("v")))
    rows = rows.select("_from", "_line", "_w", F.sort_array(F.concat(starts, "_c")).alias("_c"))
    of = lambda c: div(c["p"], band)
    ends = lambda c, k: F.when(of(F.get("_c", k + 1)) == of(c), F.get("_c", k + 1)["p"] % band).otherwise(F.col("_w"))
    runs = F.transform("_c", lambda c, k: F.struct(of(c).alias("l"), (c["p"] % band).alias("a"), ends(c, k).alias("z"), c["v"].alias("v"), c["h"].alias("h")))
    rows = rows.select("_from", "_line", F.inline(runs)).where("a < z")
    places = [c.alias(a) for (a, _), c in zip(others, from_linear(F.col("_line") + F.col("l") + 1, [d for _, d in others]), strict=True) if a is not None]
    rows = rows.select(*places, (F.col("_from") + F.col("a") + 1).alias("_a"), (F.col("_from") + F.col("z")).alias("_z"), "v", "h")
    cells = rows.select(*(a for a, _ in others if a is not None), "_a", "v", "h", F.explode(F.sequence("_a", "_z")).alias(axis))
    val = F.when(F.col("h") & (F.col(axis) == F.col("_a")), F.col("v")).otherwise(zero_of(x.type)).alias("val")  # a missing value stays missing
    return GridArray(meta, cells.select(*x.meta.axes, val), x.labels)


def sparsify(x: GridArray) -> GridArray:
    """Only nonzero cells (missing values and NaN are kept)."""
    return GridArray(replace(x.meta, is_sparse=True), x.cells.where(is_nonzero(F.col("val"), x.type)), x.labels)


def _runs_of_cells(axes: Sequence[str], dim: Sequence[int]):
    """Batches of cells to runs (by_rows, at, vals): values one behind the other from the linear position at, in the order, by rows or by columns, that has fewer runs."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            at = [b.column(a).to_numpy() - 1 for a in axes]
            found = []
            for order in "CF":
                line = np.ravel_multi_index(at, dim, order=order)
                found.append((line, np.flatnonzero(np.diff(line) != 1) + 1))
            by_rows = len(found[0][1]) <= len(found[1][1])
            line, cuts = found[0 if by_rows else 1]
            starts = np.concatenate([[0], cuts])
            vals = pa.ListArray.from_arrays(pa.array(np.append(starts, b.num_rows), pa.int32()), b.column("val"))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(starts), by_rows)), pa.array(line[starts], pa.int64()), vals], ["by_rows", "at", "vals"])

    return run


def as_array(x: GridArray, limit: int = 50_000_000):
    """The array as a local numpy array, if it has at most ``limit`` cells; missing values are None (NaN for doubles).

    Values come in runs of neighbours, so that the driver gets little more than the values themselves.
    """
    import numpy as np

    if x.meta.length > limit:
        raise ValueError(f"{x.meta.length} cells; a local array may have {limit}")
    kinds = {"double": float, "integer": np.int32, "long": np.int64, "raw": np.uint8}
    cells = x.cells.select(*(F.col(a).cast("long").alias(a) for a in x.meta.axes), "val")
    rows = cells.mapInArrow(_runs_of_cells(x.meta.axes, x.dim), f"by_rows boolean, at long, vals array<{TYPES[x.type]}>").toArrow()
    whole = x.type == "double" or x.type in kinds and not any(c.values.null_count for c in rows["vals"].chunks)
    out = np.zeros(x.dim, kinds[x.type]) if whole else np.full(x.dim, {"logical": False, "character": ""}.get(x.type, 0), object)
    for b in rows.to_batches():
        n = b.column("vals").value_lengths().to_numpy()
        line = np.repeat(b.column("at").to_numpy() - (np.cumsum(n) - n), n) + np.arange(n.sum())
        by_rows = np.repeat(b.column("by_rows").to_numpy(zero_copy_only=False), n)
        val = b.column("vals").flatten()
        val = val.to_numpy(zero_copy_only=False) if whole else np.array([*val.to_pylist(), None], object)[:-1]
        for order, of in (("C", by_rows), ("F", ~by_rows)):
            out[np.unravel_index(line[of], x.dim, order=order)] = val[of]
    return out


def positions_of(x: GridArray, axis: int, wanted: Sequence[str]) -> list[int]:
    """Positions of labels of an axis (from 1); an unknown label is an error."""
    if x.labels is None:
        raise KeyError(f"axis {axis} has no labels")
    rows = x.labels.where((F.col("axis") == axis) & F.col("label").isin(list(wanted))).groupBy("label").agg(F.min("pos").alias("pos")).collect()  # one row a label asked for
    known = {r.label: r.pos for r in rows}
    if missing := [w for w in wanted if w not in known]:
        raise KeyError(f"axis {axis} has no label {missing[0]!r}")
    return [known[w] for w in wanted]


def empty_like(meta: ArrayMeta, spark) -> DataFrame:
    return spark.createDataFrame([], ", ".join(f"{a} long" for a in meta.axes) + f", val {TYPES[meta.type]}")
