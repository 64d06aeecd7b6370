"""What larger tables asked for: each test fails with the code before it."""

import numpy as np
import pytest

from gridloom.model import ArrayMeta, GridArray
from gridloom.operators import compute, select, sparse


def stored_cells(spark, dim, rows, kind="double"):
    names = ", ".join(f"i{k + 1} long" for k in range(len(dim)))
    return GridArray(ArrayMeta(dim, kind, is_sparse=True), spark.createDataFrame(rows, f"{names}, val {kind}"))


@pytest.mark.parametrize("dim", [(3, 5), (7, 1), (2, 3, 4)])
def test_dense_in_strips(spark, dim, monkeypatch):
    monkeypatch.setattr(select, "STRIP", 4)
    rng = np.random.default_rng(len(dim))
    at = [tuple(int(k) for k in a) for a in np.argwhere(rng.random(dim) < 0.4)]
    rows = [(*(k + 1 for k in a), None if n == 1 else float(n + 1)) for n, a in enumerate(at)]
    got = select.densify(stored_cells(spark, dim, rows))
    held = {r[:-1]: r[-1] for r in rows}
    found = [tuple(r) for r in got.cells.collect()]
    assert not got.is_sparse and sorted(r[:-1] for r in found) == sorted(tuple(int(k) + 1 for k in a) for a in np.ndindex(*dim))
    assert all(r[-1] == held.get(r[:-1], 0.0) for r in found)


def test_dense_beyond_two_thousand_million_cells(spark):
    x = stored_cells(spark, (60_000, 50_000), [(60_000, 50_000, 2.0), (1, 1, 3.0)])
    full = select.densify(x)
    assert full.meta.length == 3_000_000_000 and "SortMergeJoin" not in full.cells._jdf.queryExecution().toString()
    with pytest.raises(ValueError):
        select.densify(x, limit=10)


def test_files_of_a_dense_array_are_small(spark, tmp_path):
    full = select.densify(stored_cells(spark, (300_000, 20), [(300_000, 20, 2.0), (1, 1, 3.0), (150_000, 7, None)]))
    full.cells.write.parquet(f"{tmp_path}/full")
    files = [f.stat().st_size for f in (tmp_path / "full").glob("*.parquet")]
    assert sum(files) < 0.7 * full.meta.length  # positions of a band as long as the axis took four bytes a cell
    back = spark.read.parquet(f"{tmp_path}/full")
    assert back.count() == back.select("i1", "i2").distinct().count() == full.meta.length
    assert sorted(map(tuple, back.where("val is null or val <> 0").collect())) == [(1, 1, 3.0), (150_000, 7, None), (300_000, 20, 2.0)]


def test_blocks_without_frames(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)  # blocks that go over batches
    rows = [(i, j, None if (i, j) == (1, 1) else float(10 * i + j)) for i in range(1, 8) for j in range(1, 6) if (i + j) % 4]
    x = stored_cells(spark, (7, 5), rows)
    f = lambda at, cells: [(*at, len(cells["val"]), int(cells["missing"].sum()), float(np.nansum(cells["val"])), int(cells["i1"].max()))]
    out = compute.block_apply(x, f, "bi long, bj long, n long, missing long, s double, top long", [3, 2], plain=True)
    want = {}
    for i, j, v in rows:
        n, missing, s, top = want.get(((i - 1) // 3, (j - 1) // 2), (0, 0, 0.0, 0))
        want[(i - 1) // 3, (j - 1) // 2] = n + 1, missing + (v is None), s + (v or 0.0), max(top, (i - 1) % 3 + 1)
    try:
        assert {(r.bi, r.bj): tuple(r)[2:] for r in out.collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_many_small_blocks_are_shared_out(spark):
    x = stored_cells(spark, (1000, 10), [(i, 1, 1.0) for i in range(1, 1001)])
    out = compute.block_apply(x, lambda at, cells: [(at[0], len(cells["val"]))], "b long, n long", [1, 1], plain=True)
    assert out.rdd.getNumPartitions() == 4 and sorted(map(tuple, out.collect())) == [(k, 1) for k in range(1000)]


def test_sum_of_no_stored_value_is_missing(spark):
    x = stored_cells(spark, (4, 4), [(1, 1, 2.0), (2, 2, None)])
    assert compute.summarize(x, "sum", [[3], [4]], stored=True).first()[0] is None
    assert compute.summarize(x, "sum", [[1], [1]], stored=True).first()[0] == 2.0
    assert compute.summarize(x, "sum", [[3], [4]]).first()[0] == 0.0


def test_products_are_not_shuffled(spark):
    rng = np.random.default_rng(3)
    a = np.where(rng.random((9, 40)) < 0.5, rng.integers(-3, 70_000, (9, 40)), 0).astype(float)
    a[2, 3], a[4] = 0.25, np.where(a[4] != 0, 7.0, 0.0)
    x = stored_cells(spark, a.shape, [(int(i) + 1, int(j) + 1, float(a[i, j])) for i, j in np.argwhere(a)])
    out = compute.matmul(sparse.transpose(x), x)
    want = a.T @ a
    got = {(r.i1, r.i2): r.val for r in out.cells.collect()}
    assert got == {(int(i) + 1, int(j) + 1): want[i, j] for i, j in np.argwhere((a != 0).astype(int).T @ (a != 0).astype(int))}
    plan = out.cells._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(i1" in plan and not [line for line in plan.splitlines() if "Exchange hashpartitioning(i1" in line and "i2" in line.split("hashpartitioning(i1")[1]]


def _same_cells(got, want):
    got, want = ({(r.i1, r.i2): r.val for r in z.collect()} for z in (got, want))
    assert got.keys() == want.keys() and all((got[k] is None) == (v is None) and (v is None or np.isclose(got[k], v, equal_nan=True)) for k, v in want.items())


@pytest.mark.parametrize("row_values", [1 << 14, 3])
def test_crossprod(spark, row_values, monkeypatch):
    monkeypatch.setattr(compute, "ROW_VALUES", row_values)  # longer rows are left to matmul
    rng = np.random.default_rng(8)
    wide = [1, 2, 5, 70_000, 70_001, 200_000, 200_001, 5_000_000_000]
    rows = [(int(i), wide[j], [float(rng.integers(-100, 100)), float(rng.random()), None, float("nan"), 300.0][rng.choice(5, p=[0.75, 0.1, 0.05, 0.05, 0.05])]) for i in range(1, 31) for j in np.flatnonzero(rng.random(len(wide)) < 0.3)]
    x = stored_cells(spark, (40, 5_000_000_000), rows)
    out, want = compute.crossprod(x), compute.matmul(sparse.transpose(x), x)
    assert out.meta == want.meta
    _same_cells(out.cells, want.cells)
    assert not compute.crossprod(stored_cells(spark, (4, 5), [(1, 1, 1.0)]).with_cells(x.cells.where("false"))).cells.collect()


def test_crossprod_moves_half_of_the_products(spark):
    plan = compute.crossprod(stored_cells(spark, (9, 50_000), [(9, 50_000, 2.0), (1, 1, 3.0)])).cells._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "SortMergeJoin" not in plan
    rows = [(i, j, float(j)) for i in range(1, 6) for j in range(1, 2 + 3 * i)]
    ends = compute._row_ends(spark.createDataFrame(rows, "i1 long, i2 long, v double")).toArrow()
    assert sum(len(g) for g in ends["_g2"].to_pylist()) == sum(len(v) for v in ends["_v1"].to_pylist()) == sum((1 + 3 * i) * (2 + 3 * i) // 2 for i in range(1, 6))


def test_crossprod_holds_few_cells(spark, monkeypatch):
    monkeypatch.setattr(compute, "TASK_HALVES", 8)
    rng = np.random.default_rng(9)
    a = np.where(rng.random((30, 25)) < 0.5, rng.integers(1, 50, (30, 25)), 0).astype(float)
    rows = [(int(i) + 1, int(j) + 1, float(a[i, j])) for i, j in np.argwhere(a)]
    ends = compute._row_ends(spark.createDataFrame(rows, "i1 long, i2 long, v double")).orderBy("i1")
    ends = ends.selectExpr("i1", "_g2", "array() :: array<bigint> as _g8", "_v1", "array() :: array<double> as _v8").toArrow().combine_chunks()
    halves = [list(compute._summed_ends(m)(iter(ends.to_batches(max_chunksize=40)))) for m in (False, True)]
    cells = [r for h in halves for b in h for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    want = a.T @ a
    assert len(halves[0]) > 5 and len(cells) == np.count_nonzero(want) and all(want[i - 1, j - 1] == v for i, j, v in cells)


def test_local_arrays_come_as_runs(spark):
    a = np.arange(6000.0).reshape(60, 100)
    for order in ("C", "F"):
        rows = sorted(((i + 1, j + 1, float(a[i, j])) for i in range(60) for j in range(100)), key=lambda r: r[:2] if order == "C" else r[1::-1])
        x = GridArray(ArrayMeta(a.shape), spark.createDataFrame(rows, "i1 long, i2 long, val double").coalesce(1))
        assert (select.as_array(x) == a).all()
        runs = x.cells.mapInArrow(select._runs_of_cells(x.meta.axes, x.dim), "by_rows boolean, at long, vals array<double>").collect()
        assert len(runs) == 1 and runs[0].by_rows == (order == "C")
    x = GridArray(ArrayMeta((2, 2), "character"), spark.createDataFrame([(2, 1, None), (1, 2, "b"), (1, 1, "a"), (2, 2, "")], "i1 long, i2 long, val string"))
    assert select.as_array(x).tolist() == [["a", "b"], [None, ""]]


def test_many_lines_are_dealt_before_they_are_summed(spark, tmp_path, monkeypatch):
    from gridloom.sources import tables

    monkeypatch.setattr(tables, "FEW_LINES", 10)
    monkeypatch.setattr(tables, "TASK_LINES", 10)
    spark.range(20).selectExpr("id as p_partkey", "'p' as p_name").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(5).selectExpr("id as s_suppkey", "'s' as s_name").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(100).selectExpr("id % 20 as l_partkey", "id % 5 as l_suppkey", "double(id) as l_quantity").write.parquet(f"{tmp_path}/lineitem.parquet")
    x = tables.lines_matrix(spark, str(tmp_path))
    assert x.cells.rdd.getNumPartitions() == 10
    assert {(r.i1, r.i2): r.val for r in x.cells.collect()} == {(p + 1, p % 5 + 1): 5.0 * p + 200 for p in range(20)}
