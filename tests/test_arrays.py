import itertools
import math

import numpy as np
import pytest

from gridloom.functions.summaries import summary
from gridloom.model import ArrayMeta, GridArray, UnsupportedTypeError
from gridloom.operators import compute, select, shape, sparse
from gridloom.sources import compressed, container, dump, labels, sinks, store
from gridloom.streaming import append_stream, finish


def array(spark, a, kind="integer", **more):
    """A numpy array (None for missing) as cells."""
    a = np.asarray(a, object)
    rows = [(*(int(k) + 1 for k in at), None if v is None else v) for at, v in np.ndenumerate(a)]
    types = {"integer": "int", "double": "double", "logical": "boolean", "character": "string", "raw": "smallint"}
    names = ", ".join(f"i{k + 1} long" for k in range(a.ndim))
    return GridArray(ArrayMeta(a.shape, kind, **more), spark.createDataFrame(rows, f"{names}, val {types[kind]}"))


def local(x):
    out = np.full(x.dim, None, object)
    for r in x.cells.collect():
        out[tuple(p - 1 for p in r[:-1])] = r[-1]
    return out


def column_major(n, *dim):
    return np.arange(1, n + 1).reshape(dim, order="F").astype(object)


SELECTIONS = [[None, None], [[2, 3, 4, 5, 7, 8, 9, 10], None], [None, [1, 2]], [[7, 8, 9, 10], [1, 2, 5]], [[2, 3, 4, 5, 6, 6, 5, 4, 3, 1, 1, 1, 9, 8], None], [[9, 1, 1], [6, 5, 5]]]


@pytest.mark.parametrize("chunks", [(10, 6), (10, 1), (4, 5), (2, 2)])
def test_select_from_chunks(spark, tmp_path, chunks):
    a = column_major(60, 10, 6)
    store.write_array(array(spark, a), f"{tmp_path}/m", chunks)
    s = store.stored(spark, f"{tmp_path}/m")
    assert store.same_geometry(s, "m") is None and s.meta.chunkdim == chunks
    for at in SELECTIONS:
        want = a[np.ix_(*[np.arange(d) if p is None else np.array(p) - 1 for d, p in zip(a.shape, at, strict=True)])]
        got = s.select(at)
        assert got.dim == want.shape and (local(got) == want).all()
    got = s.select([[2, 5], [4]], [[3, 4], [2]])
    assert (local(got) == a[1:8, 3:5]).all()
    assert s.select([[], []]).cells.count() == 0


@pytest.mark.parametrize("kind", ["logical", "double", "character", "raw"])
def test_types_round_trip(spark, tmp_path, kind):
    a = column_major(60, 10, 6)
    a = {"logical": lambda: a % 3 == 0, "double": lambda: a * 1.5, "character": lambda: np.vectorize(str, otypes=[object])(a), "raw": lambda: a % 256}[kind]().astype(object)
    a[3, 2] = None
    got = store.write_array(array(spark, a, kind), f"{tmp_path}/m", (4, 3))
    assert got.type == kind and (local(got) == a).all()


def test_pruning_reaches_the_scan(spark, tmp_path):
    store.write_array(array(spark, column_major(60, 10, 6)), f"{tmp_path}/m", (2, 2))
    plan = store.stored(spark, f"{tmp_path}/m").select([[5, 6], None]).cells._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(c1,2)" in plan.split("PushedFilters: [")[1].split("]")[0]


def test_three_axes_reshape_bind_drop(spark):
    a = column_major(350, 10, 5, 7)
    x = array(spark, a)
    for new in ([50, 7], [10, 35], [350]):
        assert (local(shape.reshape(x, new)) == a.reshape(new, order="F")).all()
    got = shape.select_reshaped(x, [10, 35], [[10, 1, 1], [35, 2]])
    assert (local(got) == a.reshape((10, 35), order="F")[np.ix_([9, 0, 0], [34, 1])]).all()
    assert (local(select.drop_axes(select.select(x, [None, [3], [2, 1]]))) == a[:, 2, [1, 0]]).all()
    assert (local(shape.bind([x, x], 2)) == np.concatenate([a, a], 1)).all()
    assert (local(sparse.transpose(x)) == a.T).all()


def small(spark):
    rows = [(1, 1, 5.0), (3, 1, -2.0), (2, 3, 0.5), (3, 3, None), (1, 4, float("nan"))]
    return GridArray(ArrayMeta((3, 5), "double", is_sparse=True, layout="csc"), spark.createDataFrame(rows, "i1 long, i2 long, val double"))


def test_sparse(spark):
    x = small(spark)
    got = {r.ord: (r.pos, r.vals) for r in sparse.nonzero_by(x, 2, [3, 2, 3, 1]).collect()}
    assert got == {1: (3, [0.5, None]), 2: (2, []), 3: (3, [0.5, None]), 4: (1, [5.0, -2.0])}
    assert {r.pos: r.vals for r in sparse.nonzero_by(x, 1, [3, 1]).where("pos = 3").collect()} == {3: [-2.0, None]}
    assert [tuple(r) for r in sparse.pointers(x, block=2).orderBy("pos").collect()] == [(1, 0, 2), (2, 2, 0), (3, 2, 2), (4, 4, 1), (5, 5, 0)]
    assert math.isclose(sparse.sparsity(x).first()[0], 1 - 5 / 15)
    assert x.chunkdim == (3, 1) and sparse.transpose(x).chunkdim == (1, 3)
    full = local(select.densify(x))
    assert full[0, 1] == 0 and full[2, 2] is None and math.isnan(full[0, 3])
    assert select.sparsify(select.densify(x)).cells.count() == 5


def test_along_and_blocks(spark):
    x = small(spark).with_cells(small(spark).cells.where("val is not null and not isnan(val)"))
    sums = {r.pos: r.value for r in compute.along(x, 2).collect()}
    assert sums == {1: 3.0, 2: 0.0, 3: 0.5, 4: 0.0, 5: 0.0}
    means = {r.pos: r.value for r in compute.along(x, 1, "mean").collect()}
    assert means == {1: 1.0, 2: 0.1, 3: -0.4}
    assert {r.pos: r.value for r in compute.along(x, 2, "max").collect()}[2] == 0.0 and {r.pos: r.value for r in compute.along(x, 2, "min").collect()}[1] == -2.0
    import pandas as pd

    out = compute.block_apply(x, lambda k, df: pd.DataFrame({"b": [k[1]], "n": [len(df)]}), "b long, n long", [3, 2]).collect()
    assert sorted(map(tuple, out)) == [(0, 2), (1, 1)]
    prod = local(select.densify(compute.matmul(sparse.transpose(x), x)))
    a = np.array(local(select.densify(x)), float)
    assert np.allclose(prod.astype(float), a.T @ a)


def by_rules(op, values, na_rm):
    """The rules for missing values, one value at a time."""
    if na_rm:
        values = [v for v in values if v is not None and not math.isnan(v)]
    if None in values:
        return None
    if any(math.isnan(v) for v in values):
        return math.nan
    return {"min": lambda: min(values, default=math.inf), "max": lambda: max(values, default=-math.inf), "sum": lambda: sum(values), "prod": lambda: math.prod(values)}[op]()


@pytest.mark.parametrize("op", ["min", "max", "sum", "prod"])
def test_missing_values(spark, op):
    from pyspark.sql import functions as F

    lists = [c for n in range(4) for c in itertools.product([None, math.nan, -2.0, 3.0], repeat=n)]
    rows = [(k, v) for k, c in enumerate(lists) for v in (c or ("none",))]
    df = spark.createDataFrame([(k, None if v == "none" else v, v == "none") for k, v in rows], "k int, v double, gone boolean")
    for na_rm in (False, True):
        got = {r.k: r.v for r in df.where("not gone").groupBy("k").agg(summary(op, F.col("v"), "double", na_rm).alias("v")).collect()}
        got[0] = df.where("false").agg(summary(op, F.col("v"), "double", na_rm).alias("v")).first().v
        for k, c in enumerate(lists):
            want = by_rules(op, list(c), na_rm)
            assert got[k] == want or want is not None and math.isnan(want) and math.isnan(got[k]), (op, na_rm, c)


def test_any_all(spark):
    from pyspark.sql import functions as F

    for values, na_rm, any_, all_ in (([True, None], False, True, None), ([False, None], False, None, False), ([None], True, False, True), ([], False, False, True)):
        df = spark.createDataFrame([(v,) for v in values], "v boolean")
        r = df.agg(summary("any", F.col("v"), "logical", na_rm).alias("a"), summary("all", F.col("v"), "logical", na_rm).alias("b")).first()
        assert (r.a, r.b) == (any_, all_), values
    with pytest.raises(TypeError):
        summary("sum", F.col("v"), "character")
    with pytest.raises(TypeError):
        summary("any", F.col("v"), "double")


def test_store_rules(spark, tmp_path):
    x = array(spark, column_major(60, 10, 6))
    store.write_array(x, f"{tmp_path}/a", 0)
    assert store.stored(spark, f"{tmp_path}/a").meta.chunkdim == (10, 6)
    with pytest.raises(FileExistsError):
        store.write_array(x, f"{tmp_path}/a")
    with pytest.raises(ValueError):
        store.write_array(x, f"{tmp_path}/b", (11, 6))
    with pytest.raises(ValueError):
        store.write_array(x, f"{tmp_path}/b", level=10)
    with pytest.raises(FileNotFoundError):
        store.open_array(spark, f"{tmp_path}/none")
    with pytest.raises(UnsupportedTypeError):
        ArrayMeta((2, 2), "list")
    s = store.write_array(small(spark), f"{tmp_path}/s")
    store.append_columns(small(spark), f"{tmp_path}/s")
    assert store.open_array(spark, f"{tmp_path}/s").dim == (3, 10) and s.is_sparse
    assert {r.name for r in store.list_arrays(spark, str(tmp_path)).collect()} == {"/a", "/s"}
    assert store.describe(spark, f"{tmp_path}/s").first().layout == "csc"
    assert store.normal_name("//x/y") == "/x/y" and store.chunk_shape((10_000, 10_000)) == (1000, 1000)
    data = spark.createDataFrame([(0, 0, 5.0), (1, 2, -2.0), (2, 1, 0.5)], "k long, index long, value double")
    ends = lambda v: spark.createDataFrame(list(enumerate(v)), "pos long, value long")
    got = compressed.from_compressed(data, ends([0, 2, 2, 3]), (3, 3))
    assert sorted(map(tuple, got.cells.collect())) == [(1, 1, 5.0), (2, 3, 0.5), (3, 1, -2.0)]
    for wrong in ([0, 2, 3], [1, 2, 2, 3], [0, 2, 2, 4], [0, 3, 2, 3]):
        with pytest.raises(ValueError):
            compressed.from_compressed(data, ends(wrong), (3, 3))


def test_labels(spark, tmp_path):
    store.write_array(array(spark, column_major(6, 3, 2)), f"{tmp_path}/m")
    with pytest.raises(ValueError):
        labels.write_labels(spark, f"{tmp_path}/m", [["a", "b"], None])
    labels.write_labels(spark, f"{tmp_path}/m", [["a", "b", "c"], None], ["x", None])
    assert labels.axis_names(spark, f"{tmp_path}/m") == ("x", None)
    x = store.open_array(spark, f"{tmp_path}/m")
    assert select.positions_of(x, 1, ["c", "a", "c"]) == [3, 1, 3]
    with pytest.raises(KeyError):
        select.positions_of(x, 1, ["z"])
    assert sorted((r.pos, r.label) for r in select.select(x, [[3, 3, 1], None]).labels.collect()) == [(1, "c"), (2, "c"), (3, "a")]
    labels.write_label_set(spark, f"{tmp_path}/set2", ["p", "q"])
    assert labels.attach_scales(spark, f"{tmp_path}/m", [None, f"{tmp_path}/set2"], dry_run=True) == [False, True]
    assert labels.attach_scales(spark, f"{tmp_path}/m", [None, f"{tmp_path}/set2"]) == [False, True]
    assert labels.attach_scales(spark, f"{tmp_path}/m", [None, f"{tmp_path}/set2"]) == [False, False]
    with pytest.raises(ValueError):
        labels.attach_scales(spark, f"{tmp_path}/m", [f"{tmp_path}/set2", None])
    assert labels.read_labels(spark, f"{tmp_path}/m").where("axis = 2").count() == 2


def test_container(spark, tmp_path):
    x = array(spark, column_major(60, 10, 6))
    rows = spark.createDataFrame([(k, f"g{k}") for k in range(1, 11)], "pos long, name string")
    e = container.Experiment({"counts": x, "twice": compute.elementwise(x, lambda v: v * 2, "integer")}, rows)
    container.save(e, f"{tmp_path}/e")
    with pytest.raises(FileExistsError):
        container.save(e, f"{tmp_path}/e")
    (tmp_path / "e").rename(tmp_path / "moved")
    got = container.quick_resave(container.load(spark, f"{tmp_path}/moved").subset(rows=[4, 2, 2])).subset(cols=[6])
    assert (local(got.assays["twice"]) == 2 * column_major(60, 10, 6)[np.ix_([3, 1, 1], [5])]).all()
    assert [r.name for r in got.rowdata.orderBy("pos").collect()] == ["g4", "g2", "g2"]
    with pytest.raises(ValueError, match="no experiment"):
        container.load(spark, f"{tmp_path}/none")


def test_dump_and_stream(spark, tmp_path):
    d = dump.Dump(str(tmp_path / "dump"))
    assert d.name() == d.name() and d.name(for_use=True) != d.name()
    d.write(array(spark, column_major(60, 10, 6)))
    assert d.log(spark).count() == 1 and d.arrays(spark).count() == 1
    small(spark).cells.write.parquet(f"{tmp_path}/in")
    meta = small(spark).meta
    cells = spark.readStream.schema("i1 long, i2 long, val double").parquet(f"{tmp_path}/in")
    append_stream(cells, meta, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    finish(spark, meta, f"{tmp_path}/out")
    assert store.open_array(spark, f"{tmp_path}/out").cells.count() == 5


def test_functions_that_are_not_zero_at_zero(spark):
    x = small(spark)
    dense = compute.elementwise(x, lambda v: v + 1)
    assert not dense.is_sparse and dense.cells.count() == x.meta.length
    got = local(dense)
    assert got[0, 0] == 6.0 and got[1, 0] == 1.0 and got[2, 2] is None and math.isnan(got[0, 3])
    assert compute.elementwise(x, lambda v: v * 3).is_sparse
    y = sparse.transpose(sparse.transpose(x)).with_labels(None)
    both = compute.combine(x, y, lambda a, b: a + b)
    assert both.is_sparse and {(r.i1, r.i2): r.val for r in both.cells.where("val is not null and not isnan(val)").collect()} == {(1, 1): 10.0, (3, 1): -4.0, (2, 3): 1.0}
    assert not compute.combine(x, y, lambda a, b: a + b + 1).is_sparse


def test_runs_are_not_written_out(spark):
    from gridloom.plans.selection import plan_axis

    plan = plan_axis(9_000_000_000, 1000, [1, 5_000_000_000], [4_000_000_000, 10])
    assert plan.order is None and plan.extent == 4_000_000_010 and plan.chunks == ((0, 4_000_000), (4_999_999, 2))
    assert plan_axis(100, 10, range(5, 26)).runs == ((5, 21),) and plan_axis(100, 10, range(5, 26)).chunks == ((0, 3),)
    assert plan_axis(100, 10, [3, 1, 1]).order == (3, 1, 1) and plan_axis(100, 10, [3, 4]).order is None
    a = column_major(60, 10, 6)
    got = select.select(array(spark, a), [[2, 5, 9], None], [[2, 1, 2], None])
    assert (local(got) == a[[1, 2, 4, 8, 9], :]).all()


def test_raw_keys_reach_the_scan(spark):
    from gridloom.sources.tables import lines_matrix

    plan = select.select(lines_matrix(spark, "/root/testdata/sf0.001"), [[9, 4], None]).cells._jdf.queryExecution().executedPlan().toString()
    assert "l_partkey" in plan.split("PushedFilters: [")[1].split("]")[0]


def test_a_replace_that_fails_leaves_the_old_array(spark, tmp_path):
    a = column_major(60, 10, 6)
    store.write_array(array(spark, a), f"{tmp_path}/m", (5, 3))
    broken = compute.elementwise(array(spark, a), lambda v: v / (v - v), "integer")
    with pytest.raises(Exception):
        store.write_array(broken, f"{tmp_path}/m", (5, 3), replace_old=True)
    assert (local(store.open_array(spark, f"{tmp_path}/m")) == a).all()
    store.write_array(compute.elementwise(store.open_array(spark, f"{tmp_path}/m"), lambda v: v + 1, "integer"), f"{tmp_path}/m", (5, 3), replace_old=True)  # reads what it replaces
    assert (local(store.open_array(spark, f"{tmp_path}/m")) == a + 1).all()
    assert sum(n.startswith("data") for n in store.Files(spark).names(f"{tmp_path}/m")) == 1


def test_sinks(spark, tmp_path):
    x = array(spark, column_major(6, 3, 2))
    sink = sinks.DenseSink(spark, f"{tmp_path}/d", (6, 2), "integer")
    sink.write_block([3, 0], x)
    with pytest.raises(ValueError):
        sink.write_block([4, 0], x)
    with pytest.raises(ValueError):
        sink.close()
    sink.write_block([0, 0], x)
    assert (local(sink.close()) == np.concatenate([column_major(6, 3, 2)] * 2)).all()
    empty = sinks.ColumnSink(spark, f"{tmp_path}/s", (3, 5))
    with pytest.raises(ValueError):
        empty.close()
    assert empty.write_block(1, small(spark)) == 1 - 5 / 15
    assert empty.close().dim == (3, 5)
    kept = sinks.realize(x, "", "memory")
    assert (local(kept) == column_major(6, 3, 2)).all()
    kept.cells.unpersist()


def test_values_behind_a_vector(spark, tmp_path):
    v = lambda n, at: array(spark, np.arange(at, at + n).astype(object))
    store.write_array(v(7, 0), f"{tmp_path}/v", (3,))
    for n, at in ((4, 7), (1, 11), (3, 12)):
        store.append_values(v(n, at), f"{tmp_path}/v")
    s = store.stored(spark, f"{tmp_path}/v")
    assert s.meta.dim == (15,) and store.same_geometry(s, "v") is None and local(s.array()).tolist() == list(range(15))
    assert select.as_array(s.array()).tolist() == list(range(15))


def test_bound_labels_and_blocks(spark):
    import pandas as pd

    x = array(spark, column_major(6, 3, 2)).with_labels([["a", "b", "c"], ["x", "y"]])
    got = {(r.axis, r.pos): r.label for r in shape.bind([x, x], 1).labels.collect()}
    assert got == {(1, k): v for k, v in enumerate("abcabc", 1)} | {(2, 1): "x", (2, 2): "y"}
    with pytest.raises(ValueError):
        x.with_labels([["a"], None])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)  # blocks that go over batches
    a = column_major(60, 10, 6)
    f = lambda at, cells: pd.DataFrame({"bi": [at[0]], "bj": [at[1]], "n": [len(cells)], "s": [int(cells["val"].sum())]})
    got = {(r.bi, r.bj): (r.n, r.s) for r in compute.block_apply(array(spark, a), f, "bi long, bj long, n long, s long", [4, 5]).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {(i, j): (a[4 * i : 4 * i + 4, 5 * j : 5 * j + 5].size, a[4 * i : 4 * i + 4, 5 * j : 5 * j + 5].sum()) for i in range(3) for j in range(2)}
