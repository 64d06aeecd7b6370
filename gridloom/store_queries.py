"""Queries of stores, formats, labels, settings and local results, each with SQL that gives the same rows."""

from __future__ import annotations

import json
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.model import ArrayMeta, GridArray
from gridloom.operators import compute, select, sparse
from gridloom.plans import selection
from gridloom.plans.settings import Settings
from gridloom.queries import _DIMS, _E, _GRID, _S, E, S, _ij, _pos, _workspace, query
from gridloom.sources import compressed, labels, sinks, store
from gridloom.sources.dump import Dump
from gridloom.sources.places import Place

_NR = "(SELECT max(p_partkey) + 1 FROM part)"
_NC = "(SELECT max(s_suppkey) + 1 FROM supplier)"
_NE = "(SELECT max(vec_id) + 1 FROM embeddings)"


def _facts(spark: SparkSession, facts: dict[str, object]) -> DataFrame:
    """One row a fact, as text."""
    return spark.createDataFrame([(k, str(v)) for k, v in facts.items()], "fact string, value string")


def _facts_sql(**facts: str) -> str:
    return " UNION ALL ".join(f"SELECT '{k}' AS fact, ({v})::VARCHAR AS value" for k, v in facts.items())


def _stored(spark: SparkSession, x: GridArray, *chunks: int, name: str = "x") -> store.StoredArray:
    path = f"{_workspace(spark)}/{name}"
    store.write_array(x, path, list(chunks) or None)
    return store.stored(spark, path)


# ---- formats


@query(f"WITH {_S} SELECT i, j, v FROM S")
def annotated_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{_workspace(spark)}/annotated"
    compressed.write_annotated(S(spark, sf_dir), path)
    return _ij(compressed.open_annotated(spark, path))


@query(f"WITH {_E} SELECT 'X' AS layer, j AS i, i AS j, v FROM E UNION ALL SELECT 'double', j, i, 2 * v FROM E")
def annotated_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense layers; observations are rows of the stored arrays, columns of those that are opened."""
    path, x = f"{_workspace(spark)}/annotated", sparse.transpose(E(spark, sf_dir)).with_labels(None)
    x = x.with_labels([[f"v{k}" for k in range(1, 65)], None])
    compressed.write_annotated(x, path, {"double": compute.elementwise(x, lambda v: 2 * v)}, layout=None)
    found = [(k, compressed.open_annotated(spark, path, layer)) for k, layer in (("X", None), ("double", "double"))]
    return store.union_all([_ij(a).select(F.lit(k).alias("layer"), "i", "j", "v") for k, a in found])


@query("SELECT 1 AS axis, p_partkey + 1 AS pos, p_name AS label FROM part UNION ALL SELECT 2, s_suppkey + 1, s_name FROM supplier")
def annotated_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{_workspace(spark)}/annotated"
    compressed.write_annotated(S(spark, sf_dir), path)
    return compressed.open_annotated(spark, path).labels


def _cells_matrix(spark: SparkSession, sf_dir: str) -> str:
    path = _workspace(spark)
    compressed.write_cells_matrix(S(spark, sf_dir), path)
    return path


@query(f"WITH {_S} SELECT i, j, v FROM S")
def cells_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ij(compressed.open_cells_matrix(spark, _cells_matrix(spark, sf_dir)))


@query("SELECT 1 AS axis, p_partkey + 1 AS pos, p_name AS label FROM part UNION ALL SELECT 2, s_suppkey + 1, s_name FROM supplier")
def cells_matrix_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compressed.open_cells_matrix(spark, _cells_matrix(spark, sf_dir)).labels


_K = f"{_S}, K AS (SELECT i, j, v, row_number() OVER (ORDER BY j, i) AS k FROM S)"


@query(f"WITH {_K} SELECT k, i AS value FROM K")
def component_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compressed.component(spark, f"{_cells_matrix(spark, sf_dir)}/matrix", "indices")


@query(f"WITH {_K} SELECT k, v AS value FROM K WHERE k BETWEEN 101 AND 150")
def component_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compressed.component(spark, f"{_cells_matrix(spark, sf_dir)}/matrix", "data", 101, 50)


@query(f"WITH {_S}, {_DIMS}, c AS (SELECT j, count(v) AS n FROM unnest(range(1, (SELECT nc FROM D) + 2)) AS u(j) LEFT JOIN S USING (j) GROUP BY 1) SELECT j AS k, (sum(n) OVER (ORDER BY j) - n)::BIGINT AS value FROM c")
def component_indptr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compressed.component(spark, f"{_cells_matrix(spark, sf_dir)}/matrix", "indptr")


@query(f"WITH {_S} SELECT i, j, -v AS v FROM S")
def compressed_subdata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Other values at the same places, of a group whose attributes have older names; its layout is detected."""
    path = f"{_workspace(spark)}/old"
    compressed.write_compressed(S(spark, sf_dir), path, layout="csr")
    files = store.Files(spark)
    group = json.loads(files.read(f"{path}/_group.json"))
    spark.read.parquet(f"{path}/elements").withColumn("minus", -F.col("data")).write.parquet(f"{path}/elements2")
    files.delete(f"{path}/elements")
    files.rename(f"{path}/elements2", f"{path}/elements")
    files.write(f"{path}/_group.json", json.dumps({"h5sparse_shape": group["shape"], "h5sparse_format": "csr"}))
    return _ij(compressed.open_compressed(spark, path, "minus"))


@query(f"WITH {_S} SELECT i, j, v FROM S WHERE j <= 5")
def local_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five columns as one local compressed matrix, a result for the driver by what it is."""
    m = sparse.to_local_csc(select.select(S(spark, sf_dir), [None, range(1, 6)]))
    ends = m.colPtrs
    rows = [(int(m.rowIndices[k]) + 1, j + 1, float(m.values[k])) for j in range(m.numCols) for k in range(ends[j], ends[j + 1])]
    return spark.createDataFrame(rows, "i long, j long, v double")


# ---- geometry and places


@query(_facts_sql(dim=f"SELECT {_NR}::VARCHAR || ' x ' || {_NC}::VARCHAR", type="'double'", chunkdim=f"SELECT {_NR}::VARCHAR || ' x 1'", is_sparse="'True'", layout="'csc'", show=f"SELECT '<' || {_NR}::VARCHAR || ' x ' || {_NC}::VARCHAR || ' sparse double array>'"))
def geometry_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _stored(spark, S(spark, sf_dir)).array()
    text = lambda d: " x ".join(map(str, d))
    return _facts(spark, {"dim": text(x.dim), "type": x.type, "chunkdim": text(x.chunkdim), "is_sparse": x.is_sparse, "layout": x.meta.layout, "show": repr(x)})


@query(_facts_sql(returned_type="'integer'", dim=f"SELECT {_NE}::VARCHAR || ' x 64'", chunkdim="'100 x 16'", is_sparse="'False'", taken_sparse="'True'", fits="'None'", stretched="'e: the data have not the extents (7, 64)'"))
def geometry_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of a stored array, found without its values but for the last two, which check them."""
    s = _stored(spark, E(spark, sf_dir), 100, 16, name="e")
    m = store.describe(spark, s.path).first()
    text = lambda d: " x ".join(map(str, d))
    wrong = replace(s, meta=replace(s.meta, dim=(7, 64)))
    return _facts(spark, {
        "returned_type": store.open_array(spark, s.path, kind="integer").type, "dim": text(m.dim), "chunkdim": text(m.chunkdim), "is_sparse": m.is_sparse,
        "taken_sparse": s.array().as_sparse().is_sparse, "fits": store.same_geometry(s, "e"), "stretched": store.same_geometry(wrong, "e"),
    })


@query(_facts_sql(same="'moved'", other_values="'refused'", other_extents="'refused'", sparse="'refused'"))
def move_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, e = _workspace(spark), E(spark, sf_dir)
    for name, x in (("a", e), ("b", e), ("c", compute.elementwise(e, lambda v: v + 1)), ("d", select.select(e, [range(1, 10), None])), ("s", S(spark, sf_dir))):
        store.write_array(x, f"{base}/{name}")

    def moved(old: str, new: str) -> str:
        try:
            store.move(store.stored(spark, f"{base}/{old}"), f"{base}/{new}")
        except ValueError:
            return "refused"
        return "moved"

    return _facts(spark, {"same": moved("a", "b"), "other_values": moved("a", "c"), "other_extents": moved("a", "d"), "sparse": moved("s", "b")})


@query(f"SELECT '/group' AS name, 'group' AS kind, NULL AS type, NULL AS extents UNION ALL SELECT '/group/e', 'array', 'double', {_NE}::VARCHAR || ' x 64' UNION ALL SELECT '/s', 'array', 'double', {_NR}::VARCHAR || ' x ' || {_NC}::VARCHAR")
def list_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _workspace(spark)
    store.write_array(E(spark, sf_dir), f"{base}/group/e")
    store.write_array(S(spark, sf_dir), f"{base}/s")
    found = store.list_arrays(spark, base, details=True)
    return found.select("name", "kind", "type", F.array_join(F.col("dim").cast("array<string>"), " x ").alias("extents"))


@query(_facts_sql(array="'array'", group="'group'", nothing="'None'", name="'/x/y'", old_format="'csc'", newer="'refused'"))
def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands at a path, what a name becomes, and manifests of other formats."""
    s = _stored(spark, E(spark, sf_dir), name="g/e")
    old = ArrayMeta.from_json(json.dumps({"dim": [2, 3], "type": "double", "is_sparse": True, "format_version": 1}))
    try:
        newer = ArrayMeta.from_json(json.dumps({"dim": [2], "format_version": 99})).layout
    except ValueError:
        newer = "refused"
    return _facts(spark, {
        "array": store.probe(spark, s.path), "group": store.probe(spark, s.path.rsplit("/", 1)[0]), "nothing": store.probe(spark, f"{s.path}/none"), "name": store.normal_name("//x/y"),
        "old_format": old.layout, "newer": newer,
    })


@query(_facts_sql(url="'s3a://bucket/x'", shown="'Place(path=''s3://bucket/x'', region=''eu-1'')'", known="'id'", closed="'None'", half="'refused'", local="'/x'"))
def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Handles of paths with credentials."""
    place, conf = Place("s3://bucket/x", "eu-1", "id", "key"), spark._jsc.hadoopConfiguration()
    facts = {"url": place.open(spark), "shown": repr(place), "known": conf.get("fs.s3a.bucket.bucket.access.key"), "local": Place("/x").open(spark)}
    place.close(spark)
    try:
        half = Place("s3://bucket/x", "eu-1").url
    except ValueError:
        half = "refused"
    return _facts(spark, facts | {"closed": conf.get("fs.s3a.bucket.bucket.access.key"), "half": half})


# ---- sinks


@query(f"WITH {_E} SELECT i, j, v FROM E")
def sink_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An array written by blocks, the last first; one block is written twice, and the later one holds."""
    e = E(spark, sf_dir)
    sink = sinks.DenseSink(spark, f"{_workspace(spark)}/e", e.dim, chunkdim=[64, 16])
    half = e.dim[0] // 2
    lower = select.read_block(e, [half, 0], [e.dim[0] - half, 64])
    sink.write_block([half, 0], compute.elementwise(lower, lambda v: v + 1))
    sink.write_block([half, 0], lower)
    sink.write_block([0, 0], select.read_block(e, [0, 0], [half, 64]))
    return _ij(sink.close())


@query(f"WITH {_S}, b AS (SELECT i, j, v, CASE WHEN j <= {_NC} // 2 THEN 1 ELSE 2 END AS b FROM S) SELECT i, j, v FROM b")
def sink_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = S(spark, sf_dir)
    sink, half = sinks.ColumnSink(spark, f"{_workspace(spark)}/s", s.dim), s.dim[1] // 2
    for first, n in ((1, half), (half + 1, s.dim[1] - half)):
        sink.write_block(first, select.select(s, [None, range(first, first + n)]))
    return _ij(sink.close())


@query(_facts_sql(gap="'refused'", early_close="'refused'", dense_early_close="'refused'", sparsity=f"WITH {_S} SELECT round(1 - (SELECT count(*) FROM S WHERE j <= 3) / ({_NR} * 3)::DOUBLE, 6)"))
def sink_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, e = S(spark, sf_dir), E(spark, sf_dir)
    sink, dense = sinks.ColumnSink(spark, f"{_workspace(spark)}/s", s.dim), sinks.DenseSink(spark, f"{_workspace(spark)}/e", e.dim)
    block = select.select(s, [None, range(1, 4)])
    dense.write_block([0, 0], select.read_block(e, [0, 0], [10, 64]))

    def tried(f) -> object:
        try:
            return f()
        except ValueError:
            return "refused"

    gap = tried(lambda: sink.write_block(2, block))
    sparsity = round(sink.write_block(1, block), 6)
    return _facts(spark, {"gap": gap, "early_close": tried(sink.close), "dense_early_close": tried(dense.close), "sparsity": sparsity})


@query(f"WITH {_S}, n AS (SELECT {_NC} AS nc) SELECT i, j, v FROM S UNION ALL SELECT i, j + (SELECT nc FROM n), v FROM S")
def append_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{_workspace(spark)}/s"
    store.write_array(S(spark, sf_dir), path)
    store.append_columns(S(spark, sf_dir), path)
    return _ij(store.open_array(spark, path))


@query(f"WITH {_E}, n AS (SELECT {_NE} AS n) SELECT i, v FROM E WHERE j = 1 UNION ALL SELECT i + (SELECT n FROM n), v FROM E WHERE j = 2")
def append_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, e = f"{_workspace(spark)}/v", E(spark, sf_dir)
    column = lambda j: select.drop_axes(select.select(e, [None, [j]]))
    store.write_array(column(1), path, [64])
    store.append_values(column(2), path)
    return store.open_array(spark, path).cells.select(F.col("i1").alias("i"), F.col("val").alias("v"))


@query(f"WITH {_E} SELECT j, sum(v) > -1e300 AS known, count(*) AS n FROM E GROUP BY 1")
def realize_backends(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = Settings()
    x = sinks.realize(E(spark, sf_dir), f"{_workspace(spark)}/e", settings.backend)
    return x.cells.groupBy(F.col("i2").alias("j")).agg((F.sum("val") > -1e300).alias("known"), F.count("*").alias("n"))


# ---- labels


@query("SELECT 1 AS axis, vec_id + 1 AS pos, 'row ' || vec_id::VARCHAR AS label FROM embeddings")
def labels_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _stored(spark, E(spark, sf_dir), 100, 64)
    labels.write_labels(spark, s.path, [[f"row {k}" for k in range(s.meta.dim[0])], None])
    return labels.read_labels(spark, s.path)


@query("SELECT 2 AS axis, s_suppkey + 1 AS pos, s_name AS label FROM supplier")
def labels_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _stored(spark, S(spark, sf_dir).with_labels(None))
    names = f"{_workspace(spark)}/names"
    spark.read.parquet(f"{sf_dir}/supplier.parquet").select((F.col("s_suppkey") + 1).alias("pos"), F.col("s_name").alias("label")).write.parquet(names)
    labels.attach_scales(spark, s.path, [None, names])
    return labels.read_labels(spark, s.path)


@query(_facts_sql(dry_run="'[False, True]'", attached="'[False, True]'", again="'[False, False]'", is_scale="'True'", scale_of_none="'False'", axis_names="'(''part'', None)'", no_names="'None'"))
def scales_and_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _stored(spark, S(spark, sf_dir).with_labels(None))
    names = f"{_workspace(spark)}/names"
    spark.read.parquet(f"{sf_dir}/supplier.parquet").select((F.col("s_suppkey") + 1).alias("pos"), F.col("s_name").alias("label")).write.parquet(names)
    facts = {"no_names": labels.axis_names(spark, s.path), "dry_run": labels.attach_scales(spark, s.path, [None, names], dry_run=True), "scale_of_none": labels.is_scale(spark, names, [s.path])}
    facts |= {"attached": labels.attach_scales(spark, s.path, [None, names]), "again": labels.attach_scales(spark, s.path, [None, names]), "is_scale": labels.is_scale(spark, names, [s.path])}
    labels.set_axis_names(spark, s.path, ["part", None])
    return _facts(spark, facts | {"axis_names": labels.axis_names(spark, s.path)})


@query("SELECT 1 AS axis, vec_id + 1 AS pos, 'e' || (vec_id + 1)::VARCHAR AS label FROM embeddings")
def labels_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Other labels of a lazy array: its table of labels, nothing else."""
    x = E(spark, sf_dir)
    found = spark.range(1, x.dim[0] + 1).select(F.lit(1).alias("axis"), F.col("id").alias("pos"), F.concat(F.lit("e"), F.col("id")).alias("label"))
    return x.with_labels(found).labels


# ---- reading and computing


@query(f"WITH {_E} SELECT i, j, v FROM E WHERE i IN (3, 5, 7) AND j IN (1, 64)")
def read_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every read method gives the same cells."""
    e = E(spark, sf_dir)
    found = store.union_all([_ij(select.select(e, [[3, 5, 7], [1, 64]], method=m)).withColumn("m", F.lit(m)) for m in range(8)])
    same = found.groupBy("i", "j", "v").agg(F.countDistinct("m").alias("n")).where("n = 8")
    at = lambda c, of: F.element_at(F.array(*map(F.lit, of)), F.col(c).cast("int")).cast("long").alias(c)
    return same.select(at("i", (3, 5, 7)), at("j", (1, 64)), "v")


@query(f"WITH {_S} SELECT j, count(*) AS n, sum(v) AS s FROM S WHERE j BETWEEN 2 AND 9 GROUP BY 1")
def linear_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring columns, which the reader takes as one stretch."""
    at = list(range(2, 10))
    assert selection.dense_enough(at)
    got = sparse.nonzero_by(S(spark, sf_dir), 2, at)
    return got.select(F.col("pos").alias("j"), F.size("vals").cast("long").alias("n"), F.aggregate("vals", F.lit(0.0), lambda a, v: a + v).alias("s"))


@query(f"WITH {_E} SELECT j, max(v) AS v FROM E GROUP BY 1")
def dense_transpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pos(compute.along(sparse.transpose(E(spark, sf_dir)), 1, "max"), "j", "v")


@query(f"WITH {_E} SELECT i, j, v FROM E")
def local_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense matrix as a local array, a result for the driver by what it is, and back."""
    import numpy as np
    import pyarrow as pa

    a = select.as_array(E(spark, sf_dir))
    ends = pa.array(np.arange(0, a.size + 1, a.shape[1], dtype=np.int32))
    rows = spark.createDataFrame(pa.table({"i": np.arange(1, a.shape[0] + 1), "vs": pa.ListArray.from_arrays(ends, a.ravel())}))
    return rows.select("i", F.posexplode("vs").alias("j", "v")).select("i", (F.col("j") + 1).cast("long").alias("j"), "v")


@query("SELECT p_partkey + 1 AS i, length(p_name)::INTEGER AS chars, strlen(p_name)::INTEGER AS bytes FROM part")
def nchar(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    x = GridArray(ArrayMeta((S(spark, sf_dir).dim[0],), "character"), part.select((F.col("p_partkey") + 1).alias("i1"), F.col("p_name").alias("val")))
    chars, size = (compute.nchar(x, what).cells.select(F.col("i1").alias("i"), F.col("val").alias(what)) for what in ("chars", "bytes"))
    return chars.join(size, "i")


@query(f"WITH {_S} SELECT (i - 1) // 100 AS bi, (j - 1) // 10 AS bj, sum(v) AS total FROM S GROUP BY 1, 2")
def block_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks and tasks as the settings have them: 1,000 cells, in the shape of the array."""
    settings = Settings(block_cells=1000, workers=3)
    x = S(spark, sf_dir)
    block = [100, 10] if settings.block((1000, 100)) == (100, 10) else None
    return compute.block_apply(x, lambda at, cells: [(*at, cells["val"].sum())], "bi long, bj long, total double", block, settings, plain=True)


@query(f"WITH {_S}, {_GRID} SELECT i, max(coalesce(v, 0)) AS hi, min(coalesce(v, 0)) AS lo FROM g LEFT JOIN S USING (i, j) GROUP BY 1")
def row_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = S(spark, sf_dir)
    return _pos(compute.along(x, 1, "max"), "i", "hi").join(_pos(compute.along(x, 1, "min"), "i", "lo"), "i")


# ---- plans and dumps


def _planned(f) -> str:
    try:
        return str(f())
    except selection.SelectionError:
        return "refused"


@query(_facts_sql(extents="'[6, 1, 2]'", counted="'[5]'", zero="'refused'", beyond="'refused'", negative_count="'refused'", ascending="'[3]'", descending="'refused'", huge="'[(3000000001, 10)]'"))
def check_selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = selection
    return _facts(spark, {
        "extents": _planned(lambda: list(plan.check_selection((6, 5, 4), [None, [5], [3, 4]]))), "counted": _planned(lambda: list(plan.check_selection([15], [[14, 5, 8]], [[2, 0, 3]]))),
        "zero": _planned(lambda: plan.check_selection([15], [[0]])), "beyond": _planned(lambda: plan.check_selection([15], [[16]])), "negative_count": _planned(lambda: plan.check_selection([15], [[1]], [[-1]])),
        "ascending": _planned(lambda: list(plan.check_ordered_selection([15], [[2, 5, 9]])[0])), "descending": _planned(lambda: plan.check_ordered_selection([15], [[5, 2]])),
        "huge": _planned(lambda: list(plan.plan_axis(9_000_000_000, None, [3_000_000_001], [10]).runs)),
    })


@query(_facts_sql(chunk="'(1000, 1000)'", first="'(10000, 100)'", level="'9'", level_10="'refused'", name_kept="'True'", fixed="'True'", automatic="'True'", default_level="'6'"))
def dump_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _workspace(spark)
    d = Dump(base)
    facts = {"default_level": d.level, "chunk": d.chunkdim((10_000, 10_000)), "first": Dump(base, chunk_shape="first").chunkdim((10_000, 10_000))}
    d.set_level(9)
    try:
        d.set_level(10)
        facts["level_10"] = "taken"
    except ValueError:
        facts["level_10"] = "refused"
    facts |= {"level": d.level, "name_kept": d.name() == d.name(for_use=True)}
    d.set_file(f"{base}/one")
    facts["fixed"] = d.place == f"{base}/one"
    d.set_file(f"{base}/many/")
    return _facts(spark, facts | {"automatic": d.place == f"{base}/many"})


@query(f"WITH {_E} SELECT i, j, v FROM E")
def dump_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _workspace(spark)
    d = Dump(base)
    d.set_file(f"{base}/one")
    d.set_name("/e")
    d.write(E(spark, sf_dir))
    return _ij(store.open_array(spark, f"{base}/one/e"))
