"""Plain tables as arrays: order lines as a sparse matrix, embeddings as a dense one, events as a sparse 3-d array.

Extents are metadata. Where a table of keys gives them they are its greatest key, which Parquet's statistics hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.model import ArrayMeta, GridArray
from gridloom.operators.select import between
from gridloom.sources.store import dense_from_rows


#: Lines that a task sums up about, and the number up to which Spark deals them as it likes.
TASK_LINES = 1 << 19
FEW_LINES = 1 << 21


def _top(df: DataFrame, column: str) -> int:
    return (df.agg(F.max(column)).first()[0] or 0) + 1


def lines_matrix(spark: SparkSession, sf_dir: str, val: str = "l_quantity") -> GridArray:
    """Parts by suppliers, the sum of their lines' quantities; labels are their names."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    part, supplier = read("part"), read("supplier")
    dim = (_top(part, "p_partkey"), _top(supplier, "s_suppkey"))
    # Few lines of a cell stand near one another, so sums before the shuffle save little and hold a file's cells; many lines are dealt first, to as many tasks as they need.
    n = read("lineitem").count()  # from Parquet's footers
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // TASK_LINES)) if n > FEW_LINES else None
    keys = [(F.col("l_partkey") + 1).alias("i1"), (F.col("l_suppkey") + 1).alias("i2")]

    def cells(runs) -> DataFrame:
        lines = read("lineitem")
        for key, held in zip(("l_partkey", "l_suppkey"), runs, strict=True):
            if held is not None:  # on the stored key, so that row groups are skipped
                lines = lines.where(between(F.col(key), [(s - 1, n) for s, n in held]))
        rows = lines.select(*keys, F.expr(val).alias("_v"))
        if tasks:
            rows = rows.repartition(tasks, "i1", "i2")
        return rows.groupBy("i1", "i2").agg(F.sum("_v").alias("val"))

    label = lambda df, axis, k, name: df.select(F.lit(axis).alias("axis"), (F.col(k) + 1).alias("pos"), F.col(name).alias("label"))
    labels = label(part, 1, "p_partkey", "p_name").union(label(supplier, 2, "s_suppkey", "s_name"))
    return GridArray(ArrayMeta(dim, "double", is_sparse=True, layout="csc"), cells([None, None]), labels, cells)


def embedding_matrix(spark: SparkSession, sf_dir: str) -> GridArray:
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("_row", F.col("vec_id") + 1)
    return dense_from_rows(df, "_row", "embedding", 64, _top(df, "vec_id"))


def event_counts(spark: SparkSession, sf_dir: str) -> GridArray:
    """Users by event types (in alphabetical order) by days of the month, counts."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    # A code a type by rank, as the type's extent is the number of types; the few types are numbered where the frame is.
    types = df.select("event_type").distinct().withColumn("_code", F.row_number().over(Window.orderBy("event_type")).cast("long"))
    n_types, code = types.count(), F.col("_code")
    df = df.join(types, "event_type")
    cells = df.groupBy((F.col("user_id") + 1).cast("long").alias("i1"), code.alias("i2"), F.dayofmonth("ts").cast("long").alias("i3")).agg(F.count("*").alias("val"))
    return GridArray(ArrayMeta((_top(df, "user_id"), n_types, 31), "long", is_sparse=True), cells)
