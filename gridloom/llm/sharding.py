"""Contiguous shards of near-equal byte size, by a global prefix sum.

Rows are put in order of their id (ties: checksum, then size; rows equal in all three are
interchangeable). The order is cut into ranges of ids; each range's byte and row totals are
summed first, the few totals are prefix-summed, and the running sums inside a range start from there.
A row goes to the shard its middle byte falls into when the whole is cut at equal targets.
Only ids, sizes and checksums are moved for that; :func:`place` then moves each row once, to its shard and slot.

Nulls: a null text has no bytes, a null id sorts first. An empty table gives no rows. Repeated rows are told apart by a number, and may
be in two shards if they stand at a cut. A text of any length is one row of its size. Other columns, whatever their names, stay as they are;
:func:`place` replaces columns named shard and slot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.common import Scratch, helper, partitions_for, table, utf8_bytes

#: Bytes that each row takes besides its text (a length field).
ROW_BYTES = 8
SHARDS = 24


def shard_of(end: str, size: str, whole: int, n_shards: int) -> Column:
    """The shard of the middle byte of a row that ends at byte ``end`` of ``whole``, in whole numbers: a quotient is never rounded up."""
    return F.expr(f"cast((2 * cast({end} as decimal(38,0)) - {size}) * {n_shards} div cast({2 * max(1, whole)} as decimal(38,0)) as int)")


def assign(docs: DataFrame, n_shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, size, text_crc32, shard (0 to n_shards - 1) and slot (gapless from 0)."""
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (utf8_bytes(text_col) + ROW_BYTES).alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("_tie"),  # so that alike rows, however many, need not be in one range
    )
    key = (F.col("doc_id").asc_nulls_first(), F.col("text_crc32").asc(), F.col("size").asc(), F.col("_tie").asc())
    ranged = rows.repartitionByRange(partitions_for(spark), *key).withColumn("_range", F.spark_partition_id())
    # Written once: another run of the same plan could cut the ranges elsewhere.
    rows = Scratch(spark, "sharding").keep(ranged, "ranged")
    # One total a range: as many as there are shuffle partitions, whatever the size of the table.
    totals = rows.groupBy("_range").agg(F.sum("size").alias("b"), F.count("*").alias("r")).orderBy("_range").collect()
    whole, before, base = sum(t.b for t in totals), (0, 0), []
    for t in totals:
        base.append((t["_range"], *before))
        before = (before[0] + t.b, before[1] + t.r)
    starts = F.broadcast(spark.createDataFrame(base, "_range int, _b0 long, _r0 long"))
    order = Window.partitionBy("_range").orderBy(*key)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.join(starts, "_range").select(
        "doc_id", "size", "text_crc32",
        (F.col("_b0") + F.sum("size").over(upto)).alias("_end"),
        (F.col("_r0") + F.row_number().over(order) - 1).alias("_row"),
    )
    return placed.withColumn("shard", shard_of("_end", "size", whole, n_shards))


def shard_documents(docs: DataFrame, n_shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`assign` with the slot of each row in its shard, counted from the shard's first row."""
    placed = assign(docs, n_shards, id_col, text_col)
    first = F.broadcast(placed.groupBy("shard").agg(F.min("_row").alias("_first")))  # one row a shard
    return placed.join(first, "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("_row") - F.col("_first")).alias("slot"))


def place(docs: DataFrame, n_shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with shard and slot. Repeated rows take slots next to one another; columns of these names are replaced.

    Rows alike in id, checksum and size stand together in the order, so a key with the first places it has in each of its shards says where all its rows go:
    the n-th of them, they are interchangeable, takes the n-th place. One shuffle by key thus numbers the rows and brings their places: texts are moved once.
    """
    docs = docs.drop("shard", "slot")
    key, n, pieces, piece = (helper(k) for k in ("key", "n", "pieces", "piece"))
    placed = assign(docs, n_shards, id_col, text_col)
    first = F.broadcast(placed.groupBy("shard").agg(F.min("_row").alias("_first")))  # one row a shard
    found = placed.select(F.struct("doc_id", "text_crc32", "size").alias(key), "shard", "_row").repartition(partitions_for(docs.sparkSession), key)
    found = found.groupBy(key, "shard").agg(F.min("_row").alias("_from")).join(first, "shard")
    found = found.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_from", "shard", (F.col("_from") - F.col("_first")).alias("slot")))).alias(pieces))
    found = Scratch(docs.sparkSession, "sharding").keep(found, "placed")
    of_row = F.struct(F.col(id_col).alias("doc_id"), F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"), (utf8_bytes(text_col) + ROW_BYTES).alias("size"))
    of_row = of_row.cast(found.schema[key].dataType)  # of one type on both sides, or the join would deal the texts again
    numbered = docs.withColumn(key, of_row).withColumn(n, F.row_number().over(Window.partitionBy(key).orderBy(F.lit(0))) - 1)
    row = F.element_at(pieces, 1)["_from"] + F.col(n)
    out = numbered.join(found, key).withColumn(piece, F.element_at(F.filter(pieces, lambda p: p["_from"] <= row), -1))
    return out.select(*docs.columns, F.col(f"{piece}.shard").alias("shard"), (F.col(f"{piece}.slot") + row - F.col(f"{piece}._from")).cast("long").alias("slot"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


#: What each bit of a byte, the lowest first, adds to a CRC-32.
BIT_CRC = (0x77073096, 0xEE0E612C, 0x076DC419, 0x0EDB8832, 0x1DB71064, 0x3B6E20C8, 0x76DC4190, 0xEDB88320)
_BYTE_CRC = "0"
for _k, _v in enumerate(BIT_CRC):
    _BYTE_CRC = f"xor({_BYTE_CRC}, ((xor(c, b) >> {_k}) & 1) * {_v})"

OP8_SQL = f"""
WITH rows AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0) + {ROW_BYTES} AS size, hex(encode(coalesce(text, ''))) AS h FROM documents
), summed AS (
  SELECT doc_id, size,
    xor(list_reduce(list_prepend(4294967295, list_transform(range(size - {ROW_BYTES}), lambda k: ('0x' || h[2 * k + 1 : 2 * k + 2])::BIGINT)),
      lambda c, b: xor(c >> 8, {_BYTE_CRC})), 4294967295) AS text_crc32
  FROM rows
), ends AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER () AS whole FROM summed
), placed AS (
  SELECT *, ((2 * upto - size) * {SHARDS} // (2 * whole))::INT AS shard FROM ends
)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY upto) - 1 AS slot, NULL::INT AS grown_shard
FROM placed
"""
