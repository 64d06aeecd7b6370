"""Benchmark passages in documents: SimHash of item-sized windows, Hamming blocks, exact weighted similarity.

Texts are lower-cased and cut into words at anything but letters and digits; five words in a row are a shingle (all
words, if there are fewer). A shingle weighs as many letters as its words have (65,535 at most). For an item of m
shingles, a document's windows are all runs of m of its shingles (the whole document, if it has fewer).

1. Windows without any shingle of the benchmark have similarity zero. Only those around a shared shingle are built, but of
   these every one, at every offset.
2. Each window and item gets a 64-bit SimHash of its weighted shingles.
3. Fingerprints are cut into eight blocks. Two that differ in at most 23 bits differ in at most two bits in some block, so
   items are listed under every block value within two bits, and windows of as many shingles look theirs up: all within the
   radius are found.
4. For pairs within the radius, the weighted Jaccard similarity is computed exactly; 0.75 or more is a leak. (Fingerprints
   of windows that just reach 0.75 differ in 11 bits on average, with a deviation of three: the radius is four deviations off.)

All of it is built-in functions. The benchmark's tables are broadcast only if they have at most BROADCAST_ROWS rows of a few numbers each.

Null and empty texts have no shingles. An item of fewer than five words is found in a document only if it is all of
it. Items and documents of any length are compared whole. Of windows that are equally similar the first is reported. Null ids are
kept; rows with equal id and text give one result. Extra columns, whatever their names, are not read. An empty table on either side gives no leaks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import Scratch, helper, partitions_for, table

THRESHOLD = 75  # per cent
RADIUS = 23
FLIPS = RADIUS // 8
BLOCKS, BLOCK_BITS = 8, 8
BROADCAST_ROWS = 500_000
_WEIGHT = "65535L"


def _words(text: str) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


#: Shingles of the words in w as hashes whose last sixteen bits are zero, and the same with their weights in those bits.
_GRAMS = """CASE WHEN size(w) >= 5 THEN transform(sequence(0, size(w) - 5), i -> xxhash64(w[i], w[i+1], w[i+2], w[i+3], w[i+4]) & -65536L)
            WHEN size(w) > 0 THEN array(xxhash64(w) & -65536L) ELSE array() END"""
_WEIGHED = f"""CASE WHEN size(w) >= 5 THEN transform(g, (h, i) -> h | least({" + ".join(f"length(w[i+{k}])" for k in range(5))}, 65535))
              WHEN size(w) > 0 THEN transform(g, h -> h | least(aggregate(w, 0L, (a, x) -> a + length(x)), 65535L)) ELSE g END"""


def _grams(df: DataFrame) -> DataFrame:
    return df.withColumn("g", F.expr(_GRAMS))


#: Weighted counts of all 64 bits over the shingles in d: 32 longs of two lanes, which no text's letters overflow.
_LANES = f"""aggregate(d, array_repeat(0L, 32), (a, h) -> zip_with(a, sequence(0, 31),
             (c, j) -> c + (shiftrightunsigned(xxhash64(h), j) & 4294967297L) * (h & {_WEIGHT})))"""
#: The bits that more than half of the weight has.
_MAJORITY = """aggregate(sequence(0, 63), 0L, (f, b) ->
               f | if(2 * (shiftrightunsigned(lanes[b % 32], cast(32 * (b div 32) AS int)) & 4294967295L) > weight, shiftleft(1L, b), 0L))"""


def _fingerprint(df: DataFrame) -> DataFrame:
    """df (with distinct weighted shingles d) with weight and fp."""
    return df.withColumns({"weight": _weight("d"), "lanes": F.expr(_LANES)}).withColumn("fp", F.expr(_MAJORITY)).drop("lanes")


def _weight(d: str) -> Column:
    return F.expr(f"aggregate({d}, 0L, (a, h) -> a + (h & {_WEIGHT}))")


def _if_small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """Items with a number of their own, distinct weighted shingles, size in shingles, and fingerprint."""
    words = benchmark.select(F.col(item_col).alias("item_id"), _words(text_col).alias("w")).where("size(w) > 0")
    sized = _grams(words).withColumn("sh", F.expr(_WEIGHED)).select("item_id", F.monotonically_increasing_id().alias("item"), F.size("sh").alias("m"), F.array_distinct("sh").alias("d"))
    return _fingerprint(sized)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row a document and item it has a passage of: doc_id, item_id, start (shingle), n_shingles, distance, similarity of its best window."""
    return _leaks(docs, benchmark, id_col, text_col, item_col, item_text_col).drop("th")


def _leaks(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str) -> DataFrame:
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontaminate")
    items = scratch.keep(_items(benchmark, item_col, item_text_col), "items")
    wanted = items.select(F.explode("d").alias("h"), "m").select((F.col("h").bitwiseAND(F.lit(-65536))).alias("gram"), "m").distinct()
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("t"))

    worded = keyed.select("doc_id", "th", _words("t").alias("w"))
    # The outer form: for the inner one, a filter on the array's size would be pushed down with the words split anew for each shingle.
    grams = _grams(worded).select("doc_id", "th", F.posexplode_outer("g").alias("pos", "gram"))
    hits = grams.join(_if_small(wanted), "gram").select("doc_id", "th", "pos", "m")
    anchors = scratch.keep(hits.groupBy("doc_id", "th", "m").agg(F.collect_set("pos").alias("at")), "anchors")

    found = anchors.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).distinct()
    texts = keyed.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")), "left_semi").dropDuplicates(["doc_id", "th"])
    texts = _grams(texts.select("doc_id", "th", _words("t").alias("w"))).select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), F.expr(_WEIGHED).alias("sh"))
    around = anchors.join(texts, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")))
    starts = "array_distinct(flatten(transform(at, p -> sequence(greatest(0, least(p, size(sh) - m) - m + 1), least(p, greatest(0, size(sh) - m))))))"
    # Dealt out anew: what is a few bytes before its windows are made is much work after.
    around = around.select("doc_id", "th", "m", "sh", "at").repartition(partitions_for(spark))
    windows = around.select("doc_id", "th", "m", "sh", F.explode_outer(F.expr(starts)).alias("start"))
    windows = windows.select("doc_id", "th", "m", "start", F.expr("array_distinct(slice(sh, start + 1, m))").alias("d"))
    windows = scratch.keep(_fingerprint(windows), "windows")

    probes = items.select("item", "m", F.col("fp").alias("fi"))
    near = F.lit([x for x in range(1 << BLOCK_BITS) if x.bit_count() <= FLIPS]).cast("array<bigint>")
    probes = probes.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1)))).withColumn("flip", F.explode(near))
    probes = probes.withColumn("value", F.expr(f"(shiftrightunsigned(fi, block * {BLOCK_BITS}) & 255L) ^ flip")).drop("flip")
    looked = windows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))))
    looked = looked.withColumn("value", F.expr(f"shiftrightunsigned(fp, block * {BLOCK_BITS}) & 255L"))
    # A pair that meets in several blocks counts in the first of them.
    first = "CASE " + " ".join(f"WHEN bit_count((fp ^ fi) & shiftleft(255L, {BLOCK_BITS * b})) <= {FLIPS} THEN {b}" for b in range(BLOCKS)) + " END"
    pairs = looked.join(_if_small(probes), ["m", "block", "value"]).withColumn("distance", F.expr("bit_count(fp ^ fi)")).where(f"distance <= {RADIUS} AND block = {first}")
    pairs = pairs.join(items.select("item", "item_id", F.col("d").alias("di"), F.col("weight").alias("wi")), "item")
    pairs = pairs.withColumn("common", F.expr(f"aggregate(array_intersect(d, di), 0L, (a, h) -> a + (h & {_WEIGHT}))"))
    leaks = pairs.withColumn("whole", F.expr("weight + wi - common")).where(f"100 * common >= {THRESHOLD} * whole")
    leaks = leaks.withColumn("similarity", F.col("common") / F.col("whole"))
    best = F.max_by(F.struct("start", F.col("m").alias("n_shingles"), "distance", "similarity"), F.struct("similarity", -F.col("start")))
    return leaks.groupBy("doc_id", "th", "item_id").agg(best.alias("b")).select("doc_id", "th", "item_id", "b.*")


def clean_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those that hold a benchmark passage; all columns stay."""
    doc, th = helper("doc"), helper("text")
    leaks = _leaks(docs, benchmark, id_col, text_col, "item_id", "text").select(F.col("doc_id").alias(doc), F.col("th").alias(th)).distinct()
    return docs.join(leaks, docs[id_col].eqNullSafe(F.col(doc)) & (F.xxhash64(docs[text_col]) == F.col(th)), "left_anti")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
