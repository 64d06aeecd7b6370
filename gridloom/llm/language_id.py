"""Language identification by Bayesian fusion of evidence.

For each record the log odds of the languages are summed from

* the text: a naive Bayes model over hashed character trigrams, trained on labelled documents. Documents are dealt into two halves by a
  hash of their text, and a document is judged by the model of the other half; pages are judged by both. Trigrams of one text hang
  together, so its log likelihood is tempered and limited;
* the language that the markup declares (``<html lang=...>``, its two or three letters), weighed by how often pages with that declaration have such text;
* the address suffix (the host's last label), weighed likewise;
* a prior of the host, smoothed towards that of its parent domain, which is smoothed towards the whole corpus. Priors and weights are sums of text
  posteriors in grouped aggregations over all records; a record's own share is taken out of each before it is used.

Records are documents (their source stands in for the host, and nothing is declared) and pages. Both have one row each in the result.

Null and empty texts have even odds from the text; a missing declaration, host or suffix adds nothing. Without labelled documents
there are no languages, and lang is null. Repeated rows are judged alike, each by itself. Of languages with equal odds the first in
alphabetical order is named. A text of any length is judged whole, as counts of 16,384 bins; the model has that many numbers a language and half.
Columns besides doc_id, text, lang, source, page_id, url and html are not read. Empty tables give no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import Scratch, table

BINS = 1 << 14
#: Trigrams' log likelihood counts by this factor, and no language gets further ahead by it than the limit.
TEMPER, LIMIT = 0.15, 12.0
#: Records that a parent's prior counts for.
SMOOTHING = 5.0
HALVES = 2
_M = np.uint64(0x9E3779B97F4A7C15)
_SKIP = re.compile(r"(?is)<(script|style|nav|head)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")


def trigrams(text: str | None) -> np.ndarray:
    """Bins of a text's character trigrams, lower-cased."""
    c = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    if len(c) < 3:
        return np.zeros(0, np.int64)
    z = ((c[:-2] * np.uint64(0x110000) + c[1:-1]) * np.uint64(0x110000) + c[2:]) * _M
    return (z >> np.uint64(50)).astype(np.int64)


def visible(html: str | None) -> str:
    """What a page shows, without navigation."""
    return re.sub(r"\s+", " ", _SKIP.sub(" ", html or "")).strip()


def half(text: str | None) -> int:
    """The half of the corpus that a text is in, by a hash."""
    return crc32((text or "").encode("utf-8", "replace")) % HALVES


def train(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and, for each half, the log likelihoods of their bins in the other half, then those in the whole, from all rows of labelled (text, lang)."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], np.ndarray] = {}
        for b in batches:
            for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
                if lang is not None:
                    held.setdefault((lang, k := half(text)), np.zeros(BINS, np.int64))
                    held[lang, k] += np.bincount(trigrams(text), minlength=BINS)
        for (lang, k), n in held.items():
            at = np.flatnonzero(n)
            # A language of which only empty texts are known is one as well.
            at = at if len(at) else np.zeros(1, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(np.full(len(at), k), pa.int32()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], ["lang", "half", "bin", "n"])

    scratch = Scratch(labelled.sparkSession, "language_id")
    sums = labelled.select("text", "lang").mapInArrow(counted, "lang string, half int, bin int, n long").groupBy("lang", "half", "bin").agg(F.sum("n").alias("n"))
    rows = scratch.keep(sums, "trigrams").toArrow().to_pydict()  # languages x halves x bins at most
    scratch.drop("trigrams")
    languages = sorted(set(rows["lang"]))
    number = {x: k for k, x in enumerate(languages)}
    counts = np.zeros((HALVES, len(languages), BINS))
    np.add.at(counts, (rows["half"], [number[x] for x in rows["lang"]], rows["bin"]), rows["n"])
    whole = counts.sum(0)
    models = np.stack([*(whole - counts[k] for k in range(HALVES)), whole]) + 0.5
    return languages, np.log(models / models.sum(2, keepdims=True)).transpose(0, 2, 1).astype(np.float32)


def text_posteriors(records: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """records (kind, id, text, html, host) with declared, and lp, the log odds of the text by language."""
    shared = records.sparkSession.sparkContext.broadcast(model)  # languages x BINS x (HALVES + 1) numbers

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, logs = shared.value
        for b in batches:
            found = []
            for text, html in zip(b.column("text").to_pylist(), b.column("html").to_pylist(), strict=True):
                of = logs[HALVES] if html is not None else logs[half(text)]
                score = TEMPER * of[trigrams(visible(html) if html is not None else text)].sum(0, dtype=np.float64)
                score = np.maximum(score - score.max(), -LIMIT)
                found.append(score - math.log(np.exp(score).sum()))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in ("kind", "id", "host", "declared")), pa.array(found, pa.list_(pa.float64()))], ["kind", "id", "host", "declared", "lp"])

    declared = F.lower(F.nullif(F.regexp_extract("html", r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})(?![a-z])", 1), F.lit("")))
    return records.withColumn("declared", declared).mapInArrow(judge, "kind string, id long, host string, declared string, lp array<double>")


def _sums(n: int) -> list[Column]:
    return [F.sum(F.col("w")[k]).alias(f"s{k}") for k in range(n)]


def _again(n: int) -> list[Column]:
    return [F.sum(f"s{k}").alias(f"s{k}") for k in range(n)]


def _array(n: int, name: str) -> Column:
    return F.array(*[F.col(f"s{k}") for k in range(n)]).alias(name)


def fuse(judged: DataFrame, n: int) -> DataFrame:
    """judged (kind, id, host, declared, lp) with post, the fused posteriors of the n languages."""
    parts = F.split("host", r"\.")
    rows = judged.withColumns({
        "w": F.transform("lp", F.exp),
        "parent": F.when(F.size(parts) > 2, F.array_join(F.slice(parts, -2, 2), ".")).otherwise(F.col("host")),
        "suffix": F.when(F.size(parts) > 1, F.element_at(parts, -1)),
    })
    # Hosts, then parents and suffixes, are summed from one another; a host with any share of the rows is one partial sum a task.
    hosts = rows.where("host is not null").groupBy("kind", "suffix", "parent", "host").agg(*_sums(n))
    parents = hosts.groupBy("kind", "parent").agg(*_again(n))
    whole = parents.groupBy("kind").agg(*_again(n)).select("kind", _array(n, "all"))
    index = F.sequence(F.lit(0), F.lit(n - 1))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    up = parents.join(whole, "kind").select("kind", "parent", _array(n, "_p"), "all")
    host = hosts.join(up, ["kind", "parent"]).select(F.col("kind").alias("_k"), F.col("host").alias("_h"), _array(n, "_s"), "_p", F.col("all").alias("_a"))
    out = rows.join(host, (F.col("kind") == F.col("_k")) & (F.col("host") == F.col("_h")), "left")
    values = {"declared": rows.where("declared is not null").groupBy("kind", "declared").agg(*_sums(n)), "suffix": hosts.where("suffix is not null").groupBy("kind", "suffix").agg(*_again(n))}
    for key, seen in values.items():
        every = seen.groupBy("kind").agg(*_again(n)).select("kind", _array(n, f"_t_{key}"))
        sums = seen.select("kind", key, _array(n, f"_v_{key}")).join(every, "kind")
        sums = sums.select(F.col("kind").alias(f"_k_{key}"), F.col(key).alias(f"_{key}"), f"_v_{key}", f"_t_{key}")
        out = out.join(sums, (F.col("kind") == F.col(f"_k_{key}")) & (F.col(key) == F.col(f"_{key}")), "left")

    # Without the record's own text, which is counted already.
    less = lambda a: F.transform(index, lambda k: F.greatest(F.get(a, k) - F.get("w", k), F.lit(0.0)))

    def smoothed(level: str, above: str) -> Column:
        return F.transform(index, lambda k: (F.get(level, k) + SMOOTHING * F.get(above, k)) / (total(level) + SMOOTHING))

    def weight(key: str) -> Column:
        """log P(value | language) - log P(value), smoothed; nothing for a record without one."""
        v, t = f"_v_{key}", f"_t_{key}"
        share = (total(v) + 1e-3) / (total(t) + 0.5)
        found = F.transform(index, lambda k: F.log((F.get(v, k) + 0.5 * share + 1e-3) / (F.get(t, k) + 0.5)) - F.log(share))
        return F.when(F.col(v).isNotNull(), found).otherwise(F.array_repeat(F.lit(0.0), n))

    own = ["_s", "_p", "_a", *(f"_{x}_{key}" for key in values for x in "vt")]
    out = out.withColumns({c: less(c) for c in own})
    even = F.array_repeat(F.lit(1.0 / n), n)
    out = out.withColumn("_a", F.transform(index, lambda k: (F.get("_a", k) + SMOOTHING / n) / (total("_a") + SMOOTHING)))
    out = out.withColumn("_p", smoothed("_p", "_a")).withColumn("_prior", F.coalesce(smoothed("_s", "_p"), even))
    out = out.withColumns({f"_w_{key}": weight(key) for key in values})
    out = out.withColumn("_log", F.transform(index, lambda k: F.get("lp", k) + F.log(F.greatest(F.get("_prior", k), F.lit(1e-12))) + F.get("_w_declared", k) + F.get("_w_suffix", k)))
    out = out.withColumn("_e", F.transform("_log", lambda x: F.exp(x - F.array_max("_log"))))
    return out.withColumn("post", F.transform("_e", lambda x: x / F.aggregate("_e", F.lit(0.0), lambda a, y: a + y))).select("kind", "id", "host", "declared", "lp", "post")


def records_of(docs: DataFrame, pages: DataFrame) -> DataFrame:
    d = docs.select(F.lit("document").alias("kind"), F.col("doc_id").cast("long").alias("id"), "text", F.lit(None).cast("string").alias("html"), F.lower("source").alias("host"))
    host = F.lower(F.nullif(F.regexp_extract("url", r"(?s)^.*?://([^/?#:]*)", 1), F.lit("")))
    p = pages.select(F.lit("page").alias("kind"), F.col("page_id").cast("long").alias("id"), F.lit(None).cast("string").alias("text"), F.coalesce("html", F.lit("")).alias("html"), host.alias("host"))
    return d.union(p)


def identify(docs: DataFrame, pages: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """kind, id, lang, probability, text_lang, declared for every document and page; labelled (text, lang) is docs by default."""
    spark = docs.sparkSession
    model = train(docs if labelled is None else labelled)
    languages = model[0]
    if not languages:
        return records_of(docs, pages).select("kind", "id", *(F.lit(None).cast(t).alias(c) for c, t in (("lang", "string"), ("probability", "double"), ("text_lang", "string"), ("declared", "string"))))
    judged = Scratch(spark, "language_id").keep(text_posteriors(records_of(docs, pages), model), "judged")
    names = F.array(*map(F.lit, languages))
    best = lambda a: F.get(names, (F.array_position(a, F.array_max(a)) - 1).cast("int"))
    return fuse(judged, len(languages)).select("kind", "id", best("post").alias("lang"), F.array_max("post").alias("probability"), best("lp").alias("text_lang"), "declared")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = identify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages"))
    of = lambda kind: F.when(F.col("kind") == kind, F.col("id"))
    return out.select(of("document").alias("doc_id"), of("page").alias("page_id"), "lang", F.round("probability", 6).alias("probability"), "text_lang", "declared")
