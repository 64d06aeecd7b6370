"""Co-trained quality classifier with two views of a document.

The content view sees the text: its hashed words, and how much of it is signs, capitals, or said again. The metadata view sees only what
stands beside the text: source, language and the length field. Both rest on counts of documents by feature and label. The metadata view adds
up the counts' log ratios (naive Bayes); the content view is a logistic regression on labelled rows whose features are weighed by
their log ratios, so that a rare word which one label alone has counts for much.

In each round both views score every document without a label, where it is. What one view is sure of is counted, with that view's label,
for the other, in one grouped aggregation over the whole corpus; then both are fitted anew. On labelled rows that were held out the views' scores are
calibrated (Platt), and in the end the two log odds are added, less the prior that both contain. Held-out rows also set the score from which
documents are kept. The label is 1 for a document of quality that is not toxic.

LABELLED_ROWS bounds the labelled rows that the regression is fitted on (those whose ids have the least hashes); a fifth of them is held out. Nothing else is
sampled. Models are of fixed size, whatever the corpus holds.

Null and empty texts have no words. Null source, language or length is a value of its own. Without labels of both kinds every score is the
share of ones (one half without labels). Repeated rows and rows of one id are scored each by itself, and a label of that id is theirs. Of several labels of one id,
the least holds. A text of any length is one set of bins. Columns besides those named are carried or left out by their names, which helpers avoid. An
empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import Scratch, helper, table

LABELLED_ROWS = 20_000
ROUNDS = 2
SURE = 0.97
#: Kept are documents of the score which this share of held-out good ones reaches: as many toxic ones go as that allows.
KEEP_GOOD = 0.95
#: The cut where no good row is held out.
KEEP_FROM = 0.35
#: Bins of fewer documents have no weight, at any size of the input.
LEAST_ROWS = 3
WORD_BINS, META_BINS = 1 << 16, 1 << 12
STEPS, L2 = 120, 1e-3
_SPLIT = bytes.maketrans(b"#*$%&|<>.,;:!?()[]\"'", b" " * 20)
_VIEWS = (("content", WORD_BINS), ("meta", META_BINS))


@lru_cache(maxsize=200_000)
def _word_bin(word: bytes) -> int:
    return crc32(word) % WORD_BINS


def _grade(x: float) -> int:
    return round(10 * x)


def content_features(text: bytes | None) -> np.ndarray:
    """Bins of the distinct words of a text, lower-cased A-Z and freed of signs, and of its marks."""
    text = text or b""
    words = text.lower().translate(_SPLIT).split()
    distinct, n, lines = set(words), max(1, len(text)), [x for x in text.split(b"\n") if x.strip()]
    signs = n - len(text.translate(None, b"#*$%&|<>!")) if text else 0
    upper = n - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")) if text else 0
    many = max(1, len(words))
    marks = (f"signs={_grade(signs / n)}", f"upper={_grade(upper / n)}", f"new={_grade(len(distinct) / many)}", f"again={_grade(1 - len(set(lines)) / max(1, len(lines)))}", f"word={min(20, round(n / many))}")
    bins = [_word_bin(w) if len(w) <= 64 else crc32(w) % WORD_BINS for w in distinct]
    return np.unique(np.array(bins + [crc32(m.encode()) % WORD_BINS for m in marks], np.int32))


def meta_features(source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    """Bins of a document's source, language and length, and of source and language together."""
    size = None if n_chars is None else int(math.log2(max(1, n_chars)))
    facts = (f"source={source}", f"lang={lang}", f"size={size}", f"both={source} {lang}")
    return np.unique(np.array([crc32(f.encode()) % META_BINS for f in facts], np.int32))


@dataclass(frozen=True)
class View:
    """Weights of bins, whose sum gives log odds, with the two numbers that calibrate them."""

    weights: np.ndarray
    intercept: float
    slope: float = 1.0
    shift: float = 0.0

    def sums(self, bins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Log odds before calibration of rows whose bins stand one after another."""
        upto = np.concatenate([[0.0], np.cumsum(self.weights[bins], dtype=np.float64)])
        return self.intercept + upto[ends[1:]] - upto[ends[:-1]]

    def odds(self, bins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return self.slope * self.sums(bins, ends) + self.shift


def _flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([np.zeros(0, np.int32), *rows]), np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)


def ratios(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Log ratio of each bin's rates in the documents of label 1 and of label 0; bins of few documents have none."""
    found = np.log((counts[1] + 1) / (totals[1] + 2)) - np.log((counts[0] + 1) / (totals[0] + 2))
    return np.where(counts.sum(0) >= LEAST_ROWS, found, 0.0)


def fit_content(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray) -> View:
    """Full-batch Adam on the mean log loss with an L2 penalty; a bin's value is its log ratio."""
    n, (at, ends) = len(rows), _flat(rows)
    owner = np.repeat(np.arange(n), np.diff(ends))
    value = ratio[at]
    at, owner, value = at[value != 0], owner[value != 0], value[value != 0]
    size = len(ratio)
    w, b = np.zeros(size), math.log((y.sum() + 1) / (n - y.sum() + 1))
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for t in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(owner, w[at] * value, n) + b, -30, 30)))
        g = (p - y) / n
        gw, gb = np.bincount(at, g[owner] * value, size) + L2 * w, g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        step = 0.1 * math.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        w -= step * m / (np.sqrt(v) + 1e-9)
        b -= step * mb / (math.sqrt(vb) + 1e-9)
    return View((w * ratio).astype(np.float32), b)


def fit_meta(ratio: np.ndarray, totals: np.ndarray) -> View:
    return View(ratio.astype(np.float32), math.log((totals[1] + 1) / (totals[0] + 1)))


def calibrated(view: View, rows: list[np.ndarray], y: np.ndarray) -> View:
    """The view with Platt's two numbers, fitted to held-out rows by Newton's method."""
    if not 0 < y.sum() < len(y):
        return view
    s = view.sums(*_flat(rows))
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    a, c = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * s + c, -30, 30)))
        h = p * (1 - p) + 1e-9
        g = np.array([((p - target) * s).sum() + 1e-3 * (a - 1), (p - target).sum()])
        step = np.linalg.solve(np.array([[(h * s * s).sum() + 1e-3, (h * s).sum()], [(h * s).sum(), h.sum() + 1e-9]]), g)
        a, c = a - step[0], c - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return View(view.weights, view.intercept, max(a, 0.0), c)


@dataclass(frozen=True)
class CoTrained:
    content: View | None
    meta: View | None
    prior: float  # log odds
    keep_from: float = KEEP_FROM

    def score(self, content: tuple[np.ndarray, np.ndarray], meta: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities by the content view, by the metadata view and by both, of rows given as bins and ends."""
        n = len(content[1]) - 1
        if self.content is None or self.meta is None:
            return (np.full(n, 1 / (1 + math.exp(-self.prior))),) * 3
        a, b = self.content.odds(*content), self.meta.odds(*meta)
        return tuple(_probability(x) for x in (a, b, a + b - self.prior))


def _probability(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def cut(model: CoTrained, content: list[np.ndarray], meta: list[np.ndarray], y: np.ndarray) -> float:
    """The score that KEEP_GOOD of the good among held-out rows reach."""
    good = np.sort(model.score(_flat(content), _flat(meta))[2][y == 1])
    return float(good[math.floor((1 - KEEP_GOOD) * len(good))]) if len(good) else KEEP_FROM


def featured(docs: DataFrame, *keep: str) -> DataFrame:
    """The kept columns with the bins of both views."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").cast(pa.large_binary()).to_pylist()
            content = [content_features(t) for t in texts]
            meta = [meta_features(*x) for x in zip(*(b.column(c).to_pylist() for c in ("source", "lang", "n_chars")), strict=True)]
            kinds = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(content, kinds), pa.array(meta, kinds)], [*keep, "content", "meta"])

    kept = "".join(f"{k} {docs.schema[k].dataType.simpleString()}, " for k in keep)
    return docs.select(*keep, "text", "source", "lang", "n_chars").mapInArrow(read, f"{kept}content array<int>, meta array<int>")


def _bins(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    ends = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy()[ends[0] : ends[-1]], ends - ends[0]


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with y: the label of rows that are fitted on, plus two of rows that are held out, null of all others."""
    good = ((F.coalesce("quality", F.lit(1)) == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("int")
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_l")).agg(F.min(F.when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), good)).alias("_y")).where("_y is not null")
    chosen = known.orderBy(F.xxhash64("_l"), "_l").limit(LABELLED_ROWS)  # a bounded table
    held = F.when(F.pmod(F.xxhash64("_l", F.lit(1)), F.lit(5)) == 0, 2).otherwise(0)
    chosen = chosen.select("_l", (F.col("_y") + held).cast("int").alias("y"))
    return docs.select("doc_id", "text", "source", "lang", "n_chars").join(F.broadcast(chosen), F.col("doc_id").cast("long") == F.col("_l"), "left").drop("_l")


def _counts(features: DataFrame, views: list[View] | None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each view its bins' and all counts of documents by label: of fitted rows, and of those without label that the other view is sure of."""
    shared = features.sparkSession.sparkContext.broadcast(views)  # of fixed size

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros((2, size + 1), np.int64) for _, size in _VIEWS]
        for b in batches:
            y = b.column("y").fill_null(-1).to_numpy().copy()
            sides = [_bins(b.column(name)) for name, _ in _VIEWS]
            given = [np.where(y > 1, -1, y) for _ in sides]
            if shared.value is not None:
                for k, view in enumerate(shared.value):
                    p = _probability(view.odds(*sides[k]))
                    given[1 - k] = np.where(y >= 0, given[1 - k], np.where(p >= SURE, 1, np.where(p <= 1 - SURE, 0, -1)))
            for (bins, ends), label, n in zip(sides, given, held, strict=True):
                of = np.repeat(label, np.diff(ends))
                for value in (0, 1):
                    n[value, :-1] += np.bincount(bins[of == value], minlength=n.shape[1] - 1)
                    n[value, -1] += (label == value).sum()
        for k, n in enumerate(held):
            at = np.flatnonzero(n.sum(0))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k), pa.int32()), pa.array(at, pa.int32()), pa.array(n[0, at]), pa.array(n[1, at])], ["view", "bin", "n0", "n1"])

    sums = features.select("y", "content", "meta").mapInArrow(count, "view int, bin int, n0 long, n1 long").groupBy("view", "bin").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    found = [np.zeros((2, size + 1), np.int64) for _, size in _VIEWS]
    t = sums.toArrow()  # a row a bin at most
    view, at = t["view"].to_numpy(), t["bin"].to_numpy()
    for k, n in enumerate(found):
        n[:, at[view == k]] = np.stack([t["n0"].to_numpy(), t["n1"].to_numpy()])[:, view == k]
    return [(n[:, :-1], n[:, -1]) for n in found]


def fit_features(features: DataFrame, rounds: int = ROUNDS) -> CoTrained:
    """features (y, content, meta, ...) of all documents."""
    rows = features.where("y is not null").select("y", "content", "meta").orderBy(F.xxhash64("content", "meta"), "y").limit(2 * LABELLED_ROWS).toArrow()
    y = rows["y"].to_numpy().astype(int) if rows.num_rows else np.zeros(0, int)
    bins = lambda k: [np.asarray(x.values, np.int32) for x in rows[k]]
    content, meta = bins("content"), bins("meta")
    held, y = y > 1, (y % 2).astype(float)
    prior = math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    if not 0 < y[~held].sum() < (~held).sum():
        return CoTrained(None, None, prior)
    pick = lambda xs, mask: [x for x, m in zip(xs, mask, strict=True) if m]
    views = None
    for _ in range(rounds + 1):
        of_content, of_meta = _counts(features, views)
        fitted = [fit_content(pick(content, ~held), y[~held], ratios(*of_content)), fit_meta(ratios(*of_meta), of_meta[1])]
        views = [calibrated(f, pick(x, held), y[held]) for f, x in zip(fitted, (content, meta), strict=True)]
    model = CoTrained(*views, prior)
    return replace(model, keep_from=cut(model, pick(content, held), pick(meta, held), y[held]))


def fit(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS) -> CoTrained:
    """docs (doc_id, text, source, lang, n_chars) and labels (doc_id, quality, toxic)."""
    return fit_features(Scratch(docs.sparkSession, "quality").keep(featured(labelled(docs, labels), "y"), "features"), rounds)


def score_features(features: DataFrame, model: CoTrained, *keep: str) -> DataFrame:
    """The kept columns with p_content, p_meta and score of every row of features."""
    shared = features.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = shared.value.score(_bins(b.column("content")), _bins(b.column("meta")))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), *map(pa.array, found)], [*keep, "p_content", "p_meta", "score"])

    kept = "".join(f"{k} {features.schema[k].dataType.simpleString()}, " for k in keep)
    return features.select(*keep, "content", "meta").mapInArrow(read, f"{kept}p_content double, p_meta double, score double")


def score(docs: DataFrame, model: CoTrained, id_col: str = "doc_id") -> DataFrame:
    """id, p_content, p_meta, score for every row."""
    key = helper("id")
    return score_features(featured(docs.withColumn(key, F.col(id_col)), key), model, key).withColumnRenamed(key, id_col)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = labelled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    features = Scratch(spark, "quality").keep(featured(docs, "doc_id", "y"), "features")
    model = fit_features(features)
    out = score_features(features, model, "doc_id")
    return out.select("doc_id", *(F.round(c, 6).alias(c) for c in ("p_content", "p_meta", "score")), (F.col("score") >= model.keep_from).alias("kept"))
