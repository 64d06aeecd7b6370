"""Quality rules as a short-circuit cascade.

Each rule reads lazily computed figures of one text. On a bounded, hash-spread sample the cascade
measures what each rule costs and how often it rejects, then runs the rules by rejections per cost:
a text that a rule rejects costs nothing in the rules behind it. The verdict is the same in any order.

A text that is null or has no words has zero for every figure and fails ``few_words``. Ids may repeat
or be null; each row is judged by itself, repeated rows alike. A text of any length is judged whole, by one worker. Rules that
reject as much for their cost run in the order of their cost, then as they are listed. An empty table gives no rows, in the rules' own order. Columns besides id
and text, whatever their names, are carried along untouched by :meth:`Cascade.filter`.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import hashed_sample, table

#: Rows that the order of the rules is estimated on.
SAMPLE_ROWS = 1000
WINDOW = 8
_SYMBOLS = b"#*$%&|<>"
_SPACES = b" \t\n\r\x0b\x0c"
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class TextFigures:
    """Figures of one text (UTF-8), each computed when first asked for."""

    def __init__(self, text: bytes | None):
        self.text = text or b""

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.split()  # bytes are split at ASCII white space only

    @cached_property
    def joined(self) -> bytes:
        return b"".join(self.words)

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.joined) if self.joined.isascii() else len(self.joined.decode("utf-8", "replace"))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.text) - len(self.text.translate(None, _SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        """Lines with a word."""
        return [x for x in self.text.split(b"\n") if x.strip(_SPACES)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def upper_share(self) -> float:
        upper = len(self.joined) - len(self.joined.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        return upper / max(1, len(self.joined))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside windows of eight words that are found twice or more, the first time included."""
        n = self.n_words
        if n <= WINDOW:
            return 0
        h = np.fromiter(map(hash, self.words), np.int64, n).view(np.uint64)
        z = h[: n - WINDOW + 1].copy()
        for k in range(1, WINDOW):
            z *= _MULTIPLIER
            z += h[k : n - WINDOW + 1 + k]
        order = np.argsort(z, kind="stable")
        same = z[order[1:]] == z[order[:-1]]
        if not same.any():
            return 0
        twice = np.zeros(len(z), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        cover = np.zeros(n + 1, np.int64)
        starts = np.flatnonzero(twice)
        np.add.at(cover, starts, 1)
        np.add.at(cover, starts + WINDOW, -1)
        return int((np.cumsum(cover)[:n] > 0).sum())


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[TextFigures], bool]


def few_words(x: TextFigures) -> bool:
    return x.n_words < 20


def repeated_windows(x: TextFigures) -> bool:
    return 100 * x.n_repeat_words > 30 * x.n_words


def symbols(x: TextFigures) -> bool:
    return 2 * x.n_symbols > 3 * x.n_words


def shouting(x: TextFigures) -> bool:
    return x.upper_share > 0.6


def repeated_lines(x: TextFigures) -> bool:
    return 2 * x.n_dup_lines > len(x.lines) and x.n_dup_lines > 2


def odd_word_length(x: TextFigures) -> bool:
    return x.n_words > 0 and not 2 <= x.word_chars / x.n_words <= 25


BASE = (Rule("few_words", few_words), Rule("repeated_windows", repeated_windows))
RULES = (*BASE, Rule("symbols", symbols), Rule("shouting", shouting), Rule("repeated_lines", repeated_lines), Rule("odd_word_length", odd_word_length))


@dataclass(frozen=True)
class Cascade:
    """Rules in the order they run, with what the sample said of each: (name, seconds a text, share rejected)."""

    rules: tuple[Rule, ...]
    estimates: tuple[tuple[str, float, float], ...] = field(default=())

    @classmethod
    def fit(cls, docs: DataFrame, rules: tuple[Rule, ...] = RULES, rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Cascade:
        """Order the rules by rejections per second on ``rows`` texts. They are measured where they are; a few sums a rule come to the driver."""

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts = b.column(0).cast(pa.large_binary()).to_pylist()
                found = []
                for rule in rules:
                    began = time.process_time()
                    rejected = sum(rule.rejects(TextFigures(x)) for x in texts)
                    found.append((rule.name, time.process_time() - began, rejected, len(texts)))
                kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], ["name", "s", "rejected", "n"])

        sample = hashed_sample(docs.select(id_col, text_col), id_col, rows).select(text_col)
        sums = sample.mapInArrow(measure, "name string, s double, rejected long, n long").groupBy("name").agg(*(F.sum(c).alias(c) for c in ("s", "rejected", "n")))
        of = {r.name: (max(r.s, 1e-9) / max(1, r.n), r.rejected / max(1, r.n)) for r in sums.collect()}
        found = [(rule, *of.get(rule.name, (1.0, 0.0))) for rule in rules]
        found.sort(key=lambda f: (-f[2] / f[1], f[1]))
        return cls(tuple(f[0] for f in found), tuple((f[0].name, f[1], f[2]) for f in found))

    def verdict(self, x: TextFigures) -> str | None:
        """The first rule that rejects, or None."""
        return next((r.name for r in self.rules if r.rejects(x)), None)

    def filter(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """The rows that no rule rejects, with all their columns."""
        rules = self.rules

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            judge = Cascade(rules)
            for b in batches:
                texts = b.column(text_col).cast(pa.large_binary()).to_pylist()
                yield b.filter(pa.array([judge.verdict(TextFigures(x)) is None for x in texts], pa.bool_()))

        return docs.mapInArrow(keep, docs.schema)

    def judge(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Figures and verdict of every row; rejected_by names the first rule that rejects in this cascade's order."""
        rules = self.rules
        schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, rejected_by string"

        def figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cascade = Cascade(rules)
            for b in batches:
                rows = []
                for text in b.column(text_col).cast(pa.large_binary()).to_pylist():
                    x = TextFigures(text)
                    by = cascade.verdict(x)
                    base = any(r.rejects(x) for r in BASE)
                    rows.append((x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, base, by is None and not base, by))
                cols = list(zip(*rows, strict=True)) if rows else [()] * 8
                kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [b.column(id_col), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                    [id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by"],
                )

        return docs.select(id_col, text_col).mapInArrow(figures, schema)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return Cascade.fit(docs).judge(docs).drop("rejected_by")


#: The same figures and verdict, set-wise; windows are compared as lists of words.
OP9_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM d),
f AS (SELECT doc_id, ws, len(ws)::BIGINT AS n_words, len(ls)::BIGINT AS n_lines,
             length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
             strlen(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_bytes,
             strlen(regexp_replace(t, '[^A-Z]+', '', 'g'))::BIGINT AS upper_chars,
             strlen(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines FROM w),
x AS (SELECT doc_id, p, list_slice(ws, p, p + 7) AS win FROM f, unnest(range(1, n_words - 6)) AS u(p) WHERE n_words >= 8),
r AS (SELECT doc_id, p FROM x QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
c AS (SELECT doc_id, count(DISTINCT p + k)::BIGINT AS n FROM r, unnest(range(0, 8)) AS v(k) GROUP BY 1),
g AS (SELECT f.*, coalesce(c.n, 0) AS n_repeat_words FROM f LEFT JOIN c USING (doc_id)),
h AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM g)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 2 * n_symbols > 3 * n_words OR upper_chars > 0.6 * greatest(1, word_bytes)
            OR (2 * n_dup_lines > n_lines AND n_dup_lines > 2)
            OR (n_words > 0 AND NOT (word_chars / n_words BETWEEN 2 AND 25))) AS kept
FROM h
"""
