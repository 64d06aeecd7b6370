"""URL block and allow lists as Bloom filter cascades: exact membership without joins.

A rule is a host and a path (``example.net/en/``); it fits the host and its subdomains where the
url's path starts with the rule's. Every url has a bounded set of candidate keys: each suffix of its host
that starts at a label, with each prefix of its path that is as long as some rule's path. A cascade answers
"is this key listed?" for all keys that the corpus has: level 1 holds the listed keys, level 2 the keys of
the corpus that level 1 lets in by mistake, level 3 the listed keys that level 2 lets in, and so on
until a level makes no mistake. Over that universe the answer is exact, and each level is a few
machine words, passed to the executors as a literal. Only a key's own longest rule is looked up at the
end, from the listed keys of its cascade.

Nulls: a null url, or one without ``://``, has an empty host and path and fits no rule. Repeated rows are
judged each by itself. An empty table gives no rows. No rule: every url gets the default verdict. Where a block and an allow rule of
one length fit, the url is allowed. A url of any length is judged whole. Other columns stay, but for those named host, path, rule and verdict, which are
replaced. Levels are as large as their keys need; those of a list of a million keys are a few megabytes.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import Scratch, helper, table

BLOCK = ("net/", "example.com/de/")
ALLOW = ("example.net/en/", "org/fr/")
#: Hash functions of a level.
PROBES = 3


def host_of(url: Column) -> Column:
    return _ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _ascii_lower(x: Column) -> Column:
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def candidate_keys(host: Column, path: Column, path_lengths: list[int]) -> Column:
    """Every key that could list this url, host suffixes with path prefixes of the given lengths."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    prefixes = F.filter(F.array(*[F.lit(n) for n in path_lengths]), lambda n: F.length(path) >= n)
    keys = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda n: F.concat(h, F.substring(path, F.lit(1), n)))))
    return F.when(F.length(host) > 0, keys).otherwise(F.array().cast("array<string>"))


def split_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host, slash + path


def _slots(key: Column, level: int, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level * PROBES + i)), F.lit(bits)) for i in range(PROBES)]


@dataclass(frozen=True)
class Level:
    """The bits of one level, 64 to a word."""

    number: int
    words: tuple[int, ...]

    def has(self, key: Column) -> Column:
        words = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")  # folded to a literal
        hit = [F.getbit(F.get(words, F.shiftright(s, 6).cast("int")), F.pmod(s, F.lit(64)).cast("int")) == 1 for s in _slots(key, self.number, 64 * len(self.words))]
        return reduce(lambda a, b: a & b, hit)


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def has(self, key: Column) -> Column:
        """True for listed keys, false for all other keys of the universe."""
        found: Column = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(self.levels):
            # Not in level k: out of the set it encodes. Odd levels encode listed keys, even ones mistakes.
            found = F.when(~level.has(key), F.lit(level.number % 2 == 0)).otherwise(found)
        return found


def _level(keys: DataFrame, number: int, n: int, rate: float) -> Level:
    """One level over n distinct keys, at about the given rate of mistakes."""
    bits = max(64.0, -PROBES * n / math.log(1 - min(0.9, rate) ** (1 / PROBES)))
    words = 1 << math.ceil(math.log2(bits / 64))
    slots = keys.select(F.explode(F.array(*_slots(F.col("key"), number, 64 * words))).alias("s"))
    set_bits = slots.groupBy(F.shiftright("s", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(s, 64) as int))")).alias("b"))
    filled = [0] * words
    for r in set_bits.collect():  # as many rows as the level has words: a few bytes for each listed key, none for the corpus
        filled[r.w] = r.b
    return Level(number, tuple(filled))


def build_cascade(listed: DataFrame, universe: DataFrame) -> Cascade:
    """A cascade over distinct ``key`` columns; universe need not be without the listed keys."""
    inside = listed.select("key").where("key is not null").distinct()
    n = inside.count()
    if not n:
        return Cascade(())
    outside = universe.select("key").where("key is not null").distinct()
    # The listed keys are few beside the universe; the anti-join is of keys, once, not of rows of the corpus.
    outside = outside.join(inside, "key", "left_anti")
    m = outside.count()
    levels: list[Level] = []
    rate = n / (math.sqrt(2) * max(1, m))  # as short as a cascade gets in all
    while n:
        level = _level(inside, len(levels) + 1, n, rate)
        levels.append(level)
        # What the level takes in by mistake is what the next one encodes.
        inside, outside = outside.where(level.has(F.col("key"))), inside
        n, rate = inside.count(), 0.5
    return Cascade(tuple(levels))


def judge(pages: DataFrame, block: tuple[str, ...] = BLOCK, allow: tuple[str, ...] = ALLOW, url_col: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict; the longest rule that fits wins, else the default holds."""
    spark = pages.sparkSession
    rules = sorted({*block, *allow})
    lengths = sorted({len(split_rule(r)[1]) for r in rules})
    host, path, held, blocking, allowing = map(helper, ("host", "path", "keys", "block", "allow"))
    parts = pages.withColumns({host: host_of(F.col(url_col)), path: path_of(F.col(url_col))})
    keys = candidate_keys(F.col(host), F.col(path), lengths) if lengths else F.array().cast("array<string>")
    scratch = Scratch(spark, "url_keys")
    universe = scratch.keep(parts.select(F.explode(F.array_distinct(keys)).alias("key")).distinct(), "universe")
    frame = lambda xs: spark.createDataFrame([(x,) for x in xs], "key string")
    listed = {"block": build_cascade(frame(block), universe), "allow": build_cascade(frame(allow), universe)}
    scratch.drop("universe")

    def longest(c: Cascade) -> Column:
        # Of the keys that fit one url none are as long as another unless their hosts differ; more host, more key.
        fits = F.filter(F.col(held), lambda k: c.has(k))
        return F.reduce(fits, F.lit(None).cast("string"), lambda a, k: F.when(a.isNull() | (F.length(k) > F.length(a)), k).otherwise(a))

    out = parts.withColumn(held, keys)
    out = out.withColumns({blocking: longest(listed["block"]) if block else F.lit(None).cast("string"), allowing: longest(listed["allow"]) if allow else F.lit(None).cast("string")})
    allowed = F.col(allowing).isNotNull() & (F.col(blocking).isNull() | (F.length(allowing) >= F.length(blocking)))
    blocked = F.col(blocking).isNotNull() & ~allowed
    return out.withColumns({
        "host": F.col(host),
        "path": F.col(path),
        "rule": F.when(allowed, F.col(allowing)).when(blocked, F.col(blocking)),
        "verdict": F.when(allowed, F.lit("allow")).when(blocked, F.lit("block")).otherwise(F.lit(default)),
    }).drop(host, path, held, blocking, allowing)


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


OP6_SQL = r"""
WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
rules(rule, rhost, rpath, act) AS (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
                                          ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
fits AS (SELECT p.page_id, p.host, p.path, r.rule, r.act,
                row_number() OVER (PARTITION BY p.page_id ORDER BY strlen(r.rule) DESC NULLS LAST) AS k
         FROM p LEFT JOIN rules r ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath))
SELECT page_id, host, path, rule, coalesce(act, 'allow') AS verdict FROM fits WHERE k = 1
"""
