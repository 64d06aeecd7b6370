"""Mixing to target weights by soft membership.

A classifier learned from a labelled table gives every document a posterior over the domains: Bayes over the presence of
telling words and over the document's own attributes. Every word or attribute of three labelled rows or more
whose rate in one domain is far from its rate in the others is used; there is no limit to their number. With t tokens and posterior p a document adds r * t * p to
the expected token totals of the domains, at rate r. Projected gradient descent fits the rates, nonnegative, so
that the totals match the targets in the least squares sense; a step needs the documents' sums by domain, one
aggregation, and the rates are updated where the documents are. Written out, a rate after k steps depends on k
residual vectors of as many numbers as there are domains; these alone go through the driver.

The targets are a share of tokens for each domain, of a total that no domain has to shrink for; so rates start at
one and mostly grow. A step goes along the residual as the inverse Gram matrix of the domains weighs it, over the documents that the
last step did not cut off at the least rate; so rare domains are as quick as common ones, and few steps do. Whole copies are made of a rate by rounding it up or down by a hash of the document, which
keeps the expected totals.

All of it is built-in functions. Domains are what the labelled table says of a document: ``toxic``, ``low`` (quality 0) and
``good``. A document's tokens are its words at ASCII white space.

Nulls and empty texts have no tokens: their rate stays one and adds nothing. Without labelled rows all posteriors are
equal. A domain of which nobody is expected to hold a token is left out of the targets, and the others share its part.
Repeated rows are fitted like others. Rows with a null id are kept. A text of any length is one set of words. Equal rates are rounded by the hash of id and
text, so equal rows alike. Columns, whatever their names, are carried along as they are. A rate has no upper bound: if a domain is rare, its few documents
are written as often as its target takes. Fits that do not reach the targets end with a warning that says what they reached.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import Scratch, helper, table

DOMAINS = ("good", "low", "toxic")
#: Token shares asked for. They are near what the labelled table has, as an example that changes every domain: poor and toxic documents are no more than they are
#: by nature. A corpus to be trained on without them has other targets, and ``least`` 0.
TARGETS = {"good": 0.78, "low": 0.10, "toxic": 0.12}
#: Labelled rows that the classifier is fitted on, about (evenly spread by a hash of the id).
LABELLED_ROWS = 20_000
#: Features of so many labelled rows are told from chance; as many rows as SHRINK, at the rate of all domains, are added to each domain.
LEAST_ROWS, SHRINK = 3, 2.0
#: Up to so many features are broadcast; more are joined by a shuffle. None is left out.
BROADCAST_FEATURES = 500_000
#: Steps after which a fit that has not come to its targets is given up with a warning; each is a pass over the documents' tokens and posteriors.
STEPS = 60
STEPS_A_TABLE = 10
#: The fit is done when no domain is further from its target than this share of all tokens; it is given up as well when PATIENCE steps have not brought the
#: sum of squares down by a hundredth.
CLOSE = 1e-5
PATIENCE = 8
_SPLIT = r"[^\p{L}]+"


def _token_count(text: Column) -> Column:
    """Words at ASCII white space."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _marks(text: Column) -> list[Column]:
    """Attributes of a text that count as words of their own: how much of it is signs, and how much is capitals."""
    n = F.greatest(F.length(text), F.lit(1))
    share = lambda others: F.round(10 * F.length(F.regexp_replace(text, others, "")) / n).cast("int").cast("string")
    return [F.concat(F.lit("signs:"), share(r"[^#*$%&|<>!]+")), F.concat(F.lit("capitals:"), share(r"[^A-Z]+"))]


def _domain() -> Column:
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), "good")


def _features(text: Column) -> Column:
    """The distinct lower-cased words of a text, and its marks."""
    return F.array_union(F.array_distinct(F.split(F.lower(text), _SPLIT)), F.array(*_marks(text)))


def fit_classifier(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> tuple[dict[str, float], DataFrame]:
    """Log priors by domain, and for each telling feature f the log ratios (w, in the order of DOMAINS) of its rate in a domain to its rate in all."""
    spark = docs.sparkSession
    labelled = labels.select(F.col("doc_id").cast("long").alias("_l"), _domain().alias("domain")).where("_l is not null and domain is not null").dropDuplicates(["_l"])
    docs = docs.select("doc_id", "text")
    every = max(1, labelled.count() // rows)
    spread = lambda c: F.pmod(F.xxhash64(c), F.lit(every)) == 0
    labelled, docs = labelled.where(spread("_l")), docs.where(spread(F.col("doc_id").cast("long")))  # only those are shuffled
    text = F.coalesce(F.col("text"), F.lit(""))
    known = docs.join(labelled, docs["doc_id"] == F.col("_l")).select("domain", text.alias("text"))
    scratch = Scratch(spark, "mixing")
    known = scratch.keep(known.select("domain", _features(F.col("text")).alias("f")), "labelled")
    sizes = {r.domain: r.n for r in known.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    if not total:
        return dict.fromkeys(DOMAINS, -math.log(len(DOMAINS))), spark.createDataFrame([], "f string, w array<double>")
    held = known.select("domain", F.explode_outer("f").alias("f")).where("f <> ''").groupBy("f").agg(F.count("*").alias("n"), *(F.count_if(F.col("domain") == d).alias(d) for d in DOMAINS))
    rate = {d: (F.col(d) + 0.5) / (sizes.get(d, 0) + 1.0) for d in DOMAINS}
    rest = {d: (F.col("n") - F.col(d) + 0.5) / (total - sizes.get(d, 0) + 1.0) for d in DOMAINS}
    telling = held.where(F.col("n") >= LEAST_ROWS).where(F.greatest(*[F.abs(F.log(rate[d] / rest[d])) for d in DOMAINS]) > 1.5)
    # A word of few rows says little, however they are dealt over the domains.
    weights = F.array(*[F.log((F.col(d) + SHRINK) / (F.col("n") * (sizes.get(d, 0) / total) + SHRINK)) for d in DOMAINS])
    priors = {d: math.log((sizes.get(d, 0) + 1) / (total + len(DOMAINS))) for d in DOMAINS}
    return priors, scratch.keep(telling.select("f", weights.alias("w")), "features")


def posteriors(docs: DataFrame, priors: dict[str, float], features: DataFrame, text_col: str = "text") -> DataFrame:
    """docs, whose text gives way to tokens and p, the array of posteriors in the order of DOMAINS; a row each."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    kept = [c for c in docs.columns if c != text_col]
    # Each row has its marks at least, so none is lost; repeated rows are told apart by their number.
    numbered = docs.select(*kept, F.monotonically_increasing_id().alias("_row"), _token_count(text).alias("tokens"), _features(text).alias("_f"))
    words = numbered.select(*kept, "_row", "tokens", F.explode("_f").alias("f"))
    if features.count() <= BROADCAST_FEATURES:
        features = F.broadcast(features)
    keys = ["_row", *kept, "tokens"]
    sums = words.join(features, "f", "left").groupBy(*keys).agg(*(F.coalesce(F.sum(F.col("w")[k]), F.lit(0.0)).alias(f"_s{k}") for k in range(len(DOMAINS))))
    found = sums.withColumn("_log", F.array(*[F.lit(priors[d]) + F.col(f"_s{k}") for k, d in enumerate(DOMAINS)]))
    found = found.withColumn("_log", F.transform("_log", lambda x: F.exp(x - F.array_max("_log"))))
    return found.select(*kept, "tokens", F.transform("_log", lambda x: x / F.aggregate("_log", F.lit(0.0), lambda a, y: a + y)).alias("p"))


def fit_rates(members: DataFrame, targets: dict[str, float] = TARGETS, least: float = 0.0, steps: int = STEPS) -> tuple[DataFrame, list[float]]:
    """members (tokens, p, ...) with rate, none under ``least``, and the token totals asked for, in the order of DOMAINS."""
    scratch = Scratch(members.sparkSession, "mixing")
    n = len(DOMAINS)
    mass = [F.col("tokens") * F.col("p")[k] for k in range(n)]
    sums = members.agg(*(F.sum(m).alias(f"s{k}") for k, m in enumerate(mass)), *(F.sum(mass[j] * mass[k]).alias(f"q{j}{k}") for j in range(n) for k in range(j, n))).first()
    now = [sums[f"s{k}"] or 0.0 for k in range(n)]
    share = [targets[d] if x > 0 else 0.0 for d, x in zip(DOMAINS, now, strict=True)]
    whole = max((x / w for x, w in zip(now, share, strict=True) if w > 0), default=0.0)
    want = [whole * w for w in share]
    gram = [[sums[f"q{min(j, k)}{max(j, k)}"] or 0.0 for k in range(n)] for j in range(n)]
    trace = sum(gram[k][k] for k in range(n))
    free, raw = helper("free"), helper("raw")
    rates, made, held = members.withColumns({"rate": F.lit(1.0), free: F.lit(True)}), list(now), gram
    taken, squares = 0, []
    while True:
        residual = [w - m for w, m in zip(want, made, strict=True)]
        squares.append(sum(x * x for x in residual))
        close = max(map(abs, residual), default=0.0) <= CLOSE * max(1.0, whole)
        stuck = len(squares) > PATIENCE and min(squares[-PATIENCE:]) > 0.99 * min(squares[:-PATIENCE])
        if close or stuck or taken >= steps:
            break
        inverse = _inverse([[held[j][k] + 1e-3 * gram[j][k] + (1e-9 * trace + 1e-9 if j == k else 0.0) for k in range(n)] for j in range(n)])
        push = [sum(inverse[j][k] * residual[k] for k in range(n)) for j in range(n)]
        taken += 1
        rates = rates.withColumn(raw, F.col("rate") + sum((mass[k] * F.lit(push[k]) for k in range(n)), F.lit(0.0)))
        rates = rates.withColumns({"rate": F.greatest(F.lit(float(least)), raw), free: F.col(raw) > least}).drop(raw)
        if taken % STEPS_A_TABLE == 0:
            rates = scratch.keep(rates, f"rates_{taken}")
            scratch.drop(f"rates_{taken - STEPS_A_TABLE}")
        of_free = [F.sum(F.when(F.col(free), mass[j] * mass[k])).alias(f"q{j}{k}") for j in range(n) for k in range(j, n)]
        sums = rates.agg(*(F.sum(F.col("rate") * m).alias(f"s{k}") for k, m in enumerate(mass)), *of_free).first()
        made = [sums[f"s{k}"] or 0.0 for k in range(n)]
        held = [[sums[f"q{min(j, k)}{max(j, k)}"] or 0.0 for k in range(n)] for j in range(n)]
    if not close:
        warnings.warn(f"after {taken} steps the domains {DOMAINS} have {made} expected tokens; {want} were asked for", stacklevel=2)
    return rates.drop(free), want


def _inverse(a: list[list[float]]) -> list[list[float]]:
    """The inverse of a small positive definite matrix, by elimination."""
    n = len(a)
    m = [[*row, *(float(i == j) for j in range(n))] for i, row in enumerate(a)]
    for i in range(n):
        pivot = m[i][i]
        m[i] = [x / pivot for x in m[i]]
        for j in range(n):
            if j != i:
                m[j] = [x - m[j][i] * y for x, y in zip(m[j], m[i], strict=True)]
    return [row[n:] for row in m]


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, least: float = 0.0) -> DataFrame:
    """docs with tokens, p, rate and copies (rate rounded up or down by a hash of id and text)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    priors, features = fit_classifier(docs, labels)
    keyed = docs.select("doc_id", F.xxhash64("text").alias("_h"), "text")
    members = scratch.keep(posteriors(keyed, priors, features), "members")
    rates, _ = fit_rates(members, targets, least)
    part = F.pmod(F.xxhash64("doc_id", "_h"), F.lit(1 << 32)) / float(1 << 32)
    return rates.withColumn("copies", (F.floor("rate") + F.when(part < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("long"))


def mixed_documents(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, least: float = 1.0) -> DataFrame:
    """docs with each row as often as its copies say; columns stay. With ``least`` of one no document is lost."""
    key, copies = helper("key"), helper("copies")
    rates = mix(docs, labels, targets, least).groupBy(F.xxhash64("doc_id", "_h").alias(key)).agg(F.max("copies").alias(copies))
    joined = docs.withColumn(key, F.xxhash64("doc_id", F.xxhash64("text"))).join(rates, key).where(F.col(copies) > 0)
    return joined.select(*docs.columns, F.explode(F.sequence(F.lit(1).cast("long"), copies)).alias(copies)).select(*docs.columns)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    p = [F.round(F.col("p")[k], 6).alias(f"p_{d}") for k, d in enumerate(DOMAINS)]
    return out.select("doc_id", "tokens", *p, F.round("rate", 6).alias("rate"), "copies")
