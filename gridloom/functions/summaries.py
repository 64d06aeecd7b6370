"""Whole-array summaries with explicit rules for missing values.

Without ``na_rm`` a missing value makes a numeric summary missing, else a NaN makes it NaN; with it both are left out. Nothing left
gives the operation's identity. Sums of whole numbers are BIGINT.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMERIC = ("min", "max", "range", "sum", "prod")
LOGICAL = ("any", "all")


def check_op(op: str, kind: str) -> None:
    if op not in NUMERIC + LOGICAL:
        raise ValueError(f"no summary {op!r}")
    if kind in ("character", "raw", "complex") or op in LOGICAL and kind != "logical":
        raise TypeError(f"{op} is not defined for {kind}")


def _numeric(op: str, val: Column, kind: str, na_rm: bool, zeros: Column | None) -> Column:
    """zeros: how many cells without a row there are, for sparse arrays."""
    floating = kind == "double"
    x = val.cast("int") if kind == "logical" else val
    good = F.when(~F.isnan(x), x) if floating else x
    out_type = "double" if floating or op in ("prod", "min", "max") else "bigint"
    if op == "sum":
        body = F.coalesce(F.sum(good), F.lit(0)).cast(out_type)
    elif op == "prod":
        body = F.coalesce(F.product(good), F.lit(1.0))
        if zeros is not None:
            body = F.when(zeros > 0, 0.0).otherwise(body)
    else:
        best = (F.min if op == "min" else F.max)(good).cast("double")
        if zeros is not None:
            worse = F.least if op == "min" else F.greatest
            best = F.when(zeros > 0, worse(best, F.lit(0.0))).otherwise(best)
        body = F.coalesce(best, F.lit(float("inf") if op == "min" else float("-inf")))
    if na_rm:
        return body
    out = F.when(F.count_if(val.isNull()) > 0, F.lit(None).cast(out_type))
    if floating:
        out = out.when(F.count_if(F.isnan(val)) > 0, F.lit(float("nan")))
    return out.otherwise(body)


def summary(op: str, val: Column, kind: str, na_rm: bool = False, zeros: Column | None = None) -> Column:
    """The aggregate expression of a summary over val."""
    check_op(op, kind)
    if op == "range":
        return F.struct(_numeric("min", val, kind, na_rm, zeros).alias("lo"), _numeric("max", val, kind, na_rm, zeros).alias("hi"))
    if op in NUMERIC:
        return _numeric(op, val, kind, na_rm, zeros)
    decided = op == "any"
    hit = F.coalesce(F.bool_or(val) if decided else ~F.bool_and(val), F.lit(False))
    if zeros is not None and not decided:
        hit = hit | (zeros > 0)
    out = F.when(hit, F.lit(decided))
    if not na_rm:
        out = out.when(F.count_if(val.isNull()) > 0, F.lit(None).cast("boolean"))
    return out.otherwise(F.lit(not decided))
