"""Connected components of a graph of links, by alternating large and small stars.

Each round hangs a node's larger neighbours, then its smaller ones, on the least node it knows, until every component
is one star around its least node. A round is group minima and joins on node ids; nothing is gathered
by component, so a component may hold any share of the nodes. Rounds are written to the shared folder.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import Scratch


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, root) for every node of links (a, b), undirected; root is the least node of its component.

    Links of a node to itself and repeated links are allowed; null ends are ignored.
    """
    e = links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = scratch.keep(e, f"{name}_0")
    seen, kept = None, f"{name}_0"
    for k in count(1):  # ends: every round but the last hangs some node on a lesser one
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(least.select("a", F.col("m").alias("b"))).distinct()
        e = scratch.keep(small, f"{name}_{k}")
        scratch.drop(kept)
        kept = f"{name}_{k}"
        now = e.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.expr("bit_xor(xxhash64(b, a, 1))")).first()
        if now == seen:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen = now


def grown(done: DataFrame | None, links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The components (node, root) that ``done`` becomes with more links, found on the graph of its roots."""
    if done is None:
        return scratch.keep(components(links, scratch, name), f"{name}_done")
    if links.isEmpty():
        return done
    of = lambda k: done.select(F.col("node").alias(k), F.col("root").alias(f"r{k}"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    more = scratch.keep(components(ends, scratch, name), f"{name}_more")
    moved = done.join(more.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return scratch.keep(moved.union(more.join(done, "node", "left_anti").select("node", "root")), f"{name}_done")


def still_open(lists: DataFrame, done: DataFrame, node: str) -> DataFrame:
    """The entries (token, node, ...) of lists that hold more than one component, with each entry's component ``comp``."""
    known = lists.drop("comp").join(done.select(F.col("node").alias(node), F.col("root").alias("comp")), node, "left").withColumn("comp", F.coalesce("comp", node))
    several = known.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("token")
    return known.join(several, "token", "left_semi")


def outside_largest(lists: DataFrame) -> DataFrame:
    """lists (token, comp, ...) with in_most: whether an entry is of its list's largest component."""
    most = lists.groupBy("token", "comp").agg(F.count("*").alias("c")).groupBy("token").agg(F.max_by("comp", F.struct("c", "comp")).alias("most"))
    return lists.join(most, "token").withColumn("in_most", F.col("comp") == F.col("most")).drop("most")
