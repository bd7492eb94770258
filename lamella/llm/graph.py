"""Links between rows: stars of buckets, and connected components, without a driver-side copy and without hot keys.

Joins on a hot key have saved tables on both sides, so that adaptive execution splits them; all grouping is by
aggregates that combine before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.workspace import Workspace


def shared_buckets(members: DataFrame, work: Workspace) -> DataFrame:
    """The saved (key, id, size) of those (key, id) rows, without repeated ones, whose key has several; size: how many.
    A column texts, if there is one, says in how many texts a row is (2: or more); keys of one text alone are left out."""
    sized = members.groupBy("key").agg(F.count("*").alias("size"), *(F.sum(c).alias(c) for c in members.columns if c == "texts")).where("size > 1")
    if "texts" in members.columns:
        sized = sized.where("texts > 1")
    shared = work.save(sized.select("key", "size"), "shared")
    out = work.save(members.select("key", "id").join(shared, "key"), "buckets")
    work.drop(shared)
    return out


def _is_star(edges: DataFrame) -> bool:
    roles = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("leaf"), F.lit(0).alias("hub")), F.struct(F.col("v").alias("node"), F.lit(0).alias("leaf"), F.lit(1).alias("hub")))).alias("r")).select("r.*")
    bad = roles.groupBy("node").agg(F.sum("leaf").alias("leaf"), F.max("hub").alias("hub")).where("leaf > 1 OR (leaf > 0 AND hub > 0)")
    return bad.agg(F.count("*")).first()[0] == 0


def components(links: DataFrame, work: Workspace) -> DataFrame:
    """Saved (node, component) for each end of links (a, b) that is not itself the least node of its component.

    Alternates large-star and small-star steps, each of which connects a node's neighbours to the least of them, until
    the links form stars; the number of rounds grows with the logarithm of the longest path."""
    edges = work.save(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not _is_star(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = work.save(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = work.save(both.join(low, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        work.drop(edges, low)
        low = work.save(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = work.save(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        work.drop(large, low)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
