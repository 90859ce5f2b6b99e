"""Connected components of a link table by random contraction, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from horosphere.llm.tables import kept


def components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` -> ``(node, component)``, component = least node reachable.

    Each round every node takes the neighbour (or itself) of least hash under
    that round's seed as parent and the links are carried over to the parents;
    links inside one parent vanish. An expected constant share of the nodes
    goes each round, whatever the order of the ids. The parent maps are then
    followed from the first to the last. Minima combine on the map side and
    the joins are plain equi-joins, so a hub with many links may be split.
    """
    edges = kept(links.select("a", "b").where("a <> b").distinct(), "links")
    maps: list[DataFrame] = []
    while not edges.isEmpty():
        rank = lambda c: F.xxhash64(F.col(c), F.lit(len(maps)))
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        near = both.groupBy("u").agg(F.min(F.struct(rank("v").alias("h"), F.col("v"))).alias("m"))
        parent = kept(near.select("u", F.least(
            F.col("m"), F.struct(rank("u").alias("h"), F.col("u").alias("v")))["v"].alias("p")),
            "parents")
        maps.append(parent)
        edges = kept(
            edges.join(parent.select(F.col("u").alias("a"), F.col("p").alias("pa")), "a")
            .join(parent.select(F.col("u").alias("b"), F.col("p").alias("pb")), "b")
            .where("pa <> pb")
            .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(),
            "links")
    if not maps:
        return links.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    at = maps[0].select(F.col("u").alias("node"), F.col("p").alias("root"))
    for m in maps[1:]:
        at = at.join(m.select(F.col("u").alias("root"), "p"), "root", "left") \
            .select("node", F.coalesce("p", "root").alias("root"))
    at = kept(at, "roots")
    least = at.groupBy("root").agg(F.min("node").alias("component"))
    return at.join(least, "root").select("node", "component")
