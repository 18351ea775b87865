"""Connected components by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from navspark.llm.shared import Scratch, staged

#: The edges of one node are worked on by so many groups, so a hub of any size is many small ones.
GROUPS = 512


def _least(edges: DataFrame) -> DataFrame:
    """(u, v, m): each edge seen from u, with the least node among u and its neighbours.

    Both the minimum and its way back to the edges go over groups of u's edges,
    so no task gets all edges of a hub.
    """
    dealt = edges.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(GROUPS)).cast("int"))
    some = dealt.groupBy("u", "part").agg(F.min("v").alias("low"))
    every = some.groupBy("u").agg(F.min("low").alias("m"))
    back = some.select("u", "part").join(every, "u")
    return dealt.join(back, ["u", "part"]).select("u", "v", F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    found = _least(down)
    # Each edge gives its lower end and its upper end, once, the least neighbour.
    ends = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v"))))
    return found.select(ends.alias("e")).select("e.u", "e.v").where("u <> v").distinct()


def _is_stars(edges: DataFrame) -> bool:
    """Whether no centre is a ray and every ray has one centre."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("n"), F.lit(1).alias("ray")), F.struct(F.col("v").alias("n"), F.lit(0).alias("ray")))).alias("e"))
    roles = ends.groupBy("e.n").agg(F.max("e.ray").alias("high"), F.min("e.ray").alias("low"), F.count("*").alias("k"))
    return roles.where("high = 1 and (low = 0 or k > 1)").isEmpty()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of the edges; a component is named by its least node.

    Nodes may be of any ordered type.  Self edges and repeated edges are fine,
    an edge with a null end is none.  Each round is a few shuffles of the edges
    and is written to the shared folder, where it replaces the one before; the
    number of rounds grows with the logarithm of the longest path, and nothing
    but a yes or no reaches the driver.
    """
    edges = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    with Scratch() as rounds:
        while True:
            edges = rounds.staged(_small_star(_large_star(edges)), "star")
            rounds.clear(but=1)
            if _is_stars(edges):
                break
        return staged(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), "v").distinct()).toDF("node", "component"), "components")


def merged(label: DataFrame, edges: DataFrame, a: str, b: str) -> DataFrame:
    """``label`` (node, component) after further edges; only the graph of the components that they join is worked on."""
    edges = edges.where(f"`{a}` is not null and `{b}` is not null and `{a}` <> `{b}`")
    named = edges
    for end in (a, b):
        named = named.join(label.withColumnRenamed("node", end), end, "left").withColumn(end, F.coalesce("component", end)).drop("component")
    above = components(named, a, b).toDF("component", "into")
    new = edges.select(F.explode(F.array(a, b)).alias("node")).distinct().join(label, "node", "left_anti").select("node", F.col("node").alias("component"))
    return label.unionByName(new).join(above, "component", "left").select("node", F.coalesce("into", "component").alias("component"))
