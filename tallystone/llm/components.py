"""Connected components of links by alternating large-star and small-star steps (Kiveris et al., 2014) on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystone.llm.common import materialize


def _nodes(pairs: DataFrame) -> DataFrame:
    """Each u of pairs (u, v): the smallest of u and its v as m, how many v are smaller and how many larger. Sums by u before
    any join, so no u's rows meet in one task."""
    smaller, larger = F.count_if(F.col("v") < F.col("u")), F.count_if(F.col("v") > F.col("u"))
    return materialize(pairs.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), smaller.alias("smaller"), larger.alias("larger")), "star-min")


def components(links: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(node, component) for every node of links (a, b); component is the smallest node that can be reached. The rounds needed
    grow with the logarithm of the longest path; more than max_rounds are an error.

    Rounds end when the links are stars: no node has two smaller ones, or a smaller one and larger ones.
    """
    links = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    links = materialize(links, "links")
    for _ in range(max_rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        nodes = _nodes(both)
        if nodes.where("smaller > 1 or smaller > 0 and larger > 0").isEmpty():
            break
        large = both.where("v > u").join(nodes.select("u", "m"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, "large-star")
        marked = large.join(_nodes(large).select("u", "m"), "u")
        small = marked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(marked.select("u", F.col("m").alias("v")))
        links = materialize(small.where("u <> v").distinct(), "small-star")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return nodes.select(F.col("u").alias("node"), F.col("m").alias("component"))
