"""Connected components of a link table as DataFrame jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sevlake.llm.common import materialise


def _minima(links: DataFrame) -> DataFrame:
    # written first, so that both sides of the join after it are shuffled and
    # Spark can split the partition of a node with very many links
    return materialise(links.groupBy("u").agg(F.min("v").alias("m")), "cc-min")


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    joined = both.join(_minima(both), "u").withColumn("m", F.least("m", "u"))
    return joined.where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    joined = links.join(_minima(links), "u")
    moved = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(joined.select("u", F.col("m").alias("v"))).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """``links(u, v)`` (any comparable type) -> ``(node, component)`` for every
    node that has a link to another one; the component is its least node.

    Large-star and small-star steps in turn until nothing changes: a number of
    rounds that grows with the logarithm of the component size.  Each round is
    written to the shared folder.  Nulls and self-links are left out; an empty
    table gives an empty table.
    """
    state = materialise(
        links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc"
    )
    mark = None
    while True:
        row = state.agg(F.count("u").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (row["n"], row["h"]) == mark or row["n"] == 0:
            return state.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        mark = (row["n"], row["h"])
        state = materialise(_small_star(materialise(_large_star(state), "cc-l")), "cc")
