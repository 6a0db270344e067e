"""Connected components of a table of links, as rounds of joins and aggregations.

Large-star and small-star steps by turns: every node points its larger (then its smaller or
equal) neighbours at the smallest node around it, until all links point at the smallest node of
their component.  The links never grow in number, a node of many links is aggregated before
the shuffle, and each round is written to the shared folder, so that lost executors cost one
round.  The rounds are logarithmic in the size of a component; there is no limit on them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetsight.session import materialize


def _least(pairs: DataFrame) -> DataFrame:
    """(u, m): the smallest of each node and its neighbours."""
    return pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes in ``links`` (a, b); a component is its smallest node."""
    now = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(),
                      "links")
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (both.where("v > u").join(_least(both), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u > v").distinct().repartition("u"))
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        turned = F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
        now = materialize(small.select(turned.alias("e")).select("e.u", "e.v").where("u > v").distinct(), "links")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
