"""Connected components of a link table, by alternating large and small stars.

Every round links the larger neighbours of a node (large star), then its smaller ones (small star),
to the smallest neighbour, until each node points to the smallest one it can reach.  A round is two
equi-joins and two aggregations over the links; minima are pre-aggregated before the shuffle, and
large stars are split by the adaptive skew join.  Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.llm.common import discard, stored


def _star(links: DataFrame, large: bool) -> DataFrame:
    """``links`` (a, b) with a > b, each once."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if large:
        near = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        moved = both.filter("b > a").join(near, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        near = links.groupBy("a").agg(F.min("b").alias("low"))
        joined = links.join(near, "a")
        moved = joined.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(
            near.select("a", F.col("low").alias("b"))
        )
    return moved.filter("a > b").distinct()


def _settled(links: DataFrame) -> bool:
    """Every node points to one node only, and none is pointed to and points on."""
    heads = links.groupBy("a").agg(F.count("*").alias("n"))
    if not heads.filter("n > 1").limit(1).isEmpty():
        return False
    return links.join(links.select(F.col("a").alias("x")), F.col("b") == F.col("x"), "left_semi").limit(1).isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every linked node, component being the smallest node of its group.

    ``links`` has columns ``a`` and ``b``; direction, repeats and links to itself do not matter.
    An empty table gives an empty result; rows with a null are ignored.
    """
    links = (
        links.filter("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    now = stored(links, "links")
    while not _settled(now):
        then, now = now, stored(_star(_star(now, large=True), large=False), "links")
        discard(then)
    ends = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return ends.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
