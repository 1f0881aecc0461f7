"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equi-join whose sides are both dealt anew for the join, so that adaptive execution
    may split a hot key even where one side is already grouped by the same keys."""
    salt = "_dealt"
    deal = lambda df: df.withColumn(salt, F.pmod(F.xxhash64(*keys), F.lit(16)).cast("tinyint"))  # noqa: E731  (a small number packs well)
    return deal(left).join(deal(right), [*keys, salt], how).drop(salt)


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the least of it and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return spread_join(both.filter("v > u"), least, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the least of these."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = spread_join(down, least, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).filter("u != v")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """u, v: every node of the edges but the least of its component, with that least node.

    Each round writes its edges to the shared folder and cuts the lineage. The rounds end
    when the edges no longer change; their number grows with the logarithm of the nodes."""
    now = common.staged(edges.select("u", "v").filter("u != v").distinct(), "edges")
    seen = None
    for _ in range(rounds):
        now = common.staged(_small_star(_large_star(now)).distinct(), "edges")
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if mark == seen:
            return now
        seen = mark
    raise RuntimeError("components did not settle")
