"""How hits spread over a tree, and what to expand."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, vectors


def roll_up(hits: DataFrame, path: str = "heading_path", fallback: str = "text") -> DataFrame:
    """node, total, hits: every hit adds its score (null is 0) to all ancestors of its path.

    Ancestors are exploded within the row and summed with partial sums: a root with every
    hit is one row a task before the shuffle."""
    nodes = F.when(F.col(path).isNull() | (F.col(path) == ""), F.array(F.col(fallback))).otherwise(text.prefixes(F.col(path)))
    return hits.select(F.explode(nodes).alias("node"), F.coalesce("score", F.lit(0.0)).alias("s")).groupBy("node").agg(F.sum("s").alias("total"), F.count(F.lit(1)).alias("hits"))


def spread(rolled: DataFrame, keys: list[str] = ()) -> DataFrame:
    """cv (sample deviation over mean), entropy and max_entropy (bits) of the totals."""
    total = rolled.groupBy(*keys).agg(F.sum("total").alias("whole")) if keys else rolled.agg(F.sum("total").alias("whole"))
    joined = rolled.join(total, list(keys)) if keys else rolled.join(F.broadcast(total), F.lit(True))  # one row
    share = F.col("total") / F.nullif(F.col("whole"), F.lit(0.0))
    return joined.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("nodes"),
        F.when((F.count(F.lit(1)) > 1) & (F.avg("total") != 0), F.stddev_samp("total") / F.nullif(F.avg("total"), F.lit(0.0))).otherwise(0.0).alias("cv"),
        F.coalesce(-F.sum(F.when(share > 0, share * F.log2(share))), F.lit(0.0)).alias("entropy"),
        F.log2(F.count(F.lit(1)).cast("double")).alias("max_entropy"),
    )


def decision(cv="cv", entropy="entropy", top="max_entropy"):
    """What the spread says: concentrated hits, scattered ones, or something between."""
    cv, entropy, top = F.col(cv), F.col(entropy), F.col(top)
    return F.when((cv > 1.0) & (entropy < 0.5), "high_concentration").when((cv < 0.4) | (entropy > 0.8 * top), "high_dispersion").otherwise("moderate")


def node_stats(members: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """key, support, centroid, dispersion (mean distance to the centroid), entropy of distances."""
    joined = members.join(vectors.centroids(members, key, vector), key).withColumn("distance", vectors.euclid(vectors.doubles(F.col(vector)), F.col("centroid")))
    sums = joined.groupBy(key).agg(
        F.count(F.lit(1)).alias("support"), F.avg("distance").alias("dispersion"), F.sum("distance").alias("d"),
        F.sum(F.when(F.col("distance") > 0, F.col("distance") * F.log2("distance"))).alias("dlogd"), F.first("centroid").alias("centroid"),
    )
    # -sum(p log p) with p = distance / d
    entropy = F.when(F.col("d") > 0, F.log2("d") - F.col("dlogd") / F.col("d")).otherwise(0.0)
    return sums.select(key, "support", "centroid", "dispersion", F.coalesce(entropy, F.lit(0.0)).alias("entropy"))


def subtree_stats(members: DataFrame, ancestors: DataFrame, key: str = "node_id", vector: str = "embedding") -> DataFrame:
    """node_stats of every node by its own vectors or, where it has none, by those of its subtree, with direct (own
    vectors) and is_route (has only its subtree's). ancestors: node_id, ancestor_id, itself too."""
    direct = members.groupBy(key).agg(F.count(F.lit(1)).alias("direct"))
    below = members.join(ancestors.filter("node_id <> ancestor_id"), key).join(direct.select(F.col(key).alias("ancestor_id")), "ancestor_id", "left_anti")
    used = members.select(key, vector).unionByName(below.select(F.col("ancestor_id").alias(key), vector))
    return node_stats(used, key, vector).join(direct, key, "left").withColumn("direct", F.coalesce("direct", F.lit(0))).withColumn("is_route", F.col("direct") == 0)


def tree_roll_up(hits: DataFrame, ancestors: DataFrame) -> DataFrame:
    """node_id, total, hits: every hit (node_id, score) counts for its node and all above it."""
    own = hits.groupBy("node_id").agg(F.sum(F.coalesce("score", F.lit(0.0))).alias("s"), F.count(F.lit(1)).alias("n"))
    return own.join(ancestors, "node_id").groupBy(F.col("ancestor_id").alias("node_id")).agg(F.sum("s").alias("total"), F.sum("n").alias("hits"))


def branch_policy(least_support: int = 2, dispersion: float = 1.0, entropy: float = 3.0, route=None):
    """Prune nodes of too little support; route nodes are drilled; else drill where distances are both
    wide and even, keep the parent where neither, prune between."""
    wide, even = F.col("dispersion") > dispersion, F.col("entropy") > entropy
    rest = F.when(wide & even, "drill_down").when(~wide & ~even, "keep_parent").otherwise("prune")
    rest = rest if route is None else F.when(route, "drill_down").otherwise(rest)
    return F.when(F.col("support") < least_support, "prune").otherwise(rest)


def hiro_policy(parent, child, selection: float = 0.5, delta: float = 0.05, support=None, least_support: int = 1):
    """By distances to the query: drill where the child lies beyond `selection` and farther than its
    parent by `delta`; a nearer child keeps the parent; else prune, as with too little support."""
    gain = child - parent
    out = F.when((gain > delta) & (child > selection), "drill_down").when(gain < 0, "keep_parent").otherwise("prune")
    return out if support is None else F.when((support > 0) & (support < least_support), "prune").otherwise(out)


#: Bonus of a route, of a level (four at most) and of a supporting chunk (ten at most), penalty of a root.
ROUTE_BONUS, DEPTH_BONUS, SUPPORT_BONUS, ROOT_PENALTY = 0.08, 0.03, 0.003, 0.06
#: Weights of a cluster's best and mean score, support and density.
CLUSTER_WEIGHTS = (0.20, 0.35, 0.30, 0.15)


def hotspot_score(similarity, route, depth, support, is_root):
    """Similarity with small bonuses for route nodes, depth and support, less a penalty for the root."""
    return similarity + F.when(route, ROUTE_BONUS).otherwise(0.0) + DEPTH_BONUS * F.least(depth, F.lit(4)) + SUPPORT_BONUS * F.least(support, F.lit(10)) - F.when(is_root, ROOT_PENALTY).otherwise(0.0)


def cluster_score(top, mean, support, density):
    return CLUSTER_WEIGHTS[0] * top + CLUSTER_WEIGHTS[1] * mean + CLUSTER_WEIGHTS[2] * support + CLUSTER_WEIGHTS[3] * density


def greedy_hotspots(candidates: DataFrame, group: str, limit: int) -> DataFrame:
    """Per group, best first, the nodes whose path is no ancestor or descendant of one chosen
    before; `limit` at most. candidates: group, node_id, heading_path, score; the pool of a group
    is bounded by its caller (four times the limit, twenty at least)."""
    w_pool = max(4 * limit, 20)
    pool = candidates.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("score"), "node_id"))).filter(F.col("_n") <= w_pool)
    ordered = F.array_sort(F.collect_list(F.struct("_n", "node_id", "heading_path", "score")))
    over = lambda a, b: F.startswith(F.concat(a, F.lit(" > ")), F.concat(b, F.lit(" > ")))
    empty = F.filter(ordered, lambda x: F.lit(False))
    fold = F.aggregate(
        ordered, empty,
        lambda kept, x: F.when((F.size(kept) < limit) & ~F.exists(kept, lambda y: over(x["heading_path"], y["heading_path"]) | over(y["heading_path"], x["heading_path"])), F.array_append(kept, x)).otherwise(kept),
    )
    chosen = pool.groupBy(group).agg(fold.alias("kept"))
    return chosen.select(group, F.posexplode("kept").alias("place", "x")).select(group, "place", "x.node_id", "x.heading_path", "x.score")
