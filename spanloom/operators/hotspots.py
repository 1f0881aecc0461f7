"""Hotspots of a tree by vector and keyword evidence together, for any number of queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import distribution

#: Least share of the best vector score that makes a child hot, most children of an eligible
#: parent, and weights of a parent's coverage, its children's vectors and its support (full at five).
VECTOR_HOT, MOST_CHILDREN = 0.5, 8
COVERAGE, VECTOR, SUPPORT, FULL_SUPPORT = 0.50, 0.30, 0.20, 5.0
#: Weights of vector and keyword for nodes that match all terms, and for hot ones.
EXACT_WEIGHTS, HOT_WEIGHTS = (0.15, 0.85), (0.5, 0.5)
#: Weights of own hits, siblings and children; of children and their number without own hits.
DIRECT, CHILDREN_ONLY = (0.60, 0.25, 0.15), (0.80, 0.20)


def normalized(score: Column, over) -> Column:
    """Min-max within a query; 0.5 where all are equal."""
    low, high = F.min(score).over(over), F.max(score).over(over)
    return F.coalesce(F.try_divide(score - low, high - low), F.lit(0.5))


def signals(vector: DataFrame, keyword: DataFrame) -> DataFrame:
    """query_id, node_id, v, k, exact, hot. vector: query_id, node_id, similarity; keyword: query_id, node_id, score, term.

    A node's keyword signal is the better of its normalized score and its share of the query's terms; it is
    exact with all of several terms, and hot with a term and half of the vector range."""
    w = Window.partitionBy("query_id")
    by_vector = vector.select("query_id", "node_id", normalized(F.col("similarity"), w).alias("v"))
    terms = keyword.groupBy("query_id").agg(F.countDistinct("term").alias("all_terms"))
    scored = keyword.withColumn("s", normalized(F.col("score"), w)).groupBy("query_id", "node_id").agg(F.max("s").alias("s"), F.countDistinct("term").alias("terms"))
    share = F.coalesce(F.try_divide(F.col("terms"), F.col("all_terms")), F.lit(0.0))
    by_word = scored.join(terms, "query_id").select("query_id", "node_id", F.greatest("s", share).alias("k"), "terms", ((F.col("all_terms") > 1) & (F.col("terms") == F.col("all_terms"))).alias("exact"))
    both = by_vector.join(by_word, ["query_id", "node_id"], "full")
    hot = (F.coalesce("v", F.lit(0.0)) >= VECTOR_HOT) & F.col("v").isNotNull() & (F.coalesce("terms", F.lit(0)) >= 1)
    return both.select("query_id", "node_id", F.col("v"), F.coalesce("k", F.lit(0.0)).alias("k"), F.coalesce("exact", F.lit(False)).alias("exact"), hot.alias("hot"))


def hybrid(vector: DataFrame, keyword: DataFrame, tree: DataFrame, limit: int = 3, least_coverage: float = 0.5, least_support: int = 2) -> DataFrame:
    """query_id, node_id, score, reason, place: parents of whose children enough are hot, the root and very
    broad ones left out; for queries without such a parent the best hot or exactly matching nodes, else the
    node nearest by vector. tree: node_id, parent_node_id."""
    found = signals(vector, keyword)
    edges = tree.filter("parent_node_id is not null").select("node_id", "parent_node_id")
    sizes = edges.groupBy("parent_node_id").agg(F.count(F.lit(1)).alias("children"))
    inner = tree.filter("parent_node_id is not null").select(F.col("node_id").alias("parent_node_id"))  # parents that are no root
    hot = found.filter("hot").join(edges, "node_id").groupBy("query_id", "parent_node_id").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("v"))
    eligible = hot.join(sizes, "parent_node_id").join(inner, "parent_node_id").filter((F.col("children") <= MOST_CHILDREN) & (F.col("n") >= least_support) & (F.col("n") / F.col("children") >= least_coverage))
    score = F.col("n") / F.col("children") * COVERAGE + F.col("v") * VECTOR + F.least(F.col("n") / FULL_SUPPORT, F.lit(1.0)) * SUPPORT
    parents = eligible.select("query_id", F.col("parent_node_id").alias("node_id"), score.alias("score"), F.lit("cluster_coverage").alias("reason"))
    below_root = found.join(edges.select("node_id"), "node_id", "left_semi")
    rest = below_root.join(parents.select("query_id").distinct(), "query_id", "left_anti")
    v = F.coalesce("v", F.lit(0.0))
    leaf = rest.filter("exact or hot").withColumn("score", F.when(F.col("exact"), v * EXACT_WEIGHTS[0] + F.col("k") * EXACT_WEIGHTS[1]).otherwise(v * HOT_WEIGHTS[0] + F.col("k") * HOT_WEIGHTS[1])).select("query_id", "node_id", "score", F.lit("leaf_fallback").alias("reason"))
    near = found.filter("v is not null").join(parents.unionByName(leaf).select("query_id").distinct(), "query_id", "left_anti").groupBy("query_id").agg(F.max_by("node_id", F.struct("v", "node_id")).alias("node_id"), F.max("v").alias("score")).withColumn("reason", F.lit("leaf_fallback"))
    every = parents.unionByName(leaf).unionByName(near)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "node_id"))
    return every.withColumn("place", place).filter(F.col("place") <= limit)


def route_subtree(stats: DataFrame, limit: int = 3, separator: str = " > ") -> DataFrame:
    """query_id, node_id, heading_path, score, reason, place: nodes by similarity with small bonuses, best first,
    none above or below one chosen before. stats: query_id, node_id, heading_path, similarity, is_route, support.

    One place a round for all queries at once: the best that is left, then all that it overlaps go."""
    depth = F.greatest(F.size(F.split("heading_path", separator)) - 1, F.lit(0))
    score = distribution.hotspot_score(F.col("similarity"), F.col("is_route"), depth, F.col("support"), F.col("is_route") & (depth == 0))
    reason = F.when(F.col("is_route"), "subtree_similarity").otherwise("node_similarity")
    rest = stats.filter("similarity > 0").select("query_id", "node_id", "heading_path", score.alias("score"), reason.alias("reason"))
    above = lambda a, b: F.startswith(F.concat(a, F.lit(separator)), F.concat(b, F.lit(separator)))
    chosen = None
    for place in range(1, limit + 1):
        best = rest.groupBy("query_id").agg(F.min_by(F.struct("node_id", "heading_path", "score", "reason"), F.struct(-F.col("score"), F.col("node_id"))).alias("b"))
        here = best.select("query_id", "b.*", F.lit(place).alias("place"))
        chosen = here if chosen is None else chosen.unionByName(here)
        path, other = F.col("heading_path"), F.col("b.heading_path")
        rest = rest.join(best, "query_id").filter(~above(path, other) & ~above(other, path)).drop("b")
    return chosen


def cluster(stats: DataFrame, ancestors: DataFrame, roots: DataFrame, limit: int = 3) -> DataFrame:
    """query_id, node_id, score, reason, place: the ancestor under which the best nodes lie densest, and its best
    members. stats: query_id, node_id, similarity; ancestors: node_id, ancestor_id (itself too); roots: node_id.

    Of a query's nodes the best max(4 * limit, 20) by similarity compete, all alike; each counts for all its
    ancestors. A root is taken only where nothing else is there."""
    pool = max(4 * limit, 20)
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "node_id")
    best = stats.filter("similarity > 0").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= pool)
    under = best.join(ancestors, "node_id")
    sums = under.groupBy("query_id", "ancestor_id").agg(F.max("similarity").alias("top"), F.avg("similarity").alias("mean"), F.count(F.lit(1)).alias("members"))
    score = distribution.cluster_score(F.col("top"), F.col("mean"), F.least(F.col("members") / pool, F.lit(1.0)), F.lit(1.0))  # all nodes of the pool below it are its members
    scored = sums.withColumn("cluster_score", score).join(roots.select(F.col("node_id").alias("ancestor_id"), F.lit(True).alias("root")), "ancestor_id", "left")
    first = Window.partitionBy("query_id").orderBy(F.coalesce("root", F.lit(False)), F.desc("cluster_score"), "ancestor_id")
    winner = scored.withColumn("_n", F.row_number().over(first)).filter("_n = 1").select("query_id", "ancestor_id", "top")
    head = winner.select("query_id", F.col("ancestor_id").alias("node_id"), F.col("top").alias("score"), F.lit("cluster_hotspot").alias("reason"), F.lit(0).alias("n"))
    members = under.join(winner, ["query_id", "ancestor_id"]).withColumn("m", F.row_number().over(order)).filter((F.col("m") < limit) & (F.col("node_id") != F.col("ancestor_id")))
    every = head.unionByName(members.select("query_id", "node_id", F.col("top").alias("score"), F.lit("cluster_member").alias("reason"), "n"))
    return every.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("n"))).drop("n")


def child_distribution(hits: DataFrame, tree: DataFrame) -> DataFrame:
    """query_id, node_id, score of every node with hits of its own or of its children. hits: query_id, node_id,
    score. Own hits count with those of siblings and children; a node without own hits by its children's."""
    own = hits.groupBy("query_id", "node_id").agg(F.avg("score").alias("direct"), F.count(F.lit(1)).alias("n"), F.sum("score").alias("s"))
    placed = own.join(tree.select("node_id", F.coalesce("parent_node_id", F.lit("")).alias("up")), "node_id")
    by_parent = placed.groupBy("query_id", "up").agg(F.sum("n").alias("all"), F.sum("s").alias("sum"))
    below = by_parent.filter("up <> ''").select("query_id", F.col("up").alias("node_id"), F.col("all").alias("children"), (F.col("sum") / F.col("all")).alias("child_mean"))
    rows = placed.join(by_parent.select("query_id", "up", "all"), ["query_id", "up"]).join(below, ["query_id", "node_id"], "full")
    children, siblings = F.coalesce("children", F.lit(0)), F.coalesce(F.col("all") - F.col("n"), F.lit(0))
    share = lambda n: n / (n + 1)
    direct = F.col("direct") * DIRECT[0] + share(siblings) * DIRECT[1] + share(children) * DIRECT[2]
    alone = F.col("child_mean") * CHILDREN_ONLY[0] + F.least(F.col("children") / FULL_SUPPORT, F.lit(1.0)) * CHILDREN_ONLY[1]
    return rows.select("query_id", "node_id", F.when(F.col("direct").isNotNull(), direct).otherwise(alone).alias("score"))


def traversed(hotspots: DataFrame, tree: DataFrame, chunks: DataFrame, similarities: DataFrame, drills: DataFrame | None = None) -> DataFrame:
    """query_id, hotspot_id, node_id, chunk_id, span_id, similarity, depth: for each hotspot a waypoint (no chunk,
    similarity 0, a span id made of the node's low bits), and the chunks of its children (depth 1), or its own
    where it has none (depth 0). drills: query_id, node_id of children to go down from once more (depth 2).
    chunks: node_id, chunk_id, span_id; similarities: query_id, node_id, similarity; others yield nothing."""
    spots = hotspots.select("query_id", F.col("node_id").alias("hotspot_id"))
    edges = tree.filter("parent_node_id is not null").select("node_id", F.col("parent_node_id").alias("up"))
    low = F.substr(F.replace("hotspot_id", F.lit("-"), F.lit("")), F.lit(17), F.lit(16))
    placeholder = F.concat(F.lit("00000000-0000-0000-"), F.translate(F.substr(low, F.lit(1), F.lit(1)), "89abcdef", "01234567"), F.substr(low, F.lit(2), F.lit(3)), F.lit("-"), F.substr(low, F.lit(5)))
    none = F.lit(None).cast("string")
    waypoints = spots.select("query_id", "hotspot_id", F.col("hotspot_id").alias("node_id"), none.alias("chunk_id"), placeholder.alias("span_id"), F.lit(0.0).alias("similarity"), F.lit(0).alias("depth"))
    children = spots.join(edges.withColumnRenamed("up", "hotspot_id"), "hotspot_id").withColumn("depth", F.lit(1))
    leaves = spots.join(edges.select(F.col("up").alias("hotspot_id")).distinct(), "hotspot_id", "left_anti").select("query_id", "hotspot_id", F.col("hotspot_id").alias("node_id"), F.lit(0).alias("depth"))
    sources = children.select("query_id", "hotspot_id", "node_id", "depth").unionByName(leaves)
    if drills is not None:
        again = children.join(drills, ["query_id", "node_id"]).select("query_id", "hotspot_id", F.col("node_id").alias("up"))
        sources = sources.unionByName(again.join(edges, "up").select("query_id", "hotspot_id", "node_id", F.lit(2).alias("depth")))
    evidence = sources.join(similarities, ["query_id", "node_id"]).join(chunks, "node_id")
    return waypoints.unionByName(evidence.select(*waypoints.columns))


def ordered_hits(hits: DataFrame, hotspots: DataFrame) -> DataFrame:
    """Hits with the place of their hotspot and their own: hotspot after hotspot, then by score; others last."""
    joined = hits.join(hotspots.select("query_id", F.col("node_id").alias("hotspot_id"), F.col("place").alias("hotspot_place")), ["query_id", "hotspot_id"], "left")
    order = Window.partitionBy("query_id").orderBy(F.asc_nulls_last("hotspot_place"), F.desc_nulls_last("similarity"), "node_id", "chunk_id", "span_id")
    return joined.withColumn("place", F.row_number().over(order))
