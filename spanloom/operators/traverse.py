"""Policy-guided descent of trees for many queries at once.

A round takes the whole frontier, all queries and starts, one level down by joins; what a round keeps is written to
the shared folder, so plans stay as short as one round. A policy is a pair of column rules: what to do at a
node, and what the decisions on its children say together."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors
from ..sources import store
from .distribution import branch_policy, hiro_policy

#: Fixed value: no descent goes deeper.
DEEPEST = 256


@dataclass(frozen=True)
class Policy:
    """decide: drill_down, keep_parent or prune from the columns support, dispersion, entropy, is_route, query_distance and
    parent_distance. which: how children speak together. `nearest`: the child of least distance decides alone; `any`: the
    farthest of those to drill is drilled, else one to keep keeps all, else prune; `all`: every child is a node of the next
    level and decides for itself."""

    decide: Callable[[], Column]
    which: str

    def __post_init__(self):
        if self.which not in ("nearest", "any", "all"):
            raise ValueError(f"unknown rule {self.which}")


def baseline(least_support: int = 1, dispersion: float = 1.0, entropy: float = 3.0, which: str = "nearest") -> Policy:
    """Support, dispersion and entropy decide; route nodes are drilled."""
    return Policy(lambda: branch_policy(least_support, dispersion, entropy, F.col("is_route")), which)


def hiro(selection: float = 0.5, delta: float = 0.05, least_support: int = 1, which: str = "any") -> Policy:
    """The distance to the query, and how much farther it is than the parent's, decide."""
    return Policy(lambda: hiro_policy(F.col("parent_distance"), F.col("query_distance"), selection, delta, F.col("support"), least_support), which)


def _measured(rows: DataFrame) -> DataFrame:
    """Adds query_distance (1 - cosine of query and centroid)."""
    return rows.withColumn("query_distance", 1.0 - vectors.cosine(F.col("query"), F.col("centroid")))


def traverse(tree: DataFrame, stats: DataFrame, starts: DataFrame, policy: Policy, max_depth: int | None = None) -> DataFrame:
    """query_id, start_id, node_id, depth, decision, query_distance, trail, gives of every node that is met.

    tree: node_id, parent_node_id. stats: node_id, support, dispersion, entropy, is_route, centroid; nodes without are
    passed over. starts: query_id, query (vector), node_id. `decision` is the node's own, null for children that are
    kept together by their parent; `gives` says whether the node's own chunks are evidence: it keeps its parent's
    place, or its parent drilled and its children said to keep. A node to drill at max_depth, or without children,
    gives nothing. trail: ids from the start to the node, joined by ' > '."""
    facts = ["support", "dispersion", "entropy", "is_route", "centroid"]
    known = stats.select("node_id", *facts)
    below = store.staged(tree.filter("parent_node_id is not null").select(F.col("parent_node_id").alias("parent"), "node_id").join(known, "node_id"), "children")
    first = _measured(starts.select("query_id", "query", "node_id").join(known, "node_id"))
    frontier = first.select("query_id", F.col("node_id").alias("start_id"), "query", "node_id", F.col("node_id").alias("trail"), F.col("query_distance").alias("parent_distance"), "query_distance", *facts)
    met, limit = [], DEEPEST if max_depth is None else min(max_depth, DEEPEST)
    report = ["query_id", "start_id", "node_id", "depth", "decision", "query_distance", "trail", "gives"]
    for depth in range(limit + 1):
        judged = store.staged(frontier.withColumn("decision", policy.decide()).withColumn("depth", F.lit(depth)), "frontier")
        met.append(judged.withColumn("gives", F.col("decision") == "keep_parent").select(*report))
        if depth == limit:
            break
        drilled = judged.filter("decision = 'drill_down'").select("query_id", "start_id", "query", "trail", F.col("node_id").alias("parent"), F.col("query_distance").alias("parent_distance"))
        children = _measured(drilled.join(below, "parent")).withColumn("trail", F.concat_ws(" > ", "trail", "node_id"))
        next_, kept = _together(children.withColumn("own", policy.decide()), policy.which)
        if kept is not None:
            met.append(kept.select("query_id", "start_id", "node_id", F.lit(depth + 1).alias("depth"), F.lit(None).cast("string").alias("decision"), "query_distance", "trail", F.lit(True).alias("gives")))
        frontier = store.staged(next_.select("query_id", "start_id", "query", "node_id", "trail", "parent_distance", "query_distance", *facts), "frontier")
        if frontier.isEmpty():
            break
    out = met[0]
    for part in met[1:]:
        out = out.unionByName(part)
    return out


def _together(children: DataFrame, which: str) -> tuple[DataFrame, DataFrame | None]:
    """Children to go on with, and children kept together. A parent's verdict is one row, summed with partial sums."""
    if which == "all":
        return children, None
    children = store.staged(children, "judged")
    keys = ["query_id", "start_id", "parent"]
    drill = F.col("own") == "drill_down"
    if which == "nearest":
        best = F.min_by(F.struct("node_id", "own"), F.struct("query_distance", "node_id"))
        said = children.groupBy(*keys).agg(best.alias("best")).select(*keys, F.col("best.node_id").alias("chosen"), F.col("best.own").alias("verdict"))
    else:
        far = F.min_by("node_id", F.when(drill, F.struct(-F.col("query_distance"), F.col("node_id"))))
        verdict = F.when(F.max(drill.cast("int")) == 1, "drill_down").when(F.max((F.col("own") == "keep_parent").cast("int")) == 1, "keep_parent").otherwise("prune")
        said = children.groupBy(*keys).agg(far.alias("chosen"), verdict.alias("verdict"))
    joined = children.join(said, keys)
    return joined.filter("verdict = 'drill_down' and node_id = chosen"), joined.filter("verdict = 'keep_parent'")


def evidence(met: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, start_id, chunk_id, node_id, score, depth, trail: the own chunks (node_id, chunk_id) of nodes that give."""
    giving = met.filter("gives").select("query_id", "start_id", "node_id", (1.0 - F.col("query_distance")).alias("score"), "depth", "trail")
    return giving.join(chunks.select("node_id", "chunk_id"), "node_id")


def drills(met: DataFrame) -> DataFrame:
    """query_id, node_id of the nodes to drill, as `hotspots.traversed` asks for."""
    return met.filter("decision = 'drill_down'").select("query_id", "node_id").distinct()
