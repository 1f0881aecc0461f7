"""Ways through a tree from stated nodes: parents, chains up to the root, children, siblings, nodes of near pages, and where spans come from.

A tree has a row for each node_id, with parent_node_id (null for a root); wanted has node_id. A wanted id that no node has gives no rows: `unknown`
lists such ids, `require` raises for them. Parents that are missing from the tree end a chain, as do cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import store


def unknown(tree: DataFrame, wanted: DataFrame) -> DataFrame:
    """node_id of wanted nodes that the tree does not have, null among them."""
    return wanted.select("node_id").distinct().join(tree.select("node_id"), "node_id", "left_anti")


def require(tree: DataFrame, wanted: DataFrame) -> None:
    """Raise ValueError if a wanted node does not exist."""
    if missing := unknown(tree, wanted).orderBy("node_id").head(1):
        raise ValueError(f"node not found: {missing[0].node_id}")


def parents(tree: DataFrame, wanted: DataFrame) -> DataFrame:
    """node_id, parent_node_id of each wanted node whose parent exists; roots have none."""
    own = wanted.select("node_id").distinct().join(tree.select("node_id", "parent_node_id"), "node_id")
    return own.join(tree.select(F.col("node_id").alias("parent_node_id")), "parent_node_id", "left_semi").select("node_id", "parent_node_id")


def children(tree: DataFrame, wanted: DataFrame) -> DataFrame:
    """node_id (wanted), child_id."""
    below = tree.select(F.col("node_id").alias("child_id"), F.col("parent_node_id").alias("node_id"))
    return wanted.select("node_id").distinct().join(below, "node_id").select("node_id", "child_id")


def siblings(tree: DataFrame, wanted: DataFrame) -> DataFrame:
    """node_id (wanted), sibling_id: children of the same parent, the node itself among them; a root has none."""
    own = wanted.select("node_id").distinct().join(tree.select("node_id", "parent_node_id"), "node_id")
    others = tree.select(F.col("node_id").alias("sibling_id"), "parent_node_id")
    return own.join(others, "parent_node_id").select("node_id", "sibling_id")


def adjacent(tree: DataFrame, wanted: DataFrame, pages: int = 5, scope: list[str] = ()) -> DataFrame:
    """node_id (wanted), adjacent_id, distance: nodes whose first page lies at most `pages` before or after the node's, itself among them; within
    the same `scope` (such as a version; by default the whole tree). A node without a page has none.

    Nodes fall to cells of pages + 1; a wanted node looks into its own cell and the two beside it, so the join is by equality."""
    if pages < 0:
        raise ValueError("pages must not be negative")
    placed = tree.filter("page_start is not null").select("node_id", "page_start", *scope)
    cell = F.floor(F.col("page_start") / (pages + 1))
    looking = wanted.select("node_id").distinct().join(placed, "node_id").select("node_id", *scope, F.col("page_start").alias("at_"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell_"))
    found = placed.select(F.col("node_id").alias("adjacent_id"), *scope, "page_start", cell.alias("cell_"))
    return looking.join(found, [*scope, "cell_"]).withColumn("distance", F.col("page_start") - F.col("at_")).filter(F.abs("distance") <= pages).select("node_id", "adjacent_id", "distance")


def chains(tree: DataFrame, wanted: DataFrame, deepest: int = 256) -> DataFrame:
    """node_id (wanted), step (0 is the node), ancestor_id: from each wanted node to its root. A cycle is followed once around.

    The reach doubles in each round, so rounds grow with the logarithm of the depth; a node met again keeps its first step. A chain of
    more than `deepest` nodes raises."""
    known = tree.select("node_id")
    up = tree.select(F.col("node_id").alias("at"), F.col("parent_node_id").alias("up"))
    hops = up.join(known.select(F.col("node_id").alias("up")), "up", "left_semi").select("at", "up")
    reach = wanted.select("node_id").distinct().join(known, "node_id", "left_semi").select("node_id", F.col("node_id").alias("at"), F.lit(0).alias("step"))
    length, rows = 1, reach.count()
    while True:
        farther = reach.join(hops, "at").select("node_id", F.col("up").alias("at"), (F.col("step") + length).alias("step"))
        reach = store.staged(reach.unionByName(farther).groupBy("node_id", "at").agg(F.min("step").alias("step")), "chains")
        before, rows = rows, reach.count()
        if rows == before:
            return reach.select("node_id", "step", F.col("at").alias("ancestor_id"))
        if length >= deepest:
            raise ValueError(f"a chain of more than {deepest} nodes")
        second = hops.select(F.col("at").alias("up"), F.col("up").alias("top"))
        hops, length = store.staged(hops.join(second, "up").select("at", F.col("top").alias("up")), "hops"), 2 * length


def span_provenance(spans: DataFrame, links: DataFrame, tree: DataFrame, deepest: int = 256) -> DataFrame:
    """span_id, node_id, step, ancestor_id: each span's node (of several links the one with the least ordinal_no, then node_id) and the chain
    from it to the root. A span without a link, or whose node is not in the tree, has no rows. Chains are found once a node, not once a span."""
    own = spans.select("span_id").distinct().join(links, "span_id").groupBy("span_id").agg(F.min(F.struct("ordinal_no", "node_id")).alias("link")).select("span_id", "link.node_id")
    return own.join(chains(tree, own, deepest), "node_id").select("span_id", "node_id", "step", "ancestor_id")
