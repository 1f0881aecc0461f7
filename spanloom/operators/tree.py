"""Trees with text: page and heading mapping, evidence texts, traversal, registry reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text


def most_specific(hits: DataFrame, nodes: DataFrame, key: str, scope: str = "version_id") -> DataFrame:
    """The deepest node of the hit's version whose pages hold its page: by level, length of path, length of
    title. Nodes are dealt out by page, so the join is by equality; it is a merge, as a node's pages count for nothing
    in Spark's estimate of its size, by which all of them would be sent to every executor."""
    by_page = nodes.filter("page_start <= page_end").withColumn("page_no", F.explode(F.sequence("page_start", "page_end")))
    joined = hits.join(by_page.hint("merge"), [scope, "page_no"])
    w = Window.partitionBy(key).orderBy(F.desc("level_no"), F.desc(F.length("heading_path")), F.desc(F.length("title")), "node_id")
    return joined.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def evidence_text(hits: DataFrame, span_texts: DataFrame, key: str, fallback: str, longest: int = 1600) -> DataFrame:
    """Adds evidence: the hit's spans in order, else the fallback; collapsed and clipped."""
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", "raw_text")))
    joined = span_texts.groupBy(key).agg(F.array_join(F.transform(ordered, lambda s: s["raw_text"]), " ").alias("whole_"))
    return hits.join(joined, key, "left").withColumn("evidence", text.clipped(F.coalesce("whole_", F.col(fallback)), longest)).drop("whole_")


def descend(tree: DataFrame, scores: DataFrame, start: list[str], least_gain: float = 0.0, deepest: int = 32) -> DataFrame:
    """node_id, step, action: from the start nodes, one level a round, to the best child while it scores
    better than its parent by the gain; the frontier is one node a start, and a round is a join."""
    spark = tree.sparkSession
    children = tree.select("node_id", F.col("parent_node_id").alias("parent")).join(scores.select("node_id", "score"), "node_id")
    best = children.groupBy("parent").agg(F.max_by("node_id", F.struct("score", "node_id")).alias("child"), F.max("score").alias("child_score"))
    frontier = spark.createDataFrame([(s,) for s in start], "start string").join(scores.select(F.col("node_id").alias("start"), "score"), "start").select("start", F.col("start").alias("node_id"), "score")
    visited = None
    for step in range(deepest):
        moved = frontier.join(best, frontier["node_id"] == best["parent"], "left")
        drill = F.coalesce(F.col("child_score") - F.col("score") > least_gain, F.lit(False))
        here = moved.select("start", "node_id", F.lit(step).alias("step"), F.when(drill, "drill").when(F.col("child").isNull(), "leaf").otherwise("keep").alias("action"))
        visited = here if visited is None else visited.unionByName(here)
        frontier = moved.filter(drill).select("start", F.col("child").alias("node_id"), F.col("child_score").alias("score"))
        if frontier.isEmpty():
            return visited
    raise ValueError(f"deeper than {deepest}")


def traced(chunks: DataFrame, versions: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks with the version and document they come from."""
    return chunks.join(versions, "version_id").join(documents, "doc_id")


def active(versions: DataFrame, version_id: str | None = None) -> DataFrame:
    """The named version, or all active ones."""
    return versions.filter(F.col("is_active") if version_id is None else F.col("version_id") == version_id)


def inventory(scope: DataFrame, desired: DataFrame, key: str) -> DataFrame:
    """Rows in scope or with a desired key, each key once; those in scope come first."""
    both = scope.withColumn("_p", F.lit(0)).unionByName(desired.withColumn("_p", F.lit(1)))
    return both.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("_p"))).filter("_n = 1").drop("_n", "_p")


def coverage(children: DataFrame, parent: str, hot: Column) -> DataFrame:
    """parent, children, hot, ratio: how many of a parent's children are hot."""
    flag = F.coalesce(hot, F.lit(False)).cast("int")
    return children.groupBy(parent).agg(F.count(F.lit(1)).alias("children"), F.sum(flag).alias("hot"), F.avg(flag).alias("ratio"))


def heading_stack(lines: DataFrame, key: str, order: str, level: Column, deepest: int = 6) -> DataFrame:
    """Adds path: for each line the headings above it; a heading replaces its own level and clears deeper
    ones. One window of running maxima; level is null for lines that are no heading."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("_level", level)
    last = {n: F.max(F.when(F.col("_level") == n, F.struct(F.col(order), F.col("title")))).over(w) for n in range(1, deepest + 1)}
    marked = marked.withColumns({f"_h{n}": c for n, c in last.items()})
    parts = []
    for n in range(1, deepest + 1):
        shallower = [F.coalesce(F.col(f"_h{m}.{order}"), F.lit(-1)) for m in range(1, n)]
        above = F.greatest(F.lit(-1), F.lit(-1), *shallower)
        parts.append(F.when(F.col(f"_h{n}.{order}") > above, F.col(f"_h{n}.title")))
    return marked.withColumn("path", F.array_join(F.array_compact(F.array(*parts)), " > ")).drop("_level", *(f"_h{n}" for n in range(1, deepest + 1)))
