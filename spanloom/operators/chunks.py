"""Chunks over spans: grouping, order, overlap, segments; trees from heading paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text


def by_heading(spans: DataFrame, joiner: str = "\n") -> DataFrame:
    """One chunk for each version and heading, its spans in order even where they lie apart;
    a span without heading is a chunk of its own."""
    key = F.when(F.col("heading_path").isNull(), F.concat_ws(":", F.col("version_id"), F.lit("orphan"), F.col("ordinal"))).otherwise(F.concat_ws(":", F.col("version_id"), F.lit("heading"), F.col("heading_path")))
    ordered = F.array_sort(F.collect_list(F.struct("start_offset", "ordinal", "raw_text")))
    grouped = spans.withColumn("chunk_id", key).groupBy("version_id", "chunk_id").agg(
        F.min("start_offset").alias("start_offset"), F.first("heading_path").alias("heading_path"), F.count(F.lit(1)).alias("n_spans"),
        F.array_join(F.transform(ordered, lambda s: s["raw_text"]), joiner).alias("chunk_text"),
    )
    order = F.row_number().over(Window.partitionBy("version_id").orderBy("start_offset", "chunk_id")) - 1
    return grouped.withColumns({"chunk_order": order, "token_count": text.word_count(F.col("chunk_text"))})


def overlapped(chunks: DataFrame, n: int, keys: list[str], order: list[str], column: str = "text") -> DataFrame:
    """Adds `widened`: the last n words of the chunk before, the chunk, the first n words of the next."""
    w = Window.partitionBy(*keys).orderBy(*order)
    words = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda t: t != "")
    before, after = words(F.lag(column).over(w)), words(F.lead(column).over(w))
    tail = F.when(F.size(before) <= n, before).otherwise(F.slice(before, F.greatest(F.size(before) - n + 1, F.lit(1)), n))
    parts = F.array(F.array_join(tail, " "), F.col(column), F.array_join(F.slice(after, 1, n), " ")) if n else F.array(F.col(column))
    return chunks.withColumn("widened", F.array_join(F.filter(parts, lambda p: p != ""), " "))


def token_segments(rows: DataFrame, n: int, keys: list[str], column: str = "text") -> DataFrame:
    """Runs of n words of each row: segment number, words, text."""
    words = F.filter(F.split(F.coalesce(column, F.lit("")), r"\s+"), lambda t: t != "")
    cuts = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size("w_") / n).cast("int") - 1, F.lit(0))), lambda i: F.slice(F.col("w_"), i * n + 1, n))
    out = rows.select(*keys, words.alias("w_")).filter(F.size("w_") > 0).select(*keys, F.posexplode(cuts).alias("segment", "s_"))
    return out.select(*keys, "segment", F.size("s_").alias("words"), F.array_join("s_", " ").alias("text"))


def tree_from_paths(spans: DataFrame, separator: str = " > ") -> DataFrame:
    """Nodes of all heading paths and their ancestors: spans of their own, first and last offset
    of their own spans; a missing path is (root)."""
    path = F.coalesce("heading_path", F.lit("(root)"))
    own = spans.groupBy("version_id", path.alias("path")).agg(F.count(F.lit(1)).alias("n"), F.min("start_offset").alias("first"), F.max("end_offset").alias("last"))
    every = own.select("version_id", F.posexplode(text.prefixes(F.col("path"), separator)).alias("level_no", "heading_path")).distinct()
    joined = every.join(own.withColumnRenamed("path", "heading_path"), ["version_id", "heading_path"], "left")
    parts = F.split("heading_path", separator)
    parent = F.when(F.col("level_no") > 0, F.concat_ws(":", F.col("version_id"), F.array_join(F.slice(parts, 1, F.col("level_no")), separator), F.col("level_no") - 1))
    return joined.select(
        F.concat_ws(":", "version_id", "heading_path", F.col("level_no")).alias("node_id"), "version_id", parent.alias("parent_node_id"), "level_no", F.element_at(parts, -1).alias("title"), "heading_path",
        F.coalesce("n", F.lit(0)).alias("span_count"), "first", "last",
    )


def ancestors(tree: DataFrame, node: str = "node_id", parent: str = "parent_node_id", deepest: int = 256) -> DataFrame:
    """node_id, ancestor_id, distance (0 is the node itself), by doubling the reach in each
    round: rounds grow with the logarithm of the depth. A cycle raises."""
    edges = tree.select(F.col(node).alias("node_id"), F.col(parent).alias("up")).filter("up is not null")
    reach = tree.select(F.col(node).alias("node_id"), F.col(node).alias("ancestor_id"), F.lit(0).alias("distance"))
    step, length = edges, 1
    while length <= deepest:
        hop = step.select(F.col("node_id").alias("ancestor_id"), "up")
        more = reach.join(hop, "ancestor_id").select("node_id", F.col("up").alias("ancestor_id"), (F.col("distance") + length).alias("distance"))
        if more.isEmpty():
            return reach
        reach = reach.unionByName(more)
        step = step.alias("a").join(step.alias("b"), F.col("a.up") == F.col("b.node_id")).select(F.col("a.node_id").alias("node_id"), F.col("b.up").alias("up"))
        length *= 2
    raise ValueError(f"a cycle, or a tree deeper than {deepest}")


def ancestors_by_path(tree: DataFrame, separator: str = " > ") -> DataFrame:
    """The same where heading paths name the nodes: one join on the paths' prefixes, no rounds."""
    up = tree.select("node_id", F.posexplode(text.prefixes(F.col("heading_path"), separator)).alias("_n", "heading_path"), F.size(F.split("heading_path", separator)).alias("_depth"))
    return up.join(tree.select(F.col("node_id").alias("ancestor_id"), "heading_path"), "heading_path").select("node_id", "ancestor_id", (F.col("_depth") - 1 - F.col("_n")).alias("distance"))


def siblings(tree: DataFrame) -> DataFrame:
    """node_id, sibling_id: children of the same parent, the node among them; a root has none."""
    kids = tree.filter("parent_node_id is not null")
    return kids.select("node_id", "parent_node_id").join(kids.select(F.col("node_id").alias("sibling_id"), "parent_node_id"), "parent_node_id").select("node_id", "sibling_id")


def resolved_nodes(chunks: DataFrame, links: DataFrame, span_nodes: DataFrame) -> DataFrame:
    """A chunk's node: its own, else that of its first linked span that has one."""
    found = links.join(span_nodes, "span_id").groupBy("chunk_id").agg(F.min_by("node_id", "ordinal_no").alias("linked_node"))
    return chunks.join(found, "chunk_id", "left").withColumn("node_id", F.coalesce("node_id", "linked_node")).drop("linked_node")


def exact_segments(docs: DataFrame, size: int, key: str, column: str = "text") -> DataFrame:
    """key, segment, start, stop (letters), words, segment_text: windows of `size` words that cover the text exactly. White space
    goes to the word before it, at the beginning to the first word, so that a text's segments in order are the text; a text
    without words is one segment, a null text has none. Keys must be distinct: offsets are sums over a key's segments."""
    word = r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"
    lead = F.regexp_extract(column, r"^[\x20\x09-\x0D]*", 0)
    cut = docs.filter(F.col(column).isNotNull()).select(key, lead.alias("lead_"), F.regexp_extract_all(column, F.lit(word), F.lit(0)).alias("words_"))
    count = F.greatest(F.ceil(F.size("words_") / size), F.lit(1)).cast("int")
    own = lambda i: F.slice("words_", i * size + 1, F.lit(size))
    part = lambda i: F.struct(F.size(own(i)).alias("words"), F.concat(F.when(i == 0, F.col("lead_")).otherwise(""), F.array_join(own(i), "")).alias("segment_text"))
    each = cut.select(key, F.posexplode(F.transform(F.sequence(F.lit(0), count - 1), part)).alias("segment", "s")).select(key, "segment", "s.*")
    stop = F.sum(F.length("segment_text")).over(Window.partitionBy(key).orderBy("segment").rowsBetween(Window.unboundedPreceding, 0))
    return each.withColumn("stop", stop).withColumn("start", F.col("stop") - F.length("segment_text")).select(key, "segment", "start", "stop", "words", "segment_text")
