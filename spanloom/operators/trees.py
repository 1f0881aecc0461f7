"""Trees from spans: groups of headings, semantic splits, page ranges, summaries; desired states and entities of nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ident, text
from . import fuse

#: Words that mark a domain, first domain first.
DOMAINS = {
    "ml": ("machine learning", "neural network", "deep learning", "algorithm", "model", "training"),
    "cooking": ("cooking", "recipe", "pasta", "ingredient", "dish", "food", "kitchen"),
    "medicine": ("medical", "health", "doctor", "patient", "treatment", "disease"),
    "finance": ("finance", "investment", "stock", "market", "money", "bank"),
    "sports": ("sports", "game", "team", "player", "match", "score"),
}
#: Letters of a summary; a text has one at least, so no more than half as many texts can be in one.
LONGEST = 1000


def domain_of(column: Column, domains: dict[str, tuple[str, ...]]) -> Column:
    """The first domain one of whose words stands in the text, else default."""
    low, out = F.lower(F.coalesce(column, F.lit(""))), F.lit("default")
    for name, words in reversed(domains.items()):
        found = F.lit(False)
        for w in words:
            found = found | low.contains(w)
        out = F.when(found, name).otherwise(out)
    return out


def _joined(rows: DataFrame, keys: list[str], order: list[str], column: str) -> DataFrame:
    """keys, summary: texts in order with blanks between, the first LONGEST letters."""
    some = rows.filter(F.coalesce(F.col(column), F.lit("")) != "")
    first = some.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_n") <= LONGEST // 2 + 1)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", F.col(column).alias("t")))), lambda x: x["t"]), " ")
    return first.groupBy(*keys).agg(F.substr(whole, F.lit(1), F.lit(LONGEST)).alias("summary_text"))


def generated(spans: DataFrame, domains: dict[str, tuple[str, ...]] = DOMAINS, deepest: int = 32) -> tuple[DataFrame, DataFrame]:
    """(nodes, node_spans) of all versions. spans: version_id, span_id, heading_path, start_offset, page_no, raw_text.

    Spans of a heading make a leaf, or one a domain where they speak of several (numbered by first
    appearance). Headings above are made once: their pages are those of the first heading below them,
    in order of their parts. Nodes without a summary of their own take those of their children, level by level."""
    parts = F.filter(F.transform(F.split(F.coalesce("heading_path", F.lit("(root)")), " > "), lambda p: F.trim(p)), lambda p: p != "")
    rows = spans.withColumn("parts", F.when(F.size(parts) > 0, parts).otherwise(F.array(F.lit("(root)")))).withColumn("domain", domain_of(F.col("raw_text"), domains))
    group = Window.partitionBy("version_id", "parts")
    rows = rows.withColumn("_at", F.row_number().over(group.orderBy("start_offset", "span_id", "raw_text")))
    order = rows.groupBy("version_id", "parts", "domain").agg(F.min("_at").alias("_first"))
    order = order.select("version_id", "parts", "domain", (F.row_number().over(group.orderBy("_first")) - 1).alias("cluster"), (F.count(F.lit(1)).over(group) > 1).alias("split"))
    rows = rows.join(order, ["version_id", "parts", "domain"]).withColumn("cluster", F.when(F.col("split"), F.col("cluster")))
    path, level = F.array_join("parts", " > "), F.size("parts") - 1
    seed = lambda p, n: F.concat_ws(":", F.col("version_id"), p, n.cast("string"))
    leaf_seed = F.concat_ws(":", seed(path, level), F.concat(F.lit("cluster"), F.col("cluster")))  # concat_ws leaves out a null
    rows = rows.withColumn("node_id", ident.uuid5(leaf_seed))
    node_spans = rows.select("node_id", "version_id", "span_id", (F.row_number().over(Window.partitionBy("node_id").orderBy("_at")) - 1).alias("ordinal"))
    own = rows.groupBy("node_id", "version_id", "parts", "cluster").agg(F.min("page_no").alias("page_start"), F.max("page_no").alias("page_end"))
    leaves = own.join(_joined(rows, ["node_id"], ["_at"], "raw_text"), "node_id", "left").withColumn("leaf", F.lit(True))
    pages = rows.groupBy("version_id", "parts").agg(F.min("page_no").alias("page_start"), F.max("page_no").alias("page_end"))
    above = pages.filter(F.size("parts") > 1).select("version_id", "page_start", "page_end", "parts", F.explode(F.sequence(F.lit(1), F.size("parts") - 1)).alias("_n"))
    above = above.groupBy("version_id", F.slice("parts", F.lit(1), F.col("_n")).alias("up")).agg(F.min_by(F.struct("page_start", "page_end"), "parts").alias("p"))
    taken = leaves.filter("cluster is null").select("version_id", F.col("parts").alias("up"))  # a heading with spans of its own is its own parent
    parents = above.join(taken, ["version_id", "up"], "left_anti").select("version_id", F.col("up").alias("parts"), "p.page_start", "p.page_end")
    parents = parents.withColumns({"node_id": ident.uuid5(seed(path, level)), "cluster": F.lit(None).cast("int"), "summary_text": F.lit(None).cast("string"), "leaf": F.lit(False)})
    every = leaves.unionByName(parents)
    parent = F.when(F.size("parts") > 1, ident.uuid5(seed(F.array_join(F.slice("parts", F.lit(1), level), " > "), level - 1)))
    nodes = every.withColumns({"level_no": level, "parent_node_id": parent, "title": F.element_at("parts", -1), "heading_path": path, "node_type": F.when(level == 0, "chapter").otherwise("section")})
    nodes = nodes.persist()  # a row a heading; every level reads it, and its plan would be repeated in each
    depth = (rows.agg(F.max(F.size("parts"))).first()[0] or 1) - 1  # one number
    if depth > deepest:
        raise ValueError(f"deeper than {deepest}")
    done, below = None, None
    for n in reversed(range(depth + 1)):  # a level needs the one below it, no other
        here = nodes.filter(F.col("level_no") == n)
        if below is not None:
            some = below.filter("summary_text is not null").select(F.col("parent_node_id").alias("node_id"), "parts", F.coalesce("cluster", F.lit(2**31 - 1)).alias("cluster"), "summary_text")
            up = _joined(some, ["node_id"], ["parts", "cluster"], "summary_text").withColumnRenamed("summary_text", "_up")
            here = here.join(up, "node_id", "left").withColumn("summary_text", F.coalesce("summary_text", "_up")).drop("_up")
        below = here
        done = here if done is None else done.unionByName(here)
    return done.drop("parts"), node_spans


def desired_state(spans: DataFrame, domains: dict[str, tuple[str, ...]] = DOMAINS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, node_spans, chunks): a tree, and a chunk for each span under its node. A span that the
    tree does not cover is an error. Chunks are numbered by ranges of the order, so no version falls to one task."""
    nodes, node_spans = generated(spans, domains)
    joined = spans.join(node_spans.select("span_id", "version_id", "node_id"), ["span_id", "version_id"], "left")
    covered = F.when(F.col("node_id").isNull(), F.raise_error(F.concat(F.lit("no node covers span "), F.col("span_id"))).cast("string")).otherwise(F.col("node_id"))
    seed = F.concat(F.lit('{"span_id":"'), F.col("span_id"), F.lit('","version_id":"'), F.col("version_id"), F.lit('"}'))
    rows = joined.select(ident.uuid5(seed).alias("chunk_id"), "version_id", "span_id", "start_offset", text.word_count(F.col("raw_text")).alias("token_count"), "page_no", "heading_path", covered.alias("node_id"), F.col("raw_text").alias("text_preview"))
    placed = fuse.ranked(rows, "version_id", [F.asc("start_offset"), F.asc("span_id")]).withColumn("chunk_order", F.col("rank") - 1)
    return nodes, node_spans, placed.select("chunk_id", "version_id", "span_id", "chunk_order", "token_count", "page_no", "heading_path", "node_id", "text_preview")


def entity_name(title: Column, heading_path: Column, summary: Column) -> Column:
    """The title, else the last part of the path, else the summary's first four words; null without any."""
    clean = lambda c: F.trim(F.coalesce(c, F.lit("")))
    parts = F.filter(F.transform(F.split(clean(heading_path), ">"), lambda p: F.trim(p)), lambda p: p != "")
    words = F.array_join(F.slice(F.filter(F.split(clean(summary), r"\s+"), lambda w: w != ""), 1, 4), " ")
    return F.nullif(F.coalesce(F.nullif(clean(title), F.lit("")), F.try_element_at(parts, F.lit(-1)), words), F.lit(""))


def node_entities(nodes: DataFrame, node_spans: DataFrame, entity_type: str = "concept", confidence: float = 0.7) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, node links, evidence links): a node with a name and a span stands for an entity; entities
    of equal slugs are one, described by its first node (by level, path, id)."""
    first = node_spans.groupBy("node_id").agg(F.min_by("span_id", "ordinal").alias("span_id"))
    name = entity_name(F.col("title"), F.col("heading_path"), F.col("summary_text"))
    key = F.concat(F.lit(f"{entity_type}:"), F.regexp_replace(F.lower("name"), "[^a-z0-9]", ""))
    rows = nodes.join(first, "node_id").withColumn("name", name).filter("name is not null").withColumn("entity_key", key).withColumn("entity_id", ident.uuid5(F.col("entity_key")))
    best = F.min_by(F.struct("name", "summary_text"), F.struct("level_no", "heading_path", "node_id"))
    entities = rows.groupBy("entity_id", "entity_key").agg(best.alias("b")).select("entity_id", "entity_key", F.lit(entity_type).alias("entity_type"), F.col("b.name").alias("canonical_name"), F.col("b.summary_text").alias("description"))
    links = rows.select("node_id", "version_id", "entity_id", F.lit(0).alias("ordinal_no"), F.lit(confidence).alias("confidence_score"), F.col("name").alias("mention_text"))
    evidence = rows.select("entity_id", "version_id", "span_id", F.lit("tree_summary").alias("source_kind"), F.lit(confidence).alias("confidence_score"))
    return entities, links, evidence
