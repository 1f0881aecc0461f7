"""Reads of the registry: rows of versions in order, lookups over links, version states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Stages of processing, in order.
STAGES = ("registered", "parsed", "chunks_created", "embedded", "tree_built", "entities_extracted", "complete", "failed")


def of_versions(rows: DataFrame, versions: DataFrame, order: list[str], version_id: str | None = None) -> DataFrame:
    """Rows of the named version, or of all active ones, in order. The filter on version_id reaches the scan."""
    if version_id is not None:
        return rows.filter(F.col("version_id") == version_id).orderBy(*order)
    return rows.join(versions.filter("is_active").select("version_id"), "version_id", "left_semi").orderBy("version_id", *order)


def linked(links: DataFrame, owners: DataFrame, key: str, order: list[str], version_id: str | None = None) -> DataFrame:
    """Links with the version of the node or chunk that they belong to."""
    own = owners.select(key, "version_id") if version_id is None else owners.filter(F.col("version_id") == version_id).select(key, "version_id")
    return links.join(own, key).orderBy("version_id", *order)


def entity_lookups(links: DataFrame, owners: DataFrame, entities: DataFrame, key: str) -> DataFrame:
    """Both directions of a link table: for each link, the owner's version and place and the entity's key,
    with the place of the entity among the owner's and of the owner among the entity's."""
    joined = links.join(owners.select(key, "version_id"), key).join(entities.select("entity_id", "entity_key", "entity_type"), "entity_id")
    to_entity = F.row_number().over(Window.partitionBy(key).orderBy("ordinal_no", F.desc_nulls_last("confidence_score"), "entity_key"))
    to_owner = F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc_nulls_last("confidence_score"), "version_id", key))
    return joined.withColumns({"entity_place": to_entity, "owner_place": to_owner})


def newest(versions: DataFrame, status: str | None = None) -> DataFrame:
    """Active versions, newest first, of one status if it is named."""
    rows = versions.filter("is_active")
    return (rows if status is None else rows.filter(F.col("processing_status") == status)).orderBy(F.desc("created_at"), "version_id")


def listed(versions: DataFrame) -> DataFrame:
    """All versions of each document, the latest first: place 1."""
    return versions.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("version_no"))))


def span_scan(spans: DataFrame, page: int | None = None, limit: int = 1000) -> DataFrame:
    """Spans in order, of one page if it is named; `limit` at most, which is the report's feature."""
    rows = spans if page is None else spans.filter(F.col("page_no") == page)
    return rows.orderBy("version_id", "start_offset", "span_id").limit(limit)


def stamped(before: DataFrame, after: DataFrame, key: str, now: Column) -> DataFrame:
    """after with status_changed_at: `now` where the status differs from before or is new, else what it was."""
    old = before.select(key, F.col("processing_status").alias("_status"), F.col("status_changed_at").alias("_at"))
    joined = after.join(old, key, "left")
    return joined.withColumn("status_changed_at", F.when(F.col("processing_status").eqNullSafe(F.col("_status")), F.col("_at")).otherwise(now)).drop("_status", "_at")


def unfinished(versions: DataFrame, node_links: DataFrame, evidence_links: DataFrame) -> DataFrame:
    """Versions that may not be finalized: neither nodes nor evidence link to an entity."""
    done = node_links.select("version_id").unionByName(evidence_links.select("version_id"))
    return versions.join(done, "version_id", "left_anti")


def attached_leaves(chunks: DataFrame, chunk_spans: DataFrame, node_spans: DataFrame, spans: DataFrame) -> DataFrame:
    """Chunks with the node of their spans: a mapping counts for chunks of the span's own version that hold
    the span; of several, the last by `ordinal` wins. Chunks without one keep what they have."""
    own = spans.select("span_id", F.col("version_id").alias("_v"))
    found = chunk_spans.select("chunk_id", "span_id").join(own, "span_id").join(node_spans.select("span_id", F.col("node_id").alias("_node"), F.col("ordinal").alias("_o")), "span_id")
    last = found.groupBy("chunk_id", "_v").agg(F.max(F.struct("_o", "_node"))["_node"].alias("_node"))
    return chunks.join(last.withColumnRenamed("_v", "version_id"), ["chunk_id", "version_id"], "left").withColumn("node_id", F.coalesce("_node", "node_id")).drop("_node")


def node_hits(nodes: DataFrame, node_spans: DataFrame, chunk_spans: DataFrame) -> DataFrame:
    """node_id, chunk_id, place, score (null): the chunks that hold a span of the node, each once, in order of its first."""
    found = nodes.select("node_id").join(node_spans, "node_id").join(chunk_spans.select("chunk_id", "span_id"), "span_id")
    first = found.groupBy("node_id", "chunk_id").agg(F.min("ordinal").alias("first"))
    return first.select("node_id", "chunk_id", F.row_number().over(Window.partitionBy("node_id").orderBy("first", "chunk_id")).alias("place"), F.lit(None).cast("double").alias("score"))
