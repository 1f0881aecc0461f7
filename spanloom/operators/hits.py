"""Retrieval hits: enrichment, mapping to nodes, reranking, repair, and answers."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import store
from . import distribution, fuse


def enriched(hits: DataFrame, chunks: DataFrame, links: DataFrame) -> DataFrame:
    """Hits with their chunk's columns and the ids of its spans in order; hits of unknown chunks are dropped."""
    ordered = F.array_sort(F.collect_list(F.struct("ordinal_no", "span_id")))
    spans = links.groupBy("chunk_id").agg(F.transform(ordered, lambda s: s["span_id"]).alias("span_ids"))
    return hits.join(chunks, "chunk_id").join(spans, "chunk_id", "left").withColumn("span_ids", F.coalesce("span_ids", F.array().cast("array<string>")))


def first_per_chunk(hits: DataFrame, nil: str = "") -> DataFrame:
    """The first hit of each chunk, in order of the hits; hits without a chunk are dropped."""
    w = Window.partitionBy("chunk_id").orderBy("ordinal")
    return hits.filter(F.coalesce("chunk_id", F.lit(nil)) != nil).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def reranked(hits: DataFrame, k: int = 60, bonus: float = 0.1) -> DataFrame:
    """Hits (key, path, ordinal, score) scored anew: normalized by path, reciprocal ranks, bonus; with ranks."""
    fused = fuse.fuse(hits, "key", k, bonus).withColumn("_all", F.lit(0))
    return fuse.ranked(fused, "_all", [F.desc("fused"), F.desc_nulls_last("score"), F.asc("key")]).drop("_all")


def fused_by_span(hits: DataFrame, k: int = 60) -> DataFrame:
    """Merge by span: ranks are given before duplicates go, and of duplicates the last rank counts."""
    ranked = fuse.ranked(hits, "path", [F.desc_nulls_last("score"), F.asc("ordinal")])
    last = ranked.groupBy("path", "span_id").agg(F.max("rank").alias("rank"), F.max("score").alias("score"))
    return last.groupBy("span_id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 10).alias("fused"), F.max("score").alias("score"), F.count(F.lit(1)).alias("paths"))


def channel_titles(relations: DataFrame, entities: DataFrame, chunks: DataFrame, limit: int) -> DataFrame:
    """Titles of relations (source->target), entities and chunks, in that order, malformed ones skipped, each once."""
    rows = (
        relations.filter("source is not null and target is not null").select(F.lit(0).alias("kind"), "ordinal", F.concat_ws("->", "source", "target").alias("title"))
        .unionByName(entities.filter("name is not null and name <> ''").select(F.lit(1).alias("kind"), "ordinal", F.col("name").alias("title")))
        .unionByName(chunks.filter("title is not null and title <> ''").select(F.lit(2).alias("kind"), "ordinal", "title"))
    )
    first = rows.groupBy("title").agg(F.min(F.struct("kind", "ordinal")).alias("at"))
    return first.select("title", "at.kind", "at.ordinal").orderBy("kind", "ordinal", "title").limit(limit)


def nodes_of_hits(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """hits with the node of the first chunk of an equal heading path; hits without one are dropped."""
    own = chunks.filter("node_id is not null").groupBy("heading_path").agg(F.min_by("node_id", "chunk_order").alias("node_id"))
    return hits.join(own, "heading_path")


def expanded(hits: DataFrame, rolled: DataFrame, spans: DataFrame, top: int) -> DataFrame:
    """Hits, and with score 0 the spans of the `top` best nodes that no hit has; key span_id."""
    best = rolled.orderBy(F.desc("total"), "node").limit(top).select(F.col("node").alias("heading_path"))
    more = spans.join(F.broadcast(best), "heading_path").select("span_id", "heading_path", F.lit(0.0).alias("score"))  # `top` rows
    return hits.select("span_id", "heading_path", "score").unionByName(more.join(hits.select("span_id"), "span_id", "left_anti"))


#: How many of the best nodes a decision takes; a scattered spread takes all.
TAKEN = {"high_concentration": 2, "moderate": 1}


def suggested(rolled: DataFrame) -> DataFrame:
    """node_id, rank, decision: the nodes that the spread of totals (node_id, total) says to expand, best first."""
    spread = distribution.spread(rolled).withColumn("decision", distribution.decision())
    many = F.when(F.col("decision") == "high_dispersion", F.col("nodes"))
    for name, n in TAKEN.items():
        many = many.when(F.col("decision") == name, n)
    verdict = spread.filter("nodes > 0").select("decision", many.alias("many_"))
    ranked = fuse.ranked(rolled.withColumns({"_all": F.lit(0), "total": F.round("total", 9)}), "_all", [F.desc("total"), F.asc("node_id")])
    return ranked.join(F.broadcast(verdict), F.col("rank") <= F.col("many_")).select("node_id", "rank", "decision")  # one row


def expansion(hits: DataFrame, ancestors: DataFrame, links: DataFrame, k: int = 60, bonus: float = 0.1) -> DataFrame:
    """The whole loop: decide from the hits' spread over the tree, fetch the spans of the nodes that it names and of their parents, merge, rank anew.

    hits: key (a span), path, ordinal, score, node_id (null for none); ancestors: node_id, ancestor_id, distance; links: node_id, key, ordinal_no.
    Returns key, fused, score, source_paths, rank, decision, expanded. A span of several hits counts with its best one; fetched spans
    are a list of their own at score 0, those of better nodes first, parents' last. Without a hit on a node the
    decision is no_hits and nothing is fetched."""
    best = hits.groupBy("key").agg(F.max(F.struct(F.coalesce("score", F.lit(0.0)).alias("score"), "node_id")).alias("b")).select("key", "b.*")
    rolled = store.staged(distribution.tree_roll_up(best.filter("node_id is not null"), ancestors), "rolled")
    chosen = store.staged(suggested(rolled), "suggested")
    up = chosen.join(ancestors.filter("distance = 1"), "node_id").select(F.col("ancestor_id").alias("node_id"), "rank", F.lit(1).alias("up"))
    nodes = chosen.select("node_id", "rank", F.lit(0).alias("up")).unionByName(up).groupBy("node_id").agg(F.min(F.struct("up", "rank")).alias("at"))
    found = links.join(nodes, "node_id").groupBy("key").agg(F.min(F.struct("at.up", "at.rank", "ordinal_no")).alias("place")).select("key", "place.up", F.col("place.rank").alias("of"), "place.ordinal_no", F.lit(0).alias("_all"))
    fetched = fuse.ranked(found, "_all", [F.asc("up"), F.asc("of"), F.asc("ordinal_no"), F.asc("key")]).select("key", F.lit("tree_expansion").alias("path"), F.col("rank").alias("ordinal"), F.lit(0.0).alias("score"))
    both = hits.select("key", "path", "ordinal", "score").unionByName(fetched)
    decision = chosen.agg(F.coalesce(F.min("decision"), F.lit("no_hits")).alias("decision"))  # one row
    return reranked(both, k, bonus).join(F.broadcast(decision), F.lit(True)).withColumn("expanded", F.col("source_paths") == "tree_expansion")


def repaired(chunks: DataFrame, embed: Column, nodes: DataFrame) -> DataFrame:
    """Chunks with what they lack: embeddings computed, nodes looked up; complete ones are not touched."""
    whole = chunks.filter("embedding is not null and node_id is not null").withColumn("repaired", F.lit(False))
    broken = chunks.filter("embedding is null or node_id is null").join(nodes.select("chunk_id", F.col("node_id").alias("found")), "chunk_id", "left")
    fixed = broken.withColumns({"embedding": F.coalesce("embedding", embed), "node_id": F.coalesce("node_id", "found"), "repaired": F.lit(True)}).drop("found")
    return whole.unionByName(fixed)


def manifest_digest(files: DataFrame, keys: list[str], fan_out: int = 256, digits: int | None = None) -> DataFrame:
    """files, digest: one digest of a table of files, by a tree. Files fall to groups by the first digits of
    the digest of their keys, so many that a group has about `fan_out`; a group's rows as JSON, in order,
    give its digest, and each level up hashes the sixteen digests below, down to one. `digits` fixes the levels. A group's rows
    are sorted by Spark and hashed one after another, so none is held whole."""
    count = files.count()
    digits = digits or (max(1, math.ceil(math.log(max(count, 1) / fan_out, 16))) if count > fan_out else 1)
    own = lambda values: F.sha2(F.array_join(values, "\n"), 256)
    group = F.substr(F.sha2(F.concat_ws("|", *keys), 256), F.lit(1), F.lit(digits))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, hashlib.sha256()
        for batch in batches:
            for g, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if g == now:
                    digest.update(b"\n")
                elif now is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([digest.hexdigest()])], names=["_g", "d"])
                if g != now:
                    now, digest = g, hashlib.sha256()
                digest.update(line.encode())
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([digest.hexdigest()])], names=["_g", "d"])

    lines = files.select(group.alias("_g"), F.to_json(F.struct(*sorted(files.columns))).alias("line"))
    level = lines.repartition("_g").sortWithinPartitions("_g", "line").mapInArrow(hashed, "_g string, d string")
    for n in reversed(range(digits)):
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("_g", "d"))), lambda x: x["d"])
        level = level.groupBy(F.substr("_g", F.lit(1), F.lit(n)).alias("_up")).agg(own(ordered).alias("d")).withColumnRenamed("_up", "_g")
    return level.select(F.lit(count).cast("bigint").alias("files"), F.col("d").alias("digest"))
