"""The way of a batch of source files into versions, bundle files and spans."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ident, text
from ..sources import pairs, store
from . import contracts, reconcile
from .knowledge import first_rejection


@dataclass(frozen=True)
class Ingested:
    """What a batch leaves: all versions, the batch's files and spans, and a row for each source with its outcome."""

    versions: DataFrame
    files: DataFrame
    spans: DataFrame
    results: DataFrame


def ingest(sources: DataFrame, parsed: DataFrame | None, nodes: DataFrame | None, versions: DataFrame | None, generated_by: str | None) -> Ingested:
    """Take source files (source_uri, distinct; content, null for a missing file) into the versions (doc_id, content_hash, version_no, is_active).

    parsed: source_uri, source_sha256 (of the bytes that the parser read), docling_version; nodes: source_uri, ordinal, page_no, headings, start_offset, text.
    Checks, in order, the first breach being the source's outcome: the file exists (else nothing is registered); registering (known content
    keeps its version, other content becomes the next and retires the last); it was parsed; the parser read the registered content; the files of the pair can be
    made; the sidecar reads back with ids that fit. The rest is `ingested`. A failing source holds no other back and leaves no spans; its version
    stays registered, so that a later batch can go on from it. Spans are those of the batch's versions only, in order of the sidecar, a path
    of no headings as an empty list. Missing inputs raise before anything is read. Document ids are names of the URI, version ids of document and number."""
    needed = {"parsed": parsed, "nodes": nodes, "versions": versions, "generated_by": generated_by}
    if missing := [k for k, v in needed.items() if v is None]:
        raise ValueError(f"missing: {', '.join(missing)}")
    named = sources.select("source_uri", F.when(F.col("content").isNotNull(), ident.content_hash(F.col("content"))).alias("content_hash"), ident.uuid5(F.col("source_uri")).alias("doc_id"))
    after = store.staged(reconcile.registered(versions, named.filter("content_hash is not null").select("doc_id", "content_hash")), "versions")
    version_id = ident.uuid5(F.concat_ws("|", "doc_id", F.col("version_no").cast("string")))
    held = named.join(after.select("doc_id", "content_hash", "version_no"), ["doc_id", "content_hash"], "left").withColumn("version_id", F.when(F.col("version_no").isNotNull(), version_id))
    seen = held.join(parsed.select("source_uri", "source_sha256", "docling_version"), "source_uri", "left")
    early = first_rejection([("source not found", F.col("content_hash").isNotNull()), ("not parsed", F.col("source_sha256").isNotNull()), ("content hash mismatch", F.col("source_sha256") == F.col("content_hash"))])
    seen = store.staged(seen.withColumn("early", early), "sources")
    ready = seen.filter("early is null").select("source_uri", F.col("version_id").alias("name"), "doc_id", "version_id", F.col("content_hash").alias("source_checksum"), "docling_version")
    files = store.staged(pairs.raw_pairs(ready, nodes, generated_by, "source_uri"), "pairs")
    read = contracts.sidecars(files.select("doc_id", "version_id", "error", "span_count", "dropped_nodes", F.col("sidecar").alias("json")), "json")
    outcome = F.coalesce("error", "breach", F.when(~F.coalesce(contracts.ids_fit("sidecar"), F.lit(False)), "ids do not fit"), F.lit("ingested"))
    judged = read.withColumn("late", outcome)  # each file by itself: texts stay where they lie
    results = seen.join(judged.select("version_id", "late", "span_count", "dropped_nodes"), "version_id", "left").select("source_uri", "doc_id", "version_id", F.coalesce("early", "late").alias("outcome"), F.when(F.col("late") == "ingested", F.col("span_count")).otherwise(0).alias("spans"), F.coalesce("dropped_nodes", F.lit(0)).alias("dropped_nodes"))
    # no filter, which would sink below the parsing and repeat it
    back = judged.select("doc_id", "version_id", F.posexplode(F.when(F.col("late") == "ingested", F.col("sidecar.spans"))).alias("index", "s"))
    spans = back.select("doc_id", "version_id", "s.span_id", "index", "s.page_no", F.col("s.heading_path").alias("headings"), F.col("s.offset").alias("start_offset"), text.collapsed(F.col("s.text")).alias("text"))
    return Ingested(after, files, spans, results)
