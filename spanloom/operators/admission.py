"""Proposals, admission of bundles and checks of schemas, as columns that say what becomes of a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ident

#: Kinds of files that make up one document of a bundle.
TRIPLE = (".md", ".spans.json", ".pair.json")
#: Fields that a type's schema must and may have.
SCHEMA_FIELDS, SCHEMA_OPTIONS = ("name", "description"), ("required_fields", "allowed_source_types", "allowed_target_types")


def proposals(rows: DataFrame, roots: list[str]) -> DataFrame:
    """rows with proposal_id, unverified (no evidence), status and breach (null for proposals that may be written).
    rows: target_file, patch, actor, created_at, evidence (array). The id is made of the content."""
    quoted = [F.concat(F.lit('"'), F.regexp_replace(F.coalesce(c, F.lit("")), r'(["\\])', r"\\$1"), F.lit('"')) for c in ("target_file", "patch", "actor", "created_at")]
    path = F.col("target_file")
    breach = (
        F.when(path.startswith("/") | path.rlike(r"(^|/)\.\.(/|$)"), "target_file:not relative").when(~F.split(path, "/")[0].isin(*roots), "target_file:not writable")
        .when(F.trim(F.coalesce("actor", F.lit(""))) == "", "actor:missing").when(F.trim(F.coalesce("patch", F.lit(""))) == "", "patch:missing")
        .when(~F.coalesce(F.col("created_at").rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$") & F.try_to_timestamp("created_at").isNotNull(), F.lit(False)), "created_at:time")
        .when(F.exists("evidence", lambda e: F.trim(e) == ""), "evidence:blank")
    )
    return rows.withColumns({"proposal_id": ident.uuid5(F.concat(F.lit("["), F.concat_ws(",", *quoted), F.lit("]"))), "unverified": F.size("evidence") == 0, "status": F.lit("created"), "breach": breach})


def merged_text(existing: Column, patch: Column) -> Column:
    """The patch as the new body, after the front matter that the file has; an open front matter raises."""
    ended = F.when(patch.endswith("\n"), patch).otherwise(F.concat(patch, F.lit("\n")))
    head = F.regexp_extract(existing, r"(?s)\A([ \t]*---[ \t]*\n.*?\n?[ \t]*---[ \t]*(?:\n|\z))", 1)
    closed = F.when(head.endswith("\n"), head).otherwise(F.concat(head, F.lit("\n")))
    opened = F.coalesce(existing, F.lit("")).rlike(r"\A[ \t]*---[ \t]*\n")
    return F.when(~opened, ended).when(head == "", F.raise_error(F.lit("front matter is not closed")).cast("string")).otherwise(F.concat(closed, ended))


def applied(proposals_: DataFrame, files: DataFrame, journal: DataFrame) -> DataFrame:
    """Proposals with outcome and content, the file as it becomes. journal: proposal_id, status,
    payload_digest at the last review. Only approved, unchanged proposals are merged."""
    joined = proposals_.join(journal, "proposal_id", "left").join(files.select(F.col("path").alias("target_file"), "text"), "target_file", "left")
    outcome = F.when(F.coalesce("status", F.lit("")) != "approved", "not approved").when(F.col("payload_digest") != F.sha2("patch", 256), "payload changed").otherwise("merged")
    return joined.withColumn("outcome", outcome).withColumn("content", F.when(F.col("outcome") == "merged", merged_text(F.col("text"), F.col("patch")))).drop("text")


def triples(files: DataFrame) -> DataFrame:
    """slug, missing: the documents of a bundle by their files' names, and which of a triple's files are not there."""
    ending = F.coalesce(*(F.when(F.col("path").endswith(e), F.lit(e)) for e in sorted(TRIPLE, key=len, reverse=True)))
    rows = files.withColumn("ending", ending).filter("ending is not null").select(F.expr("substr(path, 1, length(path) - length(ending))").alias("slug"), "ending")
    have = rows.groupBy("slug").agg(F.collect_set("ending").alias("have"))  # three at most
    return have.select("slug", F.array_sort(F.array_except(F.array(*(F.lit(e) for e in TRIPLE)), "have")).alias("missing"))


def admitted(facts: DataFrame, spans: DataFrame) -> DataFrame:
    """natural_key, outcome, files: what becomes of each fact of a corpus. facts: kind, natural_key, qualifiers (JSON),
    path, span_id. unknown span: evidence that no span backs; duplicate concept: one from several files;
    conflict: an entity or relation whose files differ in qualifiers; else admitted, once for all its files."""
    known = facts.join(spans.select("span_id", F.lit(True).alias("_k")).distinct(), "span_id", "left")
    same = F.to_json(F.from_json(F.coalesce("qualifiers", F.lit("{}")), "map<string,string>"))
    sums = known.withColumn("_q", same).groupBy("kind", "natural_key").agg(F.max(F.col("span_id").isNotNull() & F.col("_k").isNull()).alias("lost"), F.countDistinct("path").alias("files"), F.min("_q").alias("a"), F.max("_q").alias("b"))
    outcome = F.when(F.col("lost"), "unknown span").when((F.col("kind") == "concept") & (F.col("files") > 1), "duplicate concept").when(F.col("a") != F.col("b"), "conflict").otherwise("admitted")
    return sums.select("kind", "natural_key", outcome.alias("outcome"), "files")


def checked_schemas(items: DataFrame) -> DataFrame:
    """item, name, breach of type schemas given as JSON objects: not an object, a field that is missing, unknown or
    of the wrong kind; null for good ones. Each item is judged by itself, so bad ones hide no others."""
    fields = F.from_json("item", "map<string,string>")
    known = F.array(*(F.lit(f) for f in (*SCHEMA_FIELDS, *SCHEMA_OPTIONS)))
    breach = F.when(F.col("f").isNull() | ~F.trim("item").startswith("{"), "not an object")
    for name in SCHEMA_FIELDS:
        breach = breach.when(F.trim(F.coalesce(F.col("f")[name], F.lit(""))) == "", f"{name}:missing")
    breach = breach.when(F.size(F.array_except(F.map_keys("f"), known)) > 0, "unknown field")
    for name in SCHEMA_OPTIONS:
        breach = breach.when(F.col("f")[name].isNotNull() & F.from_json(F.col("f")[name], "array<string>").isNull() | F.col("f")[name].isNotNull() & ~F.col("f")[name].startswith("["), f"{name}:list")
    return items.withColumn("f", fields).withColumn("breach", breach).select("item", F.col("f")["name"].alias("name"), "breach")
