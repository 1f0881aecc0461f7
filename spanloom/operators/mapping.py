"""Mapping of extracted entities and relations: label maps, ordered rejections; parsing of free output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .knowledge import first_rejection

#: Raw labels and the types they mean.
RAW_LABELS = {"PER": "Person", "LOC": "Location", "CORP": "Organization", "GRP": "Organization", "CW": "CreativeWork", "PROD": "Product"}
EXTRACTOR_LABELS = {"人名": "Person", "地名": "Location", "公司名": "Organization", "产品名": "Product"}


def canonical_type(label: Column, labels: dict[str, str] = RAW_LABELS) -> Column:
    """The type that a raw label means, exactly as written; null for an unknown one."""
    return F.create_map(*(F.lit(x) for pair in labels.items() for x in pair))[label]


def _present(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) != ""


def _long_enough(c: str) -> Column:
    return (F.length(c) >= 2) & ~F.col(c).rlike(r"\A\s*\z")


def mapped_entities(raw: DataFrame, labels: dict[str, str] = EXTRACTOR_LABELS) -> DataFrame:
    """raw with entity_type and rejection (null for accepted ones), by the first check that fails.

    raw: doc_id, position, is_mapping, text, char_start, char_end, label, has_confidence, confidence and
    normalized_text. Of accepted ones of equal text and place in a document the first stands, the
    others are duplicates."""
    fits = (F.col("char_start") >= 0) & (F.col("char_start") < F.col("char_end")) & (F.col("char_end") <= F.length("normalized_text"))
    sure = F.col("confidence").between(0, 1) & ~F.isnan("confidence")
    checks = [
        ("not_a_mapping", F.col("is_mapping")), ("missing_text", _present("text")), ("too_short", _long_enough("text")),
        ("missing_offset", F.col("char_start").isNotNull() & F.col("char_end").isNotNull()), ("out_of_range", fits),
        ("not_exact_slice", F.substr("normalized_text", F.col("char_start") + 1, F.col("char_end") - F.col("char_start")) == F.col("text")),
        ("unknown_entity_type", F.col("entity_type").isNotNull()), ("invalid_confidence", ~F.col("has_confidence") | F.coalesce(sure, F.lit(False))),
    ]
    rows = raw.withColumn("entity_type", canonical_type(F.col("label"), labels)).withColumn("rejection", first_rejection(checks))
    place = F.row_number().over(Window.partitionBy("doc_id", "text", "char_start", "char_end", F.col("rejection").isNull()).orderBy("position"))
    return rows.withColumn("rejection", F.coalesce("rejection", F.when(place > 1, "duplicate_span")))


def mapped_relations(raw: DataFrame, mentions: DataFrame, schema: DataFrame, labels: dict[str, str] = EXTRACTOR_LABELS) -> DataFrame:
    """raw with subject_type, object_type and rejection, by the first check that fails.

    raw: doc_id, position, is_mapping, source_text, normalized_text, subject_text, object_text, subject_label,
    object_label, relation. mentions: doc_id, text of accepted entities. schema: relation, subjects, objects
    (types that it allows), a few rows. The whole text is searched before any row is dealt out, so it moves only where
    the caller reads it on."""
    known = lambda side: mentions.select("doc_id", F.col("text").alias(f"{side}_text"), F.lit(True).alias(f"_{side}")).distinct()
    rows = raw.withColumns({"subject_type": canonical_type(F.col("subject_label"), labels), "object_type": canonical_type(F.col("object_label"), labels), "_found": F.contains("normalized_text", "source_text")})
    rows = rows.join(known("subject"), ["doc_id", "subject_text"], "left").join(known("object"), ["doc_id", "object_text"], "left").join(schema, "relation", "left")
    checks = [
        ("not_a_mapping", F.col("is_mapping")), ("missing_source_text", _present("source_text")), ("source_not_in_normalized_text", F.col("_found")),
        ("missing_text", _present("subject_text")), ("too_short", _long_enough("subject_text")), ("missing_text", _present("object_text")), ("too_short", _long_enough("object_text")),
        ("unknown_entity_type", F.col("subject_type").isNotNull() & F.col("object_type").isNotNull()), ("relation_not_in_schema", F.col("subjects").isNotNull()),
        ("subject_type_not_allowed", F.expr("array_contains(subjects, subject_type)")), ("object_type_not_allowed", F.expr("array_contains(objects, object_type)")),
        ("subject_not_in_source", F.contains("source_text", "subject_text")), ("object_not_in_source", F.contains("source_text", "object_text")),
        ("subject_not_a_mention", F.col("_subject")), ("object_not_a_mention", F.col("_object")), ("self_loop", F.col("subject_text") != F.col("object_text")),
    ]
    rows = rows.withColumn("rejection", first_rejection(checks)).drop("_found", "_subject", "_object", "subjects", "objects")
    place = F.row_number().over(Window.partitionBy("doc_id", "subject_text", "relation", "object_text", "source_text", F.col("rejection").isNull()).orderBy("position"))
    return rows.withColumn("rejection", F.coalesce("rejection", F.when(place > 1, "duplicate_relation")))


def split_outcomes(mapped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected)."""
    return mapped.filter("rejection is null").drop("rejection"), mapped.filter("rejection is not null")


def page_numbers(answer: Column, most: int = 10_000) -> Column:
    """Pages of a free answer: a JSON list of numbers, else all whole numbers in it; 1 to `most`, sorted, each once."""
    whole = F.trim(F.coalesce(answer, F.lit("")))
    listed = F.when(whole.startswith("["), F.from_json(whole, "array<int>"))
    digits = F.transform(F.regexp_extract_all(whole, F.lit(r"(\d+)"), F.lit(1)), lambda x: F.try_to_number(x, F.lit("9" * 18)).cast("bigint").cast("int"))
    found = F.coalesce(F.when(F.size(listed) > 0, listed), digits)
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: x.between(1, most))))


def vector_of(literal: Column) -> Column:
    """A vector from its text, `[0.1,2]`; null where it is none."""
    return F.when(literal.rlike(r"^\s*\[.*\]\s*$"), F.from_json(literal, "array<double>"))


def vector_text(vector: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(vector, lambda x: x.cast("string")), ","), F.lit("]"))


def valid_time(start: Column, end: Column) -> Column:
    """Whether two times (ISO 8601, `Z` or an offset) are ones, and in order; an open end is fine."""
    time = lambda c: F.try_to_timestamp(F.regexp_replace(c, "Z$", "+00:00"))
    fine = lambda c: c.isNull() | time(c).isNotNull()
    return fine(start) & fine(end) & F.coalesce(time(start) <= time(end), F.lit(True))


def ingested(entities: DataFrame, relations: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, relations) of a graph to insert, with outcome. Entities (entity_name, ordinal): inserted, or
    skipped where known; each name once. Relations (src_id, tgt_id, description, keywords, ordinal): inserted,
    each pair once; conflict where a pair comes with different contents."""
    first = entities.groupBy("entity_name").agg(F.min("ordinal").alias("ordinal")).join(known.select("entity_name", F.lit(True).alias("_k")).distinct(), "entity_name", "left")
    named = first.select("entity_name", "ordinal", F.when(F.col("_k"), "skipped").otherwise("inserted").alias("outcome"))
    content = F.struct(F.coalesce("description", F.lit("")), F.coalesce("keywords", F.lit("")))
    pairs = relations.groupBy("src_id", "tgt_id").agg(F.min(F.struct("ordinal", "description", "keywords")).alias("r"), F.min(content).alias("a"), F.max(content).alias("b"))
    return named, pairs.select("src_id", "tgt_id", "r.*", F.when(F.col("a") == F.col("b"), "inserted").otherwise("conflict").alias("outcome"))
