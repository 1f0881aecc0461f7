"""Knowledge graph: evidence scores, schemas, candidate relations, identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text


def evidence_scores(links: DataFrame, weights: dict[str, float], bonus: float = 0.05, most: float = 1.0, key: str = "entity_id") -> DataFrame:
    """key, confidence, support, scored: mean of the scores weighted by source kind, a bonus for
    every further scored link, capped; null where nothing has weight. Support counts all links."""
    weight = F.coalesce(F.create_map(*(F.lit(x) for pair in weights.items() for x in pair))[F.col("source_kind")], F.lit(1.0))
    used = F.col("confidence_score").isNotNull()
    sums = links.groupBy(key).agg(
        F.sum(F.when(used, weight * F.col("confidence_score"))).alias("ws"), F.sum(F.when(used, weight)).alias("w"), F.count(F.lit(1)).alias("support"), F.count(F.when(used, 1)).alias("scored")
    )
    mean = F.col("ws") / F.nullif(F.col("w"), F.lit(0.0))
    return sums.select(key, F.least(F.lit(most), mean + bonus * F.greatest(F.col("scored") - 1, F.lit(0))).alias("confidence"), "support", "scored")


def allowed_relations(candidates: DataFrame, entities: DataFrame, schemas: DataFrame) -> DataFrame:
    """Candidates (source_id, target_id, relation_type) whose ends' types the relation's schema
    allows; a relation without schema, or an empty list in it, allows any."""
    side = lambda name: entities.select(F.col("entity_id").alias(f"{name}_id"), F.col("entity_type").alias(f"{name}_type"))
    joined = candidates.join(side("source"), "source_id").join(side("target"), "target_id").join(schemas.withColumnRenamed("name", "relation_type"), "relation_type", "left")
    fits = lambda allowed, kind: F.col(allowed).isNull() | (F.size(allowed) == 0) | F.expr(f"array_contains({allowed}, {kind})")
    return joined.filter(fits("allowed_source_types", "source_type") & fits("allowed_target_types", "target_type"))


def required_fields(rows: DataFrame, kind: str, fields: list[str]) -> DataFrame:
    """kind, required: the fields that every row of the kind has."""
    full = [F.when(F.count(F.col(f)) == F.count(F.lit(1)), F.lit(f)) for f in fields]
    return rows.groupBy(kind).agg(F.array_sort(F.array_compact(F.array(*full))).alias("required"))


def dangling(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations one of whose ends is no entity."""
    known = lambda end: entities.select(F.col("entity_id").alias(end)).distinct()
    return relations.join(known("source_id"), "source_id", "left_anti").unionByName(relations.join(known("source_id"), "source_id", "left_semi").join(known("target_id"), "target_id", "left_anti"))


def observed_types(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """relation_type, source_types, target_types as seen, sorted; `dangling` finds relations left out."""
    side = lambda name: entities.select(F.col("entity_id").alias(f"{name}_id"), F.col("entity_type").alias(f"{name}_type"))
    joined = relations.join(side("source"), "source_id").join(side("target"), "target_id")
    return joined.groupBy("relation_type").agg(F.array_sort(F.collect_set("source_type")).alias("source_types"), F.array_sort(F.collect_set("target_type")).alias("target_types"))


def identity_groups(mentions: DataFrame, name: Column, least: int = 1) -> DataFrame:
    """name, entity_type, span_id, n: a row for each distinct span of each group of `least` spans or
    more; a common name holds spans without bound, so no group is an array."""
    members = mentions.select(name.alias("name"), "entity_type", "span_id").distinct()
    sizes = members.groupBy("name", "entity_type").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return members.join(sizes, ["name", "entity_type"])


def spans_of_several(groups: DataFrame) -> DataFrame:
    """span_id, groups: spans that lie in more than one group, which is an error where a span is one mention."""
    return groups.groupBy("span_id").agg(F.count(F.lit(1)).alias("groups")).filter("groups > 1")


def attached(mentions: DataFrame, names: DataFrame) -> DataFrame:
    """Each mention with the one entity that its (name, type) means; null where none or several do."""
    one = names.groupBy("name", "entity_type").agg(F.min("entity_id").alias("entity_id"), F.max("entity_id").alias("last")).withColumn("entity_id", F.when(F.col("entity_id") == F.col("last"), F.col("entity_id"))).drop("last")
    return mentions.join(one, ["name", "entity_type"], "left")


#: Kinds of confidence, best first.
SOURCE_ORDER = ("frontmatter_declared", "dictionary_exact", "rule_weight", "model_probability", "unavailable")


def merge_mentions(mentions: DataFrame, scope: list[str]) -> DataFrame:
    """mention_id, outcome, winner of all mentions (start, stop, label, priority, fingerprint): within a scope
    in order of priority, then fingerprint, a mention that overlaps none chosen before is selected. Others
    are, against the first chosen one that they overlap: duplicate (equal fingerprints), grouped (same
    place and label), suppressed (same place), nested (strictly inside or around) or overlap.

    A scope is a segment of a text, so its mentions are few; they are folded in one ordered pass."""
    entry = F.struct("priority", "fingerprint", "mention_id", "start", "stop", "label")
    ordered = F.array_sort(F.collect_list(entry))
    meets = lambda x, y: (x["start"] < y["stop"]) & (y["start"] < x["stop"])
    chosen = F.aggregate(ordered, F.filter(ordered, lambda x: F.lit(False)), lambda kept, x: F.when(F.exists(kept, lambda y: meets(x, y)), kept).otherwise(F.array_append(kept, x)))
    folded = mentions.groupBy(*scope).agg(ordered.alias("all"), chosen.alias("chosen"))
    rows = folded.select(*scope, "chosen", F.explode("all").alias("x")).withColumn("y", F.element_at(F.filter("chosen", lambda y: meets(F.col("x"), y)), 1))
    same = (F.col("x.start") == F.col("y.start")) & (F.col("x.stop") == F.col("y.stop"))
    inside = lambda p, q: (F.col(f"{q}.start") < F.col(f"{p}.start")) & (F.col(f"{p}.stop") < F.col(f"{q}.stop"))
    outcome = (
        F.when(F.col("x.mention_id") == F.col("y.mention_id"), "selected").when(F.col("x.fingerprint") == F.col("y.fingerprint"), "duplicate")
        .when(same & (F.col("x.label") == F.col("y.label")), "grouped").when(same, "suppressed").when(inside("x", "y") | inside("y", "x"), "nested").otherwise("overlap")
    )
    winner = F.when(outcome != "selected", F.col("y.mention_id"))
    return rows.select(*scope, F.col("x.mention_id").alias("mention_id"), outcome.alias("outcome"), winner.alias("winner"))


def review(claims: DataFrame, form=None) -> DataFrame:
    """supported where the quote holds subject and object, unsupported where it holds neither or is empty,
    else uncertain, as with an empty subject or object; null without a quote is pending. All three are
    compared in a normal form: collapsed and lower-case, or `form` (such as entity.normal_name)."""
    form = form or (lambda c: F.lower(text.collapsed(c)))
    subject, object_, quote = (form(F.coalesce(F.col(c), F.lit(""))) for c in ("subject", "object", "quote"))
    rows = claims.withColumns({"_s": subject, "_o": object_, "_q": quote})
    has = lambda c: F.col("_q").contains(F.col(c))
    verdict = (
        F.when(F.col("quote").isNull(), "pending").when((F.col("_s") == "") | (F.col("_o") == ""), "uncertain").when(F.col("_q") == "", "unsupported")
        .when(has("_s") & has("_o"), "supported").when(~has("_s") & ~has("_o"), "unsupported").otherwise("uncertain")
    )
    return rows.withColumn("verdict", verdict).drop("_s", "_o", "_q")


def first_rejection(checks: list[tuple[str, Column]]) -> Column:
    """The name of the first check that a row fails, or null."""
    out = F.lit(None).cast("string")
    for name, ok in reversed(checks):
        out = F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)).otherwise(out)
    return out


