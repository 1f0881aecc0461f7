"""Contracts of bundle files, sidecars, manifests and journal events, as columns that name the first breach."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ident
from .knowledge import first_rejection
from .reconcile import accepted, follows, replayed

#: Required fields of each known type; other types pass unchecked.
REQUIRED = {
    "raw": ("doc_id", "version_id", "source_checksum", "docling_version", "generated_by"),
    "entity": ("title", "timestamp", "canonical_entity_id", "entity_type"),
    "relation": ("subject_entity_id", "predicate", "object_entity_id", "timestamp"),
    "concept": ("title", "timestamp"),
}
#: Fields that hold an id.
ID_FIELDS = ("doc_id", "version_id", "canonical_entity_id", "subject_entity_id", "object_entity_id")
#: Kinds of events, and reasons of a rejection.
EVENTS = ("created", "approved", "rejected", "merged", "discarded")
REASONS = ("low-confidence", "contradicted", "schema-violating", "provenance-violating", "imported", "manual-review-requested")
#: Fields of a sidecar, of its spans, and of a manifest.
SIDECAR_FIELDS = ("doc_id", "schema_version", "spans", "version_id")
SPAN_FIELDS = ("heading_path", "offset", "page_no", "span_id", "text")

UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
SIDECAR_TYPE = "struct<schema_version: int, doc_id: string, version_id: string, spans: array<struct<span_id: string, page_no: int, heading_path: array<string>, offset: int, text: string>>>"


def is_time(value: Column) -> Column:
    """ISO 8601 date, or date and time, with an offset or Z or without one."""
    return value.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2})?)?$") & F.try_to_timestamp(F.replace(F.substr(value, F.lit(1), F.lit(19)), F.lit(" "), F.lit("T"))).isNotNull()


def front_breach(fields: Column) -> Column:
    """The first breach of a front matter's contract as field:rule, or null. fields: a map column, not
    an expression, which every check would compute anew."""
    kind = fields["type"]
    checks = [("type:missing", F.coalesce(kind, F.lit("")) != "")]
    for name, required in REQUIRED.items():
        own = kind != name
        for field in required:
            value = fields[field]
            checks.append((f"{field}:missing", own | (F.coalesce(value, F.lit("")) != "")))
        for field in required:
            value = fields[field]
            if field in ID_FIELDS:
                checks.append((f"{field}:id", own | value.rlike(UUID)))
            if field == "timestamp":
                checks.append(("timestamp:time", own | is_time(value)))
            if field == "source_checksum":
                checks.append(("source_checksum:digest", own | value.rlike("^[0-9a-f]{64}$")))
    return first_rejection(checks)


def event_id(kind: Column, proposal: Column, actor: Column, at: Column, seed: str) -> Column:
    """Id of a journal event: of a compact JSON list that starts with the journal's own seed."""
    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(c, r'(["\\])', r"\\$1"), F.lit('"'))
    return ident.uuid5(F.concat(F.lit("["), F.concat_ws(",", *(quoted(c) for c in (F.lit(seed), kind, proposal, actor, at))), F.lit("]")))


def event_breach(event: str = "event_type", proposal: str = "proposal_id", actor: str = "actor", at: str = "at", digest: str = "payload_digest", reason: str = "rejected_reason") -> Column:
    """The first breach of a journal event, or null."""
    known = F.col(reason).isin(*REASONS)
    fits = F.when(F.col(event) == "rejected", F.coalesce(known, F.lit(False))).when(F.col(event) == "discarded", F.col(reason).isNull() | known).otherwise(F.col(reason).isNull())
    return first_rejection([
        ("event_type:unknown", F.col(event).isin(*EVENTS)), ("proposal_id:id", F.col(proposal).rlike(UUID)), ("actor:missing", F.trim(F.col(actor)) != ""),
        ("at:time", F.col(at).rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$") & F.try_to_timestamp(F.col(at)).isNotNull()),
        ("payload_digest:digest", F.col(digest).rlike("^[0-9a-f]{64}$")), ("rejected_reason:unfit", fits),
    ])


def appended(journal: DataFrame, events: DataFrame, order: str = "ordinal") -> DataFrame:
    """events with outcome: appended, or why not, each judged by the state that it meets after those before it in the
    batch. An id that the journal holds by then is a duplicate; an event with another digest than its proposal's is changed;
    a step must follow the proposal's status. Equal orders go by event_id; a refused event changes nothing."""
    status = replayed(journal, "proposal_id", "event_type", order).select("proposal_id", "status")
    digests = journal.groupBy("proposal_id").agg(F.min("payload_digest").alias("value"))
    state = status.join(digests, "proposal_id")
    known = journal.select("event_id", F.lit(True).alias("held_")).distinct()
    marked = events.join(known, "event_id", "left").withColumn("known_", F.col("held_").isNotNull()).drop("held_")
    place = F.struct(order, "event_id")
    steps = accepted(marked, state, "proposal_id", "event_type", [order, "event_id"], "payload_digest", "event_id")
    chains = steps.groupBy("proposal_id").agg(F.array_sort(F.collect_list(F.struct("place", "step", "id", "value"))).alias("chain_"))  # three at most
    joined = marked.join(state, "proposal_id", "left").join(chains, "proposal_id", "left").withColumn("place_", place)
    before = F.filter(F.coalesce("chain_", F.array().cast(chains.schema["chain_"].dataType)), lambda x: x["place"] < F.col("place_"))
    last = F.try_element_at(before, F.lit(-1))
    now, value = F.coalesce(last["step"], F.col("status"), F.lit("")), F.coalesce(last["value"], F.col("value"))
    taken = F.col("known_") | F.exists(before, lambda x: x["id"] == F.col("event_id"))
    outcome = first_rejection([("duplicate", ~taken), ("payload changed", value.isNull() | (value == F.col("payload_digest"))), ("illegal step", follows(now, F.col("event_type")))])
    return joined.withColumn("outcome", F.coalesce(outcome, F.lit("appended"))).drop("known_", "status", "value", "chain_", "place_")


def sidecars(rows: DataFrame, column: str) -> DataFrame:
    """Adds sidecar (parsed) and breach: fields must be exactly those of the schema, version 1, ids UUIDs."""
    keys = F.array_sort(F.json_object_keys(column))
    parsed = F.col("parsed_")  # a column, not an expression, which every check would compute anew
    raw_spans = F.from_json(F.get_json_object(column, "$.spans"), "array<string>")
    exact = F.forall(F.coalesce(raw_spans, F.array().cast("array<string>")), lambda s: F.array_sort(F.json_object_keys(s)) == F.array(*(F.lit(f) for f in SPAN_FIELDS)))
    breach = first_rejection([
        ("not an object with the fields of a sidecar", keys == F.array(*(F.lit(f) for f in SIDECAR_FIELDS))), ("schema_version must be 1", parsed["schema_version"] == 1),
        ("doc_id must be a UUID", parsed["doc_id"].rlike(UUID)), ("version_id must be a UUID", parsed["version_id"].rlike(UUID)), ("a span has other fields", exact),
    ])
    return rows.withColumn("parsed_", F.from_json(column, SIDECAR_TYPE)).withColumn("breach", breach).drop("sidecar").withColumnRenamed("parsed_", "sidecar")


def ids_fit(sidecar: str) -> Column:
    """Whether a parsed sidecar has spans and the id of each is what its seed gives; rows stay where they lie."""
    doc_id, version_id, spans = (F.col(f"{sidecar}.{c}") for c in ("doc_id", "version_id", "spans"))
    digests = F.transform(spans, lambda s: ident.uuid5_digest(ident.span_seed(doc_id, version_id, s["page_no"], s["heading_path"], s["offset"], s["text"])))
    return (F.size(spans) > 0) & F.forall(F.zip_with(spans, digests, lambda s, h: ident.uuid5_of(h) == s["span_id"]), lambda fits: fits)


def sidecar_spans(rows: DataFrame, key: str) -> DataFrame:
    """key, index, the sidecar's spans, and whether each id is what its seed gives."""
    spans = rows.select(key, F.col("sidecar.doc_id").alias("doc_id"), F.col("sidecar.version_id").alias("version_id"), F.posexplode("sidecar.spans").alias("index", "s"))
    own = ident.span_id(F.col("doc_id"), F.col("version_id"), F.col("s.page_no"), F.col("s.heading_path"), F.col("s.offset"), F.col("s.text"))
    return spans.select(key, "index", "s.*", (own == F.col("s.span_id")).alias("id_fits"))


def first_mismatch(left: DataFrame, right: DataFrame, key: str, index: str, columns: list[str]) -> DataFrame:
    """key and the first index at which two lists differ, in any column or in length; keys that agree are left out."""
    pack = lambda df, name: df.select(key, index, F.struct(*columns).alias(name))
    joined = pack(left, "l").join(pack(right, "r"), [key, index], "full")
    return joined.filter(~F.col("l").eqNullSafe(F.col("r"))).groupBy(key).agg(F.min(index).alias("first"))


def manifest_breach(markdown: Column, sidecar: Column, manifest: Column) -> Column:
    """Whether the digests of a manifest (JSON) fit the two files; null if they do."""
    get = lambda f: F.get_json_object(manifest, f"$.{f}")
    keys = ("canonical_hash", "markdown_file", "markdown_sha256", "schema_version", "sidecar_file", "sidecar_sha256")
    return first_rejection([
        ("manifest has other fields", F.array_sort(F.json_object_keys(manifest)) == F.array(*(F.lit(k) for k in keys))),
        ("markdown changed", get("markdown_sha256") == F.sha2(markdown, 256)), ("sidecar changed", get("sidecar_sha256") == F.sha2(sidecar, 256)),
    ])
