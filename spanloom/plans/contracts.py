"""Queries of contracts, with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ident
from ..operators import contracts
from ..streaming import lifecycle as streaming
from .lifecycle import drained
from .model import SPANS_SQL, spans, table


def front_breaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Front matters made from events, some of which lack or distort a field."""
    events = table(spark, sf_dir, "events")
    kinds = F.array(*(F.lit(k) for k in ("concept", "entity", "relation", "note")))
    n = F.col("event_id")
    made = {
        "type": F.when(n % 19 != 0, F.element_at(kinds, (n % 4 + 1).cast("int"))), "title": F.when(n % 5 != 0, F.lit("T")), "timestamp": F.when(n % 7 != 0, F.lit("2024-01-02T03:04:05Z")).otherwise("yesterday"),
        "canonical_entity_id": F.when(n % 3 != 0, ident.uuid5(n.cast("string"))).otherwise("x"), "entity_type": F.lit("Person"), "subject_entity_id": ident.uuid5(n.cast("string")), "object_entity_id": ident.uuid5(n.cast("string")), "predicate": F.when(n % 11 != 0, F.lit("knows")),
    }
    fields = F.map_from_arrays(F.array(*(F.lit(k) for k in made)), F.array(*made.values()))
    return events.select(fields.alias("fields")).select(F.coalesce(contracts.front_breach(F.col("fields")), F.lit("none")).alias("breach")).groupBy("breach").agg(F.count(F.lit(1)).alias("n"))


FRONT_BREACHES_SQL = """SELECT CASE WHEN event_id % 19 = 0 THEN 'type:missing' WHEN event_id % 4 = 3 THEN 'none'
 WHEN event_id % 4 IN (0, 1) AND event_id % 5 = 0 THEN 'title:missing' WHEN event_id % 4 = 2 AND event_id % 11 = 0 THEN 'predicate:missing'
 WHEN event_id % 7 = 0 THEN 'timestamp:time' WHEN event_id % 4 = 1 AND event_id % 3 = 0 THEN 'canonical_entity_id:id' ELSE 'none' END AS breach, count(*) AS n FROM events GROUP BY 1"""


def _appends(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Users' events as one batch of journal events, a user a proposal; five of six users have a journal already."""
    proposal = ident.uuid5(F.col("user_id").cast("string"))
    digest = lambda c: F.sha2(c.cast("string"), 256)
    made = lambda kind, d: (proposal.alias("proposal_id"), kind.alias("event_type"), contracts.event_id(kind, proposal, F.lit("a"), F.lit("2024-01-02T03:04:05Z"), "journal-v1").alias("event_id"), d.alias("payload_digest"))
    events = table(spark, sf_dir, "events")
    journal = events.select("user_id").distinct().filter("user_id % 6 <> 0").select(*made(F.lit("created"), digest(F.col("user_id"))), F.lit(-1).cast("bigint").alias("ordinal"))
    kind = F.element_at(F.array(*(F.lit(s) for s in ("approved", "merged", "created", "rejected", "discarded"))), (F.col("event_id") % 5 + 1).cast("int"))
    payload = digest(F.when(F.col("event_id") % 7 == 0, F.col("event_id")).otherwise(F.col("user_id")))
    return journal, events.select("user_id", F.col("event_id").alias("ordinal"), *made(kind, payload))


def journal_appends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's outcome, by the state that the ones before it leave."""
    return contracts.appended(*_appends(spark, sf_dir)).select("user_id", "ordinal", "event_type", "outcome")


def journal_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same fold over the events as a stream, for proposals without a journal."""
    digest = lambda c: F.sha2(c.cast("string"), 256)
    kind = lambda e: F.element_at(F.array(*(F.lit(s) for s in ("approved", "merged", "created", "rejected", "discarded"))), (e % 5 + 1).cast("int"))

    def plan(events: DataFrame) -> DataFrame:
        rows = events.select("user_id", F.col("event_id").alias("ordinal"), kind(F.col("event_id")).alias("event_type"), digest(F.when(F.col("event_id") % 7 == 0, F.col("event_id")).otherwise(F.col("user_id"))).alias("payload_digest"))
        return streaming.judged(rows.withColumn("event_id", F.col("event_type")), "user_id")

    return drained(spark, sf_dir, plan, "append", ["user_id", "ordinal"])


def _appends_sql(journal: str) -> str:
    """The fold as a recursion over each user's events; ids differ by kind alone, so a list of kinds is the journal's."""
    legal = "(status = '' AND k = 'created') OR (status = 'created' AND k IN ('approved', 'rejected')) OR (status = 'approved' AND k IN ('merged', 'discarded'))"
    outcome = f"CASE WHEN list_contains(held, k) THEN 'duplicate' WHEN digest IS NOT NULL AND digest <> d THEN 'payload changed' WHEN {legal} THEN 'appended' ELSE 'illegal step' END"
    return f"""WITH RECURSIVE e AS (SELECT user_id, event_id, ['approved', 'merged', 'created', 'rejected', 'discarded'][event_id % 5 + 1] AS k, CASE WHEN event_id % 7 = 0 THEN event_id ELSE user_id END AS d, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
f AS (SELECT user_id, 0::BIGINT AS i, NULL::BIGINT AS ordinal, NULL::VARCHAR AS event_type, NULL::VARCHAR AS outcome, CASE WHEN {journal} THEN 'created' ELSE '' END AS status, CASE WHEN {journal} THEN user_id END AS digest, CASE WHEN {journal} THEN ['created'] ELSE []::VARCHAR[] END AS held FROM (SELECT DISTINCT user_id FROM events)
 UNION ALL SELECT user_id, i, event_id, k, o, CASE WHEN o = 'appended' THEN k ELSE status END, CASE WHEN o = 'appended' THEN coalesce(digest, d) ELSE digest END, CASE WHEN o = 'appended' THEN list_append(held, k) ELSE held END
 FROM (SELECT f.user_id, e.i, e.event_id, e.k, e.d, f.status, f.digest, f.held, {outcome} AS o FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1))
SELECT user_id, ordinal, event_type, outcome FROM f WHERE i > 0"""


JOURNAL_APPENDS_SQL, JOURNAL_VERDICTS_SQL = _appends_sql("user_id % 6 <> 0"), _appends_sql("false")


def sidecar_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sidecars of documents, written as JSON, parsed and checked; every tenth loses its version."""
    rows = spans(table(spark, sf_dir, "documents")).filter("ordinal < 6").withColumn("did", ident.uuid5(F.col("doc_id").cast("string")))
    heads = F.split("heading_path", " > ")
    made = rows.withColumn("s", F.struct(ident.span_id(F.col("did"), F.col("did"), F.lit(1), heads, F.col("ordinal"), F.col("raw_text")).alias("span_id"), F.lit(1).alias("page_no"), heads.alias("heading_path"), F.col("ordinal").alias("offset"), F.col("raw_text").alias("text")))
    grouped = made.groupBy("doc_id", "did").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "s"))), lambda x: x["s"]).alias("spans"))
    text = F.to_json(F.struct(F.lit(1).alias("schema_version"), F.col("did").alias("doc_id"), F.when(F.col("doc_id") % 10 != 0, F.col("did")).alias("version_id"), "spans"))
    checked = contracts.sidecars(grouped.select("doc_id", text.alias("json")), "json")
    fits = contracts.sidecar_spans(checked.filter("breach is null").select(F.col("doc_id").alias("key"), "sidecar"), "key").groupBy(F.col("key").alias("doc_id")).agg(F.count(F.lit(1)).alias("spans"), F.min("id_fits").alias("ids_fit"))
    return checked.select("doc_id", F.coalesce("breach", F.lit("none")).alias("breach")).join(fits, "doc_id", "left").select("doc_id", "breach", F.coalesce("spans", F.lit(0)).alias("spans"), F.coalesce("ids_fit", F.lit(False)).alias("ids_fit"))


SIDECAR_SQL = f"""WITH {SPANS_SQL} SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'not an object with the fields of a sidecar' ELSE 'none' END AS breach, CASE WHEN doc_id % 10 = 0 THEN 0 ELSE count(*) END AS spans, doc_id % 10 <> 0 AS ids_fit
FROM spans WHERE ordinal < 6 GROUP BY doc_id"""


def list_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of documents against a second parse in which some differ and some are gone."""
    rows = spans(table(spark, sf_dir, "documents")).select("doc_id", "ordinal", "raw_text")
    other = rows.filter("not (doc_id % 4 = 1 and ordinal >= 3)").withColumn("raw_text", F.when((F.col("doc_id") % 4 == 2) & (F.col("ordinal") >= 2), "changed").otherwise(F.col("raw_text")))
    return contracts.first_mismatch(rows, other, "doc_id", "ordinal", ["raw_text"])


MISMATCHES_SQL = f"WITH {SPANS_SQL} SELECT doc_id, min(ordinal)::INTEGER AS first FROM spans WHERE (doc_id % 4 = 1 AND ordinal >= 3) OR (doc_id % 4 = 2 AND ordinal >= 2 AND raw_text <> 'changed') GROUP BY 1"


QUERIES = {
    "front_breaches": (front_breaches, FRONT_BREACHES_SQL),
    "journal_appends": (journal_appends, JOURNAL_APPENDS_SQL),
    "journal_verdicts": (journal_verdicts, JOURNAL_VERDICTS_SQL),
    "sidecar_round_trip": (sidecar_round_trip, SIDECAR_SQL),
    "list_mismatches": (list_mismatches, MISMATCHES_SQL),
}
