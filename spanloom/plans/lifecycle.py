"""Queries of reconciling, versions, lifecycles and journals, with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import reconcile
from ..sources import generations, store
from ..streaming import lifecycle as streaming
from .model import table


def _journal(events: DataFrame) -> DataFrame:
    """Events of a user as journal steps of a proposal."""
    steps = F.array(*(F.lit(s) for s in ("created", "approved", "merged", "rejected", "discarded")))
    return events.select(F.col("user_id").alias("proposal_id"), F.col("event_id"), F.element_at(steps, (F.col("event_id") % 5 + 1).cast("int")).alias("step"))


JOURNAL_SQL = "j AS (SELECT user_id AS proposal_id, event_id, ['created','approved','merged','rejected','discarded'][event_id % 5 + 1] AS step FROM events)"


def journal_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.replayed(_journal(table(spark, sf_dir, "events")), "proposal_id", "step", "event_id")


JOURNAL_REPLAY_SQL = f"""WITH RECURSIVE {JOURNAL_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY proposal_id ORDER BY event_id) AS i FROM j),
f AS (SELECT proposal_id, 0::BIGINT AS i, '' AS status, 0 AS illegal FROM (SELECT DISTINCT proposal_id FROM j)
 UNION ALL SELECT f.proposal_id, o.i,
  CASE WHEN (status = '' AND step = 'created') OR (status = 'created' AND step IN ('approved', 'rejected')) OR (status = 'approved' AND step IN ('merged', 'discarded')) THEN step ELSE status END,
  illegal + CASE WHEN (status = '' AND step = 'created') OR (status = 'created' AND step IN ('approved', 'rejected')) OR (status = 'approved' AND step IN ('merged', 'discarded')) THEN 0 ELSE 1 END
 FROM f JOIN o ON o.proposal_id = f.proposal_id AND o.i = f.i + 1)
SELECT proposal_id, status, i::INTEGER AS events, illegal FROM f QUALIFY row_number() OVER (PARTITION BY proposal_id ORDER BY i DESC) = 1"""


def journal_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same replay from a stream of the journal, to its end."""
    return drained(spark, sf_dir, lambda events: streaming.replayed(_journal(events), "proposal_id", "step", "event_id"), "update", ["proposal_id"])


def windowed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts of the event stream."""
    out = drained(spark, sf_dir, streaming.windowed_counts, "complete", ["window", "event_type"])
    return out.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("started"), "event_type", "n", F.round("total", 4).alias("total"))


WINDOWED_STREAM_SQL = "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS started, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"


def drained(spark: SparkSession, sf_dir: str, plan, mode: str, keys: list[str]) -> DataFrame:
    """Run a streaming plan over the events until all are read; the last row of each key.

    Each micro-batch is written to a table of its own number in the shared folder, so a batch
    that runs twice is written once."""
    schema = table(spark, sf_dir, "events").schema
    folder = store.new_folder(spark, "stream")
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)

    def write(df: DataFrame, batch: int) -> None:
        df.withColumn("batch_", F.lit(batch)).write.mode("overwrite").parquet(f"{folder}/out/batch={batch}")

    plan(events).writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    rows = spark.read.parquet(f"{folder}/out").drop("batch")
    names = [c for c in rows.columns if c != "batch_"]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*names), "batch_").alias("row")).select("row.*")


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = F.array(*(F.lit(s) for s in (*reconcile.STAGES, "failed")))
    events = table(spark, sf_dir, "events").select("user_id", "event_id", F.element_at(stages, (F.col("event_id") % 8 + 1).cast("int")).alias("state"))
    out = reconcile.checked_transitions(events, "user_id", "state", ["event_id"])
    return out.select("user_id", "event_id", "state", "previous", "error")


_PLACES = "['registered','parsed','chunks_created','embedded','tree_built','entities_extracted','complete','failed']"
TRANSITIONS_SQL = f"""WITH s AS (SELECT user_id, event_id, {_PLACES}[event_id % 8 + 1] AS state, event_id % 8 + 1 AS p FROM events), t AS (SELECT *, lag(state) OVER o AS previous, lag(p) OVER o AS q FROM s WINDOW o AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, event_id, state, previous, CASE WHEN previous IS NULL THEN CASE WHEN state <> 'registered' THEN 'does not start at the first state' END WHEN previous = 'failed' THEN 'failed is final' WHEN state = 'failed' THEN NULL WHEN p = q + 1 THEN NULL ELSE 'not the next state' END AS error FROM t"""


def _twisted(df: DataFrame) -> DataFrame:
    """Tomorrow's customers: some gone, some changed, some new."""
    kept = df.filter("c_custkey % 10 <> 0").withColumn("c_acctbal", F.when(F.col("c_custkey") % 7 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    return kept.unionByName(df.filter("c_custkey % 50 = 0").withColumn("c_custkey", F.col("c_custkey") + 1000000))


def table_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    return reconcile.difference(customer, _twisted(customer), ["c_custkey"])


DIFFERENCE_SQL = """WITH d AS (SELECT c_custkey, c_custkey % 7 = 0 AS changed FROM customer WHERE c_custkey % 10 <> 0 UNION ALL SELECT c_custkey + 1000000, false FROM customer WHERE c_custkey % 50 = 0)
SELECT coalesce(c.c_custkey, d.c_custkey) AS c_custkey, CASE WHEN c.c_custkey IS NULL THEN 'insert' WHEN d.c_custkey IS NULL THEN 'delete' WHEN changed THEN 'update' ELSE 'unchanged' END AS op FROM customer c FULL JOIN d ON c.c_custkey = d.c_custkey"""


def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    return reconcile.upserted(customer, _twisted(customer).filter("c_custkey % 7 = 0 or c_custkey > 1000000"), ["c_custkey"]).select("c_custkey", F.round("c_acctbal", 4).alias("c_acctbal"))


UPSERTED_SQL = """WITH d AS (SELECT c_custkey, c_acctbal + CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE 0 END AS c_acctbal FROM customer WHERE c_custkey % 10 <> 0 UNION ALL SELECT c_custkey + 1000000, c_acctbal FROM customer WHERE c_custkey % 50 = 0),
n AS (SELECT * FROM d WHERE c_custkey % 7 = 0 OR c_custkey > 1000000) SELECT c_custkey, round(c_acctbal, 4) AS c_acctbal FROM (SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM n) UNION ALL SELECT * FROM n)"""


def first_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line of each supplier and part; those of small quantity stand for themselves."""
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("evidence_id"), F.when(F.col("l_quantity") > 5, F.concat_ws("-", "l_suppkey", "l_partkey")).alias("dedup_key"))
    return reconcile.first_by_dedup_key(rows, "dedup_key", "evidence_id", "evidence_id")


FIRST_EVIDENCE_SQL = """WITH e AS (SELECT l_orderkey * 8 + l_linenumber AS evidence_id, CASE WHEN l_quantity > 5 THEN l_suppkey || '-' || l_partkey END AS dedup_key FROM lineitem)
SELECT evidence_id, dedup_key FROM e QUALIFY row_number() OVER (PARTITION BY coalesce(dedup_key, 'id:' || evidence_id) ORDER BY evidence_id) = 1"""


def registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of documents after a second load in which every third text changed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    versions = docs.select("doc_id", "content_hash", F.lit(1).alias("version_no"), F.lit(True).alias("is_active"))
    arriving = docs.withColumn("content_hash", F.when(F.col("doc_id") % 3 == 0, F.sha2("content_hash", 256)).otherwise(F.col("content_hash")))
    return reconcile.registered(versions, arriving)


REGISTRATIONS_SQL = """WITH d AS (SELECT doc_id, sha256(text) AS h FROM documents) SELECT doc_id, h AS content_hash, 1 AS version_no, doc_id % 3 <> 0 AS is_active FROM d UNION ALL SELECT doc_id, sha256(h), 2, true FROM d WHERE doc_id % 3 = 0"""


def sync_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), F.sha2("html", 256).alias("canonical_hash"))
    current = pages.filter("path not like '%3'").withColumn("canonical_hash", F.when(F.col("path").endswith("7"), "new").otherwise(F.col("canonical_hash"))).unionByName(pages.filter("path like '%5'").withColumn("path", F.concat("path", F.lit("-b"))))
    return reconcile.sync_decision(pages, current)


SYNC_SQL = """SELECT page_id::VARCHAR AS path, CASE WHEN page_id % 10 = 3 THEN 'deleted' WHEN page_id % 10 = 7 THEN 'resynced' ELSE 'skipped' END AS decision FROM pages UNION ALL SELECT page_id || '-b', 'synced' FROM pages WHERE page_id % 10 = 5"""


def constraint_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return reconcile.violations(
        lines, not_null=["l_orderkey"], unique=[["l_orderkey", "l_linenumber"], ["l_orderkey"]], checks={"quantity below 50": F.col("l_quantity") < 50},
        refers=[("l_partkey", table(spark, sf_dir, "part").filter("p_partkey % 100 <> 0"), "p_partkey"), ("l_suppkey", table(spark, sf_dir, "supplier"), "s_suppkey")],
    )


VIOLATIONS_SQL = """SELECT * FROM (SELECT 'quantity below 50' AS rule, count(*) AS n FROM lineitem WHERE NOT l_quantity < 50 UNION ALL
SELECT 'l_orderkey repeated', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1) UNION ALL SELECT 'l_orderkey, l_linenumber repeated', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) UNION ALL
SELECT 'l_partkey unknown', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 100 <> 0) UNION ALL SELECT 'l_suppkey unknown', count(*) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier)) WHERE n > 0"""


def _reports(events: DataFrame) -> DataFrame:
    """Events as reports of versions' stages: some fail, some bring links."""
    return events.select((F.col("user_id") * 100 + F.col("event_id") % 17).alias("version_id"), F.col("event_id").alias("ordinal"), (F.col("event_id") % 29 == 3).alias("failed"), (F.col("event_type") == "purchase").alias("linked"))


def stage_processing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.processed(_reports(table(spark, sf_dir, "events")))


def stage_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same stages from a stream of reports, to its end."""
    return drained(spark, sf_dir, lambda events: streaming.processed(_reports(events)), "update", ["version_id"])


def stage_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many versions stand at each stage, with their steps and reports."""
    return stage_processing(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("versions"), F.sum("processed").cast("bigint").alias("processed"), F.sum("events").cast("bigint").alias("events"))


_STAGES_SQL = f"""WITH RECURSIVE e AS (SELECT user_id * 100 + event_id % 17 AS version_id, event_id % 29 = 3 AS failed, event_type = 'purchase' AS linked, row_number() OVER (PARTITION BY user_id * 100 + event_id % 17 ORDER BY event_id) AS i FROM events),
f AS (SELECT DISTINCT version_id, 0::BIGINT AS i, 1 AS lv, false AS linked, false AS broke, 0 AS processed FROM e UNION ALL
 SELECT f.version_id, e.i, CASE WHEN broke OR lv = 7 OR bad THEN lv ELSE lv + 1 END, f.linked OR (e.linked AND NOT broke AND lv < 7), broke OR (lv < 7 AND bad), processed + CASE WHEN broke OR lv = 7 OR bad THEN 0 ELSE 1 END
 FROM f JOIN e ON e.version_id = f.version_id AND e.i = f.i + 1, LATERAL (SELECT e.failed OR (lv = 6 AND NOT (f.linked OR e.linked)) AS bad) x),
r AS (SELECT version_id, CASE WHEN broke THEN 'failed' ELSE {_PLACES}[lv] END AS status, processed::INTEGER AS processed, i::INTEGER AS events FROM f QUALIFY row_number() OVER (PARTITION BY version_id ORDER BY i DESC) = 1)"""
STAGES_SQL = f"{_STAGES_SQL} SELECT * FROM r"
STAGE_COUNTERS_SQL = f"{_STAGES_SQL} SELECT status, count(*) AS versions, sum(processed)::BIGINT AS processed, sum(events)::BIGINT AS events FROM r GROUP BY 1"


def reconciled_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and their orders reconciled three times: at first, after changes, and again without any."""
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    tables = [generations.Table("orders", ["o_orderkey"], {"o_custkey": ("customer", "c_custkey")}), generations.Table("customer", ["c_custkey"])]
    changed = orders.filter("o_orderkey % 20 <> 3").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 13 == 0, "X").otherwise(F.col("o_orderstatus")))
    later = {"customer": _twisted(customer), "orders": changed}
    root, out = store.new_folder(spark, "generations"), None
    for run, desired in enumerate(({"customer": customer.filter("c_custkey % 10 <> 0"), "orders": orders}, later, later), 1):
        number, counts = generations.reconcile(spark, root, tables, desired)
        part = counts.select(F.lit(run).alias("run"), F.lit(number).alias("generation"), "table_name", "outcome", "rows")
        out = part if out is None else out.unionByName(part)
    return out


GENERATIONS_SQL = """WITH o AS (SELECT o_orderkey AS k, o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0) AS ok, o_orderkey % 20 <> 3 AS wanted FROM orders),
r AS (SELECT 1 AS run, 'customer' AS table_name, 'insert' AS outcome FROM customer WHERE c_custkey % 10 <> 0 UNION ALL SELECT 1, 'orders', CASE WHEN ok THEN 'insert' ELSE 'blocked' END FROM o
UNION ALL SELECT 2, 'customer', CASE WHEN c_custkey % 7 = 0 THEN 'update' ELSE 'equal' END FROM customer WHERE c_custkey % 10 <> 0 UNION ALL SELECT 2, 'customer', 'insert' FROM customer WHERE c_custkey % 50 = 0
UNION ALL SELECT 2, 'orders', CASE WHEN NOT ok THEN 'blocked' WHEN NOT wanted THEN 'delete' WHEN k % 13 = 0 THEN 'update' ELSE 'equal' END FROM o WHERE ok OR wanted
UNION ALL SELECT 3, 'customer', 'equal' FROM customer WHERE c_custkey % 10 <> 0 OR c_custkey % 50 = 0 UNION ALL SELECT 3, 'customer', 'equal' FROM customer WHERE c_custkey % 10 <> 0 AND c_custkey % 50 = 0
UNION ALL SELECT 3, 'orders', CASE WHEN ok THEN 'equal' ELSE 'blocked' END FROM o WHERE wanted)
SELECT run, least(run, 2) AS generation, table_name, outcome, count(*) AS rows FROM r GROUP BY ALL"""


QUERIES = {
    "journal_replay": (journal_replay, JOURNAL_REPLAY_SQL),
    "journal_stream": (journal_stream, JOURNAL_REPLAY_SQL),
    "windowed_stream": (windowed_stream, WINDOWED_STREAM_SQL),
    "stage_processing": (stage_processing, STAGES_SQL),
    "stage_stream": (stage_stream, STAGES_SQL),
    "stage_counters": (stage_counters, STAGE_COUNTERS_SQL),
    "reconciled_generations": (reconciled_generations, GENERATIONS_SQL),
    "checked_transitions": (transitions, TRANSITIONS_SQL),
    "table_difference": (table_difference, DIFFERENCE_SQL),
    "upserted_table": (upserted, UPSERTED_SQL),
    "first_evidence": (first_evidence, FIRST_EVIDENCE_SQL),
    "registered_versions": (registrations, REGISTRATIONS_SQL),
    "sync_decisions": (sync_decisions, SYNC_SQL),
    "constraint_violations": (constraint_violations, VIOLATIONS_SQL),
}
