"""Queries of links that versions own, over orders as mentions, with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ownership
from .model import table


def _state(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Orders as mentions: customers are spread over five versions, of which v0 to v2 are reconciled; forty keys in a row are a node."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("mention_id"), F.concat(F.lit("v"), F.col("o_custkey") % 5).alias("version_id"), "o_orderpriority", "o_orderstatus", (F.col("o_orderkey").cast("long") % 9).alias("k"), F.floor(F.col("o_orderkey") / 40).alias("node_id"), F.date_format("o_orderdate", "yyyy").alias("mention_text"),
    )
    entity = F.col("o_orderpriority")
    return {
        "mentions": orders.filter("o_orderstatus <> 'F'").select("mention_id", "version_id", F.when(F.col("k") != 4, entity).alias("entity_id"), F.col("mention_id").alias("span_id"), "mention_text"),
        "held": orders.filter("k in (0, 1, 2, 3)").select("mention_id", F.when(F.col("k") == 0, F.lit(None)).when(F.col("k") == 1, F.lit("v4")).otherwise(F.col("version_id")).alias("owner"), entity.alias("entity_id"), F.col("mention_id").alias("span_id"), F.when(F.col("k") == 2, "older").otherwise(F.col("mention_text")).alias("mention_text")),
        "node_spans": orders.select("node_id", F.col("mention_id").alias("span_id")),
        "bridges": orders.filter("k < 2").groupBy("node_id", entity.alias("entity_id")).agg(F.lit(0).alias("ordinal_no"), F.min("mention_text").alias("mention_text")),
        "ledger": orders.filter("o_orderstatus = 'F' and k < 2").select("node_id", entity.alias("entity_id"), "version_id").distinct(),
        "scopes": spark.range(3).select(F.concat(F.lit("v"), "id").alias("version_id")),
    }


def link_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _state(spark, sf_dir)
    links = ownership.proven_links(ownership.derived_pairs(s["mentions"], s["held"], s["node_spans"], s["scopes"]))
    return ownership.link_outcomes(links, s["bridges"], s["ledger"], s["scopes"])


def mention_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _state(spark, sf_dir)
    return ownership.mention_outcomes(s["mentions"], s["held"], s["scopes"])


def ledger_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions and bridges that the reconciled versions want and others hold, found in both tables at once."""
    s = _state(spark, sf_dir)
    inside = s["mentions"].join(F.broadcast(s["scopes"]), "version_id", "left_semi")  # three rows
    pair = F.concat_ws(":", "node_id", "entity_id").alias("row_id")
    links = ownership.derived_pairs(s["mentions"], s["held"], s["node_spans"], s["scopes"])
    held = {"mentions": s["held"].select(F.col("mention_id").alias("row_id"), F.col("owner").alias("version_id"), F.when(F.col("owner").isNotNull(), "run").alias("source_kind")), "bridges": s["ledger"].select(pair, "version_id")}
    return ownership.collisions({"mentions": inside.select(F.col("mention_id").alias("row_id")), "bridges": links.select(pair)}, held, s["scopes"], {"mentions": "run"})


STATE_SQL = """orders_ AS (SELECT o_orderkey AS mention_id, 'v' || (o_custkey % 5) AS version_id, o_orderpriority AS e, o_orderstatus AS status, o_orderkey % 9 AS k, o_orderkey // 40 AS node_id, strftime(o_orderdate, '%Y') AS mention_text FROM orders),
mentions AS (SELECT mention_id, version_id, CASE WHEN k <> 4 THEN e END AS entity_id, mention_id AS span_id, mention_text FROM orders_ WHERE status <> 'F' AND version_id IN ('v0', 'v1', 'v2')),
held AS (SELECT mention_id, CASE WHEN k = 0 THEN NULL WHEN k = 1 THEN 'v4' ELSE version_id END AS owner, e AS entity_id, CASE WHEN k = 2 THEN 'older' ELSE mention_text END AS mention_text FROM orders_ WHERE k < 4),
bridges AS (SELECT node_id, e AS entity_id, min(mention_text) AS mention_text FROM orders_ WHERE k < 2 GROUP BY 1, 2),
ledger AS (SELECT DISTINCT node_id, e AS entity_id, version_id FROM orders_ WHERE status = 'F' AND k < 2),
links AS (SELECT m.version_id, o.node_id, m.entity_id, arg_min(m.mention_text, m.mention_id) AS mention_text FROM mentions m JOIN orders_ o ON o.mention_id = m.span_id LEFT JOIN held h ON h.mention_id = m.mention_id
 WHERE m.entity_id IS NOT NULL AND (h.mention_id IS NULL OR h.owner IS NOT DISTINCT FROM m.version_id) GROUP BY 1, 2, 3)"""

LINK_OUTCOMES_SQL = f"""WITH {STATE_SQL},
pairs AS (SELECT node_id, entity_id, version_id, bool_or(w) AS wants, bool_or(o) AS owns, max(t) AS mention_text FROM (SELECT node_id, entity_id, version_id, true AS w, false AS o, mention_text AS t FROM links UNION ALL SELECT node_id, entity_id, version_id, false, true, NULL FROM ledger) GROUP BY 1, 2, 3),
x AS (SELECT *, version_id IN ('v0', 'v1', 'v2') AS inside, owns AND NOT wants AND inside AS leaves FROM pairs),
a AS (SELECT *, count(*) FILTER (owns) OVER p AS owners, count(*) FILTER (leaves) OVER p AS leaving, coalesce(min(version_id) FILTER (wants AND owns) OVER p, min(version_id) FILTER (wants) OVER p) AS head, max(version_id) FILTER (leaves) OVER p AS tail FROM x WINDOW p AS (PARTITION BY node_id, entity_id))
SELECT a.version_id, a.node_id, a.entity_id, CASE WHEN wants THEN 0 END AS ordinal_no, a.mention_text,
 CASE WHEN wants THEN CASE WHEN b.node_id IS NULL THEN CASE WHEN version_id = head THEN 'create' ELSE 'foreign' END WHEN owners = 0 THEN 'unowned'
   WHEN owns THEN CASE WHEN owners - leaving > 1 THEN 'shared' WHEN a.mention_text = b.mention_text THEN 'equal' ELSE 'rewrite' END WHEN owners = leaving AND version_id = head THEN 'transfer' ELSE 'foreign' END
  WHEN owners = leaving AND head IS NULL AND b.node_id IS NOT NULL AND version_id = tail THEN 'delete' ELSE 'release' END AS action
FROM a LEFT JOIN bridges b USING (node_id, entity_id) WHERE inside"""

MENTION_OUTCOMES_SQL = f"""WITH {STATE_SQL}
SELECT m.version_id, m.mention_id, CASE WHEN h.mention_id IS NULL THEN 'insert' WHEN h.owner IS DISTINCT FROM m.version_id THEN 'preserve' WHEN h.entity_id IS NOT DISTINCT FROM m.entity_id AND h.mention_text = m.mention_text THEN 'equal' ELSE 'update' END AS action
FROM mentions m LEFT JOIN held h USING (mention_id)
UNION ALL SELECT owner, mention_id, 'delete' FROM held h WHERE owner IN ('v0', 'v1', 'v2') AND NOT EXISTS (SELECT 1 FROM mentions m WHERE m.mention_id = h.mention_id AND m.version_id = h.owner)"""

LEDGER_COLLISIONS_SQL = f"""WITH {STATE_SQL}
SELECT 0 AS table_no, 'mentions' AS "table", mention_id::VARCHAR AS row_id, owner, CASE WHEN owner IS NULL THEN 'source' ELSE 'owner' END AS reason FROM held SEMI JOIN mentions USING (mention_id) WHERE owner IS NULL OR owner NOT IN ('v0', 'v1', 'v2')
UNION ALL SELECT 1, 'bridges', node_id || ':' || entity_id, version_id, 'owner' FROM ledger SEMI JOIN links USING (node_id, entity_id) WHERE version_id NOT IN ('v0', 'v1', 'v2')"""

QUERIES = {"link_outcomes": (link_outcomes, LINK_OUTCOMES_SQL), "mention_outcomes": (mention_outcomes, MENTION_OUTCOMES_SQL), "ledger_collisions": (ledger_collisions, LEDGER_COLLISIONS_SQL)}
