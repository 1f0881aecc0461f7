"""Queries of policy-guided descent and of merges along links, with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import distribution, merging, traverse
from ..sources import store
from .model import table

#: Policies of the query: name, policy, its decision in SQL (over support, dispersion, entropy, is_route, dist, pd), the rule for children.
_BASE_SQL = "CASE WHEN support < 4 THEN 'prune' WHEN is_route THEN 'drill_down' WHEN dispersion > 0.9 AND entropy > 2.5 THEN 'drill_down' WHEN dispersion <= 0.9 AND entropy <= 2.5 THEN 'keep_parent' ELSE 'prune' END"
_HIRO_SQL = "CASE WHEN support > 0 AND support < 1 THEN 'prune' WHEN dist - pd > -0.02 AND dist > 0.8 THEN 'drill_down' WHEN dist - pd < 0 THEN 'keep_parent' ELSE 'prune' END"
POLICIES = [
    ("baseline", traverse.baseline(4, 0.9, 2.5), _BASE_SQL, "nearest"),
    ("hiro", traverse.hiro(0.8, -0.02), _HIRO_SQL, "any"),
    ("every", traverse.baseline(4, 0.9, 2.5, "all"), _BASE_SQL, "all"),
]


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors at the leaves of a tree: all, labels, sevenths of labels; every eleventh of an even label lies at the label."""
    rows = table(spark, sf_dir, "embeddings").filter("label is not null")
    own = F.concat(F.lit("l"), "label")
    return rows.select("vec_id", vectors.doubles(F.col("embedding")).alias("embedding"), own.alias("up"), F.when((F.col("vec_id") % 11 == 0) & (F.col("label") % 2 == 0), own).otherwise(F.concat(own, F.lit("."), F.col("vec_id") % 7)).alias("node_id"))


def _tree(members: DataFrame) -> DataFrame:
    labels = members.select(F.col("up").alias("node_id"), F.lit("all").alias("parent_node_id"))
    leaves = members.filter("node_id <> up").select("node_id", F.col("up").alias("parent_node_id"))
    root = members.select(F.lit("all").alias("node_id"), F.lit(None).cast("string").alias("parent_node_id"))
    return root.unionByName(labels).unionByName(leaves).distinct()


def _met(spark: SparkSession, sf_dir: str, names: list[str]) -> tuple[DataFrame, DataFrame]:
    members = _members(spark, sf_dir)
    tree = store.staged(_tree(members), "tree")
    up = tree.select("node_id", F.col("parent_node_id").alias("ancestor_id"))
    ancestors = up.filter("ancestor_id is not null").unionByName(up.filter("ancestor_id like 'l%'").select("node_id", F.lit("all").alias("ancestor_id"))).unionByName(tree.select("node_id", F.col("node_id").alias("ancestor_id")))
    stats = store.staged(distribution.subtree_stats(members.select("node_id", "embedding"), ancestors), "stats")
    starts = members.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), F.lit("all").alias("node_id"))
    out = None
    for name, policy, _, _ in POLICIES:
        if name in names:
            one = traverse.traverse(tree, stats, starts, policy).withColumn("policy", F.lit(name))
            out = one if out is None else out.unionByName(one)
    return out, members


def policy_descents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descents of every hundredth vector as a query, by three policies."""
    met, _ = _met(spark, sf_dir, [p[0] for p in POLICIES])
    return met.select("policy", "query_id", "node_id", "depth", "decision", F.round("query_distance", 6).alias("query_distance"), "trail", "gives")


def descent_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors that the descents give as evidence."""
    met, members = _met(spark, sf_dir, ["hiro", "every"])
    parts = [traverse.evidence(met.filter(F.col("policy") == p), members.select("node_id", F.col("vec_id").alias("chunk_id"))).withColumn("policy", F.lit(p)) for p in ("hiro", "every")]
    return parts[0].unionByName(parts[1]).select("policy", "query_id", "chunk_id", "node_id", F.round("score", 6).alias("score"), "depth", "trail")


_SETUP = """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, 'l' || label AS up, CASE WHEN vec_id % 11 = 0 AND label % 2 = 0 THEN 'l' || label ELSE 'l' || label || '.' || vec_id % 7 END AS node_id FROM embeddings WHERE label IS NOT NULL),
tree AS (SELECT DISTINCT node_id, up AS parent FROM v WHERE node_id <> up UNION SELECT DISTINCT up, 'all' FROM v UNION SELECT 'all', NULL FROM v),
own AS (SELECT DISTINCT node_id FROM v),
m AS (SELECT node_id, vec_id, e, false AS is_route FROM v UNION ALL SELECT up, vec_id, e, true FROM v WHERE node_id <> up AND up NOT IN (SELECT node_id FROM own) UNION ALL SELECT 'all', vec_id, e, true FROM v),
x AS (SELECT node_id, vec_id, unnest(e) AS x, unnest(range(len(e))) AS i FROM m), c AS (SELECT node_id, i, avg(x) AS m FROM x GROUP BY 1, 2), cv AS (SELECT node_id, list(m ORDER BY i) AS c FROM c GROUP BY 1),
d AS (SELECT node_id, vec_id, sqrt(sum((x - m) ** 2)) AS d FROM x JOIN c USING (node_id, i) GROUP BY 1, 2),
s AS (SELECT node_id, count(*) AS support, avg(d) AS dispersion, CASE WHEN sum(d) > 0 THEN log2(sum(d)) - sum(CASE WHEN d > 0 THEN d * log2(d) END) / sum(d) ELSE 0 END AS entropy FROM d GROUP BY 1),
st AS (SELECT s.*, c, is_route FROM s JOIN cv USING (node_id) JOIN (SELECT DISTINCT node_id, is_route FROM m) USING (node_id)),
q AS (SELECT vec_id AS query_id, e AS query FROM v WHERE vec_id % 100 = 0),
n AS (SELECT query_id, tree.node_id, parent, support, dispersion, entropy, is_route, 1 - list_cosine_similarity(query, c) AS dist FROM q, tree JOIN st USING (node_id)),
w AS (SELECT n.*, coalesce(p.dist, n.dist) AS pd FROM n LEFT JOIN n p ON p.query_id = n.query_id AND p.node_id = n.parent)"""


def _policy_sql(name: str, decision: str, which: str) -> str:
    """CTEs of one policy; decisions do not depend on how a node was reached, so parents' verdicts are a table."""
    if which == "nearest":
        said = f"SELECT query_id, parent AS node_id, arg_min(node_id, (dist, node_id)) AS chosen, arg_min(dec, (dist, node_id)) AS verdict FROM {name}_d WHERE parent IS NOT NULL GROUP BY 1, 2"
    else:
        said = f"""SELECT query_id, parent AS node_id, arg_min(node_id, (-dist, node_id)) FILTER (dec = 'drill_down') AS chosen,
 CASE WHEN count(*) FILTER (dec = 'drill_down') > 0 THEN 'drill_down' WHEN count(*) FILTER (dec = 'keep_parent') > 0 THEN 'keep_parent' ELSE 'prune' END AS verdict FROM {name}_d WHERE parent IS NOT NULL GROUP BY 1, 2"""
    step = "d.parent = f.node_id" + ("" if which == "all" else " AND s.verdict = 'drill_down' AND d.node_id = s.chosen")
    kept = "" if which == "all" else f""" UNION ALL SELECT f.query_id, d.node_id, f.depth + 1, NULL, d.dist, f.trail || ' > ' || d.node_id, true FROM {name}_f f JOIN {name}_s s USING (query_id, node_id) JOIN {name}_d d ON d.query_id = f.query_id AND d.parent = f.node_id WHERE f.dec = 'drill_down' AND s.verdict = 'keep_parent'"""
    return f"""{name}_d AS (SELECT *, {decision} AS dec FROM w), {name}_s AS ({said}),
{name}_f AS (SELECT query_id, node_id, 0 AS depth, dec, dist, node_id AS trail FROM {name}_d WHERE node_id = 'all' UNION ALL
 SELECT f.query_id, d.node_id, f.depth + 1, d.dec, d.dist, f.trail || ' > ' || d.node_id FROM {name}_f f JOIN {name}_s s USING (query_id, node_id) JOIN {name}_d d ON d.query_id = f.query_id AND {step} WHERE f.dec = 'drill_down'),
{name}_m AS (SELECT query_id, node_id, depth, dec, dist, trail, dec = 'keep_parent' AS gives FROM {name}_f{kept})"""


_ALL = _SETUP + ",\n" + ",\n".join(_policy_sql(name, decision, which) for name, _, decision, which in POLICIES)
DESCENTS_SQL = _ALL + "\n" + " UNION ALL ".join(f"SELECT '{p[0]}' AS policy, query_id, node_id, depth, dec AS decision, round(dist, 6) AS query_distance, trail, gives FROM {p[0]}_m" for p in POLICIES)
EVIDENCE_SQL = _ALL + "\n" + " UNION ALL ".join(f"SELECT '{p}' AS policy, query_id, vec_id AS chunk_id, node_id, round(1 - dist, 6) AS score, depth, trail FROM {p}_m JOIN (SELECT vec_id, node_id FROM v) USING (node_id) WHERE gives" for p in ("hiro", "every"))

QUERIES = {"policy_descents": (policy_descents, DESCENTS_SQL), "descent_evidence": (descent_evidence, EVIDENCE_SQL)}


def _people(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers as identities, every fifth with a code; orders as links between customers."""
    identities = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("identity_id"), F.col("c_mktsegment").alias("entity_type"), F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("c"), "c_nationkey")).alias("code"))
    orders = table(spark, sf_dir, "orders").filter("o_orderkey % 6 = 0")
    return identities, orders.select(F.col("o_custkey").alias("left_id"), (F.col("o_custkey") + F.col("o_orderkey") % 97).alias("right_id"), (F.col("o_orderkey") % 10 / F.lit(10.0)).alias("score"))


def merged_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merging.merged(*_people(spark, sf_dir))


def merge_vetoes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many links are allowed, and why others are not."""
    return merging.judged_links(*_people(spark, sf_dir)).groupBy("veto").agg(F.count(F.lit(1)).alias("links"))


_PEOPLE_SQL = """WITH RECURSIVE i AS (SELECT c_custkey AS id, c_mktsegment AS kind, CASE WHEN c_custkey % 5 = 0 THEN 'c' || c_nationkey END AS code FROM customer),
l AS (SELECT o_custkey AS a, o_custkey + o_orderkey % 97 AS b, o_orderkey % 10 / 10.0 AS score FROM orders WHERE o_orderkey % 6 = 0),
j AS (SELECT a, b, score, p.code AS pc, q.code AS qc, CASE WHEN p.id IS NULL OR q.id IS NULL THEN 'unknown' WHEN p.kind IS DISTINCT FROM q.kind THEN 'type' WHEN p.code <> q.code THEN 'code' END AS veto FROM l LEFT JOIN i p ON a = p.id LEFT JOIN i q ON b = q.id)"""
VETOES_SQL = f"{_PEOPLE_SQL} SELECT veto, count(*) AS links FROM j GROUP BY 1"
MERGED_SQL = f"""{_PEOPLE_SQL},
e AS (SELECT a, b FROM j WHERE veto IS NULL AND pc IS NULL AND qc IS NULL UNION SELECT b, a FROM j WHERE veto IS NULL AND pc IS NULL AND qc IS NULL),
r AS (SELECT id, id AS c FROM i WHERE code IS NULL UNION SELECT r.id, e.b FROM r JOIN e ON r.c = e.a), bare AS (SELECT id, min(c) AS c FROM r GROUP BY 1),
t AS (SELECT a AS id, qc AS code, score FROM j WHERE veto IS NULL AND pc IS NULL AND qc IS NOT NULL UNION ALL SELECT b, pc, score FROM j WHERE veto IS NULL AND qc IS NULL AND pc IS NOT NULL),
best AS (SELECT c, arg_min(t.code, (-score, t.code)) AS code FROM t JOIN bare USING (id) GROUP BY 1),
g AS (SELECT i.id, kind, coalesce(i.code, best.code) AS code, bare.c AS c FROM i LEFT JOIN bare USING (id) LEFT JOIN best USING (c)),
k AS (SELECT id, c, min(id) OVER w AS survivor, count(*) OVER w AS n FROM g WINDOW w AS (PARTITION BY CASE WHEN code IS NULL THEN c END, CASE WHEN code IS NOT NULL THEN kind END, code))
SELECT id AS identity_id, survivor, CASE WHEN n = 1 THEN NULL WHEN c IS NULL THEN 'code' ELSE 'link' END AS reason FROM k"""

QUERIES |= {"merged_identities": (merged_identities, MERGED_SQL), "merge_vetoes": (merge_vetoes, VETOES_SQL)}
