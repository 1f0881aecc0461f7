"""Queries that build and judge: trees, desired states, hotspots, mappings, proposals, admission; with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ident
from ..operators import admission, chunks, distribution, entity, fuse, hits, hotspots, knowledge, mapping, similar, tree, trees
from ..sources import store
from .model import HIERARCHY_SQL, SPANS_SQL, hierarchy, spans, table

DOMAINS = {"a": ("ing the", "tion"), "b": ("ción",)}


def uuid5_sql(seed: str) -> str:
    """The name-based UUID of an SQL expression."""
    cut = "substr(s,1,8) || '-' || substr(s,9,4) || '-5' || substr(s,14,3) || '-' || substr('89ab', ('0x' || substr(s,17,1))::INTEGER % 4 + 1, 1) || substr(s,18,3) || '-' || substr(s,21,12)"
    return f"list_transform([sha1(unhex('{ident.URL_NAMESPACE}') || encode({seed}))], lambda s: {cut})[1]"


def outline_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents in five versions, under headings of one to three levels, some with no heading or page."""
    n = F.col("doc_id")
    path = F.when(n % 9 == 0, None).when(n % 4 == 0, F.col("heading_path")).otherwise(F.concat("heading_path", F.lit(" > k"), n % 3))
    rows = spans(table(spark, sf_dir, "documents"))
    return rows.select(F.concat(F.lit("b"), n % 5).alias("version_id"), F.concat_ws("#", "doc_id", "ordinal").alias("span_id"), path.alias("heading_path"), (n * 1_000_000 + F.col("start_offset")).alias("start_offset"), F.when(n % 6 != 0, n % 50).cast("int").alias("page_no"), "raw_text")


_DOMAIN = "CASE WHEN contains(lower(raw_text), 'ing the') OR contains(lower(raw_text), 'tion') THEN 'a' WHEN contains(lower(raw_text), 'ción') THEN 'b' ELSE 'default' END"
_UP = "SELECT c.parent_node_id AS node_id, substr(string_agg(summary_text, ' ' ORDER BY parts, coalesce(cluster, 2147483647)), 1, 1000) AS up FROM {} c WHERE summary_text IS NOT NULL GROUP BY 1"
OUTLINE_SQL = f"""{SPANS_SQL},
o AS (SELECT 'b' || doc_id % 5 AS version_id, doc_id || '#' || ordinal AS span_id, CASE WHEN doc_id % 9 = 0 THEN NULL WHEN doc_id % 4 = 0 THEN heading_path ELSE heading_path || ' > k' || doc_id % 3 END AS heading_path, doc_id * 1000000 + start_offset AS start_offset, CASE WHEN doc_id % 6 <> 0 THEN doc_id % 50 END::INTEGER AS page_no, raw_text FROM spans),
p AS (SELECT *, string_split(coalesce(heading_path, '(root)'), ' > ') AS parts, {_DOMAIN} AS domain FROM o), q AS (SELECT *, row_number() OVER (PARTITION BY version_id, parts ORDER BY start_offset, span_id, raw_text) AS pos FROM p),
k AS (SELECT version_id, parts, domain, row_number() OVER (PARTITION BY version_id, parts ORDER BY min(pos)) - 1 AS cluster, count(*) OVER (PARTITION BY version_id, parts) > 1 AS split FROM q GROUP BY 1, 2, 3),
r AS (SELECT q.*, CASE WHEN split THEN cluster END AS cluster, {uuid5_sql("version_id || ':' || array_to_string(parts, ' > ') || ':' || len(parts) - 1 || CASE WHEN split THEN ':cluster' || cluster ELSE '' END")} AS node_id FROM q JOIN k USING (version_id, parts, domain)),
leaf AS (SELECT node_id, version_id, parts, cluster, min(page_no) AS page_start, max(page_no) AS page_end, substr(string_agg(raw_text, ' ' ORDER BY pos), 1, 1000) AS summary_text FROM r GROUP BY 1, 2, 3, 4),
g AS (SELECT version_id, parts, min(page_no) AS a, max(page_no) AS b FROM r GROUP BY 1, 2), u AS (SELECT version_id, parts, a, b, unnest(range(1, len(parts))) AS n FROM g),
par AS (SELECT version_id, parts[1:n] AS parts, (arg_min({{'a': a, 'b': b}}, parts)).a AS page_start, (arg_min({{'a': a, 'b': b}}, parts)).b AS page_end FROM (SELECT version_id, parts, a, b, n FROM u) GROUP BY version_id, parts[1:n]),
al AS (SELECT node_id, version_id, parts, cluster, page_start, page_end, summary_text FROM leaf UNION ALL SELECT {uuid5_sql("version_id || ':' || array_to_string(parts, ' > ') || ':' || len(parts) - 1")}, version_id, parts, NULL, page_start, page_end, NULL FROM par ANTI JOIN (SELECT version_id, parts FROM leaf WHERE cluster IS NULL) USING (version_id, parts)),
n0 AS (SELECT *, len(parts) - 1 AS level_no, CASE WHEN len(parts) > 1 THEN {uuid5_sql("version_id || ':' || array_to_string(parts[1:len(parts) - 1], ' > ') || ':' || len(parts) - 2")} END AS parent_node_id FROM al),
n1 AS (SELECT n0.* REPLACE (coalesce(summary_text, up) AS summary_text) FROM n0 LEFT JOIN ({_UP.format("(SELECT * FROM n0 WHERE level_no = 2)")}) USING (node_id)),
nodes AS (SELECT n1.* REPLACE (coalesce(summary_text, up) AS summary_text) FROM n1 LEFT JOIN ({_UP.format("(SELECT * FROM n1 WHERE level_no = 1)")}) USING (node_id)),
links AS (SELECT node_id, version_id, span_id, (row_number() OVER (PARTITION BY node_id ORDER BY pos) - 1)::INTEGER AS ordinal FROM r)"""


def generated_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _ = trees.generated(outline_spans(spark, sf_dir), DOMAINS)
    return nodes.select("node_id", "parent_node_id", "version_id", "level_no", "node_type", "title", "page_start", "page_end", "cluster", F.sha2("summary_text", 256).alias("summary_sha256"))


GENERATED_SQL = f"""WITH {OUTLINE_SQL} SELECT node_id, parent_node_id, version_id, level_no::INTEGER AS level_no, CASE WHEN level_no = 0 THEN 'chapter' ELSE 'section' END AS node_type, parts[-1] AS title, page_start, page_end, cluster::INTEGER AS cluster, sha256(summary_text) AS summary_sha256 FROM nodes"""


def generated_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.generated(outline_spans(spark, sf_dir), DOMAINS)[1]


GENERATED_LINKS_SQL = f"WITH {OUTLINE_SQL} SELECT * FROM links"


def desired_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of the desired state: one a span, under its node."""
    found = trees.desired_state(outline_spans(spark, sf_dir), DOMAINS)[2]
    return found.select("chunk_id", "version_id", "span_id", "chunk_order", "token_count", "page_no", "heading_path", "node_id", F.sha2("text_preview", 256).alias("text_sha256"))


DESIRED_SQL = f"""WITH {OUTLINE_SQL} SELECT {uuid5_sql("'{" + '"span_id":"' + "' || span_id || '" + '","version_id":"' + "' || version_id || '" + '"}' + "'")} AS chunk_id, version_id, span_id, (row_number() OVER (PARTITION BY version_id ORDER BY start_offset, span_id) - 1)::INTEGER AS chunk_order,
 len(list_filter(regexp_split_to_array(raw_text, '\\s+'), lambda x: x <> ''))::INTEGER AS token_count, page_no, heading_path, node_id, sha256(raw_text) AS text_sha256 FROM r"""


def node_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities that nodes stand for, with how many nodes and evidences back each."""
    nodes, links = trees.generated(outline_spans(spark, sf_dir), DOMAINS)
    entities, node_links, evidence = trees.node_entities(nodes, links)
    counted = node_links.groupBy("entity_id").agg(F.count(F.lit(1)).alias("nodes")).join(evidence.groupBy("entity_id").agg(F.countDistinct("span_id").alias("spans")), "entity_id")
    return entities.join(counted, "entity_id").select("entity_id", "entity_key", "entity_type", "canonical_name", F.sha2("description", 256).alias("description_sha256"), "nodes", "spans")


NODE_ENTITIES_SQL = f"""WITH {OUTLINE_SQL}, f AS (SELECT node_id, arg_min(span_id, ordinal) AS span_id FROM links GROUP BY 1), e AS (SELECT nodes.*, span_id, parts[-1] AS name, 'concept:' || regexp_replace(lower(parts[-1]), '[^a-z0-9]', '', 'g') AS entity_key FROM nodes JOIN f USING (node_id))
SELECT {uuid5_sql("entity_key")} AS entity_id, entity_key, 'concept' AS entity_type, arg_min(name, {{'l': level_no, 'p': array_to_string(parts, ' > '), 'n': node_id}}) AS canonical_name, sha256(arg_min(summary_text, {{'l': level_no, 'p': array_to_string(parts, ' > '), 'n': node_id}})) AS description_sha256, count(*) AS nodes, count(DISTINCT span_id) AS spans FROM e GROUP BY entity_key"""


# hotspots


def place_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market segments as queries, places as nodes: mean balance as similarity, customers as support."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("query_id"), F.concat(F.lit("n"), "c_nationkey").alias("leaf"), F.col("c_acctbal").alias("s"))
    up = chunks.ancestors_by_path(hierarchy(spark, sf_dir)).select(F.col("node_id").alias("leaf"), F.col("ancestor_id").alias("node_id"), "distance")
    sums = rows.join(F.broadcast(up.filter("leaf like 'n%'")), "leaf").groupBy("query_id", "node_id").agg(F.round(F.avg("s") / 10000, 9).alias("similarity"), F.count(F.lit(1)).alias("support"), (F.max("distance") > 0).alias("is_route"))  # 25 nations
    return sums.join(hierarchy(spark, sf_dir).select("node_id", "heading_path"), "node_id")


PLACES_SQL = f"""{HIERARCHY_SQL}, a AS (SELECT node_id AS leaf, node_id, false AS r FROM tree WHERE level_no = 2 UNION ALL SELECT node_id, parent_node_id, true FROM tree WHERE level_no = 2 UNION ALL SELECT node_id, 'world', true FROM tree WHERE level_no = 2),
st AS (SELECT c_mktsegment AS query_id, a.node_id, round(avg(c_acctbal) / 10000, 9) AS similarity, count(*) AS support, bool_or(r) AS is_route FROM customer JOIN a ON leaf = 'n' || c_nationkey GROUP BY 1, 2)"""


def route_hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hotspots.route_subtree(place_stats(spark, sf_dir), 3).select("query_id", "node_id", F.round("score", 6).alias("score"), "reason", "place")


ROUTE_HOTSPOTS_SQL = f"""WITH RECURSIVE {PLACES_SQL}, sc AS (SELECT query_id, node_id, heading_path AS p, is_route, similarity + CASE WHEN is_route THEN 0.08 ELSE 0 END + 0.03 * least(level_no, 4) + 0.003 * least(support, 10) - CASE WHEN is_route AND level_no = 0 THEN 0.06 ELSE 0 END AS score FROM st JOIN tree USING (node_id) WHERE similarity > 0),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS n FROM sc),
f AS (SELECT DISTINCT query_id, 0::BIGINT AS n, []::VARCHAR[] AS kept FROM o UNION ALL SELECT f.query_id, o.n, CASE WHEN len(kept) < 3 AND len(list_filter(kept, lambda k: starts_with(k || ' > ', p || ' > ') OR starts_with(p || ' > ', k || ' > '))) = 0 THEN list_append(kept, p) ELSE kept END FROM f JOIN o ON o.query_id = f.query_id AND o.n = f.n + 1),
k AS (SELECT query_id, arg_max(kept, n) AS kept FROM f GROUP BY 1), u AS (SELECT query_id, unnest(kept) AS p, unnest(range(1, len(kept) + 1)) AS place FROM k)
SELECT query_id, node_id, round(score, 6)::DOUBLE AS score, CASE WHEN is_route THEN 'subtree_similarity' ELSE 'node_similarity' END AS reason, place::INTEGER AS place FROM u JOIN sc USING (query_id, p)"""


def cluster_hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = hierarchy(spark, sf_dir)
    leaves = place_stats(spark, sf_dir).filter("not is_route")
    return hotspots.cluster(leaves, chunks.ancestors_by_path(nodes), nodes.filter("parent_node_id is null").select("node_id"), 4).withColumn("score", F.round("score", 6))


CLUSTER_SQL = f"""{PLACES_SQL}, b AS (SELECT query_id, node_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, node_id) AS n FROM st WHERE NOT is_route AND similarity > 0 QUALIFY n <= 20),
un AS (SELECT b.*, a.node_id AS anc FROM b JOIN a ON a.leaf = b.node_id), s AS (SELECT query_id, anc, max(similarity) AS top, 0.2 * max(similarity) + 0.35 * avg(similarity) + 0.3 * least(count(*) / 20.0, 1) + 0.15 AS score FROM un GROUP BY 1, 2),
w AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY anc = 'world', score DESC, anc) = 1),
m AS (SELECT un.query_id, node_id, top, n, anc, row_number() OVER (PARTITION BY un.query_id ORDER BY similarity DESC, node_id) AS i FROM un JOIN w USING (query_id, anc)),
cluster AS (SELECT query_id, node_id, score, reason, row_number() OVER (PARTITION BY query_id ORDER BY n)::INTEGER AS place FROM (SELECT query_id, anc AS node_id, top AS score, 'cluster_hotspot' AS reason, 0 AS n FROM w UNION ALL SELECT query_id, node_id, top, 'cluster_member', n FROM m WHERE i < 4 AND node_id <> anc))"""
CLUSTER_HOTSPOTS_SQL = f"WITH {CLUSTER_SQL} SELECT query_id, node_id, round(score, 6) AS score, reason, place FROM cluster"


def child_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as hits on their nations, every tenth on the region too."""
    rows = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")), "c_nationkey")  # 25 rows
    score = F.col("c_acctbal") / 10000
    own = rows.filter("c_acctbal > 8000").select(F.col("c_mktsegment").alias("query_id"), F.concat(F.lit("n"), "c_nationkey").alias("node_id"), score.alias("score"))
    more = rows.filter("c_custkey % 200 = 0").select(F.col("c_mktsegment").alias("query_id"), F.concat(F.lit("r"), "n_regionkey").alias("node_id"), score.alias("score"))
    return hotspots.child_distribution(own.unionByName(more), hierarchy(spark, sf_dir)).withColumn("score", F.round("score", 9))


CHILD_SCORES_SQL = f"""WITH {HIERARCHY_SQL}, h AS (SELECT c_mktsegment AS q, 'n' || c_nationkey AS node_id, c_acctbal / 10000 AS s FROM customer WHERE c_acctbal > 8000 UNION ALL SELECT c_mktsegment, 'r' || n_regionkey, c_acctbal / 10000 FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 200 = 0),
x AS (SELECT q, node_id, parent_node_id AS p, s FROM h JOIN tree USING (node_id)), qs AS (SELECT DISTINCT q FROM x),
t AS (SELECT q, node_id, (SELECT avg(s) FROM x WHERE x.q = qs.q AND x.node_id = tree.node_id) AS d, (SELECT count(*) FROM x WHERE x.q = qs.q AND x.p IS NOT DISTINCT FROM tree.parent_node_id AND x.node_id <> tree.node_id) AS sib, (SELECT count(*) FROM x WHERE x.q = qs.q AND x.p = tree.node_id) AS c, (SELECT avg(s) FROM x WHERE x.q = qs.q AND x.p = tree.node_id) AS cm FROM qs, tree)
SELECT q AS query_id, node_id, round(CASE WHEN d IS NOT NULL THEN d * 0.6 + sib / (sib + 1) * 0.25 + c / (c + 1) * 0.15 ELSE cm * 0.8 + least(c / 5, 1) * 0.2 END::DOUBLE, 9) AS score FROM t WHERE d IS NOT NULL OR c > 0"""


def hotspot_traversal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From cluster hotspots to chunks of their children, places of equal hits by hotspot, then score."""
    as_id = lambda c: ident.uuid5(F.col(c)).alias(c)
    nodes = hierarchy(spark, sf_dir)
    found = hotspots.cluster(place_stats(spark, sf_dir).filter("not is_route"), chunks.ancestors_by_path(nodes), nodes.filter("parent_node_id is null").select("node_id"), 4)
    spots = found.select("query_id", as_id("node_id"), "place")
    edges = nodes.select(as_id("node_id"), F.when(F.col("parent_node_id").isNotNull(), ident.uuid5(F.col("parent_node_id"))).alias("parent_node_id"))
    stats = place_stats(spark, sf_dir).select("query_id", as_id("node_id"), F.round("similarity", 6).alias("similarity"))
    rows = table(spark, sf_dir, "customer").select(ident.uuid5(F.concat(F.lit("n"), "c_nationkey")).alias("node_id"), F.concat(F.lit("c"), "c_custkey").alias("chunk_id"), F.concat(F.lit("s"), "c_custkey").alias("span_id"))
    return hotspots.ordered_hits(hotspots.traversed(spots, edges, rows, stats), spots)


TRAVERSAL_SQL = f"""WITH {CLUSTER_SQL}, z AS (SELECT c.query_id, c.place AS hotspot_place, c.node_id AS h, {uuid5_sql("c.node_id")} AS hotspot_id FROM cluster c),
ev AS (SELECT z.query_id, z.hotspot_place, z.hotspot_id, t.node_id AS n, 1 AS depth FROM z JOIN tree t ON t.parent_node_id = h UNION ALL SELECT query_id, hotspot_place, hotspot_id, h, 0 FROM z WHERE h NOT IN (SELECT parent_node_id FROM tree WHERE parent_node_id IS NOT NULL)),
al AS (SELECT query_id, hotspot_id, hotspot_id AS node_id, NULL::VARCHAR AS chunk_id, '00000000-0000-0000-' || translate(substr(hotspot_id, 20, 1), '89abcdef', '01234567') || substr(hotspot_id, 21) AS span_id, 0.0::DOUBLE AS similarity, 0 AS depth, hotspot_place FROM z
 UNION ALL SELECT ev.query_id, hotspot_id, {uuid5_sql("n")}, 'c' || c_custkey, 's' || c_custkey, round(similarity, 6), depth, hotspot_place FROM ev JOIN st ON st.query_id = ev.query_id AND st.node_id = n JOIN customer ON 'n' || c_nationkey = n)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hotspot_place, similarity DESC, node_id, chunk_id NULLS FIRST, span_id)::INTEGER AS place FROM al"""


def subtree_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors lie at every other nation and at one region; the other nodes have their subtrees'."""
    nodes = hierarchy(spark, sf_dir)
    own = table(spark, sf_dir, "embeddings").select(F.when(F.col("vec_id") % 11 == 0, F.lit("r1")).otherwise(F.concat(F.lit("n"), F.col("vec_id") % 25)).alias("node_id"), "embedding").filter("node_id = 'r1' or cast(substr(node_id, 2) as int) % 2 = 0")
    out = distribution.subtree_stats(own, chunks.ancestors_by_path(nodes))
    return out.select("node_id", "support", "direct", "is_route", F.round("dispersion", 6).alias("dispersion"))


SUBTREE_SQL = f"""WITH {HIERARCHY_SQL}, v AS (SELECT CASE WHEN vec_id % 11 = 0 THEN 'r1' ELSE 'n' || vec_id % 25 END AS node_id, vec_id, embedding FROM embeddings), m AS (SELECT * FROM v WHERE node_id = 'r1' OR substr(node_id, 2)::INTEGER % 2 = 0),
up AS (SELECT t.node_id, t.parent_node_id AS a FROM tree t WHERE parent_node_id IS NOT NULL UNION ALL SELECT t.node_id, 'world' FROM tree t WHERE level_no = 2),
us AS (SELECT node_id, vec_id, embedding FROM m UNION ALL SELECT a, vec_id, embedding FROM m JOIN up USING (node_id) WHERE a NOT IN (SELECT node_id FROM m)),
x AS (SELECT node_id, vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM us), c AS (SELECT node_id, i, avg(x) AS m FROM x GROUP BY 1, 2), d AS (SELECT node_id, vec_id, sqrt(sum((x - m) ** 2)) AS d FROM x JOIN c USING (node_id, i) GROUP BY 1, 2), own AS (SELECT node_id, count(*) AS n FROM m GROUP BY 1)
SELECT node_id, count(*) AS support, coalesce(any_value(n), 0)::BIGINT AS direct, any_value(n) IS NULL AS is_route, round(avg(d), 6) AS dispersion FROM d LEFT JOIN own USING (node_id) GROUP BY 1"""


def parent_roll_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.concat(F.lit("n"), "c_nationkey").alias("node_id"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal")).alias("score"))
    return distribution.tree_roll_up(rows, chunks.ancestors_by_path(hierarchy(spark, sf_dir))).withColumn("total", F.round("total", 4))


PARENT_ROLL_UP_SQL = f"WITH {PLACES_SQL} SELECT a.node_id, round(sum(CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal ELSE 0 END), 4) AS total, count(*) AS hits FROM customer JOIN a ON leaf = 'n' || c_nationkey GROUP BY 1"


# mapping


def raw_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve extracted entities of each text, most of them wrong in some way."""
    k = F.col("position")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("normalized_text"), F.explode(F.sequence(F.lit(0), F.lit(11))).alias("position"))
    at = F.when(k == 8, 0).when(k == 10, 6).otherwise(k * 3)
    piece = F.substr("normalized_text", at + F.when(k == 5, 2).otherwise(1), F.lit(5))
    return rows.select(
        "doc_id", "position", "normalized_text", (k != 9).alias("is_mapping"), F.when(k == 1, None).when(k == 2, "x").when(k == 11, "  ").otherwise(piece).alias("text"), F.when(k != 3, at).alias("char_start"),
        (at + F.when(k == 4, 10_000_000).otherwise(5)).alias("char_end"), F.when(k == 6, "星").otherwise("人名").alias("label"), k.isin(7, 10).alias("has_confidence"), F.when(k == 7, 1.5).otherwise(0.5).alias("confidence"),
    )


RAW_ENTITIES_SQL = """raw AS (SELECT doc_id, k AS position, text AS t, CASE k WHEN 8 THEN 0 WHEN 10 THEN 6 ELSE k * 3 END AS pos, k FROM documents, range(12) x(k)),
piece AS (SELECT *, CASE k WHEN 1 THEN NULL WHEN 2 THEN 'x' WHEN 11 THEN '  ' ELSE substr(t, pos + CASE WHEN k = 5 THEN 2 ELSE 1 END, 5) END AS m FROM raw),
judged AS (SELECT *, CASE WHEN k = 9 THEN 'not_a_mapping' WHEN coalesce(m, '') = '' THEN 'missing_text' WHEN length(m) < 2 OR regexp_full_match(m, '\\s*') THEN 'too_short' WHEN k = 3 THEN 'missing_offset' WHEN k = 4 OR pos + 5 > length(t) THEN 'out_of_range'
 WHEN substr(t, pos + 1, 5) <> m THEN 'not_exact_slice' WHEN k = 6 THEN 'unknown_entity_type' WHEN k = 7 THEN 'invalid_confidence' END AS r FROM piece),
mapped AS (SELECT doc_id, position, m AS text, coalesce(r, CASE WHEN row_number() OVER (PARTITION BY doc_id, m, pos, r IS NULL ORDER BY position) > 1 THEN 'duplicate_span' END) AS rejection FROM judged)"""


def mapped_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.mapped_entities(raw_entities(spark, sf_dir)).select("doc_id", "position", "text", "rejection")


MAPPED_ENTITIES_SQL = f"WITH {RAW_ENTITIES_SQL} SELECT doc_id, position::INTEGER AS position, text, rejection FROM mapped"


def mapped_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fourteen extracted relations of each text between its first accepted entities."""
    mentions = mapping.split_outcomes(mapping.mapped_entities(raw_entities(spark, sf_dir)))[0].select("doc_id", "text")
    k = F.col("position")
    first, second = F.substr("normalized_text", F.lit(1), F.lit(5)), F.substr("normalized_text", F.lit(7), F.lit(5))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("normalized_text"), F.explode(F.sequence(F.lit(0), F.lit(13))).alias("position"))
    raw = rows.select(
        "doc_id", "position", "normalized_text", (k != 12).alias("is_mapping"), F.when(k == 1, None).when(k == 2, "zz§zz").when(k == 13, first).otherwise(F.substr("normalized_text", F.lit(1), F.lit(60))).alias("source_text"),
        F.when(k == 3, None).when(k == 9, "no such name").otherwise(first).alias("subject_text"), F.when(k == 4, "x").when(k == 10, first).otherwise(second).alias("object_text"),
        F.when(k == 5, "星").when(k == 7, "产品名").otherwise("人名").alias("subject_label"), F.when(k == 8, "产品名").otherwise("人名").alias("object_label"), F.when(k == 6, "nope").otherwise("knows").alias("relation"),
    )
    schema = spark.createDataFrame([("knows", ["Person"], ["Person"])], "relation string, subjects array<string>, objects array<string>")
    return mapping.mapped_relations(raw, mentions, schema).select("doc_id", "position", "rejection")


MAPPED_RELATIONS_SQL = f"""WITH {RAW_ENTITIES_SQL}, men AS (SELECT DISTINCT doc_id, text FROM mapped WHERE rejection IS NULL),
rel AS (SELECT doc_id, k, text AS t, CASE k WHEN 1 THEN NULL WHEN 2 THEN 'zz§zz' WHEN 13 THEN substr(text, 1, 5) ELSE substr(text, 1, 60) END AS src, CASE k WHEN 3 THEN NULL WHEN 9 THEN 'no such name' ELSE substr(text, 1, 5) END AS s, CASE k WHEN 4 THEN 'x' WHEN 10 THEN substr(text, 1, 5) ELSE substr(text, 7, 5) END AS o FROM documents, range(14) x(k)),
rj AS (SELECT rel.*, CASE WHEN k = 12 THEN 'not_a_mapping' WHEN coalesce(src, '') = '' THEN 'missing_source_text' WHEN NOT contains(t, src) THEN 'source_not_in_normalized_text' WHEN coalesce(s, '') = '' THEN 'missing_text' WHEN length(s) < 2 OR regexp_full_match(s, '\\s*') THEN 'too_short'
 WHEN coalesce(o, '') = '' THEN 'missing_text' WHEN length(o) < 2 OR regexp_full_match(o, '\\s*') THEN 'too_short' WHEN k = 5 THEN 'unknown_entity_type' WHEN k = 6 THEN 'relation_not_in_schema' WHEN k = 7 THEN 'subject_type_not_allowed' WHEN k = 8 THEN 'object_type_not_allowed'
 WHEN NOT contains(src, s) THEN 'subject_not_in_source' WHEN NOT contains(src, o) THEN 'object_not_in_source' WHEN NOT EXISTS (SELECT 1 FROM men WHERE men.doc_id = rel.doc_id AND men.text = s) THEN 'subject_not_a_mention' WHEN NOT EXISTS (SELECT 1 FROM men WHERE men.doc_id = rel.doc_id AND men.text = o) THEN 'object_not_a_mention' WHEN s = o THEN 'self_loop' END AS r FROM rel)
SELECT doc_id, k::INTEGER AS position, coalesce(r, CASE WHEN row_number() OVER (PARTITION BY doc_id, s, o, src, r IS NULL ORDER BY k) > 1 THEN 'duplicate_relation' END) AS rejection FROM rj"""


def canonical_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw labels and answers of a model, in their normal forms."""
    n = F.col("event_id")
    labels = F.array(*(F.lit(x) for x in ("PER", "LOC", "CORP", "GRP", "CW", "PROD", "per", "X")))
    answer = F.when(n % 3 == 0, F.concat(F.lit("["), n % 40, F.lit(", 2, "), n % 40, F.lit("]"))).when(n % 3 == 1, F.concat(F.lit("pages "), n % 40, F.lit(" and 20000"))).otherwise("none")
    vector = F.when(n % 4 != 0, F.concat(F.lit("["), n % 9, F.lit(".5,2]"))).otherwise("?")
    start, end = F.concat(F.lit("2024-01-0"), n % 9 + 1, F.lit("T00:00:00Z")), F.when(n % 5 != 0, F.lit("2024-01-05T00:00:00+00:00"))
    return table(spark, sf_dir, "events").select(
        "event_id", mapping.canonical_type(F.element_at(labels, (n % 8 + 1).cast("int"))).alias("entity_type"), F.array_join(mapping.page_numbers(answer), ",").alias("pages"),
        F.element_at(mapping.vector_of(vector), 1).alias("first_value"), mapping.valid_time(start, end).alias("valid"),
    )


CANONICAL_SQL = """SELECT event_id, ['Person', 'Location', 'Organization', 'Organization', 'CreativeWork', 'Product', NULL, NULL][event_id % 8 + 1] AS entity_type,
 array_to_string(list_sort(list_distinct(list_filter(CASE event_id % 3 WHEN 0 THEN [event_id % 40, 2] WHEN 1 THEN [event_id % 40] ELSE [] END, lambda x: x >= 1))), ',') AS pages,
 CASE WHEN event_id % 4 <> 0 THEN event_id % 9 + 0.5 END::DOUBLE AS first_value, event_id % 5 = 0 OR event_id % 9 + 1 <= 5 AS valid FROM events"""


def graph_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as relations of suppliers and parts; those with different flags are in conflict."""
    lines = table(spark, sf_dir, "lineitem")
    entities = lines.select(F.concat(F.lit("s"), "l_suppkey").alias("entity_name"), F.col("l_orderkey").alias("ordinal"))
    known = table(spark, sf_dir, "supplier").filter("s_suppkey % 4 = 0").select(F.concat(F.lit("s"), "s_suppkey").alias("entity_name"))
    relations = lines.select(F.concat(F.lit("s"), "l_suppkey").alias("src_id"), F.concat(F.lit("p"), "l_partkey").alias("tgt_id"), F.col("l_returnflag").alias("description"), F.lit(None).cast("string").alias("keywords"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ordinal"))
    named, pairs = mapping.ingested(entities, relations, known)
    return named.select(F.col("entity_name").alias("src_id"), F.lit(None).cast("string").alias("tgt_id"), "ordinal", "outcome").unionByName(pairs.select("src_id", "tgt_id", "ordinal", "outcome"))


GRAPH_INGEST_SQL = """SELECT 's' || l_suppkey AS src_id, NULL::VARCHAR AS tgt_id, min(l_orderkey) AS ordinal, CASE WHEN l_suppkey % 4 = 0 THEN 'skipped' ELSE 'inserted' END AS outcome FROM lineitem GROUP BY l_suppkey
UNION ALL SELECT 's' || l_suppkey, 'p' || l_partkey, min(l_orderkey * 8 + l_linenumber), CASE WHEN count(DISTINCT l_returnflag) = 1 THEN 'inserted' ELSE 'conflict' END FROM lineitem GROUP BY l_suppkey, l_partkey"""


# proposals and admission


def proposal_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(
        "event_id", F.when(n % 7 == 0, "/abs/x.md").when(n % 7 == 1, "wiki/../x.md").when(n % 7 == 2, "raw/x.md").otherwise(F.concat(F.lit("wiki/e"), n, F.lit(".md"))).alias("target_file"), F.when(n % 11 != 0, F.concat(F.lit('say "hi" '), n)).alias("patch"),
        F.when(n % 13 == 0, " ").otherwise("ann").alias("actor"), F.when(n % 17 == 0, "2024-13-01T00:00:00Z").otherwise("2024-01-02T03:04:05Z").alias("created_at"), F.when(n % 3 == 0, F.array().cast("array<string>")).when(n % 19 == 0, F.array(F.lit(" "))).otherwise(F.array(F.lit("s1"))).alias("evidence"),
    )
    return admission.proposals(rows, ["wiki", "notes"]).select("event_id", "proposal_id", "unverified", "breach")


PROPOSALS_SQL = f"""WITH p AS (SELECT event_id, event_id AS n, CASE event_id % 7 WHEN 0 THEN '/abs/x.md' WHEN 1 THEN 'wiki/../x.md' WHEN 2 THEN 'raw/x.md' ELSE 'wiki/e' || event_id || '.md' END AS f, CASE WHEN event_id % 11 <> 0 THEN 'say \\"hi\\" ' || event_id ELSE '' END AS patch, CASE WHEN event_id % 13 = 0 THEN ' ' ELSE 'ann' END AS actor, CASE WHEN event_id % 17 = 0 THEN '2024-13-01T00:00:00Z' ELSE '2024-01-02T03:04:05Z' END AS made FROM events)
SELECT event_id, {uuid5_sql("'[" + '"' + "' || f || '" + '","' + "' || patch || '" + '","' + "' || actor || '" + '","' + "' || made || '" + '"]' + "'")} AS proposal_id, n % 3 = 0 AS unverified,
 CASE WHEN n % 7 < 2 THEN 'target_file:not relative' WHEN n % 7 = 2 THEN 'target_file:not writable' WHEN n % 13 = 0 THEN 'actor:missing' WHEN n % 11 = 0 THEN 'patch:missing' WHEN n % 17 = 0 THEN 'created_at:time' WHEN n % 3 <> 0 AND n % 19 = 0 THEN 'evidence:blank' END AS breach FROM p"""


def applied_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second document gets its text as the new body of a file; some reviews are missing or of another text."""
    docs, n = table(spark, sf_dir, "documents"), F.col("doc_id")
    path = F.concat(F.lit("f"), n)
    new = docs.filter("doc_id % 2 = 0").select(n.cast("string").alias("proposal_id"), path.alias("target_file"), F.col("text").alias("patch"))
    files = docs.filter("doc_id % 3 <> 0").select(path.alias("path"), F.when(n % 5 == 0, F.lit("old body")).otherwise(F.concat(F.lit("---\ntitle: t"), n, F.lit("\n---\nold body\n"))).alias("text"))
    journal = docs.filter("doc_id % 8 <> 0").select(n.cast("string").alias("proposal_id"), F.when(n % 14 == 0, "rejected").otherwise("approved").alias("status"), F.sha2(F.when(n % 10 == 0, "other").otherwise(F.col("text")), 256).alias("payload_digest"))
    return admission.applied(new, files, journal).select("proposal_id", "outcome", F.sha2("content", 256).alias("content_sha256"))


APPLIED_SQL = """WITH a AS (SELECT doc_id AS n, CASE WHEN text LIKE '%' || chr(10) THEN text ELSE text || chr(10) END AS t, CASE WHEN doc_id % 8 = 0 OR doc_id % 14 = 0 THEN 'not approved' WHEN doc_id % 10 = 0 AND text <> 'other' THEN 'payload changed' ELSE 'merged' END AS outcome FROM documents WHERE doc_id % 2 = 0)
SELECT n::VARCHAR AS proposal_id, outcome, CASE WHEN outcome = 'merged' THEN sha256(CASE WHEN n % 3 <> 0 AND n % 5 <> 0 THEN '---' || chr(10) || 'title: t' || n || chr(10) || '---' || chr(10) || t ELSE t END) END AS content_sha256 FROM a"""


def bundle_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    endings = F.array_compact(F.array(F.lit(".md"), F.when(n % 3 != 0, ".spans.json"), F.when(n % 5 != 0, ".pair.json"), F.lit(".tmp")))
    files = table(spark, sf_dir, "documents").select(F.concat(F.lit("raw/d"), n).alias("slug"), F.explode(endings).alias("e")).select(F.concat("slug", "e").alias("path"))
    return admission.triples(files).select("slug", F.array_join("missing", ",").alias("missing"))


TRIPLES_SQL = "SELECT 'raw/d' || doc_id AS slug, array_to_string(list_filter([CASE WHEN doc_id % 5 = 0 THEN '.pair.json' END, CASE WHEN doc_id % 3 = 0 THEN '.spans.json' END], lambda x: x IS NOT NULL), ',') AS missing FROM documents"


def admitted_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as facts of parts, orders as files."""
    n = F.col("l_partkey")
    kind = F.when(n % 3 == 0, "concept").when(n % 3 == 1, "entity").otherwise("relation")
    facts = table(spark, sf_dir, "lineitem").select(kind.alias("kind"), n.cast("string").alias("natural_key"), F.when(n % 5 == 0, F.concat(F.lit('{"b": "1",  "a": "'), "l_returnflag", F.lit('"}'))).otherwise('{"b":"1","a":"x"}').alias("qualifiers"), F.col("l_orderkey").alias("path"), F.when(n % 7 == 0, F.col("l_suppkey")).alias("span_id"))
    known = table(spark, sf_dir, "supplier").filter("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("span_id"))
    return admission.admitted(facts, known)


ADMITTED_SQL = """WITH f AS (SELECT l_partkey AS n, max(l_partkey % 7 = 0 AND l_suppkey % 2 <> 0) AS lost, count(DISTINCT l_orderkey) AS files, count(DISTINCT CASE WHEN l_partkey % 5 = 0 THEN l_returnflag END) AS q FROM lineitem GROUP BY 1)
SELECT CASE n % 3 WHEN 0 THEN 'concept' WHEN 1 THEN 'entity' ELSE 'relation' END AS kind, n::VARCHAR AS natural_key, CASE WHEN lost THEN 'unknown span' WHEN n % 3 = 0 AND files > 1 THEN 'duplicate concept' WHEN q > 1 THEN 'conflict' ELSE 'admitted' END AS outcome, files FROM f"""


def schema_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey")
    item = F.when(n % 5 == 0, "[1]").when(n % 5 == 1, F.concat(F.lit('{"name": "t'), n, F.lit('", "description": "d", "required_fields": ["a"]}'))).when(n % 5 == 2, '{"name": " ", "description": "d"}').when(n % 5 == 3, '{"name": "x", "description": "d", "color": "red"}').otherwise('{"name": "x", "description": "d", "allowed_source_types": "Person"}')
    return admission.checked_schemas(table(spark, sf_dir, "part").select("p_partkey", item.alias("item"))).groupBy("name", "breach").agg(F.count(F.lit(1)).alias("n"))


SCHEMA_CHECKS_SQL = "SELECT CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 't' || p_partkey WHEN 2 THEN ' ' ELSE 'x' END AS name, CASE p_partkey % 5 WHEN 0 THEN 'not an object' WHEN 2 THEN 'name:missing' WHEN 3 THEN 'unknown field' WHEN 4 THEN 'allowed_source_types:list' END AS breach, count(*) AS n FROM part GROUP BY 1, 2"


# reviews, hits and identities


def adjudications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as items of a basket, some judged before; lines as verdicts."""
    items = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id"), F.when(F.col("o_orderkey") % 4 == 0, "accepted").otherwise("pending").alias("status"))
    verdicts = table(spark, sf_dir, "lineitem").filter("l_linenumber <= 2").select((F.col("l_orderkey") + F.when(F.col("l_orderkey") % 9 == 0, 100_000_000).otherwise(0)).alias("item_id"), F.when(F.col("l_orderkey") % 5 == 0, "maybe").otherwise("rejected").alias("verdict"), F.col("l_linenumber").alias("ordinal"))
    return entity.adjudicated(items, verdicts).groupBy("status", "outcome").agg(F.count(F.lit(1)).alias("n"))


ADJUDICATIONS_SQL = """WITH i AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN 'accepted' ELSE 'pending' END AS s FROM orders), v AS (SELECT CASE WHEN l_orderkey % 9 = 0 THEN l_orderkey + 100000000 ELSE l_orderkey END AS k, CASE WHEN l_orderkey % 5 = 0 THEN 'maybe' ELSE 'rejected' END AS d, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS n FROM lineitem WHERE l_linenumber <= 2),
j AS (SELECT s, d, CASE WHEN d IS NULL THEN NULL WHEN s IS NULL THEN 'unknown item' WHEN d = 'maybe' THEN 'invalid verdict' WHEN s <> 'pending' THEN 'already adjudicated' WHEN n > 1 THEN 'repeated' ELSE 'applied' END AS outcome FROM i FULL JOIN v USING (k))
SELECT CASE WHEN outcome = 'applied' THEN d ELSE s END AS status, outcome, count(*) AS n FROM j GROUP BY 1, 2"""


def tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select(F.concat(F.lit("c"), F.col("n_nationkey") % 9).alias("cluster_id"), "n_nationkey", F.lit(False).alias("tombstoned"))
    return entity.tombstoned(rows, ["c3", "c5"])


TOMBSTONES_SQL = "SELECT 'c' || n_nationkey % 9 AS cluster_id, n_nationkey, n_nationkey % 9 IN (3, 5) AS tombstoned FROM nation"


def page_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as hits on pages (line numbers) of orders, nodes of two levels over them."""
    rows = table(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("hit_id"), F.col("l_orderkey").alias("version_id"), F.col("l_linenumber").cast("int").alias("page_no")).distinct()
    three = (("a", 0, 1, 9, "x"), ("b", 1, 2, 4, "x > y"), ("c", 1, 3, 6, "x > long"))
    node = [F.struct(F.lit(n).alias("node_id"), F.lit(level).alias("level_no"), F.lit(a).alias("page_start"), F.lit(b).alias("page_end"), F.lit(t).alias("heading_path"), F.lit(t).alias("title")) for n, level, a, b, t in three]
    nodes = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("version_id"), F.explode(F.array(*node)).alias("n")).select("version_id", "n.*")
    return tree.most_specific(rows, nodes, "hit_id").select("hit_id", "node_id")


PAGE_NODES_SQL = "SELECT DISTINCT l_orderkey || '-' || l_linenumber AS hit_id, CASE WHEN l_linenumber BETWEEN 3 AND 6 THEN 'c' WHEN l_linenumber = 2 THEN 'b' ELSE 'a' END AS node_id FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)"


def hits_to_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as hits, part types as heading paths: each takes the node of the path's first part."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("hit_id"), F.col("p_type").alias("heading_path"))
    own = table(spark, sf_dir, "part").select(F.col("p_type").alias("heading_path"), F.when((F.col("p_partkey") % 3 != 0) & (F.col("p_type") != "SMALL"), F.col("p_partkey")).alias("node_id"), F.col("p_partkey").alias("chunk_order"))
    return hits.nodes_of_hits(rows, own).groupBy("heading_path", "node_id").agg(F.count(F.lit(1)).alias("n"))


HITS_TO_NODES_SQL = "WITH f AS (SELECT p_type, min(p_partkey) AS node_id FROM part WHERE p_partkey % 3 <> 0 AND p_type <> 'SMALL' GROUP BY 1) SELECT p_type AS heading_path, node_id, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey JOIN f USING (p_type) GROUP BY 1, 2"


def ranked_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers by their evidence: score, support, id."""
    links = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("entity_id"), F.col("l_returnflag").alias("source_kind"), (1 - F.col("l_discount")).alias("confidence_score"))
    scored = knowledge.evidence_scores(links, {"A": 1.0, "N": 0.5, "R": 0.25}, bonus=0.0001, most=1.0).withColumn("confidence", F.round("confidence", 3)).withColumn("_all", F.lit(0))
    return fuse.ranked(scored, "_all", [F.desc_nulls_last("confidence"), F.desc("support"), F.asc("entity_id")]).select("entity_id", "confidence", "support", "rank")


RANKED_EVIDENCE_SQL = """WITH l AS (SELECT l_suppkey AS e, CASE l_returnflag WHEN 'A' THEN 1.0 WHEN 'N' THEN 0.5 ELSE 0.25 END::DOUBLE AS w, 1 - l_discount AS c FROM lineitem), s AS (SELECT e, round(least(1.0, sum(w * c) / sum(w) + 0.0001 * (count(*) - 1)), 3) AS confidence, count(*) AS support FROM l GROUP BY 1)
SELECT e AS entity_id, confidence, support, row_number() OVER (ORDER BY confidence DESC, support DESC, e)::INTEGER AS rank FROM s"""


def dangling_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    relations = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("source_id"), F.concat(F.lit("p"), "l_partkey").alias("target_id")).distinct()
    entities = table(spark, sf_dir, "supplier").filter("s_suppkey % 9 <> 0").select(F.concat(F.lit("s"), "s_suppkey").alias("entity_id")).unionByName(table(spark, sf_dir, "part").filter("p_partkey % 8 <> 0").select(F.concat(F.lit("p"), "p_partkey").alias("entity_id")))
    return knowledge.dangling(relations, entities)


DANGLING_SQL = "SELECT DISTINCT 's' || l_suppkey AS source_id, 'p' || l_partkey AS target_id FROM lineitem WHERE l_suppkey % 9 = 0 OR l_partkey % 8 = 0"


def page_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of pages as identities of their language."""
    pages = table(spark, sf_dir, "pages")
    cut = lambda pattern: F.regexp_extract("html", pattern, 1)
    return pages.select(F.col("page_id").alias("identity_id"), F.lower(cut("<title>([^<]*)</title>")).alias("name"), cut('<html lang="([^"]*)"').alias("entity_type")).filter("name <> ''")


def misspelt_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of pages, and each again without its first letter and with another at its end."""
    rows = page_identities(spark, sf_dir)
    other = F.concat(F.substr(F.col("name"), F.lit(2)), F.lit("x"))
    both = F.array(F.struct((F.col("identity_id") * 2).alias("identity_id"), "name"), F.struct((F.col("identity_id") * 2 + 1).alias("identity_id"), other.alias("name")))
    return rows.select("entity_type", F.explode(both).alias("r")).select("r.identity_id", "r.name", "entity_type")


def fuzzy_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of pages that may mean the same, at 0.8; no SQL has the ratio, so it is tested by brute force."""
    return entity_suggestions(misspelt_identities(spark, sf_dir))


def name_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.members(page_identities(spark, sf_dir))


NAME_MEMBERS_SQL = """WITH i AS (SELECT page_id AS identity_id, lower(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS name, regexp_extract(html, '<html lang="([^"]*)"', 1) AS kind FROM pages)
SELECT identity_id, min(identity_id) OVER (PARTITION BY kind, name) AS representative FROM i WHERE name <> ''"""


def entity_suggestions(identities: DataFrame) -> DataFrame:
    """Suggestions with their triage, best first. They are written once, as an order by ranges reads its rows twice."""
    found = store.staged(similar.suggestions(identities, 0.8), "suggestions").withColumn("triage", entity.triage(F.col("score")))
    return found.select("left_id", "right_id", F.round("score", 6).alias("score"), "triage").orderBy(F.desc("score"), "left_id", "right_id")


def code_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes within texts: every third text holds a valid one, every other a spoilt one."""
    n = F.col("s_suppkey")
    body = F.concat(F.lit("91"), F.lpad((n * 7919 % 10**8).cast("string"), 8, "0"), F.lpad((n * 104729 % 10**7).cast("string"), 7, "0"))
    value = lambda i: F.substr(body, F.lit(i + 1), F.lit(1)).cast("int") * (3**i % 31)
    check = F.substr(F.lit(entity.CODE_LETTERS), (31 - sum((value(i) for i in range(1, 17)), value(0)) % 31) % 31 + 1, F.lit(1))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", body.alias("body"), F.when(n % 3 == 0, check).otherwise("0").alias("last"), check.alias("check"))
    found = entity.codes_in(F.concat(F.lit("id "), F.lower("body"), F.lower("last"), F.lit(" end")))
    return rows.select("s_suppkey", F.array_join(found, ",").alias("codes"))


CODE_CHECKS_SQL = """WITH b AS (SELECT s_suppkey, '91' || lpad((s_suppkey * 7919 % 100000000)::VARCHAR, 8, '0') || lpad((s_suppkey * 104729 % 10000000)::VARCHAR, 7, '0') AS body FROM supplier),
c AS (SELECT s_suppkey, body, substr('0123456789ABCDEFGHJKLMNPQRTUWXY', ((31 - list_sum(list_transform(range(17), lambda i: substr(body, i + 1, 1)::INTEGER * [1, 3, 9, 27, 19, 26, 16, 17, 20, 29, 25, 13, 8, 24, 10, 30, 28][i + 1])) % 31) % 31 + 1)::BIGINT, 1) AS k FROM b)
SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN body || k WHEN k = '0' THEN body || '0' ELSE '' END AS codes FROM c"""

QUERIES = {
    "generated_tree": (generated_tree, GENERATED_SQL),
    "generated_links": (generated_links, GENERATED_LINKS_SQL),
    "desired_chunks": (desired_chunks, DESIRED_SQL),
    "node_entities": (node_entities, NODE_ENTITIES_SQL),
    "route_hotspots": (route_hotspots, ROUTE_HOTSPOTS_SQL),
    "cluster_hotspots": (cluster_hotspots, CLUSTER_HOTSPOTS_SQL),
    "child_scores": (child_scores, CHILD_SCORES_SQL),
    "hotspot_traversal": (hotspot_traversal, TRAVERSAL_SQL),
    "subtree_statistics": (subtree_statistics, SUBTREE_SQL),
    "parent_roll_up": (parent_roll_up, PARENT_ROLL_UP_SQL),
    "mapped_entities": (mapped_entities, MAPPED_ENTITIES_SQL),
    "mapped_relations": (mapped_relations, MAPPED_RELATIONS_SQL),
    "canonical_labels": (canonical_labels, CANONICAL_SQL),
    "graph_ingest": (graph_ingest, GRAPH_INGEST_SQL),
    "proposal_checks": (proposal_checks, PROPOSALS_SQL),
    "applied_proposals": (applied_proposals, APPLIED_SQL),
    "bundle_triples": (bundle_triples, TRIPLES_SQL),
    "admitted_facts": (admitted_facts, ADMITTED_SQL),
    "schema_checks": (schema_checks, SCHEMA_CHECKS_SQL),
    "adjudications": (adjudications, ADJUDICATIONS_SQL),
    "tombstones": (tombstones, TOMBSTONES_SQL),
    "page_nodes": (page_nodes, PAGE_NODES_SQL),
    "hits_to_nodes": (hits_to_nodes, HITS_TO_NODES_SQL),
    "ranked_evidence": (ranked_evidence, RANKED_EVIDENCE_SQL),
    "dangling_relations": (dangling_relations, DANGLING_SQL),
    "fuzzy_suggestions": (fuzzy_suggestions, None),
    "name_members": (name_members, NAME_MEMBERS_SQL),
    "code_checks": (code_checks, CODE_CHECKS_SQL),
}
