"""Queries of retrieval, fusion and distribution, with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text, vectors
from ..operators import distribution, fuse, retrieve
from .model import SPANS_SQL, spans, table, with_span_id

QUERY = "ing that the"

TRIGRAM_MACRO_SQL = """
grams AS (SELECT doc_id, ordinal, list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower(raw_text), '[^\\p{L}\\p{N}]+'), lambda x: x <> ''),
           lambda w: list_transform(range(1, length('  ' || w || ' ') - 1), lambda i: substr('  ' || w || ' ', i, 3))))) AS g FROM hits)"""


def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieve.keyword_search(spans(table(spark, sf_dir, "documents")), QUERY, 50)
    return found.select("doc_id", "ordinal", "start_offset", "heading_path", "raw_text", "score")


KEYWORD_SQL = f"""WITH {SPANS_SQL},
hits AS (SELECT * FROM spans WHERE raw_text ILIKE '%{QUERY}%' OR
  (list_contains(regexp_split_to_array(lower(raw_text), '[^\\p{{L}}\\p{{N}}]+'), 'ing') AND list_contains(regexp_split_to_array(lower(raw_text), '[^\\p{{L}}\\p{{N}}]+'), 'that')
   AND list_contains(regexp_split_to_array(lower(raw_text), '[^\\p{{L}}\\p{{N}}]+'), 'the'))),
{TRIGRAM_MACRO_SQL.strip()},
q AS (SELECT ['  i',' in','ing','ng ','  t',' th','tha','hat','at ','the','he '] AS g)
SELECT h.doc_id, h.ordinal::INTEGER AS ordinal, h.start_offset, h.heading_path, h.raw_text,
  round(greatest(CASE WHEN h.raw_text ILIKE '%{QUERY}%' THEN 1.0 ELSE 0.0 END::DOUBLE,
    len(list_intersect(grams.g, q.g))::DOUBLE / (len(grams.g) + len(q.g) - len(list_intersect(grams.g, q.g)))), 6) AS score
FROM hits h JOIN grams USING (doc_id, ordinal), q ORDER BY score DESC, start_offset, doc_id, ordinal LIMIT 50"""


def span_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_span_id(spans(table(spark, sf_dir, "documents"))).select("span_id", "doc_id", "version_id", "ordinal", "start_offset", "end_offset", "heading_path", F.sha2("raw_text", 256).alias("text_sha256"))


SPAN_TABLE_SQL = f"""WITH {SPANS_SQL},
h AS (SELECT *, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(doc_id || '|' || version_id || '|None|' || replace(heading_path, ' > ', '/') || '|' || start_offset || '|' || raw_text)) AS s FROM spans)
SELECT substr(s,1,8) || '-' || substr(s,9,4) || '-5' || substr(s,14,3) || '-' || substr('89ab', ('0x' || substr(s,17,1))::INTEGER % 4 + 1, 1) || substr(s,18,3) || '-' || substr(s,21,12) AS span_id,
  doc_id, version_id, ordinal::INTEGER AS ordinal, start_offset, end_offset, heading_path, sha256(raw_text) AS text_sha256 FROM h"""


def vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest vectors to vector 0, by its own values."""
    rows = table(spark, sf_dir, "embeddings")
    query = rows.filter("vec_id = 0").select("embedding").first()  # the query: one vector
    return retrieve.nearest(rows, list(query[0]) if query else [], 10).select("vec_id", "label", "score")


VECTOR_SQL = """SELECT e.vec_id, e.label, round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) /
  (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))), 6) AS score
FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY score DESC, vec_id LIMIT 10"""


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three ranked lists over the parts of orders' lines: by quantity, by price, by discount; as
    retrieval paths with part types as merge keys."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("keyword"), F.round(F.avg("l_extendedprice"), 4).alias("vector"), F.max("l_discount").alias("tree"))
    parts = lines.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    long = parts.select("p_type", "l_partkey", F.expr("stack(3, 'keyword', keyword, 'vector', vector, 'tree', tree) AS (path, score)"))
    placed = fuse.ranked(long, "path", [F.desc("score"), F.asc("l_partkey")])
    return placed.withColumnRenamed("rank", "ordinal").select("path", "ordinal", F.col("p_type").alias("text"), "score")


HITS_SQL = """parts AS (SELECT l_partkey, sum(l_quantity) AS keyword, round(avg(l_extendedprice), 4) AS vector, max(l_discount) AS tree FROM lineitem GROUP BY 1),
long AS (SELECT p_type AS text, l_partkey, path, score FROM (SELECT l_partkey, 'keyword' AS path, keyword AS score FROM parts UNION ALL SELECT l_partkey, 'vector', vector FROM parts UNION ALL SELECT l_partkey, 'tree', tree FROM parts) JOIN part ON l_partkey = p_partkey),
hits AS (SELECT path, ordinal, text, score FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, l_partkey) AS ordinal FROM long))"""


def fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuse.fuse(hits(spark, sf_dir))


FUSED_SQL = f"""WITH {HITS_SQL},
n AS (SELECT *, CASE WHEN count(*) OVER p = 1 THEN 1.0 WHEN min(score) OVER p = max(score) OVER p THEN score ELSE round((score - min(score) OVER p) / (max(score) OVER p - min(score) OVER p), 10) END AS norm FROM hits WINDOW p AS (PARTITION BY path)),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path, text ORDER BY score DESC, ordinal) AS i FROM n) WHERE i = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY greatest(0, least(1, norm)) DESC, ordinal) AS rank FROM b)
SELECT text, round(sum(1.0::DOUBLE / (60 + rank)) * (1 + 0.1 * (count(*) - 1)), 10) AS fused, round(max(score), 6) AS score, array_to_string(list_sort(list_distinct(list(path))), ',') AS source_paths
FROM r GROUP BY text"""


def title_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hits(spark, sf_dir).withColumnRenamed("text", "title").withColumn("ordinal", F.col("ordinal") - 1)
    return fuse.fuse_titles(rows.filter("path = 'keyword'"), rows.filter("path = 'vector'"), (0.6, 0.4))


TITLE_FUSION_SQL = f"""WITH {HITS_SQL},
a AS (SELECT text AS title, min(ordinal - 1) AS a FROM hits WHERE path = 'keyword' GROUP BY 1), b AS (SELECT text AS title, min(ordinal - 1) AS b FROM hits WHERE path = 'vector' GROUP BY 1)
SELECT title, round(coalesce(0.6::DOUBLE / (60 + a), 0) + coalesce(0.4::DOUBLE / (60 + b), 0), 10) AS score FROM a FULL JOIN b USING (title)"""


def hit_roll_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' balances as hits on region and nation."""
    return distribution.roll_up(_customer_hits(spark, sf_dir)).select("node", F.round("total", 4).alias("total"), "hits")


def _customer_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, nation, region = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    places = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.concat_ws(" > ", F.lit("world"), "r_name", "n_name").alias("heading_path"))
    return customer.join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey")).select("heading_path", F.col("c_name").alias("text"), F.col("c_acctbal").alias("score"))  # 25 nations at any scale


CUSTOMER_HITS_SQL = "hits AS (SELECT 'world > ' || r_name || ' > ' || n_name AS heading_path, c_acctbal AS score, r_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
ROLLED_SQL = f"""{CUSTOMER_HITS_SQL},
rolled AS (SELECT node, sum(score) AS total, count(*) AS hits FROM (SELECT 'world' AS node, score FROM hits UNION ALL SELECT 'world > ' || r_name, score FROM hits UNION ALL SELECT heading_path, score FROM hits) GROUP BY 1)"""
ROLL_UP_SQL = f"WITH {ROLLED_SQL} SELECT node, round(total, 4) AS total, hits FROM rolled"


def hit_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = distribution.spread(distribution.roll_up(_customer_hits(spark, sf_dir)))
    return out.withColumn("decision", distribution.decision()).select("nodes", F.round("cv", 6).alias("cv"), F.round("entropy", 6).alias("entropy"), F.round("max_entropy", 6).alias("max_entropy"), "decision")


SPREAD_SQL = f"""WITH {ROLLED_SQL},
s AS (SELECT count(*) AS nodes, stddev_samp(total) / avg(total) AS cv, -sum(CASE WHEN total > 0 THEN total / w * log2(total / w) END) AS entropy, log2(count(*)) AS max_entropy FROM rolled, (SELECT sum(total) AS w FROM rolled))
SELECT nodes, round(cv, 6) AS cv, round(entropy, 6) AS entropy, round(max_entropy, 6) AS max_entropy,
 CASE WHEN cv > 1 AND entropy < 0.5 THEN 'high_concentration' WHEN cv < 0.4 OR entropy > 0.8 * max_entropy THEN 'high_dispersion' ELSE 'moderate' END AS decision FROM s"""


def node_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = distribution.node_stats(table(spark, sf_dir, "embeddings"), "label")
    return out.withColumn("policy", distribution.branch_policy(2, 8.0, 5.6)).select("label", "support", F.round("dispersion", 6).alias("dispersion"), F.round("entropy", 6).alias("entropy"), F.round(F.element_at("centroid", 1), 6).alias("first_value"), "policy")


NODE_STATS_SQL = """WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings),
c AS (SELECT label, i, avg(x) AS m FROM x GROUP BY 1, 2),
d AS (SELECT vec_id, label, sqrt(sum((x - m) ** 2)) AS d FROM x JOIN c USING (label, i) GROUP BY 1, 2),
s AS (SELECT label, count(*) AS support, avg(d) AS dispersion, log2(sum(d)) - sum(CASE WHEN d > 0 THEN d * log2(d) END) / sum(d) AS entropy FROM d GROUP BY 1)
SELECT label, support, round(dispersion, 6) AS dispersion, round(entropy, 6) AS entropy, round(m, 6) AS first_value,
 CASE WHEN support < 2 THEN 'prune' WHEN dispersion > 8 AND entropy > 5.6 THEN 'drill_down' WHEN dispersion <= 8 AND entropy <= 5.6 THEN 'keep_parent' ELSE 'prune' END AS policy FROM s JOIN c USING (label) WHERE i = 0"""


def hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each market segment, places with the most balance, none within another."""
    customer = table(spark, sf_dir, "customer")
    rows = _customer_hits(spark, sf_dir).join(customer.select(F.col("c_name").alias("text"), "c_mktsegment"), "text")
    rolled = rows.select("c_mktsegment", F.explode(text.prefixes(F.col("heading_path"))).alias("heading_path"), "score").groupBy("c_mktsegment", "heading_path").agg(F.avg("score").alias("score"))
    pool = rolled.select("c_mktsegment", F.col("heading_path").alias("node_id"), "heading_path", F.round("score", 6).alias("score"))
    return distribution.greedy_hotspots(pool, "c_mktsegment", 3)


#: No place of a segment lies within one chosen before it: the rule is replayed over each segment's places, best first.
HOTSPOTS_SQL = """WITH RECURSIVE rows AS (SELECT c_mktsegment, unnest(['world', 'world > ' || r_name, 'world > ' || r_name || ' > ' || n_name]) AS p, c_acctbal AS s FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
g AS (SELECT c_mktsegment, p, round(avg(s), 6) AS s FROM rows GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY s DESC, p) AS n FROM g QUALIFY n <= 20),
f AS (SELECT DISTINCT c_mktsegment, 0::BIGINT AS n, []::VARCHAR[] AS kept FROM o
 UNION ALL SELECT f.c_mktsegment, o.n, CASE WHEN len(kept) < 3 AND len(list_filter(kept, lambda k: starts_with(k || ' > ', p || ' > ') OR starts_with(p || ' > ', k || ' > '))) = 0 THEN list_append(kept, p) ELSE kept END FROM f JOIN o ON o.c_mktsegment = f.c_mktsegment AND o.n = f.n + 1),
k AS (SELECT c_mktsegment, arg_max(kept, n) AS kept FROM f GROUP BY 1), u AS (SELECT c_mktsegment, unnest(kept) AS p, unnest(range(len(kept))) AS place FROM k)
SELECT c_mktsegment, place::INTEGER AS place, p AS node_id, p AS heading_path, s AS score FROM u JOIN g USING (c_mktsegment, p)"""


def query_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").filter("role = 'user'")
    parts = F.explode(F.split("text", r"[.?!]\s*"))  # every sentence of every question
    return rows.select("conv_id", "turn", parts.alias("query")).select("conv_id", "turn", text.query_kind(F.col("query")).alias("kind"), text.word_count(F.col("query")).alias("words"))


QUERY_ROUTER_SQL = """WITH q AS (SELECT conv_id, turn, unnest(regexp_split_to_array(text, '[.?!]\\s*')) AS query FROM conversations WHERE role = 'user'),
c AS (SELECT *, regexp_replace(query, '^\\s+|\\s+$', '', 'g') AS clean, len(list_filter(regexp_split_to_array(query, '\\s+'), lambda x: x <> '')) AS words FROM q)
SELECT conv_id, turn, CASE WHEN clean = '' THEN 'vector' WHEN regexp_matches(lower(clean), 'section structure|document outline|table of contents|chapter hierarchy') THEN 'tree' WHEN words >= 6 THEN 'vector'
 WHEN words <= 1 AND regexp_matches(clean, '([\\x{4E00}-\\x{9FFF}\\x{3400}-\\x{4DBF}].*){6}') THEN 'vector' WHEN regexp_matches(clean, '\\p{Nd}') THEN 'keyword' WHEN regexp_matches(clean, '[-/_.]') THEN 'keyword' WHEN length(clean) <= 16 THEN 'keyword' ELSE 'vector' END AS kind,
 words::INTEGER AS words FROM c"""


def relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judgements as relevance: hit rate and quality level by language."""
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    out = joined.groupBy("lang").agg(F.count(F.lit(1)).alias("judged"), F.round(F.avg("quality"), 6).alias("hit_rate"), F.round(F.avg(1 - F.col("toxic")), 6).alias("top1"))
    return out.withColumn("level", F.when((F.col("hit_rate") >= 0.8) & (F.col("top1") >= 0.9), "pass").when(F.col("hit_rate") >= 0.5, "partial").otherwise("fail"))


RELEVANCE_SQL = """SELECT *, CASE WHEN hit_rate >= 0.8 AND top1 >= 0.9 THEN 'pass' WHEN hit_rate >= 0.5 THEN 'partial' ELSE 'fail' END AS level FROM
 (SELECT lang, count(*) AS judged, round(avg(quality), 6) AS hit_rate, round(avg(1 - toxic), 6) AS top1 FROM documents JOIN labels USING (doc_id) GROUP BY 1)"""


def chunk_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic embeddings of the benchmark's whole texts: the text, its letters and pairs, in 16 dimensions."""
    rows = table(spark, sf_dir, "benchmark").select("item_id", vectors.embedding_tokens(F.col("text")).alias("t"))
    vector = rows.select("item_id", F.size("t").alias("n"), vectors.hashed_embedding(F.col("t"), 16).alias("v"))
    return vector.select("item_id", "n", *(F.round(F.element_at("v", i + 1), 6).alias(f"v{i:02d}") for i in range(16)))


EMBEDDINGS_SQL = f"""WITH c AS (SELECT item_id, regexp_replace(lower(text), '\\s+', '', 'g') AS c FROM benchmark),
t AS (SELECT item_id, unnest([c] || list_transform(range(1, length(c) + 1), lambda i: substr(c, i, 1)) || list_transform(range(1, length(c)), lambda i: substr(c, i, 2))) AS t FROM c WHERE c <> ''),
b AS (SELECT item_id, i, sum(('0x' || substr(h, 2 * i + 1, 2))::INTEGER / 255.0::DOUBLE) AS x, count(*)::INTEGER AS n FROM (SELECT item_id, sha256(t) AS h, unnest(range(16)) AS i FROM t) GROUP BY 1, 2),
v AS (SELECT *, x / sqrt(sum(x * x) OVER (PARTITION BY item_id)) AS y FROM b)
SELECT item_id, n, {", ".join(f"round(max(CASE WHEN i = {i} THEN y END), 6) AS v{i:02d}" for i in range(16))} FROM v GROUP BY 1, 2"""


QUERIES = {
    "keyword_search": (keyword_search, KEYWORD_SQL),
    "span_table": (span_table, SPAN_TABLE_SQL),
    "vector_search": (vector_search, VECTOR_SQL),
    "fused_hits": (fused, FUSED_SQL),
    "title_fusion": (title_fusion, TITLE_FUSION_SQL),
    "hit_roll_up": (hit_roll_up, ROLL_UP_SQL),
    "hit_spread": (hit_spread, SPREAD_SQL),
    "node_statistics": (node_statistics, NODE_STATS_SQL),
    "hotspots": (hotspots, HOTSPOTS_SQL),
    "query_router": (query_router, QUERY_ROUTER_SQL),
    "relevance_levels": (relevance, RELEVANCE_SQL),
    "hashed_embeddings": (chunk_embeddings, EMBEDDINGS_SQL),
}
