"""Queries of page sources, entities, trees with text and the unified search, with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import distribution, entity, fuse, hotspots, retrieve, tree
from ..sources import bundle, pages
from .model import HIERARCHY_SQL, SPANS_SQL, hierarchy, spans, table
from .retrieval import KEYWORD_SQL


def page_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.page_spans(table(spark, sf_dir, "pages")).groupBy("page_id").agg(F.count(F.lit(1)).alias("paragraphs"), F.sum(F.length("raw_text")).alias("chars"), F.max("heading").alias("heading"))


_ENTITIES = "replace(replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')"
_PLAIN = lambda c: "trim(regexp_replace(" + _ENTITIES.format(f"regexp_replace({c}, '<[^>]*>', ' ', 'g')") + r", '\s+', ' ', 'g'))"
PAGE_SPANS_SQL = rf"""WITH b AS (SELECT page_id, regexp_replace(html, '(?s)<script\b.*?</script>|<style\b.*?</style>|<nav\b.*?</nav>|<footer\b.*?</footer>|<head\b.*?</head>|<!--.*?-->|<div class="ad">.*?</div>', ' ', 'g') AS body FROM pages),
p AS (SELECT page_id, {_PLAIN("regexp_extract(body, '(?s)<h1[^>]*>(.*?)</h1>', 1)")} AS heading, unnest(regexp_split_to_array(body, '<p\b[^>]*>')[2:]) AS part FROM b),
t AS (SELECT page_id, heading, {_PLAIN("regexp_replace(part, '(?s)(</p>|</article>|</body>).*$', '')")} AS raw_text FROM p)
SELECT page_id, count(*) AS paragraphs, sum(length(raw_text))::BIGINT AS chars, max(heading) AS heading FROM t WHERE raw_text <> '' GROUP BY 1"""


def front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as bundle files and parsed again."""
    docs = table(spark, sf_dir, "documents")
    files = docs.select("doc_id", F.concat(F.lit("---\ntype: concept\ntitle: \""), "source", F.lit("\"\nlang: "), "lang", F.lit("\n---\n# "), "source", F.lit("\n\n"), F.replace("text", F.lit("\n"), F.lit("\n\n"))).alias("value"))
    parsed = bundle.split_front(files, "value")
    fields = bundle.front_fields(F.col("front"))
    counted = bundle.paragraphs(parsed, "doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("paragraphs"), F.max("heading").alias("heading"))
    return parsed.select("doc_id", fields["type"].alias("type"), fields["title"].alias("title"), fields["lang"].alias("lang"), "error").join(counted, "doc_id")


FRONT_MATTER_SQL = """SELECT doc_id, 'concept' AS type, source AS title, lang, NULL::VARCHAR AS error, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''))::BIGINT AS paragraphs, source AS heading FROM documents WHERE trim(text) <> ''"""


def serialized_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = spans(table(spark, sf_dir, "documents")).withColumnRenamed("raw_text", "text")
    return bundle.serialized(nodes, "doc_id").select("doc_id", F.sha2("body", 256).alias("body_sha256"), F.length("body").alias("chars"))


SERIALIZED_SQL = f"""WITH {SPANS_SQL}, b AS (SELECT doc_id, '## ' || max(split_part(heading_path, ' > ', 2)) || chr(10) || chr(10) || string_agg(raw_text, chr(10) || chr(10) ORDER BY ordinal) || chr(10) AS body FROM spans GROUP BY 1)
SELECT doc_id, sha256(body) AS body_sha256, length(body)::INTEGER AS chars FROM b"""


def coref_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' orders of equal date and priority as mentions of one thing."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey") % 50, "o_orderpriority", "o_orderstatus", "o_orderkey").toDF("doc_id", "mention", "type", "mention_id")
    out = entity.coreference(rows, ["doc_id", "mention", "type"], "mention_id")
    return out.groupBy("doc_id", "mention", "type").agg(F.max("n").alias("n"), F.min("mention_id").alias("first_member"), F.max("mention_id").alias("last_member"))


COREF_SQL = "SELECT o_custkey % 50 AS doc_id, o_orderpriority AS mention, o_orderstatus AS type, count(*) AS n, min(o_orderkey) AS first_member, max(o_orderkey) AS last_member FROM orders GROUP BY 1, 2, 3 HAVING count(*) >= 2"


def mention_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("occurrence"), F.col("l_linenumber").alias("mention_id"), F.col("l_discount").alias("confidence"))
    return entity.winners(rows, ["occurrence"])


WINNERS_SQL = "SELECT l_orderkey AS occurrence, l_linenumber AS mention_id, l_discount AS confidence FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, l_linenumber) = 1"


def merge_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as identities: some have a code, names are shared, types differ."""
    n = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(n.alias("identity_id"), (F.col("s_nationkey") % 5).alias("entity_type"), F.when(n % 3 == 0, (n % 40).cast("string")).alias("code"), F.concat(F.lit("name"), n % 50).alias("name"))
    return entity.merge_links(rows)


MERGE_PLAN_SQL = """WITH r AS (SELECT s_suppkey AS id, s_nationkey % 5 AS t, CASE WHEN s_suppkey % 3 = 0 THEN (s_suppkey % 40)::VARCHAR END AS code, 'name' || s_suppkey % 50 AS name FROM supplier),
c AS (SELECT min(id) AS id, code FROM r WHERE code IS NOT NULL GROUP BY 2), m AS (SELECT min(id) AS id, name FROM r GROUP BY 2),
p AS (SELECT c.id AS a, r.id AS b FROM r JOIN c USING (code) UNION ALL SELECT m.id, r.id FROM r JOIN m USING (name) WHERE r.code IS NULL)
SELECT a AS left_id, b AS right_id, CASE WHEN x.t <> y.t THEN 'veto_type' WHEN x.code <> y.code THEN 'veto_code' WHEN x.code = y.code THEN 'merge_code' WHEN x.name = y.name THEN 'merge_name' ELSE 'deferred' END AS decision
FROM p JOIN r x ON a = x.id JOIN r y ON b = y.id WHERE a <> b"""


def dictionary_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All places of a few names in documents."""
    names = spark.createDataFrame([("the", "article"), ("que", "article"), ("zzz", "none")], "name string, entity_type string")
    return entity.dictionary_candidates(table(spark, sf_dir, "documents"), names, "doc_id", "text")


DICTIONARY_SQL = """WITH p AS (SELECT doc_id, unnest(x) AS t, unnest(range(len(x))) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+') AS x FROM documents)),
q AS (SELECT doc_id, lower(t) AS name, coalesce(sum(length(t)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS start FROM p)
SELECT doc_id, name, 'article' AS entity_type, start FROM q WHERE name IN ('the', 'que')"""


def tree_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the root to the place of best balance, while it gets better."""
    customer, nodes = table(spark, sf_dir, "customer"), hierarchy(spark, sf_dir)
    nation = nodes.filter("level_no = 2").select("node_id", F.col("parent_node_id").alias("up"))
    leaf = customer.groupBy(F.concat(F.lit("n"), "c_nationkey").alias("node_id")).agg(F.avg("c_acctbal").alias("score"))
    middle = leaf.join(nation, "node_id").groupBy(F.col("up").alias("node_id")).agg(F.avg("score").alias("score"))
    root = middle.agg(F.avg("score").alias("score")).select(F.lit("world").alias("node_id"), "score")
    return tree.descend(nodes, leaf.unionByName(middle).unionByName(root), ["world"])


TREE_DESCENT_SQL = f"""WITH RECURSIVE {HIERARCHY_SQL}, leaf AS (SELECT 'n' || c_nationkey AS node_id, avg(c_acctbal) AS score FROM customer GROUP BY 1),
middle AS (SELECT parent_node_id AS node_id, avg(score) AS score FROM leaf JOIN tree USING (node_id) GROUP BY 1), scores AS (SELECT * FROM leaf UNION ALL SELECT * FROM middle UNION ALL SELECT 'world', avg(score) FROM middle),
best AS (SELECT parent_node_id AS p, arg_max(node_id, score) AS child, max(score) AS cs FROM tree JOIN scores USING (node_id) WHERE parent_node_id IS NOT NULL GROUP BY 1),
walk AS (SELECT 'world' AS node_id, 0 AS step, (SELECT score FROM scores WHERE node_id = 'world') AS score UNION ALL SELECT child, step + 1, cs FROM walk JOIN best ON p = node_id WHERE cs - score > 0)
SELECT 'world' AS start, w.node_id, step, CASE WHEN cs - score > 0 THEN 'drill' WHEN child IS NULL THEN 'leaf' ELSE 'keep' END AS action FROM walk w LEFT JOIN best ON p = w.node_id"""


def child_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.avg("c_acctbal").alias("m")), "n_nationkey", "left")
    return tree.coverage(rows, "n_regionkey", F.col("m") > 4500).withColumn("ratio", F.round("ratio", 6))


COVERAGE_SQL = """SELECT n_regionkey, count(*) AS children, sum(CASE WHEN m > 4500 THEN 1 ELSE 0 END)::BIGINT AS hot, round(avg(CASE WHEN m > 4500 THEN 1 ELSE 0 END), 6) AS ratio
FROM nation LEFT JOIN (SELECT c_nationkey, avg(c_acctbal) AS m FROM customer GROUP BY 1) ON c_nationkey = n_nationkey GROUP BY 1"""


def evidence_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of each document: its spans, clipped at 200 letters."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit("none").alias("fallback"))
    return tree.evidence_text(docs, spans(table(spark, sf_dir, "documents")), "doc_id", "fallback", 200).select("doc_id", "evidence")


EVIDENCE_TEXTS_SQL = f"""WITH {SPANS_SQL}, w AS (SELECT doc_id, trim(regexp_replace(string_agg(raw_text, ' ' ORDER BY ordinal), '\\s+', ' ', 'g')) AS t FROM spans GROUP BY 1)
SELECT doc_id, coalesce(CASE WHEN length(t) > 200 THEN substr(t, 1, 199) || '…' ELSE t END, 'none') AS evidence FROM documents LEFT JOIN w USING (doc_id)"""


def traced_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines traced to orders and customers: the three-way lookup of chunk, version and document."""
    chunks = table(spark, sf_dir, "lineitem").filter("l_quantity = 50").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("chunk_id"), F.col("l_orderkey").alias("version_id"))
    versions = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("version_id"), F.col("o_custkey").alias("doc_id"), F.col("o_orderstatus").alias("status"))
    documents = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_name").alias("title"))
    return tree.traced(chunks, versions, documents)


TRACED_SQL = "SELECT l_orderkey || '-' || l_linenumber AS chunk_id, l_orderkey AS version_id, o_custkey AS doc_id, o_orderstatus AS status, c_name AS title FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_quantity = 50"


def heading_stacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as lines of an outline: three kinds of event are headings of three levels."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.concat("event_type", F.lit("-"), "event_id").alias("title"), (F.col("event_id") % 7).alias("kind"))
    level = F.when(F.col("kind") < 3, F.col("kind") + 1)
    return tree.heading_stack(rows, "user_id", "event_id", level, 3).select("user_id", "event_id", "path")


HEADING_STACKS_SQL = """WITH e AS (SELECT user_id, event_id, event_type || '-' || event_id AS title, event_id % 7 + 1 AS l FROM events),
h AS (SELECT user_id, event_id, max(CASE WHEN l = 1 THEN event_id END) OVER w AS a, max(CASE WHEN l = 2 THEN event_id END) OVER w AS b, max(CASE WHEN l = 3 THEN event_id END) OVER w AS c FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT h.user_id, h.event_id, array_to_string(list_filter([x.title, y.title, z.title], lambda t: t IS NOT NULL), ' > ') AS path FROM h LEFT JOIN e x ON x.event_id = a LEFT JOIN e y ON y.event_id = b AND b > coalesce(a, -1) LEFT JOIN e z ON z.event_id = c AND c > greatest(coalesce(a, -1), coalesce(b, -1))"""


def json_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers in three wrappings, parsed."""
    raw = F.concat(F.lit('{"verdict": "'), "event_type", F.lit('", "confidence": '), (F.col("event_id") % 100), F.lit("}"))
    wrapped = F.when(F.col("event_id") % 4 == 0, raw).when(F.col("event_id") % 4 == 1, F.concat(F.lit("Sure:\n```json\n"), raw, F.lit("\n```\n"))).when(F.col("event_id") % 4 == 2, F.concat(F.lit("I think "), raw, F.lit(" it is."))).otherwise("no answer")
    parsed = text.json_verdict(wrapped, "verdict string, confidence int")
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(parsed["verdict"], F.lit("uncertain")).alias("verdict"), parsed["confidence"].alias("c")).select("event_id", "verdict", F.coalesce("c", F.lit(-1)).alias("confidence"))


JSON_VERDICTS_SQL = "SELECT event_id, CASE WHEN event_id % 4 = 3 THEN 'uncertain' ELSE event_type END AS verdict, CASE WHEN event_id % 4 = 3 THEN -1 ELSE event_id % 100 END::INTEGER AS confidence FROM events"


def summary_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of documents as summaries of nodes."""
    nodes = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("node_id"), F.lit(1).alias("level_no"), F.col("text").alias("summary_text"))
    return retrieve.tree_fallback(nodes, "the and ing of that", 25).select("node_id", "score")


SUMMARY_SQL = """WITH s AS (SELECT doc_id AS node_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS w FROM documents),
j AS (SELECT node_id, len(list_intersect(w, ['the','and','ing','of','that'])) AS n, len(w) AS m FROM s)
SELECT node_id, round(least(1.0, CASE WHEN n > 1 THEN 1.2 ELSE 1.0 END * n / (m + 5 - n)), 6)::DOUBLE AS score FROM j WHERE n > 0 ORDER BY score DESC, node_id LIMIT 25"""


def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword hits and word-overlap hits over spans, fused by span."""
    rows = spans(table(spark, sf_dir, "documents")).withColumn("key", F.concat_ws("#", "doc_id", "ordinal"))
    from pyspark.sql import Window

    def ranked(df: DataFrame, path: str) -> DataFrame:
        return df.select(F.lit(path).alias("path"), F.row_number().over(Window.partitionBy(F.lit(path)).orderBy(F.desc("score"), "key")).alias("ordinal"), "key", "score")  # at most 50 rows

    query = "ing that the"
    keyword = ranked(retrieve.keyword_search(rows, query, 50), "keyword")
    words = rows.withColumn("score", F.round(text.term_jaccard(F.col("raw_text"), F.lit(query)), 6)).filter("score > 0").orderBy(F.desc("score"), "key").limit(50)
    return fuse.fuse(keyword.unionByName(ranked(words, "tree")), key="key", limit=20)


_TOKENS = "list_distinct(list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''))"
HYBRID_SQL = f"""WITH {SPANS_SQL}, k AS ({KEYWORD_SQL}),
t AS (SELECT doc_id, ordinal, {_TOKENS.format("raw_text")} AS a, ['ing', 'that', 'the'] AS b FROM spans),
j AS (SELECT doc_id || '#' || ordinal AS key, round(least(1, CASE WHEN n > 1 THEN 1.2 ELSE 1 END::DOUBLE * n / (len(a) + 3 - n)), 6) AS score FROM (SELECT *, len(list_intersect(a, b))::DOUBLE AS n FROM t)),
hits AS (SELECT 'keyword' AS path, doc_id || '#' || ordinal AS key, score FROM k UNION ALL SELECT 'tree', key, score FROM (FROM j WHERE score > 0 ORDER BY score DESC, key LIMIT 50)),
n AS (SELECT *, CASE WHEN count(*) OVER p = 1 THEN 1.0 WHEN min(score) OVER p = max(score) OVER p THEN score ELSE round((score - min(score) OVER p) / (max(score) OVER p - min(score) OVER p), 10) END AS norm FROM hits WINDOW p AS (PARTITION BY path)),
r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY greatest(0, least(1, norm)) DESC, score DESC, key) AS rank FROM n)
SELECT key, round(sum(1.0::DOUBLE / (60 + rank)) * (1 + 0.1 * (count(*) - 1)), 10) AS fused, round(max(score), 6) AS score, array_to_string(list_sort(list(path)), ',') AS source_paths
FROM r GROUP BY 1 ORDER BY fused DESC, score DESC, key LIMIT 20"""


def hit_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where keyword hits lie: roll-up by language and source."""
    found = retrieve.keyword_search(spans(table(spark, sf_dir, "documents")), "ing that the", 50)
    return distribution.roll_up(found.withColumnRenamed("raw_text", "text")).select("node", F.round("total", 6).alias("total"), "hits")


DISTRIBUTION_SQL = f"""WITH k AS ({KEYWORD_SQL}), p AS (SELECT score, unnest(list_transform(range(1, len(h) + 1), lambda i: array_to_string(h[1:i], ' > '))) AS node FROM (SELECT score, string_split(heading_path, ' > ') AS h FROM k))
SELECT node, round(sum(score), 6) AS total, count(*) AS hits FROM p GROUP BY 1"""


QUERIES = {
    "page_spans": (page_spans, PAGE_SPANS_SQL),
    "front_matter": (front_matter, FRONT_MATTER_SQL),
    "serialized_documents": (serialized_documents, SERIALIZED_SQL),
    "coref_clusters": (coref_clusters, COREF_SQL),
    "mention_winners": (mention_winners, WINNERS_SQL),
    "merge_plan": (merge_plan, MERGE_PLAN_SQL),
    "dictionary_hits": (dictionary_hits, DICTIONARY_SQL),
    "tree_descent": (tree_descent, TREE_DESCENT_SQL),
    "child_coverage": (child_coverage, COVERAGE_SQL),
    "evidence_texts": (evidence_texts, EVIDENCE_TEXTS_SQL),
    "traced_lines": (traced_lines, TRACED_SQL),
    "heading_stacks": (heading_stacks, HEADING_STACKS_SQL),
    "json_verdicts": (json_verdicts, JSON_VERDICTS_SQL),
    "summary_overlap": (summary_search, SUMMARY_SQL),
    "hybrid_search": (hybrid_search, HYBRID_SQL),
    "hit_distribution": (hit_distribution, DISTRIBUTION_SQL),
}


def hybrid_hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each market segment, places by mean balance (vectors) and by their orders' priorities (terms)."""
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    node = F.concat(F.lit("n"), "c_nationkey")
    vector = customer.groupBy(F.col("c_mktsegment").alias("query_id"), node.alias("node_id")).agg(F.avg("c_acctbal").alias("similarity"))
    words = customer.join(orders, F.col("c_custkey") == F.col("o_custkey")).filter("o_totalprice > 300000")
    keyword = words.groupBy(F.col("c_mktsegment").alias("query_id"), node.alias("node_id"), F.col("o_orderpriority").alias("term")).agg(F.count(F.lit(1)).cast("double").alias("score"))
    return hotspots.hybrid(vector, keyword, hierarchy(spark, sf_dir)).withColumn("score", F.round("score", 6))


HYBRID_HOTSPOTS_SQL = f"""WITH {HIERARCHY_SQL},
vec AS (SELECT c_mktsegment AS q, 'n' || c_nationkey AS node_id, avg(c_acctbal) AS s FROM customer GROUP BY 1, 2), v AS (SELECT q, node_id, coalesce((s - min(s) OVER p) / nullif(max(s) OVER p - min(s) OVER p, 0), 0.5) AS v FROM vec WINDOW p AS (PARTITION BY q)),
hit AS (SELECT c_mktsegment AS q, 'n' || c_nationkey AS node_id, o_orderpriority AS term, count(*)::DOUBLE AS s FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 300000 GROUP BY 1, 2, 3),
al AS (SELECT q, count(DISTINCT term) AS a FROM hit GROUP BY 1),
k AS (SELECT q, node_id, greatest(max(s), count(DISTINCT term)::DOUBLE / any_value(a)) AS k, count(DISTINCT term) AS t, any_value(a) > 1 AND count(DISTINCT term) = any_value(a) AS exact FROM (SELECT q, node_id, term, coalesce((s - min(s) OVER p) / nullif(max(s) OVER p - min(s) OVER p, 0), 0.5) AS s FROM hit WINDOW p AS (PARTITION BY q)) JOIN al USING (q) GROUP BY 1, 2),
b AS (SELECT q, node_id, v, coalesce(k, 0) AS k, coalesce(exact, false) AS exact, coalesce(v >= 0.5, false) AND coalesce(t, 0) >= 1 AS hot FROM v FULL JOIN k USING (q, node_id)),
sz AS (SELECT parent_node_id AS p, count(*) AS c FROM tree WHERE parent_node_id IS NOT NULL GROUP BY 1),
par AS (SELECT q, p AS node_id, n / c * 0.5 + av * 0.3 + least(n / 5.0::DOUBLE, 1) * 0.2 AS score, 'cluster_coverage' AS reason FROM (SELECT q, parent_node_id AS p, count(*)::DOUBLE AS n, avg(v) AS av FROM b JOIN tree USING (node_id) WHERE hot AND parent_node_id IS NOT NULL GROUP BY 1, 2) JOIN sz USING (p)
 WHERE c <= 8 AND n >= 2 AND n / c >= 0.5 AND p IN (SELECT node_id FROM tree WHERE parent_node_id IS NOT NULL)),
leaf AS (SELECT q, node_id, CASE WHEN exact THEN coalesce(v, 0) * 0.15 + k * 0.85 ELSE coalesce(v, 0) * 0.5 + k * 0.5 END AS score, 'leaf_fallback' AS reason FROM b WHERE (exact OR hot) AND q NOT IN (SELECT q FROM par) AND node_id IN (SELECT node_id FROM tree WHERE parent_node_id IS NOT NULL)),
near AS (SELECT q, arg_max(node_id, v) AS node_id, max(v) AS score, 'leaf_fallback' AS reason FROM b WHERE v IS NOT NULL AND q NOT IN (SELECT q FROM par UNION ALL SELECT q FROM leaf) GROUP BY 1)
SELECT q AS query_id, node_id, round(score, 6) AS score, reason, row_number() OVER (PARTITION BY q ORDER BY score DESC, node_id)::INTEGER AS place FROM (SELECT * FROM par UNION ALL SELECT * FROM leaf UNION ALL SELECT * FROM near) QUALIFY place <= 3"""

QUERIES["hybrid_hotspots"] = (hybrid_hotspots, HYBRID_HOTSPOTS_SQL)
