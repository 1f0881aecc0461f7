"""Queries of ways through trees, the expansion loop, reading by keywords, raw pairs and the ingest of a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ident
from ..operators import chunks, graph, hits, ingest, navigate, reconcile, retrieve
from ..sources import pairs, store, workspace
from .building import uuid5_sql
from .model import SPANS_SQL, line_rows, spans, table
from .retrieval import KEYWORD_SQL, QUERY


def customer_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a tree of three children each; the first and the fifth are each other's parent, the second's is missing."""
    key = F.col("c_custkey").cast("bigint")
    return table(spark, sf_dir, "customer").select(key.alias("node_id"), F.when(key == 1, 5).otherwise(F.floor(key / 3)).alias("parent_node_id"))


CUSTOMER_TREE_SQL = "t AS (SELECT c_custkey::BIGINT AS node_id, CASE WHEN c_custkey = 1 THEN 5 ELSE c_custkey // 3 END::BIGINT AS p FROM customer)"


def span_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as spans of customers; some have a second link, some only that, some none."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("span_id"), F.col("o_custkey").cast("bigint").alias("c"))
    first = orders.filter("span_id % 7 <> 0 and span_id % 3 <> 0").select("span_id", F.col("c").alias("node_id"), F.lit(1).alias("ordinal_no"))
    second = orders.filter("span_id % 7 <> 0").select("span_id", (F.col("c") % 100 + 1).alias("node_id"), F.lit(2).alias("ordinal_no"))
    return navigate.span_provenance(orders, first.unionByName(second), customer_tree(spark, sf_dir))


SPAN_PROVENANCE_SQL = f"""WITH RECURSIVE {CUSTOMER_TREE_SQL},
c AS (SELECT node_id, 0 AS step, node_id AS ancestor_id, [node_id] AS seen FROM t
 UNION ALL SELECT c.node_id, c.step + 1, b.node_id, list_append(seen, b.node_id) FROM c JOIN t AS a ON a.node_id = c.ancestor_id JOIN t AS b ON b.node_id = a.p WHERE NOT list_contains(seen, b.node_id)),
l AS (SELECT o_orderkey AS span_id, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey % 100 + 1 ELSE o_custkey END AS node_id FROM orders WHERE o_orderkey % 7 <> 0)
SELECT span_id, c.node_id, step, ancestor_id FROM l JOIN c ON c.node_id = l.node_id"""


def node_relatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's parent and the number of its children and siblings."""
    tree = customer_tree(spark, sf_dir)
    count = lambda df, name: df.groupBy("node_id").agg(F.count(F.lit(1)).alias(name))
    joined = tree.select("node_id").join(navigate.parents(tree, tree), "node_id", "left").join(count(navigate.children(tree, tree), "children"), "node_id", "left").join(count(navigate.siblings(tree, tree), "siblings"), "node_id", "left")
    return joined.select("node_id", F.col("parent_node_id").alias("parent"), F.coalesce("children", F.lit(0)).alias("children"), F.coalesce("siblings", F.lit(0)).alias("siblings"))


NODE_RELATIVES_SQL = f"""WITH {CUSTOMER_TREE_SQL}, n AS (SELECT p, count(*) AS n FROM t GROUP BY 1)
SELECT t.node_id, u.node_id AS parent, coalesce(c.n, 0) AS children, s.n AS siblings FROM t LEFT JOIN t AS u ON u.node_id = t.p LEFT JOIN n AS c ON c.p = t.node_id LEFT JOIN n AS s ON s.p = t.p"""


def adjacent_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as nodes three pages apart, the fourth without a page: how many lie within five pages, and how far."""
    lines = table(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("node_id"), F.col("l_orderkey").alias("version_id"), F.when(F.col("l_linenumber") != 4, F.col("l_linenumber") * 3).cast("int").alias("page_start")).distinct()
    near = navigate.adjacent(lines, lines, 5, ["version_id"])
    return near.groupBy("node_id").agg(F.count(F.lit(1)).alias("nodes"), F.min("distance").alias("first"), F.max("distance").alias("last"))


ADJACENT_NODES_SQL = """WITH n AS (SELECT DISTINCT l_orderkey AS v, l_linenumber AS i FROM lineitem WHERE l_linenumber <> 4)
SELECT a.v || '-' || a.i AS node_id, count(*) AS nodes, min(3 * (b.i - a.i))::INTEGER AS first, max(3 * (b.i - a.i))::INTEGER AS last FROM n AS a JOIN n AS b ON a.v = b.v AND b.i BETWEEN a.i - 1 AND a.i + 1 GROUP BY 1"""


def expansion_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword hits, expanded as their spread over languages and sources says. A document's first line belongs to its language, the others to its source."""
    docs = table(spark, sf_dir, "documents")
    node = F.when(F.col("ordinal") == 0, F.substring_index("heading_path", " > ", 1)).otherwise(F.col("heading_path"))
    rows = spans(docs).withColumns({"key": F.concat_ws("#", "doc_id", "ordinal"), "node_id": node})
    found = retrieve.keyword_search(rows, QUERY, 20)
    order = Window.orderBy(F.desc("score"), "start_offset", "doc_id", "ordinal")  # 20 rows
    found = found.select("key", "node_id", "score", F.lit("keyword").alias("path"), F.row_number().over(order).alias("ordinal"))
    paths = docs.select(F.concat_ws(" > ", "lang", "source").alias("heading_path")).distinct()
    tree = chunks.tree_from_paths(paths.select(F.lit("all").alias("version_id"), "heading_path", F.lit(0).alias("start_offset"), F.lit(0).alias("end_offset"))).select(F.col("heading_path").alias("node_id"), "heading_path")
    return hits.expansion(found, chunks.ancestors_by_path(tree), rows.select("node_id", "key", F.col("ordinal").alias("ordinal_no")))


EXPANSION_LOOP_SQL = f"""WITH {SPANS_SQL}, k AS ({KEYWORD_SQL.replace("LIMIT 50", "LIMIT 20")}),
h AS (SELECT doc_id || '#' || ordinal AS key, CASE WHEN ordinal = 0 THEN split_part(heading_path, ' > ', 1) ELSE heading_path END AS node, score, row_number() OVER (ORDER BY score DESC, start_offset, doc_id, ordinal) AS rank FROM k),
p AS (SELECT score, unnest(CASE WHEN contains(node, ' > ') THEN [node, split_part(node, ' > ', 1)] ELSE [node] END) AS node FROM h),
r AS (SELECT node, sum(score) AS total FROM p GROUP BY 1), w AS (SELECT sum(total) AS whole FROM r),
s AS (SELECT count(*) AS n, coalesce(stddev_samp(total) / avg(total), 0) AS cv, -sum(total / whole * log2(total / whole)) AS entropy FROM r, w),
d AS (SELECT n, CASE WHEN cv > 1 AND entropy < 0.5 THEN 'high_concentration' WHEN cv < 0.4 OR entropy > 0.8 * log2(n) THEN 'high_dispersion' ELSE 'moderate' END AS decision FROM s),
g AS (SELECT node, row_number() OVER (ORDER BY round(total, 9) DESC, node) AS rank, CASE decision WHEN 'high_concentration' THEN 2 WHEN 'high_dispersion' THEN n ELSE 1 END AS many FROM r, d QUALIFY rank <= many),
u AS (SELECT node, rank, 0 AS up FROM g UNION ALL SELECT split_part(node, ' > ', 1), rank, 1 FROM g WHERE contains(node, ' > ')),
f AS (SELECT doc_id || '#' || ordinal AS key, up, rank, ordinal FROM (SELECT *, CASE WHEN ordinal = 0 THEN split_part(heading_path, ' > ', 1) ELSE heading_path END AS node FROM spans) JOIN u USING (node) QUALIFY row_number() OVER (PARTITION BY key ORDER BY up, rank) = 1),
x AS (SELECT key, 'keyword' AS path, rank, score FROM h UNION ALL SELECT key, 'tree_expansion', row_number() OVER (ORDER BY up, rank, ordinal, key), 0 FROM f),
z AS (SELECT key, round(sum(1.0::DOUBLE / (60 + rank)) * (1 + 0.1::DOUBLE * (count(*) - 1)), 10) AS fused, round(max(score), 6) AS score, string_agg(path, ',' ORDER BY path) AS source_paths FROM x GROUP BY 1)
SELECT key, fused, score, source_paths, (row_number() OVER (ORDER BY fused DESC, score DESC, key))::INTEGER AS rank, decision, source_paths = 'tree_expansion' AS expanded FROM z, d"""


def graph_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as chunks, parts as entities, documents' sources as relations between languages, for given keywords."""
    rows = spans(table(spark, sf_dir, "documents")).select(F.concat_ws("#", "doc_id", "ordinal").alias("chunk_id"), F.col("raw_text").alias("text"))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity_id"), F.concat_ws(" ", "p_name", "p_type").alias("name"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("relation_id"), F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("keywords"))
    return graph.context("what is of the kind", ["Standard", " 1 ", ""], ["the", "high F"], rows, part, orders, "mix", 15, 25)


def _matched_sql(column: str, words: list[str]) -> str:
    padded = f"' ' || array_to_string(list_filter(regexp_split_to_array(lower({column}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> ''), ' ') || ' '"
    return " + ".join(f"contains({padded}, ' {w} ')::INTEGER" for w in words)


def _context_sql(kind: str, key: str, source: str, column: str, words: list[str], limit: int) -> str:
    return f"""SELECT '{kind}' AS kind, id, matched, round(matched::DOUBLE / {len(words)}, 6) AS score, (row_number() OVER (ORDER BY matched DESC, id))::INTEGER AS rank
FROM (SELECT ({key})::VARCHAR AS id, {_matched_sql(column, words)} AS matched FROM {source}) WHERE matched > 0 QUALIFY rank <= {limit}"""


GRAPH_CONTEXT_SQL = f"""WITH {SPANS_SQL}
{_context_sql("entity", "p_partkey", "part", "p_name || ' ' || p_type", ["standard", "1"], 15)}
UNION ALL {_context_sql("relation", "o_orderkey", "orders", "o_orderpriority || ' ' || o_orderstatus", ["the", "high f"], 15)}
UNION ALL {_context_sql("chunk", "doc_id || '#' || ordinal", "spans", "raw_text", ["standard", "1", "the", "high f"], 25)}"""


def nodes_of_documents(docs: DataFrame, key: str) -> DataFrame:
    """Lines, blank ones too, as parser output: every fifth stands under the language alone, others under the source as well."""
    lines = line_rows(docs, key, "lang", "source")
    heads = F.when(F.col("ordinal") % 5 == 0, F.array("lang")).otherwise(F.array("lang", "source"))
    return lines.select(key, "ordinal", F.when(F.col("ordinal") % 3 != 0, F.floor(F.col("ordinal") / 10).cast("int") + 1).alias("page_no"), heads.alias("headings"), F.col("start").alias("start_offset"), F.col("line").alias("text"))


def _nodes_sql(key: str) -> str:
    return f"""SELECT doc_id, {key} AS key, i::INTEGER AS ordinal, CASE WHEN i % 3 <> 0 THEN i // 10 + 1 END AS page_no, CASE WHEN i % 5 = 0 THEN [lang] ELSE [lang, source] END AS heads, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS text,
 coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
 FROM (SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)"""


def raw_pair_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the files of every document; some have names or versions that are refused."""
    docs, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    name = F.when(k % 11 == 0, F.concat(F.lit("Not a slug "), k)).otherwise(F.concat(F.lit("document-"), k))
    own = ident.uuid5(F.concat(F.lit("doc:"), k))
    rows = docs.withColumn("name", name)
    listed = rows.select("name", own.alias("doc_id"), F.when(k % 13 == 0, "none").otherwise(own).alias("version_id"), ident.content_hash(F.col("text")).alias("source_checksum"), F.lit("2.1").alias("docling_version"))
    made = pairs.raw_pairs(listed, nodes_of_documents(rows, "name"), "pages 1.0")
    digest = lambda c: F.sha2(c, 256)
    return made.select("name", digest("markdown").alias("markdown"), digest("sidecar").alias("sidecar"), digest("manifest").alias("manifest"), "canonical_hash", "span_count", "dropped_nodes", F.coalesce("error", F.lit("none")).alias("error"))


_SIDE_SQL = """'    {' || chr(10) || '      "span_id": "' || span_id || '",' || chr(10) || '      "page_no": ' || coalesce(page_no::VARCHAR, 'null') || ',' || chr(10) || '      "heading_path": [' || chr(10) || '        ' || list_aggregate(list_transform(heads, lambda h: to_json(h)::VARCHAR), 'string_agg', ',' || chr(10) || '        ') || chr(10) || '      ],' || chr(10) || '      "offset": ' || start || ',' || chr(10) || '      "text": ' || to_json(text)::VARCHAR || chr(10) || '    }'"""
_PLAIN_SQL = """'{"heading_path":' || to_json(heads)::VARCHAR || ',"offset":' || start || ',"page_no":' || coalesce(page_no::VARCHAR, 'null') || ',"span_id":"' || span_id || '","text":' || to_json(text)::VARCHAR || '}'"""
_BODY_SQL = """CASE WHEN heads IS DISTINCT FROM lag(heads) OVER (PARTITION BY doc_id ORDER BY ordinal) THEN '# ' || heads[1] || chr(10) || chr(10) || CASE WHEN len(heads) > 1 THEN '## ' || heads[2] || chr(10) || chr(10) ELSE '' END ELSE '' END || text"""

RAW_PAIR_FILES_SQL = f"""WITH n AS ({_nodes_sql("CASE WHEN doc_id % 11 = 0 THEN 'Not a slug ' || doc_id ELSE 'document-' || doc_id END")}),
o AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'Not a slug ' || doc_id ELSE 'document-' || doc_id END AS name, {uuid5_sql("'doc:' || doc_id")} AS did, CASE WHEN doc_id % 13 = 0 THEN 'none' ELSE did END AS vid, sha256(coalesce(text, '')) AS checksum FROM documents),
s AS (SELECT n.*, {uuid5_sql("did || '|' || vid || '|' || coalesce(page_no::VARCHAR, 'None') || '|' || array_to_string(heads, '/') || '|' || start || '|' || n.text")} AS span_id FROM n JOIN o USING (doc_id) WHERE n.text <> ''),
q AS (SELECT doc_id, ordinal, heads, {_BODY_SQL} AS body, {_SIDE_SQL} AS side, {_PLAIN_SQL} AS plain FROM s),
a AS (SELECT doc_id, count(*) AS c, string_agg(body, chr(10) || chr(10) ORDER BY ordinal) AS body, string_agg(side, ',' || chr(10) ORDER BY ordinal) AS side, string_agg(plain, ',' ORDER BY ordinal) AS plain, arg_min(heads[1], ordinal) AS title FROM q GROUP BY 1),
d AS (SELECT doc_id, count(*) FILTER (text = '') AS dropped FROM n GROUP BY 1),
e AS (SELECT *, CASE WHEN doc_id % 13 = 0 THEN 'version_id must be a UUID' WHEN doc_id % 11 = 0 THEN 'invalid slug' WHEN c IS NULL THEN 'no valid spans' ELSE 'none' END AS error FROM o LEFT JOIN a USING (doc_id) LEFT JOIN d USING (doc_id)),
f AS (SELECT *, '---' || chr(10) || 'type: raw' || chr(10) || 'doc_id: ' || did || chr(10) || 'version_id: ' || vid || chr(10) || 'source_checksum: ' || checksum || chr(10) || 'docling_version: ''2.1''' || chr(10) || 'generated_by: pages 1.0' || chr(10) || 'title: ' || title || chr(10) || '---' || chr(10) || body || chr(10) AS markdown,
 '{{' || chr(10) || '  "schema_version": 1,' || chr(10) || '  "doc_id": "' || did || '",' || chr(10) || '  "version_id": "' || vid || '",' || chr(10) || '  "spans": [' || chr(10) || side || chr(10) || '  ]' || chr(10) || '}}' || chr(10) AS sidecar,
 sha256('{{"doc_id":"' || did || '","docling_version":"2.1","generated_by":"pages 1.0","source_checksum":"' || checksum || '","title":"' || title || '","type":"raw","version_id":"' || vid || '"}}[' || plain || ']') AS canonical FROM e),
m AS (SELECT *, '{{"canonical_hash":"' || canonical || '","markdown_file":"' || name || '.md","markdown_sha256":"' || sha256(markdown) || '","schema_version":1,"sidecar_file":"' || name || '.spans.json","sidecar_sha256":"' || sha256(sidecar) || '"}}' || chr(10) AS manifest FROM f)
SELECT name, CASE WHEN error = 'none' THEN sha256(markdown) END AS markdown, CASE WHEN error = 'none' THEN sha256(sidecar) END AS sidecar, CASE WHEN error = 'none' THEN sha256(manifest) END AS manifest, CASE WHEN error = 'none' THEN canonical END AS canonical_hash, coalesce(c, 0)::INTEGER AS span_count, coalesce(dropped, 0) AS dropped_nodes, error FROM m"""


def batch(spark: SparkSession, sf_dir: str) -> ingest.Ingested:
    """Documents as a batch of files: some are missing, some not parsed or parsed from other bytes; half are known, of these half by other content."""
    k = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").withColumn("source_uri", F.concat(F.lit("file:///in/"), k))
    digest = ident.content_hash(F.col("text"))
    sources = docs.select("source_uri", F.when(k % 9 != 0, F.coalesce("text", F.lit(""))).alias("content"))
    parsed = docs.filter("doc_id % 10 <> 3").select("source_uri", F.when(k % 10 == 7, F.sha2(F.lit("other"), 256)).otherwise(digest).alias("source_sha256"), F.lit("2.1").alias("docling_version"))
    versions = docs.filter("doc_id % 4 in (1, 2)").select(ident.uuid5(F.col("source_uri")).alias("doc_id"), F.when(k % 4 == 1, digest).otherwise("old").alias("content_hash"), F.lit(1).alias("version_no"), F.lit(True).alias("is_active"))
    return ingest.ingest(sources, parsed, nodes_of_documents(docs, "source_uri"), versions, "pages 1.0")


def ingest_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch(spark, sf_dir).results


def ingested_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch(spark, sf_dir).spans.select("version_id", "index", "span_id", F.array_join("headings", "/").alias("headings"), F.coalesce("page_no", F.lit(0)).alias("page_no"), "start_offset", F.sha2("text", 256).alias("text"))


_BATCH_SQL = f"""n AS ({_nodes_sql("'file:///in/' || doc_id")}),
o AS (SELECT doc_id, 'file:///in/' || doc_id AS source_uri, {uuid5_sql("'file:///in/' || doc_id")} AS did, CASE WHEN doc_id % 4 = 2 THEN 2 ELSE 1 END AS version_no, {uuid5_sql("did || '|' || version_no")} AS vid FROM documents),
c AS (SELECT doc_id, count(*) FILTER (text <> '') AS c, count(*) FILTER (text = '') AS dropped FROM n GROUP BY 1),
r AS (SELECT o.*, CASE WHEN o.doc_id % 9 = 0 THEN 'source not found' WHEN o.doc_id % 10 = 3 THEN 'not parsed' WHEN o.doc_id % 10 = 7 THEN 'content hash mismatch' WHEN coalesce(c, 0) = 0 THEN 'no valid spans' ELSE 'ingested' END AS outcome, c, dropped FROM o LEFT JOIN c USING (doc_id))"""

INGEST_OUTCOMES_SQL = f"""WITH {_BATCH_SQL} SELECT source_uri, did AS doc_id, CASE WHEN outcome <> 'source not found' THEN vid END AS version_id, outcome, CASE WHEN outcome = 'ingested' THEN c ELSE 0 END::INTEGER AS spans, CASE WHEN outcome IN ('ingested', 'no valid spans') THEN coalesce(dropped, 0) ELSE 0 END AS dropped_nodes FROM r"""
INGESTED_SPANS_SQL = f"""WITH {_BATCH_SQL} SELECT vid AS version_id, (row_number() OVER (PARTITION BY doc_id ORDER BY ordinal) - 1)::INTEGER AS index, {uuid5_sql("did || '|' || vid || '|' || coalesce(page_no::VARCHAR, 'None') || '|' || array_to_string(heads, '/') || '|' || start || '|' || n.text")} AS span_id, array_to_string(heads, '/') AS headings, coalesce(page_no, 0)::INTEGER AS page_no, start::INTEGER AS start_offset, sha256(n.text) AS text
FROM n JOIN r USING (doc_id) WHERE outcome = 'ingested' AND n.text <> ''"""


def arrivals(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Lines of orders as arrivals of files, in order of their numbers: contents repeat, two contracts, some titles; every third order is known."""
    lines, k = table(spark, sf_dir, "lineitem"), F.col("l_orderkey")
    uri = F.concat(F.lit("file:///o/"), k, F.lit(".v1.pdf"))
    arriving = lines.select(F.col("l_linenumber").cast("int").alias("ordinal"), uri.alias("source_uri"), F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("t"), "l_linenumber")).alias("title"), F.concat(F.lit("h"), F.col("l_linenumber") % 3).alias("content_hash"), F.when(F.col("l_linenumber") == 5, "new").otherwise("c").alias("contract"))
    known = lines.filter("l_orderkey % 3 = 0").select("l_orderkey").distinct().select(uri.alias("source_uri"))
    documents = known.select(ident.uuid5(F.col("source_uri")).alias("doc_id"), "source_uri", F.lit("old").alias("title"))
    versions = documents.select("doc_id", F.lit("h1").alias("content_hash"), F.lit("c").alias("contract"), F.lit(4).alias("version_no"), F.lit(True).alias("is_active"))
    return reconcile.registered_documents(documents, versions, arriving)


def arrived_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, versions = arrivals(spark, sf_dir)
    return versions.join(documents, "doc_id").select("doc_id", "source_uri", "title", "content_hash", "contract", "version_no", "is_active")


ARRIVED_VERSIONS_SQL = f"""WITH a AS (SELECT l_orderkey AS k, l_linenumber AS i, 'h' || l_linenumber % 3 AS h, CASE WHEN l_linenumber = 5 THEN 'new' ELSE 'c' END AS c FROM lineitem),
d AS (SELECT k, 'file:///o/' || k || '.v1.pdf' AS source_uri, max(i) AS last FROM a GROUP BY 1), t AS (SELECT k, source_uri, {uuid5_sql("source_uri")} AS doc_id, CASE WHEN last % 2 = 0 THEN 't' || last ELSE k || '.v1' END AS title FROM d),
f AS (SELECT k, h, c, min(i) AS i FROM a WHERE NOT (k % 3 = 0 AND h = 'h1' AND c = 'c') GROUP BY 1, 2, 3),
n AS (SELECT k, h, c, row_number() OVER (PARTITION BY k ORDER BY i, h, c) + CASE WHEN k % 3 = 0 THEN 4 ELSE 0 END AS version_no, row_number() OVER (PARTITION BY k ORDER BY i DESC, h DESC, c DESC) = 1 AS is_active FROM f),
v AS (SELECT * FROM n UNION ALL SELECT k, 'h1', 'c', 4, k NOT IN (SELECT k FROM n) FROM d WHERE k % 3 = 0)
SELECT doc_id, source_uri, title, h AS content_hash, c AS contract, version_no::INTEGER AS version_no, is_active FROM v JOIN t USING (k)"""


def workspace_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents indexed into a workspace, their outlines two levels deep; what the tools answer for each, and for each tenth one that it lacks."""
    docs, k = table(spark, sf_dir, "documents"), F.col("doc_id").cast("string")
    place = workspace.Workspace(spark, store.new_folder(spark, "workspace"))
    listed = docs.select(k.alias("doc_id"), F.concat(F.lit("doc "), k).alias("doc_name"), "source", "lang").select("doc_id", "doc_name", F.col("source").alias("doc_description"), F.when(F.col("lang") == "en", "md").otherwise("pdf").alias("type"), F.lit(None).cast("string").alias("version_id"))
    lines = line_rows(docs.select(k.alias("doc_id"), "text"), "doc_id").select("doc_id", (F.col("ordinal") + 1).alias("number"), F.col("line").alias("text"))
    roots = docs.select(k.alias("doc_id"), F.lit("n0").alias("node_id"), F.lit(None).cast("string").alias("parent_node_id"), F.lit(0).alias("level_no"), F.col("source").alias("title"), F.lit(1).alias("start"))
    inner = lines.filter("number % 4 = 1").select("doc_id", F.concat(F.lit("n"), "number").alias("node_id"), F.lit("n0").alias("parent_node_id"), F.lit(1).alias("level_no"), F.substr("text", F.lit(1), F.lit(12)).alias("title"), F.col("number").alias("start"))
    place.index(listed, roots.unionByName(inner), lines)
    wanted = docs.select(k.alias("doc_id")).unionByName(docs.filter("doc_id % 10 = 0").select(F.concat(F.lit("x"), k).alias("doc_id")))
    requests = wanted.withColumn("pages", F.when(F.col("doc_id").endswith("7"), "3-1").otherwise("5, 1-2"))
    answers = place.documents(wanted).withColumnRenamed("json", "document").join(place.structures(wanted).withColumnRenamed("json", "structure"), "doc_id").join(place.contents(requests).withColumnRenamed("json", "content"), "doc_id")
    return answers.select("doc_id", "document", F.sha2("structure", 256).alias("structure"), F.sha2("content", 256).alias("content"))


WORKSPACE_TOOLS_SQL = """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) + 1 AS i FROM documents),
n AS (SELECT doc_id, count(*) AS n, string_agg('{"title":' || to_json(substr(line, 1, 12))::VARCHAR || ',"node_id":"n' || i || '","start":' || i || ',"nodes":[]}', ',' ORDER BY i) FILTER (i % 4 = 1) AS kids FROM l GROUP BY 1),
c AS (SELECT doc_id, string_agg('{"page":' || i || ',"content":' || to_json(line)::VARCHAR || '}', ',' ORDER BY i) AS pages FROM l JOIN documents USING (doc_id) WHERE i <= 5 AND (lang = 'en' OR i IN (1, 2, 5)) GROUP BY 1),
a AS (SELECT doc_id::VARCHAR AS doc_id, '{"doc_id":"' || doc_id || '","doc_name":"doc ' || doc_id || '","doc_description":' || to_json(coalesce(source, ''))::VARCHAR || ',"type":"' || CASE WHEN lang = 'en' THEN 'md' ELSE 'pdf' END || '","status":"completed","' || CASE WHEN lang = 'en' THEN 'line' ELSE 'page' END || '_count":' || coalesce(n, 0) || '}' AS document,
 '[{"title":' || to_json(coalesce(source, ''))::VARCHAR || ',"node_id":"n0","start":1,"nodes":[' || coalesce(kids, '') || ']}]' AS structure, CASE WHEN doc_id % 10 = 7 THEN '{"error":"Invalid pages: 3-1"}' ELSE '[' || coalesce(pages, '') || ']' END AS content FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)),
m AS (SELECT 'x' || doc_id AS doc_id, '{"error":"Document x' || doc_id || ' not found"}' AS e FROM documents WHERE doc_id % 10 = 0)
SELECT doc_id, document, sha256(structure) AS structure, sha256(content) AS content FROM a UNION ALL SELECT doc_id, e, sha256(e), sha256(e) FROM m"""


QUERIES = {
    "span_provenance": (span_provenance, SPAN_PROVENANCE_SQL),
    "node_relatives": (node_relatives, NODE_RELATIVES_SQL),
    "adjacent_nodes": (adjacent_nodes, ADJACENT_NODES_SQL),
    "expansion_loop": (expansion_loop, EXPANSION_LOOP_SQL),
    "graph_context": (graph_context, GRAPH_CONTEXT_SQL),
    "raw_pair_files": (raw_pair_files, RAW_PAIR_FILES_SQL),
    "ingest_outcomes": (ingest_outcomes, INGEST_OUTCOMES_SQL),
    "ingested_spans": (ingested_spans, INGESTED_SPANS_SQL),
    "arrived_versions": (arrived_versions, ARRIVED_VERSIONS_SQL),
    "workspace_tools": (workspace_tools, WORKSPACE_TOOLS_SQL),
}
