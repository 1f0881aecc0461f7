"""Queries of registry reads over versions of documents, with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, vectors
from ..operators import chunks, fuse, reconcile, registry, retrieve
from .model import SPANS_SQL, spans, table


class Model:
    """Documents with one or two versions; their spans, heading nodes, chunks of two spans, entities and links."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        docs = table(spark, sf_dir, "documents")
        n = F.col("doc_id")
        stages = F.array(*(F.lit(s) for s in registry.STAGES))
        rows = docs.select("doc_id", F.explode(F.sequence(F.lit(1), (1 + n % 2).cast("int"))).alias("version_no"))
        self.versions = rows.select("doc_id", "version_no", F.concat_ws(":v", "doc_id", "version_no").alias("version_id"), (F.col("version_no") == 1 + n % 2).alias("is_active"), F.element_at(stages, (n % 8 + 1).cast("int")).alias("processing_status"), (F.col("version_no") * 1_000_000 + n).alias("created_at"))
        every = spans(docs).drop("version_id").join(self.versions.select("doc_id", "version_id"), "doc_id")
        self.spans = every.withColumn("span_id", F.concat_ws("#", "version_id", "ordinal")).withColumn("page_no", F.when(F.col("ordinal") % 4 != 0, F.col("ordinal") % 9))
        self.nodes = chunks.tree_from_paths(self.spans)
        self.node_spans = self.spans.select(F.concat_ws(":", "version_id", "heading_path", F.lit(1)).alias("node_id"), "span_id", "ordinal")
        number = F.expr("ordinal div 2").cast("int")
        self.chunk_spans = self.spans.select(F.concat_ws("@", "version_id", number).alias("chunk_id"), "version_id", "span_id", (F.col("ordinal") % 2).alias("ordinal_no"), number.alias("chunk_order"))
        self.chunks = self.chunk_spans.groupBy("chunk_id", "version_id", "chunk_order").agg(F.count(F.lit(1)).alias("n_spans")).withColumn("node_id", F.when(F.col("chunk_order") % 3 == 0, F.lit("given")))
        self.entities = docs.select("source").distinct().select(F.concat(F.lit("e:"), "source").alias("entity_id"), F.concat(F.lit("concept:"), "source").alias("entity_key"), F.lit("concept").alias("entity_type"))
        self.node_links = self.nodes.filter("level_no = 1").select("node_id", F.concat(F.lit("e:"), "title").alias("entity_id"), F.lit(0).alias("ordinal_no"), F.lit(0.7).alias("confidence_score"))
        sure = F.when(F.col("chunk_order") % 5 != 0, F.col("chunk_order") % 7 / 10.0)
        self.chunk_links = self.chunks.select("chunk_id", F.concat(F.lit("e:src"), F.col("chunk_order") % 20).alias("entity_id"), (F.col("chunk_order") % 3).alias("ordinal_no"), sure.alias("confidence_score"))


_STAGES = "[" + ", ".join(f"'{s}'" for s in registry.STAGES) + "]"
MODEL_SQL = f"""{SPANS_SQL},
versions AS (SELECT doc_id, n::INTEGER AS version_no, doc_id || ':v' || n AS version_id, n = 1 + doc_id % 2 AS is_active, {_STAGES}[doc_id % 8 + 1] AS processing_status, n * 1000000 + doc_id AS created_at FROM (SELECT doc_id, unnest(range(1, 2 + doc_id % 2)) AS n FROM documents)),
sp AS (SELECT v.version_id, s.doc_id, s.ordinal::INTEGER AS ordinal, s.start_offset, s.end_offset, s.heading_path, s.raw_text, v.version_id || '#' || s.ordinal AS span_id, CASE WHEN s.ordinal % 4 <> 0 THEN s.ordinal % 9 END::INTEGER AS page_no FROM spans s JOIN versions v USING (doc_id)),
own AS (SELECT version_id, heading_path, split_part(heading_path, ' > ', 1) AS root, count(*) AS n FROM sp GROUP BY ALL),
nd AS (SELECT version_id || ':' || heading_path || ':1' AS node_id, version_id, version_id || ':' || root || ':0' AS parent_node_id, 1 AS level_no, split_part(heading_path, ' > ', 2) AS title, heading_path, n AS span_count FROM own
 UNION ALL SELECT DISTINCT version_id || ':' || root || ':0', version_id, NULL, 0, root, root, 0 FROM own),
ns AS (SELECT version_id || ':' || heading_path || ':1' AS node_id, span_id, ordinal FROM sp),
cs AS (SELECT version_id || '@' || ordinal // 2 AS chunk_id, version_id, span_id, (ordinal % 2)::INTEGER AS ordinal_no, (ordinal // 2)::INTEGER AS chunk_order FROM sp),
ch AS (SELECT chunk_id, version_id, chunk_order, count(*) AS n_spans, CASE WHEN chunk_order % 3 = 0 THEN 'given' END AS node_id FROM cs GROUP BY 1, 2, 3),
en AS (SELECT DISTINCT 'e:' || source AS entity_id, 'concept:' || source AS entity_key FROM documents),
nl AS (SELECT node_id, 'e:' || title AS entity_id, 0 AS ordinal_no, 0.7::DOUBLE AS confidence_score FROM nd WHERE level_no = 1),
cl AS (SELECT chunk_id, 'e:src' || chunk_order % 20 AS entity_id, chunk_order % 3 AS ordinal_no, CASE WHEN chunk_order % 5 <> 0 THEN chunk_order % 7 / 10.0::DOUBLE END AS confidence_score FROM ch),
active AS (SELECT version_id FROM versions WHERE is_active)"""


def version_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Model(spark, sf_dir)
    return registry.of_versions(m.spans, m.versions, ["start_offset"]).select("version_id", "span_id", "page_no", "start_offset", "end_offset")


VERSION_SPANS_SQL = f"WITH {MODEL_SQL} SELECT version_id, span_id, page_no, start_offset, end_offset FROM sp JOIN active USING (version_id)"


def version_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Model(spark, sf_dir)
    return registry.of_versions(m.nodes, m.versions, ["level_no", "heading_path"]).select("version_id", "node_id", "parent_node_id", "level_no", "title", "span_count")


VERSION_NODES_SQL = f"WITH {MODEL_SQL} SELECT version_id, node_id, parent_node_id, level_no, title, span_count FROM nd JOIN active USING (version_id)"


def node_span_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Model(spark, sf_dir)
    return registry.linked(m.node_spans, m.nodes, "node_id", ["node_id", "ordinal"])


NODE_SPAN_LINKS_SQL = f"WITH {MODEL_SQL} SELECT node_id, span_id, ordinal, version_id FROM ns JOIN (SELECT node_id, version_id FROM nd) USING (node_id)"


def version_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Model(spark, sf_dir)
    return registry.of_versions(m.chunks, m.versions, ["chunk_order"])


VERSION_CHUNKS_SQL = f"WITH {MODEL_SQL} SELECT ch.* FROM ch JOIN active USING (version_id)"


def chunk_span_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Model(spark, sf_dir)
    return registry.linked(m.chunk_spans.select("chunk_id", "span_id", "ordinal_no"), m.chunks, "chunk_id", ["chunk_id", "ordinal_no"])


CHUNK_SPAN_LINKS_SQL = f"WITH {MODEL_SQL} SELECT chunk_id, span_id, ordinal_no, version_id FROM cs"


def node_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes with the vectors of their titles, of active versions."""
    m = Model(spark, sf_dir)
    titles = m.nodes.select("title").distinct()
    found = titles.select("title", vectors.hashed_embedding(vectors.embedding_tokens(F.col("title")), 4).alias("v"))
    own = registry.of_versions(m.nodes, m.versions, ["level_no", "heading_path"]).select("version_id", "node_id", "title")
    return own.join(found, "title").select("version_id", "node_id", *(F.round(F.element_at("v", i + 1), 6).alias(f"v{i}") for i in range(4)))


NODE_EMBEDDINGS_SQL = f"""WITH {MODEL_SQL}, t AS (SELECT DISTINCT title FROM nd), k AS (SELECT title, unnest([title] || list_transform(range(1, length(title) + 1), lambda i: substr(title, i, 1)) || list_transform(range(1, length(title)), lambda i: substr(title, i, 2))) AS t FROM t),
b AS (SELECT title, i, sum(('0x' || substr(h, 2 * i + 1, 2))::INTEGER / 255.0::DOUBLE) AS x FROM (SELECT title, sha256(t) AS h, unnest(range(4)) AS i FROM k) GROUP BY 1, 2), v AS (SELECT *, x / sqrt(sum(x * x) OVER (PARTITION BY title)) AS y FROM b),
w AS (SELECT title, {", ".join(f"round(max(CASE WHEN i = {i} THEN y END), 6) AS v{i}" for i in range(4))} FROM v GROUP BY 1) SELECT version_id, node_id, v0, v1, v2, v3 FROM nd JOIN active USING (version_id) JOIN w USING (title)"""


def entity_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All entities and relations, by key."""
    entities = table(spark, sf_dir, "supplier").select(F.lit("entity").alias("kind"), F.concat(F.lit("s"), "s_suppkey").alias("key"), F.lit(None).cast("string").alias("target"))
    lines = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("key"), F.concat(F.lit("p"), "l_partkey").alias("target")).distinct()
    return entities.unionByName(lines.select(F.lit("relation").alias("kind"), "key", "target")).orderBy("kind", "key", "target")


ENTITY_SCAN_SQL = "SELECT 'entity' AS kind, 's' || s_suppkey AS key, NULL::VARCHAR AS target FROM supplier UNION ALL SELECT DISTINCT 'relation', 's' || l_suppkey, 'p' || l_partkey FROM lineitem"


def version_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of entities, by version: the first span of each node that links to one."""
    m = Model(spark, sf_dir)
    first = m.node_spans.groupBy("node_id").agg(F.min_by("span_id", "ordinal").alias("span_id"))
    evidence = m.node_links.join(first, "node_id").join(m.nodes.select("node_id", "version_id"), "node_id").select("version_id", "entity_id", "span_id", "confidence_score")
    return registry.of_versions(evidence, m.versions, ["entity_id", "span_id"])


VERSION_EVIDENCE_SQL = f"WITH {MODEL_SQL}, f AS (SELECT node_id, arg_min(span_id, ordinal) AS span_id FROM ns GROUP BY 1) SELECT version_id, entity_id, span_id, confidence_score FROM nl JOIN f USING (node_id) JOIN (SELECT node_id, version_id FROM nd) USING (node_id) JOIN active USING (version_id)"


def entity_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks and nodes by entity, and entities by chunk and node."""
    m = Model(spark, sf_dir)
    by = lambda links, owners, key: registry.entity_lookups(links, owners, m.entities, key).select(F.lit(key).alias("kind"), F.col(key).alias("owner"), "version_id", "entity_key", "entity_place", "owner_place")
    return by(m.chunk_links, m.chunks, "chunk_id").unionByName(by(m.node_links, m.nodes, "node_id"))


ENTITY_LOOKUPS_SQL = f"""WITH {MODEL_SQL}, l AS (SELECT 'chunk_id' AS kind, chunk_id AS owner, version_id, entity_id, ordinal_no, confidence_score AS c FROM cl JOIN (SELECT chunk_id, version_id FROM ch) USING (chunk_id) UNION ALL SELECT 'node_id', node_id, version_id, entity_id, ordinal_no, confidence_score FROM nl JOIN (SELECT node_id, version_id FROM nd) USING (node_id))
SELECT kind, owner, version_id, entity_key, row_number() OVER (PARTITION BY kind, owner ORDER BY ordinal_no, c DESC NULLS LAST, entity_key)::INTEGER AS entity_place, row_number() OVER (PARTITION BY kind, entity_id ORDER BY c DESC NULLS LAST, version_id, owner)::INTEGER AS owner_place FROM l JOIN en USING (entity_id)"""


def type_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity types with their fields, relation types with their ends, in one list by name."""
    part = table(spark, sf_dir, "part").select("p_type").distinct().select(F.lit("entity").alias("kind"), F.col("p_type").alias("name"))
    flags = table(spark, sf_dir, "lineitem").select("l_returnflag").distinct().select(F.lit("relation").alias("kind"), F.col("l_returnflag").alias("name"))
    return part.unionByName(flags).orderBy("kind", "name")


TYPE_SCHEMAS_SQL = "SELECT DISTINCT 'entity' AS kind, p_type AS name FROM part UNION ALL SELECT DISTINCT 'relation', l_returnflag FROM lineitem"


def version_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of nodes (their first spans), by level and path, of active versions."""
    m = Model(spark, sf_dir)
    first = m.node_spans.join(m.spans.select("span_id", "raw_text"), "span_id").groupBy("node_id").agg(F.min_by("raw_text", "ordinal").alias("summary_text"))
    return registry.of_versions(first.join(m.nodes, "node_id"), m.versions, ["level_no", "heading_path"]).select("version_id", "node_id", "level_no", F.sha2("summary_text", 256).alias("summary_sha256"))


VERSION_SUMMARIES_SQL = f"WITH {MODEL_SQL} SELECT version_id, node_id, level_no, sha256(arg_min(raw_text, ns.ordinal)) AS summary_sha256 FROM ns JOIN (SELECT span_id, raw_text FROM sp) USING (span_id) JOIN nd USING (node_id) JOIN active USING (version_id) GROUP BY 1, 2, 3"


def version_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of each document with their places, and the active ones that are complete."""
    m = Model(spark, sf_dir)
    done = registry.newest(m.versions, "complete").select("version_id", F.lit(True).alias("done"))
    return registry.listed(m.versions).join(done, "version_id", "left").select("doc_id", "version_id", "place", F.coalesce("done", F.lit(False)).alias("done"))


VERSION_READS_SQL = f"WITH {MODEL_SQL} SELECT doc_id, version_id, row_number() OVER (PARTITION BY doc_id ORDER BY version_no DESC)::INTEGER AS place, is_active AND processing_status = 'complete' AS done FROM versions"


def paged_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.span_scan(Model(spark, sf_dir).spans, 3).select("version_id", "span_id", "page_no", "start_offset")


PAGED_SPANS_SQL = f"WITH {MODEL_SQL} SELECT version_id, span_id, page_no, start_offset FROM sp WHERE page_no = 3 ORDER BY version_id, start_offset, span_id LIMIT 1000"


def stamped_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of status changes: a third of the versions has moved on, some are new."""
    m = Model(spark, sf_dir)
    before = m.versions.filter("doc_id % 5 <> 0").select("version_id", "processing_status", F.col("created_at").alias("status_changed_at"))
    after = m.versions.select("version_id", F.when(F.col("doc_id") % 3 == 0, F.lit("failed")).otherwise(F.col("processing_status")).alias("processing_status"))
    return registry.stamped(before, after, "version_id", F.lit(9).cast("bigint")).select("version_id", "processing_status", "status_changed_at")


STAMPED_SQL = f"WITH {MODEL_SQL}, a AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN 'failed' ELSE processing_status END AS s FROM versions) SELECT version_id, s AS processing_status, CASE WHEN doc_id % 5 <> 0 AND s = processing_status THEN created_at ELSE 9 END::BIGINT AS status_changed_at FROM a"


def unfinished_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Model(spark, sf_dir)
    links = m.node_links.join(m.nodes.select("node_id", "version_id"), "node_id").filter("entity_id <> 'e:src3'")
    evidence = m.versions.filter("doc_id % 2 = 0").select("version_id")
    return registry.unfinished(m.versions, links, evidence).select("version_id")


UNFINISHED_SQL = f"WITH {MODEL_SQL} SELECT version_id FROM versions WHERE doc_id % 2 <> 0 AND version_id NOT IN (SELECT version_id FROM nl JOIN nd USING (node_id) WHERE entity_id <> 'e:src3')"


def attached_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Model(spark, sf_dir)
    mapped = m.node_spans.filter("ordinal % 4 <> 1")
    return registry.attached_leaves(m.chunks, m.chunk_spans, mapped, m.spans).select("chunk_id", "version_id", "node_id")


ATTACHED_LEAVES_SQL = f"""WITH {MODEL_SQL}, l AS (SELECT chunk_id, arg_max(ns.node_id, ns.ordinal) AS found FROM cs JOIN ns USING (span_id) WHERE ordinal % 4 <> 1 GROUP BY 1)
SELECT chunk_id, version_id, coalesce(found, node_id) AS node_id FROM ch LEFT JOIN l USING (chunk_id)"""


def node_chunk_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Model(spark, sf_dir)
    return registry.node_hits(m.nodes, m.node_spans, m.chunk_spans)


NODE_CHUNK_HITS_SQL = f"WITH {MODEL_SQL}, f AS (SELECT node_id, chunk_id, min(ordinal) AS o FROM ns JOIN cs USING (span_id) GROUP BY 1, 2) SELECT node_id, chunk_id, row_number() OVER (PARTITION BY node_id ORDER BY o, chunk_id)::INTEGER AS place, NULL::DOUBLE AS score FROM f"


def resolved_chunk_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of chunks: given ones, else that of the first span that has one."""
    m = Model(spark, sf_dir)
    return chunks.resolved_nodes(m.chunks, m.chunk_spans.select("chunk_id", "span_id", "ordinal_no"), m.node_spans.filter("ordinal % 4 <> 2").select("span_id", "node_id")).select("chunk_id", "node_id")


RESOLVED_SQL = f"WITH {MODEL_SQL}, l AS (SELECT chunk_id, arg_min(ns.node_id, ordinal_no) AS found FROM cs JOIN ns USING (span_id) WHERE ordinal % 4 <> 2 GROUP BY 1) SELECT chunk_id, coalesce(node_id, found) AS node_id FROM ch LEFT JOIN l USING (chunk_id)"


def near_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Model(spark, sf_dir).spans.select("span_id", F.col("page_no").alias("page_start"))
    return retrieve.near_pages(rows, 6, 1)


NEAR_PAGES_SQL = f"WITH {MODEL_SQL} SELECT span_id, page_no AS page_start FROM sp WHERE page_no BETWEEN 5 AND 7"


def pruned_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") != 3, F.col("l_discount")).alias("score"))
    return retrieve.marked_pruned(rows, 0.05)


PRUNED_SQL = "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <> 3 THEN l_discount END AS score, coalesce(CASE WHEN l_linenumber <> 3 THEN l_discount END, 0) < 0.05 AS pruned FROM lineitem"


def summary_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' names as summaries, by likeness to a query, sizes as levels."""
    nodes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node_id"), F.col("p_size").alias("level_no"), F.when(F.col("p_partkey") % 9 != 0, F.col("p_name")).alias("summary_text"))
    return retrieve.summary_search(nodes, "green steel", 40).select("node_id", "level_no", "score")


_GRAMS = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''), lambda w: list_transform(range(1, length('  ' || w || ' ') - 1), lambda i: substr('  ' || w || ' ', i, 3)))))"
SUMMARY_SIMILARITY_SQL = f"""WITH g AS (SELECT p_partkey AS node_id, p_size AS level_no, p_name, {_GRAMS.format("p_name")} AS a, {_GRAMS.format("'green steel'")} AS b FROM part WHERE p_partkey % 9 <> 0 AND trim(p_name) <> ''),
s AS (SELECT node_id, level_no, round(greatest(CASE WHEN p_name ILIKE '%green steel%' THEN 1.0 ELSE 0.0 END::DOUBLE, len(list_intersect(a, b))::DOUBLE / (len(a) + len(b) - len(list_intersect(a, b)))), 6) AS score FROM g)
SELECT node_id, level_no, score FROM s WHERE score > 0 ORDER BY score DESC, level_no, node_id LIMIT 40"""


def weighted_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_discount").alias("v"), F.col("l_tax").alias("k"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity") / 50).alias("r"), (F.col("l_linenumber") / 7).alias("d"))
    return rows.select("l_orderkey", "l_linenumber", F.round(fuse.weighted({"v": 0.40, "k": 0.30, "r": 0.20, "d": 0.10}, "r"), 9).alias("score"))


WEIGHTED_SQL = "SELECT l_orderkey, l_linenumber, round(CASE WHEN l_linenumber % 2 = 0 THEN l_discount * 0.4 + l_tax * 0.3 + l_quantity / 50 * 0.2 + l_linenumber / 7 * 0.1 ELSE (l_discount * 0.4 + l_tax * 0.3 + l_linenumber / 7 * 0.1) / 0.8 END::DOUBLE, 9) AS score FROM lineitem"


def keyword_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit(" a , ;"), "event_type", F.lit("；；b，"), F.col("event_id") % 5)
    return table(spark, sf_dir, "events").select("event_id", F.array_join(text.keyword_list(raw), "|").alias("keywords"))


KEYWORD_LISTS_SQL = "SELECT event_id, 'a|' || event_type || '|b|' || event_id % 5 AS keywords FROM events"


def activated_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first version of document 1 becomes its active one."""
    m = Model(spark, sf_dir)
    return reconcile.activated(m.versions, "1:v1").select("version_id", "is_active")


ACTIVATED_SQL = f"WITH {MODEL_SQL} SELECT version_id, CASE WHEN doc_id = 1 THEN version_id = '1:v1' ELSE is_active END AS is_active FROM versions"

QUERIES = {
    "version_spans": (version_spans, VERSION_SPANS_SQL),
    "version_nodes": (version_nodes, VERSION_NODES_SQL),
    "node_span_links": (node_span_links, NODE_SPAN_LINKS_SQL),
    "version_chunks": (version_chunks, VERSION_CHUNKS_SQL),
    "chunk_span_links": (chunk_span_links, CHUNK_SPAN_LINKS_SQL),
    "node_embeddings": (node_embeddings, NODE_EMBEDDINGS_SQL),
    "entity_scan": (entity_scan, ENTITY_SCAN_SQL),
    "version_evidence": (version_evidence, VERSION_EVIDENCE_SQL),
    "entity_lookups": (entity_lookups, ENTITY_LOOKUPS_SQL),
    "type_schemas": (type_schemas, TYPE_SCHEMAS_SQL),
    "version_summaries": (version_summaries, VERSION_SUMMARIES_SQL),
    "version_reads": (version_reads, VERSION_READS_SQL),
    "paged_spans": (paged_spans, PAGED_SPANS_SQL),
    "stamped_states": (stamped_states, STAMPED_SQL),
    "unfinished_versions": (unfinished_versions, UNFINISHED_SQL),
    "attached_leaves": (attached_leaves, ATTACHED_LEAVES_SQL),
    "node_chunk_hits": (node_chunk_hits, NODE_CHUNK_HITS_SQL),
    "resolved_chunk_nodes": (resolved_chunk_nodes, RESOLVED_SQL),
    "near_pages": (near_pages, NEAR_PAGES_SQL),
    "pruned_hits": (pruned_hits, PRUNED_SQL),
    "summary_similarity": (summary_similarity, SUMMARY_SIMILARITY_SQL),
    "weighted_fusion": (weighted_fusion, WEIGHTED_SQL),
    "keyword_lists": (keyword_lists, KEYWORD_LISTS_SQL),
    "activated_version": (activated_version, ACTIVATED_SQL),
}
