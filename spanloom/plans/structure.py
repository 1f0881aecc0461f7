"""Queries of chunks, trees, knowledge and identities, with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ident, text
from ..operators import chunks, knowledge
from .model import HIERARCHY_SQL, SPANS_SQL, hierarchy, spans, table


def heading_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chunks.by_heading(spans(table(spark, sf_dir, "documents")))
    return out.select("chunk_id", "version_id", "heading_path", "n_spans", "token_count", F.sha2("chunk_text", 256).alias("text_sha256"), "chunk_order")


HEADING_CHUNKS_SQL = f"""WITH {SPANS_SQL},
g AS (SELECT version_id, heading_path, version_id || ':heading:' || heading_path AS chunk_id, min(start_offset) AS start_offset, count(*) AS n_spans, string_agg(raw_text, chr(10) ORDER BY start_offset) AS t FROM spans GROUP BY 1, 2)
SELECT chunk_id, version_id, heading_path, n_spans, len(list_filter(regexp_split_to_array(t, '\\s+'), lambda x: x <> ''))::INTEGER AS token_count, sha256(t) AS text_sha256,
 (row_number() OVER (PARTITION BY version_id ORDER BY start_offset, chunk_id) - 1)::INTEGER AS chunk_order FROM g"""


def turn_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns with four words of their neighbours."""
    out = chunks.overlapped(table(spark, sf_dir, "conversations"), 4, ["conv_id"], ["turn"])
    return out.select("conv_id", "turn", "role", "widened")


TURN_OVERLAP_SQL = """WITH w AS (SELECT *, list_filter(regexp_split_to_array(coalesce(lag(text) OVER o, ''), '\\s+'), lambda x: x <> '') AS b, list_filter(regexp_split_to_array(coalesce(lead(text) OVER o, ''), '\\s+'), lambda x: x <> '') AS a
 FROM conversations WINDOW o AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, role, array_to_string(list_filter([array_to_string(b[greatest(len(b) - 3, 1):], ' '), text, array_to_string(a[1:4], ' ')], lambda x: x <> ''), ' ') AS widened FROM w"""


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chunks.token_segments(table(spark, sf_dir, "documents"), 128, ["doc_id"])
    return out.select("doc_id", "segment", "words", F.sha2("text", 256).alias("text_sha256"))


SEGMENTS_SQL = """WITH w AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS ws FROM documents))
SELECT doc_id, (i // 128)::INTEGER AS segment, count(*)::INTEGER AS words, sha256(string_agg(w, ' ' ORDER BY i)) AS text_sha256 FROM w GROUP BY doc_id, i // 128"""


def exact_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chunks.exact_segments(table(spark, sf_dir, "documents"), 128, "doc_id")
    return out.select("doc_id", "segment", "start", "stop", "words", F.sha2("segment_text", 256).alias("text_sha256"))


EXACT_SEGMENTS_SQL = r"""WITH p AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+[\x20\x09-\x0D]*') AS ws FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, i AS segment, ws[i * 128 + 1:i * 128 + 128] AS own, CASE WHEN i = 0 THEN regexp_extract(text, '^[\x20\x09-\x0D]*') ELSE '' END AS lead FROM (SELECT *, unnest(range(greatest(ceil(len(ws) / 128)::BIGINT, 1))) AS i FROM p)),
t AS (SELECT doc_id, segment::INTEGER AS segment, len(own)::INTEGER AS words, lead || array_to_string(own, '') AS t FROM s)
SELECT doc_id, segment, (sum(length(t)) OVER w - length(t))::BIGINT AS start, (sum(length(t)) OVER w)::BIGINT AS stop, words, sha256(t) AS text_sha256 FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY segment ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


def heading_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.tree_from_paths(spans(table(spark, sf_dir, "documents"))).select("node_id", "parent_node_id", "level_no", "title", "span_count", F.coalesce("first", F.lit(-1)).alias("first"), F.coalesce("last", F.lit(-1)).alias("last"))


HEADING_TREE_SQL = f"""WITH {SPANS_SQL},
own AS (SELECT version_id, heading_path AS p, split_part(heading_path, ' > ', 1) AS root, count(*) AS n, min(start_offset) AS first, max(end_offset) AS last FROM spans GROUP BY 1, 2, 3)
SELECT version_id || ':' || p || ':1' AS node_id, version_id || ':' || root || ':0' AS parent_node_id, 1 AS level_no, split_part(p, ' > ', 2) AS title, n AS span_count, first, last FROM own
UNION ALL SELECT DISTINCT version_id || ':' || root || ':0', NULL, 0, root, 0, -1, -1 FROM own"""


def tree_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.ancestors(hierarchy(spark, sf_dir))


TREE_ANCESTORS_SQL = f"""WITH RECURSIVE {HIERARCHY_SQL}, up AS (SELECT node_id, node_id AS ancestor_id, 0 AS distance FROM tree
 UNION ALL SELECT u.node_id, t.parent_node_id, distance + 1 FROM up u JOIN tree t ON u.ancestor_id = t.node_id WHERE t.parent_node_id IS NOT NULL) SELECT * FROM up"""


def tree_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.siblings(hierarchy(spark, sf_dir))


TREE_SIBLINGS_SQL = f"WITH {HIERARCHY_SQL} SELECT a.node_id, b.node_id AS sibling_id FROM tree a JOIN tree b ON a.parent_node_id = b.parent_node_id"


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as evidence for suppliers: the return flag is the kind of source, one less the discount the confidence."""
    links = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("entity_id"), F.col("l_returnflag").alias("source_kind"), F.when(F.col("l_linenumber") < 7, 1 - F.col("l_discount")).alias("confidence_score"))
    out = knowledge.evidence_scores(links, {"A": 1.0, "N": 0.5, "R": 0.25}, bonus=0.0001, most=1.0)
    return out.select("entity_id", F.round("confidence", 6).alias("confidence"), "support", "scored")


EVIDENCE_SQL = """WITH l AS (SELECT l_suppkey AS entity_id, CASE l_returnflag WHEN 'A' THEN 1.0 WHEN 'N' THEN 0.5 WHEN 'R' THEN 0.25 ELSE 1.0 END::DOUBLE AS w, CASE WHEN l_linenumber < 7 THEN 1 - l_discount END AS c FROM lineitem)
SELECT entity_id, round(least(1.0, sum(w * c) / sum(CASE WHEN c IS NOT NULL THEN w END) + 0.0001 * greatest(count(c) - 1, 0)), 6) AS confidence, count(*) AS support, count(c) AS scored FROM l GROUP BY 1"""


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("entity_id"), F.col("p_type").alias("entity_type"))
    supplier = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("entity_id"), F.concat(F.lit("nation"), F.col("s_nationkey") % 5).alias("entity_type"))
    return part.unionByName(supplier)


def _supplies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct relations of lines. Rows are dealt out by numbers first, to parts that are not put together again: a task then holds
    its part's distinct rows only, where a map over a file's split would hold nearly all of the split, as few of them repeat."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_returnflag")
    parts = 2 * max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    kept = lines.repartition(parts, *lines.columns).distinct()
    return kept.select(F.concat(F.lit("s"), "l_suppkey").alias("source_id"), F.concat(F.lit("p"), "l_partkey").alias("target_id"), F.col("l_returnflag").alias("relation_type"))


ENTITIES_SQL = """entities AS (SELECT 'p' || p_partkey AS entity_id, p_type AS entity_type FROM part UNION ALL SELECT 's' || s_suppkey, 'nation' || s_nationkey % 5 FROM supplier),
supplies AS (SELECT DISTINCT 's' || l_suppkey AS source_id, 'p' || l_partkey AS target_id, l_returnflag AS relation_type FROM lineitem)"""


def relation_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = knowledge.observed_types(_supplies(spark, sf_dir), _entities(spark, sf_dir))
    return out.select("relation_type", F.array_join("source_types", ",").alias("source_types"), F.array_join("target_types", ",").alias("target_types"))


RELATION_TYPES_SQL = f"""WITH {ENTITIES_SQL} SELECT relation_type, array_to_string(list_sort(list_distinct(list(s.entity_type))), ',') AS source_types, array_to_string(list_sort(list_distinct(list(t.entity_type))), ',') AS target_types
FROM supplies JOIN entities s ON source_id = s.entity_id JOIN entities t ON target_id = t.entity_id GROUP BY 1"""


def solved_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    schemas = spark.createDataFrame([("A", ["nation1", "nation2"], []), ("R", [], None)], "name string, allowed_source_types array<string>, allowed_target_types array<string>")
    return knowledge.allowed_relations(_supplies(spark, sf_dir), _entities(spark, sf_dir), schemas).select("source_id", "target_id", "relation_type", "source_type", "target_type")


SOLVED_SQL = f"""WITH {ENTITIES_SQL} SELECT source_id, target_id, relation_type, s.entity_type AS source_type, t.entity_type AS target_type
FROM supplies JOIN entities s ON source_id = s.entity_id JOIN entities t ON target_id = t.entity_id WHERE relation_type <> 'A' OR s.entity_type IN ('nation1', 'nation2')"""


def required(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that all events of a type carry."""
    rows = table(spark, sf_dir, "events").select("event_type", "user_id", F.when(F.col("value") > 1, F.col("value")).alias("value"), "props")
    return knowledge.required_fields(rows, "event_type", ["user_id", "value", "props"]).select("event_type", F.array_join("required", ",").alias("required"))


REQUIRED_SQL = """SELECT event_type, array_to_string(list_sort(list_filter([CASE WHEN count(user_id) = count(*) THEN 'user_id' END, CASE WHEN count(CASE WHEN value > 1 THEN 1 END) = count(*) THEN 'value' END, CASE WHEN count(props) = count(*) THEN 'props' END], lambda x: x IS NOT NULL)), ',') AS required FROM events GROUP BY 1"""


def identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capitalized words of documents as mentions; same name and language is one identity."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("entity_type"), F.explode(F.array_distinct(F.expr(r"regexp_extract_all(text, '(^|[^\\p{L}])([A-Z][a-z]{5,})($|[^\\p{L}])', 2)"))).alias("mention"))
    mentions = rows.select(F.col("doc_id").cast("string").alias("span_id"), "entity_type", "mention")
    groups = knowledge.identity_groups(mentions, F.lower(text.collapsed(F.col("mention"))), least=2)
    return groups.select(ident.concept_id(F.col("entity_type"), F.col("name")).alias("identity_id"), "name", "entity_type", "n", "span_id")


IDENTITIES_SQL = """WITH m AS (SELECT DISTINCT doc_id::VARCHAR AS span_id, lang AS entity_type, lower(unnest(regexp_extract_all(text, '(^|[^\\p{L}])([A-Z][a-z]{5,})($|[^\\p{L}])', 2))) AS name FROM documents),
g AS (SELECT name, entity_type, span_id, count(*) OVER (PARTITION BY name, entity_type) AS n FROM m QUALIFY n >= 2),
h AS (SELECT *, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(entity_type || ':' || regexp_replace(name, '[^a-z0-9]', '', 'g'))) AS s FROM g)
SELECT substr(s,1,8) || '-' || substr(s,9,4) || '-5' || substr(s,14,3) || '-' || substr('89ab', ('0x' || substr(s,17,1))::INTEGER % 4 + 1, 1) || substr(s,18,3) || '-' || substr(s,21,12) AS identity_id, name, entity_type, n, span_id FROM h"""


def reviewed_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Does a document's text hold two words? Some claims lack a subject, some a quote."""
    n = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(n % 7 == 0, " ").otherwise(" The").alias("subject"), F.lit("QUE ").alias("object"), F.when(n % 11 != 0, F.col("text")).alias("quote"))
    return knowledge.review(rows).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


REVIEWED_SQL = """SELECT CASE WHEN doc_id % 11 = 0 OR q IS NULL THEN 'pending' WHEN doc_id % 7 = 0 THEN 'uncertain' WHEN trim(q) = '' THEN 'unsupported' WHEN contains(q, 'the') AND contains(q, 'que') THEN 'supported' WHEN NOT contains(q, 'the') AND NOT contains(q, 'que') THEN 'unsupported' ELSE 'uncertain' END AS verdict, count(*) AS n
FROM (SELECT doc_id, lower(text) AS q FROM documents) GROUP BY 1"""


def merged_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as mentions of a customer: date as place, priority as source."""
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("scope"), F.col("o_orderkey").alias("mention_id"), (F.col("o_orderkey") % 23).alias("start"), (F.col("o_orderkey") % 23 + 2 + F.col("o_orderkey") % 5).alias("stop"), F.substr("o_orderpriority", F.lit(1), F.lit(1)).cast("int").alias("priority"), F.col("o_orderstatus").alias("label"),
        F.sha2(F.concat_ws("|", F.col("o_orderkey") % 23, F.col("o_orderkey") % 5, "o_orderstatus", "o_orderpriority"), 256).alias("fingerprint"))
    return knowledge.merge_mentions(rows, ["scope"])


MERGED_SQL = """WITH RECURSIVE m AS (SELECT o_custkey AS scope, o_orderkey AS id, o_orderkey % 23 AS a, o_orderkey % 23 + 2 + o_orderkey % 5 AS b, o_orderstatus AS l, substr(o_orderpriority, 1, 1)::INTEGER AS p, sha256(concat_ws('|', o_orderkey % 23, o_orderkey % 5, o_orderstatus, o_orderpriority)) AS f FROM orders),
o AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY p, f, id) AS n, {'id': id, 'a': a, 'b': b, 'l': l, 'f': f} AS x FROM m),
k AS (SELECT scope, 1::BIGINT AS n, [x] AS kept FROM o WHERE n = 1 UNION ALL SELECT k.scope, o.n, CASE WHEN len(list_filter(kept, lambda y: o.a < y.b AND y.a < o.b)) = 0 THEN list_append(kept, o.x) ELSE kept END FROM k JOIN o ON o.scope = k.scope AND o.n = k.n + 1),
w AS (SELECT scope, arg_max(kept, n) AS kept FROM k GROUP BY 1), r AS (SELECT o.*, list_filter(kept, lambda y: o.a < y.b AND y.a < o.b)[1] AS y FROM o JOIN w USING (scope))
SELECT scope, id AS mention_id, CASE WHEN id = y.id THEN 'selected' WHEN f = y.f THEN 'duplicate' WHEN a = y.a AND b = y.b THEN CASE WHEN l = y.l THEN 'grouped' ELSE 'suppressed' END WHEN (y.a < a AND b < y.b) OR (a < y.a AND y.b < b) THEN 'nested' ELSE 'overlap' END AS outcome, CASE WHEN id <> y.id THEN y.id END AS winner FROM r"""


QUERIES = {
    "exact_segments": (exact_segments, EXACT_SEGMENTS_SQL),
    "heading_chunks": (heading_chunks, HEADING_CHUNKS_SQL),
    "turn_overlap": (turn_overlap, TURN_OVERLAP_SQL),
    "token_segments": (segments, SEGMENTS_SQL),
    "heading_tree": (heading_tree, HEADING_TREE_SQL),
    "tree_ancestors": (tree_ancestors, TREE_ANCESTORS_SQL),
    "tree_siblings": (tree_siblings, TREE_SIBLINGS_SQL),
    "evidence_scores": (evidence, EVIDENCE_SQL),
    "relation_types": (relation_types, RELATION_TYPES_SQL),
    "solved_relations": (solved_relations, SOLVED_SQL),
    "required_fields": (required, REQUIRED_SQL),
    "identity_groups": (identities, IDENTITIES_SQL),
    "reviewed_claims": (reviewed_claims, REVIEWED_SQL),
    "merged_mentions": (merged_mentions, MERGED_SQL),
}
