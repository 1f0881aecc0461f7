"""Queries of spans by an inverted index and of keywords by a lexicon, with their SQL oracles (scans)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import words
from ..sources import postings, store
from .model import SPANS_SQL, spans, table

#: Terms, two choices with a phrase and a term left out, a piece of a term, a piece with a whole term inside.
ASKED = {"terms": "ing that the", "choices": 'enc or "of the" -and', "piece": "hor", "pieces": "e of th"}


def indexed_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All spans that match each of the queries, over an index of two segments."""
    docs = table(spark, sf_dir, "documents")
    index = postings.Index(spark, store.new_folder(spark, "postings"), buckets=32, slices=16)
    for half in (0, 1):
        rows = spans(docs.filter(F.pmod(F.col("doc_id"), F.lit(2)) == half)).select(F.concat_ws(":", "doc_id", "ordinal").alias("span_id"), "doc_id", "ordinal", "start_offset", "raw_text")
        index.add(rows, f"half{half}")
    reader = index.opened()
    found = [reader.matches(query).select(F.lit(name).alias("query_id"), "doc_id", "ordinal", "start_offset", F.length("raw_text").alias("letters")) for name, query in ASKED.items()]
    return reduce(DataFrame.unionByName, found)


INDEXED_SQL = f"""WITH {SPANS_SQL},
t AS (SELECT *, list_filter(regexp_split_to_array(lower(raw_text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS tokens FROM spans),
u AS (SELECT *, ' ' || array_to_string(tokens, ' ') || ' ' AS joined FROM t),
hits AS (SELECT 'terms' AS query_id, * FROM u WHERE raw_text ILIKE '%ing that the%' OR list_has_all(tokens, ['ing', 'that', 'the'])
 UNION ALL SELECT 'choices', * FROM u WHERE raw_text ILIKE '%enc or "of the" -and%' OR list_contains(tokens, 'enc') OR (contains(joined, ' of the ') AND NOT list_contains(tokens, 'and'))
 UNION ALL SELECT 'piece', * FROM u WHERE raw_text ILIKE '%hor%'
 UNION ALL SELECT 'pieces', * FROM u WHERE raw_text ILIKE '%e of th%' OR list_has_all(tokens, ['e', 'of', 'th']))
SELECT query_id, doc_id, ordinal::INTEGER AS ordinal, start_offset, length(raw_text)::INTEGER AS letters FROM hits"""


def item_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords of all benchmark items, whole, by a lexicon counted over all documents."""
    known = words.lexicon(table(spark, sf_dir, "documents"))
    return words.keywords(table(spark, sf_dir, "benchmark"), known, "item_id", stop_words=("the", "of", "and"), letters=None)


ITEM_KEYWORDS_SQL = r"""WITH w AS (SELECT item_id, unnest(ws) AS word, unnest(range(len(ws))) AS part FROM (SELECT item_id, regexp_extract_all(regexp_replace(nfc_normalize(text), '[\p{Cc}\p{Cf}\p{Co}]', '', 'g'), '[\p{L}\p{N}]+') AS ws FROM benchmark))
SELECT item_id, word, min(part)::INTEGER AS part, 0 AS start FROM w WHERE length(word) >= 2 AND word NOT IN ('the', 'of', 'and') GROUP BY 1, 2"""

QUERIES = {"indexed_spans": (indexed_spans, INDEXED_SQL), "item_keywords": (item_keywords, ITEM_KEYWORDS_SQL)}
