"""Retrieval: keyword, summary and vector top-k."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, vectors


def choices(query: str) -> list[list[tuple[str, list[str]]]]:
    """The query's choices, parted by or: pairs of kind (word, minus, phrase) and lower-case words."""
    out, current = [], []
    for phrase, minus, word in re.findall(r'"([^"]*)"|(-?)(\S+)', query):
        if not phrase and word.lower() == "or":
            out, current = [*out, current], []
        elif phrase:
            current.append(("phrase", [w.lower() for w in re.findall(r"\w+", phrase)]))
        else:
            current += [("minus" if minus else "word", [w]) for w in re.findall(r"\w+", word.lower())]
    return [*out, current]


def all_terms(column: Column, query: str) -> Column:
    """Every plain term of the query is a token of the text; -term must not be; "a b" stands in sequence; or starts another choice."""
    found = text.tokens(column)
    joined = F.concat(F.lit(" "), F.array_join(found, " "), F.lit(" "))
    out = F.lit(False)
    for terms in choices(query):
        both = F.lit(bool(terms))
        for kind, words in terms:
            hit = joined.contains(f" {' '.join(words)} ") if kind == "phrase" else F.array_contains(found, words[0])
            both = both & (~hit if kind == "minus" else hit)
        out = out | both
    return out


def matches(column: Column, query: str) -> Column:
    """The text holds the query as a substring, or all its terms."""
    return column.ilike(f"%{query}%") | all_terms(column, query)


def best(hits: DataFrame, query: str, limit: int, column: str = "raw_text") -> DataFrame:
    """The best of the rows that match: a top-k of each partition, merged (no full sort)."""
    scored = hits.withColumn("score", F.round(text.match_score(F.col(column), query), 6))
    page = F.col("page_no") if "page_no" in hits.columns else F.lit(None).cast("int")
    return scored.orderBy(F.desc("score"), page.asc_nulls_last(), F.asc("start_offset"), F.asc("doc_id"), F.asc("ordinal")).limit(limit)


def keyword_search(spans: DataFrame, query: str, limit: int = 50, version_id: str | None = None) -> DataFrame:
    """Spans that hold the query as a substring or all its terms, best first.

    The cheap predicate runs in the scan's stage; only what it lets through is scored."""
    rows = spans if version_id is None else spans.filter(F.col("version_id") == version_id)
    return best(rows.filter(matches(F.col("raw_text"), query)), query, limit)


def summary_search(nodes: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Nodes by similarity of their summaries; nodes without one are left out."""
    scored = nodes.filter(F.trim(F.coalesce("summary_text", F.lit(""))) != "").withColumn("score", F.round(text.match_score(F.col("summary_text"), query), 6))
    return scored.filter("score > 0").orderBy(F.desc("score"), "level_no", "node_id").limit(limit)


def tree_fallback(nodes: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Nodes by word overlap of summary and query; those without any are dropped."""
    scored = nodes.withColumn("score", F.round(text.term_jaccard(F.col("summary_text"), F.lit(query)), 6)).filter("score > 0")
    return scored.orderBy(F.desc("score"), "node_id").limit(limit)


def nearest(vectors_: DataFrame, query: list[float], limit: int, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Exact nearest vectors by cosine similarity (higher is better); the query is a literal."""
    wanted = F.array(*(F.lit(float(x)) for x in query))
    scored = vectors_.withColumn("score", F.round(vectors.cosine(vectors.doubles(F.col(vector)), wanted), 6))
    return scored.orderBy(F.desc("score"), id_column).limit(limit)


def near_pages(nodes: DataFrame, page: int, distance: int) -> DataFrame:
    """Nodes whose first page lies near; nodes without a page are left out."""
    return nodes.filter(F.abs(F.col("page_start") - page) <= distance)


def marked_pruned(hits: DataFrame, least: float) -> DataFrame:
    """Weak hits are marked, none dropped; a missing score counts as 0."""
    return hits.withColumn("pruned", F.coalesce("score", F.lit(0.0)) < least)
