"""Reading a knowledge graph by given keywords."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

#: What each mode returns.
MODES = {"naive": ("chunk",), "local": ("entity", "chunk"), "global": ("relation", "chunk"), "mix": ("entity", "relation", "chunk")}


def cleaned(words: Sequence[str], label: str) -> tuple[str, ...]:
    """Keywords without blanks around them, empty ones dropped, each once."""
    if isinstance(words, (str, bytes)):
        raise ValueError(f"{label} must be a list of texts")
    if any(not isinstance(w, str) for w in words):
        raise ValueError(f"{label} must hold texts only")
    return tuple(dict.fromkeys(w.strip() for w in words if w.strip()))


def matched(column: Column, words: Sequence[str]) -> Column:
    """How many of the keywords stand in the text as whole words in a row, whatever their case."""
    padded = F.concat(F.lit(" "), F.array_join(text.tokens(column), " "), F.lit(" "))
    phrase = lambda w: F.concat(F.lit(" "), F.array_join(text.tokens(F.lit(w)), " "), F.lit(" "))
    hits = [F.when((F.length(phrase(w)) > 2) & F.contains(padded, phrase(w)), 1).otherwise(0) for w in words]
    return sum(hits, F.lit(0))


def context(query: str, low: Sequence[str], high: Sequence[str], chunks: DataFrame, entities: DataFrame | None = None, relations: DataFrame | None = None, mode: str = "naive", top_k: int = 10, chunk_top_k: int = 10) -> DataFrame:
    """kind, id, matched, score, rank: what the graph holds on a question whose keywords are given, and no answer.

    chunks: chunk_id, text; entities: entity_id, name; relations: relation_id, keywords. Entities are held against the low-level keywords, relations against
    the high-level ones, chunks against both; score is the share that stands in the text, and rows without any are left out. Equal ones go by id. A
    blank question, no keyword at all, an unknown mode and limits below 1 raise. Each kind is a top-k of the partitions, merged."""
    if not isinstance(query, str) or not query.strip():
        raise ValueError("the question must not be blank")
    low, high = cleaned(low, "low"), cleaned(high, "high")
    if not low and not high:
        raise ValueError("at least one keyword is needed")
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    if min(top_k, chunk_top_k) < 1:
        raise ValueError("limits must be at least 1")
    inputs = {"entity": (entities, "entity_id", "name", low, top_k), "relation": (relations, "relation_id", "keywords", high, top_k), "chunk": (chunks, "chunk_id", "text", tuple(dict.fromkeys(low + high)), chunk_top_k)}
    parts = []
    for kind in MODES[mode]:
        rows, key, column, words, limit = inputs[kind]
        if rows is None:
            raise ValueError(f"mode {mode} needs a table of {kind} rows")
        counted = rows.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"), matched(F.col(column), words).alias("matched")).filter("matched > 0")
        best = counted.orderBy(F.desc("matched"), "id").limit(limit)
        placed = best.agg(F.array_sort(F.collect_list(F.struct((-F.col("matched")).alias("n"), "id", "kind"))).alias("x")).select(F.posexplode("x").alias("at", "x"))  # `limit` rows
        parts.append(placed.select("x.kind", "x.id", (-F.col("x.n")).alias("matched"), F.round(-F.col("x.n") / max(len(words), 1), 6).alias("score"), (F.col("at") + 1).alias("rank")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
