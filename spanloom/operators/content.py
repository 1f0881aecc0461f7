"""Content of documents by page or line, merging of leaf hits, batches of a processing line."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text
from .reconcile import STAGES


def of_pages(content: DataFrame, expression: str, page: str = "page_no") -> DataFrame:
    """Rows of exactly the pages that an expression names, in order."""
    wanted = content.sparkSession.range(1).select(F.explode(text.page_list(F.lit(expression))).alias(page))
    return content.join(F.broadcast(wanted), page, "left_semi").orderBy(page)  # as many rows as the expression has pages


def of_lines(content: DataFrame, expression: str, line: str = "line_no") -> DataFrame:
    """Rows from the least to the greatest line that an expression names, each line once."""
    lines = content.sparkSession.range(1).select(text.page_list(F.lit(expression)).alias("x")).select(F.array_min("x").alias("low"), F.array_max("x").alias("high"))
    return content.join(F.broadcast(lines), F.col(line).between(F.col("low"), F.col("high"))).drop("low", "high").dropDuplicates([line]).orderBy(line)  # one row


def merged_leaves(hits: DataFrame, chunks: DataFrame, ratio: float = 0.5) -> DataFrame:
    """chunk_id, score: where more than `ratio` of a parent's children are hit, the parent with their mean score
    stands for them. chunks: chunk_id, parent_id (null for whole ones)."""
    sizes = chunks.filter("parent_id is not null").groupBy("parent_id").agg(F.count(F.lit(1)).alias("children"))
    known = hits.join(chunks.select("chunk_id", "parent_id"), "chunk_id")
    full = known.groupBy("parent_id").agg(F.count(F.lit(1)).alias("hit"), F.avg("score").alias("score")).join(sizes, "parent_id").filter(F.col("hit") > ratio * F.col("children"))
    parents = full.select(F.col("parent_id").alias("chunk_id"), "score")
    return known.join(full.select("parent_id"), "parent_id", "left_anti").select("chunk_id", "score").unionByName(parents)


def without_fields(column: Column, names: tuple[str, ...]) -> Column:
    """JSON text without the named fields at any depth; what is no JSON becomes null."""

    def drop(value):
        if isinstance(value, dict):
            return {k: drop(v) for k, v in value.items() if k not in names}
        return [drop(v) for v in value] if isinstance(value, list) else value

    def of(value: str) -> str | None:
        try:
            return json.dumps(drop(json.loads(value)), ensure_ascii=False)
        except ValueError:
            return None

    @F.pandas_udf(StringType())
    def udf(values: pd.Series) -> pd.Series:
        return values.map(of, na_action="ignore")

    return udf(column)


def advanced(versions: DataFrame, failures: DataFrame) -> DataFrame:
    """Versions after a batch: each goes to its next stage, or to failed if it is among the failures; complete and
    failed ones stay, and a failure holds no other version back. failures: version_id."""
    stages = F.array(*(F.lit(s) for s in STAGES))
    at = F.array_position(stages, F.col("status"))
    after = F.element_at(stages, F.least(at + 1, F.lit(len(STAGES))).cast("int"))
    joined = versions.join(failures.select("version_id", F.lit(True).alias("failed_")).distinct(), "version_id", "left")
    open_ = ~F.col("status").isin("failed", STAGES[-1])
    moved = F.when(open_ & F.coalesce("failed_", F.lit(False)), "failed").when(open_ & (at > 0), after).otherwise(F.col("status"))
    return joined.withColumns({"previous": F.col("status"), "status": moved}).drop("failed_")


def counters(versions: DataFrame) -> DataFrame:
    """processed, failed, total of a batch."""
    changed = F.col("previous") != F.col("status")
    return versions.agg(F.count_if(changed & (F.col("status") != "failed")).alias("processed"), F.count_if(changed & (F.col("status") == "failed")).alias("failed"), F.count(F.lit(1)).alias("total"))
