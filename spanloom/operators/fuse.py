"""Fusion of ranked hits from several retrieval paths.

Hits: path, ordinal (place in its list), text (or another merge key), score (nullable)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import store


def normalized(hits: DataFrame, clip: bool = True) -> DataFrame:
    """Adds norm: min-max of the score by path, to 10 digits. A single hit gets 1, equal
    scores stay as they are; both clipped to [0, 1]; null counts as 0."""
    score = F.coalesce("score", F.lit(0.0))
    ends = hits.groupBy("path").agg(F.min(score).alias("_low"), F.max(score).alias("_high"), F.count(F.lit(1)).alias("_n"))  # a row a path
    low, high = F.col("_low"), F.col("_high")
    norm = F.when(F.col("_n") == 1, 1.0).when(low == high, score).otherwise(F.round((score - low) / F.nullif(high - low, F.lit(0.0)), 10))
    return hits.join(ends, "path").withColumn("norm", F.greatest(F.lit(0.0), F.least(F.lit(1.0), norm)) if clip else norm).drop("_low", "_high", "_n")


#: Buckets of keys; a bucket of more rows than HEAVY times the mean, and more than FEW, may hold a key of very many.
KEY_BUCKETS, HEAVY, FEW = 4096, 4, 10_000


def ranked(hits: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Adds rank: the place within the key by `order`, whose last columns tell equal rows apart. Rows are counted by buckets of
    the key; those of buckets with a common share are numbered key by key, the others, among them every key of very many rows,
    by ranges (`ranked_by_ranges`), so a long list never falls to one task."""
    held = store.staged(hits, "hits")
    bucket = F.pmod(F.xxhash64(key), F.lit(KEY_BUCKETS))
    sizes = {r["_bucket"]: r["n"] for r in held.groupBy(bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a bucket
    most = max(FEW, HEAVY * sum(sizes.values()) / KEY_BUCKETS)
    heavy = [b for b, n in sizes.items() if n > most]
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    if not heavy:
        return held.withColumn("rank", place)
    long = ranked_by_ranges(held.filter(bucket.isin(heavy)), key, order)
    return long if len(heavy) == len(sizes) else held.filter(~bucket.isin(heavy)).withColumn("rank", place).unionByName(long)


def ranked_by_ranges(hits: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The same for keys of any number of rows. Rows are dealt out by ranges
    of key and whole order, so neither a long list nor one of few scores falls to one task; each range is sorted, numbered
    and written once, and shifted by the rows of the key in the ranges before it, which are few numbers."""
    parts = max(8, int(hits.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = hits.repartitionByRange(parts, F.col(key), *order).sortWithinPartitions(F.col(key), *order)
    placed = store.staged(dealt.withColumn("_id", F.monotonically_increasing_id()), "ranked").withColumns({"_part": F.shiftrightunsigned("_id", 33), "_at": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))})
    sums = placed.groupBy(key, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    above = F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = sums.select(F.col(key).alias("_key"), F.col("_part").alias("_of"), (above - F.col("_first") + 1).alias("_shift"))
    joined = placed.join(shifts, placed[key].eqNullSafe(shifts["_key"]) & (placed["_part"] == shifts["_of"]))
    return joined.withColumn("rank", (F.col("_at") + F.col("_shift")).cast("int")).drop("_id", "_part", "_at", "_key", "_of", "_shift")


def best_of_path(hits: DataFrame, key: str) -> DataFrame:
    """One hit for each path and key: the best score, null the least, the first of equals."""
    w = Window.partitionBy("path", key).orderBy(F.desc_nulls_last("score"), "ordinal")
    return hits.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def fuse(hits: DataFrame, key: str = "text", k: int = 60, bonus: float = 0.1, limit: int | None = None) -> DataFrame:
    """key, fused, score, source_paths: reciprocal ranks (from 1) summed over paths, more for
    keys found by several paths; ordered by fused score, raw score and key."""
    placed = ranked(best_of_path(normalized(hits), key), "path", [F.desc("norm"), F.asc("ordinal")])
    merged = placed.groupBy(key).agg(
        F.sum(1.0 / (k + F.col("rank"))).alias("sum"), F.count(F.lit(1)).alias("paths"), F.max("score").alias("score"), F.array_join(F.array_sort(F.collect_set("path")), ",").alias("source_paths")
    )
    fused = merged.select(key, F.round(F.col("sum") * (1 + bonus * (F.col("paths") - 1)), 10).alias("fused"), F.round("score", 6).alias("score"), "source_paths")
    ordered = fused.orderBy(F.desc("fused"), F.desc_nulls_last("score"), key)
    return ordered if limit is None else ordered.limit(limit)


def fuse_titles(first: DataFrame, second: DataFrame, weights=(0.5, 0.5), k: int = 60) -> DataFrame:
    """Two title lists (title, ordinal); ranks start at 0; a title counts once, at its first place."""
    place = lambda df, name: df.groupBy("title").agg(F.min("ordinal").alias(name))
    part = lambda name, w: F.coalesce(w / (k + F.col(name)), F.lit(0.0))
    joined = place(first, "a").join(place(second, "b"), "title", "full")
    return joined.select("title", F.round(part("a", weights[0]) + part("b", weights[1]), 10).alias("score")).orderBy(F.desc("score"), "title")


def weighted(columns: dict[str, float], optional: str):
    """Weighted sum; where the optional score is missing, its weight goes to the others in proportion."""
    total = sum(columns.values())
    rest = total - columns[optional]
    every = sum((F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in columns.items()), F.lit(0.0))
    others = sum((F.coalesce(F.col(c), F.lit(0.0)) * (w * total / rest) for c, w in columns.items() if c != optional), F.lit(0.0))
    return F.when(F.col(optional).isNull(), others).otherwise(every)
