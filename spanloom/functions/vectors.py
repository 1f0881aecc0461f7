"""Vector columns (arrays of double)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def _checked(a: Column, b: Column, value: Column) -> Column:
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors of different length")).cast("double")).otherwise(value)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for a vector of norm 0."""
    scale = norm(a) * norm(b)
    return _checked(a, b, F.when(scale > 0, dot(a, b) / scale).otherwise(0.0))


def euclid(a: Column, b: Column) -> Column:
    return _checked(a, b, F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)))


def centroids(vectors: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """Element-wise mean by key: partial sums by (key, position), so no key gathers its vectors."""
    parts = vectors.select(key, F.posexplode(doubles(F.col(vector))).alias("i", "x")).groupBy(key, "i").agg(F.avg("x").alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "x")))
    return parts.groupBy(key).agg(F.transform(ordered, lambda s: s["x"]).alias("centroid"))


def embedding_tokens(text: Column) -> Column:
    """The text without white space, its letters and its pairs of letters."""
    compact = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", "")
    cut = lambda n: F.transform(F.sequence(F.lit(1), F.length(compact) - (n - 1)), lambda i: F.substr(compact, i, F.lit(n)))
    pairs = F.when(F.length(compact) > 1, cut(2)).otherwise(F.array().cast("array<string>"))
    return F.when(compact == "", F.array().cast("array<string>")).otherwise(F.concat(F.array(compact), cut(1), pairs))


def bound(value: Column, of) -> Column:
    """of(value), with value computed once: an expression that a lambda uses twice is computed twice."""
    return F.element_at(F.transform(F.array(value), of), 1)


def hashed_embedding(tokens: Column, dimensions: int = 16) -> Column:
    """Each token adds the bytes of its SHA-256, over 255; the sum is brought to length 1."""
    byte = lambda digest, i: F.conv(F.substr(digest, F.lit(2 * i + 1), F.lit(2)), 16, 10).cast("double") / 255.0
    zero = F.array(*(F.lit(0.0) for _ in range(dimensions)))
    digests = F.transform(tokens, lambda t: F.sha2(t, 256))
    total = F.aggregate(digests, zero, lambda s, d: F.zip_with(s, F.array(*(byte(d, i) for i in range(dimensions))), lambda x, y: x + y))
    unit = lambda v: bound(F.struct(v.alias("v"), norm(v).alias("n")), lambda x: F.transform(x["v"], lambda y: F.when(x["n"] > 0, y / x["n"]).otherwise(0.0)))
    return bound(total, unit)
