"""Bundles of Markdown files with front matter: scan, parse, serialize; vector collections; JSON results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Files of a bundle that are no documents, and folders that are skipped.
SKIPPED_NAMES, SKIPPED_FOLDERS = ("index.md", "log.md"), (".obsidian", ".staging")


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """path, name, front (text or null), body, error: every document file of a bundle; malformed ones are marked, not fatal."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    rows = files.select(F.input_file_name().alias("path"), F.replace(F.col("value"), F.lit("\r\n"), F.lit("\n")).alias("value"))
    name = F.element_at(F.split("path", "/"), -1)
    rows = rows.filter(~name.isin(*SKIPPED_NAMES) & ~F.col("path").rlike("/(" + "|".join(f.replace(".", r"\.") for f in SKIPPED_FOLDERS) + ")/"))
    return split_front(rows.withColumn("name", name), "value")


def split_front(rows: DataFrame, column: str) -> DataFrame:
    """Adds front, body and error for a column of whole files."""
    opened = F.col(column).startswith("---\n")
    front = F.regexp_extract(column, r"(?s)\A---\n(.*?)\n---(\n|\z)", 1)
    closed = F.col(column).rlike(r"(?s)\A---\n.*?\n---(\n|\z)")
    return rows.select(
        *(c for c in rows.columns if c != column), F.when(opened & closed, front).alias("front"), F.when(opened & closed, F.regexp_replace(column, r"(?s)\A---\n.*?\n---(\n|\z)", "")).otherwise(F.col(column)).alias("body"),
        F.when(opened & ~closed, "front matter is not closed").when(~opened, "no front matter").alias("error"),
    )


def front_fields(front):
    """Scalar fields of front matter (`key: value` lines) as a map; of repeated keys the first."""
    lines = F.filter(F.split(F.coalesce(front, F.lit("")), "\n"), lambda x: x.rlike(r"^[A-Za-z_][A-Za-z0-9_-]*:"))
    pairs = F.transform(lines, lambda x: F.struct(F.substring_index(x, ":", 1).alias("k"), F.regexp_replace(F.trim(F.substr(x, F.instr(x, ":") + 1)), "^[\"'](.*)[\"']$", "$1").alias("v")))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda p: p["k"] == k), 1)["v"]))


def paragraphs(rows: DataFrame, key: str, body: str = "body") -> DataFrame:
    """key, number (P1, P2, ...), heading, text: blocks between blank lines under their last heading."""
    blocks = rows.select(key, F.posexplode(F.filter(F.transform(F.split(body, r"\n\s*\n"), lambda b: F.regexp_replace(b, r"\A\s+|\s+\z", "")), lambda b: b != "")).alias("at", "block"))
    w = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    is_heading = F.col("block").rlike("^#+ ")
    with_heading = blocks.withColumn("heading", F.last(F.when(is_heading, F.regexp_replace("block", r"(?s)^#+ +([^\n]*).*", "$1")), ignorenulls=True).over(w))
    text = with_heading.withColumn("text", F.when(is_heading, F.trim(F.regexp_replace("block", r"^#+ [^\n]*\n?", ""))).otherwise(F.col("block"))).filter("text <> ''")
    number = F.row_number().over(Window.partitionBy(key).orderBy("at"))
    return text.select(key, F.concat(F.lit("P"), number).alias("number"), "heading", "text")


def serialized(nodes: DataFrame, key: str) -> DataFrame:
    """key, body: nodes (ordinal, heading_path, text) as Markdown; a heading stands where the path changes."""
    w = Window.partitionBy(key).orderBy("ordinal")
    changed = ~F.lag("heading_path").over(w).eqNullSafe(F.col("heading_path")) | (F.row_number().over(w) == 1)
    parts = F.split("heading_path", " > ")
    head = F.concat(F.repeat(F.lit("#"), F.least(F.size(parts), F.lit(6))), F.lit(" "), F.element_at(parts, -1), F.lit("\n\n"))
    lines = nodes.withColumn("line_", F.concat(F.when(changed & F.col("heading_path").isNotNull(), head).otherwise(F.lit("")), F.col("text")))
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", "line_")))
    return lines.groupBy(key).agg(F.concat(F.array_join(F.transform(ordered, lambda x: x["line_"]), "\n\n"), F.lit("\n")).alias("body"))


def write_collection(vectors: DataFrame, folder: str, collection: str) -> None:
    """Replace the vectors of one collection; others stay."""
    vectors.withColumn("collection", F.lit(collection)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("collection").parquet(folder)


def read_collection(spark: SparkSession, folder: str, collection: str) -> DataFrame:
    return spark.read.parquet(folder).filter(F.col("collection") == collection).drop("collection")


def as_json(rows: DataFrame) -> DataFrame:
    """One JSON object a row."""
    return rows.select(F.to_json(F.struct("*")).alias("json"))
