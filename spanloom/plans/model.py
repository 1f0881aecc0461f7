"""The document model over the driver's tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from ..functions import ident


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(texts: pa.Array) -> pa.Array:
    lists = pc.split_pattern(texts, "\n")
    first, lines = lists.offsets.to_numpy(), lists.values
    sizes = np.nan_to_num(pc.utf8_length(lines).to_numpy(zero_copy_only=False)).astype("int64") + 1
    before = np.concatenate([[0], np.cumsum(sizes)])
    own = before[:-1].copy()
    own[first[0] : first[-1]] -= np.repeat(before[first[:-1]], np.diff(first))
    items = pa.StructArray.from_arrays([pa.array(own), lines], names=["start", "line"])
    return pa.ListArray.from_arrays(lists.offsets, items, mask=pc.is_null(texts))


@F.arrow_udf(ArrayType(StructType([StructField("start", LongType()), StructField("line", StringType())])))
def lines_with_starts(texts: pa.Array) -> pa.Array:
    """Lines of each text with their offsets (code points): running sums over a whole batch, less the sum at each text's first line."""
    return _lines(texts)


#: Texts whose lines a worker holds at a time.
TEXTS = 256


def line_rows(docs: DataFrame, *keys: str) -> DataFrame:
    """keys, ordinal, start, line: a row a line of each text, with its offset (code points). A worker sends on the lines of a few texts at
    a time, so it never holds those of a whole batch beside the batch."""
    schema = StructType([*(docs.schema[k] for k in keys), StructField("ordinal", IntegerType()), StructField("start", LongType()), StructField("line", StringType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(0, batch.num_rows, TEXTS):
                few = batch.slice(n, TEXTS)
                texts = pc.fill_null(few.column(len(keys)), "")
                lists = _lines(texts)
                owner, items = lists.value_parent_indices().to_numpy(), lists.flatten()
                ordinal = np.arange(len(owner)) - np.searchsorted(owner, owner)
                rows = [*(few.column(i).take(pa.array(owner)) for i in range(len(keys))), pa.array(ordinal, pa.int32()), items.field(0), items.field(1)]
                known = pc.is_valid(few.column(len(keys))).take(pa.array(owner))
                yield pa.RecordBatch.from_arrays(rows, names=schema.names).filter(known)

    return docs.select(*keys, "text").mapInArrow(cut, schema)


def spans(docs: DataFrame) -> DataFrame:
    """Lines of documents as spans, with running offsets; blank lines are dropped but count.

    Cuts texts where they lie: no shuffle. A window over the document would need one."""
    return (
        line_rows(docs, "doc_id", "lang", "source").filter(F.trim("line") != "")
        .select("doc_id", F.concat_ws(":", F.col("doc_id"), F.lit("v1")).alias("version_id"), "ordinal", F.col("start").alias("start_offset"), (F.col("start") + F.length("line")).alias("end_offset"),
                F.concat_ws(" > ", "lang", "source").alias("heading_path"), F.col("line").alias("raw_text"))
    )


def with_span_id(rows: DataFrame) -> DataFrame:
    return rows.withColumn("span_id", ident.span_id(F.col("doc_id"), F.col("version_id"), F.lit(None).cast("int"), F.split("heading_path", " > "), F.col("start_offset"), F.col("raw_text")))


#: The same spans for the oracle.
SPANS_SQL = """spans AS (
  SELECT doc_id, doc_id || ':v1' AS version_id, i AS ordinal, start_offset, start_offset + length(raw_text) AS end_offset,
         concat_ws(' > ', lang, source) AS heading_path, raw_text
  FROM (SELECT doc_id, lang, source, i, raw_text,
               coalesce(sum(length(raw_text) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_offset
        FROM (SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS raw_text, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents))
  WHERE trim(raw_text) <> '')"""


def hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations and customers' segments as tree nodes: node_id, parent_node_id, level_no, title, heading_path."""
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    own = nation.join(F.broadcast(region), nation["n_regionkey"] == region["r_regionkey"])  # 25 and 5 rows at any scale
    root = spark.createDataFrame([("world", None, 0, "world", "world")], "node_id string, parent_node_id string, level_no int, title string, heading_path string")
    regions = region.select(F.concat(F.lit("r"), "r_regionkey").alias("node_id"), F.lit("world").alias("parent_node_id"), F.lit(1).alias("level_no"), F.col("r_name").alias("title"), F.concat(F.lit("world > "), "r_name").alias("heading_path"))
    nations = own.select(F.concat(F.lit("n"), "n_nationkey").alias("node_id"), F.concat(F.lit("r"), "r_regionkey").alias("parent_node_id"), F.lit(2).alias("level_no"), F.col("n_name").alias("title"), F.concat(F.lit("world > "), "r_name", F.lit(" > "), "n_name").alias("heading_path"))
    return root.unionByName(regions).unionByName(nations)


HIERARCHY_SQL = """tree AS (
  SELECT 'world' AS node_id, NULL::VARCHAR AS parent_node_id, 0 AS level_no, 'world' AS title, 'world' AS heading_path
  UNION ALL SELECT 'r' || r_regionkey, 'world', 1, r_name, 'world > ' || r_name FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || r_regionkey, 2, n_name, 'world > ' || r_name || ' > ' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey)"""


def ordered_window(key: list[str], *order) -> Window:
    return Window.partitionBy(*key).orderBy(*order)
