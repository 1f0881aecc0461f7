"""HTML pages as spans: heading from <h1>, text from <p>; navigation, scripts and advertisements are dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text

#: Elements whose content is no text of the page.
DROPPED = r"(?s)<(script|style|nav|footer|head)\b.*?</\1>|<!--.*?-->|<div class=\"ad\">.*?</div>"


def plain(html):
    """Text of a fragment: tags are dropped, common entities resolved, white space collapsed."""
    bare = F.regexp_replace(html, "<[^>]*>", " ")
    for entity, letter in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(letter))
    return text.collapsed(bare)


def page_spans(pages: DataFrame) -> DataFrame:
    """page_id, ordinal, heading, raw_text of every paragraph with text."""
    body = F.regexp_replace(F.coalesce("html", F.lit("")), DROPPED, " ")
    rows = pages.select("page_id", plain(F.regexp_extract(body, r"(?s)<h1[^>]*>(.*?)</h1>", 1)).alias("heading"), F.split(body, r"<p\b[^>]*>").alias("parts"))
    cut = rows.select("page_id", "heading", F.posexplode(F.slice("parts", 2, F.greatest(F.size("parts") - 1, F.lit(0)))).alias("ordinal", "part"))
    return cut.withColumn("raw_text", plain(F.regexp_replace("part", r"(?s)(</p>|</article>|</body>).*$", ""))).filter("raw_text <> ''").select("page_id", "ordinal", "heading", "raw_text")


def binary_documents(spark, folder: str, pattern: str = "*") -> DataFrame:
    """path, length, content_hash and text of files that are read whole; what is no UTF-8 is null."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return rows.select("path", "length", F.sha2("content", 256).alias("content_hash"), F.try_validate_utf8(F.col("content").cast("string")).alias("text"))


def parsed_nodes(nodes: DataFrame) -> DataFrame:
    """Parser output (text, metadata as JSON) as spans: the page and offset of the first
    provenance, headings, label; blank nodes are dropped."""
    meta = F.col("metadata")
    first = "$.doc_items[0]"
    headings = F.from_json(F.get_json_object(meta, "$.headings"), "array<string>")
    return nodes.filter(F.trim(F.coalesce("text", F.lit(""))) != "").select(
        "doc_id", "ordinal", "text", headings.alias("headings"), F.get_json_object(meta, f"{first}.label").alias("label"),
        F.get_json_object(meta, f"{first}.prov[0].page_no").try_cast("int").alias("page_no"),
        F.coalesce(F.get_json_object(meta, f"{first}.prov[0].charspan[0]").try_cast("int"), F.col("ordinal")).alias("start_offset"),
    )
