"""Raw pairs: a document's parsed nodes as Markdown with front matter, a sidecar of its spans, and a manifest with the digests of both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ident, text
from ..operators.contracts import UUID
from ..operators.knowledge import first_rejection

#: Form and length of a file's name.
SLUG, LONGEST_SLUG = r"^[a-z0-9]+(-[a-z0-9]+)*$", 100
#: Words that YAML reads as other things than text.
YAML_WORDS = ("true", "false", "yes", "no", "on", "off", "null", "y", "n")


def json_text(value: Column) -> Column:
    """A JSON string of a text, letters beyond ASCII as they are."""
    listed = F.to_json(F.array(value))
    return F.substr(listed, F.lit(2), F.length(listed) - 2)


def yaml_text(value: Column) -> Column:
    """A YAML scalar on one line: plain where that reads as the same text, else in single quotes, with control letters in double ones."""
    plain = value.rlike(r"^[A-Za-z0-9][A-Za-z0-9_/.()+ -]*$") & ~value.rlike(r"^[0-9][0-9_.eE+-]*$|^0(x[0-9a-fA-F_]+|o[0-7]+|b[01_]+)$| $") & ~F.lower(value).isin(*YAML_WORDS)
    single = F.concat(F.lit("'"), F.replace(value, F.lit("'"), F.lit("''")), F.lit("'"))
    return F.when(plain, value).when(value.rlike(r"[\p{Cc}\x{2028}\x{2029}]"), json_text(value)).otherwise(single)


def titled(name: Column) -> Column:
    """A name's words with blanks between and capital first letters; a letter after a digit is a first one too."""
    letters = F.split(F.replace(name, F.lit("-"), F.lit(" ")), "")
    return F.array_join(F.transform(letters, lambda c, i: F.when((i > 0) & F.coalesce(F.get(letters, i - 1).rlike("[a-z]"), F.lit(False)), c).otherwise(F.upper(c))), "")


def _span_json(indent: bool) -> Column:
    """A span as JSON: for the sidecar in lines, for the digest with sorted fields and no blanks."""
    page = F.coalesce(F.col("page_no").cast("string"), F.lit("null"))
    each = F.transform("headings", json_text)
    if not indent:
        return F.concat(F.lit('{"heading_path":['), F.array_join(each, ","), F.lit('],"offset":'), F.col("start_offset").cast("string"), F.lit(',"page_no":'), page, F.lit(',"span_id":"'), F.col("span_id"), F.lit('","text":'), json_text(F.col("text")), F.lit("}"))
    heads = F.when(F.size("headings") == 0, "[]").otherwise(F.concat(F.lit("[\n        "), F.array_join(each, ",\n        "), F.lit("\n      ]")))
    lines = [("span_id", json_text(F.col("span_id"))), ("page_no", page), ("heading_path", heads), ("offset", F.col("start_offset").cast("string")), ("text", json_text(F.col("text")))]
    return F.concat(F.lit("    {\n"), F.concat_ws(",\n", *(F.concat(F.lit(f'      "{k}": '), v) for k, v in lines)), F.lit("\n    }"))


def raw_pairs(documents: DataFrame, nodes: DataFrame, generated_by: str, key: str = "name") -> DataFrame:
    """name, doc_id, version_id, markdown, sidecar, manifest, canonical_hash, span_count, dropped_nodes, error: the three files of each document.

    documents: name (distinct), doc_id, version_id, source_checksum, docling_version. nodes: name, ordinal, text, and page_no, headings
    (array), start_offset, each of which may be null (no page, no heading, the ordinal). Texts and headings lose surplus white space; blank nodes
    are dropped and counted. The body names a heading's whole path where it changes. Ids that are no UUIDs, a name that is no slug, no
    node with text and a repeated span id are errors: the files are null then, and other documents go on. A document's files are one
    row; its nodes meet in one group, which is the size of its text. key: the column by which nodes name their document, where
    that is not its name; nodes of other documents are left out, and all meet in one exchange."""
    heads = F.filter(F.transform(F.coalesce("headings", F.array().cast("array<string>")), lambda h: F.trim(h)), lambda h: h != "")
    clean = nodes.select(key, "ordinal", "page_no", heads.alias("headings"), F.coalesce("start_offset", "ordinal").alias("start_offset"), text.collapsed(F.col("text")).alias("text"))
    rows = documents.select(key, "doc_id", "version_id").join(clean, key).withColumn("span_id", ident.span_id(F.col("doc_id"), F.col("version_id"), F.col("page_no"), F.col("headings"), F.col("start_offset"), F.col("text")))
    full = F.col("text") != ""
    above = F.last(F.when(full, F.col("headings")), ignorenulls=True).over(Window.partitionBy(key).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("above_", F.coalesce(above, F.array().cast("array<string>")))
    marks = F.when(F.col("headings") != F.col("above_"), F.transform("headings", lambda h, i: F.concat(F.repeat(F.lit("#"), i + 1), F.lit(" "), h))).otherwise(F.array().cast("array<string>"))
    piece = F.struct("ordinal", F.array_join(F.concat(marks, F.array("text")), "\n\n").alias("body"), _span_json(True).alias("side"), _span_json(False).alias("plain"), F.get("headings", 0).alias("head"), "span_id")
    grouped = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.when(full, piece))).alias("p"), F.count_if(~full).alias("dropped_nodes"))
    joined = documents.join(grouped, key, "left").withColumn("p", F.coalesce("p", F.array().cast(grouped.schema["p"].dataType)))
    of = lambda field: F.transform("p", lambda x: x[field])
    title = F.coalesce(F.get(F.filter(of("head"), lambda h: h.isNotNull()), 0), titled(F.col("name")))
    front = {"type": F.lit("raw"), "doc_id": F.col("doc_id"), "version_id": F.col("version_id"), "source_checksum": F.col("source_checksum"), "docling_version": F.col("docling_version"), "generated_by": F.lit(generated_by), "title": title}
    error = first_rejection([
        ("doc_id must be a UUID", F.col("doc_id").rlike(UUID)), ("version_id must be a UUID", F.col("version_id").rlike(UUID)), ("invalid slug", F.col("name").rlike(SLUG) & (F.length("name") <= LONGEST_SLUG)),
        ("no valid spans", F.size("p") > 0), ("repeated span", F.size(F.array_distinct(of("span_id"))) == F.size("p")),
    ])
    head = F.concat(*(F.concat(F.lit(f"{k}: "), yaml_text(v), F.lit("\n")) for k, v in front.items()))
    markdown = F.concat(F.lit("---\n"), head, F.lit("---\n"), F.array_join(of("body"), "\n\n"), F.lit("\n"))
    opening = F.concat(F.lit('{\n  "schema_version": 1,\n  "doc_id": '), json_text(F.col("doc_id")), F.lit(',\n  "version_id": '), json_text(F.col("version_id")), F.lit(',\n  "spans": [\n'))
    sidecar = F.concat(opening, F.array_join(of("side"), ",\n"), F.lit("\n  ]\n}\n"))
    sorted_front = F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(f'"{k}":'), json_text(front[k])) for k in sorted(front))), F.lit("}"))
    digest = F.sha2(F.concat(sorted_front, F.lit("["), F.array_join(of("plain"), ","), F.lit("]")), 256)
    good = lambda c: F.when(F.col("error").isNull(), c)
    files = joined.withColumn("error", error).select("name", "doc_id", "version_id", good(markdown).alias("markdown"), good(sidecar).alias("sidecar"), good(digest).alias("canonical_hash"), F.size("p").alias("span_count"), F.coalesce("dropped_nodes", F.lit(0)).alias("dropped_nodes"), "error")
    fields = {"canonical_hash": F.col("canonical_hash"), "markdown_file": F.concat("name", F.lit(".md")), "markdown_sha256": F.sha2("markdown", 256), "schema_version": F.lit("1"), "sidecar_file": F.concat("name", F.lit(".spans.json")), "sidecar_sha256": F.sha2("sidecar", 256)}
    manifest = F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(f'"{k}":'), v if k == "schema_version" else json_text(v)) for k, v in fields.items())), F.lit("}\n"))
    return files.withColumn("manifest", good(manifest))
