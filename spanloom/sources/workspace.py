"""A workspace of indexed documents in a folder: what is known of each, its outline and its content, read by tables of requests.

Three tables of one generation (see `generations`): documents, nodes, content. Listing documents reads the first alone; outlines never read a text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import generations
from .pairs import json_text

DOCUMENTS = "doc_id string, doc_name string, doc_description string, type string, version_id string"
NODES = "doc_id string, node_id string, parent_node_id string, level_no int, title string, start int"
CONTENT = "doc_id string, number int, text string"
SCHEMAS = {"documents": DOCUMENTS, "nodes": NODES, "content": CONTENT}
#: Kinds of documents: pages of the first are asked one by one, lines of the second from the least to the greatest.
PAGED, LINED = "pdf", "md"
#: Numbers and ranges of numbers, with commas between.
PAGES = r"^\s*\d+\s*(-\s*\d+\s*)?(,\s*\d+\s*(-\s*\d+\s*)?)*$"


def _object(**fields: Column) -> Column:
    return F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(f'"{k}":'), v) for k, v in fields.items())), F.lit("}"))


def _named(column: str) -> Column:
    return json_text(F.coalesce(column, F.lit("")))


@dataclass(frozen=True)
class Workspace:
    spark: SparkSession
    folder: str

    def tables(self) -> list[generations.Table]:
        own = {"doc_id": ("documents", "doc_id")}
        return [generations.Table("documents", ["doc_id"]), generations.Table("nodes", ["doc_id", "node_id"], own), generations.Table("content", ["doc_id", "number"], own)]

    def read(self, name: str) -> DataFrame:
        return generations.read(self.spark, self.folder, name, SCHEMAS[name])

    def _replace(self, ids: DataFrame, added: dict[str, DataFrame]) -> tuple[int, DataFrame]:
        kept = {name: self.read(name).join(ids, "doc_id", "left_anti") for name in SCHEMAS}
        shaped = lambda df, name: df.select(*(F.col(c.split()[0]).cast(c.split()[1]) for c in SCHEMAS[name].split(", ")))
        desired = {name: shaped(kept[name], name).unionByName(shaped(added[name], name)) if name in added else shaped(kept[name], name) for name in SCHEMAS}
        return generations.reconcile(self.spark, self.folder, self.tables(), desired)

    def index(self, documents: DataFrame, nodes: DataFrame, content: DataFrame) -> tuple[int, DataFrame]:
        """Put documents with their nodes and content in the place of what stood under their ids; others stay. Returns the generation
        and the outcomes by table. All three tables change at once; nodes and content of unknown documents are blocked, a type
        other than pdf and md and repeated keys raise, and a run that changes nothing writes nothing."""
        if wrong := documents.filter(F.coalesce(~F.col("type").isin(PAGED, LINED), F.lit(True))).head(1):
            raise ValueError(f"unsupported type: {wrong[0].type}")
        return self._replace(documents.select("doc_id").distinct(), {"documents": documents, "nodes": nodes, "content": content})

    def remove(self, ids: DataFrame) -> tuple[int, DataFrame]:
        """Take documents (doc_id) out, with all that is theirs."""
        return self._replace(ids.select("doc_id").distinct(), {})

    def _answered(self, requests: DataFrame, answers: DataFrame, keys: list[str]) -> DataFrame:
        missing = _object(error=json_text(F.concat(F.lit("Document "), F.coalesce("doc_id", F.lit("null")), F.lit(" not found"))))
        return requests.select(*keys).distinct().join(answers, keys, "left").withColumn("json", F.coalesce("json", missing))

    def documents(self, requests: DataFrame) -> DataFrame:
        """doc_id, json: name, description, type, status and the count of pages or lines of each requested document, or an error."""
        counts = self.read("content").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
        rows = self.read("documents").join(requests.select("doc_id").distinct(), "doc_id", "left_semi").join(counts, "doc_id", "left")
        fields = {"doc_id": json_text(F.col("doc_id")), "doc_name": _named("doc_name"), "doc_description": _named("doc_description"), "type": json_text(F.col("type")), "status": F.lit('"completed"')}
        count = F.coalesce("n", F.lit(0)).cast("string")
        json = F.when(F.col("type") == PAGED, _object(**fields, page_count=count)).otherwise(_object(**fields, line_count=count))
        return self._answered(requests, rows.select("doc_id", json.alias("json")), ["doc_id"])

    def structures(self, requests: DataFrame) -> DataFrame:
        """doc_id, json: the outline of each requested document as nested nodes without texts, in order of their starts, or an error. Levels
        are folded from the deepest up, a join each; a node's parent must lie one level above it, other nodes are left out."""
        wanted = requests.select("doc_id").distinct()
        rows = self.read("nodes").join(wanted, "doc_id", "left_semi")
        deepest = rows.agg(F.max("level_no")).first()[0]
        below = None
        for level in range(-1 if deepest is None else deepest, -1, -1):
            own = rows.filter(F.col("level_no") == level)
            own = own.join(below, ["doc_id", "node_id"], "left") if below is not None else own.withColumn("below", F.lit(None).cast("string"))
            inner = F.concat(F.lit("["), F.coalesce("below", F.lit("")), F.lit("]"))
            node = _object(title=_named("title"), node_id=json_text(F.col("node_id")), start=F.coalesce(F.col("start").cast("string"), F.lit("null")), nodes=inner)
            ordered = F.array_sort(F.collect_list(F.struct("start", "node_id", node.alias("json"))))
            parent = [F.col("parent_node_id").alias("node_id")] if level else []
            below = own.groupBy("doc_id", *parent).agg(F.array_join(F.transform(ordered, lambda x: x["json"]), ",").alias("below"))
        known = self.read("documents").join(wanted, "doc_id", "left_semi").select("doc_id")
        known = known.join(below, "doc_id", "left") if below is not None else known.withColumn("below", F.lit(""))
        return self._answered(requests, known.select("doc_id", F.concat(F.lit("["), F.coalesce("below", F.lit("")), F.lit("]")).alias("json")), ["doc_id"])

    def contents(self, requests: DataFrame) -> DataFrame:
        """doc_id, pages, json: page and content of what each request (doc_id, pages such as 5-7 or 3,8; null is empty) names, in order, or an
        error. Pages that a document does not have are left out; a range is held against the document's pages and never spelt out."""
        ends = lambda p: F.transform(F.split(p, "-"), lambda x: F.trim(x).try_cast("int"))
        part = lambda p: F.struct(F.get(ends(p), 0).alias("low"), F.element_at(ends(p), -1).alias("high"))
        asked = requests.select("doc_id", F.coalesce("pages", F.lit("")).alias("pages")).distinct().withColumn("ranges", F.transform(F.split("pages", ","), part))
        known = asked.join(self.read("documents").select("doc_id", "type"), "doc_id")
        legal = F.col("pages").rlike(PAGES) & F.forall("ranges", lambda r: F.coalesce(r["low"] <= r["high"], F.lit(False)))
        good, refused = known.filter(legal), known.filter(~legal)
        whole = F.array(F.struct(F.array_min(F.transform("ranges", lambda r: r["low"])).alias("low"), F.array_max(F.transform("ranges", lambda r: r["high"])).alias("high")))
        each = good.select("doc_id", "pages", F.explode(F.when(F.col("type") == PAGED, F.col("ranges")).otherwise(whole)).alias("r"))
        low, high = each.agg(F.min("r.low"), F.max("r.high")).first()  # no text beyond these is read
        own = self.read("content").filter(F.col("number").between(F.lit(low), F.lit(high))).withColumnRenamed("doc_id", "of")
        lines = each.join(own, (F.col("doc_id") == F.col("of")) & F.col("number").between(F.col("r.low"), F.col("r.high"))).select("doc_id", "pages", "number", "text").distinct()
        ordered = F.array_sort(F.collect_list(F.struct("number", _object(page=F.col("number").cast("string"), content=_named("text")).alias("json"))))
        found = lines.groupBy("doc_id", "pages").agg(F.array_join(F.transform(ordered, lambda x: x["json"]), ",").alias("found"))
        answers = good.select("doc_id", "pages").join(found, ["doc_id", "pages"], "left").select("doc_id", "pages", F.concat(F.lit("["), F.coalesce("found", F.lit("")), F.lit("]")).alias("json"))
        invalid = _object(error=json_text(F.concat(F.lit("Invalid pages: "), F.col("pages"))))
        return self._answered(asked, answers.unionByName(refused.select("doc_id", "pages", invalid.alias("json"))), ["doc_id", "pages"])
