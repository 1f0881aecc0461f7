"""An inverted index of rows with texts: segments written once, terms in buckets, rows in slices; a search reads what its terms need.

A segment holds postings (term, key, slice) by buckets of the term, sorted by term and key; terms with the number of their rows; and
the rows by slices of the key. A small file commits it, so that a lost writer leaves nothing that searches see. Buckets are dealt to tasks in
parts by the key's hash, so a term that stands in most rows is spread over many of them, and rows are cut into terms once: ranges would do so twice."""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text
from ..operators import retrieve
from . import store

#: Rows of a term, known from the index, up to which its keys are broadcast.
BROADCAST_ROWS = 100_000


@dataclass(frozen=True)
class Index:
    """key: a column that tells rows apart, never null; column: the text; buckets and slices must be the same for all segments."""

    spark: SparkSession
    root: str
    key: str = "span_id"
    column: str = "raw_text"
    buckets: int = 64
    slices: int = 64

    def bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("integer")

    def _part(self, column: str, groups: int) -> Column:
        """Part of a bucket or slice, by another hash than theirs: four for each partition that it would fill alone."""
        partitions = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return F.pmod(F.hash(column), F.lit(4 * -(-partitions // groups)))

    def segments(self) -> dict[str, dict]:
        """Committed segments: folder and schema of each."""
        if not store.names(self.spark, f"{self.root}/commits"):
            return {}
        found = self.spark.read.text(f"{self.root}/commits", wholetext=True, pathGlobFilter="*.json").collect()  # a short line a segment
        return {c["segment"]: c for c in (json.loads(r["value"]) for r in found)}

    def add(self, rows: DataFrame, segment: str) -> bool:
        """Index rows as a new segment; False, and nothing written, where the name is committed. Keys must be new to the index."""
        if not re.fullmatch(r"[A-Za-z0-9_-]+", segment):
            raise ValueError("a segment's name has letters, digits, - and _ only")
        known = self.segments()
        if segment in known:
            return False
        folder = f"segment={segment}-{uuid.uuid4().hex}"
        sliced = rows.withColumn("slice", F.pmod(F.xxhash64(self.key), F.lit(self.slices)).cast("integer"))
        schema = sliced.schema.json()
        if any(c["schema"] != schema for c in known.values()):
            raise ValueError("rows have other columns than the index")
        sliced.repartition("slice", self._part(self.key, self.slices)).sortWithinPartitions("slice", self.key).write.partitionBy("slice").parquet(f"{self.root}/rows/{folder}")
        kept = self.spark.read.schema(sliced.schema).parquet(f"{self.root}/rows/{folder}")
        words = kept.select(F.explode(F.array_distinct(text.tokens(F.col(self.column)))).alias("term"), F.col(self.key).alias("key"), "slice").withColumn("bucket", self.bucket(F.col("term")))
        words.repartition("bucket", self._part("key", self.buckets)).sortWithinPartitions("bucket", "term", "key").write.partitionBy("bucket").parquet(f"{self.root}/postings/{folder}")
        counts = self.spark.read.schema(words.schema).parquet(f"{self.root}/postings/{folder}").groupBy("bucket", "term").agg(F.count(F.lit(1)).alias("rows"))
        counts.repartition("bucket", self._part("term", self.buckets)).sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{self.root}/terms/{folder}")
        return store.put(self.spark, f"{self.root}/commits/{segment}.json", json.dumps({"segment": segment, "folder": folder, "schema": schema}))

    def opened(self) -> "Reader":
        """A reader of the segments that are committed now."""
        return Reader(self)


class Reader:
    def __init__(self, index: Index):
        self.index, found = index, index.segments()
        if not found:
            raise ValueError("the index has no segment")
        self.folders = sorted(c["folder"] for c in found.values())
        self.schema = StructType.fromJson(json.loads(next(iter(found.values()))["schema"]))

    def _read(self, part: str, schema: StructType) -> DataFrame:
        at = f"{self.index.root}/{part}"
        return self.index.spark.read.schema(schema).option("basePath", at).parquet(*(f"{at}/{folder}" for folder in self.folders))

    def rows(self) -> DataFrame:
        return self._read("rows", self.schema).select(*self.schema.names)

    def terms(self) -> DataFrame:
        return self._read("terms", StructType().add("term", "string").add("rows", "long").add("bucket", "integer"))

    def _postings(self) -> DataFrame:
        return self._read("postings", StructType().add("term", "string").add("key", self.schema[self.index.key].dataType).add("slice", "integer").add("bucket", "integer"))

    def postings(self, terms: dict[str, int]) -> DataFrame:
        """term, key, slice of the given terms in the given buckets: literals, so that other buckets' files are never opened."""
        return self._postings().filter(F.col("bucket").isin(*set(terms.values())) & F.col("term").isin(*terms)).select("term", "key", "slice")

    def frequencies(self, words: list[str]) -> dict[str, tuple[int, int]]:
        """Bucket and number of rows of each word, 0 where the index has none: one row a word."""
        if not words:
            return {}
        asked = self.index.spark.createDataFrame([(w,) for w in sorted(set(words))], "term string")
        buckets = {r["term"]: r["b"] for r in asked.select("term", self.index.bucket(F.col("term")).alias("b")).collect()}
        kept = self.terms().filter(F.col("bucket").isin(*set(buckets.values())) & F.col("term").isin(*buckets))
        found = {r["term"]: r["n"] for r in kept.groupBy("term").agg(F.sum("rows").alias("n")).collect()}
        return {w: (b, found.get(w, 0)) for w, b in buckets.items()}

    def _having_all(self, words: list[str], known: dict[str, tuple[int, int]]) -> DataFrame | None:
        """key, slice of rows with all the words, the rarest first; None where a word stands nowhere."""
        order = sorted(set(words), key=lambda w: (known[w][1], w))
        if known[order[0]][1] == 0:
            return None
        small = known[order[0]][1] <= BROADCAST_ROWS
        out = self.postings({order[0]: known[order[0]][0]}).select("key", "slice")
        for word in order[1:]:
            more = self.postings({word: known[word][0]}).select("key", "slice")
            out = more.join(F.broadcast(out) if small else out, ["key", "slice"])  # a key stands once in a term
        return out

    def _having_part(self, token: str, starts: bool, ends: bool) -> DataFrame:
        """key, slice of rows with a term that holds the token, at the term's start or end where asked. Reads all terms, but no texts."""
        term = F.col("term")
        fits = term.startswith(token) if starts else term.endswith(token) if ends else term.contains(token)
        fitting = self.terms().filter(fits).select("bucket", "term").distinct()
        kept = self._postings()
        return kept.join(fitting, ["bucket", "term"]).select("key", "slice").distinct()

    def candidates(self, query: str) -> tuple[DataFrame | None, int | None]:
        """key, slice of all rows that may match, each once, and the most that they can be (None: not known). No frame where the query asks
        for nothing that terms know, so that all rows may match."""
        low, tokens = self.index.spark.range(1).select(F.lower(F.lit(query)), text.tokens(F.lit(query))).first()
        wanted = [[w for kind, words in choice if kind != "minus" for w in words] for choice in retrieve.choices(query) if choice]
        if not tokens or not all(wanted):
            return None, None
        parts, at = [], 0  # the query as it stands: inner tokens are whole, the outer ones may be pieces
        for token in tokens:
            at = low.index(token, at)
            before, after = low[:at][-1:], low[at + len(token) :][:1]
            parts.append((token, before not in ("", *"%_\\"), after not in ("", *"%_\\")))
            at += len(token)
        inner = [t for t, starts, ends in parts if starts and ends]
        known = self.frequencies([w for words in wanted for w in words] + inner)
        sets = wanted + ([inner] if inner else [])
        found = [f for f in (self._having_all(words, known) for words in sets) if f is not None]
        if not inner:
            found.append(self._having_part(*max(parts, key=lambda p: len(p[0]))))
        most = sum(min(known[w][1] for w in words) for words in sets) if inner else None
        return reduce(DataFrame.unionByName, found).distinct() if found else self.postings({"": 0}).select("key", "slice").limit(0), most

    def matches(self, query: str) -> DataFrame:
        """Rows that hold the query as a substring or all its terms: as a scan finds them, from the slices of the candidates alone."""
        key, rows = self.index.key, self.rows()
        found, most = self.candidates(query)
        if found is not None:
            few = most is not None and most <= BROADCAST_ROWS
            found = found.withColumnRenamed("key", key).groupBy(key, "slice").agg(F.count(F.lit(1)).alias("named_"))
            rows = rows.join(F.broadcast(found) if few else found, [key, "slice"])
            # the texts are held against the query after the join: a filter on them alone would sink below it, to all rows
            return rows.filter(F.when(F.col("named_") > 0, retrieve.matches(F.col(self.index.column), query))).drop("slice", "named_")
        return rows.filter(retrieve.matches(F.col(self.index.column), query)).drop("slice")

    def search(self, query: str, limit: int = 50) -> DataFrame:
        """As `retrieve.keyword_search`, over the index."""
        return retrieve.best(self.matches(query), query, limit, self.index.column)
