"""One entry to all retrieval paths: validated query in, hits of one schema out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .functions import text
from .operators import fuse, retrieve
from .sources import postings

MODES = ("auto", "keyword", "vector", "tree", "hybrid")
HIT = ("path", "ordinal", "key", "text", "score", "heading_path")


class Engine:
    """Retrieval over DataFrames.

    spans: span_id, raw_text, heading_path, start_offset, doc_id, ordinal. nodes: node_id, level_no, heading_path,
    summary_text. vectors: vec_id, embedding, text, heading_path; embed turns a query into a vector of their length. index: a
    reader of the spans' postings; keyword search then reads what its terms need instead of all spans."""

    def __init__(self, spans: DataFrame, nodes: DataFrame | None = None, vectors: DataFrame | None = None, embed: Callable[[str], list[float]] | None = None, index: postings.Reader | None = None):
        self.spans, self.nodes, self.vectors, self.embed, self.index = spans, nodes, vectors, embed, index

    def route(self, query: str) -> str:
        """The mode that the query's form suggests; vector falls to keyword where there are no vectors, tree where there are no nodes."""
        kind = self.spans.sparkSession.range(1).select(text.query_kind(F.lit(query))).first()[0]
        missing = (kind == "vector" and (self.vectors is None or self.embed is None)) or (kind == "tree" and self.nodes is None)
        return "keyword" if missing else kind

    def query(self, query: str, mode: str = "auto", top_k: int = 10) -> DataFrame:
        """Hits, best first: path, ordinal (from 1), key, text, score, heading_path."""
        if mode not in MODES:
            raise ValueError(f"mode must be one of {', '.join(MODES)}")
        if not query or not query.strip():
            raise ValueError("query must not be empty")
        if not 1 <= top_k <= 100:
            raise ValueError("top_k must be from 1 to 100")
        mode = self.route(query) if mode == "auto" else mode
        return self._hybrid(query, top_k) if mode == "hybrid" else getattr(self, f"_{mode}")(query, top_k)

    def answer(self, query: str, mode: str = "auto", top_k: int = 10) -> tuple[str, str, DataFrame]:
        """(mode, text of the best hit or nothing, all hits)."""
        mode = self.route(query) if mode == "auto" else mode
        hits = self.query(query, mode, top_k)
        best = hits.orderBy("ordinal").select("text").first()
        return mode, best["text"] if best else "", hits

    def _placed(self, path: str, rows: DataFrame, key: str, body: str) -> DataFrame:
        """At most top_k rows, numbered in order of score and key."""
        order = Window.partitionBy(F.lit(path)).orderBy(F.desc("score"), key)
        return rows.select(F.lit(path).alias("path"), F.row_number().over(order).alias("ordinal"), F.col(key).cast("string").alias("key"), F.col(body).alias("text"), "score", "heading_path")

    def _keyword(self, query: str, top_k: int) -> DataFrame:
        hits = self.index.search(query, top_k) if self.index is not None else retrieve.keyword_search(self.spans, query, top_k)
        return self._placed("keyword", hits, "span_id", "raw_text")

    def _tree(self, query: str, top_k: int) -> DataFrame:
        if self.nodes is None:
            raise ValueError("no nodes to search")
        return self._placed("tree", retrieve.tree_fallback(self.nodes, query, top_k), "node_id", "summary_text")

    def _vector(self, query: str, top_k: int) -> DataFrame:
        if self.vectors is None or self.embed is None:
            raise ValueError("no vectors to search, or nothing to embed the query with")
        return self._placed("vector", retrieve.nearest(self.vectors, self.embed(query), top_k), "vec_id", "text")

    def _hybrid(self, query: str, top_k: int) -> DataFrame:
        """All paths that there are, merged by text."""
        hits = self._keyword(query, top_k)
        if self.nodes is not None:
            hits = hits.unionByName(self._tree(query, top_k))
        if self.vectors is not None and self.embed is not None:
            hits = hits.unionByName(self._vector(query, top_k))
        merged = fuse.fuse(hits, "text", limit=top_k)
        first = hits.groupBy("text").agg(F.min_by(F.struct("key", "heading_path"), F.struct("ordinal", "path")).alias("at"))
        rows = merged.join(first, "text").select(F.col("source_paths").alias("paths"), "at.key", "text", F.col("fused").alias("score"), "at.heading_path")
        order = Window.partitionBy(F.lit("hybrid")).orderBy(F.desc("score"), "key")
        return rows.select(F.col("paths").alias("path"), F.row_number().over(order).alias("ordinal"), "key", "text", "score", "heading_path")
