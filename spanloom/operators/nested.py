"""Nested chunk levels over whole texts, and hits that rise to the chunks above them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

#: Space and the controls from tab to carriage return part words.
SPACES = np.array([0x20, *range(0x09, 0x0E)], dtype="uint32")
#: Texts whose chunks a worker holds at a time.
TEXTS = 64
PIECE = StructType([StructField("level", IntegerType()), StructField("n", LongType()), StructField("up", LongType()), StructField("siblings", LongType()),
                    StructField("start", LongType()), StructField("stop", LongType()), StructField("words", LongType()), StructField("chunk_text", StringType())])


def _windows(text: str, sizes: Sequence[int]) -> tuple[np.ndarray, int, list[tuple[np.ndarray, np.ndarray | None]]]:
    """Where words begin, and the text ends; how many they are; for each level the first word of each chunk and the place of the
    chunk above it. A word ends where the next begins, the first begins at 0."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="uint32")
    space = np.isin(codes, SPACES)
    begins = np.flatnonzero(~space & np.concatenate([[True], space[:-1]])) if len(codes) else np.array([], dtype=np.int64)
    count = len(begins)
    at = np.concatenate([[0], begins[1:], [len(codes)]]) if count else np.array([0, len(codes)])
    left = np.arange(max(count, 1))  # place of a word in its chunk of the level before
    above, out = None, []
    for size in sizes:
        left = left % size
        first = np.flatnonzero(left == 0)
        out.append((first, None if above is None else above[first]))
        above = np.cumsum(left == 0) - 1
    return at, count, out


def _pieces(text: str, sizes: Sequence[int]) -> list[tuple]:
    """Chunks of all levels of one text."""
    at, count, levels = _windows(text, sizes)
    out = []
    for level, (first, up) in enumerate(levels):
        after = np.append(first[1:], len(at) - 1)
        siblings = np.full(len(first), len(first)) if up is None else np.bincount(up)[up]
        for n, (a, b) in enumerate(zip(first, after)):
            out.append((level, n, None if up is None else int(up[n]), int(siblings[n]), int(at[a]), int(at[b]), int(b - a) if count else 0, text[at[a] : at[b]]))
    return out


def nested_chunks(docs: DataFrame, sizes: Sequence[int] = (256, 96), key: str = "doc_id", column: str = "text") -> DataFrame:
    """key, chunk_id, parent_id, level (0 is the widest), n (place among the text's chunks of the level), up (n of the
    parent), siblings (children of the parent, itself included), start, stop (code points), words, chunk_text.

    Each level cuts the chunks of the level above into windows of its own number of words, so that children cover their parent exactly, the last
    of them shorter where sizes do not divide. White space belongs to the word before it, at a text's beginning to the first. A
    text without words is one chunk a level, a null text has none. Keys must be distinct. Texts are cut where they lie, a few at a time: no shuffle."""
    if not sizes or any(s < 1 for s in sizes):
        raise ValueError("sizes must be whole numbers from 1")
    wanted = tuple(sizes)
    schema = StructType([StructField("key_", docs.schema[key].dataType), *PIECE])

    def cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(0, batch.num_rows, TEXTS):
                few = batch.slice(n, TEXTS)
                owners, rows = [], []
                for i, t in enumerate(few.column(1)):
                    if t.is_valid:
                        own = _pieces(t.as_py(), wanted)
                        owners += [i] * len(own)
                        rows += own
                if rows:
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int32(), *[pa.int64()] * 6, pa.string()], strict=True)]
                    yield pa.RecordBatch.from_arrays([few.column(0).take(pa.array(owners)), *columns], names=schema.names)

    cut = docs.select(key, column).mapInArrow(cut_texts, schema).select("key_", F.struct(*PIECE.names).alias("c"))
    name = lambda level, n: F.concat_ws(":", F.col("key_").cast("string"), level, n)
    parent = F.when(F.col("c.up").isNotNull(), name(F.col("c.level") - 1, F.col("c.up")))
    return cut.select(F.col("key_").alias(key), name(F.col("c.level"), F.col("c.n")).alias("chunk_id"), parent.alias("parent_id"), "c.level", "c.n", "c.up", "c.siblings", "c.start", "c.stop", "c.words", "c.chunk_text")


def leaves(chunks: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """The narrowest level: what is searched."""
    return chunks.filter(F.col("level") == len(sizes) - 1)


def merged_upwards(hits: DataFrame, chunks: DataFrame, levels: int, ratio: float = 0.5, fill: bool = True, key: str = "doc_id", query: str = "query_id") -> DataFrame:
    """query, chunk_id, level, score: hits after all merges. From the narrowest level up, a chunk that lies between two hits of a text
    joins them with their mean score (`fill`); then a parent of whose children more than `ratio` are hit stands for them with their
    mean score. Hits of one chunk and a hit that its children merge into count once, with the greatest score.

    What merges at a level depends on that level's hits alone, and those on the levels below, so one pass from below is the fixed point. The
    plan is a chain: each pass takes its input once and reads the narrow columns of one level. Groups are a parent's children."""
    if not 0 < ratio < 1:
        raise ValueError("ratio must lie between 0 and 1")
    places = chunks.select("chunk_id", "level", F.col(key).alias("key_"), "n", "up", "siblings")
    at = ["query_", "key_", "level", "n"]
    rows = hits.select(F.col(query).alias("query_"), "chunk_id", F.col("score").cast("double").alias("score")).join(places.drop("up", "siblings"), "chunk_id")
    rows = rows.groupBy(*at).agg(F.max("score").alias("score"))
    nothing = F.lit(None).cast("double")
    for level in range(levels - 1, -1, -1):
        here = F.col("level") == level
        if fill:
            mark = lambda n, own, low, high: F.struct(n.alias("n"), own.alias("own"), low.alias("low"), high.alias("high"))
            score, n = F.col("score"), F.col("n")
            self_ = mark(n, score, nothing, nothing)
            marks = F.when(here, F.array(self_, mark(n + 1, nothing, score, nothing), mark(n - 1, nothing, nothing, score))).otherwise(F.array(self_))
            spread = rows.select("query_", "key_", "level", F.explode(marks).alias("m")).groupBy("query_", "key_", "level", F.col("m.n").alias("n"))
            both = spread.agg(F.max("m.own").alias("own"), F.max("m.low").alias("low"), F.max("m.high").alias("high"))
            rows = both.select(*at, F.coalesce("own", (F.col("low") + F.col("high")) / 2).alias("score")).filter("score is not null")
        if level:
            known = rows.join(places.filter(here).drop("chunk_id"), ["key_", "level", "n"], "left")
            family = Window.partitionBy("query_", "key_", "level", F.coalesce("up", "n"))  # other levels: a group each
            full = here & (F.count(F.lit(1)).over(family) > ratio * F.col("siblings"))
            seen = known.select(*at, "up", "score", full.alias("full_"), F.avg("score").over(family).alias("mean_"))
            rise = lambda up, stay: F.when(F.col("full_"), up).otherwise(stay)
            rows = seen.select("query_", "key_", rise(F.col("level") - 1, F.col("level")).alias("level"), rise(F.col("up"), F.col("n")).alias("n"), rise(F.col("mean_"), F.col("score")).alias("score"))
            rows = rows.groupBy(*at).agg(F.max("score").alias("score"))
    return rows.join(places, ["key_", "level", "n"]).select(F.col("query_").alias(query), "chunk_id", "level", "score")


def _risen(scores: np.ndarray, owners: Sequence[np.ndarray], ups: Sequence[np.ndarray | None], ratio: float, fill: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """level, queries, places, scores: what `merged_upwards` leaves of hits on the narrowest level of whole texts. `scores` has a row a query, a column
    a chunk, nan where it is no hit; `owners` the text of each chunk of a level, in order; `ups` the place of the chunk above it."""
    for level in range(len(owners) - 1, -1, -1):
        if fill and len(owners[level]) > 2:
            low, high, own = scores[:, :-2], scores[:, 2:], owners[level]
            mean = np.where(own[:-2] == own[2:], (low + high) / 2, np.nan)
            scores = np.concatenate([scores[:, :1], np.where(np.isnan(scores[:, 1:-1]), mean, scores[:, 1:-1]), scores[:, -1:]], axis=1)
        hit = ~np.isnan(scores)
        stay = hit
        if level:
            up, shape = ups[level], (len(scores), len(owners[level - 1]))
            family = (np.arange(shape[0])[:, None] * shape[1] + up)[hit]
            count, total = (np.bincount(family, w, minlength=shape[0] * shape[1]).reshape(shape) for w in (None, scores[hit]))
            full = count > ratio * np.bincount(up, minlength=shape[1])
            stay = hit & ~full[:, up]
        queries, places = np.nonzero(stay)
        yield level, queries, places, scores[queries, places]
        if level:
            scores = np.where(full, total / np.maximum(count, 1), np.nan)


def risen_terms(docs: DataFrame, terms: Sequence[str], sizes: Sequence[int] = (256, 96), ratio: float = 0.5, fill: bool = True, key: str = "doc_id", column: str = "text") -> DataFrame:
    """query_id (a term), chunk_id, level, score: for each term the narrowest chunks that hold it, in either case, by how often they do, merged upwards.

    The same as `merged_upwards` over `nested_chunks` and these hits. A text's hits merge among its own chunks alone, so this is done where
    the text lies, a few texts at a time: nothing is written, no shuffle. Letters are lowered one by one (İ is i), as SQL does."""
    if not sizes or any(s < 1 for s in sizes):
        raise ValueError("sizes must be whole numbers from 1")
    if not 0 < ratio < 1:
        raise ValueError("ratio must lie between 0 and 1")
    if not all(terms):
        raise ValueError("terms must have letters")
    wanted, asked = tuple(sizes), tuple(terms)
    schema = StructType([StructField("key_", docs.schema[key].dataType), StructField("query", StringType()), StructField("level", IntegerType()), StructField("n", LongType()), StructField("score", DoubleType())])

    def merge_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(asked, pa.string())
        for batch in batches:
            for begin in range(0, batch.num_rows, TEXTS):
                few = batch.slice(begin, TEXTS)
                counts, owners, ups = [[] for _ in asked], [[] for _ in wanted], [[] for _ in wanted]
                held = [0] * len(wanted)  # chunks of each level so far
                for i, t in enumerate(few.column(1)):
                    if not t.is_valid:
                        continue
                    low = t.as_py().replace("İ", "i").lower()
                    at, _, levels = _windows(low, wanted)
                    for level, (first, up) in enumerate(levels):
                        owners[level].append(np.full(len(first), i))
                        if level:
                            ups[level].append(up + held[level - 1] - len(levels[level - 1][0]))
                        held[level] += len(first)
                    cuts = at[np.append(levels[-1][0], len(at) - 1)].tolist()
                    pieces = [low[a:b] for a, b in zip(cuts, cuts[1:])]
                    for own, term in zip(counts, asked, strict=True):
                        own += [p.count(term) for p in pieces]
                if not held[-1] or not asked:
                    continue
                scores = np.array(counts, dtype="float64")
                scores[scores == 0] = np.nan
                own = [np.concatenate(o) for o in owners]
                for level, queries, places, found in _risen(scores, own, [np.concatenate(u) if u else None for u in ups], ratio, fill):
                    of = own[level][places]
                    n = places - np.searchsorted(own[level], of)
                    yield pa.RecordBatch.from_arrays([few.column(0).take(pa.array(of)), names.take(pa.array(queries)), pa.array(np.full(len(n), level), pa.int32()), pa.array(n, pa.int64()), pa.array(found, pa.float64())], names=schema.names)

    found = docs.select(key, column).mapInArrow(merge_texts, schema)
    return found.select(F.col("query").alias("query_id"), F.concat_ws(":", F.col("key_").cast("string"), "level", "n").alias("chunk_id"), "level", "score")
