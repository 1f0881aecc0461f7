"""License scan by diagonal voting (Arrow batches for hashes, Spark joins and groups for the votes).

Every rolling gram of K words of every text becomes a row (document, position, two 64-bit hashes), and Spark joins it to
the positions of the templates' grams. A match votes for the diagonal position - template position; votes of a diagonal
are gathered with partial sums, diagonals of a template that lie at most SLACK apart (words put in or left out) become
one span, and a span is verified by both hashes, by the share of the template's words that its matches cover, and by the
share of its own words that they cover. Only matches and one row a document leave a task; texts never cross the network.

The templates are a parameter; their grams are broadcast while they are BROADCAST at most, and joined by hash beyond.

Defined results: a null or empty text has no words, counts of 0, null places, no labels and a score of 0; a null doc_id is
carried, rows of an equal id or text are judged each; ties between templates give all their labels; a text of any length is
scanned whole; other columns are never read; an empty table gives no rows. A computed frame should be staged first,
so that a task that runs again numbers its rows alike."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .license_texts import TEMPLATES

#: Words of a gram, words by which neighbouring diagonals differ at most, least shares of the template and of the span.
K, SLACK, LEAST, DENSE = 5, 8, 0.6, 0.5
#: Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Template grams that are broadcast (24 bytes each).
BROADCAST = 100_000

_WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_known: dict[bytes, int] = {}


def words_of(text: bytes) -> list[bytes]:
    """Words of UTF-8 bytes, A-Z lower-cased; bytes of other letters are all above 0x7F."""
    return _WORDS.findall(text.lower())


def word_hashes(words: list[bytes]) -> np.ndarray:
    try:
        return np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))
    except KeyError:
        _known.update((w, xxhash.xxh3_64_intdigest(w)) for w in set(words) if w not in _known)
        return np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))


def gram_hashes(words: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of each run of k words, in order."""
    h = word_hashes(words)
    n = max(len(h) - k + 1, 0)
    first, second = np.full(n, k, np.uint64), np.full(n, ~k & 0xFFFFFFFF, np.uint64)
    for i in range(k):
        first = common.mix64(first ^ h[i : i + n])
        second = (second + h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        second ^= second >> np.uint64(31)
    return first.view(np.int64), second.view(np.int64)


def phrase_places(words: list[bytes], phrases: dict[str, str]) -> list[tuple[int, str]]:
    """(start, label) of every place where a phrase's words stand consecutively."""
    out = []
    for phrase, label in phrases.items():
        parts = phrase.encode().split()
        if parts[-1] in words:
            at = [i for i, w in enumerate(words) if w == parts[-1]]
            out += [(i - len(parts) + 1, label) for i in at if i >= len(parts) - 1 and words[i - len(parts) + 1 : i + 1] == parts]
    return sorted(out)


#: Grams of a row while they are hashed; a long text has several rows.
PIECE = 1 << 16
HEADS = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base"]
HEAD = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base array<string>"


def grams(docs: DataFrame, k: int, phrases: dict[str, str]) -> DataFrame:
    """number, position, hash, check and the head columns: a row for each gram. The head stands on a document's first
    row alone, which a document without grams has as well (position null)."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        for rows in common.slices(batches, "text", 1 << 20):
            texts = [words_of(t) for t in common.texts_of(rows)]
            sizes = np.array([len(words) for words in texts])
            first, second = gram_hashes([w for words in texts for w in words], k)  # those across two texts are left out
            starts = np.cumsum(sizes) - sizes
            counts = np.maximum(sizes - k + 1, 0)
            at = common.ranges(starts, counts)
            pieces = np.maximum(-(-counts // PIECE), 1)
            row = np.repeat(np.arange(len(sizes)), pieces)
            begin = PIECE * common.ranges(np.zeros(len(sizes), np.int64), pieces)
            edges = np.concatenate([[0], np.cumsum(np.minimum(counts[row] - begin, PIECE))]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(edges), pa.array(h[at])) for h in (first, second)]
            places = [phrase_places(words, phrases) for words in texts]
            found = [[a for a, _ in p] for p in places]
            head = pa.RecordBatch.from_arrays([
                rows.column(1), pa.array(sizes), pa.array([len(p) for p in found], pa.int64()), pa.array([min(p, default=None) for p in found], pa.int64()),
                pa.array([max(p, default=None) for p in found], pa.int64()), pa.array([sorted({b for _, b in p}) for p in places], pa.list_(pa.string())),
            ], HEADS).take(pa.array(np.where(begin == 0, row, -1), mask=begin > 0))
            if len(_known) > 1 << 20:
                _known.clear()
            yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(row)), pa.array(begin), *lists, *head.columns], ["number", "begin", "hashes", "checks", *HEADS])
        _known.clear()
        common.release()

    numbered = docs.select(F.monotonically_increasing_id().alias("number"), "doc_id", "text")
    whole = numbered.mapInArrow(run, f"number bigint, begin bigint, hashes array<bigint>, checks array<bigint>, doc_id {kind}, {HEAD}")
    each = whole.select("number", "begin", *HEADS, F.posexplode_outer(F.arrays_zip("hashes", "checks")).alias("place", "g"))
    position = F.col("begin") + F.col("place")
    heads = [F.when((F.col("begin") == 0) & (F.coalesce("place", F.lit(0)) == 0), F.col(c)).alias(c) for c in HEADS]
    return each.select("number", position.alias("position"), F.col("g.hashes").alias("hash"), F.col("g.checks").alias("check"), *heads)


def template_grams(spark: SparkSession, templates: list[tuple[str, str]], k: int) -> DataFrame:
    """hash, check, template, at, size, label of every gram of the templates."""
    rows = []
    for i, (label, text) in enumerate(templates):
        words = words_of(text.encode())
        rows += [(int(h), int(c), i, at, len(words), label) for at, (h, c) in enumerate(zip(*gram_hashes(words, k), strict=True))]
    _known.clear()
    found = spark.createDataFrame(rows, "hash bigint, check bigint, template int, at bigint, size bigint, label string")
    return F.broadcast(found) if len(rows) <= BROADCAST else found


def votes(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, k: int = K, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """A row for each document (template null) and for each document, template and diagonal that match:
    the template's places (ats), which a diagonal has once each."""
    left, right = grams(docs, k, phrases).alias("g"), template_grams(docs.sparkSession, templates, k).alias("t")
    meet = (F.col("g.hash") == F.col("t.hash")) & (F.col("g.check").bitwiseXOR(F.col("t.check")) == 0)
    matched = left.join(right, meet, "left").filter(F.col("n_words").isNotNull() | F.col("template").isNotNull())
    first = [F.first(c, ignorenulls=True).alias(c) for c in (*HEADS, "size", "label")]
    return matched.groupBy("number", "template", (F.col("position") - F.col("at")).alias("diagonal")).agg(F.collect_list("at").alias("ats"), *first)


def spans(found: DataFrame, k: int = K, slack: int = SLACK) -> DataFrame:
    """Diagonals of `votes` merged: number, template, label, start, stop (words of the text), votes, share, dense, the head columns."""
    w = Window.partitionBy("number", "template").orderBy("diagonal")
    new = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(w) > slack).cast("int"), F.lit(0))
    marked = found.withColumn("new", new).withColumn("span", F.sum("new").over(w))
    heads = [F.first(c, ignorenulls=True).alias(c) for c in (*HEADS, "size", "label")]
    merged = marked.groupBy("number", "template", "span").agg(
        F.flatten(F.collect_list("ats")).alias("ats"), F.min(F.col("diagonal") + F.array_min("ats")).alias("start"), (F.max(F.col("diagonal") + F.array_max("ats")) + k).alias("stop"), *heads
    )
    words = lambda at: F.sequence(at, at + (k - 1))
    covered = F.size(F.array_distinct(F.flatten(F.transform(F.array_distinct("ats"), words))))
    share = covered / F.col("size")
    return merged.select("number", "template", "label", "start", "stop", F.size("ats").alias("votes"), share.alias("share"), (covered / (F.col("stop") - F.col("start"))).alias("dense"), *HEADS)


def verified(least: float = LEAST, dense: float = DENSE):
    return F.col("template").isNotNull() & (F.col("share") >= least) & (F.col("dense") >= dense)


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, k: int = K, least: float = LEAST) -> DataFrame:
    """doc_id, n_words, base columns, spans (verified: label, start, stop, share), score of every document."""
    each = spans(votes(docs, templates, k), k)
    span = F.when(verified(least), F.struct("start", "stop", "label", "share"))
    heads = [F.first(c, ignorenulls=True).alias(c) for c in HEADS]
    return each.groupBy("number").agg(*heads, F.array_sort(F.collect_list(span)).alias("spans"), F.least(F.coalesce(F.max("share"), F.lit(0.0)), F.lit(1.0)).alias("score")).drop("number")


def report(docs: DataFrame) -> DataFrame:
    """One row for each document: labels of phrases, of both kinds, and the largest share of a template."""
    labels = F.array_sort(F.array_distinct(F.concat("base", F.transform("spans", lambda s: s["label"]))))
    return scan(docs).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.round("score", 9).alias("score"), F.size("spans").cast("bigint").alias("n_spans"),
    )
