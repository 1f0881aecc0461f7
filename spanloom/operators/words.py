"""Words of texts, also where no blanks part them: a lexicon counted from the corpus, the most probable path through each run, keywords."""

from __future__ import annotations

from unicodedata import normalize

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

#: Runs of Han letters are parted by the lexicon; runs of other letters and digits are words as they stand.
HAN = r"\p{IsHan}+"
PARTS = r"\p{IsHan}+|[\p{L}\p{N}&&[^\p{IsHan}]]+"


@F.arrow_udf(StringType())
def compatible(texts: pa.Array) -> pa.Array:
    return pa.array((None if t is None else normalize("NFKC", t) for t in texts.to_pylist()), pa.string())


def normalized(column: Column, breaks: bool = False) -> Column:
    """Compatibility form (NFKC) without control, format and private letters; null is empty. Line ends and tabs are controls: they go
    and join what they part, as the form for queries has it; with `breaks` they part words as a blank does."""
    text = F.coalesce(column, F.lit(""))
    return F.regexp_replace(compatible(F.regexp_replace(text, r"[\x09-\x0D\x85]", " ") if breaks else text), r"[\p{Cc}\p{Cf}\p{Co}]", "")


def _pieces(run: Column, longest: int) -> Column:
    """All pieces of a run of up to `longest` letters: start (from 0), piece."""
    at = lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.length(run) - i)), lambda n: F.struct(i.alias("start"), F.substr(run, i + 1, n).alias("piece")))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.length(run) - 1), at))


def lexicon(texts: DataFrame, column: str = "text", longest: int = 4, least: int = 2, cohesion: float = 10.0) -> DataFrame:
    """word, count: all Han letters, and pieces of 2 to `longest` letters that stand at least `least` times and hold together: however
    a piece is split, it is at least `cohesion` times as frequent as its two parts would meet by chance. Counts are over all texts."""
    runs = texts.select(F.explode(F.regexp_extract_all(normalized(F.col(column), breaks=True), F.lit(HAN), F.lit(0))).alias("run"))
    counts = runs.select(F.explode(_pieces(F.col("run"), longest)).alias("p")).groupBy(F.col("p.piece").alias("word")).agg(F.count(F.lit(1)).alias("count"))
    counts = counts.filter((F.length("word") == 1) | (F.col("count") >= least))
    total = counts.filter(F.length("word") == 1).agg(F.sum("count").alias("all_"))  # one row
    splits = counts.filter(F.length("word") > 1).select("word", "count", F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("n"))
    parts = splits.select("word", "count", F.substr("word", F.lit(1), F.col("n")).alias("head"), F.substr("word", F.col("n") + 1).alias("tail"))
    head, tail = (counts.select(F.col("word").alias(c), F.col("count").alias(f"{c}_")) for c in ("head", "tail"))
    by_chance = parts.join(head, "head").join(tail, "tail").crossJoin(F.broadcast(total)).groupBy("word", "count").agg(F.min(F.col("count") * F.col("all_") / (F.col("head_") * F.col("tail_"))).alias("tie_"))
    return counts.filter(F.length("word") == 1).unionByName(by_chance.filter(F.col("tie_") >= cohesion).select("word", "count"))


def best_path(letters: int, starts: list[int], sizes: list[int], scores: list[float]) -> list[int]:
    """Starts of the words of the best path: greatest sum, then fewest words, then the longest words first. Each letter is a word by itself."""
    edges: list[list] = [[] for _ in range(letters)]
    for start, size, score in zip(starts, sizes, scores):
        edges[start].append((size, score))
    best = [(0.0, 0, 0)] * (letters + 1)  # sum, words less than none, size of the first word
    for i in range(letters - 1, -1, -1):
        best[i] = max((score + best[i + size][0], best[i + size][1] - 1, size) for size, score in edges[i])
    out, i = [], 0
    while i < letters:
        out.append(i)
        i += best[i][2]
    return out


@F.arrow_udf(ArrayType(IntegerType()))
def _paths(letters: pa.Array, edges: pa.Array) -> pa.Array:
    rows = ([(e["start"], e["size"], e["score"]) for e in es] for es in edges.to_pylist())
    return pa.array([best_path(n, *map(list, zip(*es))) for n, es in zip(letters.to_pylist(), rows)], pa.list_(pa.int32()))


def segmented(rows: DataFrame, words: DataFrame, key: str, column: str = "text", longest: int = 4) -> DataFrame:
    """key, part, start, word: the words of each text in order of part (run of the normalized text) and start (in the run). Han runs go along
    the most probable path over `words` (word, count); letters that it lacks count as half an occurrence. Each distinct run is parted
    once; its pieces meet the lexicon by equality. A null or empty text has no words; keys must be distinct."""
    parts = rows.select(F.col(key).alias("key_"), F.posexplode(F.regexp_extract_all(normalized(F.col(column)), F.lit(PARTS), F.lit(0))).alias("part", "run"))
    han = F.col("run").rlike(rf"^{HAN}$")
    total = words.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("all_"))  # one row
    pieces = parts.filter(han).select("run").distinct().select("run", F.explode(_pieces(F.col("run"), longest)).alias("p")).select("run", "p.*")
    known = pieces.join(words.select(F.col("word").alias("piece"), "count"), "piece", "left").filter((F.length("piece") == 1) | F.col("count").isNotNull())
    score = F.log((F.coalesce(F.col("count").cast("double"), F.lit(0.5))) / (F.col("all_") + 1))
    edges = known.crossJoin(F.broadcast(total)).groupBy("run").agg(F.collect_list(F.struct("start", F.length("piece").alias("size"), score.alias("score"))).alias("edges"))  # some letters' worth of one run
    cut = edges.select("run", F.length("run").alias("n"), _paths(F.length("run"), F.col("edges")).alias("at"))
    stop = lambda i: F.coalesce(F.get("at", i + 1), F.col("n"))
    split = cut.select("run", F.transform("at", lambda a, i: F.struct(a.alias("start"), F.substr("run", a + 1, stop(i) - a).alias("word"))).alias("words"))
    inside = parts.filter(han).join(split, "run").select("key_", "part", F.explode("words").alias("w")).select("key_", "part", "w.start", "w.word")
    plain = parts.filter(~han).select("key_", "part", F.lit(0).alias("start"), F.col("run").alias("word"))
    return inside.unionByName(plain).withColumnRenamed("key_", key)


def keywords(rows: DataFrame, words: DataFrame, key: str, column: str = "text", stop_words: tuple[str, ...] = (), letters: int | None = 4096) -> DataFrame:
    """key, word, part, start: words of two letters or more that are no stop words, each once where it first stands. `letters`: a
    query is read up to so many letters (the form's limit for queries; None reads whole texts)."""
    asked = rows.select(key, (F.substr(column, F.lit(1), F.lit(letters)) if letters else F.col(column)).alias("text_"))
    found = segmented(asked, words, key, "text_").filter((F.length("word") >= 2) & ~F.col("word").isin(*stop_words) if stop_words else F.length("word") >= 2)
    return found.groupBy(key, "word").agg(F.min(F.struct("part", "start")).alias("at")).select(key, "word", "at.part", "at.start")
