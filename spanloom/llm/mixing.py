"""Mixing sources to target weights in fixed-length blocks.

Targets share the total size by weight; a target stops at MOST_PASSES times its source's
size and the excess is shared anew among the others. A source's texts are laid end to
end and cut every BLOCK words. The output is a row of slots in shards of SHARD_SLOTS. The
sources' counts in a shard are multinomial draws under one condition: over all shards they
add up to the sources' quotas of slots (free draws would miss a small source's target by
the square root of its slots). Such draws split in two without knowing the rest: the slots
of a range of shards fall to its halves by a multivariate hypergeometric draw, keyed by
the range. So a task walks down to its own shards alone, and finds on the way how many
slots of each source lie in front. Slot j of a source takes the block at position j mod n
of a pseudorandom permutation (a keyed Feistel network, walked until it falls below n) of
the source's n blocks, with a new key for each pass j div n; another such permutation
gives each slot its place in the shard. Slots join the blocks of the texts by (source, block), as numbers;
each text then travels once to the list of its slots, and once to its places in the output.

Running sums over texts are two-level (sums of hashed chunks of rows, then within a chunk), so a
source with a third of all rows is no single group. Weights, targets and quotas are
arithmetic over one row for each source, on the driver: at most MOST_SOURCES rows.

Defined results: null is a source of its own, last; null and empty texts have size 0 and
are taken 0 times; rows with equal ids are rows of their own; an empty table gives an
empty result; other columns are ignored, or carried by `mixed`. All draws are keyed by
fixed seeds, so reruns agree.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from . import common

BLOCK, SHARD_SLOTS, MOST_PASSES, MOST_SOURCES, SEED = 128, 8192, 3, 100_000, 20_240
#: Slots of a shard that lie together in the output of `mixed`.
RUN = 64
WEIGHTS = (1, 2, 3)


def targets(sizes: list[int], weights: list[float]) -> list[float]:
    """Shares of sum(sizes) by weight, none above MOST_PASSES times its size."""
    left, open_, out = float(sum(sizes)), list(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / total > MOST_PASSES * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = float(MOST_PASSES * sizes[i])
        open_ = [i for i in open_ if i not in set(over)]
        left -= sum(out[i] for i in over)
    return out


def permuted(j: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Position j of the key's pseudorandom permutation of 0..n-1."""
    bits = np.maximum(1, np.ceil(np.log2(np.maximum(n, 2)) / 2)).astype(np.uint64)
    bits = np.where((np.uint64(1) << (np.uint64(2) * bits)) < n.astype(np.uint64), bits + np.uint64(1), bits)
    mask = (np.uint64(1) << bits) - np.uint64(1)
    x, out = j.astype(np.uint64), np.zeros(len(j), np.int64)
    todo = np.arange(len(j))
    while len(todo):
        b, m, k = bits[todo], mask[todo], key[todo].astype(np.uint64)
        left, right = x[todo] >> b, x[todo] & m
        for turn in range(4):
            left, right = right, left ^ (common.mix64(right + k * np.uint64(0x9E3779B97F4A7C15) + np.uint64(turn << 56)) & m)
        x[todo] = left << b | right
        fits = x[todo] < n[todo].astype(np.uint64)
        out[todo[fits]] = x[todo[fits]]
        todo = todo[~fits]
    return out


@F.pandas_udf(LongType())
def word_count(texts: pd.Series) -> pd.Series:
    """Runs of anything but ASCII white space."""
    return texts.map(lambda t: len(t.encode().split()) if t else 0).astype("int64")


@F.pandas_udf(LongType())
def block_of_slot(j: pd.Series, n: pd.Series, key: pd.Series) -> pd.Series:
    j, n, key = (x.to_numpy(np.int64) for x in (j, n, key))
    return pd.Series(permuted(j % n, n, key * MOST_PASSES + j // n))


@F.pandas_udf(LongType())
def place_of_slot(at: pd.Series, n: pd.Series, key: pd.Series) -> pd.Series:
    return pd.Series(permuted(*(x.to_numpy(np.int64) for x in (at, n, key))))


def running_start(df: DataFrame, key: str, chunk: str, order: list[str], value: str) -> DataFrame:
    """Adds `start`: the sum of value over all earlier rows of the key, by (chunk, order)."""
    along = Window.partitionBy(key).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    chunks = df.groupBy(key, chunk).agg(F.sum(value).alias("chunk_sum")).select(key, chunk, F.coalesce(F.sum("chunk_sum").over(along), F.lit(0)).alias("chunk_start"))
    within = Window.partitionBy(key, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.join(chunks, [key, chunk]).withColumn("start", F.col("chunk_start") + F.coalesce(F.sum(value).over(within), F.lit(0))).drop("chunk_start")


def split(counts: np.ndarray, take: int, rng: np.random.Generator) -> np.ndarray:
    """How many of each kind are among `take` drawn without putting back."""
    rest = int(counts.sum())
    if rest < 10**9:
        return rng.multivariate_hypergeometric(counts, take, method="marginals")
    out = np.zeros(len(counts), np.int64)  # beyond numpy's sampler: normal marginals, one after the other
    for i, n in enumerate(counts.tolist()):
        mean = take * n / rest if rest else 0.0
        deviation = math.sqrt(max(0.0, mean * (1 - n / rest) * (rest - take) / max(1, rest - 1))) if rest else 0.0
        out[i] = min(n, take, max(0, take - (rest - n), round(rng.normal(mean, deviation))))
        rest, take = rest - n, take - int(out[i])
    return out


def shard_counts(quotas: np.ndarray, wanted: range, seed: int, shard_slots: int = SHARD_SLOTS):
    """(shard, counts, starts) of the wanted shards: slots of each source in it, and in front of it."""
    total = int(quotas.sum())
    slots = lambda low, high: min(high * shard_slots, total) - low * shard_slots
    open_ = [(0, math.ceil(total / shard_slots), quotas.astype(np.int64), np.zeros(len(quotas), np.int64))]
    while open_:
        low, high, counts, starts = open_.pop()
        if high <= wanted.start or low >= wanted.stop:
            continue
        if high - low == 1:
            yield low, counts, starts
            continue
        middle = (low + high) // 2
        left = split(counts, slots(low, middle), np.random.default_rng([seed, low, high]))
        open_ += [(middle, high, counts - left, starts + left), (low, middle, left, starts)]


def plan_slots(spark, quotas: list[tuple[int, int, int]], seed: int = SEED) -> DataFrame:
    """shard, number (of the source), j, block, place: every slot of the output. quotas: (number, slots, blocks).
    Its size is unknown to the planner, which would broadcast it: joins name their way."""
    quotas = [q for q in quotas if q[1]]
    if not quotas:
        return spark.createDataFrame([], "shard bigint, number int, j bigint, block bigint, place bigint")
    numbers, wanted, blocks = (np.array(x, np.int64) for x in zip(*quotas, strict=True))
    shard_slots = SHARD_SLOTS
    shards = math.ceil(int(wanted.sum()) / shard_slots)

    def draw(frames):
        for frame in frames:
            if not len(frame):
                continue
            out = []
            for shard, counts, starts in shard_counts(wanted, range(int(frame["id"].min()), int(frame["id"].max()) + 1), seed, shard_slots):
                some = counts > 0
                out.append(pd.DataFrame({"shard": shard, "number": numbers[some], "start": starts[some], "slots": counts[some], "first": (np.cumsum(counts) - counts)[some], "size": int(counts.sum()), "blocks": blocks[some]}))
            yield pd.concat(out)

    drawn = spark.range(0, shards, 1, min(shards, 4096)).mapInPandas(draw, "shard bigint, number int, start bigint, slots bigint, first bigint, size bigint, blocks bigint").filter("slots > 0")
    slots = drawn.select("*", F.explode(F.sequence("start", F.col("start") + F.col("slots") - 1)).alias("j"))
    block = block_of_slot(F.col("j"), F.col("blocks"), F.col("number").cast("bigint") + seed)
    place = place_of_slot(F.col("first") + F.col("j") - F.col("start"), F.col("size"), F.col("shard") + (seed << 32))
    return slots.select("shard", "number", "j", block.alias("block"), place.alias("place"))


def laid_texts(sizes: DataFrame, weights: tuple[float, ...], seed: int) -> tuple[DataFrame, DataFrame]:
    """(rows, slots). rows: row, doc_id, source, number, size, source_size, target and start, the
    words of its source in front of it. sizes: row, doc_id, source, size, a table in files."""
    spark = sizes.sparkSession
    found = sizes.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows")).limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources: weigh groups of sources instead")
    found.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    own = [r["size"] for r in found]
    wanted = targets(own, [weights[i % len(weights)] for i in range(len(found))])
    blocks = [math.ceil(n / BLOCK) for n in own]
    quotas = [(i, min(MOST_PASSES * b, round(t * b / n)), b) for i, (n, t, b) in enumerate(zip(own, wanted, blocks, strict=True)) if n]
    sources = spark.createDataFrame([(i, r["source"], n, t) for i, (r, n, t) in enumerate(zip(found, own, wanted, strict=True))], "number int, name string, source_size bigint, target double")
    chunks = max(16, math.isqrt(sum(r["rows"] for r in found)))  # as many chunks as rows in one: neither level grows faster
    rows = sizes.join(F.broadcast(sources), sizes["source"].eqNullSafe(sources["name"])).drop("name").withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(chunks)))
    return running_start(rows, "number", "chunk", ["doc_id", "row"], "size").drop("chunk"), plan_slots(spark, quotas, seed)


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(documents, slots). documents: doc_id, source, size, source_size, target, taken for every
    row. slots: shard, number (of the source), j, block, place, what fills the output.

    Weights are dealt to the sources in turn, by code point with null last."""
    sizes = common.staged(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")).withColumn("row", F.monotonically_increasing_id()), "mix-sizes")
    laid, slots = laid_texts(sizes, weights, seed)
    length = F.lit(BLOCK).cast("bigint")
    span = F.when(F.col("size") > 0, F.sequence(F.expr(f"start div {BLOCK}"), F.expr(f"(start + size - 1) div {BLOCK}")))
    pieces = laid.select("*", F.explode_outer(span).alias("block"))
    overlap = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * length) - F.greatest(F.col("start"), F.col("block") * length)
    times = slots.groupBy("number", "block").agg(F.count(F.lit(1)).alias("times"))
    taken = (
        pieces.join(times.hint("merge"), ["number", "block"], "left")
        .groupBy("row", "doc_id", "source", "size", "source_size", "target")
        .agg(F.sum(F.coalesce(overlap * F.col("times"), F.lit(0))).cast("bigint").alias("taken"))
    )
    return taken.drop("row"), slots


def cut_at_blocks(text: bytes, start: int) -> list[tuple[int, int, int]]:
    """(block, from, to) of a text whose first word is the start-th of its source. The pieces are
    the text: white space belongs to the word before it, that in front to the first word."""
    data = np.frombuffer(text, np.uint8)
    blank = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    words = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    if not len(words):
        return []
    first, last = start // BLOCK, (start + len(words) - 1) // BLOCK
    edges = [0, *words[np.arange(first + 1, last + 1) * BLOCK - start].tolist(), len(text)]
    return list(zip(range(first, last + 1), edges, edges[1:], strict=False))


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, seed: int = SEED, text_column: str = "text") -> DataFrame:
    """The mixed corpus in the columns of docs: for each slot, the pieces of texts in its block,
    each a row with the piece as its text. RUN slots lie together, in the order of the mix."""
    columns, kinds = docs.columns, [f.dataType.simpleString() for f in docs.schema.fields]
    row = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)))
    texts = docs.select(F.col("doc_id"), F.col("source"), F.col(f"`{text_column}`").alias("text"), row.alias("whole"))
    texts = texts.withColumn("whole", F.col("whole").dropFields(f"c{columns.index(text_column)}")) if len(columns) > 1 else texts
    staged = common.staged(texts.withColumn("size", word_count(F.col("text"))).filter("size > 0").withColumn("row", F.monotonically_increasing_id()), "mix-texts")
    laid, slots = laid_texts(staged.select("row", "doc_id", "source", "size"), weights, seed)
    whole = dict(staged.dtypes)["whole"]

    def cut(batches):
        for batch in common.slices(batches, "text", 2 << 20):
            slots_of = batch.column(2)
            block, shard, place = slots_of.flatten().flatten()
            ends, blocks = np.cumsum(slots_of.value_lengths().to_numpy()).tolist(), block.to_pylist()
            starts, owner, slot, piece, held = batch.column(1).to_pylist(), [], [], [], 0

            def rows(owner, slot, piece):
                own, at = pa.array(owner, pa.int64()), pa.array(slot, pa.int64())
                return pa.RecordBatch.from_arrays([shard.take(at), place.take(at), batch.column(1).take(own), pa.array(piece, pa.string()), batch.column(3).take(own)], ["shard", "place", "start", "piece", "whole"])

            for i, (text, begin, end) in enumerate(zip(common.texts_of(batch), [0, *ends], ends, strict=False)):
                edges = {number: (low, high) for number, low, high in cut_at_blocks(text, starts[i])}
                for k in range(begin, end):
                    low, high = edges[blocks[k]]
                    owner.append(i)
                    slot.append(k)
                    piece.append(text[low:high].decode())
                    held += high - low
                    if held > 2 << 20:  # a long text taken more than once
                        yield rows(owner, slot, piece)
                        owner, slot, piece, held = [], [], [], 0
            if owner:
                yield rows(owner, slot, piece)
        common.release()

    span = F.sequence(F.expr(f"start div {BLOCK}"), F.expr(f"(start + size - 1) div {BLOCK}"))
    met = laid.select("row", "number", "start", F.explode(span).alias("block")).join(slots.hint("merge"), ["number", "block"])
    # A row's list has an entry for each block it meets and each time it is taken: it is far shorter than the row's text.
    places = met.groupBy("row").agg(F.min("start").alias("start"), F.collect_list(F.struct("block", "shard", "place")).alias("slots"))
    pieces = staged.select("row", "text", "whole").join(places.hint("merge"), "row").select("text", "start", "slots", "whole").mapInArrow(cut, f"shard bigint, place bigint, start bigint, piece string, whole {whole}")
    ordered = pieces.repartition(common.parts(docs), "shard", F.expr(f"place div {RUN}")).sortWithinPartitions("shard", "place", "start")
    back = [F.col("piece").cast(k).alias(c) if c == text_column else F.col(f"whole.c{i}").alias(c) for i, (c, k) in enumerate(zip(columns, kinds, strict=True))]
    return ordered.select(*back)


def contract(docs: DataFrame) -> DataFrame:
    return mix(docs)[0].select("doc_id", "size", "source_size", "target", "taken")
