"""Suffix-array dedup: repeated strings by merging shard Burrows-Wheeler transforms.

Every window of LENGTH bytes that starts at two places or more, in any documents, is a
repeat; the bytes of all repeated windows are removed.

1. Cells. The anchor of a window is its rightmost least rolling hash of GRAM bytes; equal
   windows have equal anchors at equal distances. Consecutive windows of one anchor, cut
   at distance GRID, form a cell. All windows of a cell contain the same CORE bytes, whose
   hash is the cell's key: equal windows lie in cells of equal keys, and a cell whose key
   is found once holds no repeat. Cells cost a row for each hundred bytes or so, not texts.
2. Cells of a repeated key with equal contexts (all bytes of their windows, by a digest of 128 bits) are
   repeats of each other, window by window; they are counted before anything is moved.
   One of them goes on, with its multiplicity, where the key has other contexts.
3. The contexts go to tasks by key. A window is read as DEPTH symbols (hashes of 64 bits). A
   task cuts its windows into shards and builds each shard's transform: the suffixes'
   order and the symbol before each. Shards are merged pairwise by refining an interleave:
   it starts with all of one before all of the other; a pass reads the preceding symbols
   in the interleave's order and deals them out stably by symbol, which orders the
   suffixes of both by one symbol more, without comparing a suffix; boundaries between
   unequal neighbours are carried along and are the common prefixes. After DEPTH passes
   the intervals without a boundary are the windows that are equal; a second hash of 64 bits
   over the whole window must agree.
4. Keys of more than HOT contexts (a passage shorter than LENGTH in very many documents)
   would be too much for a task: their windows are counted one by one, by hash, with
   partial sums.

Defined results: null is an empty text; texts shorter than LENGTH keep all bytes; two rows
with equal id and text are two documents; equal windows within a text count, overlapping
ones too; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import spread_join
from .winnowing import least_positions, powers

LENGTH, GRAM, DEPTH = 400, 32, 2
#: Least bytes of a repeat that `digest` reports besides: passages of over 50 words are often shorter than LENGTH.
PASSAGE = 240
HOT, BIN, PIECE = 1000, 400_000, 1 << 21
SECOND = np.random.default_rng(11).permutation(256).astype(np.uint8)


@dataclass(frozen=True)
class Sizes:
    """Bytes of a window, of a cell's span of distances, of the core all its windows share, of a symbol."""

    length: int

    @property
    def grid(self) -> int:
        return (self.length - GRAM) // 2 + 1

    @property
    def core(self) -> int:
        return self.length - self.grid + 1

    @property
    def stride(self) -> int:
        return self.length // DEPTH


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums of (byte + 1) * BASE**i modulo 2**64 before each position."""
    up, _ = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return sums


def hashes_at(sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of data[start:stop]."""
    _, down = powers(len(sums))
    return common.mix64((sums[stop] - sums[start]) * down[start] + (stop - start).astype(np.uint64))


def cells_of(data: np.ndarray, lengths: np.ndarray, sizes: Sizes):
    """(document number, start, stop, key, place of the anchor) of all cells of texts laid end to
    end; start and stop count windows from the first text's first."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < sizes.length:
        return none, none, none, none.astype(np.uint64), none
    sums = prefix_sums(data)
    _, down = powers(n + 1)
    grams = (sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1] * np.uint64(0xD6E8FEB86659FD93)
    position = least_positions(grams, sizes.length - GRAM + 1)
    ends = np.cumsum(lengths)
    code = position * 2 + (position - np.arange(len(position)) >= sizes.grid)
    for end in ends[:-1]:  # windows across two documents
        code[max(0, end - sizes.length + 1) : end] = -1
    edge = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1], [True]]))
    start, stop, code = edge[:-1], edge[1:], code[edge[:-1]]
    start, stop, code = (x[code >= 0] for x in (start, stop, code))
    core = (code >> 1) - sizes.grid * (code & 1)
    key = hashes_at(sums, core, core + sizes.core) ^ (code & 1).astype(np.uint64)
    return np.searchsorted(ends, start, side="right"), start, stop, key, code >> 1


def rows_of(docs: DataFrame) -> DataFrame:
    """doc_id, text and row, a name for the row: its id where ids are whole numbers, none null and
    none repeated; else a hash of id and text, which equal rows share."""
    ids = docs.groupBy("doc_id").count()
    plain = dict(docs.dtypes)["doc_id"] in ("int", "bigint") and ids.filter("doc_id is null or count > 1").isEmpty()
    row = F.col("doc_id").cast("bigint") if plain else F.xxhash64("doc_id", "text")
    return docs.select("doc_id", "text", row.alias("row"))


def find_cells(rows: DataFrame, sizes: Sizes) -> DataFrame:
    """row, start, stop, key, context (128-bit digest of the bytes of all windows) of all cells.
    rows: text, row, at (where the text starts in the row's whole one)."""
    size = PIECE

    def run(batches):
        for batch in common.slices(batches, "text", 3 << 19):
            texts = common.texts_of(batch)
            # long texts are cut into pieces that share LENGTH - 1 bytes: a window lies in one piece, and a cell may be cut anywhere
            pieces = [(i, a, t[a : a + size + sizes.length - 1]) for i, t in enumerate(texts) for a in range(0, max(1, len(t) - sizes.length + 1), size)]
            data, lengths = b"".join(p for *_, p in pieces), np.array([len(p) for *_, p in pieces], np.int64)
            piece, start, stop, key, anchor = cells_of(np.frombuffer(data, np.uint8), lengths, sizes)
            view, tail = memoryview(data), sizes.length - 1
            context = [xxhash.xxh3_128_digest(view[a : b + tail], c) for a, b, c in zip(start.tolist(), stop.tolist(), (anchor - start).tolist(), strict=True)]
            document = np.array([i for i, *_ in pieces], np.int64)[piece]
            shift = np.array([a for _, a, _ in pieces], np.int64)[piece] - (np.cumsum(lengths) - lengths)[piece]
            shift += np.array(batch.column(2).to_pylist(), np.int64)[document]
            start, stop = start + shift, stop + shift
            yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(document)), pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32)), pa.array(key.view(np.int64)), pa.array(context, pa.binary())], ["row", "start", "stop", "key", "context"])
        common.release()

    return rows.select("text", "row", "at").mapInArrow(run, "row bigint, start int, stop int, key bigint, context binary")


class Shard:
    """Suffixes of fixed-length reads in order, with the symbol before each.

    element = t * reads + read for the suffix from symbol t on; t = DEPTH is the empty one."""

    def __init__(self, order, before, has, reads, group=None):
        self.order, self.before, self.has, self.reads, self.group = order, before, has, reads, group

    @classmethod
    def build(cls, symbols: np.ndarray) -> Shard:
        """The transform of reads (rows of symbols), by DEPTH passes of stable dealing."""
        reads, depth = symbols.shape
        flat = symbols.T.ravel()  # by element
        empty = np.arange(depth * reads, (depth + 1) * reads)
        order = np.concatenate([empty, np.arange(depth * reads)])
        for _ in range(depth):
            source = order[order >= reads] - reads
            order = np.concatenate([empty, source[np.argsort(flat[source], kind="stable")]])
        has = order >= reads
        before = np.zeros(len(order), np.uint64)
        before[has] = flat[order[has] - reads]
        return cls(order, before, has, reads)


def merge(a: Shard, b: Shard, depth: int) -> Shard:
    """Interleave two transforms by refinement; group numbers the intervals of equal suffixes."""
    bits = np.repeat(np.array([0, 1, 0, 1], np.int8), [a.reads, b.reads, len(a.order) - a.reads, len(b.order) - b.reads])
    empty, group = bits[: a.reads + b.reads].copy(), np.repeat([0, 1], [a.reads + b.reads, len(bits) - a.reads - b.reads])

    def laid(x, y):
        out = np.empty(len(bits), x.dtype)
        out[bits == 0], out[bits == 1] = x, y
        return out

    for _ in range(depth):
        has = laid(a.has, b.has)
        symbol, z, g = laid(a.before, b.before)[has], bits[has], group[has]
        deal = np.argsort(symbol, kind="stable")
        symbol, z, g = symbol[deal], z[deal], g[deal]
        boundary = np.ones(len(symbol), np.int64)
        boundary[1:] = (symbol[1:] != symbol[:-1]) | (g[1:] != g[:-1])
        bits = np.concatenate([empty, z])
        group = np.concatenate([np.zeros(len(empty), np.int64), np.cumsum(boundary)])
    # elements of the merged collection: t * (all reads) + read, b's reads after a's
    reads = a.reads + b.reads
    name = lambda s, shift: s.order // max(1, s.reads) * reads + s.order % max(1, s.reads) + shift
    return Shard(laid(name(a, 0), name(b, a.reads)), laid(a.before, b.before), laid(a.has, b.has), reads, group)


def merged_groups(symbols: np.ndarray, shards: int = 2) -> np.ndarray:
    """A number for each read, equal for equal reads: shards are built and merged pairwise."""
    level = [Shard.build(x) for x in np.array_split(symbols, max(2, shards))]
    while len(level) > 1:
        level = [merge(level[i], level[i + 1], symbols.shape[1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    whole = level[0]
    out = np.empty(whole.reads, np.int64)
    first = whole.order < whole.reads  # suffixes from symbol 0 on: whole reads
    out[whole.order[first]] = whole.group[first]
    return out


def windows_of(contexts: list[bytes], sizes: Sizes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of windows of each context, the symbols of all windows, and a second hash of each
    window, of other bytes: those of the context under a permutation."""
    lengths = np.array([len(c) for c in contexts], np.int64)
    data = np.frombuffer(b"".join(contexts), np.uint8)
    counts = lengths - sizes.length + 1
    at = common.ranges(np.cumsum(lengths) - lengths, counts)
    sums, other = prefix_sums(data), prefix_sums(SECOND[data])
    symbols = np.stack([hashes_at(sums, at + t * sizes.stride, at + (t + 1) * sizes.stride) for t in range(DEPTH)], 1)
    return counts, symbols, hashes_at(other, at, at + sizes.length)


def confirmed(group: np.ndarray, check: np.ndarray) -> np.ndarray:
    """Groups of windows that are equal by the second hash too."""
    order = np.lexsort((check, group))
    new = np.ones(len(order), bool)
    new[1:] = (group[order][1:] != group[order][:-1]) | (check[order][1:] != check[order][:-1])
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def repeated_runs(repeat: np.ndarray, counts: np.ndarray):
    """(context, first window, end) of the maximal runs of repeated windows."""
    owner = np.repeat(np.arange(len(counts)), counts)
    number = common.ranges(np.zeros(len(counts), np.int64), counts)
    starts = repeat & np.concatenate([[True], ~repeat[:-1] | (owner[1:] != owner[:-1])])
    ends = repeat & np.concatenate([~repeat[1:] | (owner[1:] != owner[:-1]), [True]])
    return owner[starts], number[starts], number[ends] + 1


def merge_contexts(contexts: DataFrame, sizes: Sizes) -> DataFrame:
    """row, start, stop of repeated windows. contexts: key, row, start, weight, bytes; all of a
    key go to one task, which takes them in order of key and judges whole keys at a time."""

    def judged(rows: list[tuple]):
        counts, symbols, check = windows_of([r[4] for r in rows], sizes)
        weights = np.repeat(np.array([r[3] for r in rows], np.int64), counts)
        group = confirmed(merged_groups(symbols), check)
        repeat = np.bincount(group, weights)[group] >= 2
        which, a, b = repeated_runs(repeat, counts)
        base = np.array([r[2] for r in rows], np.int64)[which]
        return pa.RecordBatch.from_arrays([pa.array([rows[w][1] for w in which], pa.int64()), pa.array((base + a).astype(np.int32)), pa.array((base + b).astype(np.int32))], ["row", "start", "stop"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= BIN and row[0] != held[-1][0]:
                    yield judged(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4]) - sizes.length + 1
        if held:
            yield judged(held)
        common.release()

    n = common.parts(contexts)
    dealt = contexts.select("key", "row", "start", "weight", "bytes").repartition(n, "key")
    return dealt.sortWithinPartitions("key").mapInArrow(run, "row bigint, start int, stop int")


def count_windows(contexts: DataFrame, sizes: Sizes) -> DataFrame:
    """The same for keys of too many contexts: windows are counted one by one, by two hashes of 64 bits."""

    def run(batches):
        for batch in common.slices(batches, "bytes", 1 << 20):
            rows = batch.to_pydict()
            counts, symbols, check = windows_of(rows["bytes"], sizes)
            hashes = common.mix64(symbols[:, 0] * np.uint64(0x9E3779B97F4A7C15) + symbols[:, 1])
            take = lambda n: pa.array(np.repeat(np.array(rows[n], np.int64), counts))
            at = np.repeat(np.array(rows["start"], np.int64), counts) + common.ranges(np.zeros(len(counts), np.int64), counts)
            yield pa.RecordBatch.from_arrays([take("row"), pa.array(at.astype(np.int32)), take("weight"), pa.array(hashes.view(np.int64)), pa.array(check.view(np.int64))], ["row", "start", "weight", "window", "check"])

    windows = contexts.select("row", "start", "weight", "bytes").mapInArrow(run, "row bigint, start int, weight bigint, window bigint, check bigint")
    twice = windows.groupBy("window", "check").agg(F.sum("weight").alias("n")).filter("n > 1").select("window", "check")
    return spread_join(windows, twice, ["window", "check"]).select("row", "start", (F.col("start") + 1).alias("stop"))


def candidates(rows: DataFrame, sizes: Sizes) -> DataFrame:
    """row, start, stop, key, weight, hot of the cells that matter, staged. key null: all windows of
    the cell are repeated. Else its windows are to be merged with those of the key's other
    cells (counted one by one, if hot)."""
    cells = common.staged(find_cells(rows, sizes), "cells")
    keys = cells.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("context").alias("c0"), F.max("context").alias("c1")).filter("n > 1").select("key", (F.col("c0") == F.col("c1")).alias("alike"))
    found = common.staged(spread_join(cells, keys, ["key"]), "repeated-cells")
    common.discard(cells)
    mixed = found.filter("not alike")
    first = F.min(F.struct("row", "start", "stop")).alias("cell")
    contexts = common.staged(mixed.groupBy("key", "context").agg(F.count(F.lit(1)).alias("weight"), first), "contexts")
    per_key = contexts.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("weight").alias("least"))
    equal = spread_join(mixed, contexts.filter("weight > 1").select("key", "context"), ["key", "context"])
    sure = found.filter("alike").select("row", "start", "stop").unionByName(equal.select("row", "start", "stop"))
    sure = sure.select("row", "start", "stop", F.lit(None).cast("bigint").alias("key"), F.lit(0).cast("bigint").alias("weight"), F.lit(False).alias("hot"))
    # a context found once asks; one of each of the others of its key answers
    asked = spread_join(contexts, per_key.filter("least = 1").select("key", "n"), ["key"]).select("cell.*", "key", "weight", (F.col("n") > HOT).alias("hot"))
    out = common.staged(sure.unionByName(asked), "candidates")
    common.discard(found), common.discard(contexts)
    return out


def removed_spans(runs, n: int, length: int = LENGTH) -> list[list[int]]:
    """Byte spans that runs of windows cover, joined where they touch."""
    spans: list[list[int]] = []
    for start, stop in sorted((r["start"], r["stop"]) for r in runs or ()):
        a, b = start, min(n, stop + length - 1)
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(b, spans[-1][1])
        else:
            spans.append([a, b])
    return spans


RESULT = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "regions", "row")
REGIONS = pa.list_(pa.struct([("at", pa.int32()), ("text", pa.binary())]))
RUNS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))


def strip(docs: DataFrame, with_kept: bool = True, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (binary, what remains; null if not
    wanted) of every row. length: bytes of a repeat.

    The texts are dealt by row once: a text none of whose cells is to be merged is finished
    there; only those that wait for a merge are kept and dealt again."""
    rows = rows_of(docs)
    return stripped(rows, rows, dict(docs.dtypes)["doc_id"], Sizes(length), with_kept).drop("regions", "row")


def stripped(rows: DataFrame, places: DataFrame, kind: str, sizes: Sizes, with_kept: bool = False, regions: int | None = None) -> DataFrame:
    """The columns of RESULT. places: text, row, at of all that may hold repeats. regions: the length
    from which repeated spans are returned with their bytes, in place of the digest."""
    by_row = candidates(places if "at" in places.columns else places.withColumn("at", F.lit(0)), sizes).groupBy("row").agg(F.collect_list(F.struct("start", "stop", "key", "weight", "hot")).alias("cells"))
    result = f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary, regions array<struct<at: int, text: binary>>, row bigint"
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), REGIONS, pa.int64())

    def finished(doc_id, text: bytes, runs, row) -> tuple:
        spans = removed_spans(runs, len(text), sizes.length)
        removed = sum(b - a for a, b in spans)
        if regions is not None:
            return doc_id, len(text), removed, len(spans), None, None, [{"at": a, "text": text[a:b]} for a, b in spans if b - a >= regions], row
        edges = [0, *(x for s in spans for x in s), len(text)]
        kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
        return doc_id, len(text), removed, len(spans), hashlib.sha256(kept).hexdigest(), kept if with_kept else None, None, row

    def first(batches):
        for batch in common.slices(batches, "text", 2 << 20):
            out, id_type = [], batch.column(0).type
            for doc_id, text, row, cells in zip(batch.column(0).to_pylist(), common.texts_of(batch), *(batch.column(i).to_pylist() for i in (2, 3)), strict=True):
                sure = [{"start": c["start"], "stop": c["stop"]} for c in cells or () if c["key"] is None]
                asked = [c for c in cells or () if c["key"] is not None]
                none = (None,) * 6
                if not asked:
                    out.append((*finished(doc_id, text, sure, row), *none, None))
                    continue
                out.append((doc_id, *none, row, text, sure, *none[:4], None))
                out += [(None, *none, row, None, None, c["key"], c["start"], c["weight"], c["hot"], text[c["start"] : c["stop"] + sizes.length - 1]) for c in asked]
            types = (id_type, *kinds, pa.binary(), RUNS, pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), types, strict=True)], [*RESULT, "text", "runs", "key", "start", "weight", "hot", "bytes"])
        common.release()

    def second(batches):
        for batch in common.slices(batches, "text", 2 << 20):
            out = [finished(d, t, [*(a or ()), *(b or ())], r) for d, t, a, b, r in zip(batch.column(0).to_pylist(), common.texts_of(batch), *(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(list(zip(*out, strict=True))[1:], kinds, strict=True))], list(RESULT))
        common.release()

    passed = rows.join(by_row, "row", "left").select("doc_id", "text", "row", "cells").mapInArrow(first, f"{result}, text binary, runs array<struct<start: int, stop: int>>, key bigint, start int, weight bigint, hot boolean, bytes binary")
    passed = common.staged(passed, "first-pass")
    contexts = passed.filter("key is not null").select("key", "row", "start", "weight", "hot", "bytes")
    merged = merge_contexts(contexts.filter("not hot"), sizes)
    if not (hot := contexts.filter("hot")).isEmpty():
        merged = merged.unionByName(count_windows(hot, sizes))
    more = merged.groupBy("row").agg(F.collect_set(F.struct("start", "stop")).alias("more"))
    waiting = passed.filter("text is not null").select("doc_id", "text", "row", "runs")
    late = waiting.join(more, "row", "left").select("doc_id", "text", "runs", "more", "row").mapInArrow(second, result)
    return passed.filter("n_bytes is not null").select(*RESULT).unionByName(late)


def digest(docs: DataFrame) -> DataFrame:
    """The columns of `strip` but for what is kept, and n_passage_bytes: the bytes covered by strings
    of PASSAGE bytes that also start elsewhere. They are reported, not removed. A string of LENGTH
    that repeats lies within such spans, wherever it starts, so only those are searched for it."""
    rows, kind = rows_of(docs), dict(docs.dtypes)["doc_id"]
    passages = common.staged(stripped(rows, rows.select("text", "row"), kind, Sizes(PASSAGE), regions=LENGTH).select("row", "n_removed", "regions"), "passages")
    places = passages.select("row", F.explode("regions").alias("r")).select("row", "r.text", "r.at")
    own = stripped(rows, places, kind, Sizes(LENGTH))
    shorter = passages.groupBy("row").agg(F.max("n_removed").alias("n_passage_bytes"))
    return own.join(shorter, "row").drop("row", "kept", "regions")
