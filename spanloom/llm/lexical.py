"""Ranked lexical search by branch and bound over max trees (Arrow batches in tasks; stats, joins and bounds in Spark).

`index` cuts the documents of each task into blocks and stages two tables: documents with their lengths a block, and
postings a block and term, with the greatest count and least length among them. Blocks are made where the texts lie:
only postings of asked terms cross the network, never texts.

`search` knows the weights once the corpus is counted, and descends:
1. From the greatest count and least length of each (block, term) comes a bound of the term in the block; summed
   over an item's terms it bounds the block, the root of the item's tree there.
2. For each item the block of the highest bound is searched first; its k-th score is the item's threshold.
3. All blocks whose bound reaches the threshold are searched, those of equal bound too, as ties go by doc_id.
In a block every term has a tree of maxima over ranges of documents (leaves of LEAF documents, FAN children a
node). An item opens the nodes of the highest summed bounds first, WIDTH at a time, drops those below its k-th score,
keeps equal ones, and scores the documents of opened leaves exactly. Results are the exact top k.

Items are dealt into groups of about TERMS terms, and a task searches one block for one group, so memory follows the
block's size, not the number of items or documents. A longer item's trees have wider leaves. The asked terms are
broadcast while they are BROADCAST at most, and joined by hash beyond.

Defined results: a null or empty text has no terms and is never found, nor does it count in N; an item without terms has
no rows; rows of an equal item id are one item with all their terms; a null item id is an item of its own; documents of
an equal doc_id are found each; a null doc_id comes last among equal scores; other columns are never read; without
documents or items there are no rows."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Documents and bytes of text in a block; documents of a leaf, children of a node, nodes opened at once.
BLOCK, BLOCK_BYTES, LEAF, FAN, WIDTH = 16384, 32 << 20, 16, 8, 16
#: Terms of a group of items; asked terms that are broadcast (about 100 bytes each).
TERMS, BROADCAST = 4096, 200_000
#: Fixed values of the score.
TOP, ONE, BASE, HALF = 1_000_000_000, 1000, 20, 50

_TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text: bytes) -> list[bytes]:
    """Terms of UTF-8 bytes, only A-Z lower-cased."""
    return _TERM.findall(text.lower())


class Block:
    """Postings of a run of documents, gathered text by text."""

    def __init__(self):
        self.ids, self.terms, self.lengths, self.words, self.bytes = [], {}, [], [], 0

    def add(self, doc_id, text: bytes) -> None:
        words = terms_of(text)
        for w in [w for w in set(words) if w not in self.terms]:
            self.terms[w] = len(self.terms)
        self.ids.append(doc_id)
        self.lengths.append(len(words))
        self.words.append(np.fromiter(map(self.terms.__getitem__, words), np.int32, len(words)))
        self.bytes += len(text)

    def full(self) -> bool:
        return len(self.ids) >= BLOCK or self.bytes >= BLOCK_BYTES

    def postings(self) -> pa.RecordBatch:
        """term, df, most (count), least (length), docs and counts (int32 each, by place), a row for each term."""
        lengths = np.array(self.lengths)
        key = np.concatenate(self.words).astype(np.int64) * len(lengths) + np.repeat(np.arange(len(lengths)), lengths)
        key, count = np.unique(key, return_counts=True)
        term, doc = np.divmod(key, len(lengths))
        starts = np.flatnonzero(np.diff(term, prepend=-1))
        edges = pa.array(4 * np.append(starts, len(term)), pa.int32())
        blob = lambda x: pa.Array.from_buffers(pa.binary(), len(starts), [None, edges.buffers()[1], pa.py_buffer(x.astype("<i4").tobytes())])
        df = np.diff(np.append(starts, len(term)))
        most, least = (f.reduceat(x, starts).astype(np.int64) for f, x in ((np.maximum, count), (np.minimum, lengths[doc])))
        return pa.RecordBatch.from_arrays([pa.array(list(self.terms), pa.binary()), pa.array(df), pa.array(most), pa.array(least), blob(doc), blob(count)], POSTING)


POSTING = ["term", "df", "most", "least", "docs", "counts"]


def index(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Staged tables: blocks (block, ids, lengths) and postings (block and the columns of POSTING)."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        def emit(block):
            head = [pa.array([block.ids], pa.list_(ids)), pa.array([block.lengths], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array([number]), *head, *(pa.nulls(1, t) for t in kinds)], names)
            if any(block.lengths):
                found = block.postings()
                for at in range(0, found.num_rows, 8192):
                    part = found.slice(at, 8192)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(part.num_rows, number)), *(pa.nulls(part.num_rows, a.type) for a in head), *part.columns], names)

        names, kinds = ["number", "ids", "lengths", *POSTING], [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        block, number, ids = Block(), 0, None
        for rows in common.slices(batches):
            ids = rows.column(0).type
            for doc_id, text in zip(rows.column(0).to_pylist(), common.texts_of(rows), strict=True):
                block.add(doc_id, text)
                if block.full():
                    yield from emit(block)
                    block, number = Block(), number + 1
        if block.ids:
            yield from emit(block)
        common.release()

    schema = f"number bigint, ids array<{kind}>, lengths array<bigint>, term binary, df bigint, most bigint, least bigint, docs binary, counts binary"
    numbered = docs.select("doc_id", "text").mapInArrow(run, schema).withColumn("block", (F.spark_partition_id().cast("bigint") * (1 << 32)) + F.col("number"))
    whole = common.staged(numbered.drop("number"), "lexical-index")
    return whole.filter("term is null").select("block", "ids", "lengths"), whole.filter("term is not null").select("block", *POSTING)


def asked(items: DataFrame, item: str, text: str) -> DataFrame:
    """item, term, each once."""
    kind = dict(items.dtypes)[item]

    def run(batches):
        for rows in common.slices(batches, "text"):
            found = [sorted(set(terms_of(t))) for t in common.texts_of(rows)]
            at = np.repeat(np.arange(len(found)), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(at, pa.int64())), pa.array([w for f in found for w in f], pa.binary())], ["item", "term"])

    return items.select(F.col(item).alias("item"), F.col(text).alias("text")).mapInArrow(run, f"item {kind}, term binary").distinct()


def scores(weight: np.ndarray, count: np.ndarray, length: np.ndarray, n: int, total: int) -> np.ndarray:
    """weight * ((10**9 count) div (1000 count + 20 m)), m = 50 + (50 length n) div total."""
    m = (100 - HALF) + (HALF * length * n) // total
    return weight * ((TOP * count) // (ONE * count + BASE * m))


class Trees:
    """Exact scores of a block's postings for some terms, and trees of maxima over ranges of documents."""

    def __init__(self, weights: np.ndarray, docs: list[np.ndarray], counts: list[np.ndarray], lengths: np.ndarray, n: int, total: int):
        sizes = np.array([len(d) for d in docs])
        self.leaf = LEAF * max(1, -(-len(docs) // TERMS))
        self.docs = np.concatenate(docs).astype(np.int64)
        self.score = scores(np.repeat(weights, sizes), np.concatenate(counts).astype(np.int64), lengths[self.docs], n, total)
        term = np.repeat(np.arange(len(docs)), sizes)
        leaves = -(-len(lengths) // self.leaf)
        cell = term * leaves + self.docs // self.leaf
        self.edges = np.searchsorted(cell, np.arange(len(docs) * leaves + 1)).astype(np.int64)  # postings of (term, leaf)
        low = np.zeros(len(docs) * leaves, np.int64)
        starts = np.flatnonzero(np.diff(cell, prepend=-1))
        low[cell[starts]] = np.maximum.reduceat(self.score, starts)
        self.levels = [low.reshape(len(docs), leaves)]  # from leaves to roots
        while self.levels[-1].shape[1] > 1:
            below = self.levels[-1]
            self.levels.append(np.maximum.reduceat(below, np.arange(0, below.shape[1], FAN), axis=1))
        self.leaves, self.size = leaves, len(lengths)

    def exact(self, terms: np.ndarray, leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents of the leaves with a posting, and their scores."""
        cell = (terms[:, None] * self.leaves + leaves).ravel()
        at = common.ranges(self.edges[cell], self.edges[cell + 1] - self.edges[cell])
        docs, back = np.unique(self.docs[at], return_inverse=True)
        found = np.zeros(len(docs), np.int64)
        np.add.at(found, back, self.score[at])
        return docs, found

    def best(self, terms: np.ndarray, k: int, floor: int, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The k documents of highest score, `floor` at least, equal ones by `order`; falling."""
        top = len(self.levels) - 1
        bounds, level, node = np.array([self.levels[top][terms, 0].sum()]), np.array([top]), np.array([0])
        docs, found = np.empty(0, np.int64), np.empty(0, np.int64)
        while len(bounds):
            live = bounds >= floor  # equal bounds may hold ties
            bounds, level, node = bounds[live], level[live], node[live]
            if not len(bounds):
                break
            chosen = np.argpartition(-bounds, min(WIDTH, len(bounds)) - 1)[:WIDTH]
            rest = np.ones(len(bounds), bool)
            rest[chosen] = False
            opened = [(level[chosen], node[chosen])]
            bounds, level, node = bounds[rest], level[rest], node[rest]
            for at in np.unique(opened[0][0]):
                nodes = opened[0][1][opened[0][0] == at]
                if at == 0:
                    d, s = self.exact(terms, nodes)
                    s_ok = s >= floor
                    docs, found = np.concatenate([docs, d[s_ok]]), np.concatenate([found, s[s_ok]])
                    if len(docs) > k:
                        keep = np.lexsort((order[docs], -found))[:k]
                        docs, found = docs[keep], found[keep]
                        floor = max(floor, int(found[-1]))
                    continue
                below = self.levels[at - 1]
                children = (nodes[:, None] * FAN + np.arange(FAN)).ravel()
                children = children[children < below.shape[1]]
                sums = below[terms[:, None], children].sum(0)
                bounds, level, node = np.concatenate([bounds, sums]), np.concatenate([level, np.full(len(children), at - 1)]), np.concatenate([node, children])
        keep = np.lexsort((order[docs], -found))[:k]
        return docs[keep], found[keep]


def searched(work: DataFrame, wanted: DataFrame, blocks: DataFrame, kind: str, k: int, n: int, total: int) -> DataFrame:
    """item number, doc_id, score: the top k of each (number, block, floor) of work in its block.
    wanted: block, grp, term's weight, docs, counts, items (numbers that ask for the term)."""
    empty = {"numbers": "array<bigint>", "floors": "array<bigint>", "ids": f"array<{kind}>", "lengths": "array<bigint>", "weight": "bigint", "docs": "binary", "counts": "binary", "items": "array<bigint>"}
    side = lambda df, *own: df.select("block", "grp", *(F.col(c) if c in own else F.lit(None).cast(t).alias(c) for c, t in empty.items()))
    tasks = work.groupBy("block", "grp").agg(F.collect_list(F.struct("number", "floor")).alias("x")).select("block", "grp", F.col("x.number").alias("numbers"), F.col("x.floor").alias("floors"))
    heads = tasks.join(blocks, "block")
    rows = side(heads, "numbers", "floors", "ids", "lengths").unionByName(side(wanted.join(tasks.select("block", "grp"), ["block", "grp"], "left_semi"), "weight", "docs", "counts", "items"))

    def run(table: pa.Table) -> pa.Table:
        head = table.filter(table.column("numbers").is_valid()).to_pylist()[0]
        terms = table.filter(table.column("weight").is_valid())
        ints = lambda name: [np.frombuffer(x.as_buffer(), "<i4") for x in terms.column(name)]
        trees = Trees(terms.column("weight").to_numpy(), ints("docs"), ints("counts"), np.array(head["lengths"], np.int64), n, total)
        ids = head["ids"]
        order = np.empty(len(ids), np.int64)
        order[sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i]))] = np.arange(len(ids))
        asks: dict[int, list[int]] = {}
        for t, items in enumerate(terms.column("items").to_pylist()):
            for i in items:
                asks.setdefault(i, []).append(t)
        numbers, places, found = [], [], []
        for number, floor in zip(head["numbers"], head["floors"], strict=True):
            d, s = trees.best(np.array(asks[number]), k, max(floor, 1), order)
            numbers += [number] * len(d)
            places += d.tolist()
            found += s.tolist()
        of = table.schema.field("ids").type.value_type
        return pa.table({"number": pa.array(numbers, pa.int64()), "doc_id": pa.array([ids[p] for p in places], of), "score": pa.array(found, pa.int64())})

    return rows.groupBy("block", "grp").applyInArrow(run, f"number bigint, doc_id {kind}, score bigint")


def top(found: DataFrame, k: int) -> DataFrame:
    """The first k of each item; partial ranks cut each task's rows before they are dealt."""
    w = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 50, item: str = "item_id", text: str = "text") -> DataFrame:
    """item, rank, doc_id, score of the k documents of highest score for each item."""
    kind = dict(docs.dtypes)["doc_id"]
    blocks, postings = index(docs)
    pairs = common.staged(asked(items, item, text), "asked")
    numbers = common.staged(pairs.groupBy("item").agg(F.count(F.lit(1)).alias("terms")).withColumn("number", F.monotonically_increasing_id()), "items")
    counted = blocks.select(F.explode("lengths").alias("n")).agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    n, total = int(counted[0]), int(counted[1])
    all_terms = numbers.agg(F.coalesce(F.sum("terms"), F.lit(0))).first()[0]
    result = f"`{item}` {dict(items.dtypes)[item]}, rank int, doc_id {kind}, score bigint"
    if not n or not all_terms:
        return docs.sparkSession.createDataFrame([], result)
    grp = F.pmod(F.xxhash64("number"), F.lit(max(1, all_terms // TERMS))).cast("int")
    known = pairs.join(numbers.withColumn("grp", grp), pairs["item"].eqNullSafe(numbers["item"])).select("term", "number", "grp")
    terms = common.staged(known.groupBy("term", "grp").agg(F.collect_list("number").alias("items")), "terms")
    terms = F.broadcast(terms) if all_terms <= BROADCAST else terms
    hits = common.staged(postings.join(terms, "term"), "hits")
    df = hits.groupBy("term", "grp").agg(F.sum("df").alias("all")).select("term", "grp", F.floor(1000 * F.log((F.lit(2.0) * n + 2) / (F.lit(2.0) * F.col("all") + 1))).alias("weight"))
    weights = common.staged(df.filter("weight > 0"), "weights")
    wanted = hits.join(F.broadcast(weights) if all_terms <= BROADCAST else weights, ["term", "grp"])
    m = f"({100 - HALF} + ({HALF} * least * {n}L) div {total}L)"
    wanted = wanted.withColumn("bound", F.expr(f"weight * (({TOP}L * most) div ({ONE} * most + {BASE} * {m}))"))
    roots = common.staged(wanted.select("block", "grp", "bound", F.explode("items").alias("number")).groupBy("block", "grp", "number").agg(F.sum("bound").alias("bound")), "roots")
    first = roots.groupBy("number").agg(F.max_by("block", F.struct("bound", "block")).alias("block"))
    begun = roots.join(first, ["number", "block"]).select("number", "block", "grp", F.lit(1).cast("bigint").alias("floor"))
    given = wanted.select("block", "grp", "weight", "docs", "counts", "items")
    one = common.staged(top(searched(begun, given, blocks, kind, k, n, total), k), "found")
    floors = one.filter(F.col("rank") == k).select("number", F.col("score").alias("floor"))
    more = roots.join(floors, "number", "left").withColumn("floor", F.coalesce("floor", F.lit(1).cast("bigint"))).filter("bound >= floor")
    more = more.join(first.select("number", F.col("block").alias("done")), "number").filter("block != done").select("number", "block", "grp", "floor")
    two = searched(more, given, blocks, kind, k, n, total)
    best = top(one.drop("rank").unionByName(two), k)
    return best.join(numbers.select("number", "item"), "number").select(F.col("item").alias(item), F.col("rank").cast("int").alias("rank"), "doc_id", "score")
