"""MinHash near-dedup with SetSketch registers.

A text's set is its distinct word shingles, as 64-bit hashes. Each of REGISTERS hash
functions gives every shingle an exponential variate; the register holds its minimum on
an exponential scale of base B, truncated to 16 bits: floor(1 - log_B(min / RATE)).
Registers of a union are maxima, so sketches merge, and equal registers are about as
frequent as the sets are similar.

1. Texts with equal sets (a 128-bit digest) are one class; its least doc_id stands for it.
2. Bands of ROWS registers are hashed; classes that share a band meet in a bucket.
3. Every member of a bucket is compared with the bucket's least member: a joint
   maximum-likelihood estimate of the similarity from both sketches, then, unless that is
   MARGIN below the threshold, the exact similarity of the whole sets.
4. Components of the confirmed links. Buckets that still hold more than one component are
   compared within: all members of different components, in blocks of BLOCK members a
   task, by estimate and exact sets, skipping what a link has just joined. No pair leaves
   its task but the links that join something.
5. Components of all links.

So all pairs that share a band and are not yet known to be connected are confirmed on
full sets, large groups of copies are stars, and no list of pairs is written. A pair of
similarity s shares no band with probability (1 - s**ROWS)**BANDS: 3e-7 at 0.85 with 6
by 32, and for 0.8, 5 by 40: 1e-7.

Defined results: A-Z are lower-cased; words are runs without ASCII white space; a text of
fewer words than a shingle is one shingle; without words the set is empty and linked with
nothing; rows of equal doc_id are one document (linked); a null doc_id takes the component
of its class, or null and kept where no other document has one; an empty table gives an
empty result; other columns are ignored; ids are whole numbers, or texts of such (an error else).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components, spread_join

B, RATE = 1.001, 64.0
MARGIN, BLOCK, BLOCK_SHINGLES = 0.12, 256, 2_000_000
#: (rows of a band, bands) by threshold in percent.
BANDS = {85: (6, 32), 80: (5, 40)}
REMEMBERED = 150_000
_known: dict[bytes, int] = {}


def shingle_set(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of a text."""
    words = text.lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    known = _known
    if len(known) > REMEMBERED:
        known.clear()
    try:
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    except KeyError:
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    k = min(k, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = (out ^ h[i : len(h) - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(common.mix64(out))


def multipliers(registers: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(97).integers(0, 1 << 32, (2, registers, 1), dtype=np.uint64)
    return tuple((draw | np.uint64(1)).astype(np.uint32))


def sketch(hashes: np.ndarray, a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Registers (uint16) of a set of 64-bit hashes."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        h = a * x[None, i : i + 2048]
        h ^= h >> np.uint32(15)
        h *= c
        np.minimum(least, h.min(1), out=least)
    exponential = -np.log1p(-(least + 0.5) / 2.0**32)
    return np.clip(np.floor(1 - np.log(exponential / RATE) / np.log(B)), 0, 65535).astype(np.uint16)


def estimate(above: np.ndarray, below: np.ndarray, equal: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Similarity of greatest joint likelihood, by how many registers of the first sketch are
    above, below and equal to the second's, and the sets' sizes."""
    u, v = na / (na + nb), nb / (na + nb)
    top = np.minimum(u / v, v / u)[:, None]
    j = np.linspace(0, 1, 101)[None, :] * top
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (B - 1) / B) / np.log(B)
    more, less = p(u[:, None] - v[:, None] * j), p(v[:, None] - u[:, None] * j)
    tiny = 1e-12
    likelihood = above[:, None] * np.log(more + tiny) + below[:, None] * np.log(less + tiny) + equal[:, None] * np.log(np.maximum(1 - more - less, tiny))
    return j[np.arange(len(j)), likelihood.argmax(1)]


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, on whole sorted sets."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def sketches(docs: DataFrame, k: int, registers: int) -> DataFrame:
    """doc_id, n_shingles, class (128-bit digest of the set; null if empty), sketch; map-only."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        a, c = multipliers(registers)
        for rows in common.slices(batches, "text", 2 << 20):
            sets = [shingle_set(t, k) for t in common.texts_of(rows)]
            digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            own = [sketch(s, a, c).tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(own, pa.binary())], ["doc_id", "n_shingles", "class", "sketch"])
        _known.clear()
        common.release()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles bigint, class binary, sketch binary")


def band_keys(reps: DataFrame, rows: int, bands: int) -> DataFrame:
    """key, v: one row for each class and band."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            m = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, rows * bands)
            keys = np.empty((len(m), bands), np.uint64)
            for j in range(bands):
                key = np.full(len(m), j + 1, np.uint64)
                for i in range(j * rows, (j + 1) * rows):
                    key = common.mix64(key * np.uint64(0x9E3779B97F4A7C15) + m[:, i])
                keys[:, j] = key
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(zero_copy_only=False), bands))], ["key", "v"])

    return reps.select("v", "sketch").mapInArrow(run, "key bigint, v bigint")


def sets_of(docs: DataFrame, nodes: DataFrame, k: int, registers: int) -> DataFrame:
    """v, sketch, hashes of the documents that nodes (v) name, from their whole texts."""

    def run(batches):
        a, c = multipliers(registers)
        for rows in common.slices(batches):
            sets = [shingle_set(t, k) for t in common.texts_of(rows)]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([sketch(s, a, c).tobytes() for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["v", "sketch", "hashes"])
        _known.clear()
        common.release()

    found = docs.select(F.col("doc_id").cast("bigint").alias("v"), "text").join(nodes, "v", "left_semi")
    return found.mapInArrow(run, "v bigint, sketch binary, hashes binary")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """u, v of the pairs whose whole sets are linked; sketches decide whom to spare the check."""
    side = lambda name: sets.select(F.col("v").alias(name), F.col("sketch").alias(f"sketch_{name}"), F.col("hashes").alias(f"hashes_{name}"))
    joined = spread_join(spread_join(pairs, side("v"), ["v"]), side("u"), ["u"]).select("u", "v", "sketch_u", "sketch_v", "hashes_u", "hashes_v")

    def run(batches):
        for batch in batches:
            us, vs = [], []
            for i in range(batch.num_rows):
                a, b = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint64) for c in (4, 5))
                x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint16) for c in (2, 3))
                counts = (np.array([(x > y).sum()]), np.array([(x < y).sum()]), np.array([(x == y).sum()]))
                guess = estimate(*counts, np.array([len(a)]), np.array([len(b)]))[0]
                if guess >= percent / 100 - MARGIN and linked(a, b, percent):
                    us.append(batch.column(0)[i].as_py()), vs.append(batch.column(1)[i].as_py())
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return joined.mapInArrow(run, "u bigint, v bigint")


def within_buckets(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links that join different components of a bucket. members: key, v, c (component), size (of the set).

    A bucket has as many blocks as keep one under BLOCK members and BLOCK_SHINGLES shingles."""
    several = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("shingles"), F.min("c").alias("c0"), F.max("c").alias("c1"), F.sum(F.xxhash64("v").cast("decimal(20,0)")).alias("sum"))
    # buckets of the same members are compared once
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    once = several.filter("c0 < c1").withColumn("blocks", blocks).groupBy("n", "sum").agg(F.min("key").alias("key"), F.first("blocks").alias("blocks")).select("key", "blocks")
    placed = spread_join(members, once, ["key"]).withColumn("block", F.pmod(F.xxhash64("v", "key"), F.col("blocks")).cast("int"))
    paired = placed.select("key", "v", "c", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = spread_join(paired.select("key", "v", "c", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")), sets, ["v"])

    def run(table: pa.Table) -> pa.Table:
        v, c, block = (table.column(n).to_numpy() for n in ("v", "c", "block"))
        cross = table.column("i")[0].as_py() != table.column("j")[0].as_py()
        registers = np.stack([np.frombuffer(x, np.uint16) for x in table.column("sketch").to_pylist()])
        sets_ = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
        size = np.array([len(s) for s in sets_])
        root: dict = {}

        def find(x):
            while x in root:
                x = root[x]
            return x

        us, vs = [], []
        for i in range(len(v) - 1):
            rest = np.arange(i + 1, len(v))
            rest = rest[(c[rest] != c[i]) & (100 * np.minimum(size[rest], size[i]) >= percent * np.maximum(size[rest], size[i]))]
            if cross:
                rest = rest[block[rest] != block[i]]
            if not len(rest):
                continue
            equal = (registers[rest] == registers[i]).sum(1)
            more = (registers[rest] < registers[i]).sum(1)
            guess = estimate(more, registers.shape[1] - equal - more, equal, np.full(len(rest), size[i]), size[rest])
            order = np.argsort(-guess)
            for o in order[guess[order] >= percent / 100 - MARGIN]:
                j = rest[o]
                x, y = find(c[i]), find(c[j])
                if x != y and linked(sets_[i], sets_[j], percent):
                    root[max(x, y)] = min(x, y)
                    us.append(v[i]), vs.append(v[j])
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    return dealt.groupBy("key", "i", "j").applyInArrow(run, "u bigint, v bigint")


def with_components(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """Adds c: v's component, v itself where it has no link."""
    return spread_join(nodes, found.select(F.col("u").alias("v"), F.col("v").alias("c")), ["v"], "left").withColumn("c", F.coalesce("c", "v"))


def near_duplicates(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable), kept, for every row."""
    rows, bands = BANDS[percent]
    kind = dict(docs.dtypes)["doc_id"]
    every = common.staged(sketches(docs, k, rows * bands), "sketches")
    some = every.filter("class is not null and doc_id is not null")
    reps = common.staged(some.groupBy("class").agg(F.min("doc_id").cast("bigint").alias("v"), F.first("sketch").alias("sketch"), F.first("n_shingles").alias("size")), "classes")
    keys = band_keys(reps, rows, bands)
    hubs = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("hub")).filter("n > 1").select("key", "hub")
    members = common.staged(spread_join(keys, hubs, ["key"]), "members")
    sets = common.staged(sets_of(docs, members.select("v").distinct(), k, rows * bands), "sets")
    stars = members.filter("v != hub").select(F.col("hub").alias("u"), "v").distinct()
    links = common.staged(confirm(stars, sets, percent), "links")
    first = components(links)
    sized = spread_join(members.select("key", "v"), reps.groupBy("v").agg(F.max("size").alias("size")), ["v"])
    inner = common.staged(within_buckets(with_components(sized, first), sets, percent), "links")
    last = components(first.unionByName(inner)) if not inner.isEmpty() else first
    whole = common.staged(with_components(reps.select("class", "v"), last).groupBy("class").agg(F.min("c").alias("c")), "found")
    joined = every.drop("sketch").join(whole, "class", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("c").cast(kind))
    return joined.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def deduplicated(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The rows of docs, all columns, but one alone of each group of near duplicates: that of the
    least doc_id. A row with a null doc_id stays only where no row of its group has an id, and
    then one of equal texts; of rows with an equal doc_id one stays."""
    text = F.coalesce("text", F.lit(""))
    stand_in = F.xxhash64(text).bitwiseAND(F.lit((1 << 62) - 1)) + F.lit(1 << 62)  # above any real id
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.coalesce(F.col("doc_id").cast("bigint"), stand_in).alias("doc_id"), text.alias("text"))
    found = common.staged(near_duplicates(rows.select("doc_id", "text"), k, percent), "near-duplicates")
    repeated = not found.groupBy("doc_id").count().filter("count > 1").isEmpty()
    kept = rows.select("row", "doc_id").join(found.filter("kept").select("doc_id").distinct(), "doc_id")
    kept = kept.dropDuplicates(["doc_id"]) if repeated else kept
    return kept.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))
