"""Names that may mean the same: a lossless similarity join by matching blocks.

Two names of S letters in all reach a likeness t where their matching blocks hold need(S) = ceil(t S / 2) letters. The
other U = S - 2 need(S) letters at most separate the blocks, so there are U + 1 blocks or fewer, and the names
share need(S) - (q - 1)(U + 1) grams of q letters or more, in the same order and shifted by U places at most. Of the
rarest T - a + 1 of a name's T grams (a: the fewest shared ones), one is then shared with every partner: these
prefixes alone are joined, by kind, q, gram and partner's length. Each pair of lengths takes the largest q that
leaves a shared gram; letters alone (q = 1) always do, so the bound is proven for any threshold above 0.

Names of few letters share their grams with most others, and then that join meets more rows than there are pairs. Pairs are
therefore compared in tiles where this costs less: names that are nearly equal stand behind one of them, these heads are
dealt into blocks by length, and two blocks within reach are one task's work. There, letters in common and then the longest
common subsequence (as bits of a word, for many pairs at a time) bound the matching blocks from above. Both ways are exact.

Equal names of a kind are one class before the join: copies are members, never pairs."""

from __future__ import annotations

import difflib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..sources import store
from . import fuse

#: Longest grams tried, longest pairs of lengths that are broadcast.
LONGEST_GRAM, BROADCAST = 4, 200_000
#: Heads of a block, pairs that are compared in tiles without a look at grams, pairs whose subsequences are found at a time, names of the left at a time.
BLOCK, CHEAP, AT_ONCE, AT_LEFT = 8192, 2_000_000_000, 20_000, 128
#: Names that are looked at for the choice between tiles and grams, and pairs of a tile that cost as much as a row that meets by a gram.
LOOKED, MEETING = 20_000, 20
#: Kinds of letters in a tile, the last RARE shared; columns of counts; bits of the look at frequent letters, their mean share that is in use, first steps that are kept.
KINDS, RARE, COLUMNS, BITS, FULL, KEPT = 64, 16, 1024, 32, 1.0, 12
#: Letters of the grams that make names neighbours, heads that a name is tried against, members of a head.
ANCHOR, TRIED, MEMBERS = 12, 4, 16
#: Tasks for tiles.
MOST_TASKS = 4000


def classes(identities: DataFrame) -> DataFrame:
    """entity_type, name, id of each distinct name of a kind: the least identity_id stands for it; a null name is empty."""
    return identities.groupBy("entity_type", F.coalesce("name", F.lit("")).alias("name")).agg(F.min("identity_id").alias("id"), F.count(F.lit(1)).alias("members"))


def members(identities: DataFrame) -> DataFrame:
    """identity_id and the representative of its name, for every identity; kinds may be null."""
    found = classes(identities).withColumnsRenamed({"entity_type": "kind_", "name": "name_"})
    meet = F.col("entity_type").eqNullSafe(F.col("kind_")) & (F.coalesce("name", F.lit("")) == F.col("name_"))
    return identities.join(found, meet).select("identity_id", F.col("id").alias("representative"))


def gram_length(sizes: Column, need: Column) -> Column:
    """The largest q that leaves a shared gram for two names of `sizes` letters together."""
    out = F.lit(1)
    for q in range(2, LONGEST_GRAM + 1):
        out = F.when(shared_grams(sizes, need, F.lit(q)) >= 1, q).otherwise(out)
    return out


def shared_grams(sizes: Column, need: Column, q: Column) -> Column:
    return need - (q - 1) * (sizes - 2 * need + 1)


def length_pairs(names: DataFrame, least: Fraction) -> DataFrame:
    """short, long, q, shared, shift: lengths that occur and can reach the bound, in whole numbers."""
    p, q = least.numerator, least.denominator
    lengths = names.select(F.length("name").alias("n")).distinct()
    reach = F.expr(f"cast(n * {2 * q - p}L div {p}L as int)")  # 2 min(m, n) >= t (m + n)
    ranges = lengths.filter("n > 0").select(F.col("n").alias("short"), F.explode(F.sequence("n", reach)).alias("long"))
    found = ranges.join(lengths.withColumnRenamed("n", "long"), "long")
    sizes = F.col("short") + F.col("long")
    need = F.expr(f"cast(((short + long) * {p}L + {2 * q - 1}L) div {2 * q}L as int)")
    found = found.withColumn("need", need).filter("need <= short").withColumn("q", gram_length(sizes, F.col("need")))
    return found.select("short", "long", "q", shared_grams(sizes, F.col("need"), F.col("q")).alias("shared"), (sizes - 2 * F.col("need")).alias("shift"))


def prefixes(names: DataFrame, pairs: DataFrame) -> DataFrame:
    """id, entity_type, n, q, gram, place, rank: the rarest grams of each name, as many as its closest partners call for."""
    sides = pairs.select(F.col("short").alias("n"), "q", "shared").unionByName(pairs.select(F.col("long").alias("n"), "q", "shared"))
    fewest = sides.groupBy("n", "q").agg(F.min("shared").alias("shared"))
    sized = names.select("id", "entity_type", "name", F.length("name").alias("n")).join(_small(fewest), "n")
    cut = F.transform(F.sequence(F.lit(1), F.col("n") - F.col("q") + 1), lambda i: F.substr("name", i, F.col("q")))
    grams = sized.filter("q <= n").select("id", "entity_type", "n", "q", "shared", F.posexplode(cut).alias("place", "gram"))
    often = grams.groupBy("entity_type", "q", "gram").agg(F.count(F.lit(1)).alias("often"))
    rank = F.row_number().over(Window.partitionBy("id", "q").orderBy("often", "gram", "place"))
    ordered = grams.join(often, ["entity_type", "q", "gram"]).withColumn("rank", rank)
    return ordered.filter(F.col("rank") <= F.col("n") - F.col("q") + 2 - F.col("shared")).select("id", "entity_type", "n", "q", "gram", "place", "rank")


def _small(df: DataFrame) -> DataFrame:
    """df, broadcast if it has few rows (one for each pair of lengths)."""
    return F.broadcast(df) if df.count() <= BROADCAST else df


def candidates(names: DataFrame, least: Fraction) -> DataFrame:
    """a, b (ids): pairs of classes that share a gram of both prefixes within reach, each once. A name goes
    out once for each partner's length, so a gram's names meet only those of one length."""
    pairs = length_pairs(names, least)
    found = prefixes(names, pairs)
    plan = _small(pairs.select(F.col("short").alias("n"), "q", "long", "shift", "shared"))
    last = lambda n: F.col(n) - F.col("q") + 2 - F.col("shared")  # noqa: E731  of this pair of lengths
    out = found.join(plan, ["n", "q"]).filter(F.col("rank") <= last("n")).select("entity_type", "q", "gram", "long", "shift", "shared", F.col("id").alias("a"), F.col("place").alias("at"), F.col("n").alias("short"))
    own = found.select("entity_type", "q", "gram", F.col("n").alias("long"), F.col("id").alias("b"), "place", "rank")
    met = out.join(own, ["entity_type", "q", "gram", "long"])
    once = (F.col("short") < F.col("long")) | (F.col("a") < F.col("b"))
    near = F.abs(F.col("at") - F.col("place")) <= F.col("shift")
    return met.filter((F.col("rank") <= last("long")) & once & near & (F.col("a") != F.col("b"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def ratio(a: Column, b: Column, least: float = 0.0) -> Column:
    """Likeness of two strings by matching blocks, 0 to 1; null below `least`. Shared letters, which bound it, are counted first."""

    @F.pandas_udf(DoubleType())
    def of(x: pd.Series, y: pd.Series) -> pd.Series:
        out, matcher, second = [], difflib.SequenceMatcher(None), None
        for p, q in zip(x, y, strict=True):
            p, q = p or "", q or ""
            if q != second:
                matcher.set_seq2(q)  # what it keeps of the second serves every first
                second = q
            matcher.set_seq1(p)
            value = matcher.ratio() if matcher.quick_ratio() >= least else -1.0
            out.append(value if value >= least else None)
        return pd.Series(out, dtype="float64")

    return of(a, b)


def _common(a: str, b: str) -> int:
    """Letters of the longest common subsequence, for names of any length."""
    masks: dict[str, int] = {}
    for i, c in enumerate(b):
        masks[c] = masks.get(c, 0) | 1 << i
    whole = (1 << len(b)) - 1
    v = whole
    for c in a:
        m = masks.get(c, 0)
        v = (v + (v & m) | v & ~m) & whole
    return len(b) - v.bit_count()


def _coded(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of names as numbers, a row a name, 0 after its end; their lengths."""
    sizes = np.array([len(n) for n in names], dtype=np.int64)
    codes = np.zeros((len(names), max(sizes, default=0)), dtype=np.int64)
    codes[np.arange(codes.shape[1]) < sizes[:, None]] = np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), dtype="uint32").astype(np.int64) + 1
    return codes, sizes


def _kinds(codes: np.ndarray) -> np.ndarray:
    """Codes from 1 by frequency; the rarest share the last of KINDS. Letters that are taken for one another only raise what names have in common."""
    letters, place, often = np.unique(codes, return_inverse=True, return_counts=True)
    often = np.where(letters == 0, 0, often)
    rank = np.empty(len(letters), dtype=np.int64)
    rank[np.argsort(-often, kind="stable")] = np.arange(1, len(letters) + 1)
    kinds = np.where(rank <= KINDS - RARE, rank, KINDS - RARE + 1 + letters % RARE)
    return np.where(letters == 0, 0, kinds)[place].reshape(codes.shape).astype("uint8")


def _counts(codes: np.ndarray) -> np.ndarray:
    """Letters of each kind, a row a name."""
    out = np.zeros((len(codes), KINDS + 1), dtype=np.int64)
    for k in range(codes.shape[1]):
        out[np.arange(len(codes)), codes[:, k]] += 1
    return out[:, 1:]


def _steps(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts as columns of 0 and 1, those of the right times a number: with one more column, for what few names have beyond, their products
    are the letters in common, or more where counts are long."""
    reach = np.minimum(left.max(axis=0), right.max(axis=0))
    most = np.minimum(reach, np.quantile(right, 0.99, axis=0, method="higher"))
    beyond = np.maximum(np.minimum(right, reach) - most, 0).sum(axis=1)
    by = 1
    while (-(-most // by)).sum() > COLUMNS:
        by *= 2
    levels = -(-most // by)
    kind = np.repeat(np.arange(len(most)), levels)
    level = (np.arange(len(kind)) - np.repeat(np.cumsum(levels) - levels, levels)) * by
    return np.column_stack([left[:, kind] > level, np.ones(len(left))]).astype("float32"), np.column_stack([(np.minimum(right, most)[:, kind] > level) * by, beyond]).astype("float32")


def _masks(codes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of each kind of letter in the first `bits` letters, a row a kind; letters beyond them. A code of 0 is no letter."""
    place = np.cumsum(codes > 0, axis=1) - 1
    masks, rows = np.zeros((KINDS + 1, len(codes)), f"uint{bits}"), np.arange(len(codes))
    for k in range(codes.shape[1]):
        own = np.where(place[:, k] < bits, codes[:, k], 0)
        masks[own, rows] |= np.left_shift(np.ones(1, masks.dtype), (np.minimum(place[:, k], bits - 1)).astype(masks.dtype))
    masks[0] = 0
    return masks, np.maximum((codes > 0).sum(axis=1) - bits, 0)


def _subsequences(codes: np.ndarray, masks: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Longest common subsequence of each pair of a row of codes and a column of 64-bit masks."""
    out, flat, width = np.zeros(len(i), dtype=np.int64), masks.ravel(), masks.shape[1]
    base = codes.T.astype(np.int64) * width
    for n in range(0, len(i), AT_ONCE):
        x, y = i[n : n + AT_ONCE], j[n : n + AT_ONCE]
        v = np.full(len(x), 2**64 - 1, dtype="uint64")
        for k in range(int((codes[x] > 0).sum(axis=1).max())):
            u = v & flat[base[k][x] + y]
            v = (v + u) | (v ^ u)
        out[n : n + AT_ONCE] = np.bitwise_count(~v)
    return out


def close_pairs(codes: np.ndarray, cut: int, halves: np.ndarray, scale: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places (left, right) of pairs whose longest common subsequence may reach the sum of their halves / scale: all that do, and few others. The
    first `cut` rows of codes are the left; with `same` both sides are one list and each pair comes once.

    First a name meets all of the right with its frequent letters alone, as half of the steps and half of the bits tell most pairs apart: what these
    have in common in order, and the other letters (a product of matrices) in any, is a bound. Names go in the order of their frequent
    letters, so that the first steps are those of the name before. Pairs within the bound take all letters in order."""
    left, right = codes[:cut], codes[cut:]
    counts = _counts(codes)
    frequent = max(1, int((np.cumsum(counts[cut:], axis=1).mean(axis=0) <= FULL * BITS).sum()))
    masks, over = _masks(np.where(right <= frequent, right, 0), BITS)
    need = halves / scale
    least = need[:cut] - 0.01 - 1e-6 * need.max(initial=0)  # single precision may not lose a pair
    rest, others = _steps(counts[:cut, frequent:], counts[cut:, frequent:])
    others[:, -1] += over - need[cut:]
    others = np.ascontiguousarray(others.T)
    words = [row[(row > 0) & (row <= frequent)].tobytes() for row in left]
    order = sorted(range(cut), key=words.__getitem__)
    states = np.full((KEPT + 1, len(right)), 2**BITS - 1, masks.dtype)  # after each of the first steps
    v, u, w = (np.empty_like(states[0]) for _ in range(3))
    found, before = [], b""
    for n in range(0, cut, AT_LEFT):
        some = order[n : n + AT_LEFT]
        for i, bound in zip(some, rest[some] @ others):
            word = words[i]
            at = next((k for k, (a, b) in enumerate(zip(word[:KEPT], before)) if a != b), min(len(word), len(before), KEPT))
            before, now = word, states[at]
            for k in range(at, len(word)):
                to = states[k + 1] if k < KEPT else v
                np.bitwise_and(now, masks[word[k]], out=u)
                np.add(now, u, out=w)
                np.bitwise_xor(now, u, out=u)
                np.bitwise_or(w, u, out=to)
                now = to
            np.invert(now, out=u)
            bound += np.bitwise_count(u)
            js = np.flatnonzero(bound >= least[i])
            js = js[js > i] if same else js
            found.append((np.full(len(js), i), js))
    i, j = (np.concatenate(x) for x in zip(*found))
    masks, over = _masks(right, 64)
    keep = np.ones(len(i), dtype=bool)
    few = over[j] == 0  # longer names are left to the comparison of names
    keep[few] = _subsequences(left, masks, i[few], j[few]) >= -(-(halves[i[few]] + halves[cut:][j[few]]) // scale)
    return i[keep], j[keep]


def _alike(a: str, b: str, most: int) -> bool:
    """Whether `most` letters in all may part two names: each spoils one of b's pieces at most."""
    pieces, n = 2 * most + 1, len(b)
    return abs(len(a) - n) <= most and sum(b[n * k // pieces : n * (k + 1) // pieces] in a for k in range(pieces)) >= pieces - most


def gathered(names: DataFrame, least: Fraction) -> DataFrame:
    """entity_type, id, name, half, members (id, name): names of a kind that differ in very few letters stand behind one of them. A pair
    of d letters apart (those outside the common subsequence) is at most d + d1 + d2 apart in the names that the two stand behind,
    so these are compared alone, at a bound that all members keep: half / (2 q) of either side's letters, where least is p / q.

    Names that share the least hash of their long grams are neighbours in the order by which they are dealt, and only neighbours are tried: any
    grouping is right."""
    p, q = least.numerator, least.denominator
    kinds = dict(names.dtypes)
    schema = f"entity_type {kinds['entity_type']}, id {kinds['id']}, name string, half bigint, members array<struct<id:{kinds['id']},name:string>>"

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, key, ids, own = (batch.column(c).to_pylist() for c in ("entity_type", "key", "id", "name"))
            heads, halves, members, near, last = [], [], [], [], None
            for i, name in enumerate(own):
                near, last = near if (kind[i], key[i]) == last else [], (kind[i], key[i])
                for h in near[-TRIED:]:
                    head = own[heads[h]]
                    most = (q - p) * len(head) // (4 * q)
                    if len(members[h]) < MEMBERS and _alike(head, name, most) and (apart := len(head) + len(name) - 2 * _common(head, name)) <= most:
                        members[h].append({"id": ids[i], "name": name})
                        halves[h] = min(halves[h], q * (len(head) - apart) - (q - p) * len(name))
                        break
                else:
                    near.append(len(heads))
                    heads.append(i)
                    halves.append(p * len(name))
                    members.append([])
            few = batch.take(pa.array(heads, pa.int64()))
            group = pa.list_(pa.struct([("id", few.schema.field("id").type), ("name", pa.string())]))
            yield pa.RecordBatch.from_arrays([few.column("entity_type"), few.column("id"), few.column("name"), pa.array(halves, pa.int64()), pa.array(members, group)], names=["entity_type", "id", "name", "half", "members"])

    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length("name") - (ANCHOR - 1), F.lit(1))), lambda i: F.xxhash64(F.substr("name", i, F.lit(ANCHOR))))
    keyed = names.filter("entity_type is not null and name <> ''").select("entity_type", F.array_min(grams).alias("key"), "id", "name")
    order = ("entity_type", "key", "id")
    return keyed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(gather, schema)


def tiles(names: DataFrame, least: Fraction) -> tuple[DataFrame, DataFrame]:
    """(gathered names with their kind's block, pairs of blocks a, b that may hold a pair, a <= b). A block holds BLOCK of
    them at most, fewer where they are long, in order of length."""
    own = gathered(names, least).withColumn("n", F.length("name"))
    long = F.expr("greatest(0, cast(ceil(log2(n / 64D)) as int))")  # each doubling of the length halves a block
    block = F.col("long") * F.lit(1 << 32) + F.expr(f"(rank - 1) div greatest(1, shiftright({BLOCK}, long))")
    placed = store.staged(fuse.ranked(own, "entity_type", [F.asc("n"), F.asc("id")]).withColumn("long", long).withColumn("block", block).drop("rank", "long"), "blocks")
    ends = placed.groupBy("entity_type", "block").agg(F.max("n").alias("high"), F.min("half").alias("half"))
    side = lambda x: ends.select("entity_type", *(F.col(c).alias(f"{c}_{x}") for c in ("block", "high", "half")))
    meet = side("a").join(side("b"), "entity_type").filter(f"block_a <= block_b and half_a + half_b <= cast(high_a as bigint) * {2 * least.denominator}")
    return placed, meet.select("entity_type", F.col("block_a").alias("a"), F.col("block_b").alias("b"))


def by_tiles(names: DataFrame, least: Fraction, bound: float) -> DataFrame:
    """left_id, right_id, left_name, right_name, entity_type, score: all pairs, tile by tile; a task holds two blocks of names."""
    placed, pairs = tiles(names, least)
    sides = F.when(F.col("a") == F.col("b"), F.array(F.struct(F.col("a").alias("block"), F.lit(0).alias("side")))).otherwise(F.array(F.struct(F.col("a").alias("block"), F.lit(0).alias("side")), F.struct(F.col("b").alias("block"), F.lit(1).alias("side"))))
    calls = pairs.select("entity_type", "a", "b", F.explode(sides).alias("s")).select("entity_type", "a", "b", "s.block", "s.side")
    kind = dict(names.dtypes)
    p, q = least.numerator, least.denominator

    def compare(tile: pa.Table) -> pa.Table:
        rows = sorted(zip(*(tile.column(c).to_pylist() for c in ("side", "id", "name", "half", "members")), strict=True), key=lambda r: r[:2])
        left = [r for r in rows if r[0] == 0]
        right = [r for r in rows if r[0] == 1]
        same, cut = not right, len(left)
        heads = left + (right or left)
        own = [(i, n) for _, i, n, _, m in heads for i, n in [(i, n), *((x["id"], x["name"]) for x in m)]]  # every name, behind its head
        held = np.array([1 + len(r[4]) for r in heads], dtype=np.int64)
        first = np.cumsum(held) - held
        codes, sizes = _coded([n for _, n in own])
        codes = _kinds(codes)
        x, y = close_pairs(codes[first], cut, np.array([r[3] for r in heads], dtype=np.int64), 2 * q, same)
        if same:
            alone = np.flatnonzero(held[:cut] > 1)
            x, y = np.concatenate([x, alone]), np.concatenate([y, alone])
        y = y + cut
        each = held[x] * held[y]
        at = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        wide = np.repeat(held[y], each)
        i, j = np.repeat(first[x], each) + at // wide, np.repeat(first[y], each) + at % wide
        if same:
            once = (np.repeat(x + cut, each) != np.repeat(y, each)) | (at // wide < at % wide)
            i, j = i[once], j[once]
        used, j = np.unique(j, return_inverse=True)
        masks, over = _masks(codes[used], 64)
        keep, few = np.ones(len(i), dtype=bool), over[j] == 0
        keep[few] = 2 * q * _subsequences(codes, masks, i[few], j[few]) >= p * (sizes[i[few]] + sizes[used[j[few]]])
        matcher, out, second = difflib.SequenceMatcher(None), [], None
        both = sorted(((own[a], own[b]) if own[a][0] < own[b][0] else (own[b], own[a]) for a, b in zip(i[keep].tolist(), used[j[keep]].tolist())), key=lambda x: x[1][1])
        for (a, one), (b, other) in both:
            if other != second:
                matcher.set_seq2(other)  # what it keeps of the second serves every first
                second = other
            if max(len(one), len(other)) > 64 and 2 * q * _common(one, other) < p * (len(one) + len(other)):
                continue
            matcher.set_seq1(one)
            if (score := matcher.ratio()) >= bound:
                out.append((a, b, one, other, score))
        columns = list(zip(*out)) if out else [[]] * 5
        ids = tile.schema.field("id").type
        kinds = pa.array([tile.column("entity_type")[0].as_py()] * len(out), tile.schema.field("entity_type").type)
        typed = [pa.array(c, t) for c, t in zip(columns, (ids, ids, pa.string(), pa.string(), pa.float64()), strict=True)]
        return pa.Table.from_arrays([*typed[:4], kinds, typed[4]], ["left_id", "right_id", "left_name", "right_name", "entity_type", "score"])

    schema = f"left_id {kind['id']}, right_id {kind['id']}, left_name string, right_name string, entity_type {kind['entity_type']}, score double"
    met = calls.hint("shuffle_hash").join(placed, ["entity_type", "block"]).select("entity_type", "a", "b", "side", "id", "name", "half", "members")
    # by their number: tiles are few bytes and much work, so tasks of several tiles would be long
    return met.repartition(min(MOST_TASKS, 3 * pairs.count() + 1), "entity_type", "a", "b").groupBy("entity_type", "a", "b").applyInArrow(compare, schema)


def by_grams(names: DataFrame, least: Fraction, bound: float) -> DataFrame:
    """The same by shared grams of prefixes."""
    found = candidates(names, least)
    side = lambda key, name: names.select(F.col("id").alias(key), F.col("name").alias(name), "entity_type")
    named = found.join(side("a", "left_name"), "a").join(side("b", "right_name").drop("entity_type"), "b")
    scored = named.sortWithinPartitions("b").withColumn("score", ratio(F.col("left_name"), F.col("right_name"), bound)).filter("score is not null")
    return scored.select(F.col("a").alias("left_id"), F.col("b").alias("right_id"), "left_name", "right_name", "entity_type", "score")


def _tiles_cost_less(names: DataFrame, least: Fraction) -> bool:
    """Whether all pairs of a kind are few, or cost no more than the rows that meet by grams. Both ways give the same pairs, so this
    is judged by LOOKED names or so, by a hash of their ids; the share of pairs that meet is the same in all of them."""
    pairs = lambda df, *keys: df.groupBy(*keys).count().agg(F.sum(F.expr("cast(count as double) * count / 2"))).first()[0] or 0.0
    if pairs(names, "entity_type") <= CHEAP:
        return True
    some = names.filter(F.pmod(F.xxhash64("id"), F.lit(max(1, names.count() // LOOKED))) == 0)
    return pairs(prefixes(some, length_pairs(some, least)), "entity_type", "q", "gram") * MEETING >= pairs(some, "entity_type")


def suggestions(identities: DataFrame, least: float = 0.87) -> DataFrame:
    """left_id, right_id, left_name, right_name, entity_type, score: all pairs of different names of a kind whose
    likeness is `least` or more, between the representatives of the names (`members` has the rest). Pairs
    exactly at the bound count; an empty name is like no other."""
    if not 0 < least <= 1:
        raise ValueError("least must lie above 0 and not above 1")
    names, exact = store.staged(classes(identities.select("identity_id", "entity_type", "name")), "names"), Fraction(str(least))
    return by_tiles(names, exact, least) if _tiles_cost_less(names, exact) else by_grams(names, exact, least)
