"""Language-model scoring by a hierarchical Pitman-Yor bigram model.

Each previous token has a restaurant for the token after it; all restaurants share one
parent, whose customers are their tables; the parent's base is uniform over the
vocabulary and one unknown word. A restaurant with c customers and t tables of a word,
discount d and strength s predicts (c - d t + (s + d t_all) P(parent)) / (s + c_all).

Counting is exact. Buckets form a grid: the hash of the first token of a pair names the row,
that of the second the column. So a common context is dealt over a row and a common word
over a column, none is one group, and a word's hash is sent to a row and a column at
most. Tasks exchange packed arrays, not a row a token:

1. Batches of texts are cut into tokens; a batch sends each of its distinct pairs, with
   the documents that hold it and how often, to the pair's bucket.
2. Buckets add up the training counts of pairs and ask the words' services for what lies
   in other buckets: the word's count, its number of contexts (its customers at the
   parent, one table a context at first), and the number of words seen after it.
3. Gibbs: the state is the sizes of the tables of every pair (at its bucket) and of every
   word (at its service), carried from sweep to sweep in the exchanged tables; it starts
   with one table each. A sweep takes the customers of each pair away one after the other
   and seats them again given all others of the pair (an old table by size less discount,
   a new one by the strength of the restaurant, its tables and the parent's probability).
   Pairs go side by side: tables of other pairs and the parent are those of the last
   exchange, which follows every sweep. Services then let the customers of lost tables
   go, seat those of new ones and do a sweep of their own. A pair (word) of over GROUPS
   customers takes them away in GROUPS groups, each seated side by side given the rest.
4. BURN_IN sweeps are left out. After each of the SWEEPS sweeps that follow, the tables of
   all levels give predictive probabilities, which sum to 1; buckets score their pairs with
   the mean over these sweeps and add them up by document.

Draws come from counters hashed with the words, so a pair is seated alike wherever and
however often a task computes it; reruns and lost executors change nothing. Discounts
are fitted from the numbers of pairs (words) found once and twice.

Defined results: null and empty texts are one end token; a text follows an end token;
words unknown to training share the one unknown word; a null doc_id counts as held out
only if crc32 of the empty text says so (it does not); with no training text the model is
uniform; rows of equal doc_id are scored each; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BATCH, SERVICES, SWEEPS, BURN_IN = 8 << 20, 512, 3, 2
#: Most steps of a sweep, and customers that are expanded at once (one pair or word of more goes alone).
GROUPS, EXPANDED = 256, 1 << 20
#: Bits of a pair and a document that are sorted as one number; pairs of more are sorted apart.
PACKED = 64
STRENGTH, PARENT_STRENGTH = 1.0, 1.0
END = 0x5851F42D4C957F2D
GOLD = np.uint64(0x9E3779B97F4A7C15)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays in one compressed blob; unsigned integers in as few bytes as they need, by byte planes."""
    head, body = [len(arrays)], []
    for a in arrays:
        width = a.itemsize
        if a.dtype.kind in "iu":
            a = a.astype(np.uint64)
            width = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
            raw = np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8)[:, :width].T)
        else:
            raw = np.ascontiguousarray(a.view(np.uint8).reshape(-1, width).T)
        head += [len(a), width if a.dtype.kind in "iu" else -width]
        body.append(raw.tobytes())
    return zstandard.compress(np.array(head, np.int64).tobytes() + b"".join(body), 1)


def unpack(blob: bytes) -> list[np.ndarray]:
    data = zstandard.decompress(blob)
    count = int(np.frombuffer(data, np.int64, 1)[0])
    head = np.frombuffer(data, np.int64, 1 + 2 * count)[1:].reshape(-1, 2).tolist()
    at, out = 8 * (1 + 2 * count), []
    for n, width in head:
        size = n * abs(width)
        raw = np.frombuffer(data, np.uint8, size, at).reshape(abs(width), n)
        at += size
        if width > 0:
            wide = 4 if width <= 4 else 8
            full = np.zeros((n, wide), np.uint8)
            full[:, :width] = raw.T
            out.append(full.view(np.uint32 if wide == 4 else np.uint64).ravel())
        else:
            out.append(np.ascontiguousarray(raw.T).view(f"f{-width}").ravel())
    return out


def pack_words(words: np.ndarray) -> np.ndarray:
    """Ascending hashes as differences."""
    return np.diff(words, prepend=np.uint64(0))


def is_held_out(doc_id) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 1


def _turn(sweep: int, turn: int) -> np.uint64:
    return np.uint64(int(GOLD) * ((sweep << 12) + turn + 1) % (1 << 64))


def uniform(key: np.ndarray, sweep: int, turn: int, place: np.ndarray) -> np.ndarray:
    """64 random bits for each (key, sweep, turn, place)."""
    return common.mix64(common.mix64(key + _turn(sweep, turn)) + place.astype(np.uint64) * GOLD)


def thinned(tables: np.ndarray, sizes: np.ndarray, lost: np.ndarray, key: np.ndarray, sweep: int) -> tuple[np.ndarray, np.ndarray]:
    """Tables and sizes after `lost` customers of each item, drawn alike, are gone."""
    item = np.repeat(np.arange(len(tables)), tables)
    hit = np.flatnonzero(lost[item] > 0)
    if len(hit):
        slot = np.repeat(hit, sizes[hit])
        own = item[slot]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        counts = np.diff(np.append(first, len(own)))
        draw = uniform(key[own], sweep, 4095, np.arange(len(own)) - np.repeat(first, counts))
        order = np.lexsort((draw, own))
        rank = np.arange(len(own)) - np.repeat(first, counts)
        sizes = sizes - np.bincount(slot[order][rank < lost[own]], minlength=len(sizes)).astype(np.int64)
    return np.bincount(item[sizes > 0], minlength=len(tables)).astype(np.int64), sizes[sizes > 0]


def reseated(tables, sizes, fresh, outside, strength: float, discount: float, base, key, sweep: int) -> tuple[np.ndarray, np.ndarray]:
    """A Gibbs sweep over the customers of items (pairs or words). Each item has `tables`
    tables of the given sizes, one item's after the other's, and `fresh` customers not
    seated yet, that go first; `outside` tables of its restaurant belong to other items.
    A new table has the mass (strength + discount * all tables) * base. Tables and sizes after it."""
    tables, sizes, fresh = tables.astype(np.int64), sizes.astype(np.int64), fresh.astype(np.int64)
    first = np.cumsum(tables) - tables
    before = np.concatenate([[0], np.cumsum(sizes)])
    seated = before[first + tables] - before[first]
    customers = seated + fresh
    stays = (customers < 2) & (fresh == 0)
    kept, moved = np.flatnonzero(stays), np.flatnonzero(~stays)
    # by falling customers, so that the items of a chunk take about as many steps
    moved = moved[np.argsort((GROUPS + 1 - np.minimum(customers[moved], GROUPS + 1)).astype(np.uint16), kind="stable")]
    large, total = int((customers[moved] > GROUPS).sum()), np.cumsum(customers[moved])
    found, rows, at = [tables[kept]], [sizes[common.ranges(first[kept], tables[kept])]], 0
    while at < len(moved):
        end = len(moved) if at >= large else large
        stop = min(end, max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + EXPANDED, side="right"))))
        i = moved[at:stop]
        t, x = (_swept if at < large else _swept_singly)(tables[i], sizes[common.ranges(first[i], tables[i])], fresh[i], seated[i], outside[i], strength, discount, base[i], key[i], sweep)
        found.append(t)
        rows.append(x)
        at = stop
    items, found, rows = np.concatenate([kept, moved]), np.concatenate(found), np.concatenate(rows)
    tables[items], first[items] = found, np.cumsum(found) - found
    return tables, rows[common.ranges(first, tables)]


def _seats(sizes, slot, tables, fresh, seated, key, sweep):
    """The table of each customer, one item's after the other's: -1 for fresh ones, then the others in random order."""
    customers = seated + fresh
    start = np.cumsum(customers) - customers
    table = np.full(int(customers.sum()), -1)
    table[common.ranges(start + fresh, seated)] = np.repeat(slot, sizes)
    # one that followed the tables would favour some; one table has but one order
    mixed = np.flatnonzero(tables > 1)
    x, of = common.ranges((start + fresh)[mixed], seated[mixed]), np.repeat(np.arange(len(mixed)), seated[mixed])
    bits = np.uint64(len(mixed).bit_length())
    draw = uniform(key[mixed][of], sweep, 4094, x - start[mixed][of]) >> bits
    table[x] = table[x][np.argsort(of.astype(np.uint64) << (np.uint64(64) - bits) | draw)] if len(x) else table[x]
    return table


def _swept_singly(tables, sizes, fresh, seated, outside, strength, discount, base, key, sweep):
    """_swept for items of GROUPS customers at most, in falling order: every step takes one customer of each
    item that has so many, and what is the step's lies together."""
    customers = seated + fresh
    items, most = len(tables), int(customers[0])
    # an item's slots: its tables, then one for each customer that opens one
    spare = np.cumsum(tables + customers) - customers
    slot = common.ranges(spare - tables, tables)
    size = np.zeros(int(spare[-1] + customers[-1]), np.int64)
    size[slot] = sizes
    live_at = np.searchsorted(-customers, -np.arange(most), side="left")
    off = np.cumsum(live_at) - live_at
    of = np.repeat(np.arange(items), customers)
    table = np.empty(len(of), np.int64)
    table[off[np.arange(len(of)) - np.repeat(np.cumsum(customers) - customers, customers)] + of] = _seats(sizes, slot, tables, fresh, seated, key, sweep)
    del of
    t, any_fresh = tables.copy(), bool(fresh.any())
    mixed = [common.mix64(key + _turn(sweep, 0))]
    for step, live in enumerate(live_at.tolist()):
        here = table[off[step] : off[step] + live]
        others = np.minimum(seated[:live] + step, customers[:live] - 1) if any_fresh else customers[:live] - 1
        if any_fresh:
            had = np.flatnonzero(here >= 0)
            size[here[had]] -= 1
            t[had] -= size[here[had]] == 0
        else:
            size[here] -= 1
            t[:live] -= size[here] == 0
        own = t[:live]
        mass = (strength + discount * (outside[:live] + own)) * base[:live]
        chance = mass / (others - discount * own + mass)
        place = np.uint64(int(GOLD) * step % (1 << 64))
        new = (common.mix64(mixed[0][:live] + place) >> np.uint64(11)).astype(np.float64) / 2.0**53 < chance
        chosen = spare[:live] + step
        todo, turn = np.flatnonzero(~new), 1
        # where the others share a table, it is that of the customer before, or before the first the last
        shared = own[todo] == 1
        same = todo[shared]
        chosen[same] = table[off[step - 1] + same] if step else table[off[customers[same] - 1] + same]
        todo = todo[~shared]
        while len(todo):
            # a table by size is that of any other customer; it is kept by the odds size - discount : discount
            if turn == len(mixed) and turn < 4:
                mixed.append(common.mix64(key + _turn(sweep, turn)))
            draw = common.mix64((mixed[turn][todo] if turn < 4 else common.mix64(key[todo] + _turn(sweep, turn))) + place)
            number = customers[todo]
            pick = step + 1 + ((draw >> np.uint64(24)).astype(np.float64) / 2.0**40 * (number - 1)).astype(np.int64)
            pick -= np.where(pick >= number, number, 0)
            pick = table[off[pick] + todo]
            there = size[pick]
            keep = (draw & np.uint64(0xFFFFFF)).astype(np.float64) / 2.0**24 * there < there - discount
            if any_fresh:
                keep &= pick >= 0
            chosen[todo[keep]] = pick[keep]
            todo, turn = todo[~keep], turn + 1
        here[:] = chosen
        size[chosen] += 1
        own += new
    return t, size[size > 0]


def _swept(tables, sizes, fresh, seated, outside, strength, discount, base, key, sweep):
    items, slots = len(tables), len(sizes)
    owner = np.repeat(np.arange(items), tables)
    customers = seated + fresh
    start = np.cumsum(customers) - customers
    # -1 before a customer has a table; a customer at x that opens one gives it the slot slots + x
    table = _seats(sizes, np.arange(slots), tables, fresh, seated, key, sweep)
    size = np.concatenate([sizes, np.zeros(len(table), np.int64)])
    t, seated = tables.copy(), seated.copy()
    group = -(-customers // GROUPS)
    steps = -(-customers // group)
    by_steps = np.argsort(-steps, kind="stable")
    live_at = np.searchsorted(-steps[by_steps], -np.arange(1, int(steps.max(initial=0)) + 1), side="right")
    mixed = common.mix64(key + _turn(sweep, 0))
    for step, live in enumerate(live_at):
        own = by_steps[:live]
        begin = group[own] * step
        length = np.minimum(group[own], customers[own] - begin)
        it, place = np.repeat(own, length), common.ranges(begin, length)
        x = start[it] + place
        old = table[x]
        had = old >= 0
        left, of = old[had], it[had]
        np.subtract.at(size, left, 1)
        np.subtract.at(seated, of, 1)
        gone = np.flatnonzero(size[left] == 0)
        np.subtract.at(t, of[gone[np.unique(left[gone], return_index=True)[1]]], 1)
        table[x] = -1
        mass = (strength + discount * (outside[own] + t[own])) * base[own]
        chance = mass / (seated[own] - discount * t[own] + mass)
        new = (common.mix64(mixed[it] + place.astype(np.uint64) * GOLD) >> np.uint64(11)).astype(np.float64) / 2.0**53 < np.repeat(chance, length)
        chosen = slots + x
        todo, turn = np.flatnonzero(~new), 1
        # where the others share a table, it is that of the customer before the group, or before the first the last
        shared = np.repeat(t[own] == 1, length)[todo]
        chosen[todo[shared]] = table[np.repeat(start[own] + (begin - 1) % customers[own], length)[todo[shared]]]
        todo = todo[~shared]
        after, rest = np.repeat(begin + length, length), np.repeat(customers[own] - length, length)
        while len(todo):
            # a table by size is that of any other customer; it is kept by the odds size - discount : discount
            draw = uniform(key[it[todo]], sweep, turn, place[todo])
            ahead = ((draw >> np.uint64(24)).astype(np.float64) / 2.0**40 * rest[todo]).astype(np.int64)
            pick = table[start[it[todo]] + (after[todo] + ahead) % customers[it[todo]]]
            keep = (pick >= 0) & ((draw & np.uint64(0xFFFFFF)).astype(np.float64) / 2.0**24 * size[pick] < size[pick] - discount)
            chosen[todo[keep]] = pick[keep]
            todo, turn = todo[~keep], turn + 1
        table[x] = chosen
        np.add.at(size, chosen, 1)
        np.add.at(t, it, new.astype(np.int64))
        np.add.at(seated, it, 1)
    held = np.flatnonzero(size > 0)
    owner = np.concatenate([owner, np.repeat(np.arange(items), customers)])[held]
    return t, size[held[np.argsort(owner, kind="stable")]]


def discount_of(once: float, twice: float) -> float:
    return min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5


class Bucket:
    """All batches' pairs of a bucket, merged."""

    def __init__(self, table: pa.Table, services: int):
        blobs = [(b, unpack(x)) for b, h, x in zip(table.column("batch").to_pylist(), table.column("header").to_pylist(), table.column("blob").to_pylist(), strict=True) if not h]
        words = [np.cumsum(x[0], dtype=np.uint64) for _, x in blobs]
        none = np.zeros(0, np.uint64)
        self.words, place = np.unique(np.concatenate([*words, none]), return_inverse=True)
        place = place.astype(np.int32)
        shift = np.cumsum([0, *(len(w) for w in words)])
        del words
        joined = lambda i, kind: np.concatenate([*(x[i] for _, x in blobs), none[:0].astype(kind)]).astype(kind)
        code = np.concatenate([*(place[x[1].astype(np.int64) + s] * np.int64(len(self.words)) + place[x[2].astype(np.int64) + s] for (_, x), s in zip(blobs, shift, strict=False)), none.astype(np.int64)])
        code, pair = np.unique(code, return_inverse=True)
        self.u, self.w = (x.astype(np.int32) for x in np.divmod(code, max(1, len(self.words))))
        self.pair = np.repeat(pair.astype(np.int32), joined(3, np.int32))
        self.batches = [b for b, _ in blobs]
        self.batch = np.repeat(np.arange(len(blobs), dtype=np.int32), [len(x[4]) for _, x in blobs])
        self.doc, self.times = joined(4, np.int32), joined(5, np.int32)
        self.docs = [int(x[6][0]) for _, x in blobs]
        # by document: 1 if it is for training
        use = np.concatenate([*(x[7][x[4]].astype(np.int32) for _, x in blobs), none.astype(np.int32)])
        self.count = np.bincount(self.pair, self.times * use, minlength=len(code)).astype(np.int64)
        del blobs, place, pair, use
        self.key = common.mix64(self.words[self.u] * GOLD ^ self.words[self.w]) if len(code) else none
        self.service = (self.words % np.uint64(services)).astype(np.int64)

    def by_word(self, which: np.ndarray, values: np.ndarray) -> np.ndarray:
        return np.bincount(which, values, minlength=len(self.words))

    def shares(self, services: int):
        """The words of each service, in their order."""
        order = np.argsort(self.service, kind="stable")
        return np.split(order, np.searchsorted(self.service[order], np.arange(1, services)))


def settings_of(totals: np.ndarray) -> np.ndarray:
    """Training tokens, vocabulary and the discounts of parent and restaurants."""
    n, v, m1, m2, n1, n2 = totals.astype(np.float64)
    return np.array([n, v, discount_of(m1, m2), discount_of(n1, n2)])


def parent_of(contexts, tables, customers, all_tables, v: float, d0: float) -> np.ndarray:
    return (contexts - d0 * tables + (PARENT_STRENGTH + d0 * all_tables) / (v + 1)) / (PARENT_STRENGTH + customers)


def predictive(counts, tables, customers, all_tables, parent, d1: float):
    """P(word | context) by pair: its customers and tables, the context's customers and tables, the parent's P(word)."""
    backed = (counts - d1 * tables + (STRENGTH + d1 * all_tables) * parent) / (STRENGTH + customers)
    return np.where(customers > 0, backed, parent)


E_SCHEMA = "bucket int, batch bigint, header boolean, blob binary"
#: Keys below the number of services are services, the others buckets.
ROW_SCHEMA = "key int, kind int, origin int, sweep int, blob binary"
ASK_FIRST, MODEL, ANSWER_FIRST, STATE, PARENT, ASK, ANSWER = range(7)


def table_of(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[]] * 5
    return pa.table({n: pa.array(c, pa.binary() if n == "blob" else pa.int32()) for n, c in zip(("key", "kind", "origin", "sweep", "blob"), columns, strict=True)})


def blobs_of(table: pa.Table, kind: int, sweep: int | None = None) -> dict[int, list[np.ndarray]]:
    """Arrays by origin, in its order."""
    rows = zip(*(table.column(c).to_pylist() for c in ("origin", "kind", "sweep")), table.column("blob"), strict=True)
    return dict(sorted((o, unpack(b.as_py())) for o, k, s, b in rows if k == kind and sweep in (None, s)))


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct words and the end token, ascending, the place there of each text's end and words
    in turn (and of a last end), and the texts' numbers of tokens."""
    split = pa.compute.ascii_split_whitespace(pa.compute.ascii_lower(texts.fill_null("")))
    lengths, words = split.value_lengths().to_numpy().astype(np.int64), split.flatten().dictionary_encode()
    ids, empty = words.indices.to_numpy(), words.dictionary.index("").as_py()
    if empty >= 0:  # before white space, after it and of empty texts
        real = ids != empty
        lengths = np.bincount(np.repeat(np.arange(len(lengths)), lengths)[real], minlength=len(lengths)).astype(np.int64)
        ids = ids[real]
    words = words.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False)
    h = np.concatenate([np.array([END], np.uint64), np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))])
    order = np.argsort(h)
    place = np.empty(len(h), np.uint32)
    place[order] = np.arange(len(h))
    flat = np.full(len(ids) + len(lengths) + 1, place[0])
    word = np.ones(len(flat), bool)
    word[np.cumsum(lengths + 1) - lengths - 1] = word[-1] = False
    flat[word] = place[1:][ids]
    return h[order], flat, lengths + 1


def pairs_of(h: np.ndarray, flat: np.ndarray, lengths: np.ndarray, train: np.ndarray, grid: tuple[int, int]):
    """(bucket, blob) for the pairs of a batch, given its words."""
    doc = np.repeat(np.arange(len(lengths), dtype=np.uint64), lengths)
    bits, low = np.uint64(len(h).bit_length()), np.uint64(len(lengths).bit_length())
    code = flat[:-1].astype(np.uint64) << bits | flat[1:]
    if 2 * bits + low <= PACKED:  # pairs and documents in one number
        code = np.sort(code << low | doc)
        edge = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        times = np.diff(np.append(edge, len(code)))
        code, entry_doc = code[edge] >> low, code[edge] & ((np.uint64(1) << low) - np.uint64(1))
    else:
        order = np.argsort(code, kind="stable")
        code, doc = code[order], doc[order]
        edge = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])]))
        times = np.diff(np.append(edge, len(code)))
        code, entry_doc = code[edge], doc[edge]
    pair_first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    entries = np.diff(np.append(pair_first, len(code)))
    code = code[pair_first]
    u, w = (code >> bits).astype(np.int64), (code & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    high, (down, across) = h >> np.uint64(33), grid
    buckets = down * across
    row, column = ((high % np.uint64(n)).astype(np.int64) for n in grid)
    where = row[u] * across + column[w]
    order = np.argsort(where.astype(np.uint16) if buckets <= 1 << 16 else where, kind="stable")
    cut = np.searchsorted(where[order], np.arange(buckets + 1))
    at = np.zeros(len(h), np.int64)
    for b in range(buckets):
        p = order[cut[b] : cut[b + 1]]
        if not len(p):
            continue
        own = np.sort(np.concatenate([u[p], w[p]]))
        own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        at[own] = np.arange(len(own))
        e = common.ranges(pair_first[p], entries[p])
        yield b, pack(pack_words(h[own]), at[u[p]], at[w[p]], entries[p], entry_doc[e], times[e], np.array([len(lengths)]), train)


def score(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of every row."""
    buckets = buckets or common.parts(docs)
    grid = (int(buckets**0.5), -(-buckets // int(buckets**0.5)))
    buckets = grid[0] * grid[1]
    services = min(2 * grid[1], SERVICES)  # every bucket talks to every service: rows grow by the square root of the buckets more than they
    kind = dict(docs.dtypes)["doc_id"]

    def spread(batches):
        part, number = TaskContext.get().partitionId(), 0
        for rows in common.slices(batches, "text", BATCH):
            words = words_of(rows.column(1))
            train = np.array([not is_held_out(d) for d in rows.column(0).to_pylist()], np.int64)
            batch = (part << 32) + number
            number += 1
            out = [(b, batch, False, blob) for b, blob in pairs_of(*words, train, grid)]
            sink = pa.BufferOutputStream()
            head = pa.RecordBatch.from_arrays([rows.column(0), pa.array(words[2])], ["doc_id", "n_tokens"])
            with pa.ipc.new_stream(sink, head.schema) as writer:
                writer.write_batch(head)
            out.append((batch % buckets, batch, True, sink.getvalue().to_pybytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.bool_(), pa.binary()), strict=True)], ["bucket", "batch", "header", "blob"])

    def ask(table: pa.Table) -> pa.Table:
        number = table.column("bucket")[0].as_py()
        b = Bucket(table, services)
        seen, many = (b.count > 0).astype(np.int64), b.count > 1
        count, contexts, follow = (b.by_word(*x).astype(np.int64) for x in ((b.w, b.count), (b.w, seen), (b.u, seen)))
        own = np.array([(b.count == 1).sum(), (b.count == 2).sum()])
        shares = b.shares(services)
        rows = [(s, ASK_FIRST, number, 0, pack(pack_words(b.words[at]), count[at], contexts[at], follow[at], own * (s == number % services))) for s, at in enumerate(shares)]
        # the pairs of over one customer, with words by service; a pair of one has one table for ever
        order = np.concatenate(shares)
        rank = np.zeros(len(order), np.int64)
        rank[order] = np.arange(len(order))
        lone = [x[order] - np.bincount(y[many], minlength=len(order))[order] for x, y in ((contexts, b.w), (follow, b.u))]
        rows.append((services + number, MODEL, number, 0, pack(np.array([len(x) for x in shares]), rank[b.u[many]], rank[b.w[many]], b.count[many], b.key[many] >> np.uint64(32), *lone)))
        return table_of(rows)

    def serve_first(table: pa.Table) -> pa.Table:
        number = table.column("key")[0].as_py()
        if number >= services:
            return table_of([])
        asked = blobs_of(table, ASK_FIRST)
        every, place = np.unique(np.concatenate([np.cumsum(x[0], dtype=np.uint64) for x in asked.values()]), return_inverse=True)
        count, contexts, follow = (np.bincount(place, np.concatenate([x[i] for x in asked.values()]), minlength=len(every)).astype(np.int64) for i in (1, 2, 3))
        n1, n2 = np.sum([x[4] for x in asked.values()], 0)
        totals = np.array([count.sum(), (count > 0).sum(), (contexts == 1).sum(), (contexts == 2).sum(), n1, n2]).astype(np.int64)
        tables = (contexts > 0).astype(np.int64)
        sums = np.array([contexts.sum(), tables.sum()])
        places = np.split(place, np.cumsum([len(x[0]) for x in asked.values()])[:-1])
        rows = [(services + b, ANSWER_FIRST, number, 0, pack(count[p], contexts[p], tables[p], follow[p], sums, totals)) for b, p in zip(asked, places, strict=True)]
        return table_of([*rows, (number, PARENT, number, 0, pack(tables, contexts[contexts > 0]))])

    def seat(key, left: pa.Table, right: pa.Table, sweep: int) -> pa.Table:
        number = key[0].as_py()
        if number < services:
            return right.filter(pa.compute.equal(right.column("kind"), PARENT))
        lengths, u, w, customers, draws, lone_contexts, lone_follow = blobs_of(left, MODEL)[number - services]
        u, w, draws = u.astype(np.int64), w.astype(np.int64), common.mix64(draws)
        if sweep == 0:
            got = list(blobs_of(right, ANSWER_FIRST).values())
            settings = settings_of(np.sum([x[5] for x in got], 0))
            got = [x[1:5] for x in got]
            tables, sizes = np.ones(len(u), np.int64), customers
        else:
            got = list(blobs_of(right, ANSWER).values())
            settings, tables, sizes = blobs_of(right, STATE)[number - services]
        _, v, d0, d1 = settings
        contexts, parent_tables, follow = (np.concatenate([x[i] for x in got]).astype(np.float64) for i in range(3))
        sums = np.sum([x[3] for x in got], 0)
        parent = parent_of(contexts, parent_tables, *sums.astype(np.float64), v, d0)
        tables, sizes = reseated(tables, sizes, np.zeros(len(u), np.int64), follow[u] - tables, STRENGTH, d1, parent[w], draws, sweep)
        words = int(lengths.sum())
        contexts, follow = (a.astype(np.int64) + np.bincount(i, tables, minlength=words).astype(np.int64) for a, i in ((lone_contexts, w), (lone_follow, u)))
        cuts = np.cumsum(lengths)[:-1].astype(np.int64)
        rows = [(s, ASK, number - services, sweep, pack(c, f, settings, sums)) for s, (c, f) in enumerate(zip(np.split(contexts, cuts), np.split(follow, cuts), strict=True))]
        return table_of([*rows, (number, STATE, number - services, sweep, pack(settings, tables, sizes))])

    def serve(key, left: pa.Table, right: pa.Table, sweep: int) -> pa.Table:
        number = key[0].as_py()
        if number >= services:
            return right
        words = [np.cumsum(x[0], dtype=np.uint64) for x in blobs_of(left, ASK_FIRST).values()]
        asked = blobs_of(right, ASK)
        every, place = np.unique(np.concatenate(words), return_inverse=True)
        contexts, follow = (np.bincount(place, np.concatenate([x[i] for x in asked.values()]), minlength=len(every)).astype(np.int64) for i in (0, 1))
        _, v, d0, _ = next(iter(asked.values()))[2]
        all_tables = int(next(iter(asked.values()))[3][1])
        tables, sizes = (x.astype(np.int64) for x in blobs_of(right, PARENT)[number])
        before = np.bincount(np.repeat(np.arange(len(every)), tables), sizes, minlength=len(every)).astype(np.int64)
        draws = common.mix64(every)
        tables, sizes = thinned(tables, sizes, before - contexts, draws, sweep)
        tables, sizes = reseated(tables, sizes, np.maximum(contexts - before, 0), np.maximum(all_tables - tables, 0), PARENT_STRENGTH, d0, np.full(len(every), 1 / (v + 1)), draws, sweep)
        sums = np.array([contexts.sum(), tables.sum()])
        places = np.split(place, np.cumsum([len(x) for x in words])[:-1])
        rows = [(services + b, ANSWER, number, sweep, pack(contexts[p], tables[p], follow[p], sums)) for b, p in zip(asked, places, strict=True)]
        return table_of([*rows, (number, PARENT, number, sweep, pack(tables, sizes))])

    def judge(key, left: pa.Table, right: pa.Table) -> pa.Table:
        b = Bucket(left, services)
        out = []
        if len(b.pair):
            order = np.concatenate(b.shares(services))

            def placed(got, i):
                values = np.zeros(len(order))
                values[order] = np.concatenate([x[i] for x in got])
                return values

            got = list(blobs_of(right, ANSWER_FIRST).values())
            n, v, d0, d1 = settings_of(np.sum([x[5] for x in got], 0))
            count, tables, p = placed(got, 0), (b.count > 0).astype(np.float64), np.zeros(len(b.count))
            for sweep in range(BURN_IN, BURN_IN + SWEEPS):
                got = list(blobs_of(right, ANSWER, sweep).values())
                contexts, parent_tables, follow = (placed(got, i) for i in range(3))
                parent = parent_of(contexts, parent_tables, *np.sum([x[3] for x in got], 0).astype(np.float64), v, d0)
                tables[b.count > 1] = next(iter(blobs_of(right, STATE, sweep).values()))[1]
                p += predictive(b.count, tables, count[b.u], follow[b.u], parent[b.w], d1) / SWEEPS
            base = np.log10((count + 0.5) / (n + 0.5 * (v + 1)))[b.w]
            known = (count > 0)[b.w]
            own = np.log10(p)
            first = np.cumsum([0, *b.docs])
            at = first[b.batch] + b.doc
            sums = [np.bincount(at, b.times * x[b.pair], minlength=int(first[-1])) for x in (own, base, known)]
            for i, batch in enumerate(b.batches):
                cut = slice(first[i], first[i + 1])
                out.append((batch, False, pack(sums[0][cut], sums[1][cut], sums[2][cut].astype(np.int64), np.array([int(n)]))))
        out += [(batch, True, blob) for batch, header, blob in zip(left.column("batch").to_pylist(), left.column("header").to_pylist(), left.column("blob").to_pylist(), strict=True) if header]
        columns = list(zip(*out, strict=True)) or [[], [], []]
        return pa.table({"batch": pa.array(columns[0], pa.int64()), "header": pa.array(columns[1], pa.bool_()), "blob": pa.array(columns[2], pa.binary())})

    def gather(table: pa.Table) -> pa.Table:
        blobs, heads = table.column("blob").to_pylist(), table.column("header").to_pylist()
        parts = [unpack(x) for x, h in zip(blobs, heads, strict=True) if not h]
        head = pa.ipc.open_stream(next(x for x, h in zip(blobs, heads, strict=True) if h)).read_all()
        ids, tokens = head.column("doc_id"), head.column("n_tokens")
        total, base, known = (sum(p[i].astype(np.float64) for p in parts) for i in range(3))
        out = {"doc_id": ids.combine_chunks(), "held_out": pa.array([is_held_out(d) for d in ids.to_pylist()]), "n_tokens": tokens.combine_chunks(), "n_known": pa.array(known.astype(np.int64)), "train_tokens": pa.array(np.full(len(ids), int(parts[0][3][0]), np.int64)), "base_score": pa.array(base), "score": pa.array(total), "perplexity": pa.array(10.0 ** (-total / tokens.to_numpy()))}
        return pa.table(out)

    sent = docs.select("doc_id", "text").mapInArrow(spread, E_SCHEMA)
    asked = sent.groupBy("bucket").applyInArrow(ask, ROW_SCHEMA)
    first = asked.groupBy("key").applyInArrow(serve_first, ROW_SCHEMA).repartition("key")
    step = lambda before, run, sweep: asked.groupBy("key").cogroup(before.groupBy("key")).applyInArrow(lambda key, left, right: run(key, left, right, sweep), ROW_SCHEMA)
    served, heard = first, first
    for sweep in range(BURN_IN + SWEEPS):
        served = step(step(served, seat, sweep), serve, sweep)
        if sweep >= BURN_IN:
            # what both the next sweep and the judges read is dealt by key once, or the services would work twice
            served = served if sweep == BURN_IN + SWEEPS - 1 else served.repartition("key")
            heard = heard.unionByName(served)
    # a filter would slip below that exchange and make it another one; services' rows (negative buckets) meet no pairs
    heard = heard.select((F.col("key") - services).alias("bucket"), "kind", "origin", "sweep", "blob")
    parts = sent.groupBy("bucket").cogroup(heard.groupBy("bucket")).applyInArrow(judge, "batch bigint, header boolean, blob binary")
    return parts.groupBy("batch").applyInArrow(gather, f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, perplexity double")
