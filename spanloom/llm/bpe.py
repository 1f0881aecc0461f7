"""Byte-level BPE encoding and decoding in length-bucketed padded numpy matrices.

Text is cut by the public pattern; each distinct piece of a task is encoded once.
Pieces of like byte length share one padded matrix of token ids. In each round every
row merges its leftmost pair of minimum rank: pairs are looked up in an open-addressed
hash table, the row closes up by one column, only the two pairs beside the merge are
looked up anew, and rows without a mergeable pair leave the matrix. Pieces beyond
LONGEST bytes, where a matrix would be quadratic, merge in the same order by a heap.

Defined results: null and empty texts give no tokens; lone rows, repeated rows and
repeated ids are encoded row by row; an empty table gives an empty result; columns
other than the id and text columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LONGEST = 512
#: Distinct pieces a task remembers; beyond it, it forgets all and goes on (bounds memory only).
REMEMBERED = 300_000
NONE = np.int32(2**31 - 1)

#: Characters over which PLAIN and the public pattern agree: ASCII but for control characters
#: and letters of Latin-1, general punctuation U+2010-U+2027.
PLAIN_TEXT = re.compile("[\t-\r -~À-ÖØ-öø-ÿ‐-‧]*")
PLAIN = re.compile("'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\t-\r A-Za-zÀ-ÖØ-öø-ÿ0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
#: White_Space of Unicode, as the library's regular expressions define \s.
SPACE = "\t-\r \x85\xa0  -     　"


#: A blank between letters: no piece spans it, so a long text can be cut before it.
SAFE = re.compile("[A-Za-z](?= [A-Za-z])")
PART = 1 << 20


def parts_of(text: str):
    """The text in parts of about PART characters, cut where the pattern cuts anyway."""
    start = 0
    while len(text) - start > 2 * PART and (m := SAFE.search(text, start + PART)):
        yield text[start : m.end()]
        start = m.end()
    yield text[start:] if start else text


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a .tiktoken file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}


class Flat:
    """Arrays of varying length, kept end to end in one growing array."""

    def __init__(self, dtype):
        self.values, self.used = np.zeros(1 << 12, dtype), 0
        self.starts, self.lengths, self.count = np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int64), 0

    def extend(self, values: np.ndarray, lengths: np.ndarray) -> None:
        while self.used + len(values) > len(self.values):
            self.values = np.resize(self.values, 2 * len(self.values))
        while self.count + len(lengths) > len(self.starts):
            self.starts, self.lengths = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.lengths, 2 * len(self.starts))
        self.values[self.used : self.used + len(values)] = values
        at = slice(self.count, self.count + len(lengths))
        self.lengths[at], self.starts[at] = lengths, self.used + np.cumsum(lengths) - lengths
        self.used, self.count = self.used + len(values), self.count + len(lengths)

    def take(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lengths = self.lengths[index]
        return self.values[common.ranges(self.starts[index], lengths)], lengths


class Merger:
    """Encodes pieces by the ranks of a vocabulary, and decodes ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.tokens = Flat(np.uint8)
        by_id: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            by_id[rank] = token
        self.tokens.extend(np.frombuffer(b"".join(by_id), np.uint8), np.array([len(t) for t in by_id], np.int64))
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), merged.append(rank)
        self._hash(np.array(left, np.int64) << 32 | np.array(right, np.int64), np.array(merged, np.int32))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _hash(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Open addressing with linear probing: keys that lose a slot try the next one."""
        self.bits = max(8, int(len(keys) * 4).bit_length())
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[slot[todo]] == -1]
            self.keys[slot[free]] = keys[free]  # of several, the last one stays
            self.ranks[slot[free]] = values[free]
            todo = todo[self.keys[slot[todo]] != keys[todo]]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
        self.probes = self._longest(keys)

    def _longest(self, keys: np.ndarray) -> int:
        slot, most = self._slot(keys), 1
        while (off := self.keys[slot] != keys).any():
            slot, most = np.where(off, (slot + 1) & ((1 << self.bits) - 1), slot), most + 1
        return most

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair's merge; NONE where it has none or a side is padding (negative)."""
        keys = a.astype(np.int64) << 32 | b.astype(np.int64)
        slot = self._slot(keys)
        found, got = np.full(len(keys), NONE, np.int32), self.keys[slot]
        hit = got == keys
        found[hit] = self.ranks[slot[hit]]
        open_ = np.flatnonzero(~hit & (got != -1) & (a >= 0) & (b >= 0))
        for _ in range(self.probes):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            got = self.keys[slot[open_]]
            hit = got == keys[open_]
            found[open_[hit]] = self.ranks[slot[open_[hit]]]
            open_ = open_[~hit & (got != -1)]
        return np.where((a < 0) | (b < 0), NONE, found)

    def matrix(self, ids: np.ndarray) -> np.ndarray:
        """Merge every row of a matrix (padding -1) to its end."""
        done = np.full_like(ids, -1)
        rows, m = np.arange(len(ids)), ids.copy()
        ranks = self.pair_ranks(m[:, :-1].ravel(), m[:, 1:].ravel()).reshape(len(m), -1)
        while len(rows) and m.shape[1] > 1:
            at = ranks.argmin(1)
            best = ranks[np.arange(len(rows)), at]
            if (over := best == NONE).any():
                done[rows[over], : m.shape[1]] = m[over]
                rows, m, ranks, at, best = (x[~over] for x in (rows, m, ranks, at, best))
                if not len(rows):
                    break
            width = m.shape[1]
            every = np.arange(len(rows))
            m[every, at] = best
            columns = np.arange(width - 1)
            source = columns + (columns > at[:, None])
            m = np.take_along_axis(m, source, 1)
            if width == 2:
                break
            source = columns[:-1] + (columns[:-1] >= at[:, None])  # pair (at, at + 1) is gone
            ranks = np.take_along_axis(ranks, source, 1)
            for side in (at - 1, at):
                ok = np.flatnonzero((side >= 0) & (side < width - 2))
                ranks[ok, side[ok]] = self.pair_ranks(m[ok, side[ok]], m[ok, side[ok] + 1])
        done[rows, : m.shape[1]] = m
        return done

    def long(self, piece: bytes) -> np.ndarray:
        """One piece of any length: a heap of (rank, position) gives the leftmost minimum."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        first = self.pair_ranks(np.array(ids[:-1]), np.array(ids[1:]))
        heap = [(int(r), i) for i, r in enumerate(first) if r != NONE]
        heapq.heapify(heap)
        now = dict((i, r) for r, i in heap)
        while heap:
            rank, i = heapq.heappop(heap)
            if now.get(i) != rank:
                continue
            j = after[i]
            ids[i], ids[j] = rank, -1
            now.pop(j, None), now.pop(i, None)
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n:
                    r = int(self.pair_ranks(np.array([ids[k]]), np.array([ids[after[k]]]))[0])
                    now.pop(k, None)
                    if r != NONE:
                        now[k] = r
                        heapq.heappush(heap, (r, k))
        return np.array([x for x in ids if x >= 0], np.int32)

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces end to end, and each piece's number of ids."""
        lengths = np.array([len(p) for p in pieces], np.int64)
        flat = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        starts = np.cumsum(lengths) - lengths
        counts, parts = np.zeros(len(pieces), np.int64), []
        lower = 0
        for width in (4, 6, 8, 10, 12, 16, 20, 24, 32, 48, 64, 128, 256, LONGEST):
            pick = np.flatnonzero((lengths > lower) & (lengths <= width))
            lower = width
            step = max(1, (1 << 21) // width)
            for rows in (pick[i : i + step] for i in range(0, len(pick), step)):
                cells = np.arange(width)
                inside = cells < lengths[rows, None]
                m = np.full((len(rows), width), -1, np.int32)
                m[inside] = flat[common.ranges(starts[rows], lengths[rows])]
                m = self.matrix(m)
                kept = m >= 0
                counts[rows] = kept.sum(1)
                parts.append((rows, m[kept]))
        for row in np.flatnonzero(lengths > LONGEST):
            ids = self.long(pieces[row])
            counts[row] = len(ids)
            parts.append((np.array([row]), ids))
        out, first = np.empty(int(counts.sum()), np.int32), np.cumsum(counts) - counts
        for rows, ids in parts:
            out[common.ranges(first[rows], counts[rows])] = ids
        return out, counts


class Encoder:
    """Cuts texts into pieces, encodes new pieces in bulk and remembers them."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.merger = Merger(ranks)
        self.cut = regex.compile(pattern.replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]").replace(f"[^[{SPACE}]", f"[^{SPACE}"))
        self.forget()

    def forget(self) -> None:
        self.new: list[str] = []
        new = self.new

        class Known(dict):
            def __missing__(self, piece):
                new.append(piece)
                self[piece] = at = len(self)
                return at

        self.known, self.pieces = Known(), Flat(np.int32)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and each text's number of ids."""
        if len(self.known) > REMEMBERED:
            self.forget()
        index, cuts = [], []
        for text in texts:
            cuts.append(0)
            for part in parts_of(text):
                pieces = (PLAIN if PLAIN_TEXT.fullmatch(part) else self.cut).findall(part)
                index.append(np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces)))
                cuts[-1] += len(pieces)
        if self.new:
            self.pieces.extend(*self.merger.encode([p.encode() for p in self.new]))
            self.new.clear()
        ids, lengths = self.pieces.take(np.concatenate(index) if index else np.zeros(0, np.int64))
        ends = np.concatenate([[0], np.cumsum(lengths)])
        edges = ends[np.concatenate([[0], np.cumsum(cuts)]).astype(np.int64)]
        return ids, np.diff(edges)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The bytes of each run of ids."""
        data, lengths = self.merger.tokens.take(ids)
        ends = np.concatenate([[0], np.cumsum(lengths)])
        edges = ends[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]
        data = data.tobytes()
        return [data[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """One encoder for each vocabulary and Python worker."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(load_ranks(path), pattern)
    return _encoders[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, ids (array of int), decoded (binary, what the ids decode to) of every row; map-only."""
    kind = dict(docs.dtypes)[id_column]
    schema = f"`{id_column}` {kind}, ids array<int>, decoded binary"

    def run(batches):
        own = encoder(path, pattern)
        for rows in common.slices(batches, text_column, 2 << 20):
            ids, counts = own.encode(common.strings_of(rows, text_column))
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.ListArray.from_arrays(offsets, pa.array(ids)), pa.array(own.decode(ids, counts), pa.binary())], [id_column, "ids", "decoded"])
        own.forget()
        common.release()

    return docs.select(id_column, text_column).mapInArrow(run, schema)


def encoded(docs: DataFrame, path: str, pattern: str, text_column: str = "text") -> DataFrame:
    """All columns but the text, with ids (array of int) and n_tokens in its place; map-only.
    Columns of docs that have these two names give way to them."""
    others = [c for c in docs.columns if c not in (text_column, "ids", "n_tokens")]
    given, names, schema = common.by_place(docs.select(*(F.col(f"`{c}`") for c in (text_column, *others))))

    def run(batches):
        own = encoder(path, pattern)
        for rows in common.slices(batches, names[0], 2 << 20):
            ids, counts = own.encode(common.strings_of(rows, names[0]))
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*rows.columns[1:], pa.array(counts, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(ids))], [*names[1:], "n_tokens", "ids"])
        own.forget()
        common.release()

    kept = schema.partition(", ")[2]
    return given.mapInArrow(run, f"{kept}, n_tokens bigint, ids array<int>" if kept else "n_tokens bigint, ids array<int>").toDF(*others, "n_tokens", "ids")


def digests(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit), decoded_sha256, decodes_back."""
    kind = dict(docs.dtypes)[id_column]
    schema = f"`{id_column}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, decodes_back boolean"

    def run(batches):
        own = encoder(path, pattern)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for rows in common.slices(batches, text_column, 2 << 20):
            texts = common.strings_of(rows, text_column)
            ids, counts = own.encode(texts)
            back = own.decode(ids, counts)
            edges = np.concatenate([[0], np.cumsum(counts)]).tolist()
            ids = ids.astype("<u4")
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(counts, pa.int64()), pa.array([sha(ids[a:b].tobytes()) for a, b in zip(edges, edges[1:], strict=False)], pa.string()), pa.array([sha(b) for b in back], pa.string()), pa.array([b == t.encode() for b, t in zip(back, texts, strict=True)], pa.bool_())],
                [id_column, "n_tokens", "ids_sha256", "decoded_sha256", "decodes_back"],
            )
        own.forget()
        common.release()

    return docs.select(id_column, text_column).mapInArrow(run, schema)
