"""Document fingerprints by winnowing.

K-grams of code points get rolling polynomial hashes modulo 2**64 (prefix sums, then one
subtraction and one multiplication each) and a mixing finaliser. Of every window of
WINDOW consecutive hashes the minimum is chosen, the rightmost of equal ones; a chosen
position is kept once. Two texts that share a run of K + WINDOW - 1 code points share a
chosen hash, and the positions say where.

Defined results: a text shorter than K code points is one k-gram of its own length; a
text of fewer than WINDOW k-grams is one window; null and empty texts have an empty
fingerprint, and two empty ones are alike (1.0); an empty table gives an empty result;
columns other than id and text are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

K, WINDOW, PIECE = 24, 64, 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and INVERSE**i modulo 2**64 for i below n at least."""
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]), 1 << 14)
        for which, base in enumerate((BASE, INVERSE)):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            _powers[which] = np.multiply.accumulate(factors)
    return _powers[0][:n], _powers[1][:n]


def gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """The hash of every k-gram; of a shorter text, one for the whole."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.uint64)
    k = min(k, n)
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    return common.mix64((sums[k:] - sums[:-k]) * down[: n - k + 1] + np.uint64(k))


def least_positions(hashes: np.ndarray, window: int) -> np.ndarray:
    """For every window of consecutive hashes (one, if there are fewer) the position of its
    minimum by the upper 40 bits, the rightmost of equal ones."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64)
    window = min(window, n)
    mask = np.uint64((1 << 24) - 1)
    # 40 hash bits, then the position reversed, so that the least value is the rightmost minimum
    keys = (hashes & ~mask) | (mask - (np.arange(n, dtype=np.uint64) & mask))
    blocks = -(-n // window)
    padded = np.full(blocks * window, np.uint64(2**64 - 1))
    padded[:n] = keys
    grid = padded.reshape(blocks, window)
    before = np.minimum.accumulate(grid, 1).ravel()
    after = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    least = np.minimum(after[: n - window + 1], before[window - 1 : n])
    starts = np.arange(len(least))
    low = (mask - (least & mask)).astype(np.int64)
    return starts + ((low - starts) & int(mask))  # positions beyond 2**24 wrap, a window does not


def window_choice(hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions of the rightmost minimum of every window, ascending, each once."""
    position = least_positions(hashes, window)
    return position[np.concatenate([[True], position[1:] != position[:-1]])] if len(position) else position


def fingerprint(text: str, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Chosen positions and their hashes. Long texts go in pieces of PIECE windows, each with the
    k-grams of its last window; a position that two pieces choose is kept once."""
    found_at, found = [], []
    for start in range(0, max(1, len(text) - k - window + 2), PIECE):
        hashes = gram_hashes(np.frombuffer(text[start : start + PIECE + k + window - 2].encode("utf-32-le"), np.uint32), k)
        at = window_choice(hashes, window)
        if found_at and len(at) and found_at[-1][-1] == at[0] + start:
            at = at[1:]
        if len(at):
            found_at.append(at + start), found.append(hashes[at])
    return (np.concatenate(found_at), np.concatenate(found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard likeness of two fingerprints' distinct hashes; 1.0 if both are empty."""
    a, b = np.unique(a), np.unique(b)
    both = np.sort(np.concatenate([a, b]), kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    union = len(a) + len(b) - shared
    return shared / union if union else 1.0


def render(at: np.ndarray, hashes: np.ndarray) -> str:
    """position:hash of every choice in hexadecimal, comma-joined."""
    return ",".join([f"{p:x}:{h:016x}" for p, h in zip(at.tolist(), hashes.tolist(), strict=True)])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", k: int = K, window: int = WINDOW) -> DataFrame:
    """id, positions and hashes (bit patterns as long) of every whole text; map-only."""
    kind = dict(docs.dtypes)[id_column]

    def run(batches):
        for rows in common.slices(batches, text_column):
            found = [fingerprint(t, k, window) for t in common.strings_of(rows, text_column)]
            ends = pa.array(np.concatenate([[0], np.cumsum([len(a) for a, _ in found])]).astype(np.int32))
            lists = (pa.ListArray.from_arrays(ends, pa.array(np.concatenate([f[i] for f in found]).astype(np.int64))) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([rows.column(0), *lists], [id_column, "positions", "hashes"])

    return docs.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, positions array<bigint>, hashes array<bigint>")


def with_next(docs: DataFrame, ranges: int) -> DataFrame:
    """doc_id, text, range, own: rows dealt by ranges of doc_id, sorted in each, and the first
    row of each range once more (own = false) at the end of the range before it; that of the
    first range ends the last. So every row's next one follows it in its partition.

    The bounds are approximate quantiles of the ids, at most `ranges` numbers on the driver."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63))).alias("place"))
    bounds = sorted(set(rows.approxQuantile("place", [i / ranges for i in range(1, ranges)], 0.2 / ranges)))
    number = F.size(F.filter(F.array(*(F.lit(float(b)) for b in bounds)), lambda b: b < F.col("place"))) if bounds else F.lit(0)
    rows = rows.withColumn("range", number.cast("int"))
    firsts = rows.groupBy("range").agg(F.min("place").alias("place")).orderBy("range").collect()  # one row a range
    before = {f["place"]: firsts[i - 1]["range"] for i, f in enumerate(firsts)}
    own = F.array(F.struct(F.col("range"), F.lit(True).alias("own")))
    if before:
        to = F.create_map(*(F.lit(x) for pair in before.items() for x in pair))[F.col("place")]
        own = F.when(F.col("place").isin(*before), F.array_append(own, F.struct(to.alias("range"), F.lit(False).alias("own")))).otherwise(own)
    return rows.select("doc_id", "text", "place", F.explode(own).alias("at")).select("doc_id", "text", "at.*", "place")


def edited(text: str, following: str) -> str:
    """The last floor(n/2) code points replaced by the first as many (or all) of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compare_with_next(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """Each document's fingerprint, that of its text edited with the next document's, and
    likenesses; next by ascending doc_id, the first after the last. Rows with a null doc_id
    sort first; of equal ids the lesser text comes first. Ids are whole numbers, or texts of such (an
    error else). One shuffle of the texts."""
    kind = dict(docs.dtypes)["doc_id"]
    n = common.parts(docs)
    dealt = with_next(docs, n).repartition(n, "range").sortWithinPartitions("range", F.col("own").desc(), "place", "text")
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_chosen"]

    def run(batches):
        held = None  # the row that waits for its next one: (doc_id, text, range, fingerprint)
        for rows in common.slices(batches):
            out = []
            for doc_id, text, number, own in zip(rows.column(0).to_pylist(), common.strings_of(rows), rows.column(2).to_pylist(), rows.column(3).to_pylist(), strict=True):
                print_ = fingerprint(text, k, window)
                if held is not None and held[2] == number:
                    new = edited(held[1], text)
                    other = fingerprint(new, k, window)
                    out.append((held[0], len(held[1]), hashlib.sha256(new.encode()).hexdigest(), render(*held[3]), render(*other), likeness(held[3][1], other[1]), likeness(held[3][1], print_[1]), len(held[3][0])))
                held = (doc_id, text, number, print_) if own else None
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*out, strict=True)], names)

    schema = f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_chosen bigint"
    return dealt.mapInArrow(run, schema)
