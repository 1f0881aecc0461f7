"""Secret scans: fixed-form rules and sliding-window entropy per character class.

Candidates of the entropy rule are maximal runs of token characters with a digit and a
letter. Over each, a window of fixed length slides; the Shannon entropy of the window is
kept up by incremental counts (one character enters, one leaves) for the classes hex
and base 36 in lower and in upper case, base 32 and base 64. A window whose class holds all its characters
and whose entropy reaches the class's bound is a secret; touching windows join. Spans on
the allow list (digests named as such, UUIDs, placeholders, repeated fillers) are
suppressed, each by itself; spans of the fixed-form rules always stay, and an entropy span
keeps what they leave of it.

Defined results: null and empty texts have no spans; spans are code-point offsets, end
exclusive; repeated rows get equal results; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # runs are maximal, so the length can stand in the pattern
#: An entropy candidate: a long run of token characters.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
WINDOW = 20
#: Least entropy of a window in bits a character, by class; for random strings of WINDOW characters
#: the mean is about 3.3 (hex), 3.7 (base 32), 3.8 (base 36) and 4.0 bits (base 64).
BOUNDS = {"hex": 2.9, "HEX": 2.9, "base36": 3.5, "BASE36": 3.5, "base32": 3.4, "base64": 3.7}
UPPER, LOWER = common.UPPER, common.LOWER
CLASSES = {"hex": "0123456789abcdef", "HEX": "0123456789ABCDEF", "base36": "0123456789" + LOWER, "BASE36": "0123456789" + UPPER, "base32": UPPER + "234567", "base64": UPPER + LOWER + "0123456789+/_=-"}
#: Least digits of a window; a base 64 window needs letters of both cases besides, so that names of words
#: joined by hyphens, paths and dates don't count, the others a letter.
LEAST_DIGITS = {"hex": 2, "HEX": 2, "base36": 3, "BASE36": 3, "base32": 2, "base64": 2}
#: Text just before, or the value itself, that marks something public.
ALLOW_BEFORE = re.compile(r"(?<![A-Za-z0-9])(sha1|sha256|sha512|md5|sha|digest|checksum|etag|integrity|commit|rev)[:=\s\"'-]{1,4}\Z", re.I | re.A)
FILLER = re.compile(r"(?i)example|placeholder|changeme|your[_-]|xxxx|0{8}")
UUID = re.compile(r"(?i)(?<![0-9a-z])[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}(?![0-9a-z])")

_step = [0.0] + [n * math.log2(n) for n in range(1, WINDOW + 1)]


def entropy_spans(value: str) -> list[tuple[int, int]]:
    """Spans within a candidate whose windows reach the bound of a class that holds them."""
    found: list[tuple[int, int]] = []
    for name, letters in CLASSES.items():
        inside, counts, run, total = set(letters), {}, 0, 0.0
        digits = uppers = lowers = 0
        for i, c in enumerate(value):
            if c not in inside:
                counts, run, total, digits, uppers, lowers = {}, 0, 0.0, 0, 0, 0
                continue
            if run == WINDOW:
                old = value[i - WINDOW]
                n = counts[old]
                counts[old] = n - 1
                total += _step[n - 1] - _step[n]
                digits -= old.isdigit()
                uppers -= old.isupper()
                lowers -= old.islower()
            else:
                run += 1
            n = counts.get(c, 0)
            counts[c] = n + 1
            total += _step[n + 1] - _step[n]
            digits += c.isdigit()
            uppers += c.isupper()
            lowers += c.islower()
            if run == WINDOW and digits >= LEAST_DIGITS[name] and (lowers and uppers if name == "base64" else lowers or uppers) and math.log2(WINDOW) - total / WINDOW >= BOUNDS[name]:
                start = i + 1 - WINDOW
                if found and found[-1][0] <= start <= found[-1][1]:
                    found[-1] = (found[-1][0], max(found[-1][1], i + 1))
                else:
                    found.append((start, i + 1))
    merged: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(merged[-1][1], b))
        else:
            merged.append((a, b))
    return merged


def allowed(text: str, start: int, end: int) -> bool:
    """A span is public by what it holds or, for whole values, by what stands before it."""
    uuid = text[max(0, start - 36) : end + 36]
    return bool(FILLER.search(text, start, end) or ALLOW_BEFORE.search(text, max(0, start - 16), start) or any(m.start() <= start - max(0, start - 36) and end - max(0, start - 36) <= m.end() for m in UUID.finditer(uuid)))


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end) of all spans, sorted."""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12] if "=" in text or ":" in text else []
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    base = sorted((a, b) for a, _, b in spans)
    reach = list(itertools.accumulate((b for _, b in base), max))  # ascending: the ends so far
    for m in CANDIDATE.finditer(text):
        value = m[0]
        if not any(c.isdigit() for c in value):
            continue
        for a, b in entropy_spans(value):
            a, b = m.start() + a, m.start() + b
            near = base[bisect.bisect_right(reach, a) : bisect.bisect_left(base, (b,))]
            for x, y in [*near, (b, b)]:
                x = min(x, b)
                if a < x and not allowed(text, a, x):
                    spans.append((a, 3, x))
                a = max(a, y)
    return sorted(spans)


def render(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_secrets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id and spans, an array of (kind, start, end) over the whole text of every row; map-only."""
    kind = dict(docs.dtypes)[id_column]

    def run(batches):
        for rows in common.slices(batches, text_column):
            spans = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in scan(t)] for t in common.strings_of(rows, text_column)]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(spans, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))], [id_column, "spans"])
        common.release()

    return docs.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, spans array<struct<kind: string, start: bigint, end: bigint>>")


def redact(text: str | None, mark: str = "<secret>") -> str | None:
    """The text with every span replaced; overlapping spans by one mark."""
    if not text:
        return text
    out, at = [], 0
    for a, _, b in scan(text):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """All columns, with secrets of text_column replaced by a mark; rows all stay."""
    given, names, schema = common.by_place(docs)
    place = docs.columns.index(text_column)

    def run(batches):
        for rows in common.slices(batches, names[place]):
            columns = list(rows.columns)
            columns[place] = pa.array([redact(t) for t in columns[place].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)
        common.release()

    return given.mapInArrow(run, schema).toDF(*docs.columns)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts by fixed-form kind, the digest of their spans, and all spans."""
    spans = F.col("spans")
    text = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("bigint")
    return find_secrets(docs).select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(text(F.filter(spans, lambda x: x["kind"] != "entropy")), 256).alias("base_sha256"),
        text(spans).alias("spans"),
        count("entropy").alias("n_entropy"),
    )
