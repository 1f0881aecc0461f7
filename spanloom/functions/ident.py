"""Deterministic identities: name-based UUIDs and digests as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The URL namespace of RFC 4122.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def uuid5(seed: Column, namespace: str = URL_NAMESPACE) -> Column:
    """Version 5 UUID of a seed in a namespace (hex without dashes)."""
    return uuid5_of(uuid5_digest(seed, namespace))


def uuid5_digest(seed: Column, namespace: str = URL_NAMESPACE) -> Column:
    return F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(seed, "UTF-8")))


def uuid5_of(h: Column) -> Column:
    """The UUID of a digest."""
    variant = F.substr(F.lit("89ab"), F.conv(F.substr(h, F.lit(17), F.lit(1)), 16, 10).cast("int") % 4 + 1, F.lit(1))
    cut = lambda a, n: F.substr(h, F.lit(a), F.lit(n))
    return F.concat_ws("-", cut(1, 8), cut(9, 4), F.concat(F.lit("5"), cut(14, 3)), F.concat(variant, cut(18, 3)), cut(21, 12))


def span_id(doc_id: Column, version_id: Column, page_no: Column, headings: Column, offset: Column, text: Column) -> Column:
    """Id of a span; a missing page reads None, headings are joined with slashes."""
    return uuid5(span_seed(doc_id, version_id, page_no, headings, offset, text))


def span_seed(doc_id: Column, version_id: Column, page_no: Column, headings: Column, offset: Column, text: Column) -> Column:
    text_of = lambda c: c.cast("string")
    page = F.coalesce(text_of(page_no), F.lit("None"))
    return F.concat_ws("|", text_of(doc_id), text_of(version_id), page, F.array_join(headings, "/"), text_of(offset), text)


def concept_id(kind: Column, name: Column) -> Column:
    return uuid5(F.concat(kind, F.lit(":"), F.regexp_replace(F.lower(name), "[^a-z0-9]", "")))


def content_hash(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def canonical_json(**columns: Column) -> Column:
    """A JSON object with keys in order, for digests."""
    return F.to_json(F.struct(*(columns[k].alias(k) for k in sorted(columns))))
