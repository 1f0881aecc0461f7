"""Ranked search against scoring every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import lexical

from . import fixtures

r = random.Random(4)
SHORT = [(200 + i % 90, " ".join(r.choice(fixtures.WORDS[:12]) for _ in range(r.randint(1, 6)))) for i in range(120)]  # many ties, some equal ids
DOCS = [(d, t) for d, t, *_ in fixtures.ROWS] + SHORT
ITEMS = [
    (1, fixtures.PASSAGE), (2, "two WORDS, two words!"), (3, " ".join(fixtures.WORDS[:12])), (4, None), (5, ""), (6, "nowherefound"),
    (None, "Zürich ñandú 日本語"), (7, fixtures.WORDS[3]), (7, fixtures.WORDS[5]), (8, fixtures.WORDS[3]), (8, fixtures.WORDS[3]), (9, " ".join(fixtures.WORDS)),
]


def terms(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def brute(docs, items, k):
    counts = [(d, Counter(terms(t))) for d, t in docs]
    n = sum(1 for _, c in counts if c)
    total = sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for i, ts in asked.items():
        rows = []
        for d, c in counts:
            m = 50 + (50 * c.total() * n) // total if total else 0
            s = sum(math.floor(1000 * math.log((2.0 * n + 2) / (2.0 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in ts if c[t])
            if s > 0:
                rows.append((-s, d is None, d or 0, d))
        out += [(i, rank, row[3], -row[0]) for rank, row in enumerate(sorted(rows)[:k], 1)]
    return sorted(out, key=str)


def frames(spark, docs=DOCS, items=ITEMS):
    d = fixtures.with_clashes(spark.createDataFrame(docs, "doc_id bigint, text string")).withColumns({"term": F.lit("x"), "block": F.lit(1), "grp": F.lit(1)})
    i = spark.createDataFrame(items, "item_id bigint, text string").withColumns({"number": F.lit(0), "item": F.lit(0), "term": F.lit(0)})
    return d.repartition(3), i.repartition(2)


@pytest.mark.parametrize("k,sizes", [(50, {}), (3, {"BLOCK": 20, "LEAF": 2, "FAN": 2, "WIDTH": 1}), (5, {"BLOCK": 7, "LEAF": 1, "FAN": 3, "WIDTH": 2, "TERMS": 20, "BROADCAST": 0})])
def test_search(spark, monkeypatch, k, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(lexical, name, value)
    got = lexical.search(*frames(spark), k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(x) for x in got.collect()), key=str) == brute(DOCS, ITEMS, k)


def test_nothing(spark):
    for docs, items in (([], ITEMS), (DOCS, []), ([(1, None), (2, "")], ITEMS), (DOCS, [(1, None)])):
        assert lexical.search(*frames(spark, docs, items)).count() == 0
    alone = lexical.search(*frames(spark, [(1, "one word")], [(1, "word")])).collect()  # ln(4/3)
    assert [tuple(x) for x in alone] == brute([(1, "one word")], [(1, "word")], 50)


def test_bounds_and_pruning(monkeypatch):
    """A node's bound is never below a document's score; a clear winner leaves leaves closed."""
    monkeypatch.setattr(lexical, "LEAF", 4)
    monkeypatch.setattr(lexical, "WIDTH", 1)
    draw = np.random.default_rng(2)
    lengths = draw.integers(1, 50, 500)
    docs = [np.sort(draw.choice(500, m, replace=False)) for m in (200, 90, 20, 1)]
    counts = [draw.integers(1, 9, len(d)) for d in docs]
    trees = lexical.Trees(np.array([10, 70, 900, 4000]), docs, counts, lengths, 500, int(lengths.sum()))
    whole = np.zeros(500, np.int64)
    for w, d, c in zip((10, 70, 900, 4000), docs, counts, strict=True):
        whole[d] += lexical.scores(np.full(len(d), w), c, lengths[d], 500, int(lengths.sum()))
    width = trees.leaf
    for level in trees.levels:
        bound = level.sum(0)
        assert all(bound[i] >= whole[i * width : (i + 1) * width].max(initial=0) for i in range(len(bound)))
        width *= lexical.FAN
    opened = []
    exact = trees.exact
    monkeypatch.setattr(trees, "exact", lambda t, leaves: opened.extend(leaves) or exact(t, leaves))
    d, s = trees.best(np.arange(4), 1, 1, np.arange(500))
    assert s[0] == whole.max() and d[0] == np.flatnonzero(whole == whole.max())[0] and len(opened) < 20
