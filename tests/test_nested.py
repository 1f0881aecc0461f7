"""Nested chunks and merging upwards, against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from spanloom.operators import nested

SCHEMA = "doc_id int, text string"


def brute_chunks(text, sizes):
    words = re.findall(r"[^ \t-\r]+[ \t-\r]*", text)
    if words:
        words[0] = re.match(r"[ \t-\r]*", text)[0] + words[0]
    else:
        words = [text]
    levels, groups = [], [words]
    for size in sizes:
        nested_groups = [[g[i : i + size] for i in range(0, len(g), size)] for g in groups]
        levels.append([("".join(c), up, len(g)) for up, g in enumerate(nested_groups) for c in g])
        groups = [c for g in nested_groups for c in g]
    return levels


TEXTS = ["", " ", "one", "  lead and  trail \n", "a b c d e f g h i j k l m", "ü 漢字 x 😀 y\x0bz w " * 7, None, "x " * 50000]


@pytest.mark.parametrize("sizes", [(5, 2), (7, 3, 2), (4,), (1, 1), (2, 9)])
def test_chunks(spark, sizes):
    rows = nested.nested_chunks(spark.createDataFrame(list(enumerate(TEXTS)), SCHEMA), sizes).collect()
    for doc_id, text in enumerate(TEXTS):
        own = sorted((r for r in rows if r["doc_id"] == doc_id), key=lambda r: (r["level"], r["n"]))
        if text is None:
            assert not own
            continue
        for level, want in enumerate(brute_chunks(text, sizes)):
            got = [r for r in own if r["level"] == level]
            assert "".join(r["chunk_text"] for r in got) == text
            assert [r["chunk_text"] for r in got] == [w[0] for w in want] == [text[r["start"] : r["stop"]] for r in got]
            assert [r["words"] for r in got] == [len(re.findall(r"[^ \t-\r]+", w[0])) for w in want]
            assert [r["siblings"] for r in got] == [w[2] for w in want]
            assert [r["parent_id"] for r in got] == [f"{doc_id}:{level - 1}:{w[1]}" if level else None for w in want]
            assert [r["chunk_id"] for r in got] == [f"{doc_id}:{level}:{n}" for n in range(len(want))]


def brute_merge(hits, chunks, levels, ratio, fill):
    scores = {}
    for q, c, s in hits:
        if c in chunks:
            scores[q, c] = max(s, scores.get((q, c), s))
    for level in range(levels - 1, -1, -1):
        if fill:
            at = {(q, chunks[c]["doc_id"], chunks[c]["n"]): s for (q, c), s in scores.items() if chunks[c]["level"] == level}
            for q, d, n in list(at):
                if (q, d, n + 2) in at and (q, d, n + 1) not in at:
                    scores[q, f"{d}:{level}:{n + 1}"] = (at[q, d, n] + at[q, d, n + 2]) / 2
        if level:
            groups = {}
            for (q, c), s in scores.items():
                if chunks[c]["level"] == level:
                    groups.setdefault((q, chunks[c]["parent_id"]), []).append((c, s))
            for (q, up), kids in groups.items():
                if len(kids) > ratio * chunks[kids[0][0]]["siblings"]:
                    mean = sum(s for _, s in kids) / len(kids)
                    for c, _ in kids:
                        del scores[q, c]
                    scores[q, up] = max(mean, scores.get((q, up), mean))
    return {k: round(v, 9) for k, v in scores.items()}


@pytest.mark.parametrize("fill", [True, False])
@pytest.mark.parametrize("ratio", [0.5, 0.34])
def test_merging(spark, fill, ratio):
    r, sizes = random.Random(3), (8, 4, 1)
    docs = spark.createDataFrame([(d, " ".join("w" * r.randint(1, 3) for _ in range(r.randint(1, 40)))) for d in range(12)], SCHEMA)
    chunks = nested.nested_chunks(docs, sizes)
    known = {c["chunk_id"]: c for c in chunks.collect()}
    hits = [(q, c, float(r.randint(1, 9))) for q in range(4) for c in known if r.random() < (0.45 if c.split(":")[1] == "2" else 0.1)]
    hits += hits[:9] + [(0, "99:2:0", 1.0)]
    out = nested.merged_upwards(spark.createDataFrame(hits, "query_id int, chunk_id string, score double"), chunks, 3, ratio, fill).collect()
    assert {(o["query_id"], o["chunk_id"]): round(o["score"], 9) for o in out} == brute_merge(hits, known, 3, ratio, fill)
    assert len({(o["query_id"], o["chunk_id"]) for o in out}) == len(out)
    assert all(known[o["chunk_id"]]["level"] == o["level"] for o in out)


def test_half_is_not_more_than_half_and_all_rise_to_the_top(spark):
    chunks = nested.nested_chunks(spark.createDataFrame([(1, "a b c d e f g h")], SCHEMA), (8, 4, 1))
    hit = lambda ns: spark.createDataFrame([("q", f"1:2:{n}", 1.0) for n in ns], "query_id string, chunk_id string, score double")
    rise = lambda ns, fill=False: sorted(r["chunk_id"] for r in nested.merged_upwards(hit(ns), chunks, 3, fill=fill).collect())
    assert rise([0, 1]) == ["1:2:0", "1:2:1"]
    assert rise([0, 1, 3]) == ["1:1:0"]
    assert rise([0, 1, 2, 4, 5, 6]) == ["1:0:0"]
    assert rise([0, 2]) == ["1:2:0", "1:2:2"] and rise([0, 2], True) == ["1:1:0"]
    assert nested.merged_upwards(hit([0]).limit(0), chunks.limit(0), 3).count() == 0


def test_bad_parameters(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert nested.nested_chunks(docs).count() == 0
    for sizes in ((), (4, 0)):
        with pytest.raises(ValueError):
            nested.nested_chunks(docs, sizes)
    with pytest.raises(ValueError):
        nested.merged_upwards(docs.select(F.col("doc_id").alias("query_id"), F.lit("").alias("chunk_id"), F.lit(1.0).alias("score")), nested.nested_chunks(docs), 2, ratio=1.0)


def test_chunks_of_few_texts_at_a_time(spark):
    """Rows leave a worker in parts of TEXTS texts; more texts than that in one batch lose none."""
    docs = spark.createDataFrame([(n, None if n % 50 == 7 else "w " * (n % 9)) for n in range(3 * nested.TEXTS + 5)], "doc_id int, text string").coalesce(1)
    got = nested.nested_chunks(docs, (4, 2))
    assert "ArrowEvalPython" not in got._jdf.queryExecution().executedPlan().toString()
    want = sum((max(1, -(-(n % 9) // 4)) + max(1, -(-(n % 9) // 2))) for n in range(3 * nested.TEXTS + 5) if n % 50 != 7)
    assert got.count() == want


TERM_TEXTS = ["", None, " ", "the", "The Theatre ENding İng ing", "en the x enen the\n", "  x y", "thethe en ing then "]


@pytest.mark.parametrize("fill", [True, False])
@pytest.mark.parametrize("ratio", [0.5, 0.34])
def test_terms_rise_where_texts_lie(spark, fill, ratio):
    """Equal to the merge of plain Python; texts next to each other in a batch neither fill nor count for one another."""
    r, sizes, terms = random.Random(11), (8, 4, 1), ("the", "en", "ing")
    texts = TERM_TEXTS + [" ".join(r.choice(["the", "en", "Ending", "x", "y\t", "thethe"]) for _ in range(r.randint(1, 40))) for _ in range(2 * nested.TEXTS + 9)]
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA).coalesce(1)
    known = {c["chunk_id"]: c for c in nested.nested_chunks(docs, sizes).collect()}
    low = lambda t: t.replace("İ", "i").lower()
    hits = [(q, c, float(low(k["chunk_text"]).count(q))) for q in terms for c, k in known.items() if k["level"] == 2 and q in low(k["chunk_text"])]
    got = nested.risen_terms(docs, terms, sizes, ratio, fill).collect()
    assert {(g["query_id"], g["chunk_id"]): round(g["score"], 9) for g in got} == brute_merge(hits, known, 3, ratio, fill)
    assert len({(g["query_id"], g["chunk_id"]) for g in got}) == len(got) and all(known[g["chunk_id"]]["level"] == g["level"] for g in got)


def test_risen_hits_write_and_deal_nothing(spark):
    """The query held all texts three times over in the shared folder, and dealt its hits out at each level."""
    from spanloom.plans import levels

    found = levels.risen_hits(spark, "/root/testdata/sf0.001")
    assert [f for f in found.inputFiles() if not f.endswith("/documents.parquet")] == []
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_bad_terms(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert nested.risen_terms(docs, ("a",)).count() == 0 and nested.risen_terms(docs, ()).count() == 0
    for bad in ({"terms": ("",)}, {"terms": ("a",), "sizes": ()}, {"terms": ("a",), "ratio": 1.0}):
        with pytest.raises(ValueError):
            nested.risen_terms(docs, **bad)
