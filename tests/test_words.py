"""Lexicon, paths and keywords, against plain Python."""

import math
import random

import pytest

from spanloom.operators import words


def splits(run):
    if not run:
        yield []
    for n in range(1, min(4, len(run)) + 1):
        for rest in splits(run[n:]):
            yield [run[:n], *rest]


@pytest.fixture(scope="module")
def corpus(spark):
    texts = ["北京大学在北京", "我在北京大学学习", "大学生学习中文", "他在上海学习", "上海大学在上海", "中文学习很有意思", "我爱北京", "意思很好", None, "", "plain words only"]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")


def test_lexicon_counts_and_cohesion(spark, corpus):
    got = {r["word"]: r["count"] for r in words.lexicon(corpus, cohesion=3.0).collect()}
    texts = [r["text"] or "" for r in corpus.collect() if r["doc_id"] < 8]
    counts = {}
    for t in texts:
        for i in range(len(t)):
            for n in range(1, 5):
                if i + n <= len(t):
                    counts[t[i : i + n]] = counts.get(t[i : i + n], 0) + 1
    total = sum(c for w, c in counts.items() if len(w) == 1)
    want = {w: c for w, c in counts.items() if len(w) == 1 or c >= 2 and min(c * total / (counts[w[:i]] * counts[w[i:]]) for i in range(1, len(w))) >= 3.0}
    assert got == want and {"北京", "学习", "上海"} <= set(got)
    assert words.lexicon(corpus.limit(0)).count() == 0
    lines = spark.createDataFrame([("甲乙",), ("甲\n乙",)], "text string")
    assert {r["word"]: r["count"] for r in words.lexicon(lines, least=1, cohesion=0.0).collect()} == {"甲": 2, "乙": 2, "甲乙": 1}


def test_paths_are_the_most_probable(spark):
    r = random.Random(2)
    lexicon = {w: r.randint(1, 9) for w in {"".join(r.choice("甲乙丙丁") for _ in range(r.randint(1, 4))) for _ in range(60)}}
    runs = ["".join(r.choice("甲乙丙丁戊") for _ in range(r.randint(1, 9))) for _ in range(40)]
    rows = spark.createDataFrame(list(enumerate(runs + [None, "", "ab 甲乙cd"])), "doc_id int, text string")
    got = {}
    for w in words.segmented(rows, spark.createDataFrame(list(lexicon.items()), "word string, count int"), "doc_id").orderBy("doc_id", "part", "start").collect():
        got.setdefault(w["doc_id"], []).append(w["word"])
    total = sum(lexicon.values())
    score = lambda s: sum(math.log((lexicon.get(w, 0.5)) / (total + 1)) for w in s)
    for i, run in enumerate(runs):
        best = max(score(s) for s in splits(run) if all(len(w) == 1 or w in lexicon for w in s))
        assert "".join(got[i]) == run and score(got[i]) == pytest.approx(best, abs=1e-9)
    assert 40 not in got and 41 not in got and got[42][0] == "ab" and got[42][-1] == "cd"


def test_ties_and_long_runs():
    assert words.best_path(2, [0, 0, 1], [1, 2, 1], [-1.0, -2.0, -1.0]) == [0]  # equal sums: fewer words
    assert words.best_path(3, [0, 0, 1, 1, 2], [1, 2, 1, 2, 1], [-1.0] * 5) == [0, 2]  # then the longer word first
    n = 20000
    assert words.best_path(n, list(range(n)), [1] * n, [-1.0] * n) == list(range(n))


def test_keywords_of_mixed_queries(spark, corpus):
    lexicon = spark.createDataFrame([("北京", 9), ("大学", 9), ("北京大学", 6), ("学习", 9), ("的", 50)], "word string, count int")
    queries = ["北京大学的学习 Ｓｐａｒｋ SQL 学习", "a​b\x07c ﬁne ①② x", "的 的的", "", None, "SQL sql SQL", "öer o\u0308l"]
    rows = spark.createDataFrame(list(enumerate(queries)), "q int, text string")
    found = {}
    for k in words.keywords(rows, lexicon, "q", stop_words=("sql",)).orderBy("q", "part", "start").collect():
        found.setdefault(k["q"], []).append(k["word"])
    assert found == {0: ["北京大学", "学习", "Spark", "SQL"], 1: ["abc", "fine", "12"], 5: ["SQL"], 6: ["öer", "öl"]}
    long = spark.createDataFrame([(1, "ab " * 1365 + "zzz")], "q int, text string")
    assert {k["word"] for k in words.keywords(long, lexicon, "q").collect()} == {"ab"}  # of zzz one letter is left
    assert {k["word"] for k in words.keywords(long, lexicon, "q", letters=None).collect()} == {"ab", "zzz"}
