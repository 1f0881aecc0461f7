"""License scan against a plain version, and planted license texts."""

import random
import re

import duckdb
import pytest

from spanloom.llm import licenses, queries
from spanloom.llm.license_texts import TEMPLATES

from . import fixtures

MIT, APACHE = TEMPLATES[0][1], TEMPLATES[3][1]
r = random.Random(8)


def edited(text, step):
    words = text.split()
    return " ".join(w for i, w in enumerate(words) if i % step != 3)


PLANTED = [
    (31, fixtures.prose(80, 9) + "\n" + MIT + "\n" + fixtures.prose(50, 10), "mit"),
    (32, MIT.upper().replace(" ", "\n  "), "mit"),
    (33, edited(MIT, 30), "mit"),  # words left out: neighbouring diagonals
    (34, fixtures.prose(20, 11) + " " + APACHE + " " + MIT, "apache,mit"),
    (35, MIT + " " + MIT, "mit"),
    (36, " ".join(MIT.split()[:40]), ""),  # too small a share
    (37, "The MIT-License and the mit  license; GNU General Public License.", ""),
    (38, " ".join(x for w in MIT.split() for x in (w, "x")), ""),
    (39, " ".join(r.sample(MIT.split(), len(MIT.split()))), ""),
]


def frame(spark):
    rows = fixtures.ROWS + [(d, t, "en", "a", 1) for d, t, _ in PLANTED]
    return fixtures.with_clashes(spark.createDataFrame(rows, fixtures.SCHEMA)).repartition(3)


def brute(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    places, base = [], set()
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += at
        base |= {label} if at else set()
    labels, score, n_spans = set(base), 0.0, 0
    for label, body in TEMPLATES:
        t = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", body.lower())
        votes = {}
        for i in range(len(words) - 4):
            for j in range(len(t) - 4):
                if words[i : i + 5] == t[j : j + 5]:
                    votes.setdefault(i - j, []).append(j)
        groups, last = [], None
        for diagonal in sorted(votes):
            if last is None or diagonal - last > 8:
                groups.append([])
            groups[-1] += [(diagonal + j, j) for j in votes[diagonal]]
            last = diagonal
        for g in groups:
            covered = len({j + k for _, j in g for k in range(5)})
            width = max(i for i, _ in g) + 5 - min(i for i, _ in g)
            score = max(score, covered / len(t))
            if covered / len(t) >= 0.6 and covered / width >= 0.5:
                labels.add(label)
                n_spans += 1
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), round(score, 9), n_spans


@pytest.mark.parametrize("broadcast,piece", [(100_000, 1 << 16), (0, 7)])
def test_report(spark, monkeypatch, broadcast, piece):
    monkeypatch.setattr(licenses, "BROADCAST", broadcast)
    monkeypatch.setattr(licenses, "PIECE", piece)
    got = sorted((tuple(x) for x in licenses.report(frame(spark)).collect()), key=str)
    given = [(d, t) for d, t, *_ in fixtures.ROWS] + [(d, t) for d, t, _ in PLANTED]
    assert got == sorted(((d, *brute(t)) for d, t in given), key=str)


def test_planted(spark):
    got = {x["doc_id"]: x for x in licenses.report(frame(spark)).collect()}
    for d, _, labels in PLANTED:
        if d != 37:
            assert got[d]["labels"] == labels, d
    assert got[37]["labels"] == "gpl,mit" and got[37]["n_base"] == 3 and got[31]["score"] == 1 and got[35]["n_spans"] == 2
    assert all(not got[d]["labels"] for d, *_ in fixtures.ROWS)


def test_none(spark):
    assert licenses.report(fixtures.empty(spark)).count() == 0
    alone = licenses.report(fixtures.with_clashes(spark.createDataFrame([(1, None, None, None, None)], fixtures.SCHEMA))).collect()
    assert [tuple(x) for x in alone] == [(1, 0, 0, None, None, "", "", 0.0, 0)]


def test_sql(spark):
    con = duckdb.connect()
    docs = frame(spark).select("doc_id", "text").toPandas()
    con.register("documents", docs)
    columns = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_spans"]
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.LICENSE_SQL})").fetchall()
    got = [tuple(x) for x in licenses.report(frame(spark)).select(*columns).collect()]
    assert sorted(str(r[1:]) for r in got) == sorted(str(r[1:]) for r in want)  # pandas makes ids with a null doubles
