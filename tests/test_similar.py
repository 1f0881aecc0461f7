"""The similarity join against all pairs."""

import difflib
import itertools
import random
from fractions import Fraction

import numpy as np
import pytest

from spanloom.operators import similar
from spanloom.plans import building

SF = "/root/testdata/sf0.001"
SCHEMA = "identity_id int, entity_type string, name string"


def names(seed):
    r = random.Random(seed)
    out = ["".join(r.choice("abcd") for _ in range(r.randint(0, 12))) for _ in range(60)]
    for base in out[:25]:  # a letter put in, left out, changed
        at = r.randint(0, len(base))
        out += [base[:at] + r.choice("abxé日") + base[at:], base[:at] + base[at + 1 :], base[:at] + "z" + base[at + 1 :]]
    words = ["thing", "north", "agency", "of", "river", "company", "limited", "the"]
    out += [" ".join(r.choice(words) for _ in range(r.randint(2, 6))) for _ in range(60)]
    return out


def brute(data, least):
    first = {}
    for i, kind, name in sorted(data):
        first.setdefault((kind, name or ""), i)
    out = {}
    for ((k1, n1), a), ((k2, n2), b) in itertools.combinations(sorted(first.items(), key=lambda x: x[1]), 2):
        if k1 == k2 and (score := difflib.SequenceMatcher(None, n1, n2).ratio()) >= least:
            out[(a, b)] = score
    return out


def found(spark, data, least):
    rows = similar.suggestions(spark.createDataFrame(data, SCHEMA).repartition(3), least).collect()
    assert len({(r["left_id"], r["right_id"]) for r in rows}) == len(rows)
    return {(r["left_id"], r["right_id"]): r["score"] for r in rows}


@pytest.mark.parametrize("least", [0.6, 0.8, 0.87, 0.95])
def test_suggestions(spark, least):
    data = [(i, "PQ"[i % 2], n) for i, n in enumerate(names(int(least * 100)))] + [(900, "P", None), (901, "P", ""), (902, "R", "alone")]
    want = brute(data, least)
    assert found(spark, data, least) == want and (want or least > 0.9)


def test_pairs_at_the_bound(spark):
    """Likeness of exactly the threshold, and names that share no pair of letters."""
    data = [(i, "x", n) for i, n in enumerate(["ab", "axb", "abc", "axbc", "a", "aa", "aab", "abcd", "axbxcxdx"])]
    for least in (0.5, 2 / 3, 0.8, 1.0):
        assert found(spark, data, least) == brute(data, least)
    with pytest.raises(ValueError):
        similar.suggestions(spark.createDataFrame(data, SCHEMA), 0.0)


def test_tiles_and_grams(spark, monkeypatch):
    """Both ways give all pairs, whatever the size of a block, also of names longer than a word has bits, of rare letters and of none."""
    monkeypatch.setattr(similar, "BLOCK", 20)
    monkeypatch.setattr(similar, "AT_ONCE", 7)
    long = ["north river company " * 5, "north river company " * 4 + "morth river", "x" * 300, "x" * 310, "𝄞日é" * 30, "𝄞日é" * 31 + "a", "ab" * 32, "ab" * 33]
    data = [(i * 7919 % 1009, "PQ"[i % 2], n) for i, n in enumerate(names(3) + long + long)] + [(2000, "P", None), (2001, None, "x" * 300)]
    table = similar.classes(spark.createDataFrame(data, SCHEMA))
    for way in (similar.by_tiles, similar.by_grams):
        got = {(r["left_id"], r["right_id"]): r["score"] for r in way(table, Fraction("0.8"), 0.8).collect()}
        assert got == {k: v for k, v in brute([d for d in data if d[1]], 0.8).items()}
    assert len(got) > 10


def test_few_rows_meet_where_all_names_share_grams(spark):
    """Names of few syllables are compared in tiles: by grams more rows would meet than there are pairs."""
    r = random.Random(5)
    data = [(i, "x", "".join(r.choice(["the", "in", "an", "ti", "on", " "]) for _ in range(24))) for i in range(300)]
    table = similar.classes(spark.createDataFrame(data, SCHEMA))
    _, pairs = similar.tiles(table, Fraction("0.8"))
    assert pairs.count() == 1 and similar._tiles_cost_less(table, Fraction("0.8"))
    assert found(spark, data, 0.8) == brute(data, 0.8)


def test_copies_and_nothing(spark, monkeypatch):
    monkeypatch.setattr(similar, "BROADCAST", 0)
    data = [(i, "x", "a hot name of many") for i in range(500)] + [(600, "x", "a hot name of man"), (601, "y", "a hot name of man"), (602, None, "a hot name of man")]
    assert list(found(spark, data, 0.8)) == [(0, 600)]
    got = {r["identity_id"]: r["representative"] for r in similar.members(spark.createDataFrame(data, SCHEMA)).collect()}
    assert got == {i: 0 for i in range(500)} | {600: 600, 601: 601, 602: 602}
    assert found(spark, [], 0.8) == {} and similar.members(spark.createDataFrame([], SCHEMA)).count() == 0


def test_registered_query(spark):
    """fuzzy_suggestions at its own threshold, over its own table."""
    data = [tuple(r) for r in building.misspelt_identities(spark, SF).select("identity_id", "entity_type", "name").collect()]
    got = {(r["left_id"], r["right_id"]): r["score"] for r in building.fuzzy_suggestions(spark, SF).collect()}
    assert got == {k: round(v, 6) for k, v in brute(data, 0.8).items()}


def copies(seed):
    """Long names of few syllables, each with copies that differ in 0 to 6 letters, and copies of copies."""
    r = random.Random(seed)
    out = []
    for _ in range(25):
        base = "".join(r.choice(["the", "in", "an", "ti", "on", " ", "é", "er"]) for _ in range(r.choice([22, 24, 30, 45])))[: r.choice([45, 60, 60, 90])]
        own = [base, base[1:] + "x"]
        for _ in range(7):
            name = r.choice(own)
            for _ in range(r.randint(0, 6)):
                at = r.randrange(len(name))
                name = name[:at] + r.choice(["", "q", "th"]) + name[at + r.randint(0, 1) :]
            own.append(name)
        out += own
    return list(dict.fromkeys(out))


@pytest.mark.parametrize("least", [0.6, 0.8, 0.95])
def test_copies_stand_behind_one_name(spark, monkeypatch, least):
    """No pair is lost where one name stands for several, in one block and across blocks."""
    data = [(i * 7919 % 1009, "P", n) for i, n in enumerate(copies(7))]
    table = similar.classes(spark.createDataFrame(data, SCHEMA))
    rows = similar.gathered(table, Fraction(str(least))).collect()
    assert sorted(n for r in rows for n in [r["name"], *(m["name"] for m in r["members"])]) == sorted(n for _, _, n in data)
    p, q = Fraction(str(least)).as_integer_ratio()
    for r in rows:
        apart = [(m["name"], len(m["name"]) + len(r["name"]) - 2 * similar._common(m["name"], r["name"])) for m in r["members"]] + [(r["name"], 0)]
        assert r["half"] == min(q * len(r["name"]) - q * d - (q - p) * len(n) for n, d in apart)
    assert least > 0.9 or len(rows) < 0.8 * len(data)
    want = brute(data, least)
    for block in (similar.BLOCK, 40):
        monkeypatch.setattr(similar, "BLOCK", block)
        assert {(r["left_id"], r["right_id"]): r["score"] for r in similar.by_tiles(table, Fraction(str(least)), least).collect()} == want


def test_close_pairs_lose_none(monkeypatch):
    """The bounds against the subsequence itself, with few kinds, columns, bits and kept steps."""
    r = random.Random(2)
    own = names(9) + ["".join(r.choice("etaoin shr日é𝄞") for _ in range(r.randint(30, 70))) for _ in range(80)] + ["ab" * 90, "abc" * 61]
    own = sorted({n for n in own if n}, key=len)
    for setting in ({}, {"KINDS": 6, "RARE": 2, "COLUMNS": 4}, {"BITS": 8, "KEPT": 2, "FULL": 2.0}, {"AT_LEFT": 3, "KEPT": 40, "FULL": 0.3}):
        for k, v in setting.items():
            monkeypatch.setattr(similar, k, v)
        codes, sizes = similar._coded(own)
        halves = 4 * sizes - 30  # likeness of 0.8, less 3 letters a name
        codes = similar._kinds(codes)
        got = set(zip(*(x.tolist() for x in similar.close_pairs(codes, 90, halves, 10, False))))
        reach = {(i, j) for i in range(90) for j in range(len(own) - 90) if 10 * similar._common(own[i], own[90 + j]) >= halves[i] + halves[90 + j]}
        assert reach <= got and reach and len(got) < 90 * (len(own) - 90) / 2
        both = similar.close_pairs(np.concatenate([codes[:90], codes[:90]]), 90, np.concatenate([halves[:90], halves[:90]]), 10, True)
        assert {(i, j) for i in range(90) for j in range(i + 1, 90) if 10 * similar._common(own[i], own[j]) >= halves[i] + halves[j]} <= set(zip(*(x.tolist() for x in both)))
        monkeypatch.undo()


def test_pages_are_read_and_tiles_are_compared_once(spark):
    """The titles came from two scans, and the order by ranges ran the comparison again for its bounds."""
    assert building.misspelt_identities(spark, SF)._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert all("/suggestions-" in f for f in building.fuzzy_suggestions(spark, SF).inputFiles())
    table = similar.classes(building.misspelt_identities(spark, SF))
    assert "REPARTITION_BY_NUM" in similar.by_tiles(table, Fraction("0.8"), 0.8)._jdf.queryExecution().executedPlan().toString()
    assert similar.gathered(table, Fraction("0.8")).count() < 0.7 * table.count()


def test_the_way_is_chosen_by_some_names(spark, monkeypatch):
    """Names that share few grams go by grams, those of few syllables by tiles, whatever part of them is looked at."""
    r = random.Random(8)
    letters = [chr(0x4E00 + i) for i in range(3000)]
    rare = [(i, "x", "".join(r.choice(letters) for _ in range(12))) for i in range(600)]
    few = [(i, "x", "".join(r.choice(["the", "in", "an", "ti", "on", " "]) for _ in range(24))) for i in range(600)]
    monkeypatch.setattr(similar, "CHEAP", 0)
    for looked in (20_000, 150):
        monkeypatch.setattr(similar, "LOOKED", looked)
        for data, tiles in ((rare, False), (few, True)):
            table = similar.classes(spark.createDataFrame(data, SCHEMA))
            assert similar._tiles_cost_less(table, Fraction("0.8")) is tiles
