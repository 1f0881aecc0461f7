"""Outcomes of links and mentions among versions, against plain Python on random states."""

import random

import pytest

from spanloom.operators import ownership

M, H = "mention_id int, version_id string, entity_id string, span_id int, mention_text string", "mention_id int, owner string, entity_id string, span_id int, mention_text string"
L, B, O = "version_id string, node_id int, entity_id string, ordinal_no int, mention_text string", "node_id int, entity_id string, ordinal_no int, mention_text string", "node_id int, entity_id string, version_id string"


def brute_links(links, bridges, ledger, scopes):
    want = {(v, n, e): (o, t) for v, n, e, o, t in links}
    there = {(n, e): (o, t) for n, e, o, t in bridges}
    out = {}
    for pair in {(n, e) for _, n, e in want} | {(n, e) for n, e, _ in ledger}:
        owners = {v for n, e, v in ledger if (n, e) == pair}
        wanting = {v for v, n, e in want if (n, e) == pair}
        leaving = {v for v in owners if v in scopes and v not in wanting}
        first = min(wanting & owners or wanting, default=None)
        for v in wanting:
            if pair not in there:
                action = "create" if v == first else "foreign"
            elif not owners:
                action = "unowned"
            elif v in owners:
                action = "shared" if len(owners - leaving) > 1 else "equal" if want[v, *pair] == there[pair] else "rewrite"
            else:
                action = "transfer" if owners == leaving and v == first else "foreign"
            out[v, *pair] = action
        for v in leaving:
            out[v, *pair] = "delete" if owners == leaving and not wanting and pair in there and v == max(leaving) else "release"
    return out


@pytest.fixture
def state():
    r = random.Random(5)
    scopes = ["a", "b", "c"]
    pairs = [(n, e) for n in range(40) for e in "xyz"]
    links = [(v, n, e, 0, r.choice("pq")) for n, e in pairs for v in scopes if r.random() < 0.3]
    bridges = [(n, e, 0, r.choice("pq")) for n, e in pairs if r.random() < 0.6]
    ledger = [(n, e, v) for n, e in pairs for v in "abcd" if r.random() < 0.25]
    return links, bridges, ledger, scopes


def test_links(spark, state):
    links, bridges, ledger, scopes = state
    frames = spark.createDataFrame(links, L), spark.createDataFrame(bridges, B), spark.createDataFrame(ledger + ledger[:5], O), spark.createDataFrame([(s,) for s in scopes + ["a"]], "version_id string")
    outcomes = ownership.link_outcomes(*frames)
    rows = outcomes.collect()
    got = {(r["version_id"], r["node_id"], r["entity_id"]): r["action"] for r in rows}
    assert got == brute_links(links, bridges, ledger, scopes) and len(rows) == len(got)
    assert set(got.values()) == {"create", "foreign", "unowned", "shared", "equal", "rewrite", "transfer", "delete", "release"}
    after, owned = ownership.applied(outcomes, frames[1], frames[2])
    kept = [(r["node_id"], r["entity_id"], r["ordinal_no"], r["mention_text"]) for r in after.collect()]
    left = [(r["node_id"], r["entity_id"], r["version_id"]) for r in owned.collect()]
    assert len({k[:2] for k in kept}) == len(kept) and len(set(left)) == len(left)
    assert {x for x in ledger if x[2] == "d"} <= set(left)  # a version outside the run loses nothing
    again = brute_links(links, kept, left, scopes)
    assert not set(again.values()) & {"transfer", "delete", "release", "rewrite", "create"}


def test_mentions_and_pairs(spark):
    mentions = [(1, "a", "x", 10, "one"), (2, "a", "x", 10, "two"), (3, "a", None, 10, "none"), (4, "a", "y", 11, "four"), (5, "b", "x", 10, "five"), (6, "a", "z", 10, "six"), (7, "q", "x", 10, "out")]
    held = [(1, "a", "x", 10, "one"), (2, "a", "x", 10, "old"), (4, None, "y", 11, "hand"), (5, "a", "x", 10, "five"), (8, "b", "x", 10, "stale"), (9, "q", "x", 10, "other"), (3, "a", None, 10, "none")]
    m, h = spark.createDataFrame(mentions, M), spark.createDataFrame(held, H)
    scopes = spark.createDataFrame([("a",), ("b",)], "version_id string")
    got = {(r["version_id"], r["mention_id"]): r["action"] for r in ownership.mention_outcomes(m, h, scopes).collect()}
    assert got == {("a", 1): "equal", ("a", 2): "update", ("a", 3): "equal", ("a", 4): "preserve", ("b", 5): "preserve", ("a", 6): "insert", ("b", 8): "delete", ("a", 5): "delete"}
    pairs = ownership.derived_pairs(m, h, spark.createDataFrame([(100, 10), (101, 10), (100, 10), (102, 11)], "node_id int, span_id int"), scopes)
    assert sorted(tuple(r) for r in pairs.collect()) == [("a", 100, "x", "one"), ("a", 100, "z", "six"), ("a", 101, "x", "one"), ("a", 101, "z", "six")]
    asked = spark.createDataFrame([("a", 100, "x", 3, "named")], L)
    assert ("a", 100, "x", "named", 3) in [tuple(r) for r in ownership.proven_links(pairs, asked).collect()]
    with pytest.raises(ownership.Collision, match="no mention proves"):
        ownership.proven_links(pairs, spark.createDataFrame([("a", 102, "y", 0, "hand")], L))


def test_all_ledgers_are_checked_before_the_first_is_refused(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "row_id string")
    held = {"spans": spark.createDataFrame([("s1", "a"), ("s2", "z")], "row_id string, version_id string"),
            "links": spark.createDataFrame([("l1", "a", "manual"), ("l2", "a", "model"), ("l3", "y", "manual"), ("l4", "y", None)], "row_id string, version_id string, source_kind string")}
    scopes = spark.createDataFrame([("a",)], "version_id string")
    found = ownership.collisions({"spans": ids("s1", "s2", "s2", "s9"), "links": ids("l1", "l2", "l3", "l4")}, held, scopes, {"links": "manual"})
    assert sorted((r["table"], r["row_id"], r["owner"], r["reason"]) for r in found.collect()) == [("links", "l2", "a", "source"), ("links", "l3", "y", "owner"), ("links", "l4", "y", "source"), ("spans", "s2", "z", "owner")]
    with pytest.raises(ownership.Collision, match="spans s2"):
        ownership.refuse(found)
    ownership.refuse(ownership.collisions({"spans": ids("s1")}, held, scopes))
    assert ownership.link_outcomes(spark.createDataFrame([], L), spark.createDataFrame([], B), spark.createDataFrame([], O), scopes).count() == 0
