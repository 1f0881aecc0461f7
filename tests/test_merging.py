"""Components and merges with vetoes, on random graphs."""

import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators import merging


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute(identities, links):
    facts = {i: (t, c) for i, t, c in identities}
    ok = [(a, b, s) for a, b, s in links if a in facts and b in facts and facts[a][0] == facts[b][0] and (None in (facts[a][1], facts[b][1]) or facts[a][1] == facts[b][1])]
    bare = [i for i, (_, c) in facts.items() if c is None]
    part = roots(bare, [(a, b) for a, b, _ in ok if facts[a][1] is None and facts[b][1] is None])
    best = {}
    for a, b, s in ok:
        for x, y in ((a, b), (b, a)):
            if facts[x][1] is None and facts[y][1] is not None:
                best[part[x]] = min(best.get(part[x], (9, "")), (-s, facts[y][1]))
    group = {i: ("g", t, c) if c is not None else ("g", t, best[part[i]][1]) if part[i] in best else ("c", part[i]) for i, (t, c) in facts.items()}
    return {i: min(j for j in group if group[j] == group[i]) for i in group}


@pytest.mark.parametrize("seed", [1, 2])
def test_merges(spark, seed):
    r = random.Random(seed)
    identities = [(i, "PQ"[r.random() < 0.2] if i else None, f"c{r.randint(0, 6)}" if r.random() < 0.3 else None) for i in range(120)]
    links = [(r.randint(0, 125), r.randint(0, 125), r.choice([0.8, 0.9, 0.95])) for _ in range(110)] + [(i, i + 1, 0.9) for i in range(60, 90)]
    links += [(b, a, s) for a, b, s in links[:20]] + links[:5]
    i = spark.createDataFrame(identities, "identity_id bigint, entity_type string, code string")
    got = merging.merged(i, spark.createDataFrame(links, "left_id bigint, right_id bigint, score double")).collect()
    want = brute(identities, links)
    assert {r["identity_id"]: r["survivor"] for r in got} == want and len(got) == 120
    held = {}
    for row in got:
        t, c = next((t, c) for j, t, c in identities if j == row["identity_id"])
        held.setdefault(row["survivor"], (set(), set()))[0].add(t)
        if c:
            held[row["survivor"]][1].add(c)
    assert all(len(t) == 1 and len(c) <= 1 for t, c in held.values())
    events = merging.merge_events(spark.createDataFrame(got, "identity_id bigint, survivor bigint, reason string")).collect()
    assert len({e["event_id"] for e in events}) == len(events) == sum(k != v for k, v in want.items())


def test_a_component_between_two_codes(spark):
    i = spark.createDataFrame([(1, "x", "A"), (2, "x", None), (3, "x", None), (4, "x", "B"), (5, "x", "A"), (6, "x", None), (7, "y", None)], "identity_id int, entity_type string, code string")
    links = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.99), (3, 4, 0.95), (1, 4, 1.0), (6, 7, 1.0), (6, 99, 1.0)], "left_id int, right_id int, score double")
    got = {r["identity_id"]: (r["survivor"], r["reason"]) for r in merging.merged(i, links).collect()}
    assert got == {1: (1, "code"), 5: (1, "code"), 4: (2, "code"), 2: (2, "link"), 3: (2, "link"), 6: (6, None), 7: (7, None)}
    vetoes = {(r["left_id"], r["right_id"]): r["veto"] for r in merging.judged_links(i, links).collect()}
    assert vetoes[(1, 4)] == "code" and vetoes[(6, 7)] == "type" and vetoes[(6, 99)] == "unknown" and vetoes[(1, 2)] is None


def test_long_chain_hub_and_nothing(spark):
    chain = spark.range(300).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    hub = spark.range(1000, 2000).select(F.lit(999).cast("bigint").alias("u"), F.col("id").alias("v"))
    got = merging.components(chain.unionByName(hub)).collect()
    assert {r["component"] for r in got} == {0, 999} and len(got) == 300 + 1000
    assert merging.components(chain.limit(0)).count() == 0
