"""Operators over the corpus as a whole, against brute force, and the pipeline."""

import hashlib
import itertools
import math
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
import public_tokenizers
import sentencepiece
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from spanloom.llm import bpe, components, fertility, mixing, pitman_yor, secrets, setsketch, url_reputation, warc
from spanloom.llm.queries import URL_RULES

from . import fixtures


def rows(df):
    return [r.asDict() for r in df.collect()]


# near duplicates


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(docs, k, percent):
    sets = {}
    for d, t in docs:
        sets.setdefault(d, []).append(shingles(t, k))
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = list(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {d: find(d) for d in ids}


def family(seed, n, changes):
    """A text and n copies with a chain of changed words."""
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in rng.integers(0, 4000, 160)]
    out = []
    for _ in range(n):
        for at in rng.integers(0, len(words), changes):
            words[at] = f"n{rng.integers(0, 10**6)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_setsketch(spark, k, percent):
    texts = [t for s in range(6) for t in family(s, 14, 2)] + family(9, 30, 1)
    docs = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, t) for i, (_, t) in enumerate(fixtures.texts())]
    df = fixtures.with_clashes(spark.createDataFrame(docs, "doc_id bigint, text string")).repartition(4)
    got = rows(setsketch.near_duplicates(df, k, percent))
    want = brute_components(docs, k, percent)
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got) and len(got) == len(docs)
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {d: len(shingles(t, k)) for d, t in docs}


def test_setsketch_blocks(spark, monkeypatch):
    monkeypatch.setattr(setsketch, "BLOCK", 4)
    docs = [(i, t) for i, t in enumerate(family(3, 40, 2))]
    got = {r["doc_id"]: r["component_id"] for r in rows(setsketch.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string"), 3, 85))}
    assert got == brute_components(docs, 3, 85)


def test_setsketch_nulls_repeats_and_empty(spark):
    got = rows(setsketch.near_duplicates(fixtures.full(spark), 3, 85))
    assert len(got) == len(fixtures.ROWS)
    known = {r["doc_id"]: r["component_id"] for r in got}
    assert known[2] == 1 and known[3] == 1 and known[10] == 9 and known[12] == 11 and known[7] == 7 and known[6] == 6
    assert [r["kept"] for r in got if r["doc_id"] is None] == [True]
    assert rows(setsketch.near_duplicates(fixtures.empty(spark), 3, 85)) == []
    stay = rows(setsketch.deduplicated(fixtures.full(spark), 5, 80))
    ids = [r["doc_id"] for r in stay]
    assert len(ids) == len(set(ids)) and None in ids and 1 in ids and 2 not in ids and 6 in ids and set(stay[0]) == set(fixtures.full(spark).columns)
    assert rows(setsketch.deduplicated(fixtures.empty(spark), 5, 80)) == []


def test_sketches_merge_and_estimate():
    a, c = setsketch.multipliers(192)
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    p, q = x[:2000], x[1000:]
    sp, sq = setsketch.sketch(p, a, c), setsketch.sketch(q, a, c)
    assert (np.maximum(sp, sq) == setsketch.sketch(x, a, c)).all()
    guess = setsketch.estimate(*(np.array([v]) for v in ((sp > sq).sum(), (sp < sq).sum(), (sp == sq).sum(), 2000, 2000)))[0]
    assert abs(guess - 1 / 3) < 0.1


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1100)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    got = {r["u"]: r["v"] for r in rows(components.components(spark.createDataFrame(edges, "u bigint, v bigint")))}
    assert all(got.get(x, x) == find(x) for x in root)


# mixing


def test_mixing(spark):
    docs = fixtures.full(spark)
    first, again = (sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in rows(mixing.contract(df))) for df in (docs, docs.repartition(7)))
    assert first == again and len(first) == len(fixtures.ROWS)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    assert Counter(r[2] for r in first) == Counter(size(t) for _, t in fixtures.texts())
    assert all(r[5] <= 3 * r[2] for r in first)
    totals = Counter()
    for d, t, _, source, _ in fixtures.ROWS:
        totals[source] += size(t or "")
    order = sorted(totals, key=lambda s: (s is None, s or ""))
    wanted = mixing.targets([totals[s] for s in order], [1, 2, 3, 1][: len(order)])
    assert abs(sum(wanted) - sum(totals.values())) < 1e-6 and all(w <= 3 * totals[s] + 1e-9 for w, s in zip(wanted, order, strict=True))
    got = {(r["source_size"], round(r["target"], 6)) for r in rows(mixing.contract(docs))}
    assert got == {(totals[s], round(w, 6)) for s, w in zip(order, wanted, strict=True)}
    assert rows(mixing.contract(fixtures.empty(spark))) == []


def brute_mix(docs, chunks):
    """(taken by row, pieces of all slots) from the texts alone: docs as (doc_id, text, source)."""
    size = lambda t: len((t or "").encode().split())
    totals = Counter()
    for _, t, source in docs:
        totals[source] += size(t)
    order = sorted(totals, key=lambda s: (s is None, (s or "").encode()))
    wanted = mixing.targets([totals[s] for s in order], [1 + i % 3 for i in range(len(order))])
    blocks = [math.ceil(totals[s] / mixing.BLOCK) for s in order]
    quotas = [min(3 * b, round(w * b / totals[s])) if totals[s] else 0 for s, w, b in zip(order, wanted, blocks, strict=True)]
    some = [i for i, q in enumerate(quotas) if q]
    shards = math.ceil(sum(quotas) / mixing.SHARD_SLOTS)
    numbers = [[] for _ in order]  # block of each slot
    for _, counts, starts in mixing.shard_counts(np.array([quotas[i] for i in some]), range(shards), mixing.SEED, mixing.SHARD_SLOTS):
        for i, n, start in zip(some, counts.tolist(), starts.tolist(), strict=True):
            assert len(numbers[i]) == start
            j = np.arange(start, start + n)
            numbers[i] += mixing.permuted(j % blocks[i], np.full(n, blocks[i]), (i + mixing.SEED) * 3 + j // blocks[i]).tolist()
    assert [len(x) for x in numbers] == quotas
    place = lambda d: (xxhash.xxh64_intdigest(struct.pack("<q", d), 42) + (1 << 63)) % (1 << 64) - (1 << 63)
    taken, pieces = {}, Counter()
    for i, source in enumerate(order):
        laid = []  # (row, word) of the source, texts end to end
        for _, row in sorted((place(d) % chunks, row) for row, (d, t, s) in enumerate(docs) if s == source):
            laid += [(row, w) for w in docs[row][1].split()] if docs[row][1] else []
        for block in numbers[i]:
            part = laid[block * mixing.BLOCK : (block + 1) * mixing.BLOCK]
            for row, words in itertools.groupby(part, key=lambda x: x[0]):
                words = [w for _, w in words]
                taken[row] = taken.get(row, 0) + len(words)
                pieces[docs[row][0], tuple(words)] += 1
    return taken, pieces


def test_mixing_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 64)
    docs = [(i, fixtures.prose(i % 90, i) if i % 13 else None, ["big", "mid", "small", None][min(3, i % 11 // 3)]) for i in range(700)]
    df = spark.createDataFrame([(d, t, None, s, 1) for d, t, s in docs], fixtures.SCHEMA).coalesce(1)
    taken, pieces = brute_mix(docs, max(16, math.isqrt(len(docs))))
    assert {r["doc_id"]: r["taken"] for r in rows(mixing.contract(df))} == {d: taken.get(d, 0) for d, *_ in docs}
    # the form that carries texts leaves out those without words before it counts rows
    some = [x for x in docs if x[1] and x[1].split()]
    taken, pieces = brute_mix(some, max(16, math.isqrt(len(some))))
    got = rows(mixing.mixed(df))
    assert Counter((r["doc_id"], tuple(r["text"].split())) for r in got) == pieces
    by = Counter()
    for r in got:
        by[r["source"]] += len(r["text"].split())
    targets = {r["source"]: r["target"] for r in rows(mixing.mix(df)[0].select("source", "target").distinct())}
    assert all(abs(by[s] / t - 1) < 0.03 for s, t in targets.items())
    assert rows(mixing.mixed(fixtures.empty(spark))) == [] and set(rows(mixing.mixed(fixtures.full(spark)))[0]) == set(fixtures.full(spark).columns)


def test_mix_of_a_long_text_taken_more_than_once(spark):
    """A text of several MB leaves its task in parts; each word comes as often as `mix` says."""
    long, short = " ".join(f"w{i:07d}" for i in range(300_000)), " ".join(f"v{i}" for i in range(900_000))
    df = spark.createDataFrame([(1, "b", long), (2, "a", short)], "doc_id long, source string, text string")
    taken = {r["doc_id"]: r["taken"] for r in rows(mixing.contract(df))}
    assert taken[1] > 300_000
    got = mixing.mixed(df).groupBy("doc_id").agg(F.sum(mixing.word_count("text")).alias("n"), F.count(F.lit(1)).alias("pieces"))
    assert {r["doc_id"]: r["n"] for r in rows(got)} == taken
    words = mixing.mixed(df).filter("doc_id = 1").select(F.explode(F.split(F.trim("text"), " ")).alias("w")).groupBy("w").count()
    assert words.agg(F.count(F.lit(1)).alias("n"), F.max("count").alias("most")).first().asDict() == {"n": 300_000, "most": 3}  # a target of 800,000 words of 300,000


def test_pieces_are_the_text():
    for _, text in fixtures.texts():
        for start in (0, 1, 127, 128, 1000):
            cuts = mixing.cut_at_blocks(text.encode(), start)
            assert b"".join(text.encode()[a:b] for _, a, b in cuts) == (text.encode() if text.split() and cuts else b"")
            at = start
            for block, a, b in cuts:
                n = len(text.encode()[a:b].split())
                assert n and at // mixing.BLOCK == block == (at + n - 1) // mixing.BLOCK
                at += n


def test_shard_counts_are_multinomial_draws():
    """Sums are the quotas, tasks agree on any cut, and counts vary as draws without putting back do."""
    quotas = np.array([40_000, 9_000, 800, 200])
    seen = []
    for seed in range(60):
        every = {s: (c, a) for s, c, a in mixing.shard_counts(quotas, range(7), seed)}
        assert (sum(c for c, _ in every.values()) == quotas).all() and all(c.sum() == (8192 if s < 6 else 50_000 - 6 * 8192) for s, (c, _) in every.items())
        for s, c, a in mixing.shard_counts(quotas, range(2, 5), seed):
            assert (c == every[s][0]).all() and (a == every[s][1]).all() and (a == sum((every[x][0] for x in range(s)), np.zeros(4, int))).all()
        seen += [c for s, (c, _) in every.items() if s < 6]
    p, seen = quotas / quotas.sum(), np.array(seen)
    assert (np.abs(seen.mean(0) / (8192 * p) - 1) < 0.02).all()
    variance = 8192 * p * (1 - p) * (50_000 - 8192) / 49_999
    assert (np.abs(seen.var(0) / variance - 1) < 0.35).all()
    large = mixing.split(np.array([2 * 10**9, 10**9, 5]), 10**9, np.random.default_rng(1))
    assert large.sum() == 10**9 and abs(large[1] / 333_333_332 - 1) < 1e-3 and 0 <= large[2] <= 5


def test_permutation():
    for n in (1, 2, 3, 7, 100, 1025):
        j = np.arange(n)
        assert sorted(mixing.permuted(j, np.full(n, n), np.full(n, 9)).tolist()) == j.tolist()


# language model


def test_pitman_yor(spark):
    docs = fixtures.full(spark)
    got = rows(pitman_yor.score(docs, 6))
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)), None]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1
    count = Counter(w for d, t in fixtures.texts() if not held(d) for w in tokens(t))
    n, v = sum(count.values()), len(count)
    want = Counter((d, held(d), len(tokens(t)), sum(count[w] > 0 for w in tokens(t)), n, round(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)), 6)) for d, t in fixtures.texts())
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    other = {(r["doc_id"], r["n_tokens"]): r["score"] for r in rows(pitman_yor.score(docs.repartition(1), 11))}
    assert all(r["score"] < 0 and abs(r["score"] - other[r["doc_id"], r["n_tokens"]]) < 1e-4 * abs(r["score"]) for r in got)
    assert rows(pitman_yor.score(fixtures.empty(spark), 4)) == []


def test_pitman_yor_is_a_distribution():
    """After any seating the probabilities of all words and the unknown one sum to 1, in every context."""
    rng = np.random.default_rng(4)
    counts = rng.poisson(0.7, (12, 20)) * rng.integers(1, 9, (12, 20))
    counts[3] = 0  # a context that training does not know
    key, base = np.arange(240, dtype=np.uint64), np.full(240, 0.05)
    start = (counts.ravel() > 0).astype(np.int64)
    tables, _ = pitman_yor.reseated(start, counts.ravel()[counts.ravel() > 0], np.zeros(240, np.int64), np.full(240, 3), 1.0, 0.6, base, key, 0)
    tables = tables.reshape(12, 20)
    assert (tables <= counts).all() and ((tables > 0) == (counts > 0)).all() and (tables > 1).any()
    customers = tables.sum(0)
    parent_tables, _ = pitman_yor.reseated((customers > 0).astype(np.int64), customers[customers > 0], np.zeros(20, np.int64), np.full(20, 9), 1.0, 0.4, np.full(20, 1 / 21), key[:20], 0)
    v = int((customers > 0).sum())
    of = lambda c, t: pitman_yor.parent_of(c, t, customers.sum(), parent_tables.sum(), v, 0.4)
    parent, unknown = of(customers, parent_tables)[customers > 0], of(0.0, 0.0)
    assert abs(parent.sum() + unknown - 1) < 1e-12
    for u in range(12):
        p = pitman_yor.predictive(counts[u][customers > 0], tables[u][customers > 0], counts[u].sum(), tables[u].sum(), parent, 0.6)
        rest = pitman_yor.predictive(np.zeros(1), np.zeros(1), counts[u].sum(), tables[u].sum(), np.array([unknown]), 0.6)
        assert (p > 0).all() and abs(p.sum() + rest[0] - 1) < 1e-12


def sequential_scores(docs, sweeps, burn_in, seed=0):
    """The same model sampled one customer at a time by a plain Gibbs sampler: log10 probabilities by doc."""
    rng = np.random.default_rng(seed)
    held = lambda d: zlib.crc32(str(d).encode()) % 5 == 1
    pairs = [(a, b) for d, t in docs if not held(d) for w in [["", *t.split(), ""]] for a, b in itertools.pairwise(w)]
    count, context = Counter(pairs), Counter(a for a, _ in pairs)
    words = {b for _, b in pairs}
    v = len(words)
    ones = lambda c: pitman_yor.discount_of(sum(x == 1 for x in c.values()), sum(x == 2 for x in c.values()))
    d1, d0 = ones(count), ones(Counter(b for _, b in count))
    seats = {p: [n] for p, n in count.items()}
    top = {w: [n] for w, n in Counter(b for _, b in count).items()}

    def parent(w):
        t, c = sum(map(len, top.values())), sum(map(sum, top.values()))
        return (sum(top.get(w, ())) - d0 * len(top.get(w, ())) + (1 + d0 * t) / (v + 1)) / (1 + c)

    def leave(tables, d):
        i = rng.choice(len(tables), p=np.array(tables) / sum(tables))
        tables[i] -= 1
        return tables.pop(i) == 0 if not tables[i] else False

    def sit(tables, d, mass):
        weights = np.array([x - d for x in tables] + [mass])
        i = rng.choice(len(weights), p=weights / weights.sum())
        if i == len(tables):
            tables.append(1)
            return True
        tables[i] += 1
        return False

    def enter(w):
        sit(top.setdefault(w, []), d0, (1 + d0 * sum(map(len, top.values()))) / (v + 1))

    total = Counter()
    texts = {d: ["", *t.split(), ""] for d, t in docs}
    by_context = Counter(a for a, _ in seats)
    for sweep in range(burn_in + sweeps):
        for a, b in pairs:
            if leave(seats[a, b], d1):
                by_context[a] -= 1
                leave(top[b], d0)
            if sit(seats[a, b], d1, (1 + d1 * by_context[a]) * parent(b)):
                by_context[a] += 1
                enter(b)
        if sweep >= burn_in:
            for d, w in texts.items():
                for p in itertools.pairwise(w):
                    q = parent(p[1])
                    total[d, p] = total[d, p] + ((count[p] - d1 * len(seats.get(p, ())) + (1 + d1 * by_context[p[0]]) * q) / (1 + context[p[0]]) if context[p[0]] else q) / sweeps
    scores = {}
    for d, w in texts.items():
        n = Counter(itertools.pairwise(w))
        scores[d] = sum(math.log10(total[d, p] / n[p]) * n[p] for p in n)
    return scores


def test_pitman_yor_agrees_with_a_sequential_sampler(spark):
    docs = [(i, " ".join(f"t{x}" for x in np.minimum(np.random.default_rng(i).zipf(1.5, 18), 25))) for i in range(40)]
    want = sequential_scores(docs, sweeps=6, burn_in=3)
    got = {r["doc_id"]: r for r in rows(pitman_yor.score(spark.createDataFrame(docs, "doc_id bigint, text string"), 4))}
    for held in (True, False):
        a, b, n = (sum(x) for x in zip(*((r["score"], want[d], r["n_tokens"]) for d, r in got.items() if r["held_out"] == held), strict=True))
        assert abs(10 ** (-a / n) / 10 ** (-b / n) - 1) < 0.03  # perplexities
    assert all(abs(r["score"] / want[d] - 1) < 0.05 for d, r in got.items())
    assert all(abs(r["perplexity"] - 10 ** (-r["score"] / r["n_tokens"])) < 1e-9 * r["perplexity"] for r in got.values())


def test_pitman_yor_beats_the_base(spark):
    rng = np.random.default_rng(0)
    chain = {w: [f"t{x}" for x in rng.integers(0, 40, 3)] for w in (f"t{i}" for i in range(40))}

    def text(seed):
        r, w, out = np.random.default_rng(seed), "t0", []
        for _ in range(60):
            w = chain[w][r.integers(0, 3)]
            out.append(w)
        return " ".join(out)

    got = [r for r in rows(pitman_yor.score(spark.createDataFrame([(i, text(i)) for i in range(300)], "doc_id bigint, text string"), 4)) if r["held_out"]]
    tokens = sum(r["n_tokens"] for r in got)
    assert sum(r["score"] for r in got) / tokens > sum(r["base_score"] for r in got) / tokens + 0.5


@pytest.mark.parametrize("fresh", [0, 3])
def test_pitman_yor_sweeps_reach_the_posterior(fresh):
    """Chains of many alike items: tables after burn-in are spread as the exact conditional says."""
    n, c, d, strength, base, outside = 20_000, 6, 0.6, 1.0, 0.3, 2
    stirling = np.zeros((c + 1, c + 2))
    stirling[0, 0] = 1
    for i in range(c):
        for t in range(1, c + 1):
            stirling[i + 1, t] = stirling[i, t - 1] + (i - d * t) * stirling[i, t]
    weight = np.array([stirling[c, t] * np.prod([(strength + d * (outside + j)) * base for j in range(t)]) for t in range(1, c + 1)])
    tables, sizes = np.ones(n, np.int64), np.full(n, c - fresh)
    key = np.arange(n, dtype=np.uint64)
    for sweep in range(12):
        tables, sizes = pitman_yor.reseated(tables, sizes, np.full(n, fresh if sweep == 0 else 0), np.full(n, outside), strength, d, np.full(n, base), key, sweep)
        assert tables.sum() == len(sizes) and sizes.sum() == n * c and sizes.min() == 1
    assert np.abs(np.bincount(tables, minlength=c + 1)[1:] / n - weight / weight.sum()).max() < 0.02


def test_pitman_yor_large_items_and_thinning(monkeypatch):
    """Groups, chunks and lost customers keep the counts, and sweeps go on from the state they get."""
    rng = np.random.default_rng(3)
    customers = np.array([1, 2, 5, 300, 4000, 1, 700])
    key = rng.integers(0, 2**63, len(customers)).astype(np.uint64)
    of = lambda t, x: np.bincount(np.repeat(np.arange(len(t)), t), x, minlength=len(t)).tolist()
    args = (np.zeros(len(customers)), 1.0, 0.7, np.full(len(customers), 0.4), key)
    first = pitman_yor.reseated(np.ones(len(customers), np.int64), customers, 0 * customers, *args, 0)
    assert of(*first) == customers.tolist() and first[0][4] > 1
    monkeypatch.setattr(pitman_yor, "EXPANDED", 10)
    again = pitman_yor.reseated(np.ones(len(customers), np.int64), customers, 0 * customers, *args, 0)
    assert all(a.tolist() == b.tolist() for a, b in zip(first, again, strict=True))
    lost = np.array([0, 1, 2, 100, 3999, 0, -5])
    tables, sizes = pitman_yor.thinned(*first, lost, key, 1)
    assert of(tables, sizes) == [1, 1, 3, 200, 1, 1, 700]
    tables, sizes = pitman_yor.reseated(tables, sizes, np.maximum(-lost, 0), *args, 1)
    assert of(tables, sizes) == [1, 1, 3, 200, 1, 1, 705]


def test_pitman_yor_words():
    """Words, their hashes and lengths as Python cuts bytes, in slices and texts that are no UTF-8 too."""
    rng = np.random.default_rng(6)
    letters = list(" \t\n\x0b\x0c\rabAZ\x00\x1c\x85\u00a0\u3000\u00c9\u0130\u8a9e")
    texts = pa.array([*("".join(letters[i] for i in rng.integers(0, len(letters), n)) for n in rng.integers(0, 12, 500)), "", None, " ", "a", "  B  "])
    broken = pa.Array.from_buffers(pa.string(), 2, [None, pa.py_buffer(np.array([0, 4, 6], np.int32)), pa.py_buffer(b"A\xff B\xc3 ")])
    for part in (texts, texts.slice(7, 90), texts.cast(pa.large_string()), broken, texts.slice(0, 0)):
        h, flat, lengths = pitman_yor.words_of(part)
        words = [x.lower().split() for x in (b"" if not v.is_valid else v.as_buffer().to_pybytes() for v in part)]
        assert h[flat].tolist() == [y for x in words for y in (pitman_yor.END, *map(xxhash.xxh3_64_intdigest, x))] + [pitman_yor.END]
        assert lengths.tolist() == [len(x) + 1 for x in words] and (h[1:] > h[:-1]).all()


def test_pitman_yor_pairs_without_packing(monkeypatch):
    """Pairs that don't fit one number with their document are sorted apart, to the same blobs."""
    h, flat, lengths = pitman_yor.words_of(pa.array([None, *("a b a b c " * (i % 5) for i in range(40))]))
    train = np.ones(len(lengths), np.int64)
    want = list(pitman_yor.pairs_of(h, flat, lengths, train, (2, 3)))
    assert sum(int((x[3].astype(int)).sum()) for x in (pitman_yor.unpack(b) for _, b in want)) == len({(d, *p) for d, n in enumerate(np.split(flat[:-1], np.cumsum(lengths)[:-1])) for p in itertools.pairwise([*n.tolist(), 10**9])})
    monkeypatch.setattr(pitman_yor, "PACKED", 1)
    assert list(pitman_yor.pairs_of(h, flat, lengths, train, (2, 3))) == want


def test_pitman_yor_sweep_draws_little(monkeypatch):
    """A sweep hashes under five numbers a customer, though a large item lies among many small ones (before: seven)."""
    seen, mix = [0], pitman_yor.common.mix64
    monkeypatch.setattr(pitman_yor.common, "mix64", lambda x: seen.append(np.size(x)) or mix(x))
    rng = np.random.default_rng(2)
    customers = np.concatenate([rng.integers(2, 6, 20_000), [3000]])
    n, key = len(customers), rng.integers(0, 2**63, len(customers)).astype(np.uint64)
    tables, sizes = np.ones(n, np.int64), customers
    for sweep in range(3):
        tables, sizes = pitman_yor.reseated(tables, sizes, 0 * customers, np.full(n, 3), 1.0, 0.8, np.full(n, 0.05), key, sweep)
        assert sizes.sum() == customers.sum() and tables.sum() == len(sizes)
    assert sum(seen) < 3 * 5 * customers.sum()


def test_pitman_yor_fresh_customers_of_empty_items():
    tables, sizes = pitman_yor.reseated(np.array([0, 1, 0]), np.array([4]), np.array([1, 0, 0]), np.zeros(3), 1.0, 0.5, np.full(3, 0.1), np.arange(3, dtype=np.uint64), 0)
    assert tables[0] == 1 and tables[2] == 0 and sizes[0] == 1 and sizes.sum() == 5


def test_pitman_yor_works_once(spark):
    """Services answer the next sweep and the judges by one run: five seatings, five services, one judgement."""
    docs = spark.createDataFrame([(i, "a b c a b c d " * (i % 4)) for i in range(60)], "doc_id bigint, text string")
    df = pitman_yor.score(docs, 4)
    assert len(df.collect()) == 60
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert (plan.count("FlatMapCoGroupsInArrow"), plan.count("FlatMapGroupsInArrow")) == (11, 3)


def test_packing():
    arrays = [np.arange(5), np.array([2**63], np.uint64), np.zeros(0, np.int64), np.array([0.5, -2.25]), np.array([1.5], np.float32)]
    for a, b in zip(arrays, pitman_yor.unpack(pitman_yor.pack(*arrays)), strict=True):
        assert a.tolist() == b.tolist()


# WARC


PAGES = [(1, "http://a/", "x" * 2000), (5, "http://b/", "x" * 2000), (3, None, "x" * 2000), (7, "u\r\nWARC-Type: evil", "y"), (8, "u", "y"), (None, "u", "x" * 2000), (9, "u", None), (10, "u", "é" * 499), (11, "u", "é" * 499), (12, "u", "é" * 500), (13, "u", "é" * 500), (14, "u", "\r\n\r\nWARC/1.1\r\n" * 100)]


def test_warc_round_trip(spark):
    df = spark.createDataFrame(PAGES, "page_id bigint, url string, html string").withColumns({"sha1": F.lit(1), "length": F.lit(2), "leader": F.lit(3)})
    got = {r["page_id"]: r for r in rows(warc.round_trip(df))}
    assert len(got) == len(PAGES)
    for page, _, html in PAGES:
        data = (html or "").encode()
        assert (got[page]["payload_bytes"], got[page]["payload_digest"]) == (len(data), hashlib.sha1(data).hexdigest())
    refers = {p: r["refers_to"] for p, r in got.items() if r["record_type"] == "revisit"}
    assert refers == {1: 5, 3: 5, None: 5, 12: 13}
    assert rows(warc.round_trip(df.limit(0))) == []


def members():
    return [warc.record_bytes(i, f"http://a/{i}", b"payload %d " % i * 60, hashlib.sha1(b"payload %d " % i * 60).digest(), None) for i in range(8)]


def found(data):
    out = list(warc.salvage(data))
    return [int(h["warc-record-id"][10:-1]) for k, _, _, h, _ in out if k == "record"], [(a, b) for k, a, b, _, _ in out if k == "gap"]


@pytest.mark.parametrize("packed", [True, False])
def test_salvage(packed):
    parts = [warc.gzip_member(m) if packed else m for m in members()]
    whole = b"".join(parts)
    edges = np.cumsum([0, *map(len, parts)]).tolist()
    assert found(whole) == (list(range(8)), [])
    rng = np.random.default_rng(1)
    for _ in range(30):
        hit = int(rng.integers(0, 8))
        broken = bytearray(whole)
        at = int(rng.integers(edges[hit] + (12 if packed else len(parts[hit]) - 200), edges[hit + 1] - 5))
        broken[at] ^= 0x5A
        ids, gaps = found(bytes(broken))
        assert ids == [i for i in range(8) if i != hit] and gaps == [(edges[hit], edges[hit + 1])]
    assert found(whole[: edges[5] + 30]) == (list(range(5)), [(edges[5], edges[5] + 30)])
    assert found(b"junk" + whole)[0] == list(range(8)) and found(b"junk" + whole)[1] == [(0, 4)]
    assert found(b"") == ([], []) and found(b"no archive") == ([], [(0, 10)])


def test_salvage_within_a_member():
    parts = members()
    bad = list(parts)
    bad[3] = parts[3].replace(b"payload 3", b"payload X", 1)
    data = warc.gzip_member(b"".join(bad))
    ids, gaps = found(data)
    assert ids == [0, 1, 2, 4, 5, 6, 7] and gaps == [(0, len(data))]
    reason = next(x[3] for x in warc.salvage(data) if x[0] == "gap")
    edges = np.cumsum([0, *map(len, bad)]).tolist()
    assert "block digest differs" in reason and f"bytes {edges[3]} to {edges[4]} " in reason
    # the members around it are whole
    assert found(warc.gzip_member(parts[0]) + data + warc.gzip_member(parts[1]))[0] == [0, 0, 1, 2, 4, 5, 6, 7, 1]


def test_salvage_of_broken_members():
    rng = np.random.default_rng(2)
    parts = [warc.record_bytes(i, "u", b := rng.bytes(9000), hashlib.sha1(b).digest(), None) for i in range(6)]
    whole, after = warc.gzip_member(b"".join(parts)), warc.gzip_member(members()[7])
    ids, gaps = found(whole[: len(whole) * 3 // 4])
    assert ids == [0, 1, 2, 3] and gaps == [(0, len(whole) * 3 // 4)]
    checksum = bytearray(whole)
    checksum[-6] ^= 1
    ids, gaps = found(bytes(checksum) + after)
    assert ids == [0, 1, 2, 3, 4, 5, 7] and gaps == [(0, len(whole))]
    assert found(whole[: len(whole) // 2] + after)[0][-1] == 7
    assert found(warc.gzip_member(b"") + after) == ([7], [])


# URL filter


def test_url_parts_and_rules(spark):
    urls = ["HTTP://WWW.Example.ORG/en/12?q#f", "https://example.org", "http://example.org?x/y", "no scheme", None, "", "://", "http://a.co.uk/fr/#x?y", "http://notexample.org/es/", "http://x.com/fr/://b", "ftp://com/de/", "http://ÄB.com/de/x", "http://h#/p"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").withColumns({"host": F.lit(1), "n": F.lit(2)})
    got = {r["page_id"]: r for r in rows(url_reputation.judge(df, spark.createDataFrame([], "page_id bigint, bad int"), URL_RULES))}
    assert len(got) == len(urls)
    for i, url in enumerate(urls):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [r for r in URL_RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
        rule = max(fits, key=len, default=None)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert got[i]["verdict"] == (URL_RULES[rule] if rule else "allow")
    assert rows(url_reputation.judge(df.limit(0), spark.createDataFrame([], "page_id bigint, bad int"), URL_RULES)) == []


def test_reputation_shrinks(spark):
    """Planted: 9 bad hosts of two domains, 40 good ones, and hosts too little known to judge."""
    pages, outcomes = [], []
    for h in range(9):
        for i in range(30):
            outcomes.append((len(pages), int(i % 10 > 0)))
            pages.append((len(pages), f"http://h{h}.{'spam' if h < 6 else 'junk'}.net/{i}"))
    for h in range(40):
        for i in range(30):
            outcomes.append((len(pages), int(i % 10 == 0)))
            pages.append((len(pages), f"http://h{h}.fine.org.uk/{i}"))
    single = len(pages)
    pages += [(single, "http://one.fine.org.uk/"), (single + 1, "http://new.spam.net/"), (single + 2, "http://lone.example/"), (single + 3, None)]
    outcomes += [(single, 1), (single + 2, 1), (None, 1)]
    got = rows(url_reputation.judge(spark.createDataFrame(pages, "page_id bigint, url string"), spark.createDataFrame(outcomes, "page_id bigint, bad int"), {}))
    assert {r["page_id"] for r in got if r["verdict"] == "block"} == {*range(270), single + 1}  # the new host by its domain; one bad page is not enough
    by = {r["page_id"]: r for r in got}
    assert by[single]["bad_rate"] < 0.6 and by[single + 2]["bad_rate"] < 1 and by[0]["bad_chance"] > 0.99


def test_posterior_bound(spark):
    """The integral against sums of the binomial distribution: P(Beta(a, b) > x) = P(Bin(a + b - 1, x) < a)."""
    cases = [(a, b, x) for a, b in ((1, 1), (2, 5), (40, 3), (300, 290), (1, 900), (4000, 4100)) for x in (0.05, 0.3, 0.5, 0.9)]
    for x in {c[2] for c in cases}:
        own = [c for c in cases if c[2] == x]
        got = rows(spark.createDataFrame([(float(a), float(b)) for a, b, _ in own], "a double, b double").withColumn("p", url_reputation.chance_above(x, F.col("a"), F.col("b"))))
        for r in got:
            n, a = int(r["a"] + r["b"]) - 1, int(r["a"])
            terms = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(x) + (n - k) * math.log(1 - x) for k in range(a)]
            assert abs(r["p"] - math.fsum(map(math.exp, terms))) < 1e-6
    tiny = spark.createDataFrame([(0.001, 3.0), (3.0, 0.001)], "a double, b double").withColumn("p", url_reputation.chance_above(0.5, F.col("a"), F.col("b")))
    assert [round(r["p"], 2) for r in rows(tiny)] == [0.0, 1.0]


def test_suffix_rules(spark):
    rules = url_reputation.Suffixes(["// remark", "com", "co.uk", "*.ck", "!www.ck", "city.kobe.jp", ""])
    hosts = {"a.b.com": "b.com", "x.y.co.uk": "y.co.uk", "co.uk": "co.uk", "a.b.c.ck": "b.c.ck", "a.www.ck": "www.ck", "a.b.city.kobe.jp": "b.city.kobe.jp", "q.kobe.jp": "kobe.jp", "10.0.0.1": "10.0.0.1", "single": "single", "": ""}
    got = rows(spark.createDataFrame([(h,) for h in hosts], "host string").select("host", rules.domain(F.col("host")).alias("domain"), rules.suffix(F.col("host")).alias("suffix")))
    assert {r["host"]: r["domain"] for r in got} == hosts
    assert {r["host"]: r["suffix"] for r in got if r["host"].endswith("ck")} == {"a.b.c.ck": "c.ck", "a.www.ck": "ck"}


# pipeline


def brute_entropy(text):
    """Covered by a window that reaches its class's bound, each window counted anew; less fixed-form and public spans."""
    cover = bytearray(len(text))
    for m in secrets.CANDIDATE.finditer(text):
        v = m[0]
        for name, letters in secrets.CLASSES.items():
            for i in range(len(v) - secrets.WINDOW + 1):
                w = v[i : i + secrets.WINDOW]
                lower, upper = any(c.islower() for c in w), any(c.isupper() for c in w)
                h = -sum(n / len(w) * math.log2(n / len(w)) for n in Counter(w).values())
                if set(w) <= set(letters) and sum(c.isdigit() for c in w) >= secrets.LEAST_DIGITS[name] and (lower and upper if name == "base64" else lower or upper) and h >= secrets.BOUNDS[name] - 1e-9:
                    cover[m.start() + i : m.start() + i + len(w)] = b"\1" * len(w)
    base = [(a, b) for a, k, b in secrets.scan(text) if k != 3]
    for a, b in base:
        cover[a:b] = bytes(b - a)
    return base, [m.span() for m in re.finditer(b"\1+", bytes(cover)) if not secrets.allowed(text, *m.span())]


def brute_pipeline(docs):
    """The five stages in plain Python; docs in rows of documents. Returns (doc_id, ids) with their number."""
    model = sentencepiece.SentencePieceProcessor(model_file=corpus_pipeline.PIECES)
    kept = []
    for d, t, lang, source, _ in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        grams = Counter(zip(words, words[1:], words[2:], strict=False))
        repeated = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
        if len(words) < 50 or 100 * len(repeated) > 50 * len(words):
            continue
        tokens = Counter(x for w in words for x in model.encode(w))
        n = sum(tokens.values())
        entropy = -sum(c / n * math.log2(c / n) for c in tokens.values())
        low, high, share, bits = (fertility.LANGUAGE_BANDS.get(lang) or fertility.SCRIPT_BANDS["latin"])[:4]  # all the test's texts are Latin
        if low <= sum(map(len, words)) / n <= high and sum(c for x, c in tokens.items() if model.is_byte(x)) <= share * n and entropy >= bits * min(1.0, math.log2(n) / 8):
            kept.append((d, t, source))
    least = brute_components([(d, t) for d, t, _ in kept if d is not None], 5, 80)
    kept = [(d, t, s) for d, t, s in kept if d is None or least[d] == d]
    masked = []
    for d, t, s in kept:
        base, more = brute_entropy(t)
        out, at = "", 0
        for a, b in sorted([*base, *more]):
            out, at = (out + t[at:a] + "<secret>", max(at, b)) if a >= at else (out, max(at, b))
        masked.append((d, out + t[at:], s))
    tik = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(corpus_pipeline.BYTE_BPE), special_tokens={})
    return brute_mix(masked, max(16, math.isqrt(len(masked)))), masked, tik


def test_pipeline_against_brute_force(spark, tmp_path):
    docs = [r for r in fixtures.ROWS if r[0] is not None and r[0] not in (12, 14)] + [(100 + i, fixtures.prose(60 + i, 50 + i) + (" key x7Kq9ZpL2mVt8RwB4nYs6JdF" if i % 9 == 0 else "") + (" zq" * 9 if i % 7 == 0 else ""), "en", "ab"[i % 2], 1) for i in range(60)]
    docs += [(300, "".join(np.random.default_rng(1).choice(list("qwxzjkvb \u0439"), 900)), "en", "a", 1)]
    fixtures.with_clashes(spark.createDataFrame(docs, fixtures.SCHEMA)).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    (_, pieces), masked, tik = brute_pipeline(docs)
    got = rows(corpus_pipeline.run(spark, str(tmp_path)))
    assert 300 not in {d for d, *_ in masked} and {d for d, *_ in masked} >= set(range(100, 160))
    words = Counter((r["doc_id"], tuple(tik.decode(r["ids"]).split())) for r in got)
    assert words == pieces
    texts = {d: t for d, t, _ in masked}
    for r in got:  # ids are the library's, of a piece of the masked text
        piece = tik.decode(r["ids"])
        assert piece in texts[r["doc_id"]] and r["ids"] == tik.encode_ordinary(piece) and r["n_tokens"] == len(r["ids"]) and r["n_chars"] == len(piece)


def test_pipeline(spark, tmp_path):
    """Rows of nulls, empty texts, ties, repeated rows and clashing columns go through every stage."""
    docs = [*fixtures.ROWS, *((100 + i, fixtures.prose(60 + i, 50 + i), "en", "ab"[i % 2], 1) for i in range(40))]
    fixtures.with_clashes(spark.createDataFrame(docs, fixtures.SCHEMA)).write.parquet(f"{tmp_path}/documents.parquet")
    steps = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, hard = steps.columns, steps
    for name, stage in corpus_pipeline.STAGES[:-1]:
        steps = stage(spark, steps, str(tmp_path))
        assert steps.columns == columns
        ids = {r["doc_id"] for r in rows(steps)}
        assert ids >= set(range(100, 140)) if name != "mixing" else ids <= {r[0] for r in docs}  # filters keep all clean documents
        alone = stage(spark, hard, str(tmp_path))  # every stage also takes what a stage before it would drop
        assert alone.columns == columns and rows(alone)
        assert rows(stage(spark, fixtures.empty(spark), str(tmp_path))) == []
    kept = {r["doc_id"] for r in rows(corpus_pipeline.encode(spark, steps, str(tmp_path)))}
    assert not kept & {2, 3, 6, 7, 8, 13}
    assert len(corpus_pipeline.STAGES) == 5
    spark.createDataFrame([], fixtures.SCHEMA).write.parquet(f"{tmp_path}/empty/documents.parquet")
    assert rows(corpus_pipeline.run(spark, f"{tmp_path}/empty")) == []
