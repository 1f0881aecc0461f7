"""Ways through trees, the expansion loop, reading by keywords, raw pairs and ingest, against plain Python on hard cases."""

import hashlib
import json
import uuid

import pytest
from pyspark.sql import functions as F

from spanloom.functions import ident
from spanloom.operators import contracts, graph, hits, ingest, navigate, reconcile
from spanloom.plans.model import line_rows, lines_with_starts
from spanloom.sources import bundle, pairs

#: A root with a long line below it, a pair that is each other's parent, a node of a missing parent, a node that is its own parent.
PARENTS = {"r": None, **{f"n{i}": f"n{i - 1}" if i else "r" for i in range(40)}, "x": "y", "y": "x", "z": "x", "lost": "gone", "self": "self", "s1": "r", "s2": "r"}


@pytest.fixture(scope="module")
def tree(spark):
    rows = [(n, p, None if n == "s2" else i, i % 2) for i, (n, p) in enumerate(PARENTS.items())]
    return spark.createDataFrame(rows, "node_id string, parent_node_id string, page_start int, version_id int")


def of(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "node_id string")


def chain(node):
    seen = []
    while node in PARENTS and node not in seen:
        seen.append(node)
        node = PARENTS[node]
    return seen


def test_chains(spark, tree):
    got = {}
    for r in navigate.chains(tree, tree).collect():
        got.setdefault(r.node_id, {})[r.step] = r.ancestor_id
    assert {n: [steps[i] for i in range(len(steps))] for n, steps in got.items()} == {n: chain(n) for n in PARENTS}


def test_chains_of_few_and_of_none(spark, tree):
    some = navigate.chains(tree, of(spark, "n3", "n3", "nowhere", None))
    assert sorted((r.step, r.ancestor_id) for r in some.collect()) == list(enumerate(["n3", "n2", "n1", "n0", "r"]))
    assert navigate.chains(tree, of(spark)).count() == 0
    with pytest.raises(ValueError, match="more than 16"):
        navigate.chains(tree, tree, 16).count()


def test_unknown_nodes(spark, tree):
    wanted = of(spark, "r", "nowhere", None)
    assert {r.node_id for r in navigate.unknown(tree, wanted).collect()} == {"nowhere", None}
    navigate.require(tree, of(spark, "r", "n1"))
    with pytest.raises(ValueError, match="node not found"):
        navigate.require(tree, of(spark, "nowhere"))


def test_relatives(spark, tree):
    pairs_of = lambda df: sorted(tuple(r) for r in df.collect())
    assert pairs_of(navigate.parents(tree, tree)) == sorted((n, p) for n, p in PARENTS.items() if p in PARENTS)
    assert pairs_of(navigate.children(tree, of(spark, "r", "n39"))) == [("r", "n0"), ("r", "s1"), ("r", "s2")]
    assert pairs_of(navigate.siblings(tree, of(spark, "r", "s1", "s1", "lost", "self"))) == [("lost", "lost"), ("s1", "n0"), ("s1", "s1"), ("s1", "s2"), ("self", "self")]


@pytest.mark.parametrize("pages", [0, 1, 5])
@pytest.mark.parametrize("scope", [[], ["version_id"]])
def test_adjacent(spark, tree, pages, scope):
    at = {n: i for i, n in enumerate(PARENTS) if n != "s2"}
    want = sorted((a, b, at[b] - at[a]) for a in at for b in at if abs(at[a] - at[b]) <= pages and (not scope or at[a] % 2 == at[b] % 2))
    assert sorted(tuple(r) for r in navigate.adjacent(tree, tree, pages, scope).collect()) == want


def test_provenance(spark, tree):
    spans = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), ("d",)], "span_id string")
    links = spark.createDataFrame([("a", "n1", 2), ("a", "n2", 1), ("a", "n0", 2), ("b", "y", 1), ("d", "nowhere", 1), ("e", "r", 1)], "span_id string, node_id string, ordinal_no int")
    got = {}
    for r in navigate.span_provenance(spans, links, tree).collect():
        got.setdefault((r.span_id, r.node_id), {})[r.step] = r.ancestor_id
    assert {k: [v[i] for i in range(len(v))] for k, v in got.items()} == {("a", "n2"): chain("n2"), ("b", "y"): ["y", "x"]}


@pytest.fixture(scope="module")
def graph_of_nodes(spark):
    ancestors = spark.createDataFrame([(n, n, 0) for n in "rabc"] + [(n, "r", 1) for n in "abc"], "node_id string, ancestor_id string, distance int")
    links = spark.createDataFrame([("a", "a1", 1), ("a", "a2", 2), ("b", "b1", 1), ("c", "c1", 1), ("r", "r1", 1), ("r", "a2", 2)], "node_id string, key string, ordinal_no int")
    return ancestors, links


HITS = "key string, path string, ordinal int, score double, node_id string"


def test_expansion(spark, graph_of_nodes):
    """Four equal hits on one node: its totals and the root's are alike, so the spread is even and every node is taken."""
    rows = [("a1", "keyword", 1, 0.9, "a"), ("a1", "vector", 1, 0.5, "a"), ("q", "keyword", 2, 0.4, None)]
    got = {r.key: r for r in hits.expansion(spark.createDataFrame(rows, HITS), *graph_of_nodes).collect()}
    assert {r.decision for r in got.values()} == {"high_dispersion"}
    assert set(got) == {"a1", "a2", "r1", "q"}
    assert {k for k, r in got.items() if r.expanded} == {"a2", "r1"}
    assert got["a1"].source_paths == "keyword,tree_expansion,vector" and got["a1"].rank == 1
    assert sorted(r.rank for r in got.values()) == [1, 2, 3, 4]


@pytest.mark.parametrize(("totals", "decision", "taken"), [
    ({"a": 100.0, "b": 0.1, "c": 0.1, "r": 0.1}, "high_concentration", ["a", "b"]), ({"a": 10.0, "b": 2.0, "c": 0.3, "r": 0.3}, "moderate", ["a"]), ({"a": 1.0, "b": 1.0}, "high_dispersion", ["a", "b"]),
])
def test_suggested(spark, totals, decision, taken):
    rolled = spark.createDataFrame([(n, t, 1) for n, t in totals.items()], "node_id string, total double, hits long")
    got = sorted(hits.suggested(rolled).collect(), key=lambda r: r.rank)
    assert [r.node_id for r in got] == taken and {r.decision for r in got} == {decision}


def test_expansion_without_nodes(spark, graph_of_nodes):
    got = hits.expansion(spark.createDataFrame([("q", "keyword", 1, 0.4, None), ("u", "keyword", 2, None, None)], HITS), *graph_of_nodes).collect()
    assert [(r.key, r.decision, r.expanded) for r in sorted(got, key=lambda r: r.rank)] == [("q", "no_hits", False), ("u", "no_hits", False)]
    assert hits.expansion(spark.createDataFrame([], HITS), *graph_of_nodes).count() == 0


def test_graph_context(spark):
    chunks = spark.createDataFrame([(1, "Solar power, wind."), (2, "solar powers"), (3, "wind"), (4, None), (5, "")], "chunk_id int, text string")
    got = graph.context("q", ["solar power", "  ", "wind"], ["wind"], chunks)
    assert [tuple(r) for r in got.orderBy("rank").collect()] == [("chunk", "1", 2, 1.0, 1), ("chunk", "3", 1, 0.5, 2)]
    assert graph.context("q", ["..."], [], chunks).count() == 0
    for question, low, high, limits in ((" ", ["a"], [], {}), ("q", [" "], [], {}), ("q", "solar", [], {}), ("q", [1], [], {}), ("q", ["a"], [], {"mode": "deep"}), ("q", ["a"], [], {"top_k": 0}), ("q", ["a"], [], {"mode": "local"})):
        with pytest.raises(ValueError):
            graph.context(question, low, high, chunks, **limits)


DOC, VERSION = str(uuid.uuid5(uuid.NAMESPACE_URL, "d")), str(uuid.uuid5(uuid.NAMESPACE_URL, "v"))
NODES = "name string, ordinal int, page_no int, headings array<string>, start_offset long, text string"
DOCUMENTS = "name string, doc_id string, version_id string, source_checksum string, docling_version string"


def test_raw_pairs(spark):
    rows = [
        ("one-2", 0, None, None, None, "no  heading\n"), ("one-2", 1, 1, ["A", " ", "B "], 12, 'quote " back \\ tab\tnul \x01 é😀'), ("one-2", 2, 1, ["A", "B"], 30, "same"), ("one-2", 3, 2, ["C"], 40, " \n"),
        ("one-2", 4, 2, ["C"], 41, "deep"), ("one-2", 5, 2, [], 50, "out"), ("twice", 0, 1, [], 0, "a"), ("twice", 1, 1, [], 0, "a"), ("blank", 0, 1, ["T"], 0, "  "),
    ]
    names = [("one-2", DOC, VERSION), ("twice", DOC, VERSION), ("blank", DOC, VERSION), ("empty", DOC, VERSION), ("No", DOC, VERSION), ("bad-id", "1", VERSION), ("x" * 101, DOC, VERSION)]
    docs = spark.createDataFrame([(*n, "0" * 64, "2.1") for n in names], DOCUMENTS)
    got = {r.name: r for r in pairs.raw_pairs(docs, spark.createDataFrame(rows, NODES), "maker: 1").collect()}
    assert {n: r.error for n, r in got.items() if r.error} == {"twice": "repeated span", "blank": "no valid spans", "empty": "no valid spans", "No": "invalid slug", "bad-id": "doc_id must be a UUID", "x" * 101: "invalid slug"}
    assert all(r.markdown is None and r.manifest is None for r in got.values() if r.error)
    one = got["one-2"]
    assert (one.span_count, one.dropped_nodes, got["blank"].dropped_nodes) == (5, 1, 1)
    front = {"type": "raw", "doc_id": DOC, "version_id": VERSION, "source_checksum": "0" * 64, "docling_version": "2.1", "generated_by": "maker: 1", "title": "A"}
    body = 'no heading\n\n# A\n\n## B\n\nquote " back \\ tab nul \x01 é😀\n\nsame\n\n# C\n\ndeep\n\nout\n'
    head = f"type: raw\ndoc_id: {DOC}\nversion_id: {VERSION}\nsource_checksum: '{'0' * 64}'\ndocling_version: '2.1'\ngenerated_by: 'maker: 1'\ntitle: A\n"
    assert one.markdown == f"---\n{head}---\n{body}"
    kept = [(None, [], 0, "no heading"), (1, ["A", "B"], 12, 'quote " back \\ tab nul \x01 é😀'), (1, ["A", "B"], 30, "same"), (2, ["C"], 41, "deep"), (2, [], 50, "out")]
    spans = [{"span_id": str(uuid.uuid5(uuid.NAMESPACE_URL, f"{DOC}|{VERSION}|{p}|{'/'.join(h)}|{o}|{t}")), "page_no": p, "heading_path": h, "offset": o, "text": t} for p, h, o, t in kept]
    assert one.sidecar == json.dumps({"schema_version": 1, "doc_id": DOC, "version_id": VERSION, "spans": spans}, indent=2, ensure_ascii=False) + "\n"
    plain = lambda v: json.dumps(v, ensure_ascii=False, separators=(",", ":"), sort_keys=True)
    assert one.canonical_hash == hashlib.sha256((plain(front) + plain(spans)).encode()).hexdigest()
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    manifest = {"canonical_hash": one.canonical_hash, "markdown_file": "one-2.md", "markdown_sha256": digest(one.markdown), "schema_version": 1, "sidecar_file": "one-2.spans.json", "sidecar_sha256": digest(one.sidecar)}
    assert one.manifest == plain(manifest) + "\n"


def test_raw_pairs_read_back(spark):
    docs = spark.createDataFrame([("a-1", DOC, VERSION, "f" * 64, "2.1")], DOCUMENTS)
    files = pairs.raw_pairs(docs, spark.createDataFrame([("a-1", 0, None, None, 0, "t")], NODES), "m")
    row = files.withColumn("breach", contracts.manifest_breach(F.col("markdown"), F.col("sidecar"), F.col("manifest"))).first()
    assert row.breach is None
    front = bundle.split_front(files.select("name", F.col("markdown").alias("value")), "value").select(bundle.front_fields(F.col("front")).alias("f"))
    read = front.withColumn("breach", contracts.front_breach(F.col("f"))).first()
    assert read.breach is None and read.f["title"] == "A 1"
    assert contracts.sidecars(files.select("sidecar"), "sidecar").first().breach is None


def test_yaml_text(spark):
    cases = {"plain text": "plain text", "true": "'true'", "1.5": "'1.5'", "0b10": "'0b10'", "0bca": "0bca", "a: b": "'a: b'", "it's": "'it''s'", "": "''", "-x": "'-x'", "end ": "'end '", "a\nb": '"a\\nb"', "é": "'é'"}
    got = spark.createDataFrame([(c,) for c in cases], "v string").select("v", pairs.yaml_text(F.col("v")).alias("y")).collect()
    assert {r.v: r.y for r in got} == cases


def inputs(spark, texts: dict, parsed: dict):
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    sources = spark.createDataFrame(list(texts.items()), "source_uri string, content string")
    read = spark.createDataFrame([(u, digest(t), "2.1") for u, t in parsed.items()], "source_uri string, source_sha256 string, docling_version string")
    nodes = spark.createDataFrame([(u, i, None, None, None, x) for u, t in parsed.items() for i, x in enumerate(t.split("\n"))], "source_uri string, ordinal int, page_no int, headings array<string>, start_offset long, text string")
    return sources, read, nodes


NO_VERSIONS = "doc_id string, content_hash string, version_no int, is_active boolean"


def test_ingest(spark):
    texts = {"a": "one\n\ntwo", "gone": None, "unparsed": "x", "other": "now", "blank": " \n "}
    batch = inputs(spark, texts, {"a": "one\n\ntwo", "gone": "x", "other": "then", "blank": " \n "})
    first = ingest.ingest(*batch, spark.createDataFrame([], NO_VERSIONS), "m")
    got = {r.source_uri: r for r in first.results.collect()}
    assert {u: r.outcome for u, r in got.items()} == {"a": "ingested", "gone": "source not found", "unparsed": "not parsed", "other": "content hash mismatch", "blank": "no valid spans"}
    assert (got["a"].spans, got["a"].dropped_nodes, got["blank"].dropped_nodes, got["gone"].version_id) == (2, 1, 2, None)
    assert [(r["index"], r.text, r.headings) for r in first.spans.orderBy("index").collect()] == [(0, "one", []), (1, "two", [])]
    assert first.versions.filter("is_active").count() == 4  # all but the missing one are registered

    again = ingest.ingest(*batch, first.versions, "m")
    assert {tuple(r) for r in again.versions.collect()} == {tuple(r) for r in first.versions.collect()}
    assert {r.op for r in reconcile.difference(first.spans, again.spans, ["span_id"]).collect()} == {"unchanged"}

    next_ = ingest.ingest(*inputs(spark, {"a": "one\nthree"}, {"a": "one\nthree"}), again.versions, "m")
    own = next_.versions.filter(F.col("doc_id") == ident.uuid5(F.lit("a")))
    assert sorted((r.version_no, r.is_active) for r in own.collect()) == [(1, False), (2, True)]
    assert {r.version_id for r in next_.spans.collect()} == {r.version_id for r in next_.results.collect()} != {got["a"].version_id}


def test_ingest_needs_its_inputs(spark):
    with pytest.raises(ValueError, match="missing: nodes, generated_by"):
        ingest.ingest(None, spark.range(1), None, spark.range(1), None)


def test_lines(spark):
    texts = [None, "", "a\nbé\n\n😀x\ny", "\n", None, "q"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(lines_with_starts("t").alias("l")).collect()
    for t, r in zip(texts, got, strict=True):
        assert (t is None) == (r.l is None)
        if t is not None:
            assert [x.line for x in r.l] == t.split("\n")
            assert all(t[x.start : x.start + len(x.line)] == x.line for x in r.l)


def test_lines_of_few_texts_at_a_time(spark):
    """The rows are those of whole batches, whatever falls to one slice; a null text has no line, an empty one has one."""
    texts = [None if n % 11 == 0 else "\n".join("aé𝄞 "[: (n + k) % 5] for k in range(n % 7)) for n in range(600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    want = [(n, i, sum(len(x) + 1 for x in t.split("\n")[:i]), line) for n, t in enumerate(texts) if t is not None for i, line in enumerate(t.split("\n"))]
    assert sorted(map(tuple, line_rows(docs, "doc_id").collect())) == want
