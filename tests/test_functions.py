"""Functions and operators on small fixtures, golden values among them."""

import math

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from spanloom.functions import ident, text, vectors
from spanloom.operators import chunks, distribution, entity, fuse, knowledge, reconcile, retrieve, similar, tree
from spanloom.sources import bundle, pages


def one(spark, *columns):
    return list(spark.range(1).select(*columns).first())


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def test_golden_span_id(spark):
    page, heads = F.lit(1), F.array(F.lit("Introduction to Machine Learning"))
    got = one(spark, ident.span_id(F.lit("00000000-0000-0000-0000-000000000001"), F.lit("00000000-0000-0000-0000-000000000003"), page, heads, F.lit(0), F.lit("Overview of ML fundamentals.")))
    assert got == ["11ab7e50-03f3-5849-97a8-416165e454c7"]


def test_trigrams(spark):
    assert one(spark, F.round(text.trigram_similarity(F.lit("word similarity"), F.lit("word")), 4), text.trigram_similarity(F.lit(""), F.lit("")), text.match_score(F.lit("A Word"), "word")) == [0.3125, 0.0, 1.0]


def test_scalars(spark):
    assert one(spark, text.page_list(F.lit("5-7, 3,6")), text.keyword_list(F.lit(" a,;b；c，")), text.slug(F.lit("Über Ärzte 2!")), text.heading_parts(F.lit("A > B > C")), text.prefixes(F.lit("A > B > C"))) == [[3, 5, 6, 7], ["a", "b", "c"], "berrzte2", ["A", "B", "C"], ["A", "A > B", "A > B > C"]]
    assert one(spark, *(text.query_kind(F.lit(q)) for q in (" Table of contents", "why is the sky so blue", "人工智能的历史", "error 404", "a/b", "cat", "what is machine learning?", " "))) == ["tree", "vector", "vector", "keyword", "keyword", "keyword", "vector", "vector"]
    with pytest.raises(Exception, match="reversed"):
        one(spark, text.page_list(F.lit("9-2")))


def test_vectors(spark):
    array = lambda *x: F.array(*(F.lit(float(v)) for v in x))
    assert one(spark, vectors.cosine(array(1, 0), array(1, 1)), vectors.cosine(array(0, 0), array(1, 1)), vectors.euclid(array(0, 0), array(3, 4))) == [pytest.approx(1 / math.sqrt(2)), 0.0, 5.0]
    with pytest.raises(Exception, match="length"):
        one(spark, vectors.cosine(array(1), array(1, 1)))


def test_golden_node_stats(spark):
    members = spark.createDataFrame([("c1", [1.0, 2.0]), ("c1", [3.0, 4.0]), ("c2", [10.0, 0.0])], "node string, embedding array<double>")
    got = {r["node"]: r for r in rows(distribution.node_stats(members, "node"))}
    assert got["c1"]["centroid"] == [2.0, 3.0] and got["c1"]["dispersion"] == pytest.approx(math.sqrt(2)) and got["c1"]["entropy"] == pytest.approx(1.0)
    assert (got["c2"]["support"], got["c2"]["dispersion"], got["c2"]["entropy"]) == (1, 0.0, 0.0)


def test_fusion(spark):
    hits = spark.createDataFrame([("a", 1, "x", 0.9), ("a", 2, "y", 0.1), ("a", 3, "x", 0.2), ("b", 1, "z", None), ("b", 2, "x", None)], "path string, ordinal int, text string, score double")
    got = {r["text"]: r for r in rows(fuse.fuse(hits))}
    assert got["x"]["fused"] == pytest.approx((1 / 61 + 1 / 62) * 1.1, abs=1e-9) and got["x"]["source_paths"] == "a,b"
    assert got["z"]["fused"] == pytest.approx(1 / 61, abs=1e-9)
    assert rows(fuse.fuse(hits.limit(0))) == []
    single = rows(fuse.normalized(hits.limit(1)))
    assert single[0]["norm"] == 1.0
    titles = lambda *t: spark.createDataFrame([(x, i) for i, x in enumerate(t)], "title string, ordinal int")
    assert [(r["title"], r["score"]) for r in rows(fuse.fuse_titles(titles("p", "q"), titles("q"), (1.0, 1.0)))] == [("q", pytest.approx(1 / 61 + 1 / 60)), ("p", pytest.approx(1 / 60))]


def test_weighted(spark):
    df = spark.createDataFrame([(1.0, 1.0, None), (1.0, 0.0, 0.5)], "a double, b double, r double")
    got = [r["w"] for r in rows(df.select(fuse.weighted({"a": 0.4, "b": 0.3, "r": 0.3}, "r").alias("w")))]
    assert got == [pytest.approx(1.0), pytest.approx(0.55)]


def test_search_terms(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["red fox", "red big fox", "blue fox", "green"])], "i int, raw_text string")
    hit = lambda q: [r["i"] for r in rows(df.filter(retrieve.all_terms(F.col("raw_text"), q)))]
    assert hit("red fox") == [0, 1] and hit('"red fox"') == [0] and hit("fox -red") == [2] and hit("blue or green") == [2, 3]


def test_decisions(spark):
    df = spark.createDataFrame([(1.2, 0.1, 2.0), (0.0, 0.0, 0.0), (0.7, 1.0, 2.0), (0.7, 1.9, 2.0)], "cv double, entropy double, max_entropy double")
    assert [r["d"] for r in rows(df.select(distribution.decision().alias("d")))] == ["high_concentration", "high_dispersion", "moderate", "high_dispersion"]
    assert one(spark, *(distribution.hiro_policy(F.lit(p), F.lit(c)) for p, c in ((0.4, 0.6), (0.6, 0.4), (0.55, 0.58)))) == ["drill_down", "keep_parent", "prune"]


def test_greedy_hotspots(spark):
    df = spark.createDataFrame([("g", "1", "a", 0.9), ("g", "2", "a > b", 0.8), ("g", "3", "c", 0.7), ("g", "4", "c2", 0.6), ("g", "5", "d", 0.5)], "g string, node_id string, heading_path string, score double")
    assert [r["node_id"] for r in sorted(rows(distribution.greedy_hotspots(df, "g", 3)), key=lambda r: r["place"])] == ["1", "3", "4"]


def test_mention_sweep(spark):
    schema = "scope int, mention_id int, start int, stop int, priority int, label string, fingerprint string"
    data = [(1, 1, 0, 5, 1, "P", "a"), (1, 2, 0, 5, 2, "P", "b"), (1, 3, 1, 3, 2, "P", "c"), (1, 4, 4, 9, 2, "P", "d"), (1, 5, 9, 12, 3, "P", "e"), (1, 6, 0, 5, 1, "P", "a"), (1, 7, 0, 5, 3, "Q", "f"), (2, 8, 0, 5, 4, "P", "g"), (1, 9, 8, 20, 4, "P", "h")]
    got = {r["mention_id"]: (r["outcome"], r["winner"]) for r in rows(knowledge.merge_mentions(spark.createDataFrame(data, schema), ["scope"]))}
    assert got == {1: ("selected", None), 2: ("grouped", 1), 3: ("nested", 1), 4: ("overlap", 1), 5: ("selected", None), 6: ("duplicate", 1), 7: ("suppressed", 1), 8: ("selected", None), 9: ("nested", 5)}


def test_review_of_empty_claims(spark):
    data = [("", "b", "a b"), ("a", None, "a b"), ("a", "b", " "), (" A ", "B", "x a  b"), ("a", "z", "a"), ("a", "b", None)]
    got = [r["verdict"] for r in rows(knowledge.review(spark.createDataFrame(data, "subject string, object string, quote string")))]
    assert got == ["uncertain", "uncertain", "unsupported", "supported", "uncertain", "pending"]


def test_merged_text(spark):
    from spanloom.operators import admission

    front = "---\ntitle: t\n---\n"
    got = one(spark, *(admission.merged_text(F.lit(a), F.lit(b)) for a, b in ((front + "old", "new"), (None, "new\n"), ("old", "new"), (front.rstrip("\n"), "new"))))
    assert got == [front + "new\n", "new\n", "new\n", front + "new\n"]
    with pytest.raises(Exception, match="not closed"):
        one(spark, admission.merged_text(F.lit("---\ntitle: t\n"), F.lit("new")))


def test_ranks_by_cells(spark):
    data = [(f"p{i % 2}", i, None if i % 9 == 0 else float(i * 7919 % 50)) for i in range(400)]
    df = spark.createDataFrame(data, "path string, ordinal int, score double")
    got = {(r["path"], r["ordinal"]): r["rank"] for r in rows(fuse.ranked(df, "path", [F.desc_nulls_last("score"), F.asc("ordinal")]))}
    for path in ("p0", "p1"):
        order = sorted((x for x in data if x[0] == path), key=lambda x: (x[2] is None, -(x[2] or 0), x[1]))
        assert [got[path, x[1]] for x in order] == list(range(1, len(order) + 1))


def test_tokens_of_few_texts_at_a_time(spark, monkeypatch):
    """The same places by either join; a worker never holds a list of places for a whole batch of texts."""
    texts = spark.createDataFrame([(i, "the x_y theZ " * (i % 4) + "The") for i in range(200)] + [(200, None)], "k int, t string").coalesce(1)
    names = spark.createDataFrame([("the", "x"), ("y", "z"), ("none", "z")], "name string, entity_type string")
    want = sorted((i, "the", n * 13, "x") for i in range(200) for n in range(i % 4 + 1)) + sorted((i, "y", n * 13 + 6, "z") for i in range(200) for n in range(i % 4))
    few = entity.dictionary_candidates(texts, names, "k", "t")
    monkeypatch.setattr(entity, "BROADCAST", 0)
    for found in (few, entity.dictionary_candidates(texts, names, "k", "t")):
        assert sorted((r["k"], r["name"], r["start"], r["entity_type"]) for r in rows(found)) == sorted(want)
    assert "MapInArrow" in few._jdf.queryExecution().toString()


def test_token_places(spark):
    texts = spark.createDataFrame([(1, "The other, the Théâtre"), (2, None), (3, "")], "k int, t string")
    names = spark.createDataFrame([("the", "x"), ("théâtre", "y")], "name string, entity_type string")
    assert sorted((r["k"], r["name"], r["start"]) for r in rows(entity.dictionary_candidates(texts, names, "k", "t"))) == [(1, "the", 0), (1, "the", 11), (1, "théâtre", 15)]
    found = spark.createDataFrame([(1, "other", 4), (1, "the", 5)], "k int, mention string, start int")
    assert [r["mention"] for r in rows(entity.exact_slices(found, texts, "k", "t"))] == ["other"]


def test_unknown_tombstone(spark):
    df = spark.createDataFrame([("a", False)], "cluster_id string, tombstoned boolean")
    with pytest.raises(KeyError):
        entity.tombstoned(df, ["b"])


def test_codes(spark):
    good = "91350100M000100Y43"
    assert one(spark, entity.codes_in(F.lit(f"code {good}.")), entity.codes_in(F.lit("91350100M000100Y44"))) == [[good], []]


def test_names(spark):
    df = spark.createDataFrame([("  Ｆｏｏ​  BAR",), (None,)], "n string")
    assert [r["n"] for r in rows(df.select(entity.normal_name(F.col("n")).alias("n")))] == ["foo bar", None]
    people = spark.createDataFrame([(1, "P", "jonathan smith"), (2, "P", "jonathon smith"), (3, "Q", "jonathan smith"), (4, "P", "mary")], "identity_id int, entity_type string, name string")
    assert [(r["left_id"], r["right_id"]) for r in rows(similar.suggestions(people))] == [(1, 2)]


def test_coreference_rejects_repeats(spark):
    df = spark.createDataFrame([(1, "a", 7), (1, "a", 7)], "doc int, name string, m int")
    with pytest.raises(Exception, match="twice"):
        entity.coreference(df, ["doc", "name"], "m").collect()


def test_reconcile_twice_is_idle(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d"), (3, "e")], "k int, v string")
    added = reconcile.insert_ignored(old, new, ["k"], [F.col("v")])
    assert [(r["k"], r["v"]) for r in rows(added)] == [(3, "d")]
    assert rows(reconcile.insert_ignored(old.unionByName(added), new, ["k"], [F.col("v")])) == []
    assert {r["op"] for r in rows(reconcile.difference(old, old, ["k"]))} == {"unchanged"}
    versions = spark.createDataFrame([(1, "v1", True), (1, "v2", False), (2, "w1", True)], "doc_id int, version_id string, is_active boolean")
    assert {r["version_id"]: r["is_active"] for r in rows(reconcile.activated(versions, "v2"))} == {"v1": False, "v2": True, "w1": True}


def test_transitions(spark):
    pairs = [("registered", "parsed", None), ("registered", "embedded", "not the next state"), ("parsed", "failed", None), ("failed", "parsed", "failed is final"), ("parsed", "odd", "unknown state")]
    df = spark.createDataFrame([(a, b) for a, b, _ in pairs], "a string, b string")
    assert [r["e"] for r in rows(df.select(reconcile.transition_error(F.col("a"), F.col("b")).alias("e")))] == [e for *_, e in pairs]


def test_tree(spark):
    df = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "c")], "node_id string, parent_node_id string")
    assert len(rows(chunks.ancestors(df))) == 10
    with pytest.raises(ValueError, match="cycle"):
        chunks.ancestors(spark.createDataFrame([("a", "b"), ("b", "a")], "node_id string, parent_node_id string"))
    hits = spark.createDataFrame([(1, "v", 3), (2, "v", 9), (3, "w", 3)], "hit int, version_id string, page_no int")
    nodes = spark.createDataFrame([("r", "v", 0, "r", "r", 1, 5), ("s", "v", 1, "r > s", "s", 2, 3)], "node_id string, version_id string, level_no int, heading_path string, title string, page_start int, page_end int")
    assert [(r["hit"], r["node_id"]) for r in rows(tree.most_specific(hits, nodes, "hit"))] == [(1, "s")]


def test_pages_of_nodes_are_not_broadcast(spark):
    """A node of many pages is small before its pages are dealt out; the join must not go by that size."""
    nodes = spark.range(1000).selectExpr("id as version_id", "'n' as node_id", "0 as level_no", "1 as page_start", "100 as page_end", "'x' as heading_path", "'x' as title")
    found = tree.most_specific(spark.range(1000).selectExpr("id as hit", "id as version_id", "7 as page_no"), nodes, "hit")
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 1000


def test_overlap(spark):
    df = spark.createDataFrame([(1, 1, "a b c"), (1, 2, "d"), (1, 3, "e f g")], "doc int, i int, text string")
    assert [r["widened"] for r in rows(chunks.overlapped(df, 2, ["doc"], ["i"]).orderBy("i"))] == ["a b c d", "b c d e f", "d e f g"]
    assert [r["widened"] for r in rows(chunks.overlapped(df, 0, ["doc"], ["i"]).orderBy("i"))] == ["a b c", "d", "e f g"]


def test_pages(spark):
    df = spark.createDataFrame([(1, "<head><title>t</title></head><nav><p>menu</p></nav><h1>A &amp; B</h1><p>one <b>two</b></p><p> </p><p class='x'>3 &lt; 4"), (2, None)], "page_id int, html string")
    assert [(r["heading"], r["raw_text"]) for r in rows(pages.page_spans(df))] == [("A & B", "one two"), ("A & B", "3 < 4")]


def test_parsed_nodes(spark):
    meta = '{"headings": ["H"], "doc_items": [{"label": "text", "prov": [{"page_no": 2, "charspan": [7, 9]}]}]}'
    df = spark.createDataFrame([("d", 0, "x", meta), ("d", 1, " ", meta), ("d", 2, "y", None)], "doc_id string, ordinal int, text string, metadata string")
    assert [(r["text"], r["page_no"], r["start_offset"], r["headings"]) for r in rows(pages.parsed_nodes(df))] == [("x", 2, 7, ["H"]), ("y", None, 2, None)]


def test_bundle(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/one.md").write_text("---\ntitle: \"T\"\ntype: raw\n---\n# Head\n\npara one\n\npara two\n")
    (tmp_path / "a/bad.md").write_text("---\ntitle: x\nno end")
    (tmp_path / "a/index.md").write_text("skip")
    got = {r["name"]: r for r in rows(bundle.scan(spark, str(tmp_path)).withColumn("f", bundle.front_fields(F.col("front"))))}
    assert set(got) == {"one.md", "bad.md"} and got["one.md"]["f"] == {"title": "T", "type": "raw"} and got["bad.md"]["error"]
    text_ = rows(bundle.paragraphs(bundle.scan(spark, str(tmp_path)).filter("error is null"), "name"))
    assert [(r["number"], r["heading"], r["text"]) for r in text_] == [("P1", "Head", "para one"), ("P2", "Head", "para two")]
    vectors_ = spark.createDataFrame([Row(vec_id=1, x=2.0)])
    bundle.write_collection(vectors_, str(tmp_path / "v"), "c1")
    bundle.write_collection(vectors_, str(tmp_path / "v"), "c2")
    bundle.write_collection(vectors_.limit(0).union(vectors_), str(tmp_path / "v"), "c1")
    assert len(rows(bundle.read_collection(spark, str(tmp_path / "v"), "c1"))) == 1


def test_content(spark):
    from spanloom.operators import content

    pages_ = spark.createDataFrame([(i, f"p{i}") for i in range(1, 9)], "page_no int, t string")
    assert [r["page_no"] for r in rows(content.of_pages(pages_, "2-3,7"))] == [2, 3, 7]
    assert [r["page_no"] for r in rows(content.of_lines(pages_, "7,2", "page_no"))] == [2, 3, 4, 5, 6, 7]
    leaves = spark.createDataFrame([("a", "p"), ("b", "p"), ("c", "p"), ("d", "q"), ("e", "q"), ("p", None), ("q", None)], "chunk_id string, parent_id string")
    hits_ = spark.createDataFrame([("a", 1.0), ("b", 0.5), ("d", 0.25)], "chunk_id string, score double")
    assert {(r["chunk_id"], r["score"]) for r in rows(content.merged_leaves(hits_, leaves))} == {("p", 0.75), ("d", 0.25)}
    df = spark.createDataFrame([('{"a": 1, "text": "x", "c": [{"text": 2, "d": 3}]}',), ("no",), (None,)], "j string")
    assert [r["j"] for r in rows(df.select(content.without_fields(F.col("j"), ("text",)).alias("j")))] == ['{"a": 1, "c": [{"d": 3}]}', None, None]
    versions = spark.createDataFrame([("a", "registered"), ("b", "parsed"), ("c", "complete"), ("d", "failed")], "version_id string, status string")
    after = content.advanced(versions, spark.createDataFrame([("b",), ("c",)], "version_id string"))
    assert {r["version_id"]: r["status"] for r in rows(after)} == {"a": "parsed", "b": "failed", "c": "complete", "d": "failed"}
    assert rows(content.counters(after)) == [{"processed": 1, "failed": 1, "total": 4}]


def test_contracts(spark):
    from spanloom.operators import contracts

    fields = lambda **k: F.map_from_arrays(F.array(*(F.lit(x) for x in k)), F.array(*(F.lit(x) for x in k.values())))
    good = "6be8cbc7-44ce-5f89-a468-5a883a3fcb75"
    assert one(spark, contracts.front_breach(fields(type="note")), contracts.front_breach(fields(title="x")), contracts.front_breach(fields(type="concept", title="t", timestamp="2024-01-02")), contracts.front_breach(fields(type="entity", title="t", timestamp="2024-13-02", canonical_entity_id=good, entity_type="P")))[:3] == [None, "type:missing", None]
    manifest = lambda md, sc: F.to_json(F.struct(F.lit(1).alias("schema_version"), F.lit("a.md").alias("markdown_file"), F.sha2(F.lit(md), 256).alias("markdown_sha256"), F.lit("a.json").alias("sidecar_file"), F.sha2(F.lit(sc), 256).alias("sidecar_sha256"), F.lit("h").alias("canonical_hash")))
    assert one(spark, contracts.manifest_breach(F.lit("m"), F.lit("s"), manifest("m", "s")), contracts.manifest_breach(F.lit("m2"), F.lit("s"), manifest("m", "s")), contracts.manifest_breach(F.lit("m"), F.lit("s"), F.lit("{}"))) == [None, "markdown changed", "manifest has other fields"]


def test_hotspots(spark):
    from spanloom.operators import hotspots

    tree_ = spark.createDataFrame([("r", None), ("p", "r"), ("q", "r"), ("a", "p"), ("b", "p"), ("c", "q")], "node_id string, parent_node_id string")
    vector = spark.createDataFrame([("x", "a", 0.9), ("x", "b", 0.8), ("x", "c", 0.1), ("y", "c", 0.5), ("z", "a", 0.3), ("z", "c", 0.1)], "query_id string, node_id string, similarity double")
    keyword = spark.createDataFrame([("x", "a", 1.0, "t"), ("x", "b", 1.0, "t"), ("y", "c", 1.0, "t"), ("y", "c", 1.0, "u")], "query_id string, node_id string, score double, term string")
    got = {(r["query_id"], r["place"]): (r["node_id"], r["reason"]) for r in rows(hotspots.hybrid(vector, keyword, tree_))}
    assert got == {("x", 1): ("p", "cluster_coverage"), ("y", 1): ("c", "leaf_fallback"), ("z", 1): ("a", "leaf_fallback")}


def test_engine(spark):
    from spanloom.engine import Engine

    spans = spark.createDataFrame([("s1", "the red fox", "a > b", 0, 1, 0), ("s2", "a blue fox", "a > c", 0, 2, 0), ("s3", "green", "a", 0, 3, 0)], "span_id string, raw_text string, heading_path string, start_offset int, doc_id int, ordinal int")
    nodes = spark.createDataFrame([("n1", 1, "a > b", "the red fox")], "node_id string, level_no int, heading_path string, summary_text string")
    vectors_ = spark.createDataFrame([(1, [1.0, 0.0], "east", "e"), (2, [0.0, 1.0], "north", "n")], "vec_id int, embedding array<double>, text string, heading_path string")
    engine = Engine(spans, nodes, vectors_, lambda q: [0.0, 2.0])
    assert [r["key"] for r in rows(engine.query("fox", "keyword"))] == ["s1", "s2"]
    assert [(r["key"], r["ordinal"]) for r in rows(engine.query("what does lie to the north", "auto", 1))] == [("2", 1)]
    top = rows(engine.query("red fox", "hybrid"))[0]
    assert top["text"] == "the red fox" and top["path"] == "keyword,tree" and top["ordinal"] == 1
    assert engine.answer("fox")[:2] == ("keyword", "a blue fox") or engine.answer("fox")[:2] == ("keyword", "the red fox")
    assert engine.answer("nothing", "keyword")[1] == ""
    for bad in (("x", "odd", 5), (" ", "keyword", 5), ("x", "keyword", 0)):
        with pytest.raises(ValueError):
            engine.query(*bad)
    assert Engine(spans).route("what does lie to the north") == "keyword"


def test_ranks_of_few_scores_spread(spark):
    """A list of two scores: no task gets it whole, and ranks have no gap."""
    df = spark.range(4000).select((F.col("id") % 2).alias("score"), F.col("id").alias("ordinal"), F.lit("p").alias("path"))
    got = fuse.ranked(df, "path", [F.desc("score"), F.asc("ordinal")])
    assert [r["rank"] for r in got.orderBy(F.desc("score"), "ordinal").collect()] == list(range(1, 4001))
    parts = df.repartitionByRange(8, "path", F.desc("score"), F.asc("ordinal")).select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(parts) == 8 and max(r["count"] for r in parts) < 1000
    assert fuse.ranked(df.limit(0), "path", [F.desc("score"), F.asc("ordinal")]).count() == 0


def test_segments_are_the_text(spark):
    texts = ["", " ", " \n a  b\tc ", "one", None, "x" * 5000, "é 日本 😀  z\n" * 700, "a b c d", " a b c d e "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc int, text string")
    for size in (1, 2, 128):
        got = {}
        for r in sorted(rows(chunks.exact_segments(df, size, "doc")), key=lambda r: (r["doc"], r["segment"])):
            got.setdefault(r["doc"], []).append(r)
        for i, t in enumerate(texts):
            parts = got.get(i, [])
            assert "".join(r["segment_text"] for r in parts) == (t or "") and bool(parts) == (t is not None)
            assert all((t or "")[r["start"] : r["stop"]] == r["segment_text"] for r in parts)
            assert [r["words"] for r in parts] == [min(size, len(t.split()) - a) for a in range(0, max(len(t.split()), 1), size)] if t is not None else True
    assert chunks.exact_segments(df.limit(0), 3, "doc").count() == 0


def test_texts_stay_where_they_lie(spark):
    """Relations are judged with the whole text before rows are dealt out: no exchange carries it."""
    from spanloom.operators import mapping

    raw = spark.createDataFrame([(1, 0, True, "a knows b", "x a knows b", "a1", "b1", "人名", "人名", "knows"), (1, 1, True, "nowhere", "x", "a1", "b1", "人名", "人名", "knows")], "doc_id int, position int, is_mapping boolean, source_text string, normalized_text string, subject_text string, object_text string, subject_label string, object_label string, relation string")
    mentions = spark.createDataFrame([(1, "a1"), (1, "b1")], "doc_id int, text string")
    schema = spark.createDataFrame([("knows", ["Person"], ["Person"])], "relation string, subjects array<string>, objects array<string>")
    judged = mapping.mapped_relations(raw, mentions, schema)
    assert "normalized_text" in judged.columns and not any(c.startswith("_") for c in judged.columns)
    found = judged.select("position", "rejection")
    assert sorted((r["position"], r["rejection"]) for r in rows(found)) == [(0, "subject_not_in_source"), (1, "source_not_in_normalized_text")]
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert min(i for i, line in enumerate(plan) if "contains(normalized_text" in line.lower()) > max(i for i, line in enumerate(plan) if "Join " in line)


def test_chunk_order_of_a_version_is_dealt_out(spark):
    """Chunks of one version are numbered in order though no task has them all."""
    from spanloom.operators import trees

    spans = spark.range(300).selectExpr("'v' as version_id", "concat('s', id) as span_id", "'h' as heading_path", "id * 7919 % 101 as start_offset", "1 as page_no", "'text' as raw_text")
    chunks = trees.desired_state(spans)[2]
    assert "/ranked-" in str(chunks.inputFiles())
    order = [r["span_id"] for r in sorted(rows(chunks), key=lambda r: r["chunk_order"])]
    assert order == [f"s{i}" for i in sorted(range(300), key=lambda i: (i * 7919 % 101, f"s{i}"))]


def test_manifest_of_one_level(spark):
    """Sixteen groups whatever the number of files, as the query's SQL has them."""
    import hashlib

    from spanloom.operators import hits

    files = spark.range(6000).selectExpr("concat('doc-', id) as path", "sha2(cast(id as string), 256) as sha256")
    sha, groups = lambda t: hashlib.sha256(t.encode()).hexdigest(), {}
    for i in range(6000):
        groups.setdefault(sha(f"doc-{i}")[0], []).append('{"path":"doc-%d","sha256":"%s"}' % (i, sha(str(i))))
    want = sha("\n".join(sha("\n".join(sorted(groups[g]))) for g in sorted(groups)))
    assert rows(hits.manifest_digest(files, ["path"], digits=1)) == [{"files": 6000, "digest": want}]
    assert rows(hits.manifest_digest(files, ["path"]))[0]["digest"] != want
    assert rows(hits.manifest_digest(files.limit(0), ["path"], digits=1)) == rows(hits.manifest_digest(files.limit(0), ["path"]))
