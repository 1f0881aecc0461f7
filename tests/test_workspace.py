"""Workspaces of documents, and documents registered by several arrivals, against plain Python."""

import json

import pytest

from spanloom.functions import ident
from spanloom.operators import reconcile
from spanloom.sources import workspace


@pytest.fixture
def place(spark, tmp_path):
    docs = spark.createDataFrame([("a", "A", None, "pdf", None), ("b", "B", "text", "md", None), ("c", "C", None, "pdf", None)], workspace.DOCUMENTS)
    nodes = [("a", "1", None, 0, 'top "1"', 1), ("a", "2", "1", 1, "late", 3), ("a", "3", "1", 1, None, 2), ("a", "4", "3", 2, "deep", 2), ("b", "1", None, 0, "x", 5), ("b", "2", None, 0, "y", 2), ("nobody", "1", None, 0, "z", 1)]
    content = [("a", i, f"p{i}") for i in range(1, 6)] + [("b", i, None if i == 2 else f"l{i}") for i in range(1, 8)]
    own = workspace.Workspace(spark, f"file://{tmp_path}/w")
    frames = docs, spark.createDataFrame(nodes, workspace.NODES), spark.createDataFrame(content, workspace.CONTENT)
    return own, frames, own.index(*frames)


def answers(df, *keys):
    return {tuple(r[k] for k in keys): json.loads(r["json"]) for r in df.collect()}


def test_tools(spark, place):
    own, _, (number, counts) = place
    assert number == 1
    assert {(r.table_name, r.outcome): r.rows for r in counts.collect()} == {("documents", "insert"): 3, ("nodes", "insert"): 6, ("nodes", "blocked"): 1, ("content", "insert"): 12}
    ids = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("a",)], "doc_id string")
    got = answers(own.documents(ids), "doc_id")
    assert got[("a",)] == {"doc_id": "a", "doc_name": "A", "doc_description": "", "type": "pdf", "status": "completed", "page_count": 5}
    assert got[("b",)]["line_count"] == 7 and got[("c",)]["page_count"] == 0 and got[("d",)] == {"error": "Document d not found"}
    leaf = lambda n, t, s, *nodes: {"title": t, "node_id": n, "start": s, "nodes": list(nodes)}
    assert answers(own.structures(ids), "doc_id") == {
        ("a",): [leaf("1", 'top "1"', 1, leaf("3", "", 2, leaf("4", "deep", 2)), leaf("2", "late", 3))], ("b",): [leaf("2", "y", 2), leaf("1", "x", 5)], ("c",): [], ("d",): {"error": "Document d not found"},
    }


def test_contents(spark, place):
    own = place[0]
    asked = [("a", "2-3"), ("a", "5, 1,1-2"), ("a", "9"), ("a", "3-2"), ("a", "x"), ("a", ""), ("a", None), ("a", "1-99999999999"), ("a", "1-2000000000"), ("b", "4,2"), ("d", "1")]
    got = answers(own.contents(spark.createDataFrame(asked, "doc_id string, pages string")), "doc_id", "pages")
    pages = lambda d, p: [x["page"] for x in got[(d, p)]]
    assert got[("a", "2-3")] == [{"page": 2, "content": "p2"}, {"page": 3, "content": "p3"}]
    assert pages("a", "5, 1,1-2") == [1, 2, 5] and pages("a", "9") == [] and pages("a", "1-2000000000") == [1, 2, 3, 4, 5]
    assert got[("b", "4,2")] == [{"page": 2, "content": ""}, {"page": 3, "content": "l3"}, {"page": 4, "content": "l4"}]
    assert all("error" in got[("a", p)] for p in ("3-2", "x", "", "1-99999999999")) and "error" in got[("d", "1")]


def test_changes(spark, place):
    own, frames, _ = place
    assert own.index(*frames)[0] == 1  # nothing changed, nothing written
    one = spark.createDataFrame([("a", "A2", None, "md", None)], workspace.DOCUMENTS)
    none = lambda schema: spark.createDataFrame([], schema)
    assert own.index(one, none(workspace.NODES), none(workspace.CONTENT))[0] == 2
    assert sorted((r.doc_id, r.doc_name) for r in own.read("documents").collect()) == [("a", "A2"), ("b", "B"), ("c", "C")]
    assert {r.doc_id for r in own.read("content").collect()} == {"b"}
    own.remove(spark.createDataFrame([("b",), ("nobody",)], "doc_id string"))
    assert own.read("nodes").count() == 0 and own.read("documents").count() == 2
    with pytest.raises(ValueError, match="unsupported type"):
        own.index(spark.createDataFrame([("q", "Q", None, "exe", None)], workspace.DOCUMENTS), none(workspace.NODES), none(workspace.CONTENT))


def test_registered_documents(spark):
    known = str(__import__("uuid").uuid4())
    documents = spark.createDataFrame([(known, "f:/k.txt", "old"), ("other", "f:/o.txt", "kept")], "doc_id string, source_uri string, title string")
    versions = spark.createDataFrame([(known, "h1", "c", 1, False), (known, "h2", "c", 2, True), ("other", "h1", "c", 1, True)], "doc_id string, content_hash string, contract string, version_no int, is_active boolean")
    arrive = "ordinal int, source_uri string, title string, content_hash string, contract string"
    rows = [(1, "f:/k.txt", "T", "h1", "c"), (2, "f:/n.tar.gz", None, "a", "c"), (3, "f:/n.tar.gz", "", "b", "c"), (4, "f:/n.tar.gz", None, "a", "c"), (5, "f:/n.tar.gz", None, "a", "d")]
    docs, vers = reconcile.registered_documents(documents, versions, spark.createDataFrame(rows, arrive))
    new = spark.range(1).select(ident.uuid5(__import__("pyspark").sql.functions.lit("f:/n.tar.gz"))).first()[0]
    assert {(r.doc_id, r.title) for r in docs.collect()} == {(known, "T"), ("other", "kept"), (new, "n.tar")}
    assert {tuple(r) for r in vers.collect()} == {
        (known, "h1", "c", 1, False), (known, "h2", "c", 2, True), ("other", "h1", "c", 1, True), (new, "a", "c", 1, False), (new, "b", "c", 2, False), (new, "a", "d", 3, True),
    }
    docs, vers = reconcile.registered_documents(docs, vers, spark.createDataFrame([(6, "f:/k.txt", None, "h3", "c")], arrive))
    assert {(r.version_no, r.is_active) for r in vers.collect() if r.doc_id == known} == {(1, False), (2, False), (3, True)}
