"""Search by postings against a scan of all rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from spanloom.engine import Engine
from spanloom.operators import retrieve
from spanloom.sources import postings, store

SCHEMA = "span_id string, doc_id int, ordinal int, start_offset int, heading_path string, raw_text string"
QUERIES = ["red fish", "ed fi", "fish", "is", 'fish or "blue car" -red', "-red", '"blue car"', "b%e", "no_e", "(red) fish", "%", "...", "zebra", "RED Fish", "ÉTÉ été", "red or", '""', "fish fish", "été", "the red fish swims", 'zebra or "the red"', "re-d", "漢字 car"]


def texts(n, seed):
    r = random.Random(seed)
    words = ["red", "fish", "blue", "car", "the", "swims", "b-e", "none", "no_e", "Été", "ÉTÉ", "fishes", "漢字", "re-d", "(red)", "İs"]
    return [(f"{seed}-{i}", i, 0, 0, "h", " ".join(r.choice(words) for _ in range(r.randint(0, 5)))) for i in range(n)] + [(f"{seed}-null", n, 0, 0, "h", None)]


@pytest.fixture(scope="module")
def built(spark):
    rows = spark.createDataFrame(texts(120, 1) + texts(90, 2), SCHEMA)
    index = postings.Index(spark, store.new_folder(spark, "postings"), buckets=8, slices=8)
    with pytest.raises(ValueError, match="no segment"):
        index.opened()
    assert index.add(rows.filter("span_id like '1-%'"), "one")
    before = index.opened()
    assert index.add(rows.filter("span_id like '2-%'"), "two") and index.add(rows.limit(0), "nothing")
    assert not index.add(rows, "one")  # committed: nothing is written
    return rows, index, before


@pytest.mark.parametrize("query", QUERIES)
def test_as_a_scan(spark, built, query):
    rows, index, _ = built
    want = sorted(r["span_id"] for r in rows.filter(retrieve.matches(F.col("raw_text"), query)).collect())
    assert sorted(r["span_id"] for r in index.opened().matches(query).select("span_id").collect()) == want


def test_order_engine_and_older_readers(spark, built):
    rows, index, before = built
    want = [(r["span_id"], r["score"]) for r in retrieve.keyword_search(rows, "red fish", 7).collect()]
    assert [r["score"] for r in index.opened().search("red fish", 7).collect()] == [s for _, s in want]
    hits = Engine(rows, index=index.opened()).query("red fish", "keyword", 5)
    assert {r["key"] for r in hits.collect()} == {r["key"] for r in Engine(rows).query("red fish", "keyword", 5).collect()}
    assert before.rows().count() == 121 and index.opened().rows().count() == 212


def test_reads_grow_with_the_terms_only(spark, built):
    _, index, _ = built
    reader = index.opened()
    known = reader.frequencies(["swims", "zebra"])
    assert known["zebra"][1] == 0 and known["swims"][1] > 0
    opened = reader.postings({"swims": known["swims"][0]}).select(F.input_file_name().alias("f")).distinct().collect()
    assert {r["f"].split("bucket=")[1].split("/")[0] for r in opened} == {str(known["swims"][0])}
    plan = reader.matches("the swims now")._jdf.queryExecution().executedPlan().toString()
    filters = re.findall(r"PartitionFilters: \[([^\n]*)", plan)
    assert any("bucket#" in f for f in filters) and any("slice#" in f and "dynamicpruning" in f for f in filters)


def test_a_lost_writer_and_other_columns(spark, built, monkeypatch):
    rows, index, _ = built
    count = index.opened().rows().count()
    with monkeypatch.context() as m:
        m.setattr(store, "put", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            index.add(rows.withColumn("span_id", F.concat(F.lit("3-"), "span_id")), "three")
    assert index.opened().rows().count() == count and "three" not in index.segments()
    with pytest.raises(ValueError, match="other columns"):
        index.add(rows.withColumn("more", F.lit(1)), "four")
    with pytest.raises(ValueError, match="name"):
        index.add(rows, "../five")
