"""Reconciling tables by generations, and ordered folds as batch and stream."""

import pytest
from pyspark.sql import functions as F

from spanloom.operators import contracts, reconcile
from spanloom.sources import generations, store
from spanloom.sources.generations import Table
from spanloom.streaming import lifecycle

TABLES = [Table("links", ["id"], {"node": ("nodes", "node")}, 4), Table("nodes", ["node"], {}, 4)]


def frames(spark, nodes, links):
    return {"nodes": spark.createDataFrame(nodes, "node int, title string"), "links": spark.createDataFrame(links, "id int, node int, text string")}


def outcomes(counts):
    return {(r["table_name"], r["outcome"]): r["rows"] for r in counts.collect()}


def content(spark, root, want):
    return {name: sorted(map(tuple, generations.read(spark, root, name, want[name].schema).collect())) for name in ("nodes", "links")}


def test_generations(spark):
    root = store.new_folder(spark, "generations")
    first = frames(spark, [(i, "t") for i in range(20)], [(i, i % 25, None) for i in range(50)] + [(99, None, "free")])
    number, counts = generations.reconcile(spark, root, TABLES, first)
    assert number == 1 and outcomes(counts) == {("nodes", "insert"): 20, ("links", "insert"): 41, ("links", "blocked"): 10}
    files = store.names(spark, f"{root}/data")
    number, counts = generations.reconcile(spark, root, TABLES, first)
    assert number == 1 and store.names(spark, f"{root}/data") == files and outcomes(counts) == {("nodes", "equal"): 20, ("links", "equal"): 41, ("links", "blocked"): 10}
    second = frames(spark, [(i, "u" if i == 3 else "t") for i in range(19)], [(i, i % 25, "x" if i == 7 else None) for i in range(50)])
    before = content(spark, root, first)
    for lost in ("nodes", "links"):  # a writer lost after any table leaves the generation readable

        def crash(name, lost=lost):
            if name == lost:
                raise OSError("lost")

        with pytest.raises(OSError):
            generations.reconcile(spark, root, TABLES, second, before_commit=crash)
        assert generations.last(spark, root)[0] == 1 and content(spark, root, first) == before
    number, counts = generations.reconcile(spark, root, TABLES, second)
    got = outcomes(counts)
    assert number == 2 and got == {("nodes", "equal"): 18, ("nodes", "update"): 1, ("nodes", "delete"): 1, ("links", "equal"): 37, ("links", "update"): 1, ("links", "delete"): 1, ("links", "blocked"): 12}
    now = content(spark, root, second)
    assert now["nodes"] == sorted((i, "u" if i == 3 else "t") for i in range(19))
    assert now["links"] == sorted((i, i % 25, "x" if i == 7 else None) for i in range(50) if i % 25 < 19)
    assert generations.reconcile(spark, root, TABLES, second)[0] == 2


def test_held_rows_conflicts_and_bad_input(spark):
    root = store.new_folder(spark, "generations")
    one = frames(spark, [(1, "a"), (2, "b")], [(1, 1, "x")])
    generations.reconcile(spark, root, TABLES, one)
    held = {"nodes": spark.createDataFrame([(1,), (2,)], "node int")}
    _, counts = generations.reconcile(spark, root, TABLES, frames(spark, [(1, "changed")], [(1, 1, "x")]), held)
    assert outcomes(counts) == {("nodes", "blocked"): 2, ("links", "equal"): 1} and content(spark, root, one)["nodes"] == [(1, "a"), (2, "b")]

    def other(name):
        store.put(spark, f"{root}/commits/00000002.json", "{}")

    with pytest.raises(generations.Conflict):
        generations.reconcile(spark, root, TABLES, frames(spark, [(1, "z")], []), before_commit=other)
    for bad in ([(1, "a"), (1, "b")], [(None, "a")]):
        with pytest.raises(ValueError):
            generations.reconcile(spark, store.new_folder(spark, "g"), TABLES, frames(spark, bad, []))
    with pytest.raises(ValueError):
        generations.in_order([Table("a", ["k"], {"x": ("b", "k")}), Table("b", ["k"], {"y": ("a", "k")})])
    assert not store.put(spark, f"{root}/commits/00000002.json", "again")


def test_several_events_of_a_proposal_in_one_batch(spark):
    schema = "proposal_id string, event_type string, event_id string, payload_digest string, ordinal bigint"
    batch = [("p", "created", "1", "d", 1), ("p", "merged", "2", "d", 2), ("p", "approved", "3", "d", 3), ("p", "approved", "3", "d", 4), ("p", "merged", "5", "e", 5), ("p", "merged", "6", "d", 6), ("p", "discarded", "7", "d", 7), ("q", "approved", "8", "d", 8), ("r", "rejected", "9", "d", 9), ("r", "approved", "10", "d", 10), ("r", "created", "0", "d", 11)]
    journal = [("r", "created", "0", "d", 0)]
    want = ["appended", "illegal step", "appended", "duplicate", "payload changed", "appended", "illegal step", "illegal step", "appended", "illegal step", "duplicate"]
    got = contracts.appended(spark.createDataFrame(journal, schema), spark.createDataFrame(batch, schema).repartition(3)).orderBy("ordinal").collect()
    assert [r["outcome"] for r in got] == want
    assert contracts.appended(spark.createDataFrame([], schema), spark.createDataFrame([], schema)).count() == 0


def streamed(spark, rows, plan, keys, cuts, mode):
    """Rows as files that arrive one after another; the query stops after each and starts again from its state."""
    folder = store.new_folder(spark, "arrivals")
    for part in cuts:
        rows.filter(part).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        out = f"{folder}/out"

        def write(df, batch):
            df.withColumn("batch_", F.lit(batch)).write.mode("overwrite").parquet(f"{out}/batch={batch}")

        source = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
        plan(source).writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    found = spark.read.parquet(out).drop("batch")
    names = [c for c in found.columns if c != "batch_"]
    return sorted(map(tuple, found.groupBy(*keys).agg(F.max_by(F.struct(*names), "batch_").alias("r")).select("r.*").collect()))


def test_stages_stop_and_start(spark):
    rows = [(v, n, v % 5 == 2 and n == v % 4, v % 3 == 0 and n == 2) for v in range(30) for n in range(v % 9)] + [(100, n, False, n == 9) for n in range(12)] + [(101, 0, None, None)]
    reports = spark.createDataFrame(rows, "version_id bigint, ordinal bigint, failed boolean, linked boolean")
    batch = sorted(map(tuple, reconcile.processed(reports.repartition(3)).collect()))
    assert batch == streamed(spark, reports.fillna(False), lifecycle.processed, ["version_id"], ["ordinal < 3", "ordinal >= 3 and ordinal < 6", "ordinal >= 6"], "update")
    by_id = {r[0]: r[1:] for r in batch}
    assert by_id[100] == ("failed", 5, 12) and by_id[101] == ("parsed", 1, 1) and {s for s, _, _ in by_id.values()} >= {"failed", "complete", "parsed"}
    assert reconcile.processed(reports.limit(0)).count() == 0


def test_verdicts_stop_and_start(spark):
    kinds = ["created", "approved", "merged", "rejected", "discarded"]
    rows = [(str(p), n, kinds[(p * 7 + n * n) % 5], f"{p}-{kinds[(p * 7 + n * n) % 5]}-{n % 2}", "d" if n % 4 else "e") for p in range(12) for n in range(10)]
    events = spark.createDataFrame(rows, "proposal_id string, ordinal bigint, event_type string, event_id string, payload_digest string")
    batch = sorted((r["proposal_id"], r["ordinal"], r["event_type"], r["outcome"]) for r in contracts.appended(events.limit(0), events).collect())
    assert batch == streamed(spark, events, lifecycle.judged, ["proposal_id", "ordinal"], ["ordinal < 4", "ordinal >= 4"], "append")


def test_keys_share_a_group(spark, monkeypatch):
    """Python is called for a group of keys; each key keeps a state of its own, a null key too."""
    monkeypatch.setattr(lifecycle, "GROUPS", 2)
    rows = [(None if v == 9 else v, n, v == 3 and n == 4, n == 1) for v in range(10) for n in range(v)]
    reports = spark.createDataFrame(rows, "version_id bigint, ordinal bigint, failed boolean, linked boolean")
    frames = streamed(spark, reports.filter("version_id is not null"), lifecycle.processed, ["version_id"], ["ordinal < 3", "ordinal >= 3 and ordinal < 5", "ordinal >= 5"], "update")
    assert frames == sorted(map(tuple, reconcile.processed(reports.filter("version_id is not null")).collect()))
    alone = streamed(spark, reports.filter("version_id is null"), lifecycle.processed, ["version_id"], ["ordinal < 3", "ordinal >= 3"], "update")
    assert alone == [(None, "complete", 6, 9)]
