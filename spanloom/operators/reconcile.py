"""Reconciling tables: keyed differences, idempotent sinks, versions, lifecycles, journals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ident
from . import fuse

#: States of a version's processing, in order.
STAGES = ("registered", "parsed", "chunks_created", "embedded", "tree_built", "entities_extracted", "complete")
#: What may follow each state of a proposal ('' is before the first event).
PROPOSAL_STEPS = {"": ("created",), "created": ("approved", "rejected"), "approved": ("merged", "discarded")}


def difference(existing: DataFrame, desired: DataFrame, keys: list[str]) -> DataFrame:
    """keys and op: insert, update, unchanged or delete. Rows are compared by a digest of their
    other columns, so the join carries keys and digests only."""
    others = [c for c in desired.columns if c not in keys]
    mark = lambda df, name: df.select(*keys, F.sha2(F.to_json(F.struct(*others)), 256).alias(name))
    joined = mark(existing, "was").join(mark(desired, "shall"), keys, "full")
    op = F.when(F.col("was").isNull(), "insert").when(F.col("shall").isNull(), "delete").when(F.col("was") == F.col("shall"), "unchanged").otherwise("update")
    return joined.select(*keys, op.alias("op"))


def insert_ignored(existing: DataFrame, rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Rows to append: keys that do not exist yet, the first of each by order."""
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")
    return first.join(existing.select(*keys).distinct(), keys, "left_anti")


def upserted(existing: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The table after the rows replaced those of their keys."""
    return existing.join(rows.select(*keys), keys, "left_anti").unionByName(rows)


def first_by_dedup_key(rows: DataFrame, dedup: str, row_id: str, order: str) -> DataFrame:
    """The first row of each dedup key; a null key stands for the row itself."""
    key = F.coalesce(F.col(dedup).cast("string"), F.concat(F.lit("id:"), F.col(row_id).cast("string")))
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order, row_id))).filter("_n = 1").drop("_n")


def registered(versions: DataFrame, arriving: DataFrame) -> DataFrame:
    """Versions after documents arrived. A known (doc_id, content_hash) changes nothing; a new one
    becomes version max + 1, active, and retires the active one. One arrival for each document."""
    new = arriving.join(versions.select("doc_id", "content_hash"), ["doc_id", "content_hash"], "left_anti")
    last = versions.groupBy("doc_id").agg(F.max("version_no").alias("last"))
    added = new.join(last, "doc_id", "left").select("doc_id", "content_hash", (F.coalesce("last", F.lit(0)) + 1).alias("version_no"), F.lit(True).alias("is_active"))
    retired = versions.join(new.select("doc_id", F.lit(True).alias("hit")), "doc_id", "left").withColumn("is_active", F.col("is_active") & F.col("hit").isNull()).drop("hit")
    return retired.unionByName(added)


def registered_documents(documents: DataFrame, versions: DataFrame, arriving: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, source_uri, title) and versions (doc_id, content_hash, contract, version_no, is_active) after arrivals
    (ordinal, source_uri, title, content_hash, contract) came in their order, as many of one document as there are.

    A document is known by its URI; a new one gets the URI's name-based id. Its title is that of the last arrival, or the file's name without
    its ending where that has none. Content that a document holds under the same contract changes nothing, even where it is retired; each
    other one becomes the next version, active until the one after it. Equal ordinals go by content. Arrivals shrink to contents before
    they meet documents, and `fuse.ranked` numbers them, so a document with very many arrivals falls to no single task."""
    stem = F.regexp_replace(F.element_at(F.split("source_uri", "/"), -1), r"(?<=.)\.[^.]*$", "")
    last = arriving.groupBy("source_uri").agg(F.max_by(F.struct("title"), F.struct("ordinal", "content_hash", "contract"))["title"].alias("arrived"))
    joined = documents.join(last.withColumn("come", F.lit(True)), "source_uri", "full")
    name = F.coalesce(F.nullif("arrived", F.lit("")), stem)
    after = joined.select(F.coalesce("doc_id", ident.uuid5(F.col("source_uri"))).alias("doc_id"), "source_uri", F.when(F.col("come"), name).otherwise(F.col("title")).alias("title"))
    contents = arriving.groupBy("source_uri", "content_hash", "contract").agg(F.min("ordinal").alias("ordinal"))
    own = contents.join(after.select("doc_id", "source_uri"), "source_uri").select("doc_id", "content_hash", "contract", "ordinal")
    new = fuse.ranked(own.join(versions.select("doc_id", "content_hash", "contract"), ["doc_id", "content_hash", "contract"], "left_anti"), "doc_id", [F.asc("ordinal"), F.asc("content_hash"), F.asc("contract")])
    top = versions.groupBy("doc_id").agg(F.max("version_no").alias("top"))
    newest = new.groupBy("doc_id").agg(F.max("rank").alias("newest"))
    added = new.join(top, "doc_id", "left").join(newest, "doc_id").select("doc_id", "content_hash", "contract", (F.coalesce("top", F.lit(0)) + F.col("rank")).alias("version_no"), (F.col("rank") == F.col("newest")).alias("is_active"))
    retired = versions.join(newest, "doc_id", "left").withColumn("is_active", F.col("is_active") & F.col("newest").isNull()).drop("newest")
    return after, retired.unionByName(added)


def activated(versions: DataFrame, version_id: str) -> DataFrame:
    """The named version becomes its document's only active one; other documents stay as they are."""
    docs = versions.filter(F.col("version_id") == version_id).select("doc_id", F.lit(True).alias("touched"))
    joined = versions.join(docs, "doc_id", "left")
    return joined.withColumn("is_active", F.when(F.col("touched"), F.col("version_id") == version_id).otherwise(F.col("is_active"))).drop("touched")


def transition_error(before: Column, after: Column, stages: tuple[str, ...] = STAGES) -> Column:
    """null for a legal step (the next state, or failed from any but failed), else why not."""
    place = lambda c: F.array_position(F.array(*(F.lit(s) for s in stages)), c)
    return (
        F.when(before == "failed", "failed is final").when(after == "failed", None)
        .when((place(before) == 0) | (place(after) == 0), "unknown state").when(place(after) == place(before) + 1, None).otherwise("not the next state")
    )


def checked_transitions(events: DataFrame, key: str, state: str, order: list[str], stages: tuple[str, ...] = STAGES) -> DataFrame:
    """Adds previous and error to each event of a key; the first event may be the first state only."""
    before = F.lag(state).over(Window.partitionBy(key).orderBy(*order))
    error = F.when(before.isNull(), F.when(F.col(state) != stages[0], "does not start at the first state")).otherwise(transition_error(before, F.col(state), stages))
    return events.withColumns({"previous": before, "error": error})


#: Fixed value: longest chain of legal steps of a proposal.
LONGEST_CHAIN = 3


def follows(status: Column, step: Column) -> Column:
    """Whether a step may come after a status ('' before the first)."""
    return _any([(status == state) & step.isin(*nexts) for state, nexts in PROPOSAL_STEPS.items()])


def accepted(events: DataFrame, state: DataFrame, key: str, event: str, order: list[str], same: str | None = None, event_id: str | None = None) -> DataFrame:
    """key, place (struct of `order`), step, id, value: the events that a fold in order accepts, each after the one before.

    An accepted step is the first that may follow the status, so a round finds one for every key by a minimum with partial
    sums, and there are as many rounds as the longest chain has steps; a key with any number of events is never gathered.
    state: key, status, value. An event whose `same` differs from the value (the first accepted one's, where none
    is known) is passed over, and so are rows with a true `known_`."""
    rows = events.select(F.col(key), F.col(event).alias("step"), F.struct(*order).alias("place"), (F.col(event_id) if event_id else F.lit(None).cast("string")).alias("id"), (F.col(same) if same else F.lit(None).cast("string")).alias("same_"), (F.col("known_") if "known_" in events.columns else F.lit(False)).alias("known_"))
    rows = rows.filter("not known_")
    now, out = state.select(key, "status", F.col("value").alias("value_"), F.lit(None).cast(rows.schema["place"].dataType).alias("last")), None
    for _ in range(LONGEST_CHAIN):
        met = rows.join(now, key, "left")
        later = F.col("last").isNull() | (F.col("place") > F.col("last"))
        fits = F.col("value_").isNull() | (F.col("same_") == F.col("value_"))
        first = met.filter(later & fits & follows(F.coalesce("status", F.lit("")), F.col("step"))).groupBy(key).agg(F.min(F.struct("place", "step", "id", F.coalesce("value_", "same_").alias("value"))).alias("x")).select(key, "x.*")
        out = first if out is None else out.unionByName(first)
        moved = first.select(key, F.col("step").alias("s"), F.col("value").alias("v"), "place")
        now = now.join(moved, key, "full").select(key, F.coalesce("s", "status").alias("status"), F.coalesce("v", "value_").alias("value_"), F.coalesce("place", "last").alias("last"))
    return out


def replayed(journal: DataFrame, key: str, event: str, order: str) -> DataFrame:
    """key, status, events, illegal: each key's events folded in order; an illegal one is counted and changes nothing."""
    none = journal.sparkSession.createDataFrame([], f"{key} {dict(journal.dtypes)[key]}, status string, value string")
    steps = accepted(journal, none, key, event, [order]).groupBy(key).agg(F.max_by("step", "place").alias("status"), F.count(F.lit(1)).alias("legal"))
    counts = journal.groupBy(key).agg(F.count(F.lit(1)).cast("int").alias("events"))
    return counts.join(steps, key, "left").select(key, F.coalesce("status", F.lit("")).alias("status"), "events", (F.col("events") - F.coalesce("legal", F.lit(0))).cast("int").alias("illegal"))


def _any(terms: list[Column]) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | t
    return out


def sync_decision(previous: DataFrame, current: DataFrame, key: str = "path", digest: str = "canonical_hash") -> DataFrame:
    """key, decision: synced (new), skipped (same digest), resynced (another digest), deleted (gone)."""
    joined = previous.select(key, F.col(digest).alias("was")).join(current.select(key, F.col(digest).alias("now")), key, "full")
    return joined.select(key, F.when(F.col("was").isNull(), "synced").when(F.col("now").isNull(), "deleted").when(F.col("was") == F.col("now"), "skipped").otherwise("resynced").alias("decision"))


def violations(rows: DataFrame, not_null: list[str] = (), unique: list[list[str]] = (), checks: dict[str, Column] | None = None, refers: list[tuple[str, DataFrame, str]] = ()) -> DataFrame:
    """rule, n: how many rows (for unique: keys) break each rule; rules that hold are left out."""
    found = [rows.filter(F.col(c).isNull()).select(F.lit(f"{c} is null").alias("rule")) for c in not_null]
    found += [rows.groupBy(*k).count().filter("count > 1").select(F.lit(f"{', '.join(k)} repeated").alias("rule")) for k in unique]
    found += [rows.filter(~F.coalesce(c, F.lit(True))).select(F.lit(n).alias("rule")) for n, c in (checks or {}).items()]
    found += [rows.join(t.select(F.col(k).alias(c)).distinct(), c, "left_anti").filter(F.col(c).isNotNull()).select(F.lit(f"{c} unknown").alias("rule")) for c, t, k in refers]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def processed(reports: DataFrame, key: str = "version_id") -> DataFrame:
    """key, status, processed, events: every report (key, ordinal, failed, linked) of a version takes it one stage on, or to
    failed; complete and failed are final, and one version's failure holds no other back. A version is completed only if
    a report so far was linked (to nodes or evidence), else it fails at the gate. Only the first reports of a version
    can move it, as many as there are stages; they are found before the rows are dealt, and the rest is counted."""
    most = len(STAGES) - 1
    w = Window.partitionBy(key).orderBy("ordinal")
    first = reports.withColumn("n_", F.row_number().over(w)).filter(F.col("n_") <= most)
    ok = lambda c: F.coalesce(F.col(c), F.lit(False))
    facts = first.groupBy(key).agg(F.max("n_").alias("seen_"), F.min(F.when(ok("failed"), F.col("n_"))).alias("broke_"), F.max(ok("linked").cast("int")).alias("linked_"))
    gate = F.when((F.col("seen_") == most) & F.col("broke_").isNull() & (F.col("linked_") == 0), most)
    broke = F.coalesce("broke_", gate)
    done = F.coalesce(broke - 1, F.col("seen_")).cast("int")
    status = F.when(broke.isNotNull(), "failed").otherwise(F.element_at(F.array(*(F.lit(s) for s in STAGES)), done + 1))
    counts = reports.groupBy(key).agg(F.count(F.lit(1)).cast("int").alias("events"))
    return facts.join(counts, key).select(key, status.alias("status"), done.alias("processed"), "events")
