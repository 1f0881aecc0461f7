"""Mentions and entities: normal forms, codes, coreference, merge decisions, links."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..functions import text

#: Letters of unified social credit codes, in order of their values.
CODE_LETTERS = "0123456789ABCDEFGHJKLMNPQRTUWXY"


def normal_name(column: Column) -> Column:
    """Compatibility form without zero-width characters, collapsed, case-folded; pandas, as the engine has no such forms."""
    import unicodedata

    @F.pandas_udf(StringType())
    def of(values: pd.Series) -> pd.Series:
        drop = dict.fromkeys((0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF))
        return values.map(lambda v: " ".join(unicodedata.normalize("NFKC", v).translate(drop).split()).casefold(), na_action="ignore")

    return of(column)


def code_is_valid(code: Column) -> Column:
    """Whether 18 letters end with their check letter: weights 3**i modulo 31."""
    value = lambda c: F.instr(F.lit(CODE_LETTERS), c) - 1
    total = F.lit(0)
    for i in range(17):
        total = total + value(F.substr(code, F.lit(i + 1), F.lit(1))) * (3**i % 31)
    return (F.length(code) == 18) & code.rlike(f"^[{CODE_LETTERS}]{{18}}$") & (value(F.substr(code, F.lit(18), F.lit(1))) == (31 - total % 31) % 31)


def codes_in(column: Column) -> Column:
    """All valid codes in a text, overlapping ones too."""
    up = F.upper(F.coalesce(column, F.lit("")))
    starts = F.sequence(F.lit(1), F.greatest(F.length(up) - 17, F.lit(1)))
    return F.array_distinct(F.filter(F.transform(starts, lambda i: F.substr(up, i, F.lit(18))), code_is_valid))


def coreference(mentions: DataFrame, keys: list[str], member: str) -> DataFrame:
    """Mentions in clusters of equal keys, two at least, a row a member with n, the cluster's size: a
    cluster may be of any size, so none is an array. A repeated member is an error in the data."""
    once = mentions.groupBy(*keys, member).agg(F.count(F.lit(1)).alias("times"))
    checked = F.when(F.max("times") > 1, F.raise_error(F.lit("a mention is twice in a cluster")).cast("bigint")).otherwise(F.count(F.lit(1)))
    sizes = once.groupBy(*keys).agg(checked.alias("n")).filter("n >= 2")
    return mentions.select(*keys, member).join(sizes, keys)


def tombstoned(clusters: DataFrame, cluster_ids: list[str], key: str = "cluster_id") -> DataFrame:
    """The named clusters flagged, all rows kept; an unknown id raises. The ids are a caller's few."""
    named = F.col(key).isin(*cluster_ids) if cluster_ids else F.lit(False)
    found = {r[0] for r in clusters.filter(named).select(key).distinct().collect()}  # at most the ids asked for
    if missing := sorted(set(cluster_ids) - found):
        raise KeyError(f"unknown clusters: {missing}")
    return clusters.withColumn("tombstoned", F.coalesce(F.col("tombstoned"), F.lit(False)) | named)


def winners(mentions: DataFrame, occurrence: list[str]) -> DataFrame:
    """One mention for each occurrence: the best confidence, then the smallest id."""
    w = Window.partitionBy(*occurrence).orderBy(F.desc_nulls_last("confidence"), "mention_id")
    return mentions.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def merge_decision(same_type: Column, left_code: Column, right_code: Column, same_name: Column) -> Column:
    """Vetoes first (types, codes that differ), then equal codes, then equal names, else deferred."""
    both = left_code.isNotNull() & right_code.isNotNull()
    return F.when(~same_type, "veto_type").when(both & (left_code != right_code), "veto_code").when(both, "merge_code").when(same_name, "merge_name").otherwise("deferred")


def merge_links(identities: DataFrame) -> DataFrame:
    """left_id, right_id, decision: every identity (identity_id, entity_type, code, name) against the least
    one of its code and, without a code of its own, the least one of its name. A row an identity and
    block, not a pair of any two; blocks are summed up before the join, so none is one group."""
    first = lambda block: identities.filter(F.col(block).isNotNull()).groupBy(block).agg(F.min(F.struct("identity_id", "entity_type", F.col("code").alias("c"), F.col("name").alias("n"))).alias("left"))
    by_code = identities.join(first("code"), "code")
    by_name = identities.filter("code is null").join(first("name"), "name")
    columns = ["left", "identity_id", "entity_type", "code", "name"]
    linked = by_code.select(*columns).unionByName(by_name.select(*columns)).filter(F.col("left.identity_id") != F.col("identity_id"))
    decision = merge_decision(F.col("left.entity_type") == F.col("entity_type"), F.col("left.c"), F.col("code"), F.col("left.n") == F.col("name"))
    return linked.select(F.col("left.identity_id").alias("left_id"), F.col("identity_id").alias("right_id"), decision.alias("decision"))


def basket(pairs: DataFrame, auto: float = 0.95, review: float = 0.87) -> DataFrame:
    """Pairs that a person must judge, as pending items."""
    return pairs.withColumn("triage", triage(F.col("score"), auto, review)).filter("triage = 'REVIEW'").withColumn("status", F.lit("pending"))


def adjudicated(items: DataFrame, verdicts: DataFrame, key: str = "item_id") -> DataFrame:
    """Items (key, status) after verdicts (key, verdict: accepted or rejected); outcome says what became
    of each verdict: applied, unknown item, invalid verdict, already adjudicated, repeated (a second verdict
    in the batch; the first by `ordinal` counts). Items are never dropped."""
    w = Window.partitionBy(key).orderBy("ordinal")
    joined = items.select(key, "status").join(verdicts.withColumn("_n", F.row_number().over(w)), key, "full")
    outcome = (
        F.when(F.col("verdict").isNull(), None).when(F.col("status").isNull(), "unknown item").when(~F.col("verdict").isin("accepted", "rejected"), "invalid verdict")
        .when(F.col("status") != "pending", "already adjudicated").when(F.col("_n") > 1, "repeated").otherwise("applied")
    )
    return joined.withColumn("outcome", outcome).withColumn("status", F.when(F.col("outcome") == "applied", F.col("verdict")).otherwise(F.col("status"))).drop("_n", "verdict")


def triage(score: Column, auto: float = 0.95, review: float = 0.87) -> Column:
    return F.when(score >= auto, "AUTO").when(score >= review, "REVIEW").otherwise("NEW")


#: Routes of a batch after its trial.
ROUTES = ("pure_uie", "llm_then_uie", "llm_primary_uie_assist")


def trial_route(coverage: Column, similar: Column, samples: Column) -> Column:
    """The route of a batch: by likeness of its samples and coverage; null for fewer than three samples."""
    return F.when(samples < 3, None).when(~similar, ROUTES[2]).when(coverage >= 0.90, ROUTES[0]).otherwise(ROUTES[1])


#: Texts whose tokens are held at a time; most names that are sent to every executor.
TEXTS, BROADCAST = 64, 200_000


def token_rows(texts: DataFrame, key: str, column: str) -> DataFrame:
    """key, name, start: runs of letters and digits, lower-case, with their places; the engine has no function for the places of
    all matches. A few texts at a time become rows of Arrow columns, so a worker holds their tokens and no others."""
    word, schema = re.compile(r"[^\W_]+"), StructType([texts.schema[key], StructField("name", StringType()), StructField("start", IntegerType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(0, batch.num_rows, TEXTS):
                few = batch.slice(n, TEXTS)
                owners, names, starts = [], [], []
                for i, text_ in enumerate(few.column(1)):
                    for m in word.finditer(text_.as_py() or ""):
                        owners.append(i)
                        names.append(m[0].lower())
                        starts.append(m.start())
                if owners:
                    yield pa.RecordBatch.from_arrays([few.column(0).take(pa.array(owners)), pa.array(names, pa.string()), pa.array(starts, pa.int32())], names=schema.names)

    return texts.select(key, column).mapInArrow(cut, schema)


def dictionary_candidates(texts: DataFrame, names: DataFrame, key: str, column: str) -> DataFrame:
    """key, name, entity_type, start: every place where a token of a text is a one-token name (in lower case).
    Few names are sent to the tokens, so that a very common one falls to no single task; more are joined by merge."""
    found = token_rows(texts, key, column)
    return found.join(F.broadcast(names), "name") if names.count() <= BROADCAST else found.hint("merge").join(names, "name")


def exact_slices(candidates: DataFrame, texts: DataFrame, key: str, column: str, mention: str = "mention") -> DataFrame:
    """Candidates with given places whose mention stands there exactly, as whole words; others are dropped."""
    joined = candidates.join(texts.select(key, column), key)
    stop = F.col("start") + F.length(mention)
    before = F.when(F.col("start") > 0, F.substr(column, F.col("start"), F.lit(1))).otherwise("")
    inner = (before.rlike(r"[\p{L}\p{N}]") & F.col(mention).rlike(r"^[\p{L}\p{N}]")) | (F.substr(column, stop + 1, F.lit(1)).rlike(r"[\p{L}\p{N}]") & F.col(mention).rlike(r"[\p{L}\p{N}]$"))
    return joined.filter((F.substr(column, F.col("start") + 1, F.length(mention)) == F.col(mention)) & ~inner).drop(column)


def linked_nodes(mentions: DataFrame, node_spans: DataFrame, ledger: DataFrame, version_id: str) -> DataFrame:
    """node_id, entity_id, mention_text, action for a version's mentions: `claim` new pairs, `rewrite` its own,
    `preserve` pairs that nobody or another version owns. The mention of the smallest id gives the text."""
    pairs = mentions.join(node_spans, "span_id").groupBy("node_id", "entity_id").agg(F.min(F.struct("mention_id", "mention_text"))["mention_text"].alias("mention_text"))
    owners = ledger.groupBy("node_id", "entity_id").agg(F.array_sort(F.collect_set("owner_version")).alias("owners"))
    own = F.col("owners") == F.array(F.lit(version_id))
    return pairs.join(owners, ["node_id", "entity_id"], "left").withColumn("action", F.when(F.col("owners").isNull(), "claim").when(own, "rewrite").otherwise("preserve")).drop("owners")
