"""Several tables that change together: desired rows are reconciled into a new generation, and one file commits it.

A folder holds data written once under names of their own, and commits/<number>.json, which names for each table and
bucket of keys the folder that holds it. A commit file appears whole or not at all, so a writer lost between any two
tables leaves the generation before it as it was; of two writers of one number the second is refused. Buckets
without a change are not written again, and a run that changes nothing writes nothing."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store


@dataclass(frozen=True)
class Table:
    """keys: what tells rows apart, never null. refers: column to (table, its key); null refers to nothing."""

    name: str
    keys: list[str]
    refers: dict[str, tuple[str, str]] = field(default_factory=dict)
    buckets: int = 32


class Conflict(RuntimeError):
    """Another writer committed the number first."""


def in_order(tables: list[Table]) -> list[Table]:
    """Tables after all that they refer to."""
    left, out = {t.name: t for t in tables}, []
    while left:
        ready = [t for t in left.values() if not any(to in left and to != t.name for to, _ in t.refers.values())]
        if not ready:
            raise ValueError(f"references go round: {sorted(left)}")
        out += ready
        for t in ready:
            del left[t.name]
    return out


def last(spark: SparkSession, root: str) -> tuple[int, dict]:
    """Number and content of the last commit; 0 and nothing where there is none."""
    found = [n for n in store.names(spark, f"{root}/commits") if n.endswith(".json")]
    if not found:
        return 0, {}
    text = spark.read.option("wholetext", True).text(f"{root}/commits/{found[-1]}").first()[0]
    return int(found[-1].removesuffix(".json")), json.loads(text)


def read(spark: SparkSession, root: str, name: str, schema) -> DataFrame:
    """A table as the last commit has it; without rows where it is not there yet."""
    return _of(spark, last(spark, root)[1].get(name, {}), schema)


def _of(spark: SparkSession, folders: dict, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(*sorted(folders.values())) if folders else spark.createDataFrame([], schema).limit(0)  # known to be empty before it runs, so joins with it go


def _digest(columns: list[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def outcomes(existing: DataFrame, desired: DataFrame, table: Table, parents: dict[str, DataFrame], held: DataFrame | None) -> DataFrame:
    """keys, outcome, now (the row that shall stand, null where none), bucket. insert, update, equal or delete; blocked where
    the row is held (its keys stand in `held`) and would change, or where it refers to a row that its table will not
    have. What is blocked stays as it was, unless its own reference is gone as well."""
    columns = desired.columns
    pack = lambda df, name: df.select(*table.keys, F.struct(*columns).alias(name), _digest(columns).alias(f"{name}_digest"))
    rows = pack(existing, "old").join(pack(desired, "new"), table.keys, "full")
    for side in ("old", "new"):
        rows = rows.withColumn(f"{side}_ok", F.lit(True))
        for column, (to, key) in table.refers.items():
            there = parents[to].select(F.col(key).alias("there_")).distinct()
            rows = rows.join(there, F.col(f"{side}.{column}") == F.col("there_"), "left")
            rows = rows.withColumn(f"{side}_ok", F.col(f"{side}_ok") & (F.col(f"{side}.{column}").isNull() | F.col("there_").isNotNull())).drop("there_")
    if held is None:
        rows = rows.withColumn("held_", F.lit(False))
    else:
        rows = rows.join(held.select(*table.keys).distinct().withColumn("h_", F.lit(True)), table.keys, "left").withColumn("held_", F.col("h_").isNotNull()).drop("h_")
    same = F.coalesce(F.col("old_digest") == F.col("new_digest"), F.lit(False))
    change = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete").when(same, "equal").otherwise("update")
    blocked = (F.col("held_") & ~same) | (F.col("new").isNotNull() & ~F.col("new_ok"))
    outcome = F.when(blocked, "blocked").otherwise(change)
    stays = F.when(F.col("old_ok"), F.col("old"))
    bucket = F.pmod(F.xxhash64(*table.keys), F.lit(table.buckets)).cast("int")
    now = F.when(blocked, stays).otherwise(F.col("new"))
    moved = F.when(blocked, F.col("old").isNotNull() & ~F.col("old_ok")).otherwise(~same)
    return rows.select(*table.keys, outcome.alias("outcome"), now.alias("now"), moved.alias("moved"), bucket.alias("bucket"))


def reconcile(spark: SparkSession, root: str, tables: list[Table], desired: dict[str, DataFrame], held: dict[str, DataFrame] | None = None, before_commit=None) -> tuple[int, DataFrame]:
    """Bring all tables to their desired rows: the generation that then stands, and table_name, outcome, rows.

    Guards and differences are found for all tables first, those that others refer to before them; then the changed
    buckets are written, and the commit file last. before_commit: called with each table's name once it is written."""
    number, commit = last(spark, root)
    parents, found, counts = {}, {}, None
    for table in in_order(tables):
        want = desired[table.name]
        rows = outcomes(_of(spark, commit.get(table.name, {}), want.schema), want, table, parents, (held or {}).get(table.name))
        found[table.name] = store.staged(rows, "outcomes")
        repeated = found[table.name].groupBy(*table.keys).count().filter("count > 1" + "".join(f" or {k} is null" for k in table.keys))
        if not repeated.isEmpty():
            raise ValueError(f"{table.name}: keys are null or repeated")
        parents[table.name] = found[table.name].filter("now is not null").select("now.*")
        part = found[table.name].groupBy("outcome").agg(F.count(F.lit(1)).alias("rows")).select(F.lit(table.name).alias("table_name"), "outcome", "rows")
        counts = part if counts is None else counts.unionByName(part)
    new, place = {t.name: dict(commit.get(t.name, {})) for t in tables}, f"{root}/data/{number + 1:08d}-{uuid.uuid4().hex}"
    for table in in_order(tables):
        rows = found[table.name]
        touched = [r[0] for r in rows.filter("moved").select("bucket").distinct().collect()]  # as many as buckets at most
        if touched:
            rows.filter(F.col("bucket").isin(touched) & F.col("now").isNotNull()).select("now.*", "bucket").withColumnRenamed("bucket", "bucket_").repartition("bucket_").write.partitionBy("bucket_").parquet(f"{place}/{table.name}")
            written = store.names(spark, f"{place}/{table.name}")
            for b in touched:
                new[table.name].pop(str(b), None)
                if f"bucket_={b}" in written:
                    new[table.name][str(b)] = f"{place}/{table.name}/bucket_={b}"
        if before_commit is not None:
            before_commit(table.name)
    if new == {t.name: dict(commit.get(t.name, {})) for t in tables}:
        return number, counts
    if not store.put(spark, f"{root}/commits/{number + 1:08d}.json", json.dumps(commit | new, sort_keys=True)):
        raise Conflict(f"generation {number + 1} was committed by another writer")
    return number + 1, counts
