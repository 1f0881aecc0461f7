"""Links between nodes and entities that versions own: proof, collisions, outcomes of a run over many versions, new state.

mentions: mention_id, version_id, entity_id (null: unresolved), span_id, mention_text, one row an id. held: the same with owner (the
version that wrote the row, null for hand-made ones). bridges: node_id, entity_id, ordinal_no, mention_text. ledger: node_id, entity_id,
version_id. scopes: version_id of the versions that the run reconciles. Every step is a join or a count by equal keys; no pair's versions are gathered."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAIR = ["node_id", "entity_id"]
FACTS = ("entity_id", "span_id", "mention_text")


class Collision(ValueError):
    """A row that the run would write belongs to others."""


def collisions(desired: Mapping[str, DataFrame], held: Mapping[str, DataFrame], scopes: DataFrame, sources: Mapping[str, str] | None = None) -> DataFrame:
    """table_no, table, row_id, owner, reason: desired rows whose id is held by a version outside the scopes, in all tables before
    anything is written. desired: row_id; held: row_id, version_id, where a table is in `sources` also source_kind, which
    must be the one named there (`source`, checked before the owner)."""
    found = None
    for no, (name, wanted) in enumerate(desired.items()):
        rows = held[name].join(wanted.select("row_id").distinct(), "row_id", "left_semi")
        known = rows.join(scopes.select("version_id", F.lit(True).alias("in_")).distinct(), "version_id", "left")
        kind = F.col("source_kind").eqNullSafe(F.lit(sources[name])) if sources and name in sources else F.lit(True)
        reason = F.when(~kind, "source").when(F.col("in_").isNull(), "owner")
        part = known.select(F.lit(no).alias("table_no"), F.lit(name).alias("table"), F.col("row_id").cast("string").alias("row_id"), F.col("version_id").alias("owner"), reason.alias("reason")).filter("reason is not null")
        found = part if found is None else found.unionByName(part)
    if found is None:
        raise ValueError("no tables to check")
    return found


def refuse(found: DataFrame) -> None:
    """Raises for the first collision by table, then id."""
    if first := found.orderBy("table_no", "row_id", "owner").first():
        raise Collision(f"{first['table']} {first['row_id']}: {first['reason']} {first['owner']}")


def mention_outcomes(mentions: DataFrame, held: DataFrame, scopes: DataFrame) -> DataFrame:
    """version_id, mention_id, action: `insert`, `update`, `equal`; `preserve` where another version or a hand holds the id; `delete` for
    rows that a version of the scopes holds and no longer wants."""
    wanted = mentions.join(scopes.select("version_id").distinct(), "version_id", "left_semi").select("mention_id", "version_id", F.struct(*FACTS).alias("new_"))
    there = held.select("mention_id", F.col("owner").alias("owner_"), F.struct(*FACTS).alias("old_"), F.lit(True).alias("held_"))
    both = wanted.join(there, "mention_id", "left")
    same = F.lit(True)
    for name in FACTS:
        same = same & F.col(f"new_.{name}").eqNullSafe(F.col(f"old_.{name}"))
    action = F.when(F.col("held_").isNull(), "insert").when(~F.col("owner_").eqNullSafe(F.col("version_id")), "preserve").when(same, "equal").otherwise("update")
    own = held.select("mention_id", F.col("owner").alias("version_id")).join(scopes.select("version_id").distinct(), "version_id", "left_semi")
    gone = own.join(wanted.select("mention_id", "version_id"), ["mention_id", "version_id"], "left_anti").select("version_id", "mention_id", F.lit("delete").alias("action"))
    return both.select("version_id", "mention_id", action.alias("action")).unionByName(gone)


def derived_pairs(mentions: DataFrame, held: DataFrame, node_spans: DataFrame, scopes: DataFrame) -> DataFrame:
    """version_id, node_id, entity_id, mention_text: what resolved mentions prove, by way of the nodes of their spans. A mention whose id
    others hold proves nothing. The text is that of the smallest mention id."""
    own = mentions.join(scopes.select("version_id").distinct(), "version_id", "left_semi").filter("entity_id is not null")
    foreign = held.select("mention_id", F.col("owner").alias("owner_"), F.lit(True).alias("held_"))
    free = own.join(foreign, "mention_id", "left").filter(F.col("held_").isNull() | F.col("owner_").eqNullSafe(F.col("version_id")))
    return free.join(node_spans.select("node_id", "span_id").distinct(), "span_id").groupBy("version_id", *PAIR).agg(F.min_by("mention_text", "mention_id").alias("mention_text"))


def proven_links(pairs: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """Pairs with ordinal_no and mention_text: as asked for, else 0 and the mention's. A link asked for that no mention proves
    raises. asked: version_id, node_id, entity_id, ordinal_no, mention_text."""
    if asked is None:
        return pairs.withColumn("ordinal_no", F.lit(0))
    keys = ["version_id", *PAIR]
    if bad := asked.join(pairs, keys, "left_anti").orderBy(*keys).first():
        raise Collision(f"link {bad['node_id']}, {bad['entity_id']} of {bad['version_id']}: no mention proves it")
    given = asked.groupBy(*keys).agg(F.min(F.struct("ordinal_no", "mention_text")).alias("asked_"))
    joined = pairs.join(given, keys, "left")
    own = F.col("asked_").isNotNull()
    return joined.select(*keys, F.when(own, F.col("asked_.mention_text")).otherwise(F.col("mention_text")).alias("mention_text"), F.when(own, F.col("asked_.ordinal_no")).otherwise(0).alias("ordinal_no"))


def link_outcomes(links: DataFrame, bridges: DataFrame, ledger: DataFrame, scopes: DataFrame) -> DataFrame:
    """version_id, node_id, entity_id, ordinal_no, mention_text, action: one row for each pair that a version of the scopes wants or owns.

    Wanted pairs: `create` without a bridge, for one version (an owner first, then the smallest); `unowned` where a bridge has no owner;
    `equal` and `rewrite` by the only owner that stays; `shared` by one of several that stay; `transfer` where all owners give the pair up in this run, to the smallest
    version that wants it; `foreign` else. Pairs that are owned but not wanted: `delete` with the bridge where no owner stays and nobody
    takes it over (the largest version of those that leave), else `release`. unowned, shared and foreign write nothing."""
    run = scopes.select("version_id").distinct()
    owned = ledger.select("version_id", *PAIR).distinct()
    inside = owned.join(run.withColumn("in_", F.lit(True)), "version_id", "left").withColumns({"owns_": F.lit(True), "in_": F.coalesce("in_", F.lit(False))})
    asked = links.select("version_id", *PAIR, "ordinal_no", "mention_text", F.lit(True).alias("wants_"))
    rows = inside.join(asked, ["version_id", *PAIR], "full").withColumns({c: F.coalesce(c, F.lit(d)) for c, d in (("owns_", False), ("wants_", False), ("in_", True))})
    leaves = F.col("owns_") & F.col("in_") & ~F.col("wants_")
    about = rows.groupBy(*PAIR).agg(
        F.count_if("owns_").alias("owners_"), F.count_if(leaves).alias("leaving_"),
        F.min(F.when(F.col("wants_"), F.struct((~F.col("owns_")).alias("new"), "version_id")))["version_id"].alias("first_"),
        F.max(F.when(leaves, F.col("version_id"))).alias("last_"),
    )
    there = bridges.select(*PAIR, F.struct("ordinal_no", "mention_text").alias("old_"), F.lit(True).alias("bridge_"))
    known = rows.filter("in_").join(about, PAIR).join(there, PAIR, "left")
    first, nobody = F.col("version_id") == F.col("first_"), F.col("owners_") == F.col("leaving_")
    same = F.col("ordinal_no").eqNullSafe(F.col("old_.ordinal_no")) & F.col("mention_text").eqNullSafe(F.col("old_.mention_text"))
    wanted = (
        F.when(F.col("bridge_").isNull(), F.when(first, "create").otherwise("foreign")).when(F.col("owners_") == 0, "unowned")
        .when(F.col("owns_"), F.when(F.col("owners_") - F.col("leaving_") > 1, "shared").when(same, "equal").otherwise("rewrite")).when(nobody & first, "transfer").otherwise("foreign")
    )
    left = F.when(nobody & F.col("first_").isNull() & F.col("bridge_").isNotNull() & (F.col("version_id") == F.col("last_")), "delete").otherwise("release")
    return known.select("version_id", *PAIR, "ordinal_no", "mention_text", F.when(F.col("wants_"), wanted).otherwise(left).alias("action"))


def applied(outcomes: DataFrame, bridges: DataFrame, ledger: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bridges and ledger after a run, for a new generation of both. Those who leave go first, so a second run over them changes nothing."""
    written = outcomes.filter(F.col("action").isin("create", "rewrite", "transfer")).select(*PAIR, "ordinal_no", "mention_text")
    touched = written.select(*PAIR).unionByName(outcomes.filter("action = 'delete'").select(*PAIR))
    after = bridges.select(*PAIR, "ordinal_no", "mention_text").join(touched, PAIR, "left_anti").unionByName(written)
    keys = ["version_id", *PAIR]
    gone = outcomes.filter(F.col("action").isin("delete", "release")).select(*keys)
    new = outcomes.filter(F.col("action").isin("create", "transfer")).select(*keys)
    return after, ledger.select(*keys).join(gone, keys, "left_anti").unionByName(new).distinct()
