"""Merging identities along links, with vetoes.

Components come by alternating large and small stars (Kiveris et al. 2014): every round is two sums by key and joins,
its edges are written to the shared folder, and no component is ever gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ident
from ..sources import store

#: Rounds after which something must be wrong; they grow with the logarithm of the longest path.
MOST_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.filter("v > u").join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    met = down.join(least, "u")
    return met.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """id, component (its least id), of every id in links (u, v) but the least of each component; self links count nothing."""
    edges, before = store.staged(links.filter("u <> v").select("u", "v").distinct(), "links"), None
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20, 0)"))).first())
    for _ in range(MOST_ROUNDS):
        edges = store.staged(_small_star(_large_star(edges)), "links")
        now = mark(edges)
        if now == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
        before = now
    raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")


def judged_links(identities: DataFrame, links: DataFrame) -> DataFrame:
    """links (left_id, right_id, score) with the ends' codes and veto: unknown (an end is no identity), type, code, or null."""
    side = lambda end: identities.select(F.col("identity_id").alias(f"{end}_id"), F.col("entity_type").alias(f"{end}_type"), F.col("code").alias(f"{end}_code"))
    rows = links.select("left_id", "right_id", "score").join(side("left").withColumn("l_", F.lit(True)), "left_id", "left").join(side("right").withColumn("r_", F.lit(True)), "right_id", "left")
    veto = F.when(F.col("l_").isNull() | F.col("r_").isNull(), "unknown").when(~F.col("left_type").eqNullSafe(F.col("right_type")), "type").when(F.col("left_code") != F.col("right_code"), "code")
    return rows.withColumn("veto", veto).drop("l_", "r_")


def merged(identities: DataFrame, links: DataFrame) -> DataFrame:
    """identity_id, survivor (the least id of its group), reason: code, link, or null for an identity that stands alone.

    identities: identity_id, entity_type, code (null where unknown). Vetoed links join nobody. Identities of one type and code
    are one group. Those without code that hang together by links stay together; where they touch groups of several
    codes, which must not become one, they go with the best link to one of them (equal scores: the least code), so the
    component is split there and no group ever holds two codes or types. Repeated links and both directions count once."""
    facts = store.staged(identities.select("identity_id", "entity_type", "code"), "identities")
    allowed = store.staged(judged_links(facts, links).filter("veto is null"), "allowed")
    bare = components(allowed.filter("left_code is null and right_code is null").select(F.col("left_id").alias("u"), F.col("right_id").alias("v")))
    uncoded = facts.filter("code is null").join(bare.withColumnRenamed("id", "identity_id"), "identity_id", "left").select("identity_id", "entity_type", F.coalesce("component", "identity_id").alias("component"))
    touching = allowed.filter("left_code is null and right_code is not null").select(F.col("left_id").alias("identity_id"), F.col("right_code").alias("code"), "score")
    touching = touching.unionByName(allowed.filter("left_code is not null and right_code is null").select(F.col("right_id").alias("identity_id"), F.col("left_code").alias("code"), "score"))
    best = touching.join(uncoded.select("identity_id", "component"), "identity_id").groupBy("component").agg(F.min(F.struct(-F.coalesce("score", F.lit(0.0)), F.col("code").alias("code")))["code"].alias("code"))
    placed = uncoded.join(best, "component", "left").select("identity_id", "entity_type", "code", "component").unionByName(facts.filter("code is not null").select("identity_id", "entity_type", "code", F.lit(None).cast(uncoded.schema["component"].dataType).alias("component")))
    own = placed.withColumn("group_", F.when(F.col("code").isNotNull(), F.struct(F.col("entity_type"), F.col("code"), F.lit(None).cast(uncoded.schema["component"].dataType).alias("c"))).otherwise(F.struct(F.lit(None).cast("string").alias("entity_type"), F.lit(None).cast("string").alias("code"), F.col("component").alias("c"))))
    least = own.groupBy("group_").agg(F.min("identity_id").alias("survivor"), F.count(F.lit(1)).alias("n_"))
    reason = F.when(F.col("n_") == 1, None).when(F.col("component").isNull(), "code").otherwise("link")
    return own.join(least, own["group_"].eqNullSafe(least["group_"])).select("identity_id", "survivor", reason.alias("reason"))


def merge_events(found: DataFrame, seed: str = "merge-v1") -> DataFrame:
    """event_id, survivor, merged_id, reason of every identity that goes into another, sorted; the same merge has the same id."""
    rows = found.filter("identity_id <> survivor")
    event = ident.uuid5(F.concat_ws(":", F.lit(seed), F.col("survivor").cast("string"), F.col("identity_id").cast("string")))
    return rows.select(event.alias("event_id"), "survivor", F.col("identity_id").alias("merged_id"), "reason").orderBy("survivor", "merged_id")
