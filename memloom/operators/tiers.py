"""Retention: tiers, their moves, consolidation, and times to live."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import retention as R
from ..functions.atoms import atom_type

GRACE_MS, PROMOTE_AT = 30_000, 3


def classify(features: DataFrame, now_ms: int, model: bool = True) -> DataFrame:
    """features (atom, accesses, passes, last_ms) with half_life and tier."""
    a = F.col("atom")
    half = R.half_life(F.col("accesses"), F.col("passes"), atom_type(a), R.provenance(a)) if model else R.simple_half_life(F.col("accesses"))
    since = F.when(F.col("last_ms") > 0, F.lit(now_ms) - F.col("last_ms"))
    return features.withColumn("half_life", half).withColumn("tier", R.tier(F.col("half_life"), since))


def summary(tiers: DataFrame) -> DataFrame:
    counts = [F.count(F.when(F.col("tier") == t, 1)).alias(t) for t in ("hot", "warm", "cold")]
    return tiers.agg(*counts, F.count("*").alias("total"))


def moves(before: DataFrame, now: DataFrame) -> DataFrame:
    """Promotions (was cold, now is not) and demotions (now lower); atoms without a tier before are left out."""
    rank = {"hot": 2, "warm": 1, "cold": 0}
    m = F.create_map(*[F.lit(x) for p in rank.items() for x in p])
    both = before.select("atom", F.col("tier").alias("was")).join(now.select("atom", F.col("tier").alias("is")), "atom")
    move = F.when((F.col("was") == "cold") & (F.col("is") != "cold"), "promotion").when(m[F.col("is")] < m[F.col("was")], "demotion")
    return both.withColumn("move", move).filter("move is not null")


def replay_candidates(tiers: DataFrame, n: int) -> DataFrame:
    return tiers.filter("tier = 'hot'").orderBy("half_life", "atom").limit(n)


def replay(edges: DataFrame, candidates: DataFrame, now_ms: int) -> DataFrame:
    """edges with the time of each candidate's heaviest edge set to now."""
    best = edges.join(candidates.select(F.col("atom").alias("from_atom")), "from_atom", "left_semi").groupBy("from_atom").agg(F.max(F.struct("weight", (-F.col("first_seq")).alias("o"), "to_atom")).alias("b")).select("from_atom", F.col("b.to_atom").alias("to_atom"), F.lit(now_ms).cast("long").alias("__now"))
    return edges.join(best, ["from_atom", "to_atom"], "left").withColumn("updated_ms", F.coalesce("__now", "updated_ms")).drop("__now")


def ttl_state(entries: DataFrame, touches: DataFrame, now_ms: int, promote_at: int = PROMOTE_AT) -> DataFrame:
    """entries (atom, ttl_ms, set_ms) after touches (atom, ts_ms): touched, last_ms, expires_ms, promoted, expired.

    A touch moves the expiry; the promote_at-th makes the atom permanent, and later ones count no more.
    """
    w = Window.partitionBy("atom").orderBy("ts_ms").rowsBetween(Window.unboundedPreceding, 0)
    seen = touches.join(entries.select("atom", "set_ms"), "atom").filter(F.col("ts_ms").between(F.col("set_ms"), F.lit(now_ms)))
    counted = seen.withColumn("k", F.count("*").over(w)).filter(F.col("k") <= promote_at)
    agg = counted.groupBy("atom").agg(F.count("*").alias("touched"), F.max("ts_ms").alias("last"))
    out = entries.join(agg, "atom", "left").withColumn("touched", F.coalesce("touched", F.lit(0).cast("long"))).withColumn("last_ms", F.coalesce("last", "set_ms"))
    promoted = F.col("touched") >= promote_at
    expires = F.when(~promoted, F.col("last_ms") + F.col("ttl_ms"))
    return out.select("atom", "touched", "last_ms", expires.alias("expires_ms"), promoted.alias("promoted"), F.coalesce(expires + GRACE_MS <= now_ms, F.lit(False)).alias("expired"))
