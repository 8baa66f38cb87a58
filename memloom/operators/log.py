"""State as a query over the append-only log of mutations.

A mutation is (seq long, ts_ms long, op ADD | TOMBSTONE | ACCESS | TRAIN, atom, version long).
Nothing is updated in place: adding, removing and committing append rows, and every view below is
a function of the log, a version and a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.atoms import TYPES, atom_type
from ..functions.hashing import atom_hash, jump_shard
from .ordinal import dense_index

MUTATIONS = "seq bigint, ts_ms bigint, op string, atom string, version bigint"


def add_atoms(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """The rows of incoming (seq, ts_ms, atom, version) that are valid atoms and new; the first of equal ones."""
    fresh = incoming.filter(atom_type(F.col("atom")).isNotNull()).join(existing.select("atom"), "atom", "left_anti")
    first = fresh.groupBy("atom").agg(F.min_by(F.struct("seq", "ts_ms", "version"), "seq").alias("r"))
    return first.select("r.seq", "r.ts_ms", F.lit("ADD").alias("op"), "atom", "r.version")


def atoms_view(log: DataFrame, shards: int = 4) -> DataFrame:
    """A row an atom: shard, idx (leaf place in its shard), hash, status, times and versions.

    Adding again moves the version that an atom was last committed at, and never revives it.
    """
    by_atom = log.filter("op in ('ADD', 'TOMBSTONE')").groupBy("atom").agg(
        F.min(F.when(F.col("op") == "ADD", F.col("seq"))).alias("seq"),
        F.min(F.when(F.col("op") == "ADD", F.col("ts_ms"))).alias("created_ms"),
        F.min(F.when(F.col("op") == "ADD", F.col("version"))).alias("first_version"),
        F.max(F.when(F.col("op") == "ADD", F.col("version"))).alias("committed_version"),
        F.max((F.col("op") == "TOMBSTONE").cast("int")).alias("gone"),
    )
    known = by_atom.filter("seq is not null").withColumn("shard", jump_shard(F.col("atom"), shards))
    placed = dense_index(known, "shard", "seq")
    return placed.select("atom", atom_type(F.col("atom")).alias("atom_type"), "shard", F.col("idx").cast("long").alias("idx"), atom_hash(F.col("atom")).alias("hash"), F.when(F.col("gone") == 1, "tombstoned").otherwise("active").alias("status"), "seq", "created_ms", "first_version", "committed_version")


def as_of(atoms: DataFrame, version: int | None = None, ms: int | None = None, commits: DataFrame | None = None) -> DataFrame:
    """Active atoms as of a version or a time; with both, and the commits, the earlier of the two."""
    out = atoms.filter("status = 'active'")
    if version is not None:
        out = out.filter(F.col("committed_version") <= version)
    if ms is not None:
        out = out.filter(F.col("created_ms") <= ms)
        if commits is not None:  # the last version at that time bounds the versions as well
            last = commits.filter(F.col("ts_ms") <= ms).agg(F.max("version").alias("__v"))
            out = out.crossJoin(F.broadcast(last)).filter(F.col("committed_version") <= F.col("__v")).drop("__v")  # one row
    return out


def page(atoms: DataFrame, kind: str | None = None, prefix: str | None = None, offset: int = 0, limit: int = 100) -> DataFrame:
    """A page of active atoms, in shard and leaf order."""
    out = atoms.filter("status = 'active'")
    if kind:
        out = out.filter(F.col("atom_type") == kind)
    if prefix:
        out = out.filter(F.col("atom").startswith(prefix))
    return out.orderBy("shard", "idx").offset(offset).limit(min(limit, 1000))


def stale(atoms: DataFrame, now_ms: int, days: int) -> DataFrame:
    """Active atoms created days ago or earlier, with their age in days; oldest first."""
    day = 86_400_000
    old = atoms.filter((F.col("status") == "active") & (F.col("created_ms") <= now_ms - days * day))
    return old.withColumn("age_days", F.floor((F.lit(now_ms) - F.col("created_ms")) / day)).orderBy("created_ms", "atom")


def commits(log: DataFrame) -> DataFrame:
    return log.groupBy("version").agg(F.max("ts_ms").alias("ts_ms"), F.sum((F.col("op") == "ADD").cast("long")).alias("added"), F.sum((F.col("op") == "TOMBSTONE").cast("long")).alias("removed"))


def batch_access(requests: DataFrame, atoms: DataFrame, leaf_counts: DataFrame, best: DataFrame) -> DataFrame:
    """requests (pos, atom) with the atom's leaf, the predicted next atom, or an error.

    leaf_counts (shard, leaves) are the committed leaves; best (from_atom, to_atom) the predictions.
    """
    found = requests.join(atoms.select("atom", "shard", "idx", "hash", "status"), "atom", "left").join(leaf_counts, "shard", "left")
    error: Column = (
        F.when(F.col("status").isNull(), "unknown").when(F.col("status") == "tombstoned", "tombstoned").when(F.col("idx") >= F.coalesce("leaves", F.lit(0)), "pending")
    )
    out = found.withColumn("error", error).join(best.select(F.col("from_atom").alias("atom"), F.col("to_atom").alias("predicted")), "atom", "left")
    return out.select("pos", "atom", "shard", "idx", "hash", "error", F.when(F.col("error").isNull(), F.col("predicted")).alias("predicted"))


def inspect(atoms: DataFrame, leaf_counts: DataFrame, edges: DataFrame) -> DataFrame:
    """atoms with committed and each outgoing transition (to_atom, weight, updated_ms) to a known atom; one row, of nulls, where there is none."""
    known = edges.join(atoms.select(F.col("atom").alias("to_atom")), "to_atom", "left_semi").select(F.col("from_atom").alias("atom"), "to_atom", "weight", "updated_ms")
    placed = atoms.join(leaf_counts, "shard", "left").withColumn("committed", F.col("idx") < F.coalesce("leaves", F.lit(0))).drop("leaves")
    return placed.join(known, "atom", "left")


def type_fallback(asked: DataFrame, atoms: DataFrame, edges: DataFrame, policy: dict[str, list[str]]) -> DataFrame:
    """asked (atom, shard, atom_type) with predicted: the best atom, in the same shard, of the first type that the policy lets it go to and that has one.

    Best is the largest incoming weight, the first of equals; no policy, no prediction. Types the policy does not list may go anywhere.
    """
    if not policy:
        return asked.select("atom", "shard", F.lit(None).cast("string").alias("predicted"))
    score = edges.groupBy(F.col("to_atom").alias("atom")).agg(F.sum("weight").alias("score"))
    live = atoms.filter("status = 'active'").join(score, "atom", "left").fillna({"score": 0})
    best = live.groupBy("shard", F.col("atom_type").alias("to_type")).agg(F.max_by("atom", F.struct("score", -F.col("idx"))).alias("best"))
    targets = F.array(*[F.lit(t) for t in TYPES])
    for kind, allowed in policy.items():
        some = F.array(*[F.lit(t) for t in TYPES if t in allowed]).cast("array<string>")
        targets = F.when(F.col("atom_type") == kind, some).otherwise(targets)
    to = asked.select("atom", "shard", F.posexplode_outer(targets).alias("order", "to_type"))
    found = to.join(best, ["shard", "to_type"], "left").groupBy("atom", "shard").agg(F.min_by("best", F.when(F.col("best").isNotNull(), F.col("order"))).alias("predicted"))
    return found.select("atom", "shard", "predicted")


def health(atoms: DataFrame, leaf_counts: DataFrame) -> DataFrame:
    """A row a shard: active, tombstoned and pending atoms."""
    joined = atoms.join(leaf_counts, "shard", "left")
    pending = (F.col("idx") >= F.coalesce("leaves", F.lit(0))) & (F.col("status") == "active")
    return joined.groupBy("shard").agg(F.sum((F.col("status") == "active").cast("long")).alias("active"), F.sum((F.col("status") == "tombstoned").cast("long")).alias("tombstoned"), F.sum(pending.cast("long")).alias("pending"))


def admission(pending: Column, queued: Column, incoming: Column, limit: int = 1000) -> Column:
    """Whether a write of incoming atoms is let in."""
    return pending + queued + incoming <= limit
