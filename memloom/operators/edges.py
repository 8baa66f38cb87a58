"""The weighted transition graph of training sequences: learning, decay, pruning and prediction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import retention as R
from ..functions.atoms import atom_type


def transitions(rows: DataFrame, sequence: str, *order: str) -> DataFrame:
    """(sequence, from_atom, to_atom, ts_ms, seq) of adjacent rows (sequence, atom, ts_ms, seq) in order."""
    w = Window.partitionBy(sequence).orderBy(*order)
    return rows.select(sequence, F.col("atom").alias("from_atom"), *[F.lead(c).over(w).alias(n) for c, n in (("atom", "to_atom"), ("ts_ms", "ts_ms"), ("seq", "seq"))]).filter("to_atom is not null")


def edge_weights(pairs: DataFrame, weight: Column | None = None) -> DataFrame:
    """(from_atom, to_atom, weight, updated_ms, first_seq): sums map-side first, so a hot pair is a row a task."""
    return pairs.groupBy("from_atom", "to_atom").agg(F.sum(weight if weight is not None else F.lit(1)).cast("long").alias("weight"), F.max("ts_ms").alias("updated_ms"), F.min("seq").alias("first_seq"))


def spike_weights(pairs: DataFrame, tau: float, created: DataFrame | None = None) -> DataFrame:
    """Edge weights whose increments fall with the time since any earlier update of the same source."""
    w = Window.partitionBy("from_atom").orderBy("ts_ms", "seq")
    before = F.lag("ts_ms").over(w)
    rows = pairs.withColumn("__before", before)
    if created is not None:
        rows = rows.join(created.select(F.col("atom").alias("from_atom"), "created_ms"), "from_atom", "left").withColumn("__before", F.coalesce("__before", "created_ms"))
    dt = F.coalesce(F.col("ts_ms") - F.col("__before"), F.lit(0))
    return edge_weights(rows, R.spike_increment(dt, tau))


def top_edge(edges: DataFrame, score: str = "weight") -> DataFrame:
    """Each source's best target; ties go to the edge that was learned first."""
    best = F.max(F.struct(F.col(score).alias("s"), (-F.col("first_seq")).alias("o"), F.col("to_atom"), F.col("weight"))).alias("b")
    return edges.groupBy("from_atom").agg(best, F.sum("weight").alias("total"), F.count("*").alias("edges")).select("from_atom", "b.to_atom", "b.weight", "total", "edges")


def top_edges(edges: DataFrame, k: int, score: str = "weight") -> DataFrame:
    w = Window.partitionBy("from_atom").orderBy(F.desc(score), F.desc("weight"), "first_seq")
    return edges.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def source_features(edges: DataFrame, accesses: DataFrame) -> DataFrame:
    """(from_atom, passes, accesses): what a source's half-life depends on; current sums, no feedback."""
    passes = edges.groupBy("from_atom").agg(F.sum("weight").alias("passes"))
    return passes.join(accesses.select(F.col("atom").alias("from_atom"), "accesses"), "from_atom", "left").fillna({"accesses": 0})


def effective_weights(edges: DataFrame, now_ms: int, accesses: DataFrame | None = None, half_life_ms: float | None = None) -> DataFrame:
    """edges with half_life and effective: by one half-life for all, or by each source's features."""
    elapsed = F.lit(now_ms) - F.col("updated_ms")
    if accesses is None:
        return edges.withColumn("effective", R.decayed(F.col("weight"), elapsed, F.lit(half_life_ms)))
    joined = edges.join(source_features(edges, accesses), "from_atom")
    a = F.col("from_atom")
    half = R.half_life(F.col("accesses"), F.col("passes"), atom_type(a), R.provenance(a))
    return joined.withColumn("half_life", half).withColumn("effective", R.decayed(F.col("weight"), elapsed, F.col("half_life"))).drop("passes", "accesses")


def prune(edges: DataFrame, now_ms: int, min_age_ms: int = 30 * R.DAY, least: float = 0.1) -> DataFrame:
    """edges (with effective) but for those both old and weak."""
    return edges.filter(~((F.lit(now_ms) - F.col("updated_ms") >= min_age_ms) & (F.col("effective") < least)))


def decay_all(edges: DataFrame, factor: float = 0.9, least: float = 0.1) -> DataFrame:
    return edges.withColumn("weight", F.col("weight") * factor).filter(F.col("weight") >= least)


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both graphs, weights added."""
    cols = ["from_atom", "to_atom", "weight"]
    return a.select(*cols).unionByName(b.select(*cols)).groupBy("from_atom", "to_atom").agg(F.sum("weight").alias("weight"))


def adjacency(edges: DataFrame, atoms: DataFrame) -> DataFrame:
    """A row a source: its outgoing edges as arrays by weight, then leaf, and the top of them; local, active targets only."""
    live = atoms.filter("status = 'active'").select("atom", "shard", "idx")
    src = live.select(F.col("atom").alias("from_atom"), F.col("shard").alias("from_shard"), F.col("idx").alias("from_idx"))
    dst = live.select(F.col("atom").alias("to_atom"), F.col("shard").alias("to_shard"), F.col("idx").alias("to_idx"))
    local = edges.join(src, "from_atom").join(dst, "to_atom").filter("from_shard = to_shard")
    rows = local.groupBy("from_atom", "from_shard", "from_idx").agg(F.sort_array(F.collect_list(F.struct((-F.col("weight")).alias("w"), "to_idx"))).alias("r"))
    return rows.select("from_atom", F.col("from_shard").alias("shard"), F.transform("r", lambda x: x["to_idx"]).alias("cols"), F.transform("r", lambda x: -x["w"]).alias("weights"), F.element_at("r", 1)["to_idx"].alias("top_idx"))


def policy_top(edges: DataFrame, policy: dict[str, list[str]], score: str = "weight") -> DataFrame:
    """Each source's best target that the policy allows, and whether the policy changed the answer.

    Types that the policy does not list may go anywhere. The policy is at most six by six.
    """
    to_type, from_type = atom_type(F.col("to_atom")), atom_type(F.col("from_atom"))
    allowed = F.lit(True)
    for kind, targets in policy.items():
        allowed = F.when(from_type == kind, to_type.isin(*targets) if targets else F.lit(False)).otherwise(allowed)
    key = F.struct(F.col(score), (-F.col("first_seq")).alias("o"))
    best = edges.withColumn("allowed", allowed).groupBy("from_atom").agg(F.max_by("to_atom", key).alias("best_overall"), F.max_by("to_atom", F.when(F.col("allowed"), key)).alias("best_allowed"))
    return best.withColumn("filtered", ~F.col("best_overall").eqNullSafe(F.col("best_allowed")))


def best_of_type(edges: DataFrame, atoms: DataFrame) -> DataFrame:
    """For each type its active atom of the largest incoming weight; untrained atoms score 0, ties go to the first."""
    score = edges.groupBy(F.col("to_atom").alias("atom")).agg(F.sum("weight").alias("score"))
    all_atoms = atoms.filter("status = 'active'").join(score, "atom", "left").fillna({"score": 0})
    return all_atoms.groupBy("atom_type").agg(F.max(F.struct(F.col("score"), (-F.col("seq")).alias("o"), "atom")).alias("b")).select("atom_type", "b.atom", "b.score")


def neighbourhood(edges: DataFrame, start: list[str], depth: int, fan_out: int) -> DataFrame:
    """(atom, depth) reached from start over each atom's fan_out heaviest edges, breadth first."""
    top = top_edges(edges, fan_out).select("from_atom", "to_atom")
    spark = edges.sparkSession
    seen = spark.createDataFrame([(a,) for a in dict.fromkeys(start)], "atom string").withColumn("depth", F.lit(0))
    layer = seen
    for d in range(1, depth + 1):
        reached = layer.join(top, layer["atom"] == top["from_atom"]).select(F.col("to_atom").alias("atom")).distinct()
        layer = reached.join(seen.select("atom"), "atom", "left_anti").withColumn("depth", F.lit(d))
        seen = seen.unionByName(layer)
    return seen


def mermaid(edges: DataFrame, reached: DataFrame) -> DataFrame:
    """The edges among reached atoms as lines of a diagram."""
    inside = edges.join(reached.select(F.col("atom").alias("from_atom")), "from_atom", "left_semi").join(reached.select(F.col("atom").alias("to_atom")), "to_atom", "left_semi")
    return inside.select(F.concat(F.lit('  "'), "from_atom", F.lit('" -->|'), "weight", F.lit('| "'), "to_atom", F.lit('"')).alias("line"))
