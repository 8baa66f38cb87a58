"""Statistics of runs: percentiles, histograms, intervals, tests and comparisons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Two-tailed 95 % critical values of t by degrees of freedom, and histogram bounds in ms.
T_TABLE = {1: 12.706, 2: 4.303, 3: 3.182, 4: 2.776, 5: 2.571, 6: 2.447, 7: 2.365, 8: 2.306, 9: 2.262, 10: 2.228, 11: 2.201, 12: 2.179, 13: 2.160, 14: 2.145, 15: 2.131, 20: 2.086, 25: 2.060, 30: 2.042, 40: 2.021, 60: 2.000, 120: 1.980}


def t_critical(df: Column) -> Column:
    """The table's value of the nearest degrees of freedom; the smaller of two equally near."""
    keys = sorted(T_TABLE)
    out = None
    for a, b in zip(keys, keys[1:]):
        test = df <= (a + b) / 2
        out = F.when(test, T_TABLE[a]) if out is None else out.when(test, T_TABLE[a])
    return out.otherwise(T_TABLE[keys[-1]])


def nearest_rank(value: str, *percents: int) -> list[Column]:
    return [F.expr(f"percentile_disc({p / 100}) within group (order by {value})").alias(f"p{p}") for p in percents]


def histogram(rows: DataFrame, value: str, bounds: list[float]) -> DataFrame:
    """(bucket, upper, n): counts up to each bound, the last bucket holding the rest; empty ones are 0."""
    bucket = F.lit(len(bounds))
    for k in range(len(bounds) - 1, -1, -1):
        bucket = F.when(F.col(value) <= bounds[k], k).otherwise(bucket)
    counts = rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    every = rows.sparkSession.createDataFrame([*enumerate(bounds), (len(bounds), None)], "bucket int, upper double")
    return every.join(counts, "bucket", "left").select("bucket", "upper", F.coalesce("n", F.lit(0)).alias("n"))


def interval95(rows: DataFrame, group: str, value: str) -> DataFrame:
    g = rows.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("s")).filter("n >= 2")
    margin = t_critical(F.col("n") - 1) * F.col("s") / F.sqrt("n")
    return g.select(group, "n", "mean", (F.col("mean") - margin).alias("low"), (F.col("mean") + margin).alias("high"))


def _two(rows: DataFrame, group: str, value: str, a: str, b: str) -> DataFrame:
    def of(name: str, tag: str) -> list[Column]:
        v = F.when(F.col(group) == name, F.col(value))
        return [F.count(v).alias(f"n{tag}"), F.avg(v).alias(f"m{tag}"), F.var_samp(v).alias(f"v{tag}")]

    return rows.agg(*of(a, "x"), *of(b, "y"))


def welch(rows: DataFrame, group: str, value: str, a: str, b: str) -> DataFrame:
    """Welch's t of group a against b, and the band of its p."""
    s = _two(rows, group, value, a, b)
    ex, ey = F.col("vx") / F.col("nx"), F.col("vy") / F.col("ny")
    t = (F.col("mx") - F.col("my")) / F.sqrt(ex + ey)
    df = F.floor(F.pow(ex + ey, F.lit(2)) / (ex * ex / (F.col("nx") - 1) + ey * ey / (F.col("ny") - 1)))
    crit = t_critical(df)
    band = F.when(F.abs(t) > crit * 1.15, "p<0.01").when(F.abs(t) > crit, "p<0.05").otherwise("not significant")
    return s.select(F.round(t, 3).alias("t"), band.alias("p"))


def cohens_d(rows: DataFrame, group: str, value: str, a: str, b: str) -> DataFrame:
    s = _two(rows, group, value, a, b)
    pooled = F.sqrt(((F.col("nx") - 1) * F.col("vx") + (F.col("ny") - 1) * F.col("vy")) / (F.col("nx") + F.col("ny") - 2))
    d = F.when(pooled == 0, 0.0).otherwise((F.col("mx") - F.col("my")) / pooled)
    size = F.abs(d)
    label = F.when(size < 0.2, "negligible").when(size < 0.5, "small").when(size < 0.8, "medium").otherwise("large")
    return s.select(F.round(d, 6).alias("d"), label.alias("effect"))


def compare(before: DataFrame, now: DataFrame, threshold: float, lower_is_better: Column) -> DataFrame:
    """(metric, before, now, delta, regressed) of two tables (metric, value)."""
    both = before.select("metric", F.col("value").alias("before")).join(now.select("metric", F.col("value").alias("now")), "metric")
    delta = F.when(F.col("before") != 0, (F.col("now") - F.col("before")) / F.col("before")).otherwise(0.0)
    worse = F.when(lower_is_better, F.col("delta") > threshold).otherwise(F.col("delta") < -threshold)
    return both.withColumn("delta", delta).withColumn("regressed", worse)


def report(rows: DataFrame, kind: str, value: str, ms: str) -> DataFrame:
    """One row: operations by kind, their rate over the time they span, and the latency of each."""
    span = F.greatest((F.max(ms) - F.min(ms)) / 1000, F.lit(0.001))
    return rows.agg(
        F.count("*").alias("operations"),
        F.countDistinct(kind).alias("kinds"),
        F.round(F.count("*") / span, 9).alias("per_second"),
        *nearest_rank(value, 50, 95, 99),
        F.round(F.avg(value), 6).alias("mean"),
        F.round(F.stddev_pop(value) / F.avg(value), 6).alias("cv"),
    )


def exposition(rows: DataFrame, name: str, labels: list[str], value: str) -> DataFrame:
    """Lines of the text format of metrics: name{label="..."} value."""
    parts = []
    for k, label in enumerate(labels):
        escaped = F.replace(F.replace(F.col(label).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
        parts += [F.lit(("," if k else "") + label + '="'), escaped, F.lit('"')]
    named = F.concat(F.lit(name + "{"), *parts, F.lit("} ")) if labels else F.lit(name + " ")
    return rows.select(F.concat(named, F.col(value).cast("string")).alias("line"))


def engine_metrics(log: DataFrame, edges: DataFrame, atoms: DataFrame, health: DataFrame) -> DataFrame:
    """Lines of metrics that a log of mutations, its graph, its atoms and its shards' health hold."""
    typed = edges.select(F.regexp_extract("from_atom", r"^v1\.([a-z]+)\.", 1).alias("from_type"), F.regexp_extract("to_atom", r"^v1\.([a-z]+)\.", 1).alias("to_type"), "from_atom", "weight")
    by_atom = typed.groupBy(F.col("from_atom").alias("atom")).agg(F.count("*").alias("n"), F.round(F.max("weight") / F.sum("weight"), 6).alias("dominance"))
    sequences = log.filter("op = 'TRAIN'").groupBy("seq_id").agg(F.count("*").alias("n"))
    shards = health.select(F.col("shard").cast("string").alias("shard"), "active", "tombstoned", "pending")
    whole = log.agg(*[F.coalesce(F.sum((F.col("op") == op).cast("long")), F.lit(0)).alias(op) for op in ("ACCESS", "ADD", "TOMBSTONE", "COMMIT")])
    graph = edges.agg(F.count("*").alias("edges"), F.countDistinct("from_atom").alias("trained"))
    parts = [
        exposition(whole, "access_total", [], "ACCESS"),
        exposition(whole, "atoms_added_total", [], "ADD"),
        exposition(whole, "atoms_removed_total", [], "TOMBSTONE"),
        exposition(whole, "commits_total", [], "COMMIT"),
        exposition(sequences.agg(F.count("*").alias("n")), "train_total", [], "n"),
        exposition(sequences.groupBy(F.col("n").alias("length")).agg(F.count("*").alias("c")), "train_sequence_length", ["length"], "c"),
        exposition(by_atom, "atom_dominance_ratio", ["atom"], "dominance"),
        exposition(by_atom, "atom_trained_edges", ["atom"], "n"),
        exposition(graph, "cluster_total_edges", [], "edges"),
        exposition(graph, "cluster_trained_atoms", [], "trained"),
        exposition(shards, "shard_active_atoms", ["shard"], "active"),
        exposition(shards, "shard_tombstoned_atoms", ["shard"], "tombstoned"),
        exposition(shards, "pending_writes_count", ["shard"], "pending"),
        exposition(typed.groupBy("from_type", "to_type").agg(F.sum("weight").alias("n")), "transition_by_type_total", ["from_type", "to_type"], "n"),
        exposition(atoms.filter("status = 'active'").groupBy("atom_type").agg(F.count("*").alias("n")), "atoms_by_type", ["atom_type"], "n"),
    ]
    return reduce(DataFrame.unionByName, parts)
