"""Fitting the retention model from an access log: examples, loss, gradient descent, time constant."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import retention as R
from ..functions.atoms import atom_type
from .ordinal import global_index


def examples(log: DataFrame) -> DataFrame:
    """(atom, ts_ms, accesses, trainings, interval_ms): each access with the time to the next one.

    log (atom, kind access | train, ts_ms). Counts are of all events up to the access, ties included.
    """
    upto = Window.partitionBy("atom").orderBy("ts_ms").rangeBetween(Window.unboundedPreceding, 0)
    rows = log.withColumn("accesses", F.sum((F.col("kind") == "access").cast("long")).over(upto)).withColumn("trainings", F.sum((F.col("kind") == "train").cast("long")).over(upto))
    w = Window.partitionBy("atom").orderBy("ts_ms")
    pairs = rows.filter("kind = 'access'").withColumn("interval_ms", F.lead("ts_ms").over(w) - F.col("ts_ms"))
    return pairs.filter("interval_ms > 0").select("atom", "ts_ms", "accesses", "trainings", "interval_ms")


def features(rows: DataFrame) -> list[Column]:
    a = F.col("atom")
    return [F.log1p("accesses"), F.log1p("trainings"), R.type_bias(atom_type(a)), R.provenance_bias(R.provenance(a))]


def _predicted_log2(rows: DataFrame, theta: list[float]) -> Column:
    x = sum((F.lit(t) * f for t, f in zip(theta, features(rows))), F.lit(0.0))
    return F.least(F.greatest(x, F.lit(-20.0)), F.lit(20.0))


def half_life_of(rows: DataFrame, theta: list[float]) -> Column:
    return F.lit(float(R.BASE_HALF_LIFE)) * F.pow(F.lit(2.0), _predicted_log2(rows, theta))


def loss(rows: DataFrame, theta: list[float]) -> DataFrame:
    """Mean squared difference of the logarithms of predicted and observed times."""
    d = F.ln(half_life_of(rows, theta)) - F.ln(F.col("interval_ms").cast("double"))
    return rows.agg(F.avg(d * d).alias("loss"), F.count("*").alias("n"))


def fit(rows: DataFrame, theta: list[float] | None = None, steps: int = 50, rate: float = 0.05) -> list[float]:
    """Gradient descent; one aggregation of sums a step, so data stay where they are.

    The loss is quadratic in theta where no clamp acts: a single pass gives its moments, and the
    steps run on them.
    """
    theta = list(theta or R.THETA.values())
    x = features(rows)
    target = (F.ln(F.col("interval_ms").cast("double")) - float(np.log(R.BASE_HALF_LIFE))) / float(np.log(2))
    cols = [F.sum(x[i] * x[j]) for i in range(4) for j in range(4)] + [F.sum(x[i] * target) for i in range(4)] + [F.count("*")]
    row = rows.agg(*[c.alias(f"c{k}") for k, c in enumerate(cols)]).first()
    n = row[-1]
    if not n:
        return theta
    a, b = np.array(row[:16], float).reshape(4, 4) / n, np.array(row[16:20], float) / n
    t = np.array(theta, float)
    top = max(1e-9, float(np.linalg.eigvalsh(a).max()))
    for _ in range(steps):
        t -= min(rate, 1 / top) * 2 * (a @ t - b)
    return t.tolist()


def pairwise_accuracy(rows: DataFrame, theta: list[float], order: list[str], reach: int = 9) -> DataFrame:
    """The share of pairs at most reach apart, in the given order, whose predicted order is the observed one."""
    numbered = global_index(rows.withColumn("pred", half_life_of(rows, theta)), *order)
    a = numbered.select("i", F.col("pred").alias("pa"), F.col("interval_ms").alias("ia"))
    b = numbered.select(F.explode(F.sequence(F.col("i") - reach, F.col("i") - 1)).alias("i"), F.col("pred").alias("pb"), F.col("interval_ms").alias("ib"))
    right = (F.col("pa") > F.col("pb")) == (F.col("ia") > F.col("ib"))
    return a.join(b, "i").agg(F.avg(right.cast("double")).alias("accuracy"), F.count("*").alias("pairs"))


def spike_tau(log: DataFrame, session_ms: int = 600_000, fallback: int = 300_000, low: int = 30_000, high: int = 1_800_000) -> DataFrame:
    """The 75th percentile of the gaps between trainings of an atom within a session, within bounds.

    Gaps are counted by value first, so the ranking is over values and not over rows.
    """
    w = Window.partitionBy("atom").orderBy("ts_ms")
    gaps = log.filter("kind = 'train'").select((F.col("ts_ms") - F.lag("ts_ms").over(w)).alias("gap")).filter((F.col("gap") > 0) & (F.col("gap") < session_ms))
    counts = gaps.groupBy("gap").agg(F.count("*").alias("c"))
    run = counts.withColumn("run", F.sum("c").over(Window.orderBy("gap"))).withColumn("n", F.sum("c").over(Window.partitionBy()))
    at = run.filter(F.col("run") > F.floor(F.col("n") * 0.75)).agg(F.min("gap").alias("gap"))
    return at.select(F.coalesce(F.least(F.greatest("gap", F.lit(low)), F.lit(high)), F.lit(fallback)).cast("long").alias("tau_ms"))
