"""Variable-order prediction from counts of paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import written

MAX_ORDER, ESCAPE = 3, 0.3


def path_counts(rows: DataFrame, sequence: str, *order: str, max_order: int = MAX_ORDER) -> DataFrame:
    """(path, depth, count, first_seq): each observed (context, target) counts for the context and for context + target."""
    w = Window.partitionBy(sequence).orderBy(*order)
    before = [F.lag("atom", k).over(w) for k in range(max_order, 0, -1)]
    held = rows.select("seq", "atom", F.array(*before).alias("b"))
    paths = []
    for k in range(1, max_order + 1):
        context = F.slice("b", max_order - k + 1, k)
        some = F.get("b", F.lit(max_order - k)).isNotNull()
        paths += [F.when(some, context), F.when(some, F.concat(context, F.array("atom")))]
    each = held.select("seq", F.explode(F.array_compact(F.array(*paths))).alias("path"))
    return each.groupBy("path").agg(F.count("*").alias("count"), F.min("seq").alias("first_seq")).withColumn("depth", F.size("path"))


def best_children(nodes: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """For each context its best child and that child's share of all; ties go to the first seen."""
    kids = nodes.filter("depth >= 2").select(F.slice("path", F.lit(1), F.col("depth") - 1).alias("context"), F.element_at("path", -1).alias("atom"), "count", "first_seq")
    if excluded is not None:
        kids = kids.join(excluded.select("atom"), "atom", "left_anti")
    best = kids.groupBy("context").agg(F.max(F.struct("count", (-F.col("first_seq")).alias("o"), "atom")).alias("b"), F.sum("count").alias("total"))
    return best.select("context", F.size("context").alias("order"), F.col("b.atom").alias("predicted"), (F.col("b.count") / F.col("total")).alias("confidence"))


def predict(histories: DataFrame, nodes: DataFrame, excluded: DataFrame | None = None, max_order: int = MAX_ORDER, escape: float = ESCAPE) -> DataFrame:
    """histories (key, history array) with the prediction of the longest context that is sure enough.

    If none reaches the threshold, the order-1 prediction below it is taken; none gives nulls.
    """
    contexts = F.array_compact(F.array(*[F.when(F.size("history") >= k, F.slice("history", -k, k)) for k in range(1, max_order + 1)]))
    asked = histories.select("key", F.explode(contexts).alias("context"))
    found = asked.join(best_children(nodes, excluded), "context").filter((F.col("confidence") >= escape) | (F.col("order") == 1))
    best = found.groupBy("key").agg(F.max(F.struct((F.col("confidence") >= escape).alias("sure"), "order", "predicted", "confidence")).alias("b"))
    return histories.select("key").join(best, "key", "left").select("key", "b.predicted", "b.order", "b.confidence")


def combined(ppm: DataFrame, edges_best: DataFrame, key_to_atom: DataFrame) -> DataFrame:
    """The path prediction where its order is two or more, else the edge's: (key, predicted, source)."""
    joined = key_to_atom.join(ppm, "key", "left").join(edges_best.select(F.col("from_atom").alias("atom"), F.col("to_atom").alias("edge")), "atom", "left")
    use = F.col("order") >= 2
    return joined.select("key", F.when(use, F.col("predicted")).otherwise(F.col("edge")).alias("predicted"), F.when(use, "path").when(F.col("edge").isNotNull(), "edge").otherwise("none").alias("source"))


def prune(nodes: DataFrame, most: int, share: float = 0.9) -> DataFrame:
    """nodes cut to share of most, lowest-count leaves first, round after round, once there are more than most.

    Leaves of a round are ranked together only as far as needed: the surplus is the limit.
    """
    n = nodes.count() + 1
    if n <= most:
        return nodes
    target = int(most * share)
    while n > target:
        parents = nodes.filter("depth >= 2").select(F.slice("path", F.lit(1), F.col("depth") - 1).alias("path")).distinct()
        leaves = nodes.join(parents, "path", "left_anti")
        gone = leaves.orderBy("count", "first_seq", "path").limit(n - target).select("path")
        gone = written(gone)
        k = gone.count()
        if not k:
            break
        nodes, n = written(nodes.join(gone, "path", "left_anti")), n - k
    return nodes


def invalid_nodes(nodes: DataFrame, max_order: int = MAX_ORDER) -> DataFrame:
    """Nodes that a stored table may not hold: too deep, or counts out of range."""
    checks = [F.col("depth") > max_order + 1, F.col("count") < 0, F.col("count") > 1_000_000_000]
    return nodes.filter(reduce(lambda a, b: a | b, checks))
