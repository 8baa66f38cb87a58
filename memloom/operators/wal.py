"""The write-ahead view of a log: what follows the last commit, and its compact form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def checksum(seq: Column, ts: Column, op: Column, data: Column, index: Column) -> Column:
    """The first eight hex digits of the SHA-256 of the entry as JSON, absent fields left out."""
    return F.substring(F.sha2(F.to_json(F.struct(seq.alias("seq"), ts.alias("ts"), op.alias("op"), data.alias("data"), index.alias("index"))).cast("binary"), 256), 1, 8)


def valid(entries: DataFrame) -> DataFrame:
    return entries.filter(F.col("ck") == checksum(*[F.col(c) for c in ("seq", "ts", "op", "data", "index")]))


def uncommitted(entries: DataFrame) -> DataFrame:
    """Entries after the last COMMIT."""
    last = entries.filter("op = 'COMMIT'").agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("__last"))
    return entries.crossJoin(F.broadcast(last)).filter(F.col("seq") > F.col("__last")).drop("__last")  # one row


def compact(entries: DataFrame) -> DataFrame:
    """Uncommitted entries without repeated additions, and without additions that a tombstone took back.

    An addition of data is repeated while the earlier one stands. Entries are (seq, op, data, index).
    """
    rest = uncommitted(entries).filter("op in ('ADD', 'TOMBSTONE')")
    adds = rest.filter("op = 'ADD'")
    marks = rest.filter("op = 'TOMBSTONE' and index is not null")
    # the tombstone that takes an addition back: the first of its leaf after it
    undone = adds.select(F.col("seq").alias("a"), "index").join(marks.select(F.col("seq").alias("t"), "index"), "index").filter("t > a").groupBy("a").agg(F.min("t").alias("t"))
    with_end = adds.join(undone, adds["seq"] == undone["a"], "left").select("seq", "op", "data", "index", "t")
    # in a run of equal data an addition counts if no earlier one still stands
    runs = with_end.groupBy("data").agg(F.sort_array(F.collect_list(F.struct("seq", "index", "t"))).alias("r"))
    start = F.struct(F.lit(None).cast("bigint").alias("until"), F.lit(False).alias("open"), F.array().cast("array<struct<seq:bigint,index:bigint,t:bigint>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        stands = s["open"] & (s["until"].isNull() | (s["until"] > x["seq"]))
        taken = F.struct(x["t"].alias("until"), F.lit(True).alias("open"), F.concat(s["out"], F.array(x)).alias("out"))
        return F.when(stands, s).otherwise(taken)

    kept = runs.select("data", F.explode(F.aggregate("r", start, step, lambda s: s["out"])).alias("x"))
    live = kept.filter("x.t is null").select(F.col("x.seq").alias("seq"), F.lit("ADD").alias("op"), "data", F.col("x.index").alias("index"))
    used = kept.filter("x.t is not null").select(F.col("x.t").alias("seq"))
    alone = marks.join(used, "seq", "left_anti").groupBy("index").agg(F.min("seq").alias("seq"))
    return live.unionByName(alone.select("seq", F.lit("TOMBSTONE").alias("op"), F.lit(None).cast("string").alias("data"), "index"))
