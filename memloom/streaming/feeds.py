"""Streams over the log: ingest, counters, windows, change feed and times to live."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..functions.atoms import atom_type
from ..operators.tiers import PROMOTE_AT


def source(spark: SparkSession, path: str, schema: StructType | str, files: str = "*.parquet", per_trigger: int = 100) -> DataFrame:
    """Files of a folder as a stream; per_trigger bounds a micro-batch, which is the back-pressure."""
    return spark.readStream.schema(schema).option("pathGlobFilter", files).option("maxFilesPerTrigger", per_trigger).parquet(path)


def valid_once(stream: DataFrame, time: str, delay: str = "10 minutes", keys: tuple[str, ...] = ("atom",)) -> DataFrame:
    """Valid atoms of a stream, repeats within the delay dropped; state is bounded by the watermark."""
    return stream.filter(atom_type(F.col("atom")).isNotNull()).withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def counters(stream: DataFrame) -> DataFrame:
    """Accesses and the last access of each atom, to be run in update or complete mode."""
    return stream.groupBy("atom").agg(F.count("*").alias("accesses"), F.max("ts_ms").alias("last_ms"))


def tumbling(stream: DataFrame, time: str, size: str = "1 hour", delay: str = "1 hour", *keys: str) -> DataFrame:
    """Counts and sums of value by window of event time. An extension: the log itself has arrival order only."""
    g = stream.withWatermark(time, delay).groupBy(F.window(time, size), *keys)
    return g.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), *keys, "n", "total")


def sessions(stream: DataFrame, time: str, gap: str, delay: str, *keys: str) -> DataFrame:
    g = stream.withWatermark(time, delay).groupBy(F.session_window(time, gap), *keys)
    return g.agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")


def change_feed(batch: DataFrame) -> DataFrame:
    """A row a version of a batch of mutations: what it added, removed and trained."""
    def atoms(op: str):
        return F.sort_array(F.collect_set(F.when(F.col("op") == op, F.col("atom")))).alias(op.lower())

    return batch.groupBy("version").agg(atoms("ADD"), atoms("TOMBSTONE"), atoms("TRAIN"), F.count("*").alias("mutations"))


_TTL_OUT = "atom string, touched bigint, last_ms bigint, expires_ms bigint, promoted boolean, expired boolean"
_TTL_STATE = "ttl_ms bigint, set_ms bigint, last_ms bigint, touched bigint"


def ttl(stream: DataFrame, time: str, delay: str = "1 minute", grace_ms: int = 30_000, promote_at: int = PROMOTE_AT) -> DataFrame:
    """Times to live as state: rows (atom, kind set | touch, ttl_ms, ts_ms) to each atom's state, and its expiry by timer."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            ttl_ms, _, last, touched = state.get
            state.remove()
            yield pd.DataFrame([(key[0], touched, last, last + ttl_ms, False, True)], columns=["atom", "touched", "last_ms", "expires_ms", "promoted", "expired"])
            return
        ttl_ms, first, last, touched = state.get if state.exists else (None, None, None, 0)
        rows = pd.concat(list(batches)).sort_values("ts_ms", kind="stable")
        for r in rows.itertuples(index=False):
            if r.kind == "set":
                ttl_ms, first, last, touched = int(r.ttl_ms), int(r.ts_ms), int(r.ts_ms), 0
            elif ttl_ms is not None and touched < promote_at and r.ts_ms >= first:
                last, touched = int(r.ts_ms), touched + 1
        if ttl_ms is None:
            return
        promoted = touched >= promote_at
        if promoted:
            state.remove()
        else:
            state.update((ttl_ms, first, last, touched))
            state.setTimeoutTimestamp(max(last + ttl_ms + grace_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(key[0], touched, last, None if promoted else last + ttl_ms, promoted, False)], columns=["atom", "touched", "last_ms", "expires_ms", "promoted", "expired"]).astype({"expires_ms": "Int64"})

    rows = stream.withWatermark(time, delay).select("atom", "kind", "ttl_ms", "ts_ms", time)
    return rows.groupBy("atom").applyInPandasWithState(run, _TTL_OUT, _TTL_STATE, "update", GroupStateTimeout.EventTimeTimeout)


def drain(stream: DataFrame, path: str, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None, name: str | None = None, progress: list | None = None) -> str:
    """Runs a stream over what is there now into a folder, a batch at a time; returns the folder.

    Each batch is written under its number, so a batch that runs again replaces itself: after a crash, the same name
    goes on where the marks say, and nothing is lost or twice. progress gets a record for each batch that had rows.
    """
    own = name or uuid.uuid4().hex
    out, marks = f"{path}/out-{own}", f"{path}/marks-{own}"

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={batch}")
        if each:
            each(df, batch)

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", marks).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    if progress is not None:
        progress += [{"batch": p["batchId"], "rows": p["numInputRows"], "ms": p["batchDuration"]} for p in query.recentProgress if p["numInputRows"]]
    return out


def ingest_statistics(spark: SparkSession, progress: list[dict], out: str) -> DataFrame:
    """One row: rows read and batches of a drained stream, rows that it let through, and those it dropped."""
    read = sum(p["rows"] for p in progress)
    kept = spark.read.parquet(f"{out}/batch=*").agg(F.count("*").alias("kept"))
    return kept.select(F.lit(read).cast("long").alias("read"), "kept", (F.lit(read) - F.col("kept")).alias("dropped"))


def latest(spark: SparkSession, path: str, *keys: str) -> DataFrame:
    """The last update of each key of a drained stream in update mode."""
    rows = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    others = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("r")).select(*keys, "r.*")
