"""Queries that run as streams over the events, held against the same answers in batch."""

from __future__ import annotations

import uuid

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.wordpiece import embed_documents
from ..operators import commitments as V
from ..operators import edges as E
from ..operators import ppm as P
from ..operators.storage import shared_folder
from ..sources import generators as G
from ..streaming import feeds as S
from .registry import DAY, EV, events, ntz_millis, query, table


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/streams"


def _stream(spark: SparkSession, d: str) -> DataFrame:
    schema = table(spark, d, "events").schema
    rows = S.source(spark, d, schema, "events.parquet")
    return rows.select(F.concat(F.lit("v1.event."), "event_type").alias("atom"), "event_type", "user_id", "value", F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("time"), ntz_millis(F.col("ts")).alias("ts_ms"))


@query(f"WITH {EV} SELECT 'v1.event.' || event_type AS atom, count(*) AS accesses, max(ts_ms) AS last_ms FROM ev GROUP BY 1")
def stream_access_counters(spark, d):
    out = S.drain(S.counters(_stream(spark, d)), _folder(spark), "update")
    return S.latest(spark, out, "atom")


@query(f"WITH {EV} SELECT ts_ms // 3600000 * 3600000 AS start_ms, event_type, count(*) AS n, round(sum(value), 6) AS total FROM ev GROUP BY ALL")
def stream_hourly_windows(spark, d):
    stream = _stream(spark, d).withColumn("time", F.timestamp_millis("ts_ms"))
    out = S.drain(S.tumbling(stream, "time", "1 hour", "1 hour", "event_type"), _folder(spark), "update")
    rows = S.latest(spark, out, "start", "event_type")
    return rows.select(F.unix_millis("start").alias("start_ms"), "event_type", "n", F.round("total", 6).alias("total"))


@query(f"WITH {EV} SELECT DISTINCT 'v1.other.user_' || user_id AS atom FROM ev")
def stream_ingest(spark, d):
    stream = _stream(spark, d).withColumn("atom", F.concat(F.lit("v1.other.user_"), "user_id"))
    out = S.drain(S.valid_once(stream, "time", "60 days"), _folder(spark))
    return spark.read.parquet(f"{out}/batch=*").select("atom")


@query(f"""WITH {EV}, log AS (SELECT seq // 100 AS version, CASE WHEN event_type = 'purchase' THEN 'TOMBSTONE' ELSE 'ADD' END AS op, atom FROM ev)
SELECT version, count(*) AS mutations, coalesce(array_to_string(list_sort(list(DISTINCT atom) FILTER (WHERE op = 'ADD')), ','), '') AS added, coalesce(array_to_string(list_sort(list(DISTINCT atom) FILTER (WHERE op = 'TOMBSTONE')), ','), '') AS removed FROM log GROUP BY version""")
def change_feed(spark, d):
    log = events(spark, d).select(F.floor(F.col("seq") / 100).alias("version"), F.when(F.col("event_type") == "purchase", "TOMBSTONE").otherwise("ADD").alias("op"), "atom")
    return S.change_feed(log).select("version", "mutations", F.array_join("add", ",").alias("added"), F.array_join("tombstone", ",").alias("removed"))


_TTL = f"""WITH {EV}, en AS (SELECT user_id, 'u' || user_id AS atom, min(seq) AS s, min(ts_ms) AS set_ms FROM ev GROUP BY 1), tc AS (SELECT user_id, ts_ms, row_number() OVER (PARTITION BY user_id ORDER BY ts_ms, seq) AS k FROM ev WHERE event_type = 'purchase' AND seq % 7 = 0)
SELECT en.atom, count(k) AS touched, coalesce(max(ts_ms), any_value(set_ms)) AS last_ms, count(k) >= 3 AS promoted FROM en LEFT JOIN tc ON en.user_id = tc.user_id AND k <= 3 GROUP BY en.atom"""


@query(_TTL)
def stream_ttl(spark, d):
    """Entries are set at each user's first event and touched by some purchases."""
    first = table(spark, d, "events").groupBy("user_id").agg(F.min(ntz_millis(F.col("ts"))).alias("set_ms"))
    rows = _stream(spark, d).join(first, "user_id")
    sets = F.when(F.col("ts_ms") == F.col("set_ms"), "set")
    touch = F.when((F.col("event_type") == "purchase") & (F.col("seq") % 7 == 0), "touch")
    kinds = rows.withColumn("kind", F.explode(F.array_compact(F.array(sets, touch)))).select(F.concat(F.lit("u"), "user_id").alias("atom"), "kind", F.lit(400 * DAY).alias("ttl_ms"), "ts_ms", "time")
    out = S.drain(S.ttl(kinds, "time"), _folder(spark), "update")
    return S.latest(spark, out, "atom").select("atom", "touched", "last_ms", "promoted")


@query(f"WITH {EV} SELECT count(*) AS read, count(DISTINCT user_id) AS kept, count(*) - count(DISTINCT user_id) AS dropped FROM ev")
def ingest_statistics(spark, d):
    """Rows that a stream read, those it let through once, and those it dropped, from the batches' own progress."""
    stream, progress = _stream(spark, d).withColumn("atom", F.concat(F.lit("v1.other.user_"), "user_id")), []
    out = S.drain(S.valid_once(stream, "time", "60 days"), _folder(spark), progress=progress)
    return S.ingest_statistics(spark, progress, out)


@query(f"WITH {EV} SELECT 'v1.event.' || event_type AS atom, count(*) AS n FROM ev GROUP BY 1")
def stream_recovery(spark, d):
    """A stream that is killed after it wrote a batch, before the batch was marked as done, and goes on: every row once."""
    folder, name, runs = _folder(spark), uuid.uuid4().hex, []

    def fail_once(df: DataFrame, batch: int) -> None:
        runs.append(batch)
        if len(runs) == 1:
            raise RuntimeError("killed")

    for _ in range(2):
        try:
            out = S.drain(_stream(spark, d).select("atom", "seq"), folder, each=fail_once, name=name)
        except StreamingQueryException:
            continue
    return spark.read.parquet(f"{out}/batch=*").groupBy("atom").agg(F.count("*").alias("n"))


# -- operators that SQL cannot express: tests hold them against plain Python ---------------------------


@query()
def commitment_root(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("idx"), F.sha2(F.col("s_name").cast("binary"), 256).alias("hash"))
    return V.tree(s)[-1].select("commitment")


@query()
def commitment_proofs(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("idx"), F.sha2(F.col("n_name").cast("binary"), 256).alias("hash"))
    return V.verify(V.proofs(V.tree(n), n))


@query()
def random_walk_edges(spark, d):
    chain = {"v1.other.a": [("v1.other.b", 0.75), ("v1.other.c", 0.25)], "v1.other.b": [("v1.other.c", 1.0)], "v1.other.c": [("v1.other.a", 1.0)]}
    rows = G.sequences(spark, G.random_walks(chain, 200, 8))
    return E.top_edge(E.edge_weights(E.transitions(rows, "seq_id", "pos")))


@query()
def ppm_pruned(spark, d):
    nodes = P.path_counts(events(spark, d), "user_id", "ts_ms", "seq")
    return P.prune(nodes, 300).select(F.array_join("path", ">").alias("path"), "depth", "count")


@query()
def wordpiece_embeddings(spark, d):
    pieces = ["the", "and", "th", "an", *"abcdefghijklmnopqrstuvwxyz", *("##" + c for c in "abcdefghijklmnopqrstuvwxyz")]
    vocab = {p: [float((7 * i + 3 * k) % 11 - 5) for k in range(16)] for i, p in enumerate(pieces)}
    dims, read = G.read_vocabulary(G.write_vocabulary(vocab))
    return embed_documents(table(spark, d, "part").select("p_partkey", "p_name"), "p_partkey", "p_name", read, dims)
