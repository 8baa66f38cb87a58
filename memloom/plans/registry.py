"""Registration of queries with the SQL they are held against, and the views that they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The moment that time-dependent queries are asked at: 2024-02-01 00:00 UTC.
NOW = 1_706_745_600_000
DAY = 86_400_000


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt out over as many tasks as a shuffle has: for small files, where what follows costs far more than reading."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def ntz_millis(ts: Column) -> Column:
    """Milliseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    day = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * DAY
    clock = F.hour(ts) * 3_600_000 + F.minute(ts) * 60_000
    return day + clock + F.floor(F.expr("extract(SECOND FROM ts)") * 1000).cast("long")


# Event types as atoms of five types.
EVENT_KINDS = {"signup": "state", "error": "fact", "purchase": "procedure", "click": "event", "view": "event"}


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, user_id, event_type, value, ts_ms, atom)."""
    kind = F.create_map(*[F.lit(x) for p in EVENT_KINDS.items() for x in p])
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("seq"), "user_id", "event_type", "value", ntz_millis(F.col("ts")).alias("ts_ms"), F.concat(F.lit("v1."), kind[F.col("event_type")], F.lit("."), "event_type").alias("atom"))


EV = """ev AS (SELECT event_id AS seq, user_id, event_type, value, (epoch_us(ts) // 1000)::BIGINT AS ts_ms,
  'v1.' || CASE event_type WHEN 'signup' THEN 'state' WHEN 'error' THEN 'fact' WHEN 'purchase' THEN 'procedure' ELSE 'event' END || '.' || event_type AS atom FROM events)"""
PAIRS = EV + """, lead_rows AS (SELECT user_id, atom AS from_atom, lead(atom) OVER w AS to_atom, lead(ts_ms) OVER w AS ts_ms, lead(seq) OVER w AS seq
  FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts_ms, seq)), pairs AS (SELECT * FROM lead_rows WHERE to_atom IS NOT NULL)"""
EDGES = PAIRS + """, edges AS (SELECT from_atom, to_atom, count(*) AS weight, max(ts_ms) AS updated_ms, min(seq) AS first_seq FROM pairs GROUP BY ALL)"""
HALF = f"""least(604800000.0 * pow(2.0, least(0.1 * accesses + 0.15 * passes + 0.3 * CASE split_part(a, '.', 2) WHEN 'procedure' THEN 1 WHEN 'state' THEN -1 WHEN 'event' THEN -1 WHEN 'other' THEN -0.5 ELSE 0 END
  + 0.4 * CASE WHEN a LIKE '%\\_src\\_human' ESCAPE '\\' THEN 1 WHEN a LIKE '%\\_src\\_test' ESCAPE '\\' THEN 0 WHEN a LIKE '%\\_src\\_research' ESCAPE '\\' THEN -0.5 ELSE -1 END, 1000)), {90.0 * DAY})"""
