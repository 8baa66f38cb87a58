"""Queries over retention, model fitting, statistics, audit and windows of the events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import retention as R
from ..operators import learning as G
from ..operators import measures as S
from ..operators import tiers as Z
from .registry import DAY, EV, HALF, NOW, events, query, table

_AT = NOW - 2 * DAY
_FEATURES = f"""f AS (SELECT 'v1.' || (['fact','event','relation','state','procedure','other'])[user_id % 6 + 1] || '.u' || user_id || CASE WHEN user_id % 4 = 0 THEN '_src_human' ELSE '' END AS atom,
 count(*) FILTER (WHERE event_type <> 'click') / 10.0 AS accesses, count(*) FILTER (WHERE event_type = 'click') / 10.0 AS passes, max(ts_ms) AS last_ms FROM ev WHERE ts_ms <= {{0}} GROUP BY user_id)"""
_TIER = """CASE WHEN since IS NULL OR since > 2592000000 THEN 'cold' WHEN half_life > 1209600000 AND since > 86400000 THEN 'cold' WHEN half_life < 259200000 AND since <= 86400000 THEN 'hot' ELSE 'warm' END"""


def _features(spark: SparkSession, d: str, upto: int) -> DataFrame:
    kinds = F.array(*[F.lit(t) for t in ("fact", "event", "relation", "state", "procedure", "other")])
    u = F.col("user_id")
    atom = F.concat(F.lit("v1."), F.element_at(kinds, (u % 6 + 1).cast("int")), F.lit(".u"), u, F.when(u % 4 == 0, "_src_human").otherwise(""))
    click = (F.col("event_type") == "click").cast("int")
    return events(spark, d).filter(F.col("ts_ms") <= upto).groupBy(atom.alias("atom")).agg((F.sum(1 - click) / 10).alias("accesses"), (F.sum(click) / 10).alias("passes"), F.max("ts_ms").alias("last_ms"))


def _tier_sql(upto: int) -> str:
    half = HALF.replace("split_part(a,", "split_part(atom,").replace("WHEN a LIKE", "WHEN atom LIKE")
    return f"WITH {EV}, {_FEATURES.format(upto)}, c AS (SELECT *, {half} AS half_life, {upto} - last_ms AS since FROM f), t AS (SELECT *, {_TIER} AS tier FROM c)"


def _tiers(spark: SparkSession, d: str, upto: int) -> DataFrame:
    return Z.classify(_features(spark, d, upto), upto)


@query(_tier_sql(_AT) + " SELECT atom, round(half_life, 3) AS half_life, tier FROM t")
def tier_classify(spark, d):
    return _tiers(spark, d, _AT).select("atom", F.round("half_life", 3).alias("half_life"), "tier")


@query(_tier_sql(_AT) + " SELECT count(*) FILTER (WHERE tier = 'hot') AS hot, count(*) FILTER (WHERE tier = 'warm') AS warm, count(*) FILTER (WHERE tier = 'cold') AS cold, count(*) AS total FROM t")
def tier_summary(spark, d):
    return Z.summary(_tiers(spark, d, _AT))


@query(_tier_sql(_AT) + " SELECT atom, round(half_life, 3) AS half_life FROM t WHERE tier = 'hot' ORDER BY t.half_life, atom LIMIT 5")
def replay_candidates(spark, d):
    return Z.replay_candidates(_tiers(spark, d, _AT), 5).select("atom", F.round("half_life", 3).alias("half_life"))


@query(_tier_sql(_AT) + f""", f2 AS (SELECT atom, tier FROM t), {_tier_sql(NOW - 9 * DAY)[len('WITH ' + EV) + 2:].replace('f AS', 'fb AS', 1).replace('FROM f)', 'FROM fb)').replace('c AS (', 'cb AS (').replace('FROM c)', 'FROM cb)').replace('t AS (', 'tb AS (')}
SELECT f2.atom, tb.tier AS was, f2.tier AS "is", CASE WHEN tb.tier = 'cold' THEN 'promotion' ELSE 'demotion' END AS move FROM f2 JOIN tb ON f2.atom = tb.atom
WHERE (tb.tier = 'cold' AND f2.tier <> 'cold') OR (tb.tier = 'hot' AND f2.tier <> 'hot') OR (tb.tier = 'warm' AND f2.tier = 'cold')""")
def tier_moves(spark, d):
    return Z.moves(_tiers(spark, d, NOW - 9 * DAY), _tiers(spark, d, _AT))


@query(f"WITH {EV} SELECT user_id, round(least(1 + count(*) / 10.0, 90) * {DAY}, 3)::DOUBLE AS half_life FROM ev GROUP BY user_id")
def simple_half_life(spark, d):
    return events(spark, d).groupBy("user_id").agg(F.count("*").alias("n")).select("user_id", F.round(R.simple_half_life(F.col("n")), 3).alias("half_life"))


_TTL = f"""WITH {EV}, en AS (SELECT 'u' || user_id AS atom, (user_id % 9 + 1) * {2 * DAY} AS ttl_ms, min(ts_ms) AS set_ms FROM ev GROUP BY user_id),
tc AS (SELECT 'u' || user_id AS atom, ts_ms, row_number() OVER (PARTITION BY user_id ORDER BY ts_ms, seq) AS k FROM ev WHERE event_type = 'purchase' AND seq % 7 = 0),
g AS (SELECT atom, count(*) AS touched, max(ts_ms) AS last FROM tc WHERE k <= 3 GROUP BY atom),
s AS (SELECT en.atom, coalesce(touched, 0) AS touched, coalesce(last, set_ms) AS last_ms, ttl_ms FROM en LEFT JOIN g USING (atom))"""


def _ttl(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumn("name", F.concat(F.lit("u"), "user_id"))
    entries = e.groupBy(F.col("name").alias("atom"), ((F.col("user_id") % 9 + 1) * 2 * DAY).alias("ttl_ms")).agg(F.min("ts_ms").alias("set_ms"))
    touches = e.filter("event_type = 'purchase' and seq % 7 = 0").select(F.col("name").alias("atom"), "ts_ms")
    return Z.ttl_state(entries, touches, NOW)


@query(_TTL + f" SELECT atom, touched, last_ms, CASE WHEN touched < 3 THEN last_ms + ttl_ms END AS expires_ms, touched >= 3 AS promoted, touched < 3 AND last_ms + ttl_ms + 30000 <= {NOW} AS expired FROM s")
def ttl_state(spark, d):
    return _ttl(spark, d)


@query(_TTL + f" SELECT atom FROM s WHERE touched < 3 AND last_ms + ttl_ms + 30000 <= {NOW}")
def ttl_expired(spark, d):
    return _ttl(spark, d).filter("expired").select("atom")


# -- model fitting ---------------------------------------------------------------------------------
_LOGX = EV + """, lg AS (SELECT seq, 'v1.procedure.u' || user_id || CASE WHEN user_id % 3 = 0 THEN '_src_test' ELSE '' END AS atom, CASE WHEN event_type IN ('click', 'signup') THEN 'train' ELSE 'access' END AS kind, ts_ms FROM ev),
run AS (SELECT *, count(*) FILTER (WHERE kind = 'access') OVER w AS accesses, count(*) FILTER (WHERE kind = 'train') OVER w AS trainings FROM lg WINDOW w AS (PARTITION BY atom ORDER BY ts_ms RANGE UNBOUNDED PRECEDING)),
ex AS (SELECT * FROM (SELECT atom, ts_ms, accesses, trainings, lead(ts_ms) OVER (PARTITION BY atom ORDER BY ts_ms) - ts_ms AS interval_ms FROM run WHERE kind = 'access') WHERE interval_ms > 0),
pr AS (SELECT *, 604800000.0 * pow(2.0, greatest(-20, least(20, 0.1 * ln(1 + accesses) + 0.15 * ln(1 + trainings) + 0.3 * 1 + 0.4 * CASE WHEN atom LIKE '%test' THEN 0 ELSE -1 END))) AS pred FROM ex)"""
_THETA = list(R.THETA.values())


def _log(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("user_id")
    atom = F.concat(F.lit("v1.procedure.u"), u, F.when(u % 3 == 0, "_src_test").otherwise(""))
    return events(spark, d).select("seq", atom.alias("atom"), F.when(F.col("event_type").isin("click", "signup"), "train").otherwise("access").alias("kind"), "ts_ms")


@query(f"WITH {_LOGX} SELECT atom, ts_ms, accesses, trainings, interval_ms FROM ex")
def hlr_examples(spark, d):
    return G.examples(_log(spark, d))


@query(f"WITH {_LOGX} SELECT round(avg(pow(ln(pred) - ln(interval_ms), 2)), 6) AS loss, count(*) AS n FROM pr")
def hlr_loss(spark, d):
    return G.loss(G.examples(_log(spark, d)), _THETA).select(F.round("loss", 6).alias("loss"), "n")


@query(f"WITH {_LOGX}, n AS (SELECT *, row_number() OVER (ORDER BY atom, ts_ms) AS i FROM pr) SELECT round(avg(((a.pred > b.pred) = (a.interval_ms > b.interval_ms))::INT), 9) AS accuracy, count(*) AS pairs FROM n a JOIN n b ON b.i > a.i AND b.i < a.i + 10")
def hlr_pairwise(spark, d):
    return G.pairwise_accuracy(G.examples(_log(spark, d)), _THETA, ["atom", "ts_ms"]).select(F.round("accuracy", 9).alias("accuracy"), "pairs")


@query(f"WITH {_LOGX}, gp AS (SELECT ts_ms - lag(ts_ms) OVER (PARTITION BY atom ORDER BY ts_ms) AS gap FROM lg WHERE kind = 'train'), o AS (SELECT gap, row_number() OVER (ORDER BY gap) - 1 AS i, count(*) OVER () AS n FROM gp WHERE gap > 0 AND gap < 600000) SELECT coalesce(least(greatest(min(gap), 30000), 1800000), 300000)::BIGINT AS tau_ms FROM o WHERE i = floor(n * 0.75)")
def stdp_tau(spark, d):
    return G.spike_tau(_log(spark, d))


# -- statistics ------------------------------------------------------------------------------------
@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY event_type")
def latency_percentiles(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(*S.nearest_rank("value", 50, 95, 99))


_BOUNDS = [1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0]


@query("""WITH b AS (SELECT unnest([0,1,2,3,4,5,6,7]) AS bucket, unnest([1.0,5.0,10.0,25.0,50.0,100.0,250.0,NULL]::DOUBLE[]) AS upper), c AS (SELECT CASE WHEN value <= 1 THEN 0 WHEN value <= 5 THEN 1 WHEN value <= 10 THEN 2 WHEN value <= 25 THEN 3 WHEN value <= 50 THEN 4 WHEN value <= 100 THEN 5 WHEN value <= 250 THEN 6 ELSE 7 END AS bucket, count(*) AS n FROM events GROUP BY 1)
SELECT b.bucket, upper, coalesce(n, 0) AS n FROM b LEFT JOIN c ON b.bucket = c.bucket""")
def latency_histogram(spark, d):
    return S.histogram(table(spark, d, "events"), "value", _BOUNDS)


@query("SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value) / avg(value), 6) AS cv, round(stddev_samp(value), 6) AS sample_std FROM events GROUP BY event_type")
def latency_cv(spark, d):
    v = F.col("value")
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_pop(v) / F.avg(v), 6).alias("cv"), F.round(F.stddev_samp(v), 6).alias("sample_std"))


_T = "CASE " + " ".join(f"WHEN {{0}} <= {(a + b) / 2} THEN {S.T_TABLE[a]}" for a, b in zip(sorted(S.T_TABLE), sorted(S.T_TABLE)[1:])) + " ELSE 1.980 END"


@query(f"WITH g AS (SELECT user_id, count(value) AS n, avg(value) AS m, stddev_samp(value) AS s FROM events GROUP BY user_id HAVING count(value) >= 2) SELECT user_id, n, round(m, 6) AS mean, round(m - {_T.format('(n - 1)')} * s / sqrt(n), 6) AS low, round(m + {_T.format('(n - 1)')} * s / sqrt(n), 6) AS high FROM g")
def ci95(spark, d):
    r = S.interval95(table(spark, d, "events"), "user_id", "value")
    return r.select("user_id", "n", *[F.round(c, 6).alias(c) for c in ("mean", "low", "high")])


_TWO = "two AS (SELECT count(value) FILTER (WHERE event_type = 'click') AS nx, count(value) FILTER (WHERE event_type = 'view') AS ny, avg(value) FILTER (WHERE event_type = 'click') AS mx, avg(value) FILTER (WHERE event_type = 'view') AS my, var_samp(value) FILTER (WHERE event_type = 'click') AS vx, var_samp(value) FILTER (WHERE event_type = 'view') AS vy FROM events)"


@query(f"WITH {_TWO}, t AS (SELECT (mx - my) / sqrt(vx / nx + vy / ny) AS t, floor(pow(vx / nx + vy / ny, 2) / (pow(vx / nx, 2) / (nx - 1) + pow(vy / ny, 2) / (ny - 1))) AS df FROM two) SELECT round(t, 3) AS t, CASE WHEN abs(t) > 1.15 * {_T.format('df')} THEN 'p<0.01' WHEN abs(t) > {_T.format('df')} THEN 'p<0.05' ELSE 'not significant' END AS p FROM t")
def welch_t(spark, d):
    return S.welch(table(spark, d, "events"), "event_type", "value", "click", "view")


@query(f"WITH {_TWO}, c AS (SELECT (mx - my) / sqrt(((nx - 1) * vx + (ny - 1) * vy) / (nx + ny - 2)) AS d FROM two) SELECT round(d, 6) AS d, CASE WHEN abs(d) < 0.2 THEN 'negligible' WHEN abs(d) < 0.5 THEN 'small' WHEN abs(d) < 0.8 THEN 'medium' ELSE 'large' END AS effect FROM c")
def cohens_d(spark, d):
    return S.cohens_d(table(spark, d, "events"), "event_type", "value", "click", "view")


@query("""WITH m AS (SELECT event_type AS metric, avg(value) FILTER (WHERE event_id % 2 = 0) AS b, avg(value) FILTER (WHERE event_id % 2 = 1) AS n FROM events GROUP BY 1)
SELECT metric, round(b, 6) AS before, round(n, 6) AS now, round((n - b) / b, 6) AS delta, CASE WHEN metric = 'error' THEN (n - b) / b > 0.01 ELSE (n - b) / b < -0.01 END AS regressed FROM m""")
def metric_regression(spark, d):
    e = table(spark, d, "events")
    half = lambda k: e.filter(F.col("event_id") % 2 == k).groupBy(F.col("event_type").alias("metric")).agg(F.avg("value").alias("value"))
    r = S.compare(half(0), half(1), 0.01, F.col("metric") == "error")
    return r.select("metric", *[F.round(c, 6).alias(c) for c in ("before", "now", "delta")], "regressed")


@query("SELECT event_type, quantile_disc(value, 0.95) <= 250 AS access_ok, quantile_disc(value, 0.95) <= 750 AS context_ok FROM events GROUP BY 1")
def slo_eval(spark, d):
    p = latency_percentiles(spark, d)
    return p.select("event_type", (F.col("p95") <= 250).alias("access_ok"), (F.col("p95") <= 750).alias("context_ok"))


@query("""WITH e AS (SELECT conv_id, bool_or(contains(lower(text), 'the')) AS a, bool_or(contains(lower(text), 'and')) AS b, bool_or(contains(lower(text), 'zzz')) AS c FROM conversations GROUP BY 1) SELECT conv_id, round((a::INT + b::INT + c::INT) / 3, 9) AS utility FROM e""")
def pilot_utility(spark, d):
    low = F.lower("text")
    marks = [F.max(F.contains(low, F.lit(w)).cast("int")).alias(w) for w in ("the", "and", "zzz")]
    return table(spark, d, "conversations").groupBy("conv_id").agg(*marks).select("conv_id", F.round((F.col("the") + F.col("and") + F.col("zzz")) / 3, 9).alias("utility"))


# -- audit, logs and counters ------------------------------------------------------------------------
@query(f"WITH {EV} SELECT seq AS id, event_type AS event, ts_ms FROM ev WHERE ts_ms >= {NOW - 10 * DAY} AND event_type = 'error' ORDER BY seq DESC LIMIT 100")
def audit_tail(spark, d):
    return events(spark, d).filter((F.col("ts_ms") >= NOW - 10 * DAY) & (F.col("event_type") == "error")).orderBy(F.desc("seq")).limit(100).select(F.col("seq").alias("id"), F.col("event_type").alias("event"), "ts_ms")


@query(f"WITH {EV} SELECT seq, atom, ts_ms FROM ev WHERE ts_ms BETWEEN {NOW - 12 * DAY} AND {NOW - 11 * DAY}")
def access_log_range(spark, d):
    return events(spark, d).filter(F.col("ts_ms").between(NOW - 12 * DAY, NOW - 11 * DAY)).select("seq", "atom", "ts_ms")


@query(f"WITH {EV} SELECT seq, atom FROM (SELECT seq, atom, row_number() OVER (PARTITION BY atom ORDER BY seq DESC) AS n FROM ev) WHERE n <= 100")
def fifo_keep(spark, d):
    w = Window.partitionBy("atom").orderBy(F.desc("seq"))
    return events(spark, d).withColumn("n", F.row_number().over(w)).filter("n <= 100").select("seq", "atom")


@query(f"WITH {EV} SELECT atom, user_id, count(*) AS accesses, max(ts_ms) AS last_ms FROM ev GROUP BY ALL")
def access_counters(spark, d):
    return events(spark, d).groupBy("atom", "user_id").agg(F.count("*").alias("accesses"), F.max("ts_ms").alias("last_ms"))


@query(f"WITH {EV}, r AS (SELECT user_id, atom, row_number() OVER (PARTITION BY user_id ORDER BY ts_ms DESC, seq DESC) AS n FROM ev) SELECT user_id, string_agg(atom, '>' ORDER BY n DESC) AS history FROM r WHERE n <= 4 GROUP BY user_id")
def access_history(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts_ms"), F.desc("seq"))
    last = events(spark, d).withColumn("n", F.row_number().over(w)).filter("n <= 4")
    return last.groupBy("user_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("o"), "atom"))), lambda x: x["atom"]), ">").alias("history"))


@query(f"WITH {EV} SELECT ts_ms // 3600000 AS hour, event_type, count(*) AS n, round(sum(value), 6) AS total FROM ev GROUP BY ALL")
def hourly_windows(spark, d):
    return events(spark, d).groupBy(F.floor(F.col("ts_ms") / 3_600_000).alias("hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


# -- codes, parsers, reports -------------------------------------------------------------------------
@query(_tier_sql(_AT) + " SELECT atom, substr(tier, 1, 1) AS code, tier AS again FROM t")
def tier_codes(spark, d):
    t = _tiers(spark, d, _AT).withColumn("code", R.encode_tier(F.col("tier")))
    return t.select("atom", "code", R.decode_tier(F.col("code")).alias("again"))


@query("SELECT c_custkey, 'tier:' || lpad(c_custkey::VARCHAR, 10, '0') AS key, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey / 4.0 END AS access, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 1.5 END AS training, NULL::DOUBLE AS type FROM customer")
def theta_parse(spark, d):
    k = F.col("c_custkey")
    text = F.concat_ws(",", F.when(k % 3 == 0, F.lit("access:none")).otherwise(F.concat(F.lit("access:"), k / 4)), F.when(k % 5 == 0, F.lit("training")).otherwise(F.lit("training:1.5")))
    t = R.parse_theta(text)
    return table(spark, d, "customer").select("c_custkey", R.tier_key(k).alias("key"), t["access"].alias("access"), t["training"].alias("training"), t["type"].alias("type"))


@query(f"""WITH {EV} SELECT count(*) AS operations, count(DISTINCT event_type) AS kinds, round(count(*) / greatest((max(ts_ms) - min(ts_ms)) / 1000, 0.001), 9) AS per_second,
quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, round(avg(value), 6) AS mean, round(stddev_pop(value) / avg(value), 6) AS cv FROM ev""")
def run_report(spark, d):
    return S.report(events(spark, d), "event_type", "value", "ts_ms")


@query("SELECT 'memory_events_total{event_type=\"' || event_type || '\"} ' || count(*) AS line FROM events GROUP BY event_type")
def metrics_text(spark, d):
    return S.exposition(table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n")), "memory_events_total", ["event_type"], "n")
