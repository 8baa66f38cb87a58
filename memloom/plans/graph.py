"""Queries over the transition graph of the events, baskets and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import retention as R
from ..functions.atoms import atom_type
from ..operators import edges as E
from ..operators import ppm as P
from .registry import EDGES, EV, HALF, NOW, PAIRS, events, query, table


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return E.transitions(events(spark, d), "user_id", "ts_ms", "seq")


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return E.edge_weights(_pairs(spark, d))


@query(f"WITH {EDGES} SELECT * FROM edges")
def edge_weights(spark, d):
    return _edges(spark, d)


@query(f"""WITH {EDGES}, r AS (SELECT *, row_number() OVER (PARTITION BY from_atom ORDER BY weight DESC, first_seq) AS n,
  sum(weight) OVER (PARTITION BY from_atom) AS total, count(*) OVER (PARTITION BY from_atom) AS edges FROM edges)
SELECT from_atom, to_atom, weight, total::BIGINT AS total, edges, round(weight / total, 9) AS dominance FROM r WHERE n = 1""")
def edge_top1(spark, d):
    return E.top_edge(_edges(spark, d)).withColumn("dominance", F.round(F.col("weight") / F.col("total"), 9))


@query(f"WITH {EDGES} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY from_atom ORDER BY weight DESC, first_seq) AS rank FROM edges) WHERE rank <= 3")
def edge_topk(spark, d):
    return E.top_edges(_edges(spark, d), 3)


@query(f"WITH {EDGES} SELECT from_atom, max(weight) AS top_weight, sum(weight)::BIGINT AS total, count(*) AS edges, round(max(weight) / sum(weight), 9) AS dominance FROM edges GROUP BY from_atom")
def edge_dominance(spark, d):
    g = _edges(spark, d).groupBy("from_atom").agg(F.max("weight").alias("top_weight"), F.sum("weight").alias("total"), F.count("*").alias("edges"))
    return g.withColumn("dominance", F.round(F.col("top_weight") / F.col("total"), 9))


@query(f"WITH {EDGES} SELECT split_part(from_atom, '.', 2) AS from_type, split_part(to_atom, '.', 2) AS to_type, count(*) AS edges, sum(weight)::BIGINT AS transitions FROM edges GROUP BY 1, 2")
def edge_type_pairs(spark, d):
    return _edges(spark, d).groupBy(atom_type(F.col("from_atom")).alias("from_type"), atom_type(F.col("to_atom")).alias("to_type")).agg(F.count("*").alias("edges"), F.sum("weight").alias("transitions"))


@query(f"WITH {EDGES} SELECT count(DISTINCT from_atom) AS trained_atoms, count(*) AS total_edges FROM edges")
def cluster_stats(spark, d):
    return _edges(spark, d).agg(F.countDistinct("from_atom").alias("trained_atoms"), F.count("*").alias("total_edges"))


_EFFECTIVE = f"""WITH {EDGES}, acc AS (SELECT atom, count(*) AS accesses FROM ev WHERE ts_ms >= {NOW - 4 * R.DAY} GROUP BY atom),
f AS (SELECT from_atom AS a, sum(weight) AS passes FROM edges GROUP BY 1),
h AS (SELECT a, {HALF} AS half_life FROM (SELECT f.a, f.passes * 0.001 AS passes, coalesce(acc.accesses, 0) * 0.001 AS accesses FROM f LEFT JOIN acc ON f.a = acc.atom))"""


@query(_EFFECTIVE + f" SELECT from_atom, to_atom, weight, round(half_life, 3) AS half_life, round(weight * pow(0.5, greatest(0, {NOW} - updated_ms) / half_life), 6) AS effective FROM edges JOIN h ON from_atom = a")
def edge_effective_hlr(spark, d):
    e = _edges(spark, d)
    f = E.source_features(e, events(spark, d).filter(F.col("ts_ms") >= NOW - 4 * R.DAY).groupBy("atom").agg(F.count("*").alias("accesses")))
    a = F.col("from_atom")
    half = R.half_life(F.col("accesses") * 0.001, F.col("passes") * 0.001, atom_type(a), R.provenance(a))
    out = e.join(f, "from_atom").withColumn("half_life", half)
    eff = R.decayed(F.col("weight"), F.lit(NOW) - F.col("updated_ms"), F.col("half_life"))
    return out.select("from_atom", "to_atom", "weight", F.round("half_life", 3).alias("half_life"), F.round(eff, 6).alias("effective"))


_GLOBAL = f"pow(0.5, greatest(0, {NOW} - updated_ms) / {2.0 * R.DAY})"


@query(f"WITH {EDGES} SELECT from_atom, to_atom, round(weight * {_GLOBAL}, 6) AS effective FROM edges")
def edge_effective_global(spark, d):
    return E.effective_weights(_edges(spark, d), NOW, half_life_ms=2.0 * R.DAY).select("from_atom", "to_atom", F.round("effective", 6).alias("effective"))


@query(f"WITH {PAIRS}, e AS (SELECT user_id || ':' || from_atom AS from_atom, to_atom, count(*) AS weight, max(ts_ms) AS updated_ms FROM pairs GROUP BY ALL) SELECT from_atom, to_atom, weight FROM e WHERE NOT ({NOW} - updated_ms >= {10 * R.DAY} AND weight * {_GLOBAL} < 0.1)")
def edge_prune(spark, d):
    pairs = _pairs(spark, d).withColumn("from_atom", F.concat_ws(":", "user_id", "from_atom"))
    e = E.effective_weights(E.edge_weights(pairs), NOW, half_life_ms=2.0 * R.DAY)
    return E.prune(e, NOW, 10 * R.DAY).select("from_atom", "to_atom", "weight")


@query(f"WITH {PAIRS}, e AS (SELECT user_id, from_atom, to_atom, count(*) * 0.25 AS weight FROM pairs GROUP BY ALL) SELECT user_id, from_atom, to_atom, round(weight, 6)::DOUBLE AS weight FROM e WHERE weight >= 0.5")
def edge_decay_global(spark, d):
    e = _pairs(spark, d).groupBy("user_id", "from_atom", "to_atom").agg(F.count("*").alias("weight"))
    return E.decay_all(e, 0.25, 0.5).withColumn("weight", F.round(F.col("weight").cast("double"), 6))


@query(f"""WITH {PAIRS}, dt AS (SELECT *, coalesce(ts_ms - lag(ts_ms) OVER (PARTITION BY from_atom ORDER BY ts_ms, seq), 0) AS dt FROM pairs)
SELECT from_atom, to_atom, sum(greatest(1, round(1000 * exp(-greatest(dt, 0) / 300000.0))))::BIGINT AS weight, max(ts_ms) AS updated_ms, min(seq) AS first_seq FROM dt GROUP BY 1, 2""")
def edge_stdp(spark, d):
    return E.spike_weights(_pairs(spark, d), 300_000.0)


@query(f"""WITH {PAIRS}, a AS (SELECT from_atom, to_atom, count(*) AS w FROM pairs WHERE user_id % 3 = 0 GROUP BY ALL), b AS (SELECT from_atom, to_atom, count(*) AS w FROM pairs WHERE user_id % 3 <> 0 AND to_atom <> 'v1.event.view' GROUP BY ALL)
SELECT coalesce(a.from_atom, b.from_atom) AS from_atom, coalesce(a.to_atom, b.to_atom) AS to_atom, (coalesce(a.w, 0) + coalesce(b.w, 0))::BIGINT AS weight FROM a FULL JOIN b ON a.from_atom = b.from_atom AND a.to_atom = b.to_atom""")
def edge_merge(spark, d):
    """The graphs of two groups of users; one of them has no edges to views."""
    pairs = _pairs(spark, d)
    return E.merge(E.edge_weights(pairs.filter("user_id % 3 = 0")), E.edge_weights(pairs.filter("user_id % 3 <> 0 and to_atom <> 'v1.event.view'")))


_POLICY = {"event": ["state", "fact"], "state": ["procedure"], "fact": []}


@query(f"""WITH {EDGES}, t AS (SELECT *, split_part(from_atom, '.', 2) AS ft, split_part(to_atom, '.', 2) AS tt FROM edges),
m AS (SELECT *, CASE ft WHEN 'event' THEN tt IN ('state', 'fact') WHEN 'state' THEN tt = 'procedure' WHEN 'fact' THEN false ELSE true END AS ok FROM t),
o AS (SELECT from_atom, to_atom AS best_overall FROM (SELECT *, row_number() OVER (PARTITION BY from_atom ORDER BY weight DESC, first_seq) AS n FROM m) WHERE n = 1),
p AS (SELECT from_atom, to_atom AS best_allowed FROM (SELECT *, row_number() OVER (PARTITION BY from_atom ORDER BY weight DESC, first_seq) AS n FROM m WHERE ok) WHERE n = 1)
SELECT from_atom, best_overall, best_allowed, best_overall IS DISTINCT FROM best_allowed AS filtered FROM o LEFT JOIN p USING (from_atom)""")
def policy_top1(spark, d):
    return E.policy_top(_edges(spark, d), _POLICY)


@query(f"""WITH {EDGES}, a AS (SELECT atom, min(seq) AS seq FROM ev GROUP BY atom), s AS (SELECT to_atom AS atom, sum(weight)::BIGINT AS score FROM edges WHERE to_atom <> 'v1.event.view' GROUP BY 1)
SELECT atom_type, atom, score FROM (SELECT split_part(a.atom, '.', 2) AS atom_type, a.atom, coalesce(score, 0) AS score, row_number() OVER (PARTITION BY split_part(a.atom, '.', 2) ORDER BY coalesce(score, 0) DESC, seq) AS n FROM a LEFT JOIN s ON a.atom = s.atom) WHERE n = 1""")
def best_atom_of_type(spark, d):
    atoms = events(spark, d).groupBy("atom").agg(F.min("seq").alias("seq")).withColumn("atom_type", atom_type(F.col("atom"))).withColumn("status", F.lit("active"))
    return E.best_of_type(_edges(spark, d).filter("to_atom <> 'v1.event.view'"), atoms)


@query("""WITH p AS (SELECT 'v1.other.part_' || l_partkey AS from_atom, 'v1.other.part_' || lead(l_partkey) OVER w AS to_atom, l_orderkey AS seq FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey)),
e AS (SELECT from_atom, to_atom, count(*) AS weight, min(seq) AS first_seq FROM p WHERE to_atom IS NOT NULL GROUP BY 1, 2)
SELECT from_atom, to_atom, weight FROM (SELECT *, row_number() OVER (PARTITION BY from_atom ORDER BY weight DESC, first_seq, to_atom DESC) AS n FROM e) WHERE n = 1""")
def part_next_in_basket(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.concat(F.lit("v1.other.part_"), "l_partkey").alias("atom"), F.lit(0).alias("ts_ms"), F.col("l_orderkey").alias("seq"))
    return E.top_edge(E.edge_weights(E.transitions(rows, "l_orderkey", "l_linenumber", "l_partkey"))).select("from_atom", "to_atom", "weight")


@query("""WITH p AS (SELECT role AS from_role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS to_role FROM conversations)
SELECT from_role, to_role, count(*) AS transitions FROM p WHERE to_role IS NOT NULL GROUP BY 1, 2""")
def role_transitions(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.col("role").alias("atom"), F.lit(0).alias("ts_ms"), F.col("turn").alias("seq"))
    e = E.edge_weights(E.transitions(rows, "conv_id", "turn"))
    return e.select(F.col("from_atom").alias("from_role"), F.col("to_atom").alias("to_role"), F.col("weight").alias("transitions"))


@query(f"""WITH RECURSIVE {EDGES}, top AS (SELECT from_atom, to_atom FROM (SELECT *, row_number() OVER (PARTITION BY from_atom ORDER BY weight DESC, first_seq) AS n FROM edges) WHERE n <= 1),
walk AS (SELECT 'v1.state.signup' AS atom, 0 AS depth UNION SELECT to_atom, depth + 1 FROM walk JOIN top ON from_atom = atom WHERE depth < 3)
SELECT atom, min(depth)::INTEGER AS depth FROM walk GROUP BY atom""")
def graph_bfs(spark, d):
    return E.neighbourhood(_edges(spark, d), ["v1.state.signup"], 3, 1)


# -- variable-order prediction ---------------------------------------------------------------------
_PATHS = EV + """, b AS (SELECT seq, atom, lag(atom, 1) OVER w AS a1, lag(atom, 2) OVER w AS a2, lag(atom, 3) OVER w AS a3 FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts_ms, seq)),
each AS (SELECT seq, a1 AS path, 1 AS depth FROM b WHERE a1 IS NOT NULL UNION ALL SELECT seq, a1 || '>' || atom, 2 FROM b WHERE a1 IS NOT NULL
 UNION ALL SELECT seq, a2 || '>' || a1, 2 FROM b WHERE a2 IS NOT NULL UNION ALL SELECT seq, a2 || '>' || a1 || '>' || atom, 3 FROM b WHERE a2 IS NOT NULL
 UNION ALL SELECT seq, a3 || '>' || a2 || '>' || a1, 3 FROM b WHERE a3 IS NOT NULL UNION ALL SELECT seq, a3 || '>' || a2 || '>' || a1 || '>' || atom, 4 FROM b WHERE a3 IS NOT NULL),
nodes AS (SELECT path, depth, count(*) AS count, min(seq) AS first_seq FROM each GROUP BY path, depth)"""
_BEST = _PATHS + """, kids AS (SELECT regexp_replace(path, '>[^>]*$', '') AS context, regexp_extract(path, '[^>]*$') AS atom, depth - 1 AS ord, count, first_seq FROM nodes WHERE depth >= 2),
ranked AS (SELECT *, sum(count) OVER (PARTITION BY context) AS total, row_number() OVER (PARTITION BY context ORDER BY count DESC, first_seq, atom DESC) AS n FROM kids),
best AS (SELECT context, ord, atom AS predicted, count / total AS confidence FROM ranked WHERE n = 1)"""


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return P.path_counts(events(spark, d), "user_id", "ts_ms", "seq")


@query(f"WITH {_PATHS} SELECT path, depth, count, first_seq FROM nodes")
def ppm_counts(spark, d):
    return _nodes(spark, d).withColumn("path", F.array_join("path", ">"))


@query(f"WITH {_PATHS} SELECT count(*) + 1 AS nodes, max(depth) AS deepest, sum(count)::BIGINT AS observations FROM nodes")
def ppm_node_stats(spark, d):
    return _nodes(spark, d).agg((F.count("*") + 1).alias("nodes"), F.max("depth").alias("deepest"), F.sum("count").alias("observations"))


@query(f"WITH {_BEST} SELECT context, ord, predicted, round(confidence, 9) AS confidence FROM best")
def ppm_contexts(spark, d):
    b = P.best_children(_nodes(spark, d))
    return b.select(F.array_join("context", ">").alias("context"), F.col("order").alias("ord"), "predicted", F.round("confidence", 9).alias("confidence"))


def _histories(spark: SparkSession, d: str) -> DataFrame:
    """The last three atoms of each user, in order."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy(F.desc("ts_ms"), F.desc("seq"))
    last = events(spark, d).withColumn("n", F.row_number().over(w)).filter("n <= 3")
    return last.groupBy(F.col("user_id").alias("key")).agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("o"), "atom"))), lambda x: x["atom"]).alias("history"))


_PREDICT = _BEST + """, r AS (SELECT user_id, atom, row_number() OVER (PARTITION BY user_id ORDER BY ts_ms DESC, seq DESC) AS n FROM ev),
h AS (SELECT user_id, max(atom) FILTER (WHERE n = 1) AS h1, max(atom) FILTER (WHERE n = 2) AS h2, max(atom) FILTER (WHERE n = 3) AS h3 FROM r WHERE n <= 3 GROUP BY user_id),
p AS (SELECT h.user_id, h.h1, b3.predicted AS p3, b3.confidence AS c3, b2.predicted AS p2, b2.confidence AS c2, b1.predicted AS p1, b1.confidence AS c1
 FROM h LEFT JOIN best b3 ON b3.context = h3 || '>' || h2 || '>' || h1 LEFT JOIN best b2 ON b2.context = h2 || '>' || h1 LEFT JOIN best b1 ON b1.context = h1),
pred AS (SELECT user_id, h1, CASE WHEN c3 >= 0.3 THEN p3 WHEN c2 >= 0.3 THEN p2 ELSE p1 END AS predicted, CASE WHEN c3 >= 0.3 THEN 3 WHEN c2 >= 0.3 THEN 2 WHEN p1 IS NOT NULL THEN 1 END AS ord,
 CASE WHEN c3 >= 0.3 THEN c3 WHEN c2 >= 0.3 THEN c2 ELSE c1 END AS confidence FROM p)"""


@query(f"WITH {_PREDICT} SELECT user_id, predicted, ord::INTEGER AS ord, round(confidence, 9) AS confidence FROM pred")
def ppm_predict(spark, d):
    p = P.predict(_histories(spark, d), _nodes(spark, d))
    return p.select(F.col("key").alias("user_id"), "predicted", F.col("order").alias("ord"), F.round("confidence", 9).alias("confidence"))


@query(f"""WITH {_PREDICT}, pairs2 AS (SELECT atom AS from_atom, lead(atom) OVER w AS to_atom, lead(seq) OVER w AS s FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts_ms, seq)),
top AS (SELECT from_atom, to_atom FROM (SELECT from_atom, to_atom, row_number() OVER (PARTITION BY from_atom ORDER BY count(*) DESC, min(s)) AS n FROM pairs2 WHERE to_atom IS NOT NULL GROUP BY 1, 2) WHERE n = 1)
SELECT user_id, CASE WHEN ord >= 2 THEN predicted ELSE to_atom END AS predicted, CASE WHEN ord >= 2 THEN 'path' WHEN to_atom IS NOT NULL THEN 'edge' ELSE 'none' END AS source FROM pred LEFT JOIN top ON from_atom = h1""")
def combined_prediction(spark, d):
    h = _histories(spark, d)
    p = P.predict(h, _nodes(spark, d))
    out = P.combined(p, E.top_edge(_edges(spark, d)), h.select("key", F.element_at("history", -1).alias("atom")))
    return out.withColumnRenamed("key", "user_id")


@query(f"""WITH {EDGES}, top AS (SELECT from_atom, to_atom AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY from_atom ORDER BY weight DESC, first_seq) AS n FROM edges) WHERE n = 1)
SELECT from_atom, count(*) AS asked, sum((predicted = to_atom)::INT)::BIGINT AS hits, round(avg((predicted = to_atom)::INT), 9) AS hit_rate FROM pairs JOIN top USING (from_atom) GROUP BY from_atom""")
def prediction_hit_rate(spark, d):
    pairs = _pairs(spark, d)
    top = E.top_edge(E.edge_weights(pairs)).select("from_atom", F.col("to_atom").alias("predicted"))
    hit = (F.col("predicted") == F.col("to_atom")).cast("long")
    return pairs.join(top, "from_atom").groupBy("from_atom").agg(F.count("*").alias("asked"), F.sum(hit).alias("hits"), F.round(F.avg(hit), 9).alias("hit_rate"))


@query(f"""WITH RECURSIVE {EDGES}, top AS (SELECT from_atom, to_atom FROM (SELECT *, row_number() OVER (PARTITION BY from_atom ORDER BY weight DESC, first_seq) AS n FROM edges) WHERE n <= 2),
walk AS (SELECT 'v1.state.signup' AS atom, 0 AS depth UNION SELECT to_atom, depth + 1 FROM walk JOIN top ON from_atom = atom WHERE depth < 1), r AS (SELECT DISTINCT atom FROM walk)
SELECT '  "' || from_atom || '" -->|' || weight || '| "' || to_atom || '"' AS line FROM edges WHERE from_atom IN (SELECT atom FROM r) AND to_atom IN (SELECT atom FROM r)""")
def graph_mermaid(spark, d):
    e = _edges(spark, d)
    return E.mermaid(e, E.neighbourhood(e, ["v1.state.signup"], 1, 2))
