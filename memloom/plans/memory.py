"""Queries over atoms: parsing, scopes, claims, governance, listing, retrieval and its products."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import atoms as A
from ..functions import hashing as H
from ..functions import retention as R
from ..operators import blocks as K
from ..operators import edges as E
from ..operators import log as L
from ..operators import merkle as M
from ..operators import retrieval as T
from ..operators.ordinal import dense_index
from ..operators.storage import written
from ..sources import ndjson as N
from .registry import DAY, EV, NOW, events, query, spread, table

# -- atoms from names ------------------------------------------------------------------------------


def _customer_atoms(spark: SparkSession, d: str) -> DataFrame:
    """Facts and other records with scopes, sources and confidences, made from customers."""
    c = spread(table(spark, d, "customer").select("c_custkey", "c_mktsegment"))
    k = F.col("c_custkey")
    kind = F.element_at(F.array(*[F.lit(t) for t in A.TYPES]), (k % 6 + 1).cast("int"))
    scope = F.when(k % 4 == 0, F.concat(F.lit("_ns_user_u"), k % 7)).when(k % 4 == 1, F.concat(F.lit("_ns_user_u"), k % 7, F.lit("_ns_project_p"), k % 3)).otherwise("")
    meta = F.when(k % 3 == 0, "_src_human").when(k % 3 == 1, "_src_test_conf_high").otherwise("")
    value = F.concat(F.lit("Seg_"), k % 50, F.lit("_is_"), F.lower("c_mktsegment"), meta, scope)
    broken = F.when(k % 97 == 0, F.lit("v2.fact.old")).otherwise(F.concat(F.lit("v1."), kind, F.lit("."), value))
    return c.select("c_custkey", broken.alias("atom"))


_CUST = """ca AS (SELECT c_custkey, CASE WHEN c_custkey % 97 = 0 THEN 'v2.fact.old' ELSE 'v1.' || (['fact','event','relation','state','procedure','other'])[c_custkey % 6 + 1] || '.' ||
 'Seg_' || (c_custkey % 50) || '_is_' || lower(c_mktsegment) || CASE c_custkey % 3 WHEN 0 THEN '_src_human' WHEN 1 THEN '_src_test_conf_high' ELSE '' END ||
 CASE c_custkey % 4 WHEN 0 THEN '_ns_user_u' || (c_custkey % 7) WHEN 1 THEN '_ns_user_u' || (c_custkey % 7) || '_ns_project_p' || (c_custkey % 3) ELSE '' END END AS atom FROM customer),
parsed AS (SELECT c_custkey, atom, CASE WHEN regexp_matches(atom, '^v1\\.(fact|event|relation|state|procedure|other)\\..+$') THEN split_part(atom, '.', 2) END AS kind,
 CASE WHEN regexp_matches(atom, '^v1\\.(fact|event|relation|state|procedure|other)\\..+$') THEN trim(regexp_replace(atom, '^v1\\.[a-z]+\\.', '')) END AS value FROM ca)"""
_CORE = "regexp_replace(regexp_replace({v}, '_(src|conf|scope|dt|ns|namespace)_.*$', '', 'i'), '^_+|_+$', '', 'g')"


@query(f"WITH {_CUST} SELECT c_custkey, atom, kind, value, CASE WHEN kind IS NOT NULL THEN 'v1.' || kind || '.' || value END AS again FROM parsed")
def atom_parse(spark, d):
    a = F.col("atom")
    return _customer_atoms(spark, d).select("c_custkey", "atom", A.atom_type(a).alias("kind"), A.atom_value(a).alias("value"), A.encode_atom(A.atom_type(a), A.atom_value(a)).alias("again"))


@query(f"WITH {_CUST} SELECT c_custkey, CASE WHEN kind IS NULL THEN atom WHEN {_CORE.format(v='value')} = '' THEN kind ELSE kind || ':' || {_CORE.format(v='value')} END AS summary, greatest(1, ceil(length(atom) / 4.0))::BIGINT AS tokens, CASE WHEN kind IS NULL THEN atom ELSE kind || ' ' || value || ' ' || atom END AS semantic FROM parsed")
def atom_summary(spark, d):
    a = F.col("atom")
    return _customer_atoms(spark, d).select("c_custkey", A.compact_summary(a).alias("summary"), A.estimate_tokens(a).alias("tokens"), A.semantic_text(a).alias("semantic"))


_NS = "nullif(regexp_extract(coalesce(lower(value), lower(atom)), '(?:^|_)(?:ns|namespace)_{0}_([a-z0-9-]+)', 1), '')"


@query(f"WITH {_CUST} SELECT c_custkey, {_NS.format('user')} AS ns_user, {_NS.format('project')} AS ns_project, {_NS.format('task')} AS ns_task, coalesce({_NS.format('user')} = 'u3', true) AS loose, coalesce({_NS.format('user')} = 'u3', false) AS strict FROM parsed")
def atom_namespace(spark, d):
    a = F.col("atom")
    return _customer_atoms(spark, d).select("c_custkey", *[A.namespace(a, n).alias(f"ns_{n}") for n in ("user", "project", "task")], A.in_scope(a, {"user": "u3"}).alias("loose"), A.in_scope(a, {"user": "u3"}, False).alias("strict"))


_CLAIMS = f"""{_CUST}, core AS (SELECT c_custkey, atom, lower(value) AS v, list_filter(string_split(lower({_CORE.format(v='value')}), '_'), lambda x: x <> '') AS p FROM parsed WHERE kind = 'fact'),
claims AS (SELECT c_custkey, atom, array_to_string(p[1:len(p) - 1], '_') AS key, p[len(p)] AS claim, nullif(regexp_extract(v, '(?:^|_)src_([a-z0-9_-]+)', 1), '') AS source, nullif(regexp_extract(v, '(?:^|_)conf_([a-z0-9_-]+)', 1), '') AS confidence FROM core WHERE len(p) >= 2)"""


@query(f"WITH {_CLAIMS} SELECT * FROM claims")
def fact_claims(spark, d):
    return _customer_atoms(spark, d).withColumn("f", A.fact_claim(F.col("atom"))).filter("f is not null").select("c_custkey", "atom", "f.*")


@query(f"WITH {_CLAIMS} SELECT key, array_to_string(list_sort(list(DISTINCT claim)), ',') AS claims, count(*) AS entries, arg_max(atom, (c_custkey, atom)) AS newest FROM claims GROUP BY key HAVING count(DISTINCT claim) >= 2")
def fact_conflicts(spark, d):
    claims = _customer_atoms(spark, d).withColumn("f", A.fact_claim(F.col("atom"))).filter("f is not null").select("atom", "f.key", "f.claim", F.col("c_custkey").alias("created_ms"))
    return T.conflicts(claims).select("key", F.array_join("claims", ",").alias("claims"), F.size("atoms").cast("long").alias("entries"), F.element_at("atoms", 1).alias("newest"))


_MARKED = """pm AS (SELECT p_partkey, 'v1.' || CASE WHEN p_partkey % 2 = 0 THEN 'fact' ELSE 'state' END || '.' || replace(p_name, ' ', '_') || '_' ||
 (['Prefers_', 'preference', 'preference_', 'REQUIRES_', 'must', 'must_', 'constraint_', 'policy_objective_', 'objective_', 'current_focus_', 'next_step_must_', 'sprint.', 'plain'])[p_partkey % 13 + 1] || replace(lower(p_brand), '#', '') AS atom FROM part)"""


def _marked(spark: SparkSession, d: str) -> DataFrame:
    """Atoms made from part names, with markers of categories, halves of markers, and two at once."""
    markers = ("Prefers_", "preference", "preference_", "REQUIRES_", "must", "must_", "constraint_", "policy_objective_", "objective_", "current_focus_", "next_step_must_", "sprint.", "plain")
    mark = F.element_at(F.array(*[F.lit(m) for m in markers]), (F.col("p_partkey") % len(markers) + 1).cast("int"))
    kind = F.when(F.col("p_partkey") % 2 == 0, "fact").otherwise("state")
    return table(spark, d, "part").select("p_partkey", F.concat(F.lit("v1."), kind, F.lit("."), F.translate("p_name", " ", "_"), F.lit("_"), mark, F.replace(F.lower("p_brand"), F.lit("#"), F.lit(""))).alias("atom"))


_CATEGORY = "CASE WHEN regexp_matches(lower({v}), 'prefers_|preference_') THEN 'preference' WHEN regexp_matches(lower({v}), 'requires_|must_|constraint_|policy_') THEN 'constraint' WHEN regexp_matches(lower({v}), 'objective_|current_focus_|next_step_|sprint\\.') THEN 'goal' ELSE 'memory' END"


@query(f"WITH {_MARKED} SELECT p_partkey, {_CATEGORY.format(v='substr(atom, 4)')} AS category FROM pm")
def bootstrap_category(spark, d):
    return _marked(spark, d).select("p_partkey", A.memory_category(F.col("atom")).alias("category"))


# -- governance -------------------------------------------------------------------------------------
_SECRET = "regexp_matches(regexp_replace(lower(text), '[\\s_-]+', '', 'g'), 'password|passwd|apikey|privatekey|secret|credential|accesstoken|authtoken|bearertoken')"
_INJECT = "regexp_matches(replace(text, '_', ' '), '(?i)\\b(ignore|override|bypass|disregard|instead)\\b') OR regexp_matches(lower(text), 'system_prompt|pre_approved|approved_all|forget_previous')"


@query(f"SELECT doc_id, {_SECRET} AS secret FROM documents")
def secret_filter(spark, d):
    return table(spark, d, "documents").select("doc_id", A.has_secret(F.col("text")).alias("secret"))


@query(f"SELECT doc_id, {_INJECT} AS injection FROM documents")
def injection_filter(spark, d):
    return table(spark, d, "documents").select("doc_id", A.has_injection(F.col("text")).alias("injection"))


_TIERS = {"fact": "review-required", "state": "never-store"}


@query(f"""WITH {_CUST}, t AS (SELECT *, CASE coalesce(kind, 'other') WHEN 'fact' THEN 'review-required' WHEN 'state' THEN 'never-store' ELSE 'auto-write' END AS tier FROM parsed)
SELECT tier, CASE tier WHEN 'never-store' THEN 'deny' WHEN 'review-required' THEN 'review-required' ELSE 'allow' END AS decision, count(*) AS atoms FROM t GROUP BY 1, 2""")
def write_policy_eval(spark, d):
    rows = _customer_atoms(spark, d).withColumn("tier", R.write_tier(A.atom_type(F.col("atom")), _TIERS))
    return rows.groupBy("tier", R.write_decision(F.col("tier")).alias("decision")).agg(F.count("*").alias("atoms"))


# -- the log ---------------------------------------------------------------------------------------


def _log(spark: SparkSession, d: str) -> DataFrame:
    """A log of the events: purchases tombstone, everything else adds; ten events a version."""
    e = events(spark, d)
    op = F.when(F.col("event_type") == "purchase", "TOMBSTONE").otherwise("ADD")
    return e.select("seq", "ts_ms", op.alias("op"), F.concat(F.lit("v1.other.user_"), "user_id", F.lit("_"), F.when(F.col("seq") % 3 == 0, "a").otherwise("b")).alias("atom"), F.floor(F.col("seq") / 10).cast("long").alias("version"))


_LOG = EV + """, log AS (SELECT seq, ts_ms, CASE event_type WHEN 'purchase' THEN 'TOMBSTONE' ELSE 'ADD' END AS op, 'v1.other.user_' || user_id || '_' || CASE WHEN seq % 3 = 0 THEN 'a' ELSE 'b' END AS atom, seq // 10 AS version FROM ev),
atoms AS (SELECT atom, min(seq) FILTER (WHERE op = 'ADD') AS seq, min(ts_ms) FILTER (WHERE op = 'ADD') AS created_ms, min(version) FILTER (WHERE op = 'ADD') AS first_version, max(version) FILTER (WHERE op = 'ADD') AS committed_version, bool_or(op = 'TOMBSTONE' AND user_tomb) AS gone
 FROM (SELECT *, true AS user_tomb FROM log) GROUP BY atom HAVING min(seq) FILTER (WHERE op = 'ADD') IS NOT NULL)"""


def _sparse(log: DataFrame) -> DataFrame:
    """Tombstones of every seventh user only, so that both statuses occur."""
    return log.filter("op = 'ADD' or seq % 7 = 0")


_LOG7 = _LOG.replace("FROM (SELECT *, true AS user_tomb FROM log)", "FROM (SELECT *, true AS user_tomb FROM log WHERE op = 'ADD' OR seq % 7 = 0)")


@query(f"WITH {_LOG7} SELECT atom, CASE WHEN gone THEN 'tombstoned' ELSE 'active' END AS status, seq, created_ms, first_version, committed_version, sha256(atom) AS hash FROM atoms")
def atoms_view(spark, d):
    return L.atoms_view(_sparse(_log(spark, d))).select("atom", "status", "seq", "created_ms", "first_version", "committed_version", "hash")


_JUMP = """WITH RECURSIVE {0}, j AS (SELECT atom, ('0x' || substr(sha256(atom), 1, 16))::UBIGINT::UHUGEINT AS k, -1::BIGINT AS b, 0::BIGINT AS j FROM {1}
 UNION ALL SELECT atom, (k * 2862933555777941757::UHUGEINT + 1::UHUGEINT) % 18446744073709551616::UHUGEINT, j,
 floor((j + 1)::DOUBLE * (2147483648.0::DOUBLE / (((k * 2862933555777941757::UHUGEINT + 1::UHUGEINT) % 18446744073709551616::UHUGEINT // 8589934592::UHUGEINT)::DOUBLE + 1)))::BIGINT FROM j WHERE j < 4),
shards AS (SELECT atom, max(b)::INTEGER AS shard FROM j GROUP BY atom)"""


@query(_JUMP.format("c AS (SELECT c_custkey, 'v1.other.' || c_name AS atom FROM customer)", "c") + " SELECT c_custkey, shard FROM c JOIN shards USING (atom)")
def shard_assign(spark, d):
    return table(spark, d, "customer").select("c_custkey", H.jump_shard(F.concat(F.lit("v1.other."), "c_name"), 4).alias("shard"))


@query(_JUMP.format("c AS (SELECT c_custkey, 'v1.other.' || c_name AS atom FROM customer)", "c") + " SELECT shard, count(*) AS atoms, round(count(*) / avg(count(*)) OVER (), 9) AS ratio FROM c JOIN shards USING (atom) GROUP BY shard")
def shard_distribution(spark, d):
    counts = shard_assign(spark, d).groupBy("shard").agg(F.count("*").alias("atoms"))
    mean = F.broadcast(counts.agg(F.avg("atoms").alias("mean")))  # one row
    return counts.crossJoin(mean).select("shard", "atoms", F.round(F.col("atoms") / F.col("mean"), 9).alias("ratio"))


@query(_JUMP.format(_LOG7, "atoms") + ", placed AS (SELECT a.*, shard, row_number() OVER (PARTITION BY shard ORDER BY seq) - 1 AS idx FROM atoms a JOIN shards USING (atom)) SELECT atom, shard, idx FROM placed WHERE NOT gone ORDER BY shard, idx LIMIT 50 OFFSET 20")
def atoms_page(spark, d):
    return L.page(L.atoms_view(_sparse(_log(spark, d))), kind="other", prefix="v1.other.user_", offset=20, limit=50).select("atom", "shard", "idx")


@query(f"WITH {_LOG7} SELECT atom, created_ms, ({NOW} - created_ms) // {DAY} AS age_days FROM atoms WHERE NOT gone AND created_ms <= {NOW - 25 * DAY}")
def stale_atoms(spark, d):
    return L.stale(L.atoms_view(_sparse(_log(spark, d))), NOW, 25).select("atom", "created_ms", F.col("age_days").cast("long").alias("age_days"))


@query(f"WITH {_LOG7} SELECT atom FROM atoms WHERE NOT gone AND committed_version <= 995 AND created_ms <= {NOW - 20 * DAY}")
def atoms_as_of(spark, d):
    return L.as_of(L.atoms_view(_sparse(_log(spark, d))), version=995, ms=NOW - 20 * DAY).select("atom")


@query(f"WITH {_LOG} SELECT version, max(ts_ms) AS ts_ms, count(*) FILTER (WHERE op = 'ADD') AS added, count(*) FILTER (WHERE op = 'TOMBSTONE') AS removed FROM log GROUP BY version")
def commit_versions(spark, d):
    return L.commits(_log(spark, d))


_LEAVES = ", placed AS (SELECT a.*, shard, row_number() OVER (PARTITION BY shard ORDER BY seq) - 1 AS idx FROM atoms a JOIN shards USING (atom)), leaves AS (SELECT shard, count(*) AS leaves FROM placed WHERE first_version < 100 GROUP BY shard)"


def _leaf_counts(atoms: DataFrame) -> DataFrame:
    return atoms.filter("first_version < 100").groupBy("shard").agg(F.count("*").alias("leaves"))


_BEST = """, nx AS (SELECT atom AS from_atom, lead(atom) OVER (PARTITION BY version ORDER BY seq) AS to_atom, lead(seq) OVER (PARTITION BY version ORDER BY seq) AS seq FROM log WHERE op = 'ADD'),
ed AS (SELECT from_atom, to_atom, count(*) AS weight, min(seq) AS first_seq FROM nx WHERE to_atom IS NOT NULL GROUP BY 1, 2),
best AS (SELECT from_atom, to_atom FROM (SELECT from_atom, to_atom, row_number() OVER (PARTITION BY from_atom ORDER BY weight DESC, first_seq) AS n FROM ed JOIN atoms ON to_atom = atoms.atom AND NOT gone) WHERE n = 1)"""


def _trained(spark: SparkSession, d: str) -> DataFrame:
    """Edges of the log's additions: each version is a training sequence."""
    adds = _log(spark, d).filter("op = 'ADD'")
    return E.edge_weights(E.transitions(adds, "version", "seq"))


@query(_JUMP.format(_LOG7, "atoms") + _LEAVES + _BEST + """, req AS (SELECT row_number() OVER (ORDER BY u, s) - 1 AS pos, 'v1.other.user_' || u || '_' || s AS atom FROM (SELECT unnest(range(0, 200)) AS u), (SELECT unnest(['a', 'b', 'c']) AS s)),
r AS (SELECT pos, req.atom, shard, idx, hash, CASE WHEN placed.atom IS NULL THEN 'unknown' WHEN gone THEN 'tombstoned' WHEN idx >= coalesce(leaves, 0) THEN 'pending' END AS error FROM req LEFT JOIN (SELECT *, sha256(atom) AS hash FROM placed) placed USING (atom) LEFT JOIN leaves USING (shard))
SELECT pos, atom, shard, idx, hash, error, CASE WHEN error IS NULL THEN to_atom END AS predicted FROM r LEFT JOIN best ON best.from_atom = r.atom""")
def batch_access(spark, d):
    atoms = L.atoms_view(_sparse(_log(spark, d)))
    req = spark.range(600).select(F.col("id").alias("pos"), F.concat(F.lit("v1.other.user_"), F.floor(F.col("id") / 3), F.lit("_"), F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("id") % 3 + 1).cast("int"))).alias("atom"))
    live = atoms.filter("status = 'active'").select(F.col("atom").alias("to_atom"))
    best = E.top_edge(_trained(spark, d).join(live, "to_atom", "left_semi")).select("from_atom", "to_atom")
    return L.batch_access(req, atoms, _leaf_counts(atoms), best)


@query(_JUMP.format(_LOG7, "atoms") + _LEAVES + """, nx AS (SELECT atom AS from_atom, lead(atom) OVER (PARTITION BY version ORDER BY seq) AS to_atom, lead(ts_ms) OVER (PARTITION BY version ORDER BY seq) AS ts_ms FROM log WHERE op = 'ADD'),
ed AS (SELECT from_atom, to_atom, count(*) AS weight, max(ts_ms) AS updated_ms FROM nx WHERE to_atom IS NOT NULL GROUP BY 1, 2)
SELECT p.atom, p.shard, p.idx, CASE WHEN p.gone THEN 'tombstoned' ELSE 'active' END AS status, p.idx < coalesce(leaves, 0) AS committed, p.created_ms, p.committed_version, ed.to_atom, ed.weight, ed.updated_ms
FROM placed p LEFT JOIN leaves USING (shard) LEFT JOIN ed ON ed.from_atom = p.atom""")
def atom_inspect(spark, d):
    """Every atom's record, whether it is a committed leaf, and its outgoing transitions to known atoms."""
    atoms = L.atoms_view(_sparse(_log(spark, d)))
    return L.inspect(atoms, _leaf_counts(atoms), _trained(spark, d)).select("atom", "shard", "idx", "status", "committed", "created_ms", "committed_version", "to_atom", "weight", "updated_ms")


@query(_JUMP.format("c AS (SELECT p_partkey, 'v1.' || (['fact','event','relation','state','procedure','other'])[p_partkey % 6 + 1] || '.part_' || p_partkey AS atom FROM part)", "c") + """, placed AS (SELECT c.*, split_part(atom, '.', 2) AS kind, shard, row_number() OVER (PARTITION BY shard ORDER BY p_partkey) - 1 AS idx FROM c JOIN shards USING (atom)),
inc AS (SELECT l_partkey AS p_partkey, count(*) AS score FROM lineitem GROUP BY 1),
bt AS (SELECT shard, kind, atom FROM (SELECT shard, kind, atom, row_number() OVER (PARTITION BY shard, kind ORDER BY coalesce(score, 0) DESC, idx) AS n FROM placed LEFT JOIN inc USING (p_partkey) WHERE p_partkey % 5 <> 0) WHERE n = 1),
al AS (SELECT * FROM (VALUES ('fact', 'state', 4), ('fact', 'event', 2), ('event', 'other', 6), ('state', 'procedure', 5), ('state', 'fact', 1)) AS v(kind, to_kind, o) UNION ALL SELECT k, t, list_position(['fact','event','relation','state','procedure','other'], t) FROM (SELECT unnest(['procedure', 'other']) AS k), (SELECT unnest(['fact','event','relation','state','procedure','other']) AS t)),
m AS (SELECT p.atom, p.shard, b.atom AS predicted, row_number() OVER (PARTITION BY p.atom ORDER BY o) AS n FROM placed p JOIN al USING (kind) JOIN bt b ON b.shard = p.shard AND b.kind = al.to_kind WHERE p.p_partkey % 10 = 3)
SELECT p.atom, p.shard, m.predicted FROM placed p LEFT JOIN m ON m.atom = p.atom AND m.n = 1 WHERE p.p_partkey % 10 = 3""")
def warm_read(spark, d):
    """Pending parts (every tenth) with what the policy alone predicts; relations may go nowhere, other types that it doesn't list anywhere."""
    kind = F.element_at(F.array(*[F.lit(t) for t in A.TYPES]), (F.col("p_partkey") % 6 + 1).cast("int"))
    p = table(spark, d, "part").select("p_partkey", kind.alias("atom_type"), F.concat(F.lit("v1."), kind, F.lit(".part_"), "p_partkey").alias("atom"))
    placed = dense_index(p.withColumn("shard", H.jump_shard(F.col("atom"), 4)), "shard", "p_partkey").withColumn("status", F.when(F.col("p_partkey") % 5 == 0, "tombstoned").otherwise("active"))
    edges = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("weight")).join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("atom").alias("to_atom"), "weight")
    policy = {"fact": ["state", "event"], "event": ["other"], "state": ["procedure", "fact"], "relation": []}
    return L.type_fallback(placed.filter("p_partkey % 10 = 3"), placed, edges, policy)


@query(_JUMP.format(_LOG7, "atoms") + _LEAVES + " SELECT shard, count(*) FILTER (WHERE NOT gone) AS active, count(*) FILTER (WHERE gone) AS tombstoned, count(*) FILTER (WHERE NOT gone AND idx >= coalesce(leaves, 0)) AS pending FROM placed LEFT JOIN leaves USING (shard) GROUP BY shard")
def cluster_health(spark, d):
    atoms = L.atoms_view(_sparse(_log(spark, d)))
    return L.health(atoms, _leaf_counts(atoms))


@query(_JUMP.format(_LOG7, "atoms") + _LEAVES + " SELECT shard, (count(*) FILTER (WHERE NOT gone AND idx >= coalesce(leaves, 0)) + 10 + 900 <= 1000) AS admitted FROM placed LEFT JOIN leaves USING (shard) GROUP BY shard")
def write_admission(spark, d):
    return cluster_health(spark, d).select("shard", L.admission(F.col("pending"), F.lit(10), F.lit(900)).alias("admitted"))


@query("""WITH e AS (SELECT DISTINCT 'v1.other.' || c_name AS atom FROM customer WHERE c_custkey % 2 = 0), i AS (SELECT c_custkey AS seq, CASE WHEN c_custkey % 10 = 0 THEN 'bad' ELSE 'v1.other.' || c_name END AS atom FROM customer)
SELECT min(seq) AS seq, atom FROM i WHERE atom LIKE 'v1.%' AND atom NOT IN (SELECT atom FROM e) GROUP BY atom""")
def add_atoms(spark, d):
    c = table(spark, d, "customer")
    have = c.filter("c_custkey % 2 = 0").select(F.concat(F.lit("v1.other."), "c_name").alias("atom"))
    new = c.select(F.col("c_custkey").alias("seq"), F.lit(0).cast("long").alias("ts_ms"), F.when(F.col("c_custkey") % 10 == 0, "bad").otherwise(F.concat(F.lit("v1.other."), "c_name")).alias("atom"), F.lit(1).cast("long").alias("version"))
    return L.add_atoms(have, new).select("seq", "atom")


# -- exchange formats --------------------------------------------------------------------------------


@query("""SELECT '{"atom":"v1.other.order_' || o_orderkey || '","status":"' || CASE WHEN o_orderstatus = 'F' THEN 'tombstoned' ELSE 'active' END || '","hash":"' || sha256('v1.other.order_' || o_orderkey) || '"}' AS line FROM orders""")
def export_ndjson(spark, d):
    o = table(spark, d, "orders").select(F.concat(F.lit("v1.other.order_"), "o_orderkey").alias("atom"), F.when(F.col("o_orderstatus") == "F", "tombstoned").otherwise("active").alias("status"))
    return N.export_lines(o.withColumn("hash", H.atom_hash(F.col("atom"))), ["atom", "status", "hash"])


@query("""SELECT 'v1.other.order_' || o_orderkey AS atom FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 100 <> 7""")
def import_dedup(spark, d):
    o = table(spark, d, "orders")
    atom = F.concat(F.lit("v1.other.order_"), "o_orderkey")
    lines = o.select(F.when(F.col("o_orderkey") % 100 == 7, "{broken").when(F.col("o_orderkey") % 2 == 0, F.to_json(F.struct(atom.alias("atom")))).otherwise(atom).alias("line"))
    good, _ = N.import_lines(lines, o.filter("o_orderkey % 3 = 0").select(atom.alias("atom")))
    return good


@query("""SELECT from_atom, to_atom, max(weight)::BIGINT AS weight FROM (SELECT 'a' || l_partkey AS from_atom, 'b' || l_suppkey AS to_atom, l_linenumber AS weight FROM lineitem) GROUP BY 1, 2""")
def import_full_merge(spark, d):
    w = table(spark, d, "lineitem").select(F.concat(F.lit("a"), "l_partkey").alias("from"), F.concat(F.lit("b"), "l_suppkey").alias("to"), F.col("l_linenumber").cast("long").alias("weight"), F.lit(0).cast("long").alias("updated_ms"))
    lines = N.export_full(weights=w)
    return N.import_full(lines)["weights"].select(F.col("from").alias("from_atom"), F.col("to").alias("to_atom"), "weight")


@query("""SELECT n_nationkey AS k, 'v1.other.' || n_name AS atom FROM nation WHERE 'v1.other.' || n_name BETWEEN 'v1.other.C' AND 'v1.other.I'""")
def key_range_scan(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.concat(F.lit("v1.other."), "n_name").alias("atom"))
    return N.range_scan(n, "atom", "v1.other.C", "v1.other.I")


# -- retrieval --------------------------------------------------------------------------------------
_TOK = "list_filter(string_split_regex(lower({0}), '[^a-z0-9]+'), lambda x: x <> '')"
_DOCS = f"t AS (SELECT doc_id, {_TOK.format('text')} AS toks FROM documents), x AS (SELECT doc_id, unnest(toks) AS token FROM t)"


@query(f"WITH {_DOCS} SELECT token, count(DISTINCT doc_id) AS df FROM x GROUP BY token")
def tokens_df(spark, d):
    return T.document_frequency(T.term_rows(table(spark, d, "documents"), "doc_id", "text"))


@query(f"WITH {_DOCS} SELECT count(*) AS n, round(avg(len(toks)), 6) AS avg_len FROM t")
def doc_len_stats(spark, d):
    return T.corpus_stats(table(spark, d, "documents"), "text").select("n", F.round("avg_len", 6).alias("avg_len"))


@query(f"""WITH {_DOCS}, total AS (SELECT token, count(DISTINCT doc_id) AS n FROM x GROUP BY token), gone AS (SELECT token, count(DISTINCT doc_id) AS n FROM x JOIN documents d USING (doc_id) WHERE d.source = 'src0' GROUP BY token)
SELECT token, total.n - coalesce(gone.n, 0) AS df FROM total LEFT JOIN gone USING (token) WHERE total.n - coalesce(gone.n, 0) > 0""")
def tokens_df_after_removal(spark, d):
    docs = table(spark, d, "documents")
    signed = T.term_rows(docs, "doc_id", "text").withColumn("s", F.lit(1)).unionByName(T.term_rows(docs.filter("source = 'src0'"), "doc_id", "text").withColumn("s", F.lit(-1)))
    return signed.groupBy("token").agg(F.sum("s").alias("df")).filter("df > 0")


_BM = f"""{_DOCS}, l AS (SELECT doc_id, len(toks) AS len FROM t), st AS (SELECT count(*) AS n, avg(len) AS al FROM l),
tf AS (SELECT doc_id, token, count(*) AS tf FROM x GROUP BY 1, 2), df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1),
q AS (SELECT DISTINCT item_id AS q, unnest({_TOK.format('text')}) AS token FROM benchmark), w AS (SELECT q, token, ln((n - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5) + 1) AS idf FROM q LEFT JOIN df USING (token), st),
nm AS (SELECT q, sum(idf) * 2.2 AS norm FROM w GROUP BY q),
sc AS (SELECT q, doc_id, round(least(1.0, greatest(0.0, sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / al))) / any_value(norm))), 9) AS score FROM tf JOIN w USING (token) JOIN l USING (doc_id) JOIN nm USING (q), st GROUP BY q, doc_id)"""


@query(f"WITH {_BM} SELECT q, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM sc) WHERE rank <= 5")
def bm25_topk(spark, d):
    return _ranked(spark, d, 5)


def _ranked(spark: SparkSession, d: str, k: int, docs: DataFrame | None = None, embedding: str | None = None) -> DataFrame:
    """The k best documents of each benchmark text; docs: those that may be answers, out of the corpus that gives the frequencies."""
    corpus = table(spark, d, "documents")
    queries = table(spark, d, "benchmark").select(F.col("item_id").alias("q"), F.col("text").alias("q_text"))
    scorer = K.lexical_scorer(corpus, "text", queries, "q", "q_text", embedding)
    return K.top(docs if docs is not None else corpus, "doc_id", "text", queries, "q", scorer, k, same=True)


@query(f"""WITH p AS (SELECT p_partkey, list_distinct({_TOK.format('p_name')}) AS pt FROM part), s AS (SELECT p1.p_partkey AS a, p2.p_partkey AS b, round(len(list_intersect(p1.pt, p2.pt)) / len(list_distinct(list_concat(p1.pt, p2.pt))), 9) AS score FROM p p1, p p2 WHERE p1.p_partkey % 100 = 0 AND p1.p_partkey <> p2.p_partkey)
SELECT a, b, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS rank FROM s WHERE score > 0) WHERE rank <= 5""")
def jaccard_topk(spark, d):
    """Parts of the same words are one set, so pairs of different sets are scored, in blocks."""
    words = F.array_join(F.array_sort(F.array_distinct(A.tokens(F.col("p_name")))), " ")
    p = table(spark, d, "part").select(F.col("p_partkey").alias("b"), words.alias("words")).filter("words <> ''")
    a = p.filter("b % 100 = 0").withColumnRenamed("b", "a")
    return K.top_of_copies(p, "b", "words", a, "a", lambda chunk: K.Jaccard(chunk, "__q", "words"), 5)


_FNV = """WITH RECURSIVE words AS (SELECT p_partkey, unnest(list_filter(string_split_regex(lower(p_name), '[^a-z0-9]+'), lambda x: x <> '')) AS w FROM part),
dw AS (SELECT DISTINCT w FROM words), g AS (SELECT w, 'w:' || w AS f FROM dw UNION ALL SELECT w, 'n:' || w FROM dw WHERE length(w) = 2
 UNION ALL SELECT w, 'n:' || substr(w, i, k) FROM dw, (SELECT unnest([3, 4, 5]) AS k), (SELECT unnest(range(1, 40)) AS i) WHERE i + k - 1 <= length(w)),
df AS (SELECT DISTINCT f FROM g),
h AS (SELECT f, 0 AS i, 2166136261::BIGINT AS h FROM df UNION ALL
 SELECT f, i + 1, (trunc((CASE WHEN xor(h, ascii(substr(f, i + 1, 1))::BIGINT) >= 2147483648 THEN xor(h, ascii(substr(f, i + 1, 1))::BIGINT) - 4294967296 ELSE xor(h, ascii(substr(f, i + 1, 1))::BIGINT) END)::DOUBLE * 16777619.0::DOUBLE)::BIGINT & 4294967295) FROM h WHERE i < length(f)),
hh AS (SELECT f, h FROM h WHERE i = length(f)), raw AS (SELECT p_partkey, (h % 256)::INTEGER AS bucket, sum(CASE WHEN h >= 2147483648 THEN -1 ELSE 1 END) AS v FROM words JOIN g USING (w) JOIN hh USING (f) GROUP BY 1, 2),
nz AS (SELECT * FROM raw WHERE v <> 0), vec AS (SELECT p_partkey, bucket, v / sqrt(sum(v * v) OVER (PARTITION BY p_partkey)) AS weight FROM nz)"""


def _part_vectors(spark: SparkSession, d: str) -> DataFrame:
    return T.hashed_buckets(table(spark, d, "part"), "p_partkey", "p_name")


@query(_FNV + " SELECT p_partkey, bucket, round(weight, 9) AS weight FROM vec")
def ngram_embed_buckets(spark, d):
    return _part_vectors(spark, d).withColumn("weight", F.round("weight", 9))


@query(_FNV + """, qs AS (SELECT DISTINCT p_partkey AS a FROM vec WHERE p_partkey % 100 = 0), dt AS (SELECT a.p_partkey AS a, b.p_partkey AS b, sum(a.weight * b.weight) AS c FROM vec a JOIN vec b USING (bucket) WHERE a.p_partkey % 100 = 0 GROUP BY 1, 2),
cs AS (SELECT qs.a, p.p_partkey AS b, round(greatest(-1, least(1, coalesce(c, 0))), 9) AS cosine FROM qs, (SELECT DISTINCT p_partkey FROM part) p LEFT JOIN dt ON dt.a = qs.a AND dt.b = p.p_partkey WHERE qs.a <> p.p_partkey)
SELECT a, b, cosine, round((cosine + 1) / 2, 9) AS index_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY cosine DESC, b) AS rank FROM cs) WHERE rank <= 5""")
def ngram_cosine_topk(spark, d):
    """A vector depends on how often a name has each word, so names that agree in that are one."""
    words = F.coalesce(F.array_join(F.array_sort(A.tokens(F.col("p_name"))), " "), F.lit(""))
    p = table(spark, d, "part").select(F.col("p_partkey").alias("b"), words.alias("embedding"))
    a = p.filter("b % 100 = 0").withColumnRenamed("b", "a")
    c = K.top_of_copies(p, "b", "embedding", a, "a", lambda chunk: K.Dot(chunk, "__q", "embedding"), 5, lambda df, key: T.embedded(df, key, "embedding", "ngram"))
    return c.select("a", "b", F.col("score").alias("cosine"), F.round(T.index_score(F.col("score")), 9).alias("index_score"), "rank")


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT a.vec_id AS q, b.vec_id AS vec_id, round(list_dot_product(a.e, b.e), 9) AS score FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)
SELECT q, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""")
def cosine_topk(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    q = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), F.col("embedding"))
    return K.top(e, "vec_id", "embedding", q, "q", lambda chunk: K.Dot(chunk, "q", "embedding"), 5)


# the words of queries and documents as hashed n-grams: a vector a text
_GRAMS = """, tx AS (SELECT -1 - item_id AS id, text FROM benchmark UNION ALL SELECT doc_id, text FROM documents), tw AS (SELECT id, unnest(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS w FROM tx), ct AS (SELECT id, w, count(*) AS n FROM tw GROUP BY 1, 2),
dw AS (SELECT DISTINCT w FROM ct), ng AS (SELECT w, 'w:' || w AS f FROM dw UNION ALL SELECT w, 'n:' || w FROM dw WHERE length(w) = 2 UNION ALL SELECT w, 'n:' || substr(w, i, k) FROM dw, (SELECT unnest([3, 4, 5]) AS k), (SELECT unnest(range(1, 60)) AS i) WHERE i + k - 1 <= length(w)),
fs AS (SELECT DISTINCT f FROM ng), fh AS (SELECT f, 0 AS i, 2166136261::BIGINT AS h FROM fs UNION ALL
 SELECT f, i + 1, (trunc((CASE WHEN xor(h, ascii(substr(f, i + 1, 1))::BIGINT) >= 2147483648 THEN xor(h, ascii(substr(f, i + 1, 1))::BIGINT) - 4294967296 ELSE xor(h, ascii(substr(f, i + 1, 1))::BIGINT) END)::DOUBLE * 16777619.0::DOUBLE)::BIGINT & 4294967295) FROM fh WHERE i < length(f)),
wv AS (SELECT w, (h % 256)::INTEGER AS bucket, sum(CASE WHEN h >= 2147483648 THEN -1 ELSE 1 END) AS s FROM ng JOIN (SELECT f, h FROM fh WHERE i = length(f)) USING (f) GROUP BY 1, 2),
rv AS (SELECT id, bucket, sum(n * s) AS v FROM ct JOIN wv USING (w) GROUP BY 1, 2), uv AS (SELECT id, bucket, v / sqrt(sum(v * v) OVER (PARTITION BY id)) AS u FROM rv WHERE v <> 0),
cq AS (SELECT -1 - a.id AS q, b.id AS doc_id, sum(a.u * b.u) AS c FROM uv a JOIN uv b USING (bucket) WHERE a.id < 0 AND b.id >= 0 GROUP BY 1, 2)"""


@query(f"""WITH RECURSIVE {_BM}{_GRAMS}, al AS (SELECT item_id AS q, documents.doc_id AS doc_id, coalesce(sc2.score, 0) AS b, 0.8 * (greatest(-1, least(1, coalesce(c, 0))) + 1) / 2 AS e FROM benchmark CROSS JOIN documents LEFT JOIN (SELECT q, doc_id, score FROM sc) sc2 ON sc2.q = item_id AND sc2.doc_id = documents.doc_id LEFT JOIN cq ON cq.q = item_id AND cq.doc_id = documents.doc_id),
h AS (SELECT q, doc_id, round(greatest(b, e) + 0.1 * least(b, e), 7) AS score FROM al) SELECT q, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM h) WHERE rank <= 5""")
def hybrid_topk(spark, d):
    """Words and hashed n-grams of the same texts, together."""
    top = _ranked(spark, d, 12, embedding="ngram").drop("rank").withColumn("score", F.round("score", 7))
    return T.top_k(top, 5, "q", "doc_id")


_ITEMS = f"""{_BM}, r AS (SELECT q, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM sc),
items AS (SELECT r.q, r.doc_id, r.rank, r.score, greatest(1, ceil(length(d.text) / 4.0))::BIGINT AS tokens, coalesce(l.quality, 0) AS quality, coalesce(l.toxic, 0) AS toxic FROM r JOIN documents d USING (doc_id) LEFT JOIN labels l USING (doc_id) WHERE rank <= 12)"""


def _items(spark: SparkSession, d: str) -> DataFrame:
    docs, top = table(spark, d, "documents"), _ranked(spark, d, 12)
    return top.join(docs.select("doc_id", A.estimate_tokens(F.col("text")).alias("tokens")), "doc_id").join(table(spark, d, "labels"), "doc_id", "left").fillna({"quality": 0, "toxic": 0})


@query(f"WITH {_ITEMS} SELECT q, doc_id, rank, used FROM (SELECT *, sum(tokens) OVER (PARTITION BY q ORDER BY rank ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM items) WHERE used <= 2000")
def context_pack(spark, d):
    return T.pack_context(_items(spark, d), 2000, "q", "rank").select("q", "doc_id", "rank", "used")


@query(f"""WITH {_ITEMS}, e AS (SELECT *, round(greatest(0, least(1, score * 0.55 + CASE WHEN quality = 1 THEN 0.25 ELSE 0 END + CASE WHEN tokens > 500 THEN 0.1 ELSE 0 END + CASE WHEN toxic = 1 THEN 0 ELSE 0.1 END)), 6) AS evidence FROM items),
g AS (SELECT *, evidence >= 0.65 AS included, count(*) OVER (PARTITION BY q) AS input_count, count(*) FILTER (WHERE evidence >= 0.65) OVER (PARTITION BY q) AS k FROM e)
SELECT q, doc_id, evidence, included, input_count, input_count - k AS excluded_count, k = 0 AS low_evidence_fallback, round((input_count - k) / input_count, 6) AS exclusion_rate FROM g""")
def evidence_gate(spark, d):
    category = F.when(F.col("tokens") > 500, "goal").otherwise("memory")
    e = _items(spark, d).withColumn("evidence", T.evidence_score(F.col("score"), F.col("quality") == 1, category, F.col("toxic") == 1))
    return T.evidence_gate(e).select("q", "doc_id", "evidence", "included", "input_count", "excluded_count", "low_evidence_fallback", "exclusion_rate")


@query(f"""WITH {_BM}, lg AS (SELECT doc_id, doc_id // 50 + 1 AS version, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS copy FROM documents), mx AS (SELECT max(version) // 2 AS v FROM lg),
d2 AS (SELECT doc_id FROM lg, mx WHERE copy = 1 AND version <= v), s AS (SELECT q, doc_id, score FROM sc JOIN d2 USING (doc_id) WHERE score >= 0.05)
SELECT q, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10""")
def search_asof(spark, d):
    """Documents added fifty a version, later copies of a text removed; searched as of half of the versions, with the frequencies of the current corpus."""
    docs = table(spark, d, "documents").select("doc_id", "text", (F.floor(F.col("doc_id") / 50) + 1).cast("long").alias("committed_version"))
    first = docs.groupBy(F.xxhash64("text").alias("h"), F.sha2("text", 256).alias("s")).agg(F.min("doc_id").alias("doc_id"))
    status = docs.join(first.select("doc_id", F.lit("active").alias("status")), "doc_id", "left").fillna({"status": "tombstoned"})
    half = docs.agg(F.max("committed_version")).first()[0] // 2
    return _ranked(spark, d, 10, L.as_of(status, version=half)).filter("score >= 0.05")


# known-item retrieval: the first twelve words of every fiftieth document ask for that document, among all
_KNOWN = f"""{_DOCS}, l AS (SELECT doc_id, len(toks) AS len FROM t), st AS (SELECT count(*) AS n, avg(len) AS al FROM l), tf AS (SELECT doc_id, token, count(*) AS tf FROM x GROUP BY 1, 2), df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1),
q AS (SELECT DISTINCT doc_id AS q, unnest(toks[1:12]) AS token FROM t WHERE doc_id % 50 = 0), w AS (SELECT q, token, ln((n - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5) + 1) AS idf FROM q LEFT JOIN df USING (token), st),
nm AS (SELECT q, sum(idf) * 2.2 AS norm FROM w GROUP BY q),
sc AS (SELECT q, doc_id, round(least(1.0, greatest(0.0, sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / al))) / any_value(norm))), 9) AS score FROM tf JOIN w USING (token) JOIN l USING (doc_id) JOIN nm USING (q), st GROUP BY q, doc_id),
rk AS (SELECT q, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM sc)"""


@query(f"""WITH {_KNOWN}, lab AS (SELECT doc_id AS q, coalesce(lang, 'none') AS category FROM documents WHERE doc_id % 50 = 0), c AS (SELECT lab.q, category, min(rank) AS best FROM lab LEFT JOIN (SELECT * FROM rk WHERE rank <= 10 AND score > 0) r ON r.q = lab.q AND r.doc_id = lab.q GROUP BY 1, 2)
SELECT category, count(*) AS queries, round(avg(coalesce((best <= 1)::INT, 0)), 9) AS recall_1, round(avg(coalesce((best <= 3)::INT, 0)), 9) AS recall_3, round(avg(coalesce((best <= 5)::INT, 0)), 9) AS recall_5, round(avg(coalesce(1.0 / best, 0)), 9) AS mrr FROM c GROUP BY ROLLUP (category)""")
def recall_mrr(spark, d):
    """Of known items: labels come from the documents, not from what is found; ten answers a query."""
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    asked = docs.filter("doc_id % 50 = 0")
    queries = asked.select(F.col("doc_id").alias("q"), F.array_join(F.slice(A.tokens(F.col("text")), 1, 12), " ").alias("q_text"), F.col("text").alias("own"))
    # the place of the asked document is all that counts, so less than its score is no answer
    scorer = K.lexical_scorer(docs, "text", queries, "q", "q_text", own="own")
    found = K.top(docs.withColumnRenamed("doc_id", "key"), "key", "text", queries, "q", scorer, 10, same=True, chunk=K.WORD_CHUNK)
    labels = asked.select(F.col("doc_id").alias("q"), F.col("doc_id").alias("key"), F.coalesce("lang", F.lit("none")).alias("category"))
    out = T.recall_and_rank(found, labels)
    return out.select("category", "queries", *[F.round(c, 9).alias(c) for c in ("recall_1", "recall_3", "recall_5", "mrr")])


@query(f"SELECT doc_id, greatest(1, ceil(length(text) / 4.0))::BIGINT AS tokens FROM documents")
def token_estimates(spark, d):
    return table(spark, d, "documents").select("doc_id", A.estimate_tokens(F.col("text")).alias("tokens"))




# -- decisions --------------------------------------------------------------------------------------
_OBJECTIVE = "ship the green metallic policy"


@query(_JUMP.format(_MARKED + ", pa AS (SELECT p_partkey, atom, row_number() OVER (ORDER BY p_partkey) AS seq FROM pm)", "pa") + f""", pl AS (SELECT pa.*, shard, row_number() OVER (PARTITION BY shard ORDER BY p_partkey) - 1 AS idx, count(*) OVER (PARTITION BY shard) AS n FROM pa JOIN shards USING (atom)),
v AS (SELECT *, substr(atom, strpos(substr(atom, 4), '.') + 4) AS value FROM pl), tk AS (SELECT *, list_distinct({_TOK.format("split_part(atom, '.', 2) || ' ' || value || ' ' || atom")}) AS ts, list_distinct({_TOK.format(f"'{_OBJECTIVE}'")}) AS qs, {_TOK.format('value')} AS vs FROM v),
sc AS (SELECT *, round(len(list_intersect(ts, qs)) / len(list_distinct(list_concat(ts, qs))), 6) AS score, {_CATEGORY.format(v='value')} AS category, idx < n - 5 AND p_partkey % 7 <> 0 AS proven, len(list_intersect(qs, vs)) AS overlap FROM tk),
e AS (SELECT *, round(least(1, greatest(0, score * 0.55 + CASE WHEN proven THEN 0.25 ELSE 0 END + CASE WHEN category = 'memory' THEN 0 ELSE 0.1 END + 0.1)), 6) AS evidence FROM sc),
t AS (SELECT *, row_number() OVER (ORDER BY score DESC, p_partkey DESC, atom) AS rank FROM e)
SELECT atom, proven, evidence, rank, array_to_string(list_filter([CASE WHEN overlap > 0 THEN 'objective_token_overlap=' || overlap END, CASE WHEN score > 0 THEN 'semantic_relevance=' || regexp_replace(printf('%.6f', score::DOUBLE), '\\.?0+$', '') END, CASE WHEN category <> 'memory' THEN 'category=' || category END,
 'evidence_score=' || regexp_replace(printf('%.6f', evidence::DOUBLE), '\\.?0+$', ''), 'threshold_gate=' || CASE WHEN evidence >= 0.4 THEN 'pass' ELSE 'fail' END, 'rank=' || rank], lambda x: x IS NOT NULL), ';') AS reasons FROM t WHERE rank <= 200""")
def decision_evidence(spark, d):
    """The 200 most relevant of the marked atoms, whether their leaf is committed and its path leads to the shard's root, and why each was chosen.

    The last five atoms of a shard are not committed yet, and every seventh part's leaf was forged.
    """
    sharded = written(spread(_marked(spark, d)).withColumn("shard", H.jump_shard(F.col("atom"), 4)))
    atoms = dense_index(sharded, "shard", "p_partkey")
    counts = F.broadcast(atoms.groupBy("shard").agg((F.count("*") - 5).alias("leaves")))  # four shards
    placed = written(atoms.join(counts, "shard").withColumn("hash", H.atom_hash(F.col("atom"))))
    leaves = placed.filter("idx < leaves").select("shard", "idx", "hash")
    a = F.col("atom")
    score = F.round(A.jaccard(F.array_distinct(A.tokens(A.semantic_text(a))), F.array_distinct(A.tokens(F.lit(_OBJECTIVE)))), 6)
    top = placed.select("atom", "shard", "idx", F.when(F.col("p_partkey") % 7 == 0, F.sha2(F.lit("forged"), 256)).otherwise(F.col("hash")).alias("hash"), F.col("p_partkey").alias("created_ms"), score.alias("score")).orderBy(F.desc("score"), F.desc("created_ms"), "atom").limit(200)
    held = M.held_spans(leaves, "shard")
    paths = M.audit_paths(leaves, "shard", wanted=top, held=held).select("shard", "idx", "path")
    known = top.join(paths, ["shard", "idx"], "left").join(F.broadcast(M.roots(leaves, "shard", held=held)), "shard", "left")
    proven = F.coalesce(M.root_of_path(F.col("hash"), F.col("idx"), F.col("path")) == F.col("root"), F.lit(False))
    items = known.withColumn("proven", proven).withColumn("category", A.memory_category(a)).withColumn("conflict_key", F.lit(None).cast("string")).withColumn("q", F.lit(0))
    items = items.withColumn("evidence", T.evidence_score(F.col("score"), F.col("proven"), F.col("category"), F.lit(False)))
    return T.with_reasons(items, _OBJECTIVE, 0.4).select("atom", "proven", "evidence", "rank", F.array_join("reasons", ";").alias("reasons"))
