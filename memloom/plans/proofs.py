"""Queries over Merkle trees of orders and customers, and over write-ahead entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import ZERO_HASH
from ..operators import merkle as M
from ..operators import wal as W
from ..operators.storage import written
from .registry import query, table


def _leaves(spark: SparkSession, d: str, name: str, key: str, label: str, least: int = 0) -> DataFrame:
    """(tree, idx, hash): one tree for each of two kinds of keys, of different sizes."""
    rows = table(spark, d, name).select((F.col(key) - least).alias("k"), F.sha2(F.concat(F.lit("v1.other."), F.col(label)).cast("binary"), 256).alias("hash"))
    return rows.select(F.when(F.col("k") % 3 == 0, 1).otherwise(0).alias("tree"), F.when(F.col("k") % 3 == 0, F.floor(F.col("k") / 3)).otherwise(F.floor(F.col("k") / 3) * 2 + F.col("k") % 3 - 1).cast("long").alias("idx"), "hash")


def _sql_leaves(name: str, key: str, label: str, least: int = 0) -> str:
    k = f"({key} - {least})"
    return f"lv AS (SELECT CASE WHEN {k} % 3 = 0 THEN 1 ELSE 0 END AS tree, (CASE WHEN {k} % 3 = 0 THEN {k} // 3 ELSE ({k} // 3) * 2 + {k} % 3 - 1 END)::BIGINT AS idx, sha256('v1.other.' || {label}) AS hash FROM {name})"


# every level at once: a level is a list of hashes, padded by zeros or by its own last one
def _sql_roots(leaves: str, pad: str) -> str:
    last = f"repeat('0', 64)" if pad == "zero" else "l[len(l)]"
    return f"""{leaves}, n AS (SELECT tree, list(hash ORDER BY idx) AS l, count(*) AS n, ceil(log2(count(*)))::INT AS h FROM lv GROUP BY tree),
 padded AS (SELECT tree, n, h, CASE WHEN '{pad}' = 'zero' THEN list_concat(l, list_transform(range(0, (pow(2, h) - n)::BIGINT), lambda x: repeat('0', 64))) ELSE l END AS l FROM n),
 up AS (SELECT tree, n, h, 0 AS lev, l FROM padded UNION ALL SELECT tree, n, h, lev + 1, list_transform(range(1, len(l) + 1, 2), lambda i: sha256(unhex(l[i]) || unhex(coalesce(l[i + 1], {last})))) FROM up WHERE lev < h)"""


@query(f"WITH RECURSIVE {_sql_roots(_sql_leaves('customer', 'c_custkey', 'c_name'), 'zero')} SELECT tree, n AS leaves, l[1] AS root FROM up WHERE lev = h")
def merkle_root(spark, d):
    return M.roots(_leaves(spark, d, "customer", "c_custkey", "c_name"), "tree")


@query(f"WITH RECURSIVE {_sql_roots(_sql_leaves('customer', 'c_custkey', 'c_name'), 'last')} SELECT tree, n AS leaves, l[1] AS root FROM up WHERE lev = h")
def kernel_root(spark, d):
    return M.roots(_leaves(spark, d, "customer", "c_custkey", "c_name"), "tree", zero_pad=False)


_ORDERS = _sql_leaves("orders", "o_orderkey", "o_orderpriority || o_custkey || ':' || o_orderkey")
#: Every node as a row, and the siblings of each leaf by the nodes' places.
_NODES = """, nd AS (SELECT tree, lev, unnest(range(0, len(l))) AS pos, unnest(l) AS h FROM up WHERE lev < h)"""
_PATH = _NODES + """, p AS (SELECT lv.tree, lv.idx, lv.hash, list(nd.h ORDER BY nd.lev) AS path FROM lv JOIN (SELECT DISTINCT tree, lev FROM nd) s USING (tree) JOIN nd ON nd.tree = lv.tree AND nd.lev = s.lev AND nd.pos = xor(lv.idx >> s.lev, 1) GROUP BY ALL)"""


def _order_leaves(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", F.concat("o_orderpriority", "o_custkey", F.lit(":"), "o_orderkey").alias("label"))
    k, label = F.col("o_orderkey"), F.sha2(F.concat(F.lit("v1.other."), "label").cast("binary"), 256)
    third = F.floor(k / 3)
    return rows.select(F.when(k % 3 == 0, 1).otherwise(0).alias("tree"), F.when(k % 3 == 0, third).otherwise(third * 2 + k % 3 - 1).cast("long").alias("idx"), label.alias("hash"))




@query(f"WITH RECURSIVE {_sql_roots(_ORDERS, 'zero')}{_PATH} SELECT tree, idx, hash, array_to_string(path, ',') AS path FROM p")
def merkle_paths(spark, d):
    return M.audit_paths(_order_leaves(spark, d), "tree").withColumn("path", F.array_join("path", ","))


@query(f"WITH RECURSIVE {_sql_roots(_ORDERS, 'zero')} SELECT lv.tree, lv.idx, lv.idx % 4 <> 0 AS valid, up.l[1] AS root FROM lv JOIN up USING (tree) WHERE lev = h")
def merkle_verify(spark, d):
    leaves = _order_leaves(spark, d)
    held = M.held_spans(leaves, "tree")
    paths = M.audit_paths(leaves, "tree", held=held).join(F.broadcast(M.roots(leaves, "tree", held=held)), "tree")  # two trees
    claimed = F.when(F.col("idx") % 4 == 0, F.sha2(F.lit("forged").cast("binary"), 256)).otherwise(F.col("hash"))
    return paths.select("tree", "idx", (M.root_of_path(claimed, F.col("idx"), F.col("path")) == F.col("root")).alias("valid"), "root")


@query(f"WITH RECURSIVE {_sql_roots(_ORDERS, 'last')}{_NODES}, pp AS (SELECT lv.tree, lv.idx, list(coalesce(o.h, m.h) ORDER BY m.lev) AS path FROM lv JOIN (SELECT DISTINCT tree, lev FROM nd) s USING (tree) JOIN nd m ON m.tree = lv.tree AND m.lev = s.lev AND m.pos = lv.idx >> s.lev LEFT JOIN nd o ON o.tree = lv.tree AND o.lev = s.lev AND o.pos = xor(lv.idx >> s.lev, 1) GROUP BY ALL) SELECT tree, idx, array_to_string(path, ',') AS path FROM pp")
def kernel_paths(spark, d):
    return M.audit_paths(_order_leaves(spark, d), "tree", zero_pad=False).select("tree", "idx", F.array_join("path", ",").alias("path"))


def _shard_roots(spark: SparkSession, d: str) -> DataFrame:
    """(version, shard, root): a root for each region and a number of its nations."""
    n = table(spark, d, "nation").select(F.col("n_regionkey").alias("shard"), "n_nationkey", F.sha2(F.col("n_name").cast("binary"), 256).alias("h"))
    v = spark.range(1, 4).select(F.col("id").alias("version"))
    return n.crossJoin(F.broadcast(v)).filter("n_nationkey < version * 9").groupBy("version", "shard").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), "").cast("binary"), 256).alias("root"))


_SHARDS = "sr AS (SELECT version, n_regionkey AS shard, sha256(string_agg(sha256(n_name), '' ORDER BY sha256(n_name))) AS root FROM nation, (SELECT unnest([1, 2, 3]) AS version) WHERE n_nationkey < version * 9 GROUP BY 1, 2), lv AS (SELECT version AS tree, row_number() OVER (PARTITION BY version ORDER BY shard) - 1 AS idx, sha256(root) AS hash FROM sr)"


def _dense(roots: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    return roots.withColumn("shard", F.row_number().over(Window.partitionBy("version").orderBy("shard")) - 1)


@query(f"WITH RECURSIVE {_sql_roots(_SHARDS, 'last')} SELECT tree AS version, l[1] AS root FROM up WHERE lev = h")
def master_root(spark, d):
    return M.master_root(_dense(_shard_roots(spark, d)))


@query(f"WITH RECURSIVE {_sql_roots(_SHARDS, 'last')} SELECT max(tree) AS version, arg_max(l[1], tree) AS root FROM up WHERE lev = h")
def tree_head(spark, d):
    return M.master_root(_dense(_shard_roots(spark, d))).agg(F.max("version").alias("version"), F.max_by("root", "version").alias("root"))


@query("""SELECT a AS from_version, b AS to_version, a < b AND a <> 2 AND b <> 2 AS valid, CASE WHEN a >= b THEN 'version order' WHEN a = 2 THEN 'from root' WHEN b = 2 THEN 'to root' END AS reason FROM (SELECT unnest([1, 2, 3])::BIGINT AS a), (SELECT unnest([1, 2, 3])::BIGINT AS b)""")
def consistency_check(spark, d):
    chain = M.master_root(_dense(_shard_roots(spark, d))).withColumn("recomputed", F.when(F.col("version") == 2, F.lit(ZERO_HASH)).otherwise(F.col("root"))).withColumn("ts_ms", F.col("version") * 1000)
    v = chain.select("version")
    pairs = v.select(F.col("version").alias("from_version")).crossJoin(v.select(F.col("version").alias("to_version")))  # versions to compare: the question, not the data
    return M.consistency(pairs, chain)


@query("""WITH n AS (SELECT max(o_orderkey) + 1 AS n FROM orders) SELECT o_orderkey AS idx, CASE WHEN o_orderkey % 6 = 0 THEN repeat('0', 64) ELSE sha256(o_orderpriority || o_custkey) END AS hash FROM orders""")
def pending_apply(spark, d):
    """Two thirds of the orders are leaves; the rest is added, and every sixth is removed."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("idx"), F.sha2(F.concat("o_orderpriority", "o_custkey").cast("binary"), 256).alias("hash"))
    n = o.agg(F.max("idx")).first()[0] + 1
    adds = o.filter(F.col("idx") >= n * 2 // 3).select(F.col("idx").alias("seq"), F.lit("ADD").alias("op"), "idx", "hash")
    marks = o.filter("idx % 6 = 0").select((F.col("idx") + n).alias("seq"), F.lit("TOMBSTONE").alias("op"), "idx", F.lit(None).cast("string").alias("hash"))
    return M.apply_pending(o.filter(F.col("idx") < n * 2 // 3), adds.unionByName(marks))


_CHANGED = _sql_leaves("orders", "o_orderkey", "o_orderpriority || o_custkey || ':' || o_orderkey").replace("lv AS", "lv0 AS", 1) + ", sz AS (SELECT tree, count(*) AS n FROM lv0 GROUP BY tree), lv AS (SELECT tree, idx, CASE WHEN idx % 50 = 7 AND idx < n // 3 THEN repeat('0', 64) ELSE hash END AS hash FROM lv0 JOIN sz USING (tree))"


@query(f"WITH RECURSIVE {_sql_roots(_CHANGED, 'zero')}{_NODES} SELECT tree, lev AS level, pos, h AS hash FROM nd JOIN sz USING (tree) WHERE pos << lev < sz.n UNION ALL SELECT tree, lev, 0, l[1] FROM up WHERE lev = h")
def merkle_incremental(spark, d):
    """A tree of a third of the orders: some leaves change, the others are appended and the tree doubles twice; only what is above them is hashed.

    Nodes over missing leaves alone are not kept, so the SQL's are left out of the comparison.
    """
    leaves = _order_leaves(spark, d)
    sizes = leaves.groupBy("tree").agg(F.count("*").alias("n"))
    rows = leaves.join(F.broadcast(sizes), "tree")  # two trees
    third = F.floor(F.col("n") / 3)
    table_ = written(M.nodes(rows.filter(F.col("idx") < third).select("tree", "idx", "hash"), "tree"))
    gone = rows.filter((F.col("idx") < third) & (F.col("idx") % 50 == 7)).select("tree", "idx", F.lit(ZERO_HASH).alias("hash"))
    new = rows.filter(F.col("idx") >= third).select("tree", "idx", "hash")
    return M.update_nodes(table_, gone.unionByName(new), "tree").select("tree", "level", "pos", "hash")


# -- write-ahead entries ---------------------------------------------------------------------------


def _entries(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    op = F.when((F.col("event_type") == "signup") & (F.col("event_id") % 97 == 0), "COMMIT").when(F.col("event_type") == "error", "TOMBSTONE").otherwise("ADD")
    rows = e.select(F.col("event_id").alias("seq"), F.lit(1700000000000).alias("ts"), op.alias("op"), F.concat(F.lit("v1.other.u"), F.col("user_id")).alias("data"), F.col("user_id").alias("index"))
    return rows.withColumn("data", F.when(F.col("op") == "ADD", F.col("data"))).withColumn("index", F.when(F.col("op") != "COMMIT", F.col("index")))


_WAL = """w AS (SELECT event_id AS seq, 1700000000000 AS ts, CASE WHEN event_type = 'signup' AND event_id % 97 = 0 THEN 'COMMIT' WHEN event_type = 'error' THEN 'TOMBSTONE' ELSE 'ADD' END AS op, user_id FROM events),
en AS (SELECT seq, ts, op, CASE WHEN op = 'ADD' THEN 'v1.other.u' || user_id END AS data, CASE WHEN op <> 'COMMIT' THEN user_id END AS index FROM w),
un AS (SELECT * FROM en WHERE seq > coalesce((SELECT max(seq) FROM en WHERE op = 'COMMIT'), -1))"""


@query(f"WITH {_WAL} SELECT seq, op, data, index FROM un")
def wal_uncommitted(spark, d):
    return W.uncommitted(_entries(spark, d)).select("seq", "op", "data", "index")


# leaf and data go together here, so an addition stands if it is the first of its user since the user's last tombstone,
# and none follows; a tombstone stands if no addition stood before it and it is the user's first such
@query(f"""WITH {_WAL}, g AS (SELECT *, sum((op = 'TOMBSTONE')::INT) OVER (PARTITION BY index ORDER BY seq) AS marks, sum((op = 'TOMBSTONE')::INT) OVER (PARTITION BY index) AS all_marks, lag(op) OVER (PARTITION BY index ORDER BY seq) AS before FROM un WHERE op <> 'COMMIT'),
a AS (SELECT min(seq) AS seq, 'ADD' AS op, data, index FROM g WHERE op = 'ADD' AND marks = all_marks GROUP BY data, index),
t AS (SELECT min(seq) AS seq, 'TOMBSTONE' AS op, NULL AS data, index FROM g WHERE op = 'TOMBSTONE' AND (before IS NULL OR before = 'TOMBSTONE') GROUP BY index)
SELECT * FROM a UNION ALL SELECT * FROM t""")
def wal_compact(spark, d):
    return W.compact(_entries(spark, d))


@query(f"""WITH {_WAL} SELECT seq, substr(sha256('{{"seq":' || seq || ',"ts":' || ts || ',"op":"' || op || '"' || CASE WHEN data IS NOT NULL THEN ',"data":"' || data || '"' ELSE '' END || CASE WHEN index IS NOT NULL THEN ',"index":' || index ELSE '' END || '}}'), 1, 8) AS ck FROM en""")
def wal_checksum(spark, d):
    return _entries(spark, d).select("seq", W.checksum(*[F.col(c) for c in ("seq", "ts", "op", "data", "index")]).alias("ck"))


@query(f"""WITH RECURSIVE {_sql_roots(_ORDERS, 'zero')}, m AS (SELECT sha256(sha256(max(root) FILTER (WHERE tree = 0))) AS h0, max(root) FILTER (WHERE tree = 0) AS r0, max(root) FILTER (WHERE tree = 1) AS r1 FROM (SELECT tree, l[1] AS root FROM up WHERE lev = h))
SELECT lv.tree, lv.idx, lv.idx % 5 <> 0 AS valid, sha256(unhex(sha256(r0)) || unhex(sha256(r1))) AS root FROM lv, m""")
def report_validate(spark, d):
    """Leaf to shard to master, with the root of a forged leaf in every fifth place."""
    leaves = _order_leaves(spark, d)
    held = M.held_spans(leaves, "tree")
    roots = written(M.roots(leaves, "tree", held=held).select(F.lit(0).alias("version"), F.col("tree").alias("shard"), "root"))
    master = M.master_root(roots).select("root")
    upper = roots.select(F.lit(0).alias("m"), F.col("shard").cast("long").alias("idx"), F.sha2(F.col("root").cast("binary"), 256).alias("hash"))
    upper_paths = M.audit_paths(upper, "m", zero_pad=False).select(F.col("idx").alias("tree"), F.col("path").alias("shard_path"))
    rows = M.audit_paths(leaves, "tree", held=held).join(F.broadcast(upper_paths), "tree").crossJoin(F.broadcast(master))  # two trees, and one row
    leaf = F.when(F.col("idx") % 5 == 0, F.lit(ZERO_HASH)).otherwise(F.col("hash"))
    return rows.select("tree", "idx", M.valid_report(leaf, F.col("idx"), F.col("path"), F.col("tree"), F.col("shard_path"), F.col("root")).alias("valid"), "root")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'unknown version' WHEN c_custkey % 11 = 0 THEN 'no root' WHEN c_custkey % 2 = 0 AND c_custkey % 3 = 0 THEN 'bad leaf' WHEN c_custkey % 2 = 1 AND c_custkey % 5 = 0 THEN 'no openings' END AS problem FROM customer""")
def proof_shapes(spark, d):
    k, h = F.col("c_custkey"), F.sha2(F.col("c_name").cast("binary"), 256)
    version = F.when(k % 7 == 0, 3).when(k % 2 == 0, 1).otherwise(2)
    problem = M.proof_problem(version, F.when(k % 3 == 0, F.lit("zz")).otherwise(h), F.when(k % 11 == 0, F.lit("")).otherwise(h), F.lit(4), F.when(k % 5 == 0, 0).otherwise(2))
    return table(spark, d, "customer").select("c_custkey", problem.alias("problem"))
