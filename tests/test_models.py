"""Operators against plain Python models."""

import hashlib
import math
import random

from pyspark.sql import functions as F

from memloom.functions import atoms as A
from memloom.functions import curve as C
from memloom.functions import hashing as H
from memloom.functions import retention as R
from memloom.operators import commitments as V
from memloom.operators import edges as E
from memloom.operators import learning as G
from memloom.operators import log as L
from memloom.operators import merkle as M
from memloom.operators import ppm as P
from memloom.operators import wal as W
from memloom.operators.ordinal import dense_index


def jump(atom, n):
    k, b, j = int(hashlib.sha256(atom.encode()).hexdigest()[:16], 16), -1, 0
    while j < n:
        b, k = j, (k * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((k >> 33) + 1)))
    return b


def test_jump_shards(spark):
    atoms = [f"v1.other.N_{k:03d}" for k in range(200)]
    df = spark.createDataFrame([(a,) for a in atoms], "a string")
    got = {r.a: (r.s1, r.s2, r.s4, r.s8) for r in df.select("a", *[H.jump_shard(F.col("a"), n).alias(f"s{n}") for n in (1, 2, 4, 8)]).collect()}
    assert got == {a: tuple(jump(a, n) for n in (1, 2, 4, 8)) for a in atoms}
    assert [got[a][2] for a in atoms[:10]] == [3, 2, 3, 1, 2, 3, 3, 3, 1, 2]


def test_rounded_hash_values(spark):
    df = spark.createDataFrame([("w:test",), ("n:tes",), ("w:a",)], "t string")
    assert [r[0] for r in df.select(H.rounded_fnv(F.col("t"))).collect()] == [698226028, 1613868809, 135331781]


def tree_root(hashes, zero):
    level = list(hashes)
    if zero:
        level += ["0" * 64] * ((1 << (len(level) - 1).bit_length()) - len(level))
    while len(level) > 1:
        level += [level[-1]] * (len(level) % 2)
        level = [hashlib.sha256(bytes.fromhex(a + b)).hexdigest() for a, b in zip(level[::2], level[1::2])]
    return level[0]


def test_roots_paths_and_forgeries(spark):
    rows, want = [], {}
    for n in (1, 2, 3, 5, 8, 257, 600):
        hs = [hashlib.sha256(f"{n}/{k}".encode()).hexdigest() for k in range(n)]
        rows += [(n, k, h) for k, h in enumerate(hs)]
        want[n] = (tree_root(hs, True), tree_root(hs, False))
    leaves = spark.createDataFrame(rows, "t int, idx long, hash string")
    for zero in (True, False):
        got = {r.t: r.root for r in M.roots(leaves, "t", zero_pad=zero).collect()}
        assert got == {n: w[0 if zero else 1] for n, w in want.items()}
        paths = M.audit_paths(leaves.filter("t < 100"), "t", zero_pad=zero)
        ok = paths.select("t", M.root_of_path(F.col("hash"), F.col("idx"), F.col("path")).alias("r")).collect()
        assert all(r.r == got[r.t] for r in ok)
    known = [hashlib.sha256(f"v1.other.{x}".encode()).hexdigest() for x in ("Alpha", "Beta", "Gamma", "Delta")]
    df = spark.createDataFrame([(0, k, h) for k, h in enumerate(known)], "t int, idx long, hash string")
    assert M.roots(df, "t").first().root == "c6227029189ce6343b9a1802c00a028a91281b1b3f02db80bfec6b4964feb3c7"
    assert M.roots(df.filter("idx < 3"), "t", zero_pad=False).first().root == "865f0808104bc804f1322fb3651cb38c92cd3d7c046ea49bfcf80023f28a0a78"


def test_decay_values(spark):
    one = spark.range(1)
    fact = R.half_life(F.lit(0), F.lit(0), F.lit("fact"), F.lit("default"))
    human = R.half_life(F.lit(5), F.lit(10), F.lit("procedure"), F.lit("human"))
    got = one.select(fact, human, R.decayed(F.lit(10.0), F.lit(5), F.lit(5.0)), *[R.spike_increment(F.lit(t * 1000), 300_000.0) for t in (0, 60, 300, 3000)], R.spike_increment(F.lit(9), 0)).first()
    assert math.isclose(got[0], 458_352_689.713, rel_tol=1e-9) and math.isclose(got[1], 3_930_001_994.53, rel_tol=1e-9)
    assert got[2] == 5 and list(got[3:]) == [1000, 819, 368, 1, 1]


def test_scenarios(spark):
    def train(*parts):
        rows, k = [], 0
        for seq, times in parts:
            for _ in range(times):
                for pos, a in enumerate(seq):
                    rows.append((len(rows) - pos, pos, a, k, k))
                    k += 1
        df = spark.createDataFrame(rows, "s long, pos int, atom string, ts_ms long, seq long")
        return {r.from_atom: r.to_atom for r in E.top_edge(E.edge_weights(E.transitions(df, "s", "pos"))).collect()}

    assert train((["A", "B", "C", "D"], 3)) == {"A": "B", "B": "C", "C": "D"}
    assert train((["R", "D", "E"], 5), (["R", "M", "E"], 1)) == {"R": "D", "D": "E", "M": "E"}
    assert train((["A", "B", "C", "A", "B", "C"], 4)) == {"A": "B", "B": "C", "C": "A"}
    assert train((["S", "D"], 20), (["S", "N"], 1)) == {"S": "D"}
    assert train((["S", "X"], 2), (["S", "Y"], 2)) == {"S": "X"}  # a tie: the first learned


def test_paths_against_a_trie(spark):
    rng = random.Random(3)
    seqs = [[rng.choice("abcd") for _ in range(rng.randint(1, 9))] for _ in range(40)]
    rows, k = [], 0
    counts = {}
    for s, seq in enumerate(seqs):
        for pos, a in enumerate(seq):
            rows.append((s, pos, a, k))
            k += 1
            for o in range(1, min(3, pos) + 1):
                for path in (tuple(seq[pos - o : pos]), tuple(seq[pos - o : pos + 1])):
                    counts[path] = counts.get(path, 0) + 1
    df = spark.createDataFrame(rows, "s int, pos int, atom string, seq int")
    nodes = P.path_counts(df, "s", "pos")
    assert {tuple(r.path): r["count"] for r in nodes.collect()} == counts
    asked = spark.createDataFrame([(0, ["a", "b", "c"]), (1, ["zz"]), (2, ["zz", "a"])], "key int, history array<string>")
    got = {r.key: r for r in P.predict(asked, nodes).collect()}
    assert got[1].predicted is None and got[2].order == 1
    for n in (3, 2, 1):
        ctx = tuple("abc"[3 - n :])
        kids = {p[-1]: c for p, c in counts.items() if p[:-1] == ctx}
        if kids and max(kids.values()) / sum(kids.values()) >= 0.3:
            assert got[0].order == n and kids[got[0].predicted] == max(kids.values())
            break
    assert P.prune(nodes, 50).count() <= 45 and not P.invalid_nodes(nodes).count()


def test_log_views(spark):
    rows = [(0, 10, "ADD", "v1.fact.a", 1), (1, 11, "ADD", "v1.fact.b", 1), (2, 20, "TOMBSTONE", "v1.fact.a", 2), (3, 30, "ADD", "v1.fact.a", 3), (4, 40, "ADD", "v1.fact.b", 4)]
    view = {r.atom: r for r in L.atoms_view(spark.createDataFrame(rows, L.MUTATIONS)).collect()}
    assert view["v1.fact.a"].status == "tombstoned" and view["v1.fact.b"].committed_version == 4 and view["v1.fact.b"].created_ms == 11
    df = spark.createDataFrame([(g, s) for g in (0, 1) for s in random.Random(g).sample(range(10**7), 300)], "g int, s long")
    got = dense_index(df, "g", "s", span=1000).collect()
    for g in (0, 1):
        assert [r.idx for r in sorted((r for r in got if r.g == g), key=lambda r: r.s)] == list(range(300))


def wal_model(entries):
    last = max([k for k, e in enumerate(entries) if e[1] == "COMMIT"], default=-1)
    live, by_index, by_data, marks = {}, {}, {}, {}
    for seq, op, data, index in entries[last + 1 :]:
        if op == "ADD" and data not in by_data:
            live[seq] = (seq, op, data, index)
            by_index[index], by_data[data] = seq, seq
        elif op == "TOMBSTONE":
            if index in by_index:
                e = live.pop(by_index.pop(index))
                by_data.pop(e[2], None)
            elif index not in marks:
                marks[index] = (seq, op, None, index)
    return sorted([*live.values(), *marks.values()])


def test_wal_compaction(spark):
    rng = random.Random(8)
    entries = []
    for k in range(400):
        op = "COMMIT" if k == 60 else rng.choice(["ADD", "ADD", "TOMBSTONE"])
        i = rng.randint(0, 12)
        entries.append((k, op, f"d{i}" if op == "ADD" else None, i if op != "COMMIT" else None))
    df = spark.createDataFrame(entries, "seq long, op string, data string, index long")
    assert sorted(tuple(r) for r in W.compact(df).select("seq", "op", "data", "index").collect()) == wal_model(entries)


def test_commitments(spark):
    hashes = [hashlib.sha256(str(k).encode()).hexdigest() for k in range(21)]
    leaves = spark.createDataFrame(list(enumerate(hashes)), "idx long, hash string")
    levels = V.tree(leaves)
    assert levels[-1].first().commitment == V.local_root(hashes)
    openings = V.proofs(levels, leaves.filter("idx in (0, 7, 20)"))
    assert {r.idx: r.valid for r in V.verify(openings).collect()} == {0: True, 7: True, 20: True}
    forged = openings.withColumn("value", F.when(F.col("level") == 0, F.lit(f"{5:064x}")).otherwise(F.col("value")))
    assert not any(r.valid for r in V.verify(forged).collect())
    p = C.multiply(12345, C.generators(1)[0])
    assert C.decompress(C.compress(p)) == p and C.add(p, None) == p and C.multiply(C.N, p) is None


def test_model_fit_lowers_loss(spark):
    rng = random.Random(5)
    rows = []
    for a in range(12):
        t = 0
        for k in range(30):
            t += int(rng.expovariate(1 / (3_600_000 * (a + 1)))) + 1
            rows.append((f"v1.procedure.x{a}", rng.choice(["access", "access", "train"]), t))
    ex = G.examples(spark.createDataFrame(rows, "atom string, kind string, ts_ms long")).cache()
    start = list(R.THETA.values())
    assert G.loss(ex, G.fit(ex)).first().loss < G.loss(ex, start).first().loss


def test_atom_edges(spark):
    texts = ["v1.fact.x", "v1.fact. ", "v1.nope.x", "v1.fact.a\nb", "v1.fact.a\n", "", None, "v1.state.  y  "]
    df = spark.createDataFrame([(t,) for t in texts], "a string")
    got = [(r[0], r[1]) for r in df.select(A.atom_type(F.col("a")), A.atom_value(F.col("a"))).collect()]
    assert got == [("fact", "x"), (None, None), (None, None), (None, None), (None, None), (None, None), (None, None), ("state", "y")]


def test_sql_names(spark):
    from memloom.functions.register import register

    names = register(spark, "mem_")
    row = spark.sql("SELECT mem_atom_type('v1.fact.x y') t, mem_atom_value('v1.fact. x ') v, mem_atom_type('v3.fact.x') n, mem_estimate_tokens('abcde') k, mem_atom_tokens('A-b 1') w, mem_has_secret('api-Key') s, mem_decayed(8, 2, 1) d, mem_hybrid_score(0.5, 0.25) h").first()
    assert tuple(row) == ("fact", "x", None, 2, ["a", "b", "1"], True, 2.0, 0.52) and len(names) == 9


def test_generators():
    from memloom.sources import generators as G

    chain = G.domain_chains({"a": ["x", "y", "z"], "b": ["u", "v"]})
    walks = G.random_walks(chain, 50, 6, seed=3)
    assert walks == G.random_walks(chain, 50, 6, seed=3) and all(len({a.split("_")[0] for a in w}) == 1 for w in walks)
    assert G.dominant_next(chain)["v1.other.a_x"] == "v1.other.a_y" and len(G.batches(walks, 20)) == 3
    assert all(len(w) <= 5 for w in G.random_walks(G.shop_chain(4), 20, 5))
    vocab = {"a": [1.0, 2.0], "##b": [0.5, -1.0]}
    dims, back = G.read_vocabulary(G.write_vocabulary(vocab))
    assert dims == 2 and {k: v.tolist() for k, v in back.items()} == vocab
