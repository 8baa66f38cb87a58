"""Near-duplicates, nearest vectors and the pipeline against brute force."""

import collections
import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from memloom.llm import ann, bpe, components, packing, pii, quality, simhash
from memloom.llm import queries as registered

from .test_text_ops import CLASH, SPACE, lower_ascii, removed_lines, whole_pieces


def brute_print(text):
    w = [x for x in re.split(SPACE, lower_ascii(text or "")) if x]
    hashes = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]).encode(), 42) for k in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    ids = sorted(prints)
    x = np.array([prints[i] for i in ids], np.uint64)
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= 4
    out = {}
    for k, i in enumerate(ids):
        stack = [k] if i not in out else []
        while stack:
            q = stack.pop()
            if ids[q] not in out:
                out[ids[q]] = i
                stack += np.flatnonzero(near[q]).tolist()
    return out


def test_simhash_components(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(-1, None), (-2, "  "), (-3, "one two"), (-4, "ONE\ttwo")], "doc_id long, text string")
    rows = docs.unionByName(more)
    prints = {r.doc_id: brute_print(r.text) for r in rows.collect()}
    want = brute_components(prints)
    got = simhash.near_duplicates(rows).collect()
    assert {r.doc_id: (r.fp % 2**64, r.component_id) for r in got} == {k: (prints[k], want[k]) for k in prints}
    kept = simhash.deduplicate(rows)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def linked(n, pairs):
    """Groups of two or more of 0 .. n - 1 that pairs join."""
    parent = list(range(n))

    def root(k):
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    groups = collections.defaultdict(list)
    for k in range(n):
        groups[root(k)].append(k)
    return sorted(g for g in groups.values() if len(g) > 1)


def planted_prints(unrelated, copies, flips, hub, seed):
    """Unrelated fingerprints, near copies of some of them, and many near copies of one."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**64, unrelated, dtype=np.uint64)
    near, many = base[:copies].copy(), np.repeat(base[:1], hub)
    for some, times in ((near, flips), (many, 3)):
        for _ in range(times):
            some ^= np.uint64(1) << rng.integers(0, 64, len(some), dtype=np.uint64)
    return np.unique(np.concatenate([base, near, many]))


def near_pairs(x, radius):
    for k in range(0, len(x), 256):
        rows, cols = np.nonzero(np.bitwise_count(x[k : k + 256][:, None] ^ x[None, :]) <= radius)
        yield from zip((rows + k).tolist(), cols.tolist())


#: The last three settings cut with one tree, cut large shards again, and deal out in blocks what no cut makes smaller.
@pytest.mark.parametrize("size, settings", [(20_000, {}), (1500, {"shard": 200, "trees": 1}), (1500, {"shard": 300, "large": 250}), (1000, {"large": 500})])
def test_vantage_points_lose_no_link(spark, size, settings):
    x = planted_prints(size, size // 10, 4, size // 16, 5)
    df = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")
    place = {int(v): k for k, v in enumerate(x.view(np.int64))}
    edges = [(place[r.a], place[r.b]) for r in simhash.hamming_links(df, **settings).collect()]
    radius = settings.get("radius", simhash.RADIUS)
    assert all((int(x[a]) ^ int(x[b])).bit_count() <= radius for a, b in edges)
    assert linked(len(x), edges) == linked(len(x), near_pairs(x, radius))


def test_trees_cut_and_overlap():
    x = planted_prints(20_000, 0, 0, 0, 2)
    for part in simhash._parts(4, 3):
        tree = simhash.grow(x, 2000, [part])
        at, leaf = simhash.route(x, tree)
        sizes = np.bincount(leaf)
        assert len(sizes) > 8 and sizes.max() <= 2000 and len(x) < len(at) < 4 * len(x) and set(at) == set(range(len(x)))


def test_simhash_odd_rows(spark):
    rows = [(None, "a b c d e"), (None, "a b c d e"), (3, "q r s t u v w"), (None, "q r s t u v w"), (5, None), (5, None), (6, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name, value in CLASH.items():
        df = df.withColumn(name, F.lit(value))
    assert sorted((str(r.doc_id), r.text) for r in simhash.deduplicate(df).collect()) == [("3", "q r s t u v w"), ("5", None), ("None", "a b c d e")]
    assert simhash.near_duplicates(df).count() == len(rows)
    assert not simhash.near_duplicates(df.limit(0)).count() and not simhash.deduplicate(df.limit(0)).count()


def test_one_row_of_each_group_stays(spark):
    words = [" ".join(f"{c}{k}" for k in range(30)) for c in "abc"]
    near = " ".join(f"c{k}" for k in range(60)), " ".join(f"C{k}  " for k in range(60))
    assert (brute_print(near[0]) ^ brute_print(near[1])).bit_count() <= 4 and near[0] != near[1]
    rows = [(1, words[0]), (1, words[1]), (2, words[1]), (None, near[0]), (None, near[1]), (None, words[0])]
    got = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 3 and {r.text for r in got if r.doc_id == 1} == set(words[:2])
    assert [r.text in near for r in got if r.doc_id is None] == [True]


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 100 + k) for k in range(50)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[k] for k in range(61)} == {0} and {got[100 + k] for k in range(50)} == {100} and len(got) == 111
    assert not components.connected_components(spark.createDataFrame([], "a long, b long")).count()


def test_nearest_recall_and_ties(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    x = np.array([r.embedding for r in e.orderBy("vec_id").collect()], np.float64)
    ids = np.array([r.vec_id for r in e.orderBy("vec_id").collect()])
    rows = collections.defaultdict(list)
    for r in ann.op3_ann(spark, sf).orderBy("query_id", "rank").collect():
        rows[r.query_id].append(r)
    hit = 0
    for q, got in rows.items():
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        best = np.lexsort((ids, -s))[:20]
        hit += len(set(ids[best]) & {r.vec_id for r in got})
        assert [r.rank for r in got] == list(range(1, 21)) and all(abs(r.score - s[ids == r.vec_id][0]) < 1e-9 for r in got)
        assert [(-r.score, r.vec_id) for r in got] == sorted((-r.score, r.vec_id) for r in got)
    assert len(rows) == (ids % 20 == 0).sum() and hit / (20 * len(rows)) >= 0.9


def vectors(kind, n, dim):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, dim))
    if kind == "clustered":
        x = 0.5 * x + rng.normal(size=(60, dim))[rng.integers(0, 60, n)]
    return (x * rng.uniform(0.5, 1.5, (n, 1))).astype(np.float32)


@pytest.mark.parametrize("kind", ["even", "clustered"])
def test_nearest_recall_over_many_blocks(spark, tmp_path, monkeypatch, kind):
    monkeypatch.setattr(ann, "BLOCK_BYTES", 1024 * 32 * 4)  # partitions of about 4,096 rows in blocks of no more
    x = vectors(kind, 24_000, 32)
    pq.write_table(pa.table({"vec_id": pa.array(np.arange(len(x))), "embedding": pa.array(list(x), pa.list_(pa.float32()))}), tmp_path / "e.parquet", row_group_size=3000)
    got = collections.defaultdict(set)
    for r in ann.nearest(spark.read.parquet(str(tmp_path / "e.parquet")), F.col("vec_id") % 100 == 0).collect():
        got[r.query_id].add(r.vec_id)
    hit = 0
    for q in range(0, len(x), 100):
        s = x.astype(np.float64) @ x[q].astype(np.float64)
        s[q] = -np.inf
        hit += len(got[q] & set(np.lexsort((np.arange(len(x)), -s))[:20].tolist()))
        assert len(got[q]) == 20
    assert hit / (20 * len(got)) >= 0.93 and len(got) == 240
    model = ann.Model(x[:8000], 6)
    assert 0 < model.share < (0.98 if kind == "even" else 0.7)


def test_nearest_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [1.0, None]), (20, [1.0, 0.0]), (7, [2.0]), (None, [1.0, 1.0]), (40, [0.0, 1.0]), (8, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x")).withColumn("part", F.lit(1)).withColumn("row", F.lit(2))
    got = [(r.query_id, r["rank"], r.vec_id) for r in ann.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(20, 1, 7), (20, 2, 1), (20, 3, 2), (20, 4, 40), (40, 1, 1), (40, 2, 2), (40, 3, 7), (40, 4, 20)]
    assert not ann.nearest(df.limit(0), F.lit(True)).count()


def test_nearest_repeated_ids_and_doubles(spark):
    tiny = 1 + 2.0**-40  # lost in single precision
    rows = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [1.0, 0.5]), (2, [tiny, 0.5])]
    got = collections.defaultdict(list)
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect():
        got[r["rank"]].append((r.query_id, r.vec_id, r.score))
    assert {k: len(v) for k, v in got.items()} == {1: 2, 2: 2, 3: 2}  # two queries, each row of an id but the query's own
    assert sorted(got[1]) == [(20, 1, 0.5), (20, 2, tiny)] and sorted(got[3]) == [(20, 20, 0.0), (20, 20, 0.0)]


def test_anisotropic_loss_falls_with_directions():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 16)).astype(np.float32)
    m = ann.Model(x, 2)
    own = m.nearest(x)
    y, u = m._pad((x - m.centres[own]) / m.scales[own][:, None]), m._directions(x)

    def loss(codes):
        r = y - m.books[np.arange(m.subs)[None, :], codes]
        return (r**2).sum() + (ann.ETA - 1) * ((r * u).sum(axis=(1, 2)) ** 2).sum()

    assert loss(m.encode(y, u)) < loss(m.encode(y, None))


def test_pipeline_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, made = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = stage(spark, docs, sf).persist()
        made.append((before, docs))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    kept = {r.doc_id for r in made[0][1].collect()}
    assert kept == {r.doc_id for r in quality.judge(made[0][0]).filter("kept").collect()}
    rows = sorted((r.doc_id, r.text) for r in made[1][0].collect())
    lined = {r.doc_id: r for r in made[1][1].collect()}
    assert [lined[k].text for k, _ in rows] == removed_lines(rows) and all(r.n_chars == len(r.text) for r in lined.values())
    assert {r.doc_id for r in made[2][1].collect()} == set(brute_components({r.doc_id: brute_print(r.text) for r in made[2][0].collect()}).values())
    spans = {r.doc_id: len(r.spans) for r in pii.find_pii(made[3][0]).collect()}
    was = {r.doc_id: r.text for r in made[3][0].collect()}
    assert all((r.text != was[r.doc_id]) == bool(spans[r.doc_id]) for r in made[3][1].collect())
    assert not any(s for r in pii.find_pii(made[3][1]).collect() for s in r.spans if s.kind in ("email", "card", "phone"))
    assert made[4][1].select("doc_id").distinct().count() == made[4][0].count()
    texts = {r.doc_id: r.text for r in made[4][0].collect()}
    enc = bpe.encoder()
    for rows in (made[4][1].collect(), corpus_pipeline.run(spark, sf).collect()):  # cuts follow the partitions, what is packed does not
        whole_pieces({k: [*enc.encode(t).tolist(), packing.END_ID] for k, t in texts.items()}, rows)


def test_stages_take_odd_rows(spark, sf):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "a b", None, "s", 3), (3, "word " * 5000, "de", None, None), (3, "word " * 5000, "de", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, value in CLASH.items():
        df = df.withColumn(name, F.lit(value))
    for frame in (df, df.limit(0)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, frame, sf)
            out.collect()
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == df.columns


def test_registered_names():
    names = [n for n in registered.queries()]
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 11)]
    assert packing.WIDTH == 2048
