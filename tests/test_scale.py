"""What queries shuffle and hold: in proportion to their input, not to its square or to its levels."""

import hashlib
import math
import random
import tracemalloc

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from memloom.functions import embedding as N
from memloom.operators import blocks as K
from memloom.operators import commitments as V
from memloom.operators import merkle as M
from memloom.plans import catalogue


def shuffled(spark, run):
    """Rows that run writes into shuffles."""
    sc = spark.sparkContext._jsc.sc()

    def written() -> int:
        sc.listenerBus().waitUntilEmpty()
        stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))

    before = written()
    run()
    return written() - before


def leaves_of(spark, *sizes):
    rows = [(t, k, hashlib.sha256(f"{t}/{k}".encode()).hexdigest()) for t, n in enumerate(sizes) for k in range(n)]
    return spark.createDataFrame(rows, "t int, idx long, hash string")


def keep(df):
    df.write.format("noop").mode("overwrite").save()


def test_paths_shuffle_no_row_a_leaf_and_level(spark):
    leaves = leaves_of(spark, 3000, 2)
    for zero in (True, False):
        assert shuffled(spark, lambda: keep(M.audit_paths(leaves, "t", zero_pad=zero))) < 300


def test_wanted_paths_are_those_of_all(spark):
    leaves = leaves_of(spark, 1, 2, 256, 257, 700)
    wanted = spark.createDataFrame([(0, 0), (2, 255), (3, 256), (4, 300), (4, 699), (9, 1)], "t int, idx long")
    every = {(r.t, r.idx): r.path for r in M.audit_paths(leaves, "t").collect()}
    some = {(r.t, r.idx): r.path for r in M.audit_paths(leaves, "t", wanted=wanted).collect()}
    assert some == {k: every[k] for k in [(0, 0), (2, 255), (3, 256), (4, 300), (4, 699)]}
    one = leaves_of(spark, 1, 1)
    assert [(r.t, r.path) for r in M.audit_paths(one, "t", wanted=wanted).collect()] == [(0, [])]


def test_order_proofs_shuffle_no_row_an_order_and_level(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet").count()
    for name in ("merkle_paths", "merkle_verify", "report_validate"):
        assert shuffled(spark, lambda: keep(catalogue.queries()[name](spark, sf))) < orders, name


@pytest.fixture(scope="module")
def parts(tmp_path_factory):
    """2,000 parts of seven names, some of the same words, and one of none."""
    at = tmp_path_factory.mktemp("parts")
    names = "['blue ring', 'ring blue', 'blue blue ring', 'hot bolt', 'blue bolt', 'x', '-']"
    duckdb.sql(f"copy (select i as p_partkey, ({names})[i * i % 7 + 1] as p_name from range(2000) t(i) where i % 700 <> 1) to '{at}/part.parquet' (format parquet)")
    return str(at)


def of_sql(name, at):
    con = duckdb.connect()
    con.execute(f"create view part as select * from '{at}/part.parquet'")
    return con.execute(catalogue.oracle_sql()[name]).df()


def rounded(df, *keys):
    return [tuple(round(float(x), 6) for x in r) for r in df.sort_values(list(keys))[sorted(df.columns)].itertuples(index=False)]


def test_sets_of_words_are_paired_once(spark, parts):
    found = []
    assert shuffled(spark, lambda: found.append(catalogue.queries()["jaccard_topk"](spark, parts).toPandas())) < 2000
    assert rounded(found[0], "a", "rank") == rounded(of_sql("jaccard_topk", parts), "a", "rank")


def test_names_of_the_same_words_are_scored_once(spark, parts, monkeypatch):
    tables, write = [], K.written
    monkeypatch.setattr(K, "CHUNK", 1)
    monkeypatch.setattr(K, "written", lambda df: tables.append(0) or write(df))
    got = catalogue.queries()["ngram_cosine_topk"](spark, parts).toPandas()
    assert len(tables) < 12  # 20 parts ask, of four names
    assert rounded(got, "a", "rank") == rounded(of_sql("ngram_cosine_topk", parts), "a", "rank")


def test_updated_nodes_are_those_of_the_new_trees(spark):
    new = leaves_of(spark, 1, 100, 256, 257, 700, 300)
    for known in ("idx < 1", "idx < 256", "idx < 128 + t", "t < 5"):
        old = new.filter(known).withColumn("hash", F.when(F.col("idx") % 90 == 5, F.lit("0" * 64)).otherwise(F.col("hash")))
        changed = new.join(old.filter("idx % 90 <> 5").select("t", "idx"), ["t", "idx"], "left_anti")
        got = M.update_nodes(M.nodes(old, "t"), changed, "t").collect()
        assert len(got) == len(set(got)) and set(got) == set(M.nodes(new, "t").select("t", "level", "pos", "hash").collect())


def test_an_update_shuffles_no_row_a_node(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet").count()
    assert shuffled(spark, lambda: keep(catalogue.queries()["merkle_incremental"](spark, sf))) < orders // 3


def test_slices_cost_the_words_they_share():
    """A chunk of 4,000 queries of 12 words each, and texts: no table of texts by words, and the scores of plain sums."""
    import pyarrow as pa

    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(30_000)]
    texts = [" ".join(rng.choices(vocabulary, k=40)) for _ in range(60)] + [None, ""]
    asked = [" ".join(rng.sample(vocabulary, 12)) for _ in range(3990)] + [" ".join(t.split()[:12]) for t in texts[:10]]
    df = {w: 1 + k % 40 for k, w in enumerate(vocabulary)}
    own = [None] * 3990 + texts[:10]
    queries = pa.table({"q": list(range(4000)), "t": asked, "o": pa.array(own, pa.string())})
    tracemalloc.start()
    score = K.Lexical(queries, "q", "t", df, 1000, 40.0, own="o")
    got = score(pa.array(texts))
    assert tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()
    for k in (0, 3990, 3999):
        ws = sorted(set(asked[k].split()))
        idf = {w: math.log((1000 - df[w] + 0.5) / (df[w] + 0.5) + 1) for w in ws}
        for d, t in enumerate(texts):
            found = (t or "").split()
            s = sum(idf[w] * found.count(w) * 2.2 / (found.count(w) + 1.2 * (0.25 + 0.75 * len(found) / 40)) for w in ws) / (2.2 * sum(idf.values()))
            assert abs(got[k, d] - s) < 1e-12 if s > 0 else got[k, d] == -math.inf
    assert all(score.floor[3990 + k] == round(got[3990 + k, k], 9) for k in range(10)) and not score.floor[:3990].any()


def test_new_words_are_hashed_together():
    rng = random.Random(6)
    found = ["a", "ab", "abc", "z9", "abcdefghij", "q" * 24, "r" * 25, "0" * 300, *("".join(rng.choices("abcxyz059", k=rng.randint(1, 30))) for _ in range(500))]
    assert np.array_equal(N.word_vectors(found), np.array([N.word_vector(w) for w in found])) and N.word_vectors([]).shape == (0, 256)
    texts = [" ".join(rng.choices(found, k=rng.randint(0, 60))) for _ in range(150)] + [None, ""]
    plain = np.array([sum((N.word_vector(w) for w in N.words(t)), np.zeros(256)) for t in texts])
    norm = np.sqrt((plain * plain).sum(axis=1, keepdims=True))
    assert np.array_equal(N.HashedNgrams().embed(texts), plain / np.where(norm > 0, norm, 1))


def test_decisions_shuffle_no_row_a_part_and_level(spark, parts, tmp_path):
    at = str(tmp_path)
    duckdb.sql(f"copy (select *, 'Brand#' || p_partkey % 9 as p_brand from '{parts}/part.parquet') to '{at}/part.parquet' (format parquet)")
    found = []
    assert shuffled(spark, lambda: found.append(catalogue.queries()["decision_evidence"](spark, at).toPandas())) < 10_000
    con = duckdb.connect()
    con.execute(f"create view part as select * from '{at}/part.parquet'")
    want = con.execute(catalogue.oracle_sql()["decision_evidence"]).df()
    assert [tuple(r) for r in found[0].sort_values("rank").itertuples(index=False)] == [tuple(r) for r in want[list(found[0].columns)].sort_values("rank").itertuples(index=False)]


def test_atoms_of_customers_are_made_in_all_tasks(spark, sf):
    rows = catalogue.queries()["atom_summary"](spark, sf)
    assert rows.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_commitments_are_made_in_all_tasks(spark):
    level = leaves_of(spark, 40).select(F.col("idx").alias("pos"), "hash")
    assert V.commit_level(level).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
