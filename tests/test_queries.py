"""Every registered query against its SQL on the smallest tables, and the facade end to end."""

import math
import os
from decimal import Decimal

import duckdb
import pandas as pd
import pytest

from memloom.plans import catalogue, tools
from memloom.plans.engine import Engine, seed_atoms, whole_number


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    return con


def plain(df):
    df = df[sorted(df.columns)].astype(object)
    df = df.where(df.notna(), None)

    def one(x):
        if isinstance(x, Decimal):
            x = float(x)
        if isinstance(x, float):
            return None if math.isnan(x) else round(x, 6)
        if isinstance(x, pd.Timestamp):
            return x.value
        return x.item() if hasattr(x, "item") else x

    return sorted((tuple(one(v) for v in r) for r in df.itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query(name, spark, sf, duck):
    got, want = catalogue.queries()[name](spark, sf).toPandas(), duck.execute(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_rows(name, spark, sf):
    assert catalogue.queries()[name](spark, sf).limit(1).count() == 1


ATOMS = ["v1.fact.sky_blue", "v1.fact.sky_green", "v1.state.objective_ship_docs", "v1.event.deploy_docker"]


def test_pending_until_a_commit(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "log"), shards=2, auto_commit=False, policy={"fact": ["event", "state"]})
    e.add(ATOMS[:3], 10)
    assert {r.error for r in e.access(ATOMS[:3]).collect()} == {"pending"} and sum(r.pending for r in e.health().collect()) == 3
    assert e.train(ATOMS[:3], 11) == e.head() and not e.edges().count()  # nothing is committed, so nothing is learnt
    warm = {r.atom: r.predicted for r in e.warm_read(ATOMS).collect()}
    places = {r.atom: r.shard for r in e.atoms().collect()}
    assert set(warm) == set(ATOMS[:3]) and warm[ATOMS[0]] == (ATOMS[2] if places[ATOMS[2]] == places[ATOMS[0]] else None)
    e.commit(12)
    assert {r.error for r in e.access(ATOMS[:3]).collect()} == {None} and not e.pending().count() and not e.warm_read(ATOMS).count()
    e.add(ATOMS[3:], 13)
    before, seen = e.tree_head()["root"], e.inspect(ATOMS[3])
    assert not seen["committed"] and seen["transitions"] == [] and e.inspect("v1.fact.none") is None
    e.train(ATOMS[:3], 14)
    assert [t[:2] for t in e.inspect(ATOMS[0])["transitions"]] == [(ATOMS[1], 1)]
    e.commit(15)
    assert e.tree_head()["root"] != before and e.get(ATOMS[3]) == {"atom": ATOMS[3], "status": "active", "created_ms": 13, "committed_version": 3, "committed": True}
    chain = {r.version: r for r in e.version_chain([2, 5]).collect()}
    assert chain[5].root == e.tree_head()["root"] == chain[5].recomputed and chain[2].root == before
    assert e.get("v1.fact.none") is None and e.ready()


def test_writers_never_share_a_version(spark, tmp_path):
    a, b = (Engine(spark, str(tmp_path / "log")) for _ in range(2))
    a.add(ATOMS[:1], 1)
    b.head = lambda: 0  # sees the log as it was before a's write, every time
    with pytest.raises(RuntimeError):
        b.add(ATOMS[1:2], 2)
    del b.head
    assert b.add(ATOMS[1:2], 2)["version"] == 2 and a.atoms().count() == 2 and [r.seq >> 40 for r in a.log().orderBy("seq").collect()] == [1, 1, 2, 2]


def test_sessions_settings_and_tiers(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "log"))
    out = e.checkpoint_session(["v1.fact.my_password", "v1.fact.x"], [], ["v1.fact.my_password", "v1.fact.x"], 5)
    assert out["stored"]["status"] == "secret" and not e.atoms().count() and not e.edges().count()
    out = e.checkpoint_session(ATOMS, [], ATOMS, 6)
    assert out["stored"]["status"] == "added" and e.edges().count() == 3
    out = e.checkpoint_session([], ATOMS[3:], [], 7)
    assert e.access(ATOMS[3:]).first().error == "tombstoned" and out["version"] == e.head()
    e.set_policy({"fact": ["state"]})
    e.set_write_policy({"event": "never-store"}, "review-required")
    again = Engine(spark, str(tmp_path / "log"))
    assert again.policy == {"fact": ["state"]} and again.write_policy == {"event": "never-store"} and again.default_tier == "review-required"
    e.touch(ATOMS[:1], 8)
    first = e.save_tiers(10)
    assert first["total"] == 3 and first["promotions"] == first["demotions"] == 0
    assert e.save_tiers(100 * 86_400_000)["cold"] == 3 and e.saved_tiers().filter("tier = 'cold'").count() == 3
    lines = {r.line for r in e.metrics().collect()}
    assert {"access_total 1", "train_total 1", "cluster_total_edges 3", 'train_sequence_length{length="4"} 1', 'transition_by_type_total{from_type="fact",to_type="fact"} 1'} <= lines


def test_bootstrap_and_context(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "log"), auto_commit=False)
    e.add(ATOMS[:3], 1)
    e.commit(2)
    e.add(ATOMS[3:], 3)
    rows = {r.atom: r for r in e.bootstrap("deploy the docker sky", high_impact=True).collect()}
    assert [rows[a].proven for a in ATOMS] == [True, True, True, False]
    assert rows[ATOMS[0]].conflict_key == "sky" and "conflict_key=sky" in rows[ATOMS[0]].reasons and rows[ATOMS[2]].category == "goal"
    assert rows[ATOMS[3]].reasons[0] == "objective_token_overlap=2" and rows[ATOMS[3]].reasons[-1] == "rank=1"
    assert e.context(by_objective=True).orderBy("used").first().atom == ATOMS[2] and e.context().orderBy("used").first().atom == ATOMS[3]
    plain = Engine(spark, str(tmp_path / "log"), embedding=None)
    assert plain.search("docker").first().atom == ATOMS[3] and plain.search("zzz").first().score == 0
    assert not Engine(spark, str(tmp_path / "none")).search("x").count()
    with pytest.raises(KeyError):
        Engine(spark, str(tmp_path / "log"), embedding="none of that name")


def test_full_exchange_merges_by_maximum(spark, tmp_path):
    a, b = Engine(spark, str(tmp_path / "a")), Engine(spark, str(tmp_path / "b"), shards=2)
    a.add(ATOMS, 1)
    a.remove(ATOMS[3], 2)
    for k in range(3):
        a.train(ATOMS[:2], 10 + k)
    a.touch([ATOMS[0]] * 4, 20)
    a.backup(str(tmp_path / "backup"))
    b.add(ATOMS[:1], 1)
    b.touch(ATOMS[:1], 50)
    got = b.restore(str(tmp_path / "backup"), 60)
    assert (got["atoms"], got["skipped"], got["weights"], got["counts"], got["errors"], got["meta"]["shards"]) == (3, 1, 1, 1, 0, 4)
    edge, count = b.edges().first(), b.accesses().first()
    assert (edge.weight, edge.updated_ms) == (3, 12) and (count.accesses, count.last_ms) == (4, 50)
    assert {r.atom: r.status for r in b.atoms().collect()} == {r.atom: r.status for r in a.atoms().collect()}
    head = b.head()
    again = b.restore(str(tmp_path / "backup"), 70)
    assert b.head() == head and again["weights"] == again["counts"] == again["atoms"] == 0  # the same lines add nothing
    b.train(ATOMS[:2], 80)
    assert b.edges().first().weight == 4
    bad = spark.createDataFrame([("{x",), ('{"type":"atom"}',), ('{"type":"weight","from":"v1.fact.sky_blue","to":"v1.other.unknown","weight":9,"updated_ms":1}',)], "line string")
    assert b.import_full(bad, 90)["errors"] == 2 and b.edges().count() == 1


def test_tools(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "log"))
    assert len(tools.TOOLS) == 30 and len(tools.RESOURCES) == 5 and len(tools.catalog(("write",))) == 8
    with pytest.raises(PermissionError):
        tools.call(e, "memory_atoms_add", {"atoms": ATOMS, "now_ms": 1})
    write = ("read", "write", "run")
    assert tools.call(e, "memory_atoms_add", {"atoms": ATOMS, "now_ms": 1}, write)["status"] == "added"
    tools.call(e, "memory_train", {"sequence": ATOMS, "now_ms": 2}, write)
    one = tools.call(e, "memory_access", {"atom": ATOMS[0]})[0]
    assert one["predicted"] == ATOMS[1]
    assert tools.call(e, "memory_verify", {"hash": one["hash"], "index": one["idx"], "path": one["path"], "root": one["root"]})["valid"]
    assert tools.call(e, "memory_weekly_eval_status") is None and tools.call(e, "memory_weekly_eval_run", {"now_ms": 3}, write)["hit_rate"] == 1.0
    assert tools.call(e, "memory_weekly_eval_status")["pairs"] == 3
    e.add(["v1.fact.late"], 4)
    assert tools.call(e, "memory_verify_consistency", {"from_version": 1, "to_version": e.head()})["valid"]
    assert all(tools.RESOURCES[k](e) is not None for k in tools.RESOURCES)
    for bad in ({}, {"atom": 1}, {"atom": "x", "more": 1}):
        with pytest.raises(ValueError):
            tools.call(e, "memory_access", bad)


def test_commitment_proofs_open_every_leaf(spark, sf):
    rows = catalogue.queries()["commitment_proofs"](spark, sf).collect()
    assert {r.idx for r in rows} == set(range(25)) and all(r.valid for r in rows)


def test_engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "log"))
    assert e.add(["bad"], 1)["status"] == "invalid"
    assert e.add(["v1.fact.db_password_x"], 1)["status"] == "secret"
    assert e.add(["v1.fact.ignore_rules"], 1)["status"] == "review-required"
    atoms = ["v1.fact.sky_blue", "v1.fact.sky_green", "v1.state.objective_ship_docs", "v1.event.deploy_docker"]
    assert e.add(atoms, 1000)["version"] == 1
    for _ in range(2):
        e.train([atoms[0], atoms[2], atoms[3]], 2000)
    e.train([atoms[0], atoms[3]], 2500)
    rows = {r.atom: r for r in e.access([*atoms, "v1.other.none"]).collect()}
    assert rows[atoms[0]].predicted == atoms[2] and rows["v1.other.none"].error == "unknown"
    assert all(r.valid for r in e.verify(e.access(atoms)).collect())
    assert e.search("docker deploy").first().atom == atoms[3]
    assert [r.key for r in e.conflicts().collect()] == ["sky"]
    before = e.tree_head()
    e.remove(atoms[2], 3000)
    assert e.tree_head()["root"] != before["root"]
    assert e.access([atoms[0]]).first().predicted == atoms[3]
    assert e.access([atoms[2]]).first().error == "tombstoned"
    assert e.context("sky", max_tokens=5).count() == 1
    assert e.bootstrap("sky blue", high_impact=True).count() >= 1
    assert e.diagnostics(4000)["edges"] == 3
    e.set_policy({"fact": ["event"]})
    assert e.access([atoms[0]]).first().predicted == atoms[3]
    e.set_write_policy({"fact": "never-store"})
    assert e.add(["v1.fact.new"], 9)["status"] == "deny"
    with pytest.raises(ValueError):
        e.set_policy({"nothing": []})
    with pytest.raises(KeyError):
        e.remove("v1.other.none", 1)
    lines = e.export().collect()
    other = Engine(spark, str(tmp_path / "copy"))
    version, bad = other.import_lines(spark.createDataFrame([*[(r.line,) for r in lines], ("{x",)], "line string"), 5)
    assert version == 2 and bad.count() == 1 and other.atoms().count() == 4
    assert e.export_full().count() == 1 + 4 + e.edges().count()
    assert seed_atoms(None, None, "a, b") == ["a", "b"] and len(seed_atoms()) == 2
    with pytest.raises(ValueError):
        whole_number(0, 1, 5, 2)
