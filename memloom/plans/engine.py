"""A facade: one method for each call of a memory service, over a log kept as Parquet files.

The log is the only state: atoms, trainings, accesses, commits, settings and what imports add are rows
of it, a folder a version. A version is written under another name and renamed, which fails if another
writer has taken the number; the next number is tried then. So the head is the last folder's name, an
append reads no data, and all of a version is there or none of it.

Atoms are pending until the next commit, which comes with each write unless auto_commit is off. Each
call reads the log, or appends to it; all answers are DataFrames, or the few values that describe one.
Time is a parameter of every call that depends on it.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import atoms as A
from ..functions import embedding as B
from ..functions import retention as R
from ..operators import edges as E
from ..operators import log as L
from ..operators import measures as X
from ..operators import merkle as M
from ..operators import ppm as P
from ..operators import retrieval as T
from ..operators import tiers as Z
from ..operators.ordinal import global_index
from ..operators.storage import place, rename_new, written
from ..sources import ndjson as N

#: A row's number is its version's, shifted, and its place in it.
SHIFT = 40
_ROW = "seq bigint, ts_ms bigint, op string, atom string, seq_id bigint, pos int, to_atom string, weight bigint"
LOG = _ROW + ", version bigint"
BUILT_IN_SEEDS = ("v1.fact.engine_ready", "v1.other.root")


def seed_atoms(option: list[str] | None = None, lines: list[str] | None = None, env: str | None = None) -> list[str]:
    """The first source that has any: an option, the lines of a file, a comma list, the built-in ones."""
    for found in (option, lines, [s.strip() for s in env.split(",") if s.strip()] if env else None):
        if found:
            return list(dict.fromkeys(found))
    return list(BUILT_IN_SEEDS)


def whole_number(value, low: int, high: int, default: int) -> int:
    """A parameter within limits; the default if it is missing."""
    if value is None:
        return default
    if isinstance(value, bool) or not isinstance(value, int) or not low <= value <= high:
        raise ValueError(f"a whole number from {low} to {high} is needed, not {value!r}")
    return value


@dataclass
class Engine:
    spark: SparkSession
    path: str
    shards: int = 4
    policy: dict[str, list[str]] = field(default_factory=dict)
    write_policy: dict[str, str] = field(default_factory=dict)
    default_tier: str = "auto-write"

    auto_commit: bool = True
    embedding: str | None = "ngram"

    def __post_init__(self) -> None:
        B.provider(self.embedding)  # an unknown name is an error here
        for name, default in (("policy", self.policy), ("write_policy", [self.write_policy, self.default_tier])):
            if default in ({}, [{}, "auto-write"]) and (found := self._setting(name)) is not None:
                self.policy, (self.write_policy, self.default_tier) = (found, (self.write_policy, self.default_tier)) if name == "policy" else (self.policy, found)

    # -- the log ---------------------------------------------------------------------------------
    def log(self) -> DataFrame:
        """All mutations, or none before the first write."""
        return self.spark.read.schema(LOG).parquet(self.path) if self.head() else self.spark.createDataFrame([], LOG)

    def head(self) -> int:
        """The last version; 0 before the first."""
        at, fs = place(self.spark, self.path)
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return max((int(n.partition("=")[2]) for n in names if n.startswith("version=")), default=0)

    def _append(self, rows: DataFrame, tries: int = 20) -> int:
        """Appends rows (i, ts_ms, op, atom, seq_id, pos, to_atom, weight), numbered by i, as one version."""
        columns = [c.split()[0] for c in _ROW.split(", ")[1:]]
        for _ in range(tries):
            version, aside = self.head() + 1, f"{self.path}/_new-{uuid.uuid4().hex}"
            rows.select((F.lit(version << SHIFT) + F.col("i")).alias("seq"), *columns).write.parquet(aside)
            if rename_new(self.spark, aside, f"{self.path}/version={version}"):
                return version
            at, fs = place(self.spark, aside)
            fs.delete(at, True)
        raise RuntimeError(f"{tries} versions of {self.path} were taken by others")

    def _write(self, rows: list[tuple], commit_ms: int | None = None) -> int:
        """Appends (op, atom, ts_ms, seq_id, pos, to_atom), and a commit if commit_ms says so."""
        if commit_ms is not None and self.auto_commit:
            rows = [*rows, ("COMMIT", None, commit_ms, None, None, None)]
        if not rows:
            return self.head()
        out = [(k, ts, op, atom, seq_id, pos, to, None) for k, (op, atom, ts, seq_id, pos, to) in enumerate(rows)]
        return self._append(self.spark.createDataFrame(out, _ROW.replace("seq bigint", "i bigint", 1)).coalesce(1))

    def atoms(self) -> DataFrame:
        return L.atoms_view(self.log(), self.shards)

    def _committed(self) -> Column:
        """Whether a row of the log, or an atom by its first row, is committed."""
        last = self.log().filter("op = 'COMMIT'").agg(F.coalesce(F.max("seq"), F.lit(-1))).first()[0]
        return F.col("seq") <= last

    def _leaf_counts(self, view: DataFrame) -> DataFrame:
        return view.filter(self._committed()).groupBy("shard").agg(F.count("*").alias("leaves"))

    def get(self, atom: str) -> dict | None:
        """One atom's record, without the places of others; the rows of that atom are all that is kept of the scan."""
        row = self.log().filter((F.col("atom") == atom) & F.col("op").isin("ADD", "TOMBSTONE")).agg(
            F.min(F.when(F.col("op") == "ADD", F.col("ts_ms"))).alias("created_ms"), F.max(F.when(F.col("op") == "ADD", F.col("version"))).alias("committed_version"),
            F.coalesce(F.max(F.col("op") == "TOMBSTONE"), F.lit(False)).alias("gone"), F.coalesce(F.min(F.when(F.col("op") == "ADD", self._committed())), F.lit(False)).alias("committed"),
        ).first()
        if row.created_ms is None:
            return None
        return {"atom": atom, "status": "tombstoned" if row.gone else "active", "created_ms": row.created_ms, "committed_version": row.committed_version, "committed": row.committed}

    # -- writes ----------------------------------------------------------------------------------
    def commit(self, now_ms: int) -> int:
        """Makes leaves of all pending atoms."""
        return self._write([("COMMIT", None, now_ms, None, None, None)])

    def pending(self) -> DataFrame:
        """Active atoms that no commit has reached yet."""
        return self.atoms().filter((F.col("status") == "active") & ~self._committed())

    def add(self, atoms: list[str], now_ms: int, review_approved: bool = False, block_secrets: bool = True) -> dict:
        """Checks atoms, and appends those that the write policy lets in; what stands in the way is in the answer."""
        rows = self.spark.createDataFrame([(a,) for a in dict.fromkeys(atoms)], "atom string")
        a = F.col("atom")
        tier = R.write_tier(A.atom_type(a), self.write_policy, self.default_tier)
        seen = rows.select("atom", A.atom_type(a).isNotNull().alias("valid"), A.has_secret(a).alias("secret"), A.has_injection(a).alias("injection"), R.write_decision(tier, review_approved).alias("decision")).collect()  # as many rows as were passed in
        invalid = [r.atom for r in seen if not r.valid]
        if invalid:
            return {"status": "invalid", "atoms": invalid}
        secret = [r.atom for r in seen if r.secret]
        if secret and block_secrets:
            return {"status": "secret", "atoms": secret}
        injected = [r.atom for r in seen if r.injection]
        if injected and not review_approved:
            return {"status": "review-required", "atoms": injected}
        for decision in ("deny", "review-required"):
            if held := [r.atom for r in seen if r.decision == decision]:
                return {"status": decision, "atoms": held}
        return {"status": "added", "version": self._write([("ADD", r.atom, now_ms, None, None, None) for r in seen], now_ms)}

    def remove(self, atom: str, now_ms: int) -> int:
        if not self.log().filter((F.col("op") == "ADD") & (F.col("atom") == atom)).limit(1).count():
            raise KeyError(atom)
        return self._write([("TOMBSTONE", atom, now_ms, None, None, None)], now_ms)

    def train(self, sequence: list[str], now_ms: int) -> int:
        """Learns a sequence; atoms that are unknown or not committed are left out of it."""
        known = {r[0] for r in self.log().filter((F.col("op") == "ADD") & F.col("atom").isin(*sequence) & self._committed()).select("atom").distinct().collect()}
        rows = [("TRAIN", a, now_ms, k, None) for k, a in enumerate(sequence) if a in known]
        own = uuid.uuid4().int >> 65  # the sequence's name, in 63 bits
        return self._write([(op, a, ts, own, k, to) for op, a, ts, k, to in rows])

    def touch(self, atoms: list[str], now_ms: int) -> int:
        """Records accesses; read-only callers leave this out."""
        return self._write([("ACCESS", a, now_ms, None, None, None) for a in atoms])

    def checkpoint_session(self, add: list[str], remove: list[str], sequence: list[str], now_ms: int) -> dict:
        """Adds, removes, commits, trains and commits, in that order: only committed atoms can be trained.

        Each part's own answer is in the result; what add refuses is not known, so it is not trained.
        """
        out: dict = {}
        if add:
            out["stored"] = self.add(add, now_ms)
        if remove:
            out["removed"] = [self.remove(a, now_ms) for a in remove]
        if out:
            out["committed"] = self.commit(now_ms)
        if len(sequence) >= 2:
            out["trained"] = self.train(sequence, now_ms)
        out["version"] = self.commit(now_ms)
        return out

    # -- the graph -------------------------------------------------------------------------------
    def edges(self) -> DataFrame:
        """Learnt transitions, and what imports have added to them."""
        rows = self.log()
        learnt = E.transitions(rows.filter("op = 'TRAIN'"), "seq_id", "pos").withColumn("w", F.lit(1).cast("long"))
        brought = rows.filter("op = 'WEIGHT'").select(F.col("atom").alias("from_atom"), "to_atom", "ts_ms", "seq", F.col("weight").alias("w"))
        return E.edge_weights(learnt.select(*brought.columns).unionByName(brought), F.col("w"))

    def accesses(self) -> DataFrame:
        """(atom, accesses, last_ms); rows that imports have added hold their number."""
        rows = self.log().filter("op = 'ACCESS'")
        return rows.groupBy("atom").agg(F.sum(F.coalesce("weight", F.lit(1))).alias("accesses"), F.max("ts_ms").alias("last_ms"))

    def weights(self, atom: str, now_ms: int, half_life_ms: float | None = None) -> DataFrame:
        e = self.edges().filter(F.col("from_atom") == atom)
        return E.effective_weights(e, now_ms, half_life_ms=half_life_ms).orderBy(F.desc("effective"), F.desc("weight"), "first_seq")

    def _best(self, view: DataFrame) -> DataFrame:
        live = view.filter("status = 'active'").select(F.col("atom").alias("to_atom"))
        edges = self.edges().join(live, "to_atom", "left_semi")
        if self.policy:
            return E.policy_top(edges, self.policy).select("from_atom", F.col("best_allowed").alias("to_atom"))
        return E.top_edge(edges).select("from_atom", "to_atom")

    def access(self, atoms: list[str]) -> DataFrame:
        """(pos, atom, shard, idx, hash, error, predicted, path, root): each request with its proof and prediction, or why there is none."""
        requests = self.spark.createDataFrame(list(enumerate(atoms)), "pos long, atom string")
        view = self.atoms()
        out = L.batch_access(requests, view, self._leaf_counts(view), self._best(view))
        return self._with_proof(out, view).orderBy("pos")

    def _with_proof(self, rows: DataFrame, view: DataFrame) -> DataFrame:
        """rows (shard, idx) with the path and root of those that are committed leaves."""
        leaves = self._leaves(view.filter(self._committed()))
        asked = rows.filter("idx is not null").select("shard", "idx")
        paths = M.audit_paths(leaves, "shard", wanted=asked).select("shard", "idx", "path")
        return rows.join(paths, ["shard", "idx"], "left").join(M.roots(leaves, "shard").select("shard", "root"), "shard", "left").withColumn("root", F.when(F.col("path").isNotNull(), F.col("root")))

    def inspect(self, atom: str) -> dict | None:
        """One atom's record with its place, the version it was committed at, and where it leads to."""
        view = self.atoms()
        row = view.filter(F.col("atom") == atom).withColumn("committed", self._committed()).first()
        if row is None:
            return None
        known = view.select(F.col("atom").alias("to_atom"))
        out = self.edges().filter(F.col("from_atom") == atom).join(known, "to_atom", "left_semi").orderBy(F.desc("weight"), "first_seq")
        return {**{k: row[k] for k in ("atom", "shard", "idx", "status", "hash", "committed", "created_ms", "committed_version")}, "tree_version": self.head(), "transitions": [(r.to_atom, r.weight, r.updated_ms) for r in out.collect()]}

    def warm_read(self, atoms: list[str]) -> DataFrame:
        """(atom, shard, predicted) of the atoms that are pending: unverified, and predicted by the policy alone.

        With a policy, the best atom of the first type, in the order of types, that the atom's own may go to and
        that has one in its shard; without a policy there is no prediction.
        """
        asked = self.pending().filter(F.col("atom").isin(*atoms)).select("atom", "shard", "atom_type")
        return L.type_fallback(asked, self.atoms(), self.edges(), self.policy)

    def predict(self, histories: DataFrame) -> DataFrame:
        """Path predictions of (key, history), from all training sequences."""
        rows = self.log().filter("op = 'TRAIN'")
        return P.predict(histories, P.path_counts(rows, "seq_id", "pos"))

    # -- retrieval -------------------------------------------------------------------------------
    def _scored(self, live: DataFrame, text: str) -> DataFrame:
        """live atoms with score: the hybrid of words and embeddings; without a provider, of words; without a corpus, of shared words."""
        rows = live.withColumn("semantic", A.semantic_text(F.col("atom")))
        if not self.log().filter("op = 'ADD'").limit(1).count():
            return rows.withColumn("score", A.jaccard(F.array_distinct(A.tokens(F.lit(text))), F.array_distinct(A.tokens(F.col("semantic")))))
        query = self.spark.createDataFrame([(0, text)], "q int, q_text string")
        scored = rows.join(T.bm25(rows, query, "atom", "semantic").select("atom", F.col("score").alias("lexical")), "atom", "left").withColumn("lexical", F.coalesce("lexical", F.lit(0.0)))
        if self.embedding is None:
            return scored.withColumnRenamed("lexical", "score")
        return scored.join(T.provided_cosine(rows, "atom", "semantic", text, self.embedding), "atom").withColumn("score", T.hybrid(F.col("lexical"), T.index_score(F.col("cosine")))).drop("lexical", "cosine")

    def search(self, text: str, limit: int | None = None, threshold: float = 0.0, scope: dict[str, str] | None = None, include_global: bool = True, version: int | None = None, ms: int | None = None) -> DataFrame:
        """(atom, score, created_ms, category) of the atoms that fit a text, a scope and a version best."""
        limit = whole_number(limit, 1, 100, 10)
        if not 0 <= threshold <= 1:
            raise ValueError("a threshold from 0 to 1 is needed")
        scored = self._scored(self.atoms().filter("status = 'active'"), text).withColumn("score", F.round("score", 6))
        found = L.as_of(scored, version, ms, L.commits(self.log()))
        if scope:
            found = found.filter(A.in_scope(F.col("atom"), scope, include_global))
        top = found.filter(F.col("score") >= threshold).orderBy(F.desc("score"), F.desc("created_ms"), "atom").limit(limit)
        return top.select("atom", "score", "created_ms", A.memory_category(F.col("atom")).alias("category"))

    def conflicts(self) -> DataFrame:
        claims = self.atoms().filter("status = 'active'").withColumn("f", A.fact_claim(F.col("atom"))).filter("f is not null")
        return T.conflicts(claims.select("atom", "f.key", "f.claim", "created_ms"))

    def context(self, text: str | None = None, max_tokens: int | None = None, by_objective: bool = False, **how) -> DataFrame:
        """The best atoms' summaries, as many as the token budget holds.

        Ordered by a text; or by the value of the first atom, by shard and place, that names an objective; or by time.
        """
        budget = whole_number(max_tokens, 1, 8000, 512)
        if text is not None:
            found = self.search(text, 100, **how)
        else:
            live = self.atoms().filter("status = 'active'")
            first = live.filter(F.contains("atom", F.lit("objective_"))).orderBy("shard", "idx").select(A.atom_value(F.col("atom"))).first() if by_objective else None
            found = self._scored(live, first[0]) if first else live.withColumn("score", F.lit(0.0))
        lines = found.withColumn("line", A.compact_summary(F.col("atom"))).withColumn("tokens", A.estimate_tokens(F.col("line"))).withColumn("q", F.lit(0))
        return T.pack_context(lines, budget, "q", F.desc("score"), F.desc("created_ms"), "atom").select("atom", "score", "created_ms", "line", "tokens", "used")

    def bootstrap(self, objective: str, limit: int | None = None, high_impact: bool = False, threshold: float = 0.65, **how) -> DataFrame:
        """The memories to start with: categories, conflicts, whether their proof holds, evidence, reasons and, if asked for, the gate."""
        view = self.atoms()
        top = self.search(objective, whole_number(limit, 1, 100, 12), **how)
        groups = self.conflicts().select(F.explode("atoms").alias("atom"), F.col("key").alias("conflict_key"))
        placed = self._with_proof(top.join(view.select("atom", "shard", "idx", "hash"), "atom"), view)
        proven = F.coalesce(M.root_of_path(F.col("hash"), F.col("idx"), F.col("path")) == F.col("root"), F.lit(False))
        out = placed.withColumn("proven", proven).join(groups, "atom", "left").drop("path")
        out = out.withColumn("evidence", T.evidence_score(F.col("score"), F.col("proven"), F.col("category"), F.col("conflict_key").isNotNull())).withColumn("q", F.lit(0))
        out = T.with_reasons(out, objective, threshold if high_impact else None)
        return (T.evidence_gate(out, threshold) if high_impact else out).drop("q")

    # -- proofs ----------------------------------------------------------------------------------
    @staticmethod
    def _leaves(view: DataFrame) -> DataFrame:
        return view.select("shard", "idx", F.when(F.col("status") == "tombstoned", F.lit("0" * 64)).otherwise(F.col("hash")).alias("hash"))

    def shard_roots(self) -> DataFrame:
        return M.roots(self._leaves(self.atoms().filter(self._committed())), "shard")

    def tree_head(self) -> dict:
        version = self.log().agg(F.coalesce(F.max("version"), F.lit(0)), F.max("ts_ms")).first()
        view = self.atoms()
        roots = M.roots(self._leaves(view.filter(self._committed())), "shard").select(F.lit(0).alias("version"), "shard", "root")
        by_shard = self.spark.range(self.shards).select(F.col("id").alias("shard"))
        full = by_shard.join(roots, "shard", "left").select(F.lit(0).alias("version"), "shard", F.coalesce("root", F.lit("0" * 64)).alias("root"))
        return {"version": version[0], "root": M.master_root(full).first()["root"], "ts_ms": version[1]}

    @staticmethod
    def verify(rows: DataFrame) -> DataFrame:
        """rows (hash, idx, path, root) with valid."""
        return rows.withColumn("valid", M.root_of_path(F.col("hash"), F.col("idx"), F.col("path")) == F.col("root"))

    # -- upkeep and exchange -----------------------------------------------------------------------
    def stale(self, now_ms: int, days: int) -> DataFrame:
        return L.stale(self.atoms(), now_ms, days)

    def page(self, **how) -> DataFrame:
        return L.page(self.atoms(), **how)

    def health(self) -> DataFrame:
        view = self.atoms()
        return L.health(view, self._leaf_counts(view))

    def ready(self) -> bool:
        """Whether every version from the first to the head is there."""
        at, fs = place(self.spark, self.path)
        return self.head() == (sum(s.getPath().getName().startswith("version=") for s in fs.listStatus(at)) if fs.exists(at) else 0)

    def tiers(self, now_ms: int) -> DataFrame:
        used = self.accesses()
        passes = self.edges().groupBy(F.col("from_atom").alias("atom")).agg(F.sum("weight").alias("passes"))
        features = self.atoms().filter("status = 'active'").select("atom").join(used, "atom", "left").join(passes, "atom", "left").fillna({"accesses": 0, "passes": 0})
        return Z.classify(features, now_ms)

    def consolidate(self, now_ms: int, n: int = 10) -> DataFrame:
        return Z.replay(self.edges(), Z.replay_candidates(self.tiers(now_ms), n), now_ms)

    def save_tiers(self, now_ms: int) -> dict:
        """Classifies all active atoms and keeps the result; how many are in each tier, and moved since the last run."""
        now, folder = written(self.tiers(now_ms)), f"{self.path}/_tiers"
        before = self.saved_tiers()
        moved = {r.move: r.n for r in Z.moves(before, now).groupBy("move").agg(F.count("*").alias("n")).collect()} if before else {}
        aside = f"{folder}/_new-{uuid.uuid4().hex}"
        now.write.parquet(aside)
        if not rename_new(self.spark, aside, f"{folder}/run={now_ms}"):
            raise RuntimeError(f"there is a run of {now_ms} already")
        return {**Z.summary(now).first().asDict(), "promotions": moved.get("promotion", 0), "demotions": moved.get("demotion", 0)}

    def saved_tiers(self) -> DataFrame | None:
        """The tiers of the last run."""
        at, fs = place(self.spark, f"{self.path}/_tiers")
        runs = [s.getPath().getName() for s in fs.listStatus(at) if s.getPath().getName().startswith("run=")] if fs.exists(at) else []
        return self.spark.read.parquet(f"{self.path}/_tiers/{max(runs, key=lambda r: int(r[4:]))}") if runs else None

    def diagnostics(self, now_ms: int) -> dict:
        """Sizes of the graph and of the paths, atoms by tier, and what was observed since the start."""
        paths = P.path_counts(self.log().filter("op = 'TRAIN'"), "seq_id", "pos").agg(F.count("*").alias("n"), F.coalesce(F.max("depth"), F.lit(0)).alias("deepest")).first()
        graph = self.edges().agg(F.countDistinct("from_atom").alias("trained"), F.count("*").alias("edges")).first()
        return {"path_nodes": paths.n + 1, "deepest": paths.deepest, **graph.asDict(), "tiers": Z.summary(self.tiers(now_ms)).first().asDict(), "mutations": self.log().count()}

    def metrics(self) -> DataFrame:
        """Lines of the text format of metrics, from the log."""
        return X.engine_metrics(self.log(), self.edges(), self.atoms(), self.health())

    def version_chain(self, versions: list[int]) -> DataFrame:
        """(version, root, recomputed, ts_ms) of the asked versions that have a commit: the master root as it left it.

        A commit's leaves are the atoms up to it, with those removed by then as zeros; every root is computed twice, from
        the leaves as they are now known and from the rows of that version alone.
        """
        log = written(self.log())
        at = log.filter((F.col("op") == "COMMIT") & F.col("version").isin(*versions)).groupBy("version").agg(F.max("seq").alias("upto"), F.max("ts_ms").alias("ts_ms"))
        view = self.atoms().select("atom", "shard", "idx", "hash", "seq")
        gone = log.filter("op = 'TOMBSTONE'").groupBy("atom").agg(F.min("seq").alias("gone"))
        rows = view.join(gone, "atom", "left").join(F.broadcast(at), F.col("seq") <= F.col("upto"))  # a row an asked version
        leaf = F.when(F.col("gone") <= F.col("upto"), F.lit("0" * 64)).otherwise(F.col("hash"))
        leaves = written(rows.select(F.concat_ws(":", "version", "shard").alias("tree"), "version", "shard", "idx", leaf.alias("hash")))
        named = leaves.select("tree", "version", "shard").distinct()

        def master(roots: DataFrame) -> DataFrame:
            full = named.select("version").distinct().crossJoin(self.spark.range(self.shards).select(F.col("id").alias("shard")))
            own = named.join(roots, "tree").select("version", "shard", "root")
            return M.master_root(full.join(own, ["version", "shard"], "left").select("version", "shard", F.coalesce("root", F.lit("0" * 64)).alias("root")))

        nodes = M.nodes(leaves, "tree")
        tops = nodes.groupBy("tree").agg(F.max_by("hash", "level").alias("root"))
        again = master(tops).withColumnRenamed("root", "recomputed")
        return master(M.roots(leaves, "tree").select("tree", "root")).join(again, "version").join(at.select("version", "ts_ms"), "version").select("version", "root", "recomputed", "ts_ms")

    def evaluate(self, now_ms: int) -> dict:
        """How often the likeliest next atom is the one that follows in the log's own sequences; kept as the latest evaluation."""
        rows = self.log().filter("op = 'TRAIN'")
        best = E.top_edge(self.edges()).select("from_atom", F.col("to_atom").alias("best"))
        hit = E.transitions(rows, "seq_id", "pos").join(best, "from_atom").agg(F.count("*").alias("pairs"), F.avg((F.col("best") == F.col("to_atom")).cast("double")).alias("rate")).first()
        out = {"now_ms": now_ms, "pairs": hit.pairs, "hit_rate": round(hit.rate, 6) if hit.pairs else None, "version": self.head()}
        self._set("evaluation", out)
        return out

    def evaluation(self) -> dict | None:
        return self._setting("evaluation")

    def _set(self, name: str, value) -> int:
        return self._write([("SETTING", name, 0, None, None, json.dumps(value))])

    def _setting(self, name: str):
        """The latest value of a setting; None if it was never set."""
        row = self.log().filter((F.col("op") == "SETTING") & (F.col("atom") == name)).agg(F.max_by("to_atom", "seq")).first()[0]
        return None if row is None else json.loads(row)

    def set_policy(self, policy: dict[str, list[str]]) -> None:
        """The targets that each listed type may go to."""
        if any(k not in A.TYPES or any(v not in A.TYPES for v in vs) for k, vs in policy.items()):
            raise ValueError("a policy names atom types only")
        self.policy = {k: list(vs) for k, vs in policy.items()}
        self._set("policy", self.policy)

    def set_write_policy(self, by_type: dict[str, str], default: str = "auto-write") -> None:
        if {default, *by_type.values()} - {"auto-write", "review-required", "never-store"} or set(by_type) - set(A.TYPES):
            raise ValueError("a write policy gives atom types one of three tiers")
        self.write_policy, self.default_tier = dict(by_type), default
        self._set("write_policy", [self.write_policy, self.default_tier])

    def audit(self, since: int = 0, event: str | None = None, limit: int = 100) -> DataFrame:
        rows = self.log().filter(F.col("ts_ms") >= since)
        return (rows.filter(F.col("op") == event) if event else rows).orderBy(F.desc("seq")).limit(limit)

    def export(self, status: str = "all", kind: str | None = None) -> DataFrame:
        return N.export_lines(self.atoms(), ["atom", "status", "hash", "created_ms", "committed_version", "shard"], status, kind)

    def export_full(self, now_ms: int = 0) -> DataFrame:
        """Lines of all that the log has: a header, atoms, weights and access counts."""
        head = self.tree_head()
        meta = {"type": "meta", "version": 1, "exported_at_ms": now_ms, "shards": self.shards, "tree_version": head["version"], "tree_root": head["root"]}
        weights = self.edges().select(F.col("from_atom").alias("from"), F.col("to_atom").alias("to"), "weight", "updated_ms")
        counts = self.accesses().select("atom", F.col("accesses").alias("count"), "last_ms")
        lines = N.export_full(self.atoms().select("atom", "status"), weights, counts)
        return self.spark.createDataFrame([(json.dumps(meta),)], "line string").unionByName(lines)

    def import_full(self, lines: DataFrame, now_ms: int) -> dict:
        """Brings in lines of :meth:`export_full`, atoms first; weights, counts and times merge with what is there by their maximum.

        What an import adds to a weight or a count is a row of the log, so importing the same lines again adds nothing.
        """
        held = written(lines)
        read, meta, bad = N.import_full(held), N.meta_line(held), N.bad_full_lines(held).count()
        known = written(self.atoms().select("atom", "status"))
        valid = read["atoms"].filter(A.atom_type(F.col("atom")).isNotNull())
        fresh = written(valid.join(known.select("atom"), "atom", "left_anti"))
        none = F.lit(None)
        shape = {"seq_id": none.cast("long"), "pos": none.cast("int"), "to_atom": none.cast("string"), "weight": none.cast("long")}

        def rows(df: DataFrame, op: str, ts: Column, **more) -> DataFrame:
            return df.select(F.lit(op).alias("op"), "atom", ts.cast("long").alias("ts_ms"), *[more.get(k, v).alias(k) for k, v in shape.items()])

        every = known.select("atom").unionByName(fresh.select("atom"))
        atoms = rows(fresh, "ADD", F.lit(now_ms)).unionByName(rows(fresh.filter("status = 'tombstoned'"), "TOMBSTONE", F.lit(now_ms)))
        ends = every.withColumnRenamed("atom", "from"), every.withColumnRenamed("atom", "to")
        now = self.edges().select(F.col("from_atom").alias("from"), F.col("to_atom").alias("to"), F.col("weight").alias("w"), F.col("updated_ms").alias("u"))
        brought = read["weights"].join(ends[0], "from", "left_semi").join(ends[1], "to", "left_semi").join(now, ["from", "to"], "left")
        more = brought.withColumn("gain", F.greatest(F.col("weight") - F.coalesce("w", F.lit(0)), F.lit(0))).filter((F.col("gain") > 0) | (F.col("updated_ms") > F.col("u"))).withColumnRenamed("from", "atom")
        counts = read["counts"].join(every, "atom", "left_semi").join(self.accesses().select("atom", "accesses", F.col("last_ms").alias("u")), "atom", "left")
        seen = counts.withColumn("gain", F.greatest(F.col("count") - F.coalesce("accesses", F.lit(0)), F.lit(0))).filter((F.col("gain") > 0) | (F.col("last_ms") > F.col("u")))
        out = written(atoms.unionByName(rows(more, "WEIGHT", F.col("updated_ms"), to_atom=F.col("to"), weight=F.col("gain"))).unionByName(rows(seen, "ACCESS", F.col("last_ms"), weight=F.col("gain"))))
        of = {r.op: r.n for r in out.groupBy("op").agg(F.count("*").alias("n")).collect()}
        if of:
            order = F.when(F.col("op") == "ADD", 0).when(F.col("op") == "TOMBSTONE", 1).otherwise(2)
            self._append(global_index(out.withColumn("o", order), "o", "atom", "to_atom"))
            if self.auto_commit:
                self.commit(now_ms)
        return {"atoms": of.get("ADD", 0), "skipped": valid.count() - of.get("ADD", 0), "weights": of.get("WEIGHT", 0), "counts": of.get("ACCESS", 0), "errors": bad, "meta": meta, "version": self.head()}

    def backup(self, folder: str, now_ms: int = 0) -> None:
        """Writes all lines of :meth:`export_full` as text; a folder that is there already is an error."""
        self.export_full(now_ms).write.text(folder)

    def restore(self, folder: str, now_ms: int) -> dict:
        return self.import_full(self.spark.read.text(folder).withColumnRenamed("value", "line"), now_ms)

    def import_lines(self, lines: DataFrame, now_ms: int) -> tuple[int, DataFrame]:
        """Adds the new atoms of lines in one distributed append; returns the version and the lines that are none."""
        good, bad = N.import_lines(lines, self.atoms().filter("status = 'active'"))
        none = F.lit(None)
        rows = good.select(F.lit(now_ms).cast("long").alias("ts_ms"), F.lit("ADD").alias("op"), "atom", none.cast("long").alias("seq_id"), none.cast("int").alias("pos"), none.cast("string").alias("to_atom"), none.cast("long").alias("weight"))
        version = self._append(global_index(rows, "atom"))
        return self.commit(now_ms) if self.auto_commit else version, bad
