"""The facade's calls as named tools with checked arguments, for agents: plain functions, in three tiers.

``read`` tools change nothing, ``write`` tools append to the log, ``run`` tools start a measurement and keep it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators import merkle as M
from .engine import Engine, whole_number

TIERS = ("read", "write", "run")
#: Rows that a tool answers with at most; page() and export() have the rest.
MOST = 1000


@dataclass(frozen=True)
class Tool:
    tier: str
    needs: dict[str, type]
    may: dict[str, type]
    run: Callable[[Engine, dict], object]


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.limit(MOST).collect()]


def _verify(e: Engine, a: dict) -> dict:
    row = e.spark.createDataFrame([(a["hash"], a["index"], a["path"], a["root"])], "hash string, idx long, path array<string>, root string")
    return {"valid": e.verify(row).first().valid}


def _consistent(e: Engine, a: dict) -> dict:
    pairs = e.spark.createDataFrame([(a["from_version"], a["to_version"])], "from_version long, to_version long")
    return M.consistency(pairs, e.version_chain([a["from_version"], a["to_version"]])).first().asDict()


#: The tools' names.
TOOLS: dict[str, Tool] = {
    "memory_access": Tool("read", {"atom": str}, {"warm": bool}, lambda e, a: _rows(e.warm_read([a["atom"]])) if a.get("warm") else _rows(e.access([a["atom"]]))),
    "memory_batch_access": Tool("read", {"atoms": list}, {}, lambda e, a: _rows(e.access(a["atoms"]))),
    "memory_atoms_list": Tool("read", {}, {"kind": str, "prefix": str, "offset": int, "limit": int}, lambda e, a: _rows(e.page(**a))),
    "memory_atom_get": Tool("read", {"atom": str}, {}, lambda e, a: e.inspect(a["atom"])),
    "memory_weights_get": Tool("read", {"atom": str, "now_ms": int}, {"half_life_ms": float}, lambda e, a: _rows(e.weights(**a))),
    "memory_policy_get": Tool("read", {}, {}, lambda e, a: e.policy),
    "memory_write_policy_get": Tool("read", {}, {}, lambda e, a: {"by_type": e.write_policy, "default": e.default_tier}),
    "memory_pending": Tool("read", {}, {}, lambda e, a: _rows(e.pending())),
    "memory_atoms_stale": Tool("read", {"now_ms": int, "days": int}, {}, lambda e, a: _rows(e.stale(**a))),
    "memory_health": Tool("read", {}, {}, lambda e, a: _rows(e.health())),
    "memory_ready": Tool("read", {}, {}, lambda e, a: {"ready": e.ready()}),
    "memory_metrics": Tool("read", {}, {}, lambda e, a: [r.line for r in e.metrics().limit(MOST).collect()]),
    "memory_audit_log": Tool("read", {}, {"since": int, "event": str, "limit": int}, lambda e, a: _rows(e.audit(**a))),
    "memory_verify": Tool("read", {"hash": str, "index": int, "path": list, "root": str}, {}, _verify),
    "memory_weekly_eval_status": Tool("read", {}, {}, lambda e, a: e.evaluation()),
    "memory_search": Tool("read", {"text": str}, {"limit": int, "threshold": float, "scope": dict, "version": int, "ms": int}, lambda e, a: _rows(e.search(**a))),
    "memory_context": Tool("read", {}, {"text": str, "max_tokens": int, "by_objective": bool}, lambda e, a: _rows(e.context(**a))),
    "memory_session_bootstrap": Tool("read", {"objective": str}, {"limit": int, "high_impact": bool, "threshold": float}, lambda e, a: _rows(e.bootstrap(**a))),
    "memory_tree_head": Tool("read", {}, {}, lambda e, a: e.tree_head()),
    "memory_verify_consistency": Tool("read", {"from_version": int, "to_version": int}, {}, _consistent),
    "memory_atoms_export": Tool("read", {}, {"status": str, "kind": str}, lambda e, a: [r.line for r in e.export(**a).limit(MOST).collect()]),
    "memory_train": Tool("write", {"sequence": list, "now_ms": int}, {}, lambda e, a: {"version": e.train(**a)}),
    "session_checkpoint": Tool("write", {"now_ms": int}, {"add": list, "remove": list, "sequence": list}, lambda e, a: e.checkpoint_session(a.get("add", []), a.get("remove", []), a.get("sequence", []), a["now_ms"])),
    "memory_atoms_add": Tool("write", {"atoms": list, "now_ms": int}, {"review_approved": bool}, lambda e, a: e.add(**a)),
    "memory_atoms_delete": Tool("write", {"atom": str, "now_ms": int}, {}, lambda e, a: {"version": e.remove(**a)}),
    "memory_policy_set": Tool("write", {"policy": dict}, {}, lambda e, a: e.set_policy(a["policy"])),
    "memory_write_policy_set": Tool("write", {"by_type": dict}, {"default": str}, lambda e, a: e.set_write_policy(**a)),
    "memory_commit": Tool("write", {"now_ms": int}, {}, lambda e, a: {"version": e.commit(**a)}),
    "memory_atoms_import": Tool("write", {"lines": list, "now_ms": int}, {}, lambda e, a: {"version": e.import_lines(e.spark.createDataFrame([(x,) for x in a["lines"]], "line string"), a["now_ms"])[0]}),
    "memory_weekly_eval_run": Tool("run", {"now_ms": int}, {}, lambda e, a: e.evaluate(a["now_ms"])),
}
RESOURCES: dict[str, Callable[[Engine], object]] = {
    "health": lambda e: call(e, "memory_health"),
    "readiness": lambda e: call(e, "memory_ready"),
    "policy": lambda e: call(e, "memory_policy_get"),
    "metrics": lambda e: call(e, "memory_metrics"),
    "tools": lambda e: catalog(),
}


def catalog(allowed: tuple[str, ...] = TIERS) -> list[dict]:
    return [{"name": n, "tier": t.tier, "needs": {k: v.__name__ for k, v in t.needs.items()}, "may": {k: v.__name__ for k, v in t.may.items()}} for n, t in TOOLS.items() if t.tier in allowed]


def call(engine: Engine, name: str, arguments: dict | None = None, allowed: tuple[str, ...] = ("read",)) -> object:
    """The answer of a tool; KeyError for unknown ones, PermissionError outside the allowed tiers, ValueError for wrong arguments."""
    tool, arguments = TOOLS[name], arguments or {}
    if tool.tier not in allowed:
        raise PermissionError(f"{name} is a {tool.tier} tool")
    if missing := set(tool.needs) - set(arguments):
        raise ValueError(f"{name} needs {', '.join(sorted(missing))}")
    for k, v in arguments.items():
        kind = {**tool.needs, **tool.may}.get(k)
        if kind is None:
            raise ValueError(f"{name} has no argument {k}")
        good = isinstance(v, (int, float) if kind is float else kind) and (kind is bool or not isinstance(v, bool))
        if not good:
            raise ValueError(f"{name}: {k} must be a {kind.__name__}")
    for k in ("limit", "days"):
        if k in arguments:
            whole_number(arguments[k], 1, MOST if k == "limit" else 36_500, 1)
    return tool.run(engine, arguments)


__all__ = ["RESOURCES", "TIERS", "TOOLS", "Tool", "call", "catalog"]
