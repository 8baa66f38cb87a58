"""Exchange of atoms and graphs as lines of JSON, and scans by key range."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.atoms import atom_type

_FULL = "type string, atom string, status string, `from` string, `to` string, weight bigint, updated_ms bigint, count bigint, last_ms bigint"


def range_scan(df: DataFrame, key: str, low: str, high: str) -> DataFrame:
    """Rows with low <= key <= high, in the order of bytes."""
    return df.filter(F.col(key).between(low, high)).orderBy(key)


def export_lines(atoms: DataFrame, columns: list[str], status: str = "all", kind: str | None = None) -> DataFrame:
    """A line of JSON a row."""
    out = atoms
    if status != "all":
        out = out.filter(F.col("status") == status)
    if kind:
        out = out.filter(atom_type(F.col("atom")) == kind)
    return out.select(F.to_json(F.struct(*columns)).alias("line"))


def import_lines(lines: DataFrame, active: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(atoms to add, lines that are none): lines are JSON objects with an atom, or bare atoms."""
    text = F.trim(F.col("line"))
    parsed = F.from_json(text, "atom string")
    atom = F.when(text.startswith("{"), parsed["atom"]).otherwise(text)
    read = lines.filter(text != "").select("line", atom.alias("atom"))
    good = atom_type(F.col("atom")).isNotNull()
    fresh = read.filter(good).select("atom").distinct().join(active.select("atom"), "atom", "left_anti")
    return fresh, read.filter(F.coalesce(~good, F.lit(True))).select("line")


def export_full(atoms: DataFrame | None = None, weights: DataFrame | None = None, counts: DataFrame | None = None) -> DataFrame:
    """Tagged lines of atoms (atom, status), weights (from, to, weight, updated_ms) and access counts (atom, count, last_ms)."""
    parts = []
    for name, df, cols in (("atom", atoms, ("atom", "status")), ("weight", weights, ("from", "to", "weight", "updated_ms")), ("access_count", counts, ("atom", "count", "last_ms"))):
        if df is not None:
            parts.append(df.select(F.to_json(F.struct(F.lit(name).alias("type"), *cols)).alias("line")))
    return reduce(DataFrame.unionByName, parts)


def import_full(lines: DataFrame) -> dict[str, DataFrame]:
    """The tables of :func:`export_full`; weights, times and counts of repeated keys merge by their maximum."""
    read = lines.select(F.from_json("line", _FULL).alias("r")).select("r.*").filter("type is not null")
    return {
        "atoms": read.filter("type = 'atom'").groupBy("atom").agg(F.min("status").alias("status")),
        "weights": read.filter("type = 'weight'").groupBy("from", "to").agg(F.max("weight").alias("weight"), F.max("updated_ms").alias("updated_ms")),
        "counts": read.filter("type = 'access_count'").groupBy("atom").agg(F.max("count").alias("count"), F.max("last_ms").alias("last_ms")),
    }


def meta_line(lines: DataFrame) -> dict | None:
    """The header of :func:`export_full`'s lines, if they have one."""
    row = lines.filter(F.get_json_object("line", "$.type") == "meta").first()
    return json.loads(row["line"]) if row else None


def bad_full_lines(lines: DataFrame) -> DataFrame:
    """Lines that are neither a header nor a record with an atom."""
    kind = F.get_json_object("line", "$.type")
    named = F.when(kind == "weight", F.get_json_object("line", "$.from")).otherwise(F.get_json_object("line", "$.atom"))
    good = (kind == "meta") | (kind.isin("atom", "weight", "access_count") & named.isNotNull())
    return lines.filter((F.trim("line") != "") & ~F.coalesce(good, F.lit(False)))


def seeds(df: DataFrame) -> DataFrame:
    """Atoms of a seed table (atom), all of them or none: one that is invalid empties it."""
    bad = F.broadcast(df.agg(F.coalesce(F.bool_or(atom_type(F.col("atom")).isNull()), F.lit(True)).alias("__bad")))  # one row
    return df.crossJoin(bad).filter("not __bad").drop("__bad")
