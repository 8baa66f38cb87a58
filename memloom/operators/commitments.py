"""A wide commitment tree: each node commits to its children, so a proof is one opening a level."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import curve as C

WIDTH = 16


def commit_level(children: DataFrame, width: int = WIDTH) -> DataFrame:
    """(pos, commitment) of the nodes over children (pos, hash): one group a node, of at most width rows."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        values = [0] * width
        for pos, h in zip(rows["pos"], rows["hash"]):
            values[int(pos) % width] = C.scalar_of(h)
        return pd.DataFrame({"pos": [key[0]], "commitment": [C.compress(C.commit(values, C.generators(width)))]})

    grouped = children.withColumn("parent", F.floor(F.col("pos") / width).cast("long"))
    # groups are small and slow, so they are dealt out by number, not by size
    tasks = int(children.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return grouped.repartition(tasks, "parent").groupBy("parent").applyInPandas(run, "pos bigint, commitment string")


def node_hash(commitment):
    return F.sha2(F.unhex(commitment), 256)


def tree(leaves: DataFrame, width: int = WIDTH) -> list[DataFrame]:
    """Levels (pos, hash, commitment) from the leaves (idx, hash) up to the root."""
    level = leaves.select(F.col("idx").cast("long").alias("pos"), "hash", F.lit(None).cast("string").alias("commitment"))
    out, n = [level], (leaves.agg(F.max("idx") + 1).first()[0] or 0)
    while True:
        up = commit_level(level, width).select("pos", node_hash(F.col("commitment")).alias("hash"), "commitment")
        out.append(up)
        level, n = up, -(-n // width)
        if n <= 1:
            return out


def root(leaves: DataFrame, width: int = WIDTH) -> str:
    row = tree(leaves, width)[-1].first()
    return row["commitment"] if row else C.compress(None)


def proofs(levels: list[DataFrame], wanted: DataFrame, width: int = WIDTH) -> DataFrame:
    """(idx, level, position, value, commitment, left, right, a): an opening for each wanted leaf and level.

    A leaf meets the children of its node by the node's place; no group holds more than width of them.
    """
    shape = "idx bigint, level int, position int, value string, commitment string, `left` array<string>, `right` array<string>, a string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                values = [0] * width
                for c in r.children:
                    values[int(c["pos"]) % width] = C.scalar_of(c["hash"])
                p = C.prove(values, C.generators(width), int(r.position))
                rows.append((r.idx, r.level, r.position, f"{values[int(r.position)]:064x}", r.commitment, p["left"], p["right"], p["a"]))
            yield pd.DataFrame(rows, columns=["idx", "level", "position", "value", "commitment", "left", "right", "a"])

    out = None
    for k in range(len(levels) - 1):
        step = width**k
        children = levels[k].groupBy(F.floor(F.col("pos") / width).cast("long").alias("node")).agg(F.collect_list(F.struct("pos", "hash")).alias("children"))
        nodes = levels[k + 1].select(F.col("pos").alias("node"), "commitment")
        at = F.floor(F.col("idx") / step)
        asked = wanted.select("idx", F.lit(k).alias("level"), (at % width).cast("int").alias("position"), F.floor(at / width).cast("long").alias("node"))
        part = asked.join(children, "node").join(nodes, "node").select("idx", "level", "position", "commitment", "children").mapInPandas(run, shape)
        out = part if out is None else out.unionByName(part)
    return out


def verify(openings: DataFrame, width: int = WIDTH) -> DataFrame:
    """openings with valid: each opening against its commitment, and each commitment against the value above it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            good = []
            for r in b.itertuples(index=False):
                proof = {"left": list(r.left), "right": list(r.right), "a": r.a}
                good.append(C.verify(C.decompress(r.commitment), C.generators(width), int(r.position), int(r.value, 16), proof))
            yield pd.DataFrame({"idx": b["idx"], "level": b["level"], "opened": good})

    shape = "idx bigint, level int, opened boolean"
    opened = openings.mapInPandas(run, shape)
    above = openings.select("idx", (F.col("level") - 1).alias("level"), F.col("value").alias("above"))
    order = F.lit(f"{C.N:064x}")
    own = openings.select("idx", "level", node_hash(F.col("commitment")).alias("hash")).join(above, ["idx", "level"], "left")
    # a hash is below 2^256, so it is its own scalar unless it reaches the group's order
    linked = F.col("above").isNull() | (F.col("above") == F.col("hash")) | (F.col("hash") >= order)
    return opened.join(own, ["idx", "level"]).groupBy("idx").agg(F.bool_and(F.col("opened") & linked).alias("valid"))


def aggregate(openings: DataFrame) -> DataFrame:
    """Openings of many leaves with those that they share kept once: (commitment, position) is the key."""
    return openings.groupBy("level", "commitment", "position").agg(F.first("value").alias("value"), F.first("left").alias("left"), F.first("right").alias("right"), F.first("a").alias("a"), F.sort_array(F.collect_list("idx")).alias("leaves"))


def sizes(openings: int, width: int, atoms: int) -> dict[str, int]:
    """Bytes of a multiproof, and of the Merkle paths of as many atoms."""
    depth = max(1, (atoms - 1).bit_length())
    return {"multiproof": openings * (33 + 4 + 32 + C.proof_size(width)), "merkle": atoms * depth * 32}


def local_root(hashes: list[str], width: int = WIDTH) -> str:
    """The same root without Spark, for checks."""
    level = hashes
    while True:
        commitments = [C.compress(C.commit([C.scalar_of(h) for h in level[k : k + width]] + [0] * (width - len(level[k : k + width])), C.generators(width))) for k in range(0, len(level), width)]
        if len(commitments) <= 1:
            return commitments[0] if commitments else C.compress(None)
        level = [sha256(bytes.fromhex(c)).hexdigest() for c in commitments]
