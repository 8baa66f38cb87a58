"""Near-duplicates by 64-bit SimHash, linked within a Hamming radius through vantage-point trees.

A vantage-point tree cuts a set at a distance mu from one of its points: what lies within mu goes
inwards, what lies beyond goes outwards, and by the triangle inequality a pair within the reach r
that is parted by the cut has both distances in (mu - r, mu + r]. The inner ends of such pairs,
those beyond mu - r, therefore go to both sides, so that every linked pair meets in some leaf.

One tree over all 64 bits cuts little at a radius of 4: distances of unrelated fingerprints
concentrate at 32 +- 4, so a cut sends a third of all points to both sides, and the work grows as
n to the power 1.9. The bits are therefore dealt to TREES parts with a tree each. The Hamming
distance on a part is a metric, too, and a pair within the radius differs in at most
radius // TREES bits of some part, so its reach is 1 there: a cut copies a sixth of the points,
and the work grows as n to the power 1.3. Points that a part's distance cannot tell apart are cut
by the whole distance with its own reach.

* The upper levels are grown on the driver from at most SAMPLE fingerprints, until their leaves
  hold about SHARD of all; each fingerprint is sent to its leaf and to those whose boundary it is in.
* Shards of more than LARGE are cut again and again, each by a vantage point of its own, in joins
  and counts; one that no cut makes smaller is dealt out in blocks, every two of which meet.
* Each shard is searched by one task, by the same cuts down to LEAF points, which are compared.

All is exact. Equal fingerprints are one class before any search; a shard gives the edges of a
spanning forest, never all pairs of a group; classes are joined by connected components.

Defined cases: a text without words (null, empty, white space) has fingerprint zero and links like
any other; fewer than ``width`` words are one shingle; repeated rows are members of one class; a
null id keeps its row, takes no part in the minimum and gets the component of its class (null if
no member has an id); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, drop_cut, read_table, with_row_id
from .components import connected_components

SEED, WIDTH, RADIUS = 42, 4, 4
#: Parts of the bits with a tree each; fingerprints in a leaf, in a shard as the upper levels aim at, and in one that a task may hold.
TREES, LEAF, SHARD, LARGE = 3, 512, 1 << 14, 1 << 20
#: Fingerprints that the upper levels are grown from, and the fewest of them that are cut.
SAMPLE, LEAST = 1 << 18, 32
#: Vantage points tried for a cut, and the share of the points that the larger side may keep.
TRIED, WORTH = 4, 0.9
_STEP, _ROW = 1 << 14, "__row"


def fingerprint(text: str | None, width: int = WIDTH, seed: int = SEED) -> int:
    """The SimHash of a whole text: each bit by majority over its word shingles."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    at = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    starts = [0, *(at + 1).tolist()]
    ends = [*at.tolist(), len(line)]
    n = max(1, len(words) - width + 1)
    ends = ends[width - 1 :] or ends[-1:]
    digest = xxhash.xxh64_intdigest
    total = np.zeros(64, np.int64)
    for k in range(0, n, _STEP):
        h = np.array([digest(line[a:b], seed) for a, b in zip(starts[k : min(n, k + _STEP)], ends[k : k + _STEP])], dtype="<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """(key, fp): the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), width, seed) for t in batch.column(1)], dtype="<u8").view("<i8")
            yield pa.record_batch([batch.column(0), pa.array(fp)], names=[key, "fp"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, fp bigint")


def _parts(radius: int, trees: int) -> list[tuple[int, int]]:
    """(mask, reach) of each tree: a part of the bits, and how far apart a linked pair is in one of the parts at most."""
    ends = [64 * k // trees for k in range(trees + 1)]
    return [((1 << b) - (1 << a), radius // trees) for a, b in zip(ends, ends[1:])]


def _distances(x: np.ndarray, vantage: int, mask: int) -> np.ndarray:
    return np.bitwise_count((x ^ np.uint64(vantage)) & np.uint64(mask)).astype(np.int16)


def _cut(x: np.ndarray, metrics: list[tuple[int, int]]) -> tuple[int, int, int, int] | None:
    """(vantage, mask, reach, mu) of the cut of x that leaves the fewest pairs, by the first metric that is worth it."""
    tried = x[:: max(1, len(x) // TRIED)][:TRIED].tolist()
    for mask, reach in metrics:
        best = (WORTH * len(x) ** 2,)
        for v in tried:
            inner = np.cumsum(np.bincount(_distances(x, v, mask), minlength=65)).astype(float)
            outer = len(x) - np.concatenate([np.zeros(reach), inner])[:65]
            pairs = inner**2 + outer**2
            mu = int(pairs.argmin())
            best = min(best, (pairs[mu], v, mu))
        if len(best) > 1:
            return best[1], mask, reach, best[2]
    return None


def _sides(x: np.ndarray, at: np.ndarray, cut_at: tuple[int, int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The places at of x that go inwards, and those that go outwards."""
    vantage, mask, reach, mu = cut_at
    d = _distances(x[at], vantage, mask)
    return at[d <= mu], at[d > mu - reach]


#: A tree's nodes: a cut with its inner and outer node, or the number of a leaf.
_Tree = list


def grow(sample: np.ndarray, least: float, metrics: list[tuple[int, int]]) -> _Tree:
    """A tree over a sample whose leaves hold fewer than least of its points, where cuts reach that far."""
    nodes: _Tree = [None]
    stack, leaves = [(0, np.arange(len(sample)))], 0
    while stack:
        node, at = stack.pop()
        found = _cut(sample[at], metrics) if len(at) > max(least, LEAST) else None
        if found is None:
            nodes[node], leaves = leaves, leaves + 1
            continue
        nodes[node] = (found, len(nodes), len(nodes) + 1)
        nodes += [None, None]
        stack += list(zip(nodes[node][1:], _sides(sample, at, found)))
    return nodes


def route(x: np.ndarray, tree: _Tree) -> tuple[np.ndarray, np.ndarray]:
    """(place in x, leaf) of every leaf that each point belongs to."""
    places, leaves = [], []
    stack = [(0, np.arange(len(x)))]
    while stack:
        node, at = stack.pop()
        if not len(at):
            continue
        if isinstance(tree[node], int):
            places.append(at)
            leaves.append(np.full(len(at), tree[node], np.int64))
        else:
            found, inner, outer = tree[node]
            stack += list(zip((inner, outer), _sides(x, at, found)))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *places]), np.concatenate([none, *leaves])


class _Forest:
    """Links of one shard, kept as a spanning forest: each point's group, and the points of each group."""

    def __init__(self, x: np.ndarray, radius: int):
        self.x, self.radius = x, radius
        self.label = np.arange(len(x))
        self.members: dict[int, list[int]] = {}
        self.edges: list[tuple[int, int]] = []

    def _join(self, a: int, near: np.ndarray) -> None:
        own, others = int(self.label[a]), self.label[near]
        new = others != own
        if not new.any():
            return
        found, first = np.unique(others[new], return_index=True)
        self.edges += [(a, k) for k in near[new][first].tolist()]
        groups = [own, *found.tolist()]
        of = [self.members.pop(g, None) or [g] for g in groups]
        large = max(range(len(groups)), key=lambda k: len(of[k]))
        for k, some in enumerate(of):  # the smaller groups take the largest one's label
            if k != large:
                self.label[some] = groups[large]
                of[large].extend(some)
        self.members[groups[large]] = of[large]

    def compare(self, s: np.ndarray) -> None:
        """All pairs of s, in blocks, until they are one group."""
        step = max(1, (1 << 20) // max(1, len(s)))
        for k in range(0, len(s), step):
            rows, cols = s[k : k + step], s[k:]
            if (self.label[s] == self.label[s[0]]).all():
                return
            hit = np.bitwise_count(self.x[rows][:, None] ^ self.x[cols][None, :]) <= self.radius
            hit &= np.arange(len(cols))[None, :] > np.arange(len(rows))[:, None]
            for r in np.flatnonzero(hit.any(axis=1)).tolist():
                self._join(int(rows[r]), cols[hit[r]])

    def search(self, metrics: list[tuple[int, int]]) -> None:
        stack = [np.arange(len(self.x))]
        while stack:
            s = stack.pop()
            found = _cut(self.x[s[:: max(1, len(s) // 2048)]], metrics) if len(s) > LEAF else None
            parts = _sides(self.x, s, found) if found else ()
            if found and max(map(len, parts)) < len(s):
                stack += parts
            else:
                self.compare(s)


def _forest_edges(batches: Iterator[pa.RecordBatch], radius: int, metrics: list[list[tuple[int, int]]]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, tree, fp) sorted by shard, to the edges of each shard's forest."""
    held: list[np.ndarray] = []
    out: list[np.ndarray] = []
    last = None

    def done() -> None:
        x = np.unique(np.concatenate(held)).view("<u8")
        if len(x) > 1:
            forest = _Forest(x, radius)
            forest.search(metrics[last[1]])
            if forest.edges:
                out.append(x[np.array(forest.edges)].view("<i8"))

    for batch in batches:
        names = np.stack([np.asarray(batch.column(0)), np.asarray(batch.column(1)).astype(np.int64)], axis=1)
        fp = np.asarray(batch.column(2))
        ends = np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1
        for a, b in zip([0, *ends.tolist()], [*ends.tolist(), len(fp)]):
            if a == b:
                continue
            name = tuple(names[a].tolist())
            if name != last and held:
                done()
                held = []
            last = name
            held.append(fp[a:b])
        if out:
            a, b = np.concatenate(out).T
            out = []
            yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])
    if held:
        done()
    if out:
        a, b = np.concatenate(out).T
        yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _cut_large(rows: DataFrame, parts: list[tuple[int, int]], radius: int, large: int) -> DataFrame:
    """Rows (shard, tree, level, fp) of shards that are too large, in other shards: one cut of each.

    Levels: 0 is cut by a part's distance, 1 by the whole one, where the part's is no use; what that does not
    cut, either, is dealt out in blocks of half of large, a shard for every two of them, and is at level 2.
    A shard has one row in the tables that it meets, and at most 65 in the counts by distance.
    """
    level, by = F.col("level"), Window.partitionBy("shard").orderBy("d")
    mask = F.when(level == 1, F.lit(-1).cast("long")).otherwise(F.element_at(F.array(*[F.lit(_signed(m)).cast("long") for m, _ in parts]), F.col("tree") + 1))
    heads = cut(rows.groupBy("shard").agg(F.min_by("fp", F.xxhash64("fp", "shard")).alias("vantage"), F.count("*").alias("n")))
    placed = rows.join(heads, "shard").withColumn("d", F.bit_count(F.col("fp").bitwiseXOR(F.col("vantage")).bitwiseAND(mask)))
    counts = placed.groupBy("shard", "level", "n", "d").agg(F.count("*").alias("c"))

    def upto(back: int) -> Column:
        return F.coalesce(F.sum("c").over(by.rangeBetween(Window.unboundedPreceding, -back)), F.lit(0)).cast("double")

    outer = F.col("n") - F.when(level == 1, upto(radius)).otherwise(upto(parts[0][1]))
    pairs = counts.select("shard", "n", F.col("d").alias("mu"), (upto(0) * upto(0) + outer * outer).alias("pairs"))
    best = cut(pairs.groupBy("shard", "n").agg(F.min(F.struct("pairs", "mu")).alias("b")).select("shard", F.when(F.col("b.pairs") <= WORTH * F.col("n") * F.col("n"), F.col("b.mu")).alias("mu")))
    placed = placed.join(best, "shard")
    reach = F.when(level == 1, F.lit(radius)).otherwise(F.lit(parts[0][1]))
    sides = F.array_compact(F.array(F.when(F.col("d") <= F.col("mu"), F.lit(0)), F.when(F.col("d") > F.col("mu") - reach, F.lit(1))))
    blocks = F.ceil(F.col("n") * 2 / large).cast("int")
    own = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    pairs_of = F.transform(F.sequence(F.lit(0), blocks - 1), lambda k: F.xxhash64("shard", F.least(k, own), F.greatest(k, own)))
    halves = F.transform(sides, lambda k: F.xxhash64("shard", k))
    to = F.when(F.col("mu").isNotNull(), halves).when(level == 0, F.array("shard")).otherwise(pairs_of)
    return placed.select(F.explode(to).alias("shard"), "tree", F.when(F.col("mu").isNull(), level + 1).otherwise(level).alias("level"), "fp")


def hamming_links(classes: DataFrame, radius: int = RADIUS, shard: int = SHARD, large: int = LARGE, trees: int = TREES) -> DataFrame:
    """(a, b) over the distinct longs of classes.fp: a spanning forest per shard of the links within radius."""
    spark, parts = classes.sparkSession, _parts(radius, trees)
    metrics = [[p, ((1 << 64) - 1, radius)] for p in parts]
    n = classes.count()
    wanted = min(SAMPLE, 8 * LEAST * n // shard)
    grown: list[_Tree] = [[0]] * trees
    if n > shard:
        some = classes.filter(F.pmod(F.xxhash64("fp"), F.lit(1 << 40)) <= int(wanted / n * (1 << 40))).select("fp").toArrow()  # about as many as wanted, whatever n is
        sample = np.sort(some.column("fp").combine_chunks().to_numpy()).view("<u8")
        grown = [grow(sample, shard * len(sample) / n, own[:1]) for own in metrics]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).to_numpy().view("<u8")
            for k, tree in enumerate(grown):
                at, leaf = route(x, tree)
                whole = np.full(len(at), k, np.int32)
                yield pa.record_batch([pa.array(leaf + (k << 40)), pa.array(whole), pa.array(whole * 0), pa.array(x[at].view("<i8"))], names=["shard", "tree", "level", "fp"])

    dealt = cut(classes.select("fp").mapInArrow(deal, "shard bigint, tree int, level int, fp bigint"))
    while True:
        sizes = dealt.groupBy("shard").agg(F.count("*").alias("n"), F.min("level").alias("level"))
        most, total = sizes.agg(F.max(F.when(F.col("level") < 2, F.col("n"))), F.coalesce(F.sum("n"), F.lit(0))).first()
        if (most or 0) <= large:
            break
        over = cut(sizes.filter((F.col("n") > large) & (F.col("level") < 2)).select("shard"))
        smaller = cut(dealt.join(over, "shard", "left_anti").unionByName(_cut_large(dealt.join(over, "shard", "left_semi"), parts, radius, large)))
        drop_cut(dealt)
        dealt = smaller
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // (1 << 17)))
    return dealt.select("shard", "tree", "fp").repartition(tasks, "shard").sortWithinPartitions("shard").mapInArrow(lambda it: _forest_edges(it, radius, metrics), "a bigint, b bigint")


def _component_classes(fps: DataFrame, rep, radius: int) -> DataFrame:
    """(fp, rep, component) of each distinct fp: the least rep of its rows, and what is the same for all that it reaches over links."""
    classes = cut(fps.groupBy("fp").agg(F.min(rep).alias("rep")))
    nodes = connected_components(hamming_links(classes, radius))
    return classes.join(nodes.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = WIDTH, seed: int = SEED, radius: int = RADIUS) -> DataFrame:
    """(key, fp, component_id): each row's fingerprint and the smallest key that it reaches over links."""
    fps = cut(fingerprints(docs, text, key, width, seed))
    named = _component_classes(fps, key, radius)
    linked = named.filter("component is not null").groupBy("component").agg(F.min("rep").alias("component_id"))
    of_class = named.join(linked, "component").select("fp", "component_id")
    return fps.join(of_class, "fp").select(key, "fp", "component_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with one row of each near-duplicate group: that of the smallest id, and the first of several.

    Rows without an id come last, so one stays only where its group has no id.
    """
    rows = with_row_id(docs, _ROW)
    at = F.struct(F.col(key).isNull().alias("nameless"), F.col(key).alias("k"), F.col(_ROW).alias("row"))
    fps = cut(fingerprints(rows.select(at.alias("at"), F.col(text).alias("t")), "t", "at"))
    named = _component_classes(fps, "at", RADIUS)
    keep = cut(named.groupBy("component").agg(F.min("rep").alias("rep")).select(F.col("rep.row").alias(_ROW)))
    return rows.join(keep.hint("merge"), _ROW, "left_semi").select(*docs.columns)  # rows to keep grow with the corpus: never broadcast


__all__ = ["deduplicate", "fingerprint", "fingerprints", "hamming_links", "near_duplicates", "op7_simhash"]
