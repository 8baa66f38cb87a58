"""Approximate maximum inner products: anisotropic quantisation, four-bit table scans, exact reranking.

Vectors are split among partitions around k-means centres. Within its partition a vector is its
scaled residual, coded in four bits for every SUB dimensions. Codes and codebooks are fitted to
the score-aware loss: the residual's part along the vector itself costs ETA times its other part,
since only that part moves large inner products. With r the residual and u the vector's direction,

    loss = |r|^2 + (ETA - 1) (r . u)^2

is lowered by coordinate descent over the codes and by closed-form 2 x 2 systems for the
codewords. A query scans tables of its inner products with all codewords: the sum of one table
entry a code is the approximate score. What may still be among a query's best is scored again on
the original vectors in double precision:

* a query's scores with those of ANCHORS rows of the sample that are in the partitions it visits
  bound what its last answer scores from below, and so do the exact scores that a task has seen;
* approximate scores of top rows lie below the exact ones by no more than a margin, but for one in
  two hundred; the margin is measured on the sample;
* so a row is scored again if its approximate score reaches the bound less the margin. No number
  of rows is fixed: more rows raise the bound.

The model is fitted on about TRAIN rows, chosen by a hash; it has at most PARTS centres, so what is
broadcast is bounded (PARTS and ANCHORS vectors). Every row is indexed. Partitions of more rows
than a block (BLOCK_BYTES of vectors) are dealt out in blocks, so no task holds more than a block and
a slice of queries, whatever share of rows one partition has. A query visits partitions in the
order of its inner product with their centres, until they hold the share of all rows that held
REACHED of the nearest rows of the sample's own queries: little where vectors are clustered, most of
them where they are spread evenly over the sphere, since nothing prunes there.

Defined cases: vectors that are null, empty, zero, or that hold null or non-finite components take
no part, as queries or candidates; where lengths differ, the components that a vector lacks count as
zero; null ids take no part; equal scores go to the smaller id; repeated rows of an id are queries
and candidates each, and only the query's own row is left out; fewer candidates than asked for are
all returned; no queries or an empty table give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, read_table

TRAIN, ANCHORS, PART, PARTS, BLOCK_BYTES, SUB, CODES = 20_000, 8192, 4096, 1024, 1 << 24, 2, 16
ETA, REACHED, SURE, TOP, SCORES = 2.6, 0.97, 0.995, 20, 1 << 21
ROUNDS, SWEEPS, ASKED = 6, 2, 512
#: Candidates that a task holds before it merges them.
FLUSH = 400_000


class Model:
    """Centres, scales and codebooks."""

    def __init__(self, sample: np.ndarray, parts: int, top: int = TOP, seed: int = 7):
        rng = np.random.default_rng(seed)
        x = sample.astype(np.float32)
        self.dim = x.shape[1]
        self.subs = -(-self.dim // SUB)
        parts = max(1, min(parts, len(x)))
        self.centres = x[rng.choice(len(x), parts, replace=False)].copy()
        for _ in range(ROUNDS):
            own = self.nearest(x)
            n = np.bincount(own, minlength=parts)
            sums = np.zeros_like(self.centres)
            np.add.at(sums, own, x)
            self.centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], self.centres)
        own = self.nearest(x)
        r = x - self.centres[own]
        energy = np.bincount(own, weights=(r * r).mean(axis=1), minlength=parts) / np.maximum(np.bincount(own, minlength=parts), 1)
        typical = float((r * r).mean()) or 1.0
        self.scales = np.sqrt(np.where(energy > 0, energy, typical)).astype(np.float32)
        self._fit(self._pad(r / self.scales[own][:, None]), self._directions(x), rng)
        self.anchors, self.anchor_parts = x[:ANCHORS], own[:ANCHORS]
        self._measure(x, own, top)

    def _measure(self, x: np.ndarray, own: np.ndarray, top: int) -> None:
        """The margin of approximate scores, and the share of rows to visit, from the sample's own queries."""
        asked = np.arange(0, len(x), max(1, len(x) // ASKED))[:ASKED]
        q = x[asked]
        part, codes = self.index(x)
        codes = np.stack([codes >> 4, codes & 15], axis=2).reshape(len(x), -1)[:, : self.subs]
        coded = self.books[np.arange(self.subs)[None, :], codes].reshape(len(x), -1)[:, : self.dim]
        coded = self.centres[part] + self.scales[part][:, None] * coded
        held = np.bincount(own, minlength=len(self.centres))
        order = self.visits(q)
        before = np.empty(order.shape)  # the share of rows in the partitions that are visited earlier
        np.put_along_axis(before, order, np.cumsum(held[order], axis=1) - held[order], axis=1)
        errors, needed = [], []
        for k in range(0, len(q), 64):
            exact, approx = q[k : k + 64] @ x.T, q[k : k + 64] @ coded.T
            best = np.argpartition(-exact, min(top, len(x) - 1), axis=1)[:, : top + 1]
            gap = np.take_along_axis(exact, best, axis=1) - np.take_along_axis(approx, best, axis=1)
            errors.append(gap / np.maximum(np.linalg.norm(q[k : k + 64], axis=1, keepdims=True), 1e-30))
            others = best != asked[k : k + 64, None]
            needed.append(np.take_along_axis(before[k : k + 64], part[best], axis=1)[others] / len(x))
        self.margin = float(max(0.0, np.quantile(np.concatenate(errors), SURE))) * 1.05 + 1e-5
        needed = np.concatenate(needed)
        self.share = float(np.quantile(needed, REACHED)) if len(needed) else 0.0

    def visits(self, q: np.ndarray) -> np.ndarray:
        """Partitions in the order in which each query visits them."""
        return np.argsort(-(q.astype(np.float32) @ self.centres.T), axis=1, kind="stable")

    def floors(self, q: np.ndarray, visited: np.ndarray, top: int) -> np.ndarray:
        """What each query's last answer scores at least, from the anchors in the partitions that it visits (queries, partitions).

        Twice as many as are asked for score that much: the query may be an anchor itself, and codes may lose some.
        """
        rank = 2 * top
        if len(self.anchors) <= rank:
            return np.full(len(q), -np.inf)
        scores = np.where(visited[:, self.anchor_parts], q.astype(np.float32) @ self.anchors.T, -np.inf)
        return np.partition(scores, len(self.anchors) - rank - 1, axis=1)[:, len(self.anchors) - rank - 1].astype(np.float64)

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """By Euclidean distance, in slices."""
        half = (self.centres * self.centres).sum(axis=1) / 2
        return np.concatenate([np.argmax(x[k : k + 4096] @ self.centres.T - half, axis=1) for k in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])

    def _pad(self, y: np.ndarray) -> np.ndarray:
        y = np.pad(y, ((0, 0), (0, self.subs * SUB - self.dim)))
        return y.reshape(len(y), self.subs, SUB).astype(np.float32)

    def _directions(self, x: np.ndarray) -> np.ndarray:
        return self._pad(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30))

    def _fit(self, y: np.ndarray, u: np.ndarray, rng: np.random.Generator) -> None:
        take = rng.choice(len(y), CODES, replace=len(y) < CODES)
        self.books = np.ascontiguousarray(y[take].transpose(1, 0, 2)) + rng.normal(0, 1e-3, (self.subs, CODES, SUB)).astype(np.float32)
        eye = np.eye(SUB, dtype=np.float32)
        for step in range(ROUNDS):
            codes = self.encode(y, u if step > 1 else None)
            along = self._along(y, u, codes)
            for m in range(self.subs):
                c, um, ym = codes[:, m], u[:, m], y[:, m]
                mine = ((ym - self.books[m][c]) * um).sum(axis=1)
                t = along - mine
                if step > 1:
                    a = eye + (ETA - 1) * um[:, :, None] * um[:, None, :]
                    b = ym + (ETA - 1) * (t + (ym * um).sum(axis=1))[:, None] * um
                else:
                    a, b = np.broadcast_to(eye, (len(y), SUB, SUB)), ym
                for k in range(CODES):
                    at = c == k
                    if at.any():
                        self.books[m, k] = np.linalg.solve(a[at].sum(axis=0) + 1e-6 * eye, b[at].sum(axis=0))
                along = t + ((ym - self.books[m][c]) * um).sum(axis=1)

    def _along(self, y: np.ndarray, u: np.ndarray, codes: np.ndarray) -> np.ndarray:
        coded = self.books[np.arange(self.subs)[None, :], codes]
        return ((y - coded) * u).sum(axis=(1, 2))

    def encode(self, y: np.ndarray, u: np.ndarray | None) -> np.ndarray:
        """Codes by the plain loss, then, with directions, by coordinate descent on the score-aware one."""
        d = ((y[:, :, None, :] - self.books[None]) ** 2).sum(axis=3)
        codes = d.argmin(axis=2)
        if u is None:
            return codes
        dots = ((y[:, :, None, :] - self.books[None]) * u[:, :, None, :]).sum(axis=3)
        rows = np.arange(len(y))
        along = np.take_along_axis(dots, codes[:, :, None], axis=2)[:, :, 0].sum(axis=1)
        for _ in range(SWEEPS):
            for m in range(self.subs):
                t = along - dots[rows, m, codes[:, m]]
                best = (d[:, m] + (ETA - 1) * (t[:, None] + dots[:, m]) ** 2).argmin(axis=1)
                codes[:, m] = best
                along = t + dots[rows, m, best]
        return codes

    def index(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Partition and packed codes, two a byte, of each row."""
        own = self.nearest(x)
        out = np.zeros((len(x), -(-self.subs // 2)), np.uint8)
        for k in range(0, len(x), 1024):
            part = x[k : k + 1024]
            y = self._pad((part - self.centres[own[k : k + 1024]]) / self.scales[own[k : k + 1024]][:, None])
            codes = self.encode(y, self._directions(part)).astype(np.uint8)
            codes = np.pad(codes, ((0, 0), (0, self.subs % 2)))
            out[k : k + 1024] = codes[:, ::2] << 4 | codes[:, 1::2]
        return own, out

    def tables(self, q: np.ndarray) -> np.ndarray:
        """For each query and pair of codes the inner product with both codewords: (queries, pairs, 256)."""
        t = np.einsum("qms,mcs->qmc", self._pad(q), self.books)
        if self.subs % 2:
            t = np.concatenate([t, np.zeros_like(t[:, :1])], axis=1)
        return (t[:, ::2, :, None] + t[:, 1::2, None, :]).reshape(len(q), -1, 256).astype(np.float32)


def scan_block(tables: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Approximate scores (queries, rows), up to the block's centre and scale."""
    out = np.zeros((len(tables), len(codes)), np.float32)
    for m in range(codes.shape[1]):
        out += np.take(tables[:, m], codes[:, m], axis=1)
    return out


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of dim components, those that a vector lacks as zeros."""
    flat, ends = np.asarray(column.flatten()), np.concatenate([[0], np.cumsum(np.asarray(column.value_lengths()))])
    if len(flat) == len(column) * dim:
        return flat.reshape(-1, dim)
    out = np.zeros((len(column), dim), flat.dtype)
    for k, (a, b) in enumerate(zip(ends, ends[1:])):
        out[k, : b - a] = flat[a:b]
    return out


def _best(parts: list[tuple[np.ndarray, ...]], top: int) -> tuple[np.ndarray, ...]:
    """The top rows of each query among parts of (query's row, query's id, id, score)."""
    row, q, i, s = (np.concatenate(c) for c in zip(*parts))
    order = np.lexsort((i, -s, row))
    row, q, i, s = row[order], q[order], i[order], s[order]
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    rank = np.arange(len(row)) - np.repeat(first, np.diff(np.concatenate([first, [len(row)]])))
    keep = rank < top
    return row[keep], q[keep], i[keep], s[keep]


def _search(batches: Iterator[pa.RecordBatch], model: Model, top: int) -> Iterator[pa.RecordBatch]:
    """Rows (part, block, query, row, id, vector, code, floor), sorted, with each block's rows before its queries, to candidates."""
    name, held, ready = None, [], None
    out: list[tuple[np.ndarray, ...]] = []
    found = 0
    seen = np.zeros(0, np.int64), np.zeros(0)  # queries whose bound this task has raised, and the bounds

    def raised(rows: np.ndarray, floors: np.ndarray) -> np.ndarray:
        if not len(seen[0]):
            return floors
        at = np.minimum(np.searchsorted(seen[0], rows), len(seen[0]) - 1)
        return np.where(seen[0][at] == rows, np.maximum(floors, seen[1][at]), floors)

    def answer(rows: np.ndarray, ids: np.ndarray, q: np.ndarray, floors: np.ndarray) -> None:
        nonlocal ready, found
        if not held:
            return
        if ready is None:
            ready = tuple(np.concatenate(c) for c in zip(*held))
        row, i, v, c = ready
        step = max(1, SCORES // len(i))
        floors = raised(rows, floors)
        for k in range(0, len(q), step):
            part = q[k : k + step]
            approx = scan_block(model.tables(part), c) * model.scales[name[0]] + (part.astype(np.float32) @ model.centres[name[0]])[:, None]
            least = floors[k : k + step] - model.margin * np.linalg.norm(part, axis=1)
            a, b = np.nonzero(approx >= least.astype(np.float32)[:, None])
            score = np.concatenate([np.zeros(0), *((v[b[n : n + 65536]].astype(np.float64) * part[a[n : n + 65536]]).sum(axis=1) for n in range(0, len(a), 65536))])
            good = (score >= floors[k : k + step][a] - 1e-4 * np.abs(floors[k : k + step][a])) & (row[b] != rows[k + a])
            a, b, score = a[good] + k, b[good], score[good]
            out.append((rows[a], ids[a], i[b], score))
            found += len(a)

    def merge() -> None:
        nonlocal out, found, seen
        best = _best(out, top)
        out, found = [best], len(best[0])
        rows, first, n = np.unique(best[0], return_index=True, return_counts=True)
        full = n == top
        seen = rows[full], best[3][first[full] + top - 1]

    def record(part) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c) for c in part], names=["query_row", "query_id", "vec_id", "score"])

    for batch in batches:
        keys = np.stack([np.asarray(batch.column(k)).astype(np.int64) for k in range(3)], axis=1)
        ends = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        for a, b in zip([0, *ends.tolist()], [*ends.tolist(), len(keys)]):
            if a == b:
                continue
            if (keys[a, 0], keys[a, 1]) != name:
                name, held, ready = (keys[a, 0], keys[a, 1]), [], None
            part = batch.slice(a, b - a)
            row, own, x = np.asarray(part.column(3)), np.asarray(part.column(4)), _matrix(part.column(5), model.dim)
            if keys[a, 2]:
                answer(row, own, x.astype(np.float64), np.asarray(part.column(7)))
            else:
                held.append((row, own, x, np.frombuffer(b"".join(part.column(6).to_pylist()), np.uint8).reshape(b - a, -1)))
        if found > FLUSH:  # a task's blocks are merged before anything is shuffled
            merge()
            if found > FLUSH // 2:
                yield record(out[0])
                out, found = [], 0
    if out:
        merge()
        yield record(out[0])


def nearest(vectors: DataFrame, is_query, top: int = TOP, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the top rows of largest inner product of every row for which is_query holds."""
    v = F.col(column)
    kind = "float" if vectors.schema[column].dataType.elementType.simpleString() == "float" else "double"
    finite = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = vectors.filter(F.col(key).isNotNull() & v.isNotNull() & (F.size(v) > 0)).filter(finite & F.exists(v, lambda e: e != 0))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("id"), v.cast(f"array<{kind}>").alias("x"), F.coalesce(is_query, F.lit(False)).alias("q"))
    dim, total = rows.agg(F.max(F.size("x")), F.count("*")).first()
    if not total:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    some = rows.filter(F.pmod(F.xxhash64("row"), F.lit(1 << 40)) < int(min(1.0, TRAIN / total) * (1 << 40))) if total > TRAIN else rows
    sample = _matrix(some.select("x").toArrow().column("x").combine_chunks(), dim)[: TRAIN + TRAIN // 10]
    model = Model(sample, min(PARTS, -(-total // PART)), top)
    block_rows = max(PART, BLOCK_BYTES // (dim * 4))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, codes = model.index(_matrix(batch.column(2), dim).astype(np.float32))
            yield pa.record_batch([*batch.columns, pa.array(part.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary())], names=["row", "id", "x", "q", "part", "code"])

    indexed = cut(rows.mapInArrow(index, f"row bigint, id bigint, x array<{kind}>, q boolean, part int, code binary"))  # rows have their numbers from here on
    held = np.zeros(len(model.centres), np.int64)
    for r in indexed.groupBy("part").agg(F.count("*").alias("n")).collect():  # a row a centre: bounded
        held[r["part"]] = r["n"]
    blocks = np.maximum(1, -(-held // block_rows))
    enough = max(model.share * held.sum(), 4 * top)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(2), dim)
            order = model.visits(x)
            early = (np.cumsum(held[order], axis=1) - held[order] <= enough) & (held[order] > 0)
            visited = np.zeros(early.shape, bool)
            np.put_along_axis(visited, order, early, axis=1)
            floors = model.floors(x, visited, top)
            at, nth = np.nonzero(early)
            part = order[at, nth]
            times = blocks[part]
            block = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            at, part = np.repeat(at, times), np.repeat(part, times)
            for a in range(0, len(at), 8192):
                take, n = pa.array(at[a : a + 8192]), len(at[a : a + 8192])
                yield pa.record_batch([pa.array(part[a : a + 8192].astype(np.int32)), pa.array(block[a : a + 8192].astype(np.int32)), pa.array(np.ones(n, np.int32)), *(batch.column(c).take(take) for c in range(3)), pa.nulls(n, pa.binary()), pa.array(floors[at[a : a + 8192]])], names=["part", "block", "query", "row", "id", "x", "code", "floor"])

    shape = f"part int, block int, query int, row bigint, id bigint, x array<{kind}>, code binary, floor double"
    deal = F.element_at(F.array(*[F.lit(int(b)) for b in blocks]), F.col("part") + 1)
    data = indexed.select("part", F.pmod(F.xxhash64("row"), deal).cast("int").alias("block"), F.lit(0).alias("query"), "row", "id", "x", "code", F.lit(None).cast("double").alias("floor"))
    queries = indexed.filter("q").select("row", "id", "x").mapInArrow(probe, shape)
    cells = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(blocks.sum()) // 4)
    found = data.unionByName(queries).repartition(cells, "part", "block").sortWithinPartitions("part", "block", "query")
    found = found.mapInArrow(lambda it: _search(it, model, top), "query_row bigint, query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
