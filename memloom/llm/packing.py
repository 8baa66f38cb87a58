"""Order-preserving packing of documents into fixed windows by dynamic programming.

Documents keep their order within an input partition. Windows may end at document ends (free), at
sentence ends inside a document (a penalty), and, where a sentence is long, at places inside it
(a larger penalty). The plan of a stretch is the cheapest chain of cuts: a window of length L
costs its padding plus the penalty of the cut that ends it, so

    best[j] = W - p[j] + penalty[j] + min over p[j] - W <= p[i] < p[j] of (best[i] + p[i])

and the minimum comes from a monotone queue, one push and pop a cut. Windows whose length is a
power of two are not padded; they are extra transitions. Nothing is shuffled: a task plans its
partition as it comes, and lets go of what is settled: the chains of all cuts that a later window
can begin at share their beginnings, and these are the cheapest whatever follows. So the plan is
the cheapest of the whole partition, in the memory of a stretch and what is not settled yet.

The order is that of the rows in a partition, so windows follow the table's layout: another layout
of the same rows gives other cuts and numbers, but the same ids in pieces that cover each document.
A partition that is computed again, after a lost executor, reads the same split and gives the same rows.

Defined cases: a null or empty text is one piece, its end id; a text longer than a window spans
several; equal documents are packed one by one; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .bpe import encoder
from .common import TOKENIZER_FILE, read_table

WIDTH = 2048
END_ID = 1
#: Costs in tokens of padding: a window of its own, a cut after a sentence, a cut inside one.
WINDOW_COST, SENTENCE_COST, INNER_COST = 24, 8, 96
#: Sentence ends nearer to each other than this are one candidate; longer sentences get inner candidates.
NEAR, LONG, INNER_STEP = 8, 256, 32
#: Tokens gathered before what is settled is let go; it has no influence on the plan.
STRETCH = 1 << 19
#: Bytes of text encoded at a time, and the last text's; it has no influence on the ids.
BLOCK = 1 << 25
OUT = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def sentence_ends(enc) -> np.ndarray:
    """By id: whether the token is punctuation with a full stop, exclamation or question mark."""
    table = np.zeros(max(enc.token_of) + 1, dtype=bool)
    for token, i in enc.vocab.items():
        body = token.removesuffix(enc.suffix)
        table[i] = token != body and not any(c.isalnum() for c in body) and any(c in ".!?" for c in body)
    return table


def candidates(n: int, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where a document of n tokens may be cut, its end the last, and their penalties.

    ends: sorted places after sentence ends; of those near to each other the first counts.
    """
    soft = ends[(ends > 0) & (ends < n)]
    if len(soft):
        group = soft // NEAR
        soft = soft[np.concatenate([[True], group[1:] != group[:-1]])]
    at = np.concatenate([soft, [n]])
    cost = np.full(len(at), SENTENCE_COST)
    cost[-1] = 0
    before = np.concatenate([[0], at[:-1]])
    if (at - before).max() <= LONG:
        return at, cost
    inner = np.concatenate([np.arange(a + INNER_STEP, b, INNER_STEP) for a, b in zip(before, at) if b - a > LONG])
    order = np.argsort(np.concatenate([at, inner]), kind="stable")
    return np.concatenate([at, inner])[order], np.concatenate([cost, np.full(len(inner), INNER_COST)])[order]


def settled(back: list[int], first: int) -> int:
    """The last cut that the chains of all cuts from first on share."""
    alive = [False] * first + [True] * (len(back) - first)
    count, j = len(back) - first, len(back) - 1
    while True:
        if alive[j]:
            if count == 1:
                return j
            if alive[back[j]]:
                count -= 1
            alive[back[j]] = True
        j -= 1


def plan(at: np.ndarray, cost: np.ndarray, width: int = WIDTH, last: bool = True) -> list[int]:
    """Positions of the cheapest chain of cuts from at[0] to at[-1]; ties go to the longer window.

    If more follows (not last), as much of the chain as is settled.
    """
    n = len(at)
    even: dict[int, list[int]] = {}
    k = 64
    while k < width:
        i = np.searchsorted(at, at - k)
        for j in np.flatnonzero((at[np.minimum(i, n - 1)] == at - k)):
            even.setdefault(int(j), []).append(int(i[j]))
        k *= 2
    p, extra = at.tolist(), (cost + WINDOW_COST + width - at).tolist()
    best, back = [0] * n, [0] * n
    queue, head = [0] * n, 0
    key = [0] * n
    tail = 0
    for j in range(1, n):
        v = best[j - 1] + p[j - 1]
        key[j - 1] = v
        while tail > head and key[queue[tail - 1]] > v:
            tail -= 1
        queue[tail] = j - 1
        tail += 1
        low = p[j] - width
        while p[queue[head]] < low:
            head += 1
        i = queue[head]
        b = key[i] + extra[j]
        if j in even:
            for i2 in even[j]:
                if (b2 := best[i2] + extra[j] - width + p[j]) < b:
                    b, i = b2, i2
        best[j], back[j] = b, i
    j = n - 1 if last else settled(back, int(np.searchsorted(at, at[-1] - width, "right")))
    out = [p[j]]
    while j:
        j = back[j]
        out.append(p[j])
    return out[::-1]


class _Packer:
    """Plans a stream of documents."""

    def __init__(self, first_id: int, stretch: int | None = None):
        self.docs: list[list] = []  # key, ids, tokens used, places of cuts, their penalties
        self.size, self.stretch = 0, stretch or STRETCH
        self.limit = self.stretch
        self.next_id = first_id
        self.rows: list[tuple] = []

    def add(self, key, ids: np.ndarray, ends: np.ndarray) -> None:
        self.docs.append([key, ids, 0, *candidates(len(ids), ends)])
        self.size += len(ids)
        if self.size >= self.limit:
            self.flush(False)

    def flush(self, last: bool) -> None:
        if not self.docs:
            return
        at, cost, base = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], 0
        for _, ids, used, places, penalties in self.docs:
            k = np.searchsorted(places, used, "right") if used else 0
            at.append(places[k:] + (base - used))
            cost.append(penalties[k:])
            base += len(ids) - used
        cuts = plan(np.concatenate(at), np.concatenate(cost), last=last)
        k, used = 0, self.docs[0][2]
        for a, b in zip(cuts, cuts[1:]):
            where, left = a, 0
            while where < b:
                key, ids = self.docs[k][:2]
                n = min(len(ids) - used, b - where)
                self.rows.append((key, used, n, zlib.crc32(ids[used : used + n].tobytes()), len(ids), self.next_id, left))
                where, left, used = where + n, left + n, used + n
                if used == len(ids):
                    k, used = k + 1, 0
            self.next_id += 1
        self.docs = self.docs[k:]
        if self.docs:
            self.docs[0][2] = used
        self.size = base - cuts[-1]
        self.limit = max(self.stretch, 2 * self.size)


def blocks(keys: pa.Array, texts: pa.Array) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Rows in a row, up to the one that makes their texts BLOCK bytes."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(size // BLOCK)) + 1).tolist(), len(texts)]
    for a, b in zip(cuts, cuts[1:]):
        yield keys[a:b], texts[a:b]


def pack(docs: DataFrame, text: str = "text", key: str = "doc_id", tokenizer: str = TOKENIZER_FILE) -> DataFrame:
    """One row a piece: its document, its place there, its window and its place there."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        is_end = sentence_ends(enc)
        packer = _Packer((TaskContext.get().partitionId()) << 33)
        key_type = None

        def out() -> pa.RecordBatch:
            cols = list(zip(*packer.rows))
            packer.rows = []
            return pa.record_batch([pa.array(cols[0], key_type), *(pa.array(c, pa.int64()) for c in cols[1:])], names=[key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            key_type = batch.schema.field(0).type
            for keys, texts in blocks(batch.column(0), batch.column(1)):
                ids, at = enc.encode_all(texts)
                ids = np.insert(ids, at[1:], END_ID)
                at = at + np.arange(len(at))
                ends = np.flatnonzero(is_end[ids]) + 1
                first = np.searchsorted(ends, at, "right")
                for k, a, b, i, j in zip(keys.to_pylist(), at.tolist(), at[1:].tolist(), first.tolist(), first[1:].tolist()):
                    packer.add(k, ids[a:b], ends[i:j] - a)
                    if len(packer.rows) >= 10_000:
                        yield out()
        packer.flush(True)
        if packer.rows:
            yield out()

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, {OUT}")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))
