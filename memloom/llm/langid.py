"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the UTF-8 bytes of the lower-cased text in windows of SPAN bytes, once forwards
and once backwards. Its cell has one gate: with x a byte and h the state,

    z = sigmoid(Wz[x] + Uz h),  c = tanh(Wc[x] + Uc h),  h' = h + z (c - h)

Both states give a distribution over languages at every position, and a document's probability is
the mean over all positions of all its windows. It is trained here, in numpy, by backpropagation
through time with the position-wise cross-entropy, on the whole texts of at most SAMPLE documents a
language (fewer if there are more than ROWS / SAMPLE languages), chosen by a hash of the id; the
training set is everything that is not held out and has a language. Whole texts are predicted, every
byte, without moving them.

A letter is a character of Unicode's class L, in training and prediction alike. Defined cases: a null
text, or one without a letter, is ``und`` with score 0; so is everything if no row has a language;
every language of the training set is learned; a null id is neither held out nor learned from; equal
texts get equal predictions; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

SPAN, HIDDEN, SAMPLE, ROWS, TRAIN_SPAN = 256, 16, 200, 12_800, 96
EPOCHS, BATCH, RATE, SEED = 2, 96, 0.02, 11
#: Windows that go through the network at once with up to WIDE_LANGUAGES languages; with more, fewer.
WIDE, WIDE_LANGUAGES = 2048, 64
UNKNOWN = "und"


class ByteNetwork:
    """Weights of both directions and the readout. The gate's weights are halved: sigmoid(a) = (1 + tanh(a / 2)) / 2."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.languages, self.hidden = languages, hidden
        k = len(languages)
        self.w = {}
        for d in "fb":
            self.w[f"x{d}"] = rng.normal(0, 0.3, (257, 2 * hidden)).astype(np.float32)  # byte 256 pads
            self.w[f"u{d}"] = rng.normal(0, 0.5 / np.sqrt(hidden), (hidden, 2 * hidden)).astype(np.float32)
            self.w[f"v{d}"] = rng.normal(0, 0.3, (hidden, k)).astype(np.float32)
        self.w["bias"] = np.zeros(k, np.float32)

    # -- one direction over windows x of shape (time, windows) --------------------------------
    def _states(self, x: np.ndarray, d: str) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each time, in reading order: (time, state before, gate and candidate, state after)."""
        table, u, n = self.w[f"x{d}"], self.w[f"u{d}"], self.hidden
        h = np.zeros((x.shape[1], n), np.float32)
        times = range(len(x)) if d == "f" else range(len(x) - 1, -1, -1)
        for t in times:
            a = h @ u
            a += table[x[t]]
            np.tanh(a, out=a)
            z = a[:, :n]
            z *= 0.5
            z += 0.5
            new = a[:, n:] - h
            new *= z
            new += h
            yield t, h, a, new
            h = new

    def pooled(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Sums over the positions of each window of the distributions there: (windows, languages)."""
        k = len(self.languages)
        logits = np.empty((len(x), x.shape[1], k), np.float32)
        for t, _, _, h in self._states(x, "f"):
            np.matmul(h, self.w["vf"], out=logits[t])
        out = np.zeros((x.shape[1], k), np.float32)
        for t, _, _, h in self._states(x, "b"):
            p = logits[t]
            p += h @ self.w["vb"]
            p += self.w["bias"]
            p -= p.max(axis=1, keepdims=True)
            np.exp(p, out=p)
            p *= ((t < lengths) / p.sum(axis=1))[:, None].astype(np.float32)
            out += p
        return out

    def gradients(self, x: np.ndarray, y: np.ndarray, lengths: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and its gradients, by backpropagation through time in both directions."""
        n, (time, wide) = self.hidden, x.shape
        kept = {d: list(self._states(x, d)) for d in "fb"}
        state = {d: {t: h for t, _, _, h in kept[d]} for d in "fb"}
        g = {name: np.zeros_like(w) for name, w in self.w.items()}
        hf = np.stack([state["f"][t] for t in range(time)])
        hb = np.stack([state["b"][t] for t in range(time)])
        p = hf @ self.w["vf"] + hb @ self.w["vb"] + self.w["bias"]
        p = np.exp(p - p.max(axis=2, keepdims=True))
        p /= p.sum(axis=2, keepdims=True)
        mask = (np.arange(time)[:, None] < lengths[None, :]).astype(np.float32)
        mask /= mask.sum()
        loss = float(-(np.log(p[:, np.arange(wide), y] + 1e-9) * mask).sum())
        p[:, np.arange(wide), y] -= 1
        p *= mask[:, :, None]
        g["bias"] += p.sum(axis=(0, 1))
        for d, h in (("f", hf), ("b", hb)):
            g[f"v{d}"] += np.tensordot(h, p, axes=((0, 1), (0, 1)))
            from_above = p @ self.w[f"v{d}"].T
            carried = np.zeros((wide, n), np.float32)
            for t, before, a, _ in reversed(kept[d]):
                dh = from_above[t] + carried
                z, c = a[:, :n], a[:, n:]
                # d tanh for both halves; the gate is (1 + tanh) / 2, so its slope in a is 2 z (1 - z)
                da = np.concatenate([dh * (c - before) * 2 * z * (1 - z), dh * z * (1 - c * c)], axis=1)
                np.add.at(g[f"x{d}"], x[t], da)
                g[f"u{d}"] += before.T @ da
                carried = dh * (1 - z) + da @ self.w[f"u{d}"].T
        return loss, g

    def fit(self, x: np.ndarray, y: np.ndarray, lengths: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> list[float]:
        """Adam over shuffled batches; the losses of the epochs."""
        rng, step, losses = np.random.default_rng(seed), 0, []
        m = {k: np.zeros_like(w) for k, w in self.w.items()}
        v = {k: np.zeros_like(w) for k, w in self.w.items()}
        total = epochs * -(-len(y) // BATCH)
        for _ in range(epochs):
            order, sums = rng.permutation(len(y)), []
            for k in range(0, len(y), BATCH):
                at = order[k : k + BATCH]
                loss, g = self.gradients(x[:, at], y[at], lengths[at])
                sums.append(loss)
                step += 1
                norm = np.sqrt(sum(float((q * q).sum()) for q in g.values()))
                rate = RATE * (1 - 0.95 * step / total)
                for name, w in self.w.items():
                    q = g[name] * min(1.0, 1.0 / (norm + 1e-9))
                    m[name] += 0.1 * (q - m[name])
                    v[name] += 0.01 * (q * q - v[name])
                    w -= rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-6)
            losses.append(float(np.mean(sums)))
        return losses


def raw_bytes(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass")


def windows(texts: list[bytes], span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of all texts: bytes (span, windows) padded by 256, lengths, and each window's text."""
    counts = [-(-len(t) // span) for t in texts]
    x = np.full((sum(counts), span), 256, np.int16)
    lengths, of, at = np.zeros(len(x), np.int64), np.repeat(np.arange(len(texts)), counts), 0
    for t, n in zip(texts, counts):
        if n:
            x[at : at + n].reshape(-1)[: len(t)] = np.frombuffer(t, np.uint8)
            lengths[at : at + n] = span
            lengths[at + n - 1] = len(t) - (n - 1) * span
        at += n
    return x, lengths, of


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def has_letter(text: Column) -> Column:
    return text.rlike(r"\p{L}")


def train(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> ByteNetwork | None:
    """A network fitted on a bounded sample of the rows that are not held out."""
    rows = docs.filter(F.col(key).isNotNull() & F.col(lang).isNotNull() & has_letter(F.col(text))).filter(~held_out(F.col(key)))
    counts = {r[0]: r["n"] for r in rows.groupBy(lang).agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    languages = sorted(counts)
    most = max(1, min(SAMPLE, ROWS // len(languages)))
    every = {x: max(1, n // (most * 3 // 2 + 1)) for x, n in counts.items()}
    pick = F.xxhash64(F.col(key).cast("string"), F.lit("sample"))
    step = F.element_at(F.create_map(*[F.lit(x) for pair in every.items() for x in pair]), F.col(lang))
    chosen = rows.filter(F.pmod(pick, step) == 0).select(F.col(lang).alias("lang"), pick.alias("pick"), F.col(text).alias("text"))
    texts, y, seen = [], [], dict.fromkeys(languages, 0)
    for r in chosen.orderBy("pick", "text").toLocalIterator():
        if seen[r["lang"]] < most:
            seen[r["lang"]] += 1
            texts.append(raw_bytes(r["text"]))
            y.append(languages.index(r["lang"]))
    net = ByteNetwork(languages)
    x, lengths, of = windows(texts, TRAIN_SPAN)
    net.fit(np.ascontiguousarray(x.T), np.array(y)[of], lengths)
    return net


def predict(texts: list[str | None], net: ByteNetwork | None) -> list[tuple[str, float]]:
    """The language and its probability of each text that has a letter; null stands for those without."""
    out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
    at = [k for k, t in enumerate(texts) if net and t]
    if not at:
        return out
    x, lengths, of = windows([raw_bytes(texts[k]) for k in at], SPAN)
    sums, sizes = np.zeros((len(at), len(net.languages))), np.zeros(len(at))
    wide = max(1, WIDE * WIDE_LANGUAGES // max(WIDE_LANGUAGES, len(net.languages)))
    for k in range(0, len(x), wide):
        part = net.pooled(np.ascontiguousarray(x[k : k + wide].T), lengths[k : k + wide])
        np.add.at(sums, of[k : k + wide], part)
    np.add.at(sizes, of, lengths)
    p = sums / sizes[:, None]
    for k, row in zip(at, p):
        best = int(row.argmax())
        out[k] = net.languages[best], float(min(1.0, row[best]))
    return out


def identify(docs: DataFrame, net: ByteNetwork | None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, lang_pred, score) of every row."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, got, start, size = batch.column(1), [], 0, 0
            for k, t in enumerate(texts, 1):  # about 2 MB at once, so windows are many and memory is bounded
                size += len(t.as_py() or "")
                if size >= 1 << 21 or k == len(texts):
                    got += predict([x.as_py() for x in texts[start:k]], net)
                    start, size = k, 0
            yield pa.record_batch([batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=[key, "lang_pred", "score"])

    return docs.select(key, F.when(has_letter(F.col(text)), F.col(text))).mapInArrow(run, f"`{key}` {kind}, lang_pred string, score double")


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = identify(docs, train(docs.select("doc_id", "text", "lang")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
