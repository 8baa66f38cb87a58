"""Seeded synthetic sequences, and a reader and writer of embedding vocabularies."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: Fixed values of the linear congruential generator.
LCG_FACTOR, LCG_STEP, LCG_MODULUS = 1664525, 1013904223, 1 << 32


def lcg(seed: int) -> Iterator[float]:
    """Numbers in [0, 1)."""
    state = seed % LCG_MODULUS
    while True:
        state = (LCG_FACTOR * state + LCG_STEP) % LCG_MODULUS
        yield state / LCG_MODULUS


def random_walks(chain: dict[str, list[tuple[str, float]]], n: int, length: int, seed: int = 1) -> list[list[str]]:
    """n walks of at most length atoms over a chain of probabilities, which must sum to 1 from each atom."""
    for atom, edges in chain.items():
        if edges and abs(sum(p for _, p in edges) - 1) > 0.001:
            raise ValueError(f"probabilities from {atom} do not sum to 1")
    numbers, starts, out = lcg(seed), list(chain), []
    for _ in range(n):
        at = starts[int(next(numbers) * len(starts))]
        walk = [at]
        while len(walk) < length and chain.get(at):
            r, edges = next(numbers), chain[at]
            for nxt, p in edges:
                r -= p
                if r < 0:
                    break
            at = nxt
            walk.append(at)
        out.append(walk)
    return out


def dominant_next(chain: dict[str, list[tuple[str, float]]]) -> dict[str, str]:
    """The likeliest next atom of each, the first of equals."""
    return {a: max(e, key=lambda x: x[1])[0] for a, e in chain.items() if e}


def domain_chains(domains: dict[str, list[str]], branches: int = 2, seed: int = 1) -> dict[str, list[tuple[str, float]]]:
    """A chain over each domain's words: every word leads to the next one mostly, and to branches others of its domain."""
    numbers, out = lcg(seed), {}
    for domain, words in domains.items():
        names = [f"v1.other.{domain}_{w}" for w in words]
        for k, name in enumerate(names):
            others = [names[int(next(numbers) * len(names))] for _ in range(branches)]
            weights: dict[str, float] = {}
            for target, p in [(names[(k + 1) % len(names)], 0.7), *((o, 0.3 / branches) for o in others)]:
                weights[target] = weights.get(target, 0.0) + p
            out[name] = list(weights.items())
    return out


def shop_chain(products: int) -> dict[str, list[tuple[str, float]]]:
    """Visits of a shop: views lead to other views, carts and ends; carts to purchases or back."""
    out: dict[str, list[tuple[str, float]]] = {}
    for k in range(products):
        view, cart, bought = (f"v1.event.{verb}_product_{k}" for verb in ("view", "cart", "buy"))
        out[view] = [(f"v1.event.view_product_{(k + 1) % products}", 0.6), (cart, 0.4)]
        out[cart] = [(bought, 0.7), (view, 0.3)]
        out[bought] = []
    return out


def batches(walks: list[list[str]], size: int) -> list[list[list[str]]]:
    return [walks[k : k + size] for k in range(0, len(walks), size)]


def sequences(spark: SparkSession, walks: list[list[str]]) -> DataFrame:
    """(seq_id, pos, atom, ts_ms, seq) of sequences made on the driver."""
    rows, k = [], 0
    for s, walk in enumerate(walks):
        for pos, atom in enumerate(walk):
            rows.append((s, pos, atom, k, k))
            k += 1
    return spark.createDataFrame(rows, "seq_id long, pos int, atom string, ts_ms long, seq long")


# -- vocabularies of piece vectors -------------------------------------------------------------------
_MAGIC = b"M2VB"


def write_vocabulary(vocab: dict[str, list[float]]) -> bytes:
    """magic, version, dimensions, size; then each token's length, its bytes and its float32 vector."""
    dims = len(next(iter(vocab.values()))) if vocab else 0
    out = [_MAGIC, struct.pack("<III", 1, dims, len(vocab))]
    for token, vector in vocab.items():
        raw = token.encode()
        out += [struct.pack("<H", len(raw)), raw, np.asarray(vector, "<f4").tobytes()]
    return b"".join(out)


def read_vocabulary(data: bytes) -> tuple[int, dict[str, np.ndarray]]:
    """Dimensions and vectors, from the binary form or from JSON {dimensions, vocab}."""
    if data[:4] != _MAGIC:
        spec = json.loads(data)
        return spec["dimensions"], {t: np.asarray(v, np.float32) for t, v in spec["vocab"].items()}
    _, dims, n = struct.unpack_from("<III", data, 4)
    at, out = 16, {}
    for _ in range(n):
        (k,) = struct.unpack_from("<H", data, at)
        token = data[at + 2 : at + 2 + k].decode()
        at += 2 + k
        out[token] = np.frombuffer(data, "<f4", dims, at)
        at += 4 * dims
    return dims, out
