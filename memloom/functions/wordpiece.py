"""Greedy longest-match word pieces and mean piece vectors, in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

_WORD = re.compile(r"[a-z0-9]+")


def word_pieces(word: str, vocab) -> list[str]:
    """Longest match first; pieces inside a word carry ##; characters that no piece has are skipped."""
    out, at = [], 0
    while at < len(word):
        for end in range(len(word), at, -1):
            piece = ("##" if at else "") + word[at:end]
            if piece in vocab:
                out.append(piece)
                at = end
                break
        else:
            at += 1
    return out


def embed(text: str | None, vocab: dict[str, np.ndarray], dims: int) -> np.ndarray:
    """The unit-length mean of a text's piece vectors; zeros where there is none."""
    rows = [vocab[p] for w in _WORD.findall((text or "").lower()) for p in word_pieces(w, vocab)]
    if not rows:
        return np.zeros(dims, np.float32)
    mean = np.mean(np.asarray(rows, np.float64), axis=0)
    norm = float(np.linalg.norm(mean))
    return (mean / norm if norm else mean).astype(np.float32)


def embed_documents(docs: DataFrame, key: str, text: str, vocab: dict[str, np.ndarray], dims: int) -> DataFrame:
    """(key, embedding). The vocabulary goes to executors with the function: it must fit a worker, as a model does."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key], "embedding": [embed(t, vocab, dims).tolist() for t in b[text]]})

    return docs.select(key, text).mapInPandas(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, embedding array<float>")
