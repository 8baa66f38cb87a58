"""Byte-pair encoding and decoding by forced boundaries.

A byte pair that occurs inside no token of the vocabulary can never be merged across, so every
such place in a text is a certain cut: the fragments between cuts are encoded independently and
their ids concatenated. White space occurs in no token, so it always cuts; inside a word the cuts
come from the table of pairs. Fragments repeat a great deal, so each worker keeps bounded
memories of what it has encoded; they change the speed only. Where only ids are wanted
(:meth:`ForcedBoundaryBpe.encode_all`), the words of many texts are cut, told apart and put back
as arrays, and the merge engine sees each different piece of them once.

Defined cases: a null text counts as empty and gives no ids; strings such as ``<|endoftext|>`` in
a text give the ids of the special tokens, as the library does; rows with equal texts give equal
results; columns of the input other than those named are not read.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .common import TOKENIZER_FILE, read_table, tokenizer_path

#: Python's str.split() also cuts at these, which the tokenizer's white space does not include.
_ONLY_PYTHON_SPACE = ("\x1c", "\x1d", "\x1e", "\x1f")
#: Below this code point normalisation only lowers the case, but for U+0130.
_PLAIN = "ɐ"
#: Classes of bytes in lower-case words: symbols, letters (all of U+00C0 to U+01FF but two), digits.
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[ord("a") : ord("z") + 1] = _CLASS[0x80:] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
#: Bytes of words that are left to the patterns: controls, apostrophes, and what begins other code points.
_RARE = np.zeros(256, dtype=bool)
_RARE[:0x20] = _RARE[0x7F] = _RARE[ord("'")] = _RARE[0xC2] = _RARE[0xC8:] = True
#: And pairs of bytes: the two symbols among those letters, the letter that grows, what begins a special token.
_RARE_PAIRS = ("×".encode(), "÷".encode(), "İ".encode(), b"<|")
#: Words of more bytes are left to the patterns too, which cut them before they are merged.
_LONG = 4096
#: Pieces given to the merge engine at a time.
_AT_ONCE = 1000


def _strings(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of strings, and where each begins."""
    array = array.cast(pa.large_binary())
    _, at, data = array.buffers()
    at = np.frombuffer(at, np.int64)[array.offset : array.offset + len(array) + 1] if len(array) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8)[at[0] : at[-1]] if at[-1] else np.zeros(0, np.uint8)), at - at[0]


def _lists(at: np.ndarray, ids: np.ndarray | pa.Array) -> pa.LargeListArray:
    return pa.LargeListArray.from_arrays(pa.array(at, pa.int64()), pa.array(ids, pa.uint32()))


class _Memory(dict):
    """A bounded memo: two generations, so that the latest ``size`` entries are always kept."""

    __slots__ = ("old", "make", "size")

    def __init__(self, make, size: int):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def _byte_chars() -> list[str]:
    """The printable stand-in of each byte that byte-level vocabularies use."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, more = [""] * 256, 256
    for b in range(256):
        if b in shown:
            out[b] = chr(b)
        else:
            out[b], more = chr(more), more + 1
    return out


class ForcedBoundaryBpe:
    """Encoder and decoder of one vocabulary file with an end-of-word suffix."""

    def __init__(self, path: str, memory: int = 450_000):
        import regex
        from tokenizers import Tokenizer
        from tokenizers.models import BPE
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.lib = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_of = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.specials.items()}
        chars = _byte_chars()
        self.byte_of = byte_of = {c: b for b, c in enumerate(chars)}
        self.translate = {b: c for b, c in enumerate(chars)}
        # one merge engine for fragments that end a pre-token, one for those that do not
        self.ending = self.lib.model
        self.within = BPE(vocab=self.vocab, merges=[tuple(m) for m in model["merges"]])
        # the first engine for pieces in a row: each ends with the one token of its that has the suffix
        self.row = Tokenizer(self.ending)
        self.row.pre_tokenizer = WhitespaceSplit()
        self.ends_piece = np.zeros(max(self.token_of) + 1, dtype=bool)
        self.ends_piece[[i for t, i in self.vocab.items() if t.endswith(self.suffix)]] = True
        self.code_points = np.array([ord(c) for c in chars], dtype="<u4")
        self.code_points[ord(" ")] = ord(" ")
        inside = np.zeros((256, 256), dtype=bool)
        for token in self.vocab:
            raw = [byte_of[c] for c in token.removesuffix(self.suffix)]
            for a, b in zip(raw, raw[1:]):
                inside[a, b] = True
        self.inside = inside
        self.forced = frozenset(zip(*(x.tolist() for x in np.nonzero(~inside))))
        self.words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
        self.special_split = regex.compile("(" + "|".join(regex.escape(s) for s in self.specials) + ")")
        self.piece_memory = _Memory(self._encode_piece, memory)
        self.chunk_memory = _Memory(self._encode_chunk, memory)

    # -- pieces --------------------------------------------------------------------------------
    def fragments(self, raw: bytes) -> list[bytes]:
        """raw cut at every byte pair that occurs inside no token."""
        forced, out, start = self.forced, [], 0
        for k, pair in enumerate(zip(raw, raw[1:]), 1):
            if pair in forced:
                out.append(raw[start:k])
                start = k
        out.append(raw[start:])
        return out

    def _encode_piece(self, piece: str):
        """One pre-token; only its last fragment carries the end of the word."""
        parts = self.fragments(piece.encode())
        out: list[int] = []
        for part in parts[:-1]:
            out += [t.id for t in self.within.tokenize(part.decode("latin-1").translate(self.translate))]
        out += [t.id for t in self.ending.tokenize(parts[-1].decode("latin-1").translate(self.translate))]
        return self._value(out)

    # -- chunks: what stands between white space -------------------------------------------------
    def _pieces(self, chunk: str) -> list[str]:
        if chunk.isascii() or max(chunk) < _PLAIN and "İ" not in chunk:
            return self.words.findall(chunk.lower())
        found = self.lib.pre_tokenizer.pre_tokenize_str(self.lib.normalizer.normalize_str(chunk))
        return [bytes(self.byte_of[c] for c in w).decode() for w, _ in found]

    def _encode_chunk(self, chunk: str):
        memory = self.piece_memory
        if "<|" in chunk:
            values = []
            for part in self.special_split.split(chunk):
                if part in self.specials:
                    values.append(self._value([self.specials[part]]))
                elif part:
                    values += [memory[w] for w in self._pieces(part)]
            return self._join(values)
        pieces = self._pieces(chunk)
        return memory[pieces[0]] if len(pieces) == 1 else self._join([memory[w] for w in pieces])

    # what is remembered of a piece or chunk: here its ids, as bytes
    def _value(self, ids: list[int]):
        return array("I", ids).tobytes()

    def _join(self, values: list):
        return b"".join(values)

    def chunks(self, text: str) -> list[str]:
        """text cut at white space, so that no piece, merge or composition crosses a cut."""
        if any(c in text for c in _ONLY_PYTHON_SPACE):
            return [c for part in text.split(" ") for c in part.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") if c]
        return text.split()

    def encode(self, text: str | None) -> np.ndarray:
        """All ids of text as unsigned 32-bit integers."""
        return np.frombuffer(b"".join(map(self.chunk_memory.__getitem__, self.chunks(text or ""))), dtype="<u4")

    # -- many texts ------------------------------------------------------------------------------
    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts in a row, and where those of each begin; the last is their number."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        words = split.flatten().dictionary_encode()
        found = self._encode_words(words.dictionary).take(words.indices)
        at = found.offsets.to_numpy()[split.offsets.to_numpy()]
        return found.flatten().to_numpy().astype("<u4", copy=False), at

    def _encode_words(self, words: pa.Array) -> pa.LargeListArray:
        """The ids of each word."""
        raw, at = _strings(words)
        rare = _RARE[raw]
        for a, b in _RARE_PAIRS:
            rare[:-1] |= (raw[:-1] == a) & (raw[1:] == b)
        rare = (np.diff(np.concatenate([[0], np.cumsum(rare)])[at]) > 0) | (np.diff(at) > _LONG)
        ids = self._encode_plain(words.filter(pa.array(~rare)))
        if not rare.any():
            return ids
        other = [np.frombuffer(self.chunk_memory[w], "<u4") for w in words.filter(pa.array(rare)).to_pylist()]
        other = _lists(np.cumsum([0, *map(len, other)]), np.concatenate(other))
        place = np.where(rare, len(ids) + np.cumsum(rare) - 1, np.cumsum(~rare) - 1)
        return pa.concat_arrays([ids, other]).take(pa.array(place))

    def _encode_plain(self, words: pa.Array) -> pa.LargeListArray:
        """The same of words without rare bytes: a piece is a run of letters or of symbols, or a digit."""
        raw, at = _strings(words)
        raw = np.frombuffer(raw.tobytes().decode().lower().encode(), np.uint8)
        kind = _CLASS[raw]
        first = kind == 2
        first[1:] |= kind[1:] != kind[:-1]
        first[at[:-1][at[:-1] < len(raw)]] = True
        starts = np.flatnonzero(first)
        bounds = pa.py_buffer(np.append(starts, len(raw)).astype(np.int64))
        pieces = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, bounds, pa.py_buffer(raw)]).dictionary_encode()
        ids = self._encode_pieces(pieces.dictionary).take(pieces.indices)
        return _lists(ids.offsets.to_numpy()[np.searchsorted(starts, at)], ids.flatten())

    def _encode_pieces(self, pieces: pa.Array) -> pa.LargeListArray:
        """The ids of each pre-token, given in lower case and without white space."""
        rows = pa.LargeListArray.from_arrays(pa.array([*range(0, len(pieces), _AT_ONCE), len(pieces)], pa.int64()), pieces)
        ids: list[int] = []
        for row in pc.binary_join(rows, pa.scalar(b" ", pieces.type)).to_pylist():
            shown = self.code_points[np.frombuffer(row, np.uint8)].tobytes().decode("utf-32-le")
            ids += self.row.encode(shown, add_special_tokens=False).ids
        out = np.array(ids, dtype=np.uint32)
        ends = np.flatnonzero(self.ends_piece[out]) + 1
        if len(ends) != len(pieces):
            raise ValueError("the vocabulary lacks single bytes, so pieces do not end with a suffix")
        return _lists(np.concatenate([[0], ends]), out)

    def decode(self, ids) -> str:
        """As the library's decode(): this vocabulary has no decoder, so tokens are joined by a space."""
        return " ".join(self.token_of[int(i)] for i in ids)


_ENCODERS: dict[tuple[str, type], object] = {}


def encoder(file: str = TOKENIZER_FILE, kind: type = ForcedBoundaryBpe):
    """The encoder of this worker; it is built once and keeps its memory."""
    if (file, kind) not in _ENCODERS:
        _ENCODERS[file, kind] = kind(tokenizer_path(file))
    return _ENCODERS[file, kind]


class _Digesting(ForcedBoundaryBpe):
    """Keeps a chunk's ids and tokens as text, for digests."""

    def _value(self, ids: list[int]):
        return " ".join(map(str, ids)), self.decode(ids)

    def _join(self, values: list):
        return " ".join([x[0] for x in values]), " ".join([x[1] for x in values])

    def digest(self, text: str | None) -> tuple[int, str, str]:
        found = [x for x in map(self.chunk_memory.__getitem__, self.chunks(text or "")) if x[0]]
        if not found:
            empty = hashlib.sha256(b"").hexdigest()
            return 0, empty, empty
        ids = " ".join([x[0] for x in found])
        tokens = " ".join([x[1] for x in found])
        return ids.count(" ") + 1, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(tokens.encode()).hexdigest()


def encode_documents(docs: DataFrame, text: str = "text", key: str = "doc_id", tokenizer: str = TOKENIZER_FILE) -> DataFrame:
    """(key, ids array<long>, decoded string): the operator itself, one row a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for at in range(0, batch.num_rows, 64):
                ids = [enc.encode(t.as_py()) for t in texts[at : at + 64]]
                yield pa.record_batch([keys[at : at + 64], pa.array([x.astype("i8") for x in ids], pa.list_(pa.int64())), pa.array([enc.decode(x) for x in ids], pa.string())], names=[key, "ids", "decoded"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<bigint>, decoded string")


def token_digests(docs: DataFrame, text: str = "text", key: str = "doc_id", tokenizer: str = TOKENIZER_FILE) -> DataFrame:
    """Count and digests of each document's ids and decoded text, without moving the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, _Digesting)
        for batch in batches:
            rows = [enc.digest(t.as_py()) for t in batch.column(1)]
            n, ids, decoded = zip(*rows) if rows else ((), (), ())
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(read_table(spark, sf_dir, "documents"))
