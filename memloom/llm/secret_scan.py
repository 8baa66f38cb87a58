"""Secret scanning with structural confirmation.

Patterns name candidates; before one of the method's own kinds is reported, its bytes are decoded
and parsed: base64 or hex runs must hold a key in DER (nested lengths that fill their parents
exactly, a version number or an algorithm's identifier first) or in the OpenSSH container (its
magic and its length-prefixed fields), and signed tokens must have a JSON header with an algorithm
and a JSON payload. A key in base64 may stand behind other characters of that alphabet, as in a path,
and may run over lines: it begins wherever a container can begin, and its own outer length says where
it ends. The three base kinds are reported as their patterns and lengths say.

A PEM block is a BEGIN line and the next line of its kind, if that is the END of the same label. Every
pattern passes over the text once, and a container is decoded as far as its length says, MOST_KEY
bytes at most (longer keys than the largest in use), so the time is linear in the text.

Defined cases: a null text counts as empty; an empty text has no spans; equal rows give equal
results; a very long text is scanned whole; other columns are not read. Places are in code points,
the end exclusive.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import read_table

#: Kinds in the order in which spans of one start are listed; the first three are the base.
KINDS = ("assign", "access", "hex", "pem_key", "der_key", "hex_key", "jwt")
_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""")
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_PEM = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]{1,40})-----")
_NOT_PEM = re.compile(r"[^A-Za-z0-9+/=\s:,-]")
#: What follows the end of a line in base64 that runs over lines, and the first characters of a DER sequence and of the OpenSSH magic.
_NEXT_LINE = re.compile(r"[ \t]*\r?\n[ \t]*([A-Za-z0-9+/_-]{4,}+)")
_KEY_START = re.compile(r"M[A-P]|b3BlbnNzaC1rZXkt")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]{5,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)")
_HEX_CHARS, _ANY_HEX_CHARS = b"0123456789abcdef", b"0123456789abcdefABCDEF"
_B64_CHARS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
_IS_HEX = np.isin(np.arange(256), list(_HEX_CHARS))
_IS_ANY_HEX = np.isin(np.arange(256), list(_ANY_HEX_CHARS))
_IS_B64 = np.isin(np.arange(256), list(_B64_CHARS))
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST, B64_LEAST, HEX_KEY_LEAST = 12, 18, 16, 40, 64
MOST_KEY = 1 << 15


def runs(member: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Maximal runs of true values of length least or more."""
    n, step = len(member), max(1, least // 2)  # such a run holds a whole aligned block
    if n < least or not member[: n // step * step].reshape(-1, step).all(axis=1).any():
        return []
    edge = np.flatnonzero(np.diff(member, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    long = ends - starts >= least
    return list(zip(starts[long].tolist(), ends[long].tolist()))


def _der(b: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, first, last) of the DER item at a place; None if its lengths don't fit."""
    if at + 2 > end:
        return None
    tag, n, at = b[at], b[at + 1], at + 2
    if n >= 128:
        k = n - 128
        if not 1 <= k <= 4 or at + k > end:
            return None
        n, at = int.from_bytes(b[at : at + k]), at + k
    return (tag, at, at + n) if at + n <= end else None


def _children(b: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The items that fill b[at:end] exactly."""
    out = []
    while at < end:
        item = _der(b, at, end)
        if item is None:
            return None
        out.append(item)
        at = item[2]
    return out


def is_der_key(b: bytes) -> bool:
    """Whether b is a DER key: PKCS #1, DSA, PKCS #8 (plain or encrypted), SEC 1 or a public key, by structure."""
    top = _der(b, 0, len(b))
    if top is None or top[0] != 0x30 or top[2] != len(b):
        return False
    items = _children(b, top[1], top[2])
    if not items or len(items) < 2:
        return False
    tags = [t for t, _, _ in items]

    def algorithm(k: int) -> bool:
        inner = _children(b, items[k][1], items[k][2])
        return bool(inner) and inner[0][0] == 0x06

    if tags[0] == 0x02:
        version = items[0][2] - items[0][1] == 1
        if len(items) >= 9 and set(tags[:9]) == {0x02}:
            return version  # PKCS #1
        if tags == [0x02] * 6:
            return version and b[items[0][1]] == 0  # DSA: version 0, p, q, g, y, x
        if version and tags[1] == 0x30 and len(items) >= 3 and tags[2] == 0x04:
            return algorithm(1)  # PKCS #8
        return version and tags[1] == 0x04 and items[1][2] - items[1][1] in (28, 32, 48, 66)  # SEC 1
    return tags in ([0x30, 0x03], [0x30, 0x04]) and algorithm(0)  # a public key, or PKCS #8 encrypted


_MAGIC = b"openssh-key-v1\x00"


def _openssh_end(b: bytes) -> int | None:
    """Where the container that b begins with ends, by its magic and nested lengths: options, public and private keys."""
    at = len(_MAGIC)
    if not b.startswith(_MAGIC):
        return None
    for k in range(3):  # cipher, derivation, options
        if at + 4 > len(b):
            return None
        at += 4 + int.from_bytes(b[at : at + 4])
    n = int.from_bytes(b[at : at + 4])
    if at + 4 > len(b) or not 1 <= n <= 64:
        return None
    at += 4
    for _ in range(n + 1):
        if at + 4 > len(b):
            return None
        at += 4 + int.from_bytes(b[at : at + 4])
    return at if at <= len(b) else None


def is_openssh_key(b: bytes) -> bool:
    """Whether b begins with an OpenSSH private key container."""
    return _openssh_end(b) is not None


def _unbase64(s: str) -> bytes | None:
    s = s.rstrip("=").replace("-", "+").replace("_", "/")
    if len(s) % 4 == 1:
        return None
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _json_object(part: str) -> dict | None:
    raw = _unbase64(part)
    try:
        value = json.loads(raw) if raw else None
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def is_signed_token(header: str, payload: str) -> bool:
    found = _json_object(header)
    return bool(found) and isinstance(found.get("alg"), str) and _json_object(payload) is not None


def pem_blocks(text: str) -> list[tuple[int, int]]:
    """Places of the blocks between a BEGIN line and the END of its label right after it that hold a key."""
    out, last = [], None
    for m in _PEM.finditer(text):
        if m[1] == "END" and last and last[2] == m[2]:
            body = text[last.end() : m.start()]
            if len(body) >= 16 and not _NOT_PEM.search(body):
                raw = _unbase64("".join(x for x in body.split() if ":" not in x and "," not in x))
                if raw and _is_key(raw):
                    out.append((last.start(), m.end()))
        last = m if m[1] == "BEGIN" else None
    return out


def base64_keys(text: str, long: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Places of the keys that begin in the long runs of base64; lines that follow a run belong to it."""
    out, done = [], 0
    for start, end in long:
        if start < done:
            continue
        lines = [(start, end)]
        while m := _NEXT_LINE.match(text, lines[-1][1]):
            lines.append(m.span(1))
        done = lines[-1][1]
        s = "".join(text[a:b] for a, b in lines).replace("-", "+").replace("_", "/")
        ends = np.cumsum([b - a for a, b in lines])

        def place(k: int, lines=lines, ends=ends) -> int:
            """Of the character k of s in the text."""
            line = int(np.searchsorted(ends, k, "right"))
            return lines[line][1] - int(ends[line]) + k

        at = 0
        while m := _KEY_START.search(s, at):
            n = _key_chars(s, m.start())
            if n:
                out.append((place(m.start()), place(m.start() + n - 1) + 1))
            at = m.start() + (n or 1)
    return out


def _key_chars(s: str, at: int) -> int:
    """Characters of the base64 key that s holds at a place; 0 if it holds none there."""
    if s[at] == "b":
        part = s[at : at + MOST_KEY * 4 // 3]
        raw = base64.b64decode(part[: len(part) // 4 * 4]) + _tail(part)
        size = _openssh_end(raw)
        return -(-size * 8 // 6) if size else 0
    head = base64.b64decode(s[at : at + 8]) if at + 8 <= len(s) else b""
    if len(head) < 6 or head[1] == 0x80 or head[1] > 0x84:
        return 0
    size = 2 + head[1] if head[1] < 0x80 else 2 + (head[1] - 128) + int.from_bytes(head[2 : 2 + head[1] - 128])
    n = -(-size * 8 // 6)
    if not B64_LEAST * 6 // 8 <= size <= MOST_KEY or at + n > len(s):
        return 0
    first = head[2 + max(0, head[1] - 128)] if 2 + max(0, head[1] - 128) < len(head) else None
    if first not in (None, 0x02, 0x30):  # a version or an algorithm comes first
        return 0
    raw = _unbase64(s[at : at + n])
    return n if raw and is_der_key(raw) else 0


def _tail(part: str) -> bytes:
    """The whole bytes of what a multiple of four characters leaves over."""
    left = part[len(part) // 4 * 4 :]
    return base64.b64decode(left + "=" * (4 - len(left))) if len(left) > 1 else b""


def scan(text: str | None) -> list[tuple[int, int, int]]:
    """(kind's number, start, end), by start and then kind."""
    text = text or ""
    out: list[tuple[int, int, int]] = []
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        out += [(0, m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(1, m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    chars = np.frombuffer(text.encode("latin-1", "replace"), np.uint8)  # one byte a code point
    for a, b in runs(_IS_HEX[chars], HEX_LEAST):
        out.append((2, a, b))
    found = {(a, b) for member in (_IS_HEX, _IS_ANY_HEX) for a, b in runs(member[chars], HEX_KEY_LEAST)}
    out += [(5, a, b) for a, b in found if (b - a) % 2 == 0 and _is_key(bytes.fromhex(text[a:b]))]
    blocks = pem_blocks(text) if "-----BEGIN " in text else []
    out += [(3, a, b) for a, b in blocks]
    if long := runs(_IS_B64[chars], B64_LEAST):
        begins = [a for a, _ in blocks]
        for a, b in base64_keys(text, long):
            k = bisect_right(begins, a) - 1
            if k < 0 or a >= blocks[k][1]:  # a block's own key is reported with it
                out.append((4, a, b))
    if "eyJ" in text:
        out += [(6, m.start(), m.end()) for m in _JWT.finditer(text) if is_signed_token(m[1], m[2])]
    return sorted(out, key=lambda x: (x[1], x[0], x[2]))


def _is_key(raw: bytes) -> bool:
    return is_der_key(raw) or is_openssh_key(raw)


def scan_secrets(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, spans): each secret's kind, place, text and whether a structure confirms it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string()), ("confirmed", pa.bool_())]))
        for batch in batches:
            rows = []
            for t in batch.column(1):
                t = t.as_py()
                rows.append([{"kind": KINDS[k], "start": a, "end": b, "text": t[a:b], "confirmed": k > 2} for k, a, b in scan(t)])
            yield pa.record_batch([batch.column(0), pa.array(rows, kind)], names=[key, "spans"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, spans array<struct<kind:string,start:bigint,end:bigint,text:string,confirmed:boolean>>")


def secret_digests(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the digest of their places, and all places, a row a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column(1):
                found = scan(t.as_py())
                shown = [f"{KINDS[k]}:{a}:{b}" for k, a, b in found]
                base = ",".join(s for s, x in zip(shown, found) if x[0] < 3)
                rows.append((*(sum(x[0] == k for x in found) for k in range(3)), hashlib.sha256(base.encode()).hexdigest(), ",".join(shown)))
            cols = list(zip(*rows)) or [()] * 5
            yield pa.record_batch([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.string()) for c in cols[3:])], names=[key, "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digests(read_table(spark, sf_dir, "documents"))
