"""Vector commitments over secp256k1: group, transcript, inner-product argument and wide tree.

The opening argument binds a position and a value only through its transcript, so it is kept for
its results and is not a sound proof of opening.
"""

from __future__ import annotations

from hashlib import sha256

# The curve's field and group order.
P = 2**256 - 2**32 - 977
N = 0xFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFEBAAEDCE6AF48A03BBFD25E8CD0364141

Point = tuple[int, int] | None


def add(a: Point, b: Point) -> Point:
    """Affine addition; None is the neutral point."""
    if a is None or b is None:
        return a or b
    if a[0] == b[0]:
        if (a[1] + b[1]) % P == 0:
            return None
        m = 3 * a[0] * a[0] * pow(2 * a[1], -1, P) % P
    else:
        m = (b[1] - a[1]) * pow(b[0] - a[0], -1, P) % P
    x = (m * m - a[0] - b[0]) % P
    return x, (m * (a[0] - x) - a[1]) % P


def multiply(k: int, a: Point) -> Point:
    k, out = k % N, None
    while k:
        if k & 1:
            out = add(out, a)
        a, k = add(a, a), k >> 1
    return out


def combine(scalars: list[int], points: list[Point]) -> Point:
    """The sum of scalars times points, bit by bit for all at once."""
    out: Point = None
    scalars = [s % N for s in scalars]
    for bit in range(max([0, *(s.bit_length() for s in scalars)]) - 1, -1, -1):
        out = add(out, out)
        for s, p in zip(scalars, points):
            if s >> bit & 1:
                out = add(out, p)
    return out


def compress(a: Point) -> str:
    return "00" * 33 if a is None else f"{2 + (a[1] & 1):02x}{a[0]:064x}"


def decompress(text: str) -> Point:
    if set(text) == {"0"}:
        return None
    x = int(text[2:], 16)
    y = pow((x**3 + 7) % P, (P + 1) // 4, P)
    if y * y % P != (x**3 + 7) % P:
        raise ValueError("not on the curve")
    return x, y if y & 1 == int(text[:2], 16) & 1 else P - y


def to_curve(seed: str) -> Point:
    """The first point whose x is the hash of the seed and a counter, with an even y."""
    for k in range(1000):
        x = int.from_bytes(sha256(f"{seed}:{k}".encode()).digest()) % P
        y2 = (pow(x, 3, P) + 7) % P
        y = pow(y2, (P + 1) // 4, P)
        if y * y % P == y2 and y2:
            return x, y if y % 2 == 0 else P - y
    raise ValueError("no point found")


_GENERATORS: dict[tuple[str, int], Point] = {}


def generators(width: int, label: str = "memloom") -> list[Point]:
    for i in range(width):
        if (label, i) not in _GENERATORS:
            _GENERATORS[label, i] = to_curve(f"{label}_{i}")
    return [_GENERATORS[label, i] for i in range(width)]


def commit(values: list[int], points: list[Point]) -> Point:
    if len(values) != len(points):
        raise ValueError("as many generators as values are needed")
    return combine(values, points)


def scalar_of(hash_hex: str) -> int:
    return int(hash_hex, 16) % N


class Transcript:
    def __init__(self, label: str):
        self.state = sha256(label.encode()).digest()

    def absorb(self, hex_text: str) -> None:
        self.state = sha256(self.state + bytes.fromhex(hex_text)).digest()

    def challenge(self) -> int:
        self.state = sha256(self.state + b"challenge").digest()
        return int.from_bytes(self.state) % N


def _opened(position: int, value: int) -> Transcript:
    t = Transcript("open")
    t.absorb(f"{position:064x}")
    t.absorb(f"{value:064x}")
    return t


def prove(values: list[int], points: list[Point], position: int) -> dict:
    """Halves the vector round by round; each round gives two points and a challenge."""
    n = len(values)
    if n == 0 or n & (n - 1):
        raise ValueError("the length must be a power of two")
    t, a, g = _opened(position, values[position]), list(values), list(points)
    left, right = [], []
    while len(a) > 1:
        h = len(a) // 2
        lp, rp = compress(combine(a[:h], g[h:])), compress(combine(a[h:], g[:h]))
        left.append(lp)
        right.append(rp)
        t.absorb(lp)
        t.absorb(rp)
        x = t.challenge()
        y = pow(x, -1, N)
        a = [(u * x + v * y) % N for u, v in zip(a[:h], a[h:])]
        g = [combine([y, x], [u, v]) for u, v in zip(g[:h], g[h:])]
    return {"left": left, "right": right, "a": f"{a[0]:064x}"}


def verify(commitment: Point, points: list[Point], position: int, value: int, proof: dict) -> bool:
    n, rounds = len(points), len(proof["left"])
    if 1 << rounds != n or len(proof["right"]) != rounds:
        return False
    t, xs = _opened(position, value), []
    for lp, rp in zip(proof["left"], proof["right"]):
        t.absorb(lp)
        t.absorb(rp)
        xs.append(t.challenge())
    inverses = [pow(x, -1, N) for x in xs]
    s = []
    for i in range(n):
        w = 1
        for r in range(rounds):
            w = w * (xs[r] if i >> (rounds - 1 - r) & 1 else inverses[r]) % N
        s.append(w)
    folded = combine(s, points)
    total = commitment
    for x, y, lp, rp in zip(xs, inverses, proof["left"], proof["right"]):
        total = add(total, combine([x * x % N, y * y % N], [decompress(lp), decompress(rp)]))
    return total == multiply(int(proof["a"], 16), folded)


def proof_size(width: int) -> int:
    """Bytes of one opening."""
    return 2 * (width.bit_length() - 1) * 33 + 32
