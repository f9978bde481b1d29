"""Vector work on code points, shared by the text operators; runs inside tasks only.

Texts of an Arrow batch are laid end to end in one array, in slices of bounded size, so that
numpy works on long arrays and memory does not depend on the batch.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

U32, U64 = np.uint32, np.uint64
#: Odd multipliers of common 64-bit mixers (public constants).
K1, K2, K3 = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
BASE = U64(0x5851F42D4C957F2D)
BASE_INV = U64(pow(0x5851F42D4C957F2D, -1, 1 << 64))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so equal inputs stay equal and others spread."""
    x = x ^ (x >> U64(30))
    x = x * K2
    x = x ^ (x >> U64(27))
    x = x * K3
    return x ^ (x >> U64(31))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), dtype=U32)


def slices(texts: Sequence[str], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about ``limit`` characters each; one longer text stands alone."""
    begin = total = 0
    for i, t in enumerate(texts):
        if i > begin and total + len(t) > limit:
            yield begin, i
            begin, total = i, 0
        total += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def lay(texts: Sequence[str], pad: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, starts, lengths): the texts' code points end to end, ``pad`` zeros after each."""
    gap = b"\0\0\0\0" * pad
    codes = np.frombuffer(b"".join(t.encode("utf-32-le", "replace") + gap for t in texts), dtype=U32)
    lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    starts = np.concatenate([[0], np.cumsum(lengths + pad)[:-1]]).astype(np.int64)
    return codes, starts, lengths


def gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all ``k`` successive codes, built by doubling: about log2(k) passes."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    power, width, done = codes.astype(U64) + U64(1), 1, 0
    out, weight = None, int(BASE)
    rest = k
    while rest:
        if rest & 1:
            part = power[done : done + n]
            out = part.copy() if out is None else out * U64(weight) + part
            done += width
        rest >>= 1
        if rest:
            power = power[:-width] * U64(weight) + power[width:]
            width *= 2
            weight = weight * weight % (1 << 64)
    return mix64(out)


class Spans:
    """Hashes of any spans of one code array in constant time each, by a polynomial's prefix sums."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        up = np.ones(n + 1, dtype=U64)
        up[1:] = BASE
        np.multiply.accumulate(up, out=up)
        self.sums = np.zeros(n + 1, dtype=U64)
        np.cumsum(mix64(codes.astype(U64) + K1) * up[:n], out=self.sums[1:])
        down = np.ones(n + 1, dtype=U64)
        down[1:] = BASE_INV
        np.multiply.accumulate(down, out=down)
        self.down = down

    def hash(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[begin]) * self.down[begin]
        return mix64(h + (end - begin).astype(U64) * K1)
