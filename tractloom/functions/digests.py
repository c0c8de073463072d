"""md5 of many short texts at once, in numpy: what rng says in SQL, for tasks that need it for whole groups."""

from __future__ import annotations

from hashlib import md5

import numpy as np

from tractloom.functions import rng

_K = np.array([int(abs(np.sin(k + 1.0)) * 2**32) for k in range(64)], np.uint32)
_TURN = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_START = [np.uint32(v) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
#: Texts worked at once, so that their words stay in the cache.
AT_ONCE = 8192


class Names:
    """Texts that are hashed again and again, each time after another beginning."""

    def __init__(self, names: list[bytes]) -> None:
        self.names, self.laid = names, (-1, np.zeros((16, 0), np.uint32))
        self.lengths = np.array([len(n) for n in names], np.int64)

    def words(self, at: int) -> np.ndarray:
        """16 words of each text's block, with the text from byte at on and the padding."""
        if self.laid[0] != at:
            n, size = len(self.names), self.lengths
            b = np.zeros((n, 64), np.uint8)
            row = np.repeat(np.arange(n), size)
            b[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + at] = np.frombuffer(b"".join(self.names), np.uint8)
            b[np.arange(n), at + size] = 0x80
            b[:, 56:] = ((at + size) * 8).astype("<u8").view(np.uint8).reshape(n, 8)
            self.laid = at, np.ascontiguousarray(b.view("<u4").T.astype(np.uint32))
        return self.laid[1]

    def after(self, start: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The digests of start + text as two numbers, whose order is that of the hexadecimal texts."""
        if len(self.names) == 0 or len(start) + int(self.lengths.max()) > 55:
            raw = b"".join([md5(start + n).digest() for n in self.names])
            high, low = np.frombuffer(raw, ">u8").reshape(-1, 2).T.astype(np.uint64)
            return high, low
        m = self.words(len(start))
        s = np.frombuffer(start.ljust(64, b"\0"), "<u4").astype(np.uint32)
        out = np.empty((4, len(self.names)), np.uint32)
        with np.errstate(over="ignore"):
            for k in range(0, out.shape[1], AT_ONCE):
                out[:, k : k + AT_ONCE] = _rounds(m[:, k : k + AT_ONCE], s)
        a, b, c, d = out.byteswap().astype(np.uint64)
        return a << np.uint64(32) | b, c << np.uint64(32) | d


def _rounds(m: np.ndarray, s: np.ndarray) -> list[np.ndarray]:
    a, b, c, d = (np.full(m.shape[1], v, np.uint32) for v in _START)
    for k in range(64):
        if k < 16:
            f, g = d ^ (b & (c ^ d)), k
        elif k < 32:
            f, g = c ^ (d & (b ^ c)), (5 * k + 1) % 16
        elif k < 48:
            f, g = b ^ c ^ d, (3 * k + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * k % 16
        f += a
        f += m[g]
        f += _K[k] + s[g]
        a, d, c, b = d, c, b, b + (f << np.uint32(_TURN[k]) | f >> np.uint32(32 - _TURN[k]))
    return [x + v for x, v in zip((a, b, c, d), _START, strict=True)]


def uniforms(seed: int | str, first: int, places: Names) -> np.ndarray:
    """rng.uniform(seed, first, place) of each place."""
    high, _ = places.after(f"{seed}:{first}:".encode())
    return (high >> np.uint64(64 - 4 * rng.DIGITS)).astype(float) / float(16**rng.DIGITS)
