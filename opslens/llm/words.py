"""Words of whole texts as 64-bit numbers, many documents at a time.

A word is a maximal run of bytes other than space and 0x09-0x0D, which on UTF-8 is the same as the
pattern ``[^\\x20\\x09-\\x0D]+``.  Hashes are polynomials modulo 2**64 over fixed random byte codes with a
final mixing step; prefix sums give all words of a batch without a loop over them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_SPAN = 1 << 18
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_NO_LETTER = np.ones(256, bool)
_NO_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CODES = np.random.Generator(np.random.PCG64(20240607)).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def _powers(size: int, held: dict = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    if size in held:
        return held[size]
    up, down = np.full(size, _BASE, U64), np.full(size, pow(_BASE, -1, 2**64), U64)
    up[0] = down[0] = 1
    made = np.cumprod(up), np.cumprod(down)
    if size == _SPAN + 1:
        held[size] = made
    return made


@dataclass
class Words:
    """Words of a batch: ``codes`` of all words in order; document d owns first[d]:first[d + 1]."""

    codes: np.ndarray
    first: np.ndarray
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    def windows(self, k: int, seed: int = 0) -> np.ndarray:
        """Codes of k consecutive words by start position; see ``whole`` for those inside one document."""
        n = len(self.codes) - k + 1
        if n <= 0:
            return np.zeros(0, U64)
        base = U64(((_BASE ^ (seed * 0x5851F42D4C957F2D)) | 1) % 2**64)
        out = np.empty(n, U64)
        for at in range(0, n, _SPAN):
            to = min(n, at + _SPAN)
            h = self.codes[at:to].copy()
            for j in range(1, k):
                h *= base
                h += self.codes[at + j : to + j]
            out[at:to] = mix(h + U64(seed))
        return out

    def document_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def whole(self, k: int) -> np.ndarray:
        """Start positions whose k words lie in one document."""
        n = max(0, len(self.codes) - k + 1)
        last = np.repeat(self.first[1:], np.diff(self.first))[:n]
        return np.flatnonzero(np.arange(n) + k <= last)


def flat(texts: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row and the document borders; a null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    borders = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    all_bytes = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return all_bytes[borders[0] : borders[-1]], borders - borders[0]


def runs(data: np.ndarray, borders: np.ndarray, outside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every maximal run of bytes that are not ``outside``, inside one document."""
    ink = ~outside[data]
    fresh = np.zeros(len(data) + 1, bool)
    fresh[borders] = True
    before = np.concatenate([[True], ~ink[:-1]]) | fresh[:-1]
    after = np.concatenate([~ink[1:], [True]]) | fresh[1:]
    return np.flatnonzero(ink & before), np.flatnonzero(ink & after) + 1


def words(
    texts: pa.ChunkedArray | pa.Array, lower: bool = False, letters: bool = False, outside: np.ndarray | None = None
) -> Words:
    """All words of all texts.  ``lower`` maps A-Z to a-z first; ``letters`` ends words at every ASCII non-letter.

    ``outside`` names the bytes that end a word by itself, as a mask of 256.
    """
    data, borders = flat(texts)
    if not len(data):
        zero = np.zeros(0, np.int64)
        return Words(np.zeros(0, U64), np.zeros(len(borders), np.int64), data, zero, zero)
    if lower:
        data = _LOWER[data]
    if outside is None:
        outside = _NO_LETTER if letters else _SPACE
    starts, ends = runs(data, borders, outside)
    codes = np.empty(len(starts), U64)
    at = 0
    while at < len(starts):  # spans of whole words, so that working memory stays small
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + _SPAN, "right")))
        low, high = starts[at], ends[to - 1]
        size = max(_SPAN, int(high - low)) + 1
        up, down = _powers(size)
        sums = np.zeros(high - low + 1, U64)
        np.cumsum(_CODES[data[low:high]] * up[: high - low], out=sums[1:])
        s, e = starts[at:to] - low, ends[at:to] - low
        codes[at:to] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(U64))
        at = to
    return Words(codes, np.searchsorted(starts, borders), data, starts, ends)


def spread(values: np.ndarray) -> bytes:
    """Non-negative numbers as byte planes, as many as the largest one needs; zero planes vanish in the shuffle."""
    top = int(values.max()) if len(values) else 0
    planes = max(1, (top.bit_length() + 7) // 8)
    raw = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :planes]
    return bytes([planes]) + np.ascontiguousarray(raw.T).tobytes()


def gather(blob: bytes) -> np.ndarray:
    """Inverse of ``spread``."""
    planes = blob[0]
    raw = np.frombuffer(blob, np.uint8, offset=1).reshape(planes, -1)
    out = np.zeros((raw.shape[1], 8), np.uint8)
    out[:, :planes] = raw.T
    return out.reshape(-1).view("<u8")


def steps(ordered: np.ndarray) -> bytes:
    """Ascending numbers by their differences."""
    return spread(np.diff(ordered, prepend=U64(0)))


def unsteps(blob: bytes) -> np.ndarray:
    return np.cumsum(gather(blob), dtype=U64)
