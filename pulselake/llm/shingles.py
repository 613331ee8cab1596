"""Hashed word shingles of whole texts and one-permutation MinHash signatures, in numpy."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_rng = np.random.default_rng(20240817)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_ODD = _rng.integers(1, 2**62, 64, dtype=np.uint64) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)


def scramble(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Shingler:
    """Distinct hashed shingles of ``width`` words for many texts at a time.

    A-Z are lower-cased; words are runs of bytes other than 0x20 and 0x09-0x0D. A text
    with fewer words is one shingle of all of them; one without words has none.
    """

    def __init__(self, width: int):
        self.width = width
        self._powers = self._inverses = np.ones(0, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self._powers) < n:
            n = max(n, 1 << 20)
            for name, base in (("_powers", _BASE), ("_inverses", _INVERSE)):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def words(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(hash of every word, text that it is in), in order."""
        raw = [(t or "").encode("utf-8", "replace").lower() for t in texts]
        data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
        self._grow(len(data) + 1)
        space = _SPACE[data]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], space))))
        start, end = edge[::2], edge[1::2]
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * self._powers[: len(data)], dtype=np.uint64)))
        hashes = scramble((sums[end] - sums[start]) * self._inverses[start] + (end - start).astype(np.uint64))
        first = np.cumsum([0] + [len(r) + 1 for r in raw])
        return hashes, np.searchsorted(first, start, side="right") - 1

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        """Sorted distinct shingle hashes of each text."""
        hashes, of = self.words(texts)
        w, found = self.width, []
        bounds = np.searchsorted(of, np.arange(len(texts) + 1))
        full = np.zeros(0, np.uint64)
        if len(hashes) >= w:
            full = np.zeros(len(hashes) - w + 1, np.uint64)
            for k in range(w):
                full += scramble(hashes[k : len(hashes) - w + 1 + k] * _ODD[k])
            full = scramble(full)
        for i in range(len(texts)):
            lo, hi = bounds[i], bounds[i + 1]
            if hi - lo >= w:
                found.append(np.unique(full[lo : hi - w + 1]))
            elif hi > lo:
                short = sum((scramble(hashes[lo + k : lo + k + 1] * _ODD[k]) for k in range(hi - lo)), np.zeros(1, np.uint64))
                found.append(scramble(short + _U(hi - lo)))
            else:
                found.append(np.zeros(0, np.uint64))
        return found


class MinHasher:
    """One-permutation MinHash with optimal densification and banding."""

    def __init__(self, bins: int = 128, rows: int = 4):
        self.bins, self.rows, self.bits = bins, rows, bins.bit_length() - 1
        if 1 << self.bits != bins or bins % rows:
            raise ValueError("bins must be a power of two and a multiple of rows")
        draws = np.arange(bins, dtype=np.uint64)[:, None] * _U(1 << 20) + np.arange(64 * bins // 16, dtype=np.uint64)[None, :]
        self._probes = (scramble(draws + _ODD[40]) >> _U(64 - self.bits)).astype(np.int64)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        """The least hash of every bin; an empty bin copies the bin that its own hashes find first."""
        if not len(shingles):
            return np.zeros(self.bins, np.uint64)
        of = shingles >> _U(64 - self.bits)
        first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
        at, values = of[first].astype(np.int64), shingles[first]
        signature, full = np.zeros(self.bins, np.uint64), np.zeros(self.bins, bool)
        signature[at], full[at] = values, True
        if len(at) < self.bins:
            empty = np.flatnonzero(~full)
            hit = full[self._probes[empty]]
            source = self._probes[empty, hit.argmax(axis=1)]
            missed = ~full[source]
            if missed.any():  # as good as never: take the next full bin
                source[missed] = at[np.searchsorted(at, empty[missed]) % len(at)]
            signature[empty] = signature[source]
        return signature

    def bands(self, signatures: np.ndarray) -> np.ndarray:
        """A key for each run of ``rows`` bins, as signed 64-bit numbers: (texts, bins / rows)."""
        parts = signatures.reshape(len(signatures), -1, self.rows)
        keys = np.zeros(parts.shape[:2], np.uint64)
        for k in range(self.rows):
            keys += scramble(parts[:, :, k] * _ODD[k])
        return scramble(keys + np.arange(parts.shape[1], dtype=np.uint64) * _ODD[41]).view(np.int64)


def set_digest(shingles: np.ndarray) -> bytes:
    """16 bytes that stand for the whole set."""
    return blake2b(shingles.tobytes(), digest_size=16).digest()
