"""Polynomial fingerprints that compose: the hash of a text from the hashes of its chunks.

Of bytes b[0..n) the fingerprint modulo p is the sum of b[i] * BASE ** (n - 1 - i), so that
``joined = left * BASE ** len(right) + right``: chunks may be hashed in any order or place and
combined by length-shifted arithmetic."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

BASE = 1_000_003
MODULI = (2**40 - 87, 2**40 - 167)  # primes; a byte, 40 bits and 2**16 terms fit in 64 bits
CHUNK = 1 << 16


@lru_cache(maxsize=8)
def _powers(p: int) -> np.ndarray:
    """BASE ** k modulo p for k under CHUNK, highest first."""
    out, x = [], 1
    for _ in range(CHUNK):
        out.append(x)
        x = x * BASE % p
    return np.array(out[::-1], "u8")


@dataclass(frozen=True)
class Print:
    length: int
    hashes: tuple[int, ...]

    def then(self, right: Print, moduli: tuple[int, ...] = MODULI) -> Print:
        """The fingerprint of this text followed by the other."""
        return Print(
            self.length + right.length,
            tuple((a * pow(BASE, right.length, p) + b) % p for a, b, p in zip(self.hashes, right.hashes, moduli, strict=True)),
        )


def of_chunk(data: bytes, moduli: tuple[int, ...] = MODULI) -> Print:
    values = np.frombuffer(data, "u1").astype("u8")
    return Print(len(data), tuple(int(np.dot(values, _powers(p)[CHUNK - len(data) :])) % p for p in moduli))


def of(data: bytes, moduli: tuple[int, ...] = MODULI) -> Print:
    out = of_chunk(data[:CHUNK], moduli)
    for k in range(CHUNK, len(data), CHUNK):
        out = out.then(of_chunk(data[k : k + CHUNK], moduli), moduli)
    return out
