"""Batches of vectors to codes and back, in Arrow blocks: the work of one task on rows that Spark deals.

The rotation, the sign projections and the codebook are small constants that a
profile fixes.  Codes equal those of the column expressions in ``codecs``.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from .codecs import PI2, initial_codebook, projections
from .rotation import rotation
from .wire import FibProfile, TurboProfile


def checked(x, dim: int) -> np.ndarray:
    """Rows as a matrix; a wrong length or a value that is not finite is an error."""
    if len(x) and {len(v) for v in x} != {dim}:
        raise ValueError(f"vectors of {dim} numbers are asked for")
    x = np.asarray(x, np.float64).reshape(len(x), dim)
    if not np.isfinite(x).all():
        raise ValueError("a vector is not finite")
    return x


class Turbo:
    """Angles on a grid, radii, and the signs of what they leave over."""

    def __init__(self, profile: TurboProfile):
        self.profile, self.turn = profile, rotation(profile.dim, profile.seed)
        self.planes = projections(profile.projections, profile.dim, profile.seed)

    def grid(self, angles: np.ndarray) -> np.ndarray:
        """The lower edge of each angle's bin."""
        return np.asarray(angles) / (1 << self.profile.angle_bits) * PI2 - np.pi

    def rotated(self, radii: np.ndarray, angles: np.ndarray) -> np.ndarray:
        at = self.grid(angles)
        return np.stack([radii * np.cos(at), radii * np.sin(at)], 2).reshape(len(at), -1)

    def encode(self, x) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(radii, angles, signs)"""
        y = checked(x, self.profile.dim) @ self.turn.T
        a, b = y[:, ::2], y[:, 1::2]
        n = 1 << self.profile.angle_bits
        radii = np.sqrt(a * a + b * b)
        angles = np.floor(np.round((np.arctan2(b, a) + np.pi) / PI2 * n, 12)).astype(np.int64) % n
        left = (y - self.rotated(radii, angles)) @ self.planes.T
        return radii, angles, np.where(left >= 0, 1, -1)

    def decode(self, radii, angles) -> np.ndarray:
        """The angles' part alone: signs correct estimates, they do not rebuild vectors."""
        return self.rotated(radii, angles) @ self.turn

    def score(self, query, radii, angles, signs, norm=1.0) -> np.ndarray:
        """Inner product estimates with one query; norm scales the signs' part."""
        q = checked([query], self.profile.dim)[0] @ self.turn.T
        found = self.rotated(radii, angles) @ q
        m = self.profile.projections
        return found + (norm * np.sqrt(np.pi / 2) / m * (signs @ (self.planes @ q)) if m else 0)

    def distance(self, query, radii, angles, signs) -> np.ndarray:
        q = np.asarray(query, np.float64)
        return np.sqrt(np.maximum(0, q @ q + (radii * radii).sum(1) - 2 * self.score(query, radii, angles, signs)))


class Fib:
    """Blocks of the rotated unit vector as codewords, and the norm."""

    def __init__(self, profile: FibProfile, book: np.ndarray | None = None, seed: int = 42):
        self.profile, self.turn = profile, rotation(profile.dim, seed)
        self.book = np.asarray(initial_codebook(profile.dim, profile.block, profile.words) if book is None else book, np.float64)
        if self.book.shape != (profile.words, profile.block) or not np.isfinite(self.book).all():
            raise ValueError("the codebook does not fit the profile")

    def nearest(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of each block's codeword; the least index wins ties."""
        d = np.zeros((len(blocks), len(self.book)))
        for j in range(self.book.shape[1]):
            d += (blocks[:, j, None] - self.book[:, j]) ** 2
        d = d.round(12)
        at = d.argmin(1)
        return at, d[np.arange(len(at)), at]

    def encode(self, x) -> tuple[np.ndarray, np.ndarray]:
        """(norms, codeword indices); a vector without a direction is an error."""
        x = checked(x, self.profile.dim)
        norms = np.sqrt((x * x).sum(1))
        if (norms == 0).any():
            raise ValueError("a zero vector has no direction")
        unit = (x @ self.turn.T) / norms[:, None]
        return norms, self.nearest(unit.reshape(-1, self.profile.block))[0].reshape(len(x), -1)

    def decode(self, norms, words) -> np.ndarray:
        return self.book[words].reshape(len(words), -1) @ self.turn * np.asarray(norms)[:, None]


@lru_cache(maxsize=16)
def turbo(profile: TurboProfile) -> Turbo:
    return Turbo(profile)


@lru_cache(maxsize=16)
def fib(profile: FibProfile) -> Fib:
    return Fib(profile)
