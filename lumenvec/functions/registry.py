"""Vector codecs by id: a user's own stands beside the built-in ones.

A codec turns a batch of vectors into one blob and back.  ``register`` takes a
pattern of ids and a factory (match, dim) -> codec; ``create`` finds it.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Protocol

import numpy as np

from . import quantize, wire


class Codec(Protocol):
    """What a store needs of a codec; ``lossless`` promises an exact round trip of 32-bit floats."""

    dim: int
    lossless: bool

    def encode_batch(self, x: np.ndarray) -> bytes: ...

    def decode_batch(self, raw: bytes) -> np.ndarray: ...


class Exact:
    """32-bit floats as they are."""

    lossless = True

    def __init__(self, dim: int):
        self.dim = dim

    def encode_batch(self, x):
        return quantize.checked(x, self.dim).astype("<f4").tobytes()

    def decode_batch(self, raw):
        if len(raw) % (4 * self.dim):
            raise ValueError("wrong length")
        return np.frombuffer(raw, "<f4").reshape(-1, self.dim).astype(np.float64)


class FibBatch:
    """A block codebook in the batch form; reads the form of single codes as well."""

    lossless = False

    def __init__(self, dim: int, block: int = 4, words: int = 32, norm: str = "f16"):
        self.dim, self.profile = dim, wire.FibProfile(dim, block, words, norm)

    def encode_batch(self, x):
        return wire.fb2_encode(self.profile, *quantize.fib(self.profile).encode(x))

    def decode_batch(self, raw):
        if raw[:3] == wire.FB1:
            norm, words = wire.fb1_decode(self.profile, raw)
            return quantize.fib(self.profile).decode([norm], words[None])
        return quantize.fib(self.profile).decode(*wire.fb2_decode(self.profile, raw))


class TurboBatch:
    """Angles and signs in the batch form."""

    lossless = False

    def __init__(self, dim: int, bits: int = 4, lossy: bool = False, projections: int = 32):
        self.dim, self.mode = dim, "log_u8" if lossy else "f32"
        self.profile = wire.TurboProfile(dim, bits, projections)

    def encode_batch(self, x):
        return wire.tqb1_encode(self.profile, *quantize.turbo(self.profile).encode(x), self.mode)

    def decode_batch(self, raw):
        radii, angles, _ = wire.tqb1_decode(self.profile, raw)
        return quantize.turbo(self.profile).decode(radii, angles)


_FACTORIES: list[tuple[re.Pattern, Callable[[re.Match, int], Codec]]] = []


def register(pattern: str, factory: Callable[[re.Match, int], Codec]) -> None:
    """Later registrations win, so a user may replace a built-in codec."""
    _FACTORIES.insert(0, (re.compile(pattern), factory))


def create(codec_id: str, dim: int) -> Codec:
    for pattern, factory in _FACTORIES:
        if match := pattern.fullmatch(codec_id):
            return factory(match, dim)
    raise ValueError(f"no codec has the id {codec_id}")


def turbo_codec_id(bits: int, lossy: bool = False) -> str:
    if not 2 <= bits <= 16:
        raise ValueError("2 to 16 bits are possible")
    return f"turbo_{bits}bit_batched" + "_lossy" * lossy


register(r"exact_f32_fallback", lambda m, dim: Exact(dim))
register(r"fib_k([0-9]+)_n([0-9]+)_batched(_f32)?", lambda m, dim: FibBatch(dim, int(m[1]), int(m[2]), "f32" if m[3] else "f16"))
register(r"turbo_([2-9]|1[0-6])bit_batched(_lossy)?", lambda m, dim: TurboBatch(dim, int(m[1]), bool(m[2])))
