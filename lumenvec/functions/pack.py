"""Bit packing and FNV-1a."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

def pack_bits(values, bits: int) -> bytes:
    """Least significant bit first; the last byte is padded with zeros."""
    v = np.asarray(values, np.uint64)
    if len(v) and int(v.max()) >> bits:
        raise ValueError("a value needs more bits")
    flat = (v[:, None] >> np.arange(bits, dtype=np.uint64) & np.uint64(1)).astype(np.uint8).ravel()
    return np.packbits(flat, bitorder="little").tobytes()


def unpack_bits(raw: bytes, bits: int, n: int) -> np.ndarray:
    if len(raw) != -(-n * bits // 8):
        raise ValueError("wrong length")
    flat = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")
    if flat[n * bits :].any():
        raise ValueError("padding is not zero")
    return (flat[: n * bits].reshape(n, bits).astype(np.int64) << np.arange(bits)).sum(1)


# Offset basis and prime of 64-bit FNV-1a.
FNV_BASIS, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def fnv1a_rows(rows: list[bytes]) -> np.ndarray:
    """64-bit FNV-1a of each row; all rows take a byte at a time together."""
    sizes = np.array([len(r) for r in rows], np.int64)
    h = np.full(len(rows), FNV_BASIS, np.uint64)
    flat = np.frombuffer(b"".join(rows), np.uint8)
    begin = np.cumsum(sizes) - sizes
    for i in range(int(sizes.max(initial=0))):
        open_ = np.flatnonzero(sizes > i)
        h[open_] = (h[open_] ^ flat[begin[open_] + i]) * np.uint64(FNV_PRIME)
    return h


def fnv1a(raw: bytes) -> int:
    return int(fnv1a_rows([raw])[0])


def fnv_column():
    """Of a text's UTF-8, as 16 hex digits."""

    @F.pandas_udf("string")
    def digest(text: pd.Series) -> pd.Series:
        return pd.Series([f"{h:016x}" for h in fnv1a_rows([t.encode() for t in text]).tolist()])

    return digest


def packed_column(bits: int):
    @F.pandas_udf("binary")
    def pack(values: pd.Series) -> pd.Series:
        return pd.Series([pack_bits(v, bits) for v in values])

    return pack


def unpacked_column(bits: int, n: int):
    @F.pandas_udf("array<int>")
    def unpack(raw: pd.Series) -> pd.Series:
        return pd.Series([unpack_bits(bytes(b), bits, n).astype("i4") for b in raw])

    return unpack
