"""Byte counts, packing, damage, rotations."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenvec.functions import codecs, pack, rotation


@pytest.mark.parametrize(
    "layers, heads, tokens, want", [(24, 32, 800, 14_746_512), (24, 32, 1024, 18_875_280), (24, 2, 819, 944_400)]
)
def test_fb2_sizes(layers, heads, tokens, want):
    assert layers * 2 * codecs.fb2_bytes(tokens * heads, 64) == want


def test_fb1_size():
    assert 24 * 2 * codecs.fb1_bytes(1024 * 32, 64) == 36_175_872


@pytest.mark.parametrize(
    "heads, tokens, bits, lossy, want",
    [
        (32, 28, 4, False, 6_194_976), (32, 28, 4, True, 2_410_272), (32, 28, 8, False, 6_883_104), (32, 28, 8, True, 3_098_400),
        (32, 224, 8, False, 55_052_064), (32, 224, 8, True, 24_774_432), (2, 28, 8, False, 431_904), (2, 28, 8, True, 195_360),
    ],
)
def test_tqb1_sizes(heads, tokens, bits, lossy, want):
    assert 24 * 2 * codecs.tqb1_bytes(tokens * heads, 64, bits, 32, lossy) == want


@settings(max_examples=50, deadline=None)
@given(st.integers(1, 16), st.data())
def test_bits_round_trip(bits, data):
    values = data.draw(st.lists(st.integers(0, 2**bits - 1), max_size=40))
    assert pack.unpack_bits(pack.pack_bits(values, bits), bits, len(values)).tolist() == values


def test_padding():
    with pytest.raises(ValueError):
        pack.unpack_bits(b"\xff", 3, 1)


def test_fnv():
    # fixed values: published test vectors of 64-bit FNV-1a
    assert [pack.fnv1a(x) for x in (b"", b"a", b"foobar")] == [0xCBF29CE484222325, 0xAF63DC4C8601EC8C, 0x85944171F73967E8]


@pytest.mark.parametrize("n", [8, 12, 64])
def test_rotation_is_orthogonal(n):
    m = rotation.rotation(n)
    assert np.allclose(m @ m.T, np.eye(n))
    assert np.array_equal(m, rotation.rotation(n))
