"""Binary forms, codecs, codebook laws: damage, round trips, brute force."""

import math
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenvec.arrow import lists
from lumenvec.functions import codecs, quantize, registry, wire
from lumenvec.operators import codes, kvcache, lloyd, search

RNG = np.random.default_rng(5)
FIB, TURBO = wire.FibProfile(16, 4, 32), wire.TurboProfile(16, 4, 8)


def fib_blobs():
    norms, words = quantize.fib(FIB).encode(RNG.standard_normal((5, 16)))
    return wire.fb1_encode(FIB, norms[0], words[0]), wire.fb2_encode(FIB, norms, words), norms, words


def test_fib_forms():
    one, many, norms, words = fib_blobs()
    assert len(one) == 11 + 2 + 3 and len(many) == 19 + 5 * (2 + 3) and wire.fb2_count(many) == 5
    norm, back = wire.fb1_decode(FIB, one)
    assert back.tolist() == words[0].tolist() and abs(norm - norms[0]) < 1e-2
    back_norms, back_words = wire.fb2_decode(FIB, many)
    assert (back_words == words).all() and np.allclose(back_norms, norms, rtol=1e-3)
    assert wire.fb2_count(many[:13]) is None and wire.fb2_count(one) is None


def test_turbo_forms():
    radii, angles, signs = quantize.turbo(TURBO).encode(RNG.standard_normal((5, 16)))
    one = wire.tqw1_encode(TURBO, radii[0], angles[0], signs[0])
    assert len(one) == 46 + 32 + 3 + 1 and wire.tqw1_header(one)["dim"] == 16
    r, k, s = wire.tqw1_decode(TURBO, one)
    assert (k == angles[0]).all() and (s == signs[0]).all() and np.allclose(r, radii[0])
    for mode, size, error in (("f32", 32, 1e-6), ("linear_u16", 24, 1e-4), ("log_u8", 16, 0.05)):
        many = wire.tqb1_encode(TURBO, radii, angles, signs, mode)
        assert len(many) == 38 + 5 * (size + 3 + 1)
        r, k, s = wire.tqb1_decode(TURBO, many)
        assert (k == angles).all() and (s == signs).all() and (abs(r / radii - 1) < error).all()


@pytest.mark.parametrize("kind", ["fb1", "fb2", "tqw1", "tqb1"])
def test_damage_is_refused(kind):
    one, many, *_ = fib_blobs()
    radii, angles, signs = quantize.turbo(TURBO).encode(RNG.standard_normal((3, 16)))
    blob, head, read = {
        "fb1": (one, 11, lambda b: wire.fb1_decode(FIB, b)), "fb2": (many, 19, lambda b: wire.fb2_decode(FIB, b)),
        "tqw1": (wire.tqw1_encode(TURBO, radii[0], angles[0], signs[0]), 46, lambda b: wire.tqw1_decode(TURBO, b)),
        "tqb1": (wire.tqb1_encode(TURBO, radii, angles, signs), 38, lambda b: wire.tqb1_decode(TURBO, b)),
    }[kind]
    for i in range(head):
        with pytest.raises(ValueError):
            read(blob[:i] + bytes([blob[i] ^ 0xA5]) + blob[i + 1 :])
    for short in (b"", blob[: head - 1], blob[:-1], blob + b"\0"):
        with pytest.raises(ValueError):
            read(short)


def test_refused_input():
    with pytest.raises(ValueError):
        wire.unpack_rows(np.array([[255]], np.uint8), 3, 1)  # padding
    for norm in (0.0, -1.0, math.inf, 1e9, 1e-12):
        with pytest.raises(ValueError):
            wire.norm_bytes([norm])
    with pytest.raises(ValueError):
        quantize.fib(FIB).encode(np.zeros((1, 16)))
    with pytest.raises(ValueError):
        quantize.turbo(TURBO).encode([[math.nan] * 16])
    for bad in (dict(dim=4, block=4), dict(dim=16, block=5), dict(dim=16, words=1)):
        with pytest.raises(ValueError):
            wire.FibProfile(**bad)
    with pytest.raises(ValueError):
        registry.create("turbo_17bit_batched", 16)


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 16), st.integers(1, 20), st.data())
def test_rows_of_bits(bits, count, data):
    values = np.array(data.draw(st.lists(st.lists(st.integers(0, 2**bits - 1), min_size=count, max_size=count), min_size=1, max_size=4)))
    assert (wire.unpack_rows(wire.pack_rows(values, bits), bits, count) == values).all()


def test_registry_takes_other_codecs():
    class Halves:
        lossless = False

        def __init__(self, dim):
            self.dim = dim

        def encode_batch(self, x):
            return np.asarray(x, "<f2").tobytes()

        def decode_batch(self, raw):
            return np.frombuffer(raw, "<f2").reshape(-1, self.dim).astype(float)

    registry.register("halves", lambda m, dim: Halves(dim))
    x = RNG.standard_normal((4, 16))
    for codec in ("halves", "exact_f32_fallback", "fib_k4_n32_batched", "turbo_8bit_batched", "turbo_8bit_batched_lossy"):
        c = registry.create(codec, 16)
        back = c.decode_batch(c.encode_batch(x))
        assert back.shape == x.shape and ((x * back).sum(1) / np.linalg.norm(x, axis=1) / np.linalg.norm(back, axis=1) > 0.7).all()
        assert not c.lossless or np.allclose(back, x, atol=1e-6)


def test_radius_law():
    for a, b in ((2.0, 20.3), (0.5, 3.0), (5.0, 1.0)):
        for q in (0.01, 0.5, 0.99):
            assert abs(codecs.beta_cdf(codecs.beta_inv(q, a, b), a, b) - q) < 1e-9
    assert abs(codecs.radius_quantile(64, 2, 3, 8) - math.sqrt(1 - (1 - 2.5 / 8) ** (4 / 64))) < 1e-12
    for k in (2, 3, 4, 8):
        assert np.allclose(np.linalg.norm(codecs.directions(k, 20), axis=1), 1)
    x, y = codecs.spherical_samples(20_000, 64, 4, 1), codecs.spherical_samples(20_000, 64, 4, 2, project=True)
    for s in (x, y):
        assert abs((s * s).sum(1).mean() - 4 / 64) < 2e-3 and abs(s.mean()) < 5e-3


def test_lloyd_equals_plain_steps(spark):
    x = RNG.standard_normal((600, 4))
    book = x[:8] * 0.1
    rows = spark.createDataFrame([(v.tolist(),) for v in x], "x array<double>")
    found = lloyd.cells(rows, book)
    at, d = lloyd.nearest(x, book)
    for w, (n, distortion, sums, far, sample) in found.items():
        own = at == w
        assert n == own.sum() and np.isclose(distortion, d[own].sum()) and np.allclose(sums, x[own].sum(0)) and np.isclose(far, d[own].max())
    new, repairs = lloyd.step(book, found)
    assert repairs == 8 - len(found) and np.allclose(new[at[0]], x[at == at[0]].mean(0), atol=1e-3)
    far_book = np.concatenate([book[:7], [[9e3] * 4]])  # an empty cell
    with pytest.raises(ValueError):
        lloyd.step(far_book, lloyd.cells(rows, far_book), repair=False)
    assert lloyd.step(far_book, lloyd.cells(rows, far_book))[1] == 1
    got = lloyd.refine(rows, book, iterations=3, restarts=2)
    assert got.mse < got.first_mse


@pytest.mark.parametrize("metric", ["ip", "cosine", "l2"])
def test_search_against_all_pairs(spark, monkeypatch, metric):
    monkeypatch.setattr(search, "PART_ROWS", 37)
    monkeypatch.setattr(search, "FAN", 3)
    x = RNG.standard_normal((200, 8)).round(2)
    x[50:60] = x[40]  # ties
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, x array<double>")
    asked = corpus.where("id % 9 = 0")
    s = search._scores(x[::9], x, metric)
    want = {(9 * q, i, r) for q in range(len(s)) for r, i in enumerate(np.lexsort((np.arange(200), -s[q]))[:7].tolist())}
    assert {(r.q, r.id, r["rank"]) for r in search.top_k(corpus, asked, 7, metric, block=5).collect()} == want
    assert search.top_k(corpus, asked.limit(0), 7).count() == search.top_k(corpus.limit(0), asked, 7).count() == 0


def test_cache_edges(spark):
    profile = wire.TurboProfile(8, 4, 8)
    x = RNG.standard_normal((6, 8))
    tokens = spark.createDataFrame([(1, i, v.tolist(), v.tolist()) for i, v in enumerate(x)], "ctx bigint, pos bigint, key array<double>, value array<double>")
    asked = spark.createDataFrame([(1, x[0].tolist()), (2, x[1].tolist())], "ctx bigint, q array<double>")
    bare, kept = kvcache.compress(tokens, profile, keep_shadow=False), kvcache.compress(tokens, profile)
    out = {(r.ctx, r.dim): r.value for r in kvcache.attend(bare, asked, profile).collect()}
    assert all(out[2, d] == 0 for d in range(8)) and any(out[1, d] for d in range(8))
    with pytest.raises(ValueError):
        kvcache.exact_scores(bare, asked)
    exact = {r.pos: r.score for r in kvcache.exact_scores(kept, asked).collect()}
    assert all(abs(exact[i] - x[i] @ x[0]) < 1e-8 for i in range(6))
    one = {r.pos: r.score for r in kvcache.scores(bare, asked, profile).collect()}
    half = {r.pos: r.score for r in kvcache.scores(bare, asked, profile, 0.5).collect()}
    assert all(abs(one[i] / 2 - half[i]) < 1e-8 for i in one)
    for bad in ("wide", math.nan):
        with pytest.raises(ValueError):
            kvcache.scale_of(bad, 8)


def test_code_tables(spark):
    x = RNG.standard_normal((9, 16))
    v = spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(x)], "id int, x array<double>")
    q = quantize.turbo(TURBO)
    radii, angles, signs = q.encode(x)
    c = codes.turbo_codes(v, TURBO)
    got = {r.id: r for r in c.collect()}
    assert all(got[i].angles == angles[i].tolist() and got[i].signs == signs[i].tolist() for i in range(9))
    a = {r.id: np.array(r.x) for r in codes.turbo_search_vectors(c, TURBO).collect()}
    b = {r.id: np.array(r.x) for r in codes.turbo_query_vectors(v, TURBO).collect()}
    want = q.score(x[2], radii, angles, signs)
    assert np.allclose([a[i] @ b[2] for i in range(9)], want)
    assert np.allclose(q.distance(x[2], radii, angles, signs) ** 2, np.maximum(0, x[2] @ x[2] + (radii**2).sum(1) - 2 * want))


@pytest.mark.parametrize("metric", ["ip", "cosine", "l2"])
def test_search_of_a_whole_part_is_bounded(metric):
    """A part of 65,536 rows and 1,024 queries in one batch: what a task holds stays near the rows themselves."""
    n, x = search.PART_ROWS, RNG.standard_normal((search.PART_ROWS, 32))
    rows = pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), pa.array(np.zeros(n, np.int32)), pa.array(np.arange(n)), lists(x)], ["part", "side", "id", "x"])
    asked = pa.RecordBatch.from_arrays([pa.array(np.zeros(1024, np.int32)), pa.array(np.ones(1024, np.int32)), pa.array(np.arange(1024)), lists(x[:1024])], ["part", "side", "id", "x"])
    tracemalloc.start()
    got = pa.Table.from_batches(search._visit(iter([rows, asked]), 3, metric, search.BLOCK))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.num_rows == 3 * 1024 and peak < 300e6
    s = search._scores(x[1000:1001], x, metric)[0]
    assert got.column("id").to_pylist()[3000:3003] == np.lexsort((np.arange(n), -s))[:3].tolist()
