"""Pool, shells, paged tensors, page files, corpora: round trips and damage."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenvec.functions import wire
from lumenvec.operators import kvpages, statestore, store
from lumenvec.shared import settings
from lumenvec.sources import pages, tables

SHAPE = store.Shape(2, 2, 8)
RNG = np.random.default_rng(7)


@pytest.fixture(scope="module")
def tokens(spark):
    x = RNG.standard_normal((40, 64)).astype("f4")
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "pos bigint, vector array<float>"), x


def test_exact_pool_round_trip(spark, tokens):
    df, x = tokens
    blobs = store.build_pool(df, SHAPE, "exact_f32_fallback", tokens_per_blob=16)
    assert {r.n_vectors for r in blobs.collect()} == {32, 16} and blobs.count() == 2 * 2 * 3
    back = {(r.layer, r.role, r.pos, r.head): r.x for r in store.decode_blobs(blobs, ["layer", "role"], SHAPE).collect()}
    for i, v in enumerate(x):
        for at in range(8):
            assert np.allclose(back[at // 4, "key" if at % 2 == 0 else "value", i, at // 2 % 2], v[at * 8 : at * 8 + 8])
    whole = {r.pos: r for r in store.nest(store.unnest(df, SHAPE), ["pos"]).where("layer = 1").collect()}
    assert np.allclose(whole[3].k, np.concatenate([x[3][32:40], x[3][48:56]]))


def test_pool_digests_bind_their_blobs(tokens):
    df, _ = tokens
    a, b = (store.build_pool(d, SHAPE) for d in (df, df.where("pos != 7")))
    one, two = (store.pool_manifest(p, SHAPE).first() for p in (a, b))
    assert one.pool_id != two.pool_id and one.shared_tokens == 40 and two.shared_tokens == 39
    assert store.pool_manifest(a, SHAPE, seed=1).first().pool_id != one.pool_id
    hurt = a.withColumn("payload", F.expr("concat(payload, X'00')"))
    with pytest.raises(Exception, match="digest does not hold"):
        store.decode_blobs(hurt, ["layer", "role"], SHAPE).count()


def test_bad_tokens_are_refused(spark):
    for v in ([1.0] * 63, [1.0] * 63 + [float("nan")], [1.0] * 63 + [float("inf")], [1.0] * 63 + [None]):
        with pytest.raises(Exception, match="64 finite numbers"):
            store.unnest(spark.createDataFrame([(0, v)], "pos bigint, vector array<float>"), SHAPE).collect()


def blocks(spark, n=37, profile=None, zero=()):
    shape = kvpages.TensorShape(1, 1, 2, n, 8)
    x = RNG.standard_normal((2, n, 8)).astype("f4")
    for t in zero:
        x[:, t] = 0
    rows = spark.createDataFrame([(0, 0, h, t, x[h, t].tolist()) for h in range(2) for t in range(n)], "batch int, layer int, head int, token int, x array<double>")
    profile = profile or kvpages.PageProfile(16, protected=kvpages.Protected(first=3))
    return shape, profile, x, rows, kvpages.encode_tensor(rows, shape, profile, wire.FibProfile(8)).cache()


def test_paged_tensor(spark):
    shape, profile, x, rows, b = blocks(spark, zero=(5,))
    got = {(r.head, r.token): r for r in b.collect()}
    assert profile.pages(shape) == 3 and sorted(r.block_id for r in got.values() if r.page_id == 2) == list(range(10))
    assert {k[1] for k, r in got.items() if r.reason == "protected_region"} == {0, 1, 2}
    assert {k[1] for k, r in got.items() if r.reason == "encode_fallback"} == {5}
    back = {(r.head, r.token): np.array(r.x) for r in kvpages.decode_tensor(b, shape, wire.FibProfile(8)).collect()}
    for (h, t), v in back.items():
        assert np.allclose(v, x[h, t]) if got[h, t].raw else abs(np.linalg.norm(v - x[h, t])) < np.linalg.norm(x[h, t])
    with pytest.raises(Exception, match="may not stay raw"):
        kvpages.encode_tensor(rows, shape, kvpages.PageProfile(16, keep_raw=False), wire.FibProfile(8)).collect()
    for axis, reason in (("raw", "raw_axis_policy"), ("role_aware", "unsupported_axis_raw_fallback")):
        all_raw = kvpages.encode_tensor(rows, shape, kvpages.PageProfile(16, axis), wire.FibProfile(8))
        assert {r.reason for r in all_raw.select("reason").distinct().collect()} == {reason}
    with pytest.raises(Exception, match="outside the shape"):
        kvpages.encode_tensor(rows.withColumn("token", F.col("token") + 1), shape, profile, wire.FibProfile(8)).collect()


def test_page_violations(spark):
    shape, profile, _, _, b = blocks(spark)
    stored = kvpages.pages_of(b, profile)
    found = lambda blocks_, pages_=stored: {r.page_id: r.violations for r in kvpages.page_violations(blocks_, pages_, shape, profile).collect()}
    assert set(map(tuple, found(b).values())) == {()}
    lost = found(b.where("not (page_id = 1 and block_id = 4)"))
    assert lost[0] == [] and "block_ids" in lost[1] and "page_digest" in lost[1]
    other = found(b.withColumn("payload", F.when(F.col("page_id") == 2, F.expr("concat(substring(payload, 1, length(payload) - 1), X'07')")).otherwise(F.col("payload"))))
    assert "block_damaged" in other[2] and other[1] == []
    assert "page_too_long" in found(b, stored.withColumn("token_count", F.lit(17)))[0]
    assert found(b.where("page_id != 0"))[0] == ["no_blocks", "raw_count", "block_ids", "token_outside", "block_form", "block_damaged", "page_digest"]


def test_page_files(spark, tmp_path):
    rows = [(i, bytes(range(i, i + 9))) for i in range(4)]
    base = spark.createDataFrame(rows, "id int, payload binary").selectExpr(
        "*", "'full_attn_k' component_kind", "array(9L) dims", "'int8' dtype", "'l' endianness", "'m' model_digest", "'l' layout_digest",
        "0 position_start", "9 position_end", "'raw' codec_profile",
    )
    made = pages.with_headers(base).withColumn("content", pages.page_bytes()).collect()
    for r in made:
        name = r.header.payload_digest if r.id != 2 else "0" * 64
        (tmp_path / f"{name}.page").write_bytes(bytes(r.content) if r.id != 3 else bytes(r.content)[:-2])
    (tmp_path / ".tmp.x.page").write_bytes(b"half")
    (tmp_path / "other.txt").write_bytes(b"no page")
    got = {r.name: r.status for r in pages.recover(spark, str(tmp_path)).collect()}
    assert got[made[0].header.payload_digest] == got[made[1].header.payload_digest] == "valid"
    assert got["0" * 64] == "name" and got[made[3].header.payload_digest] == "payload_len"
    line, payload = bytes(made[0].content).split(b"\n", 1)
    assert payload == rows[0][1] and json.loads(line)["payload_len"] == 9


def test_page_store(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = spark.createDataFrame([(b"one", "h"), (b"two", "h"), (b"one", "h")], "payload binary, header string").withColumn("digest", F.sha2("payload", 256))
    tables.write_pages(rows, path)
    tables.write_pages(rows, path)  # again: nothing new
    kept = spark.read.parquet(path)
    assert kept.count() == 2
    digest = rows.first().digest
    assert bytes(tables.read_page(spark, path, digest).first().payload) == b"one" and tables.read_page(spark, path, "0" * 64).count() == 0
    stay, gone = pages.without_pages(kept, spark.createDataFrame([(digest,), ("x",)], "digest string"))
    assert stay.count() == 1 and {r.digest: r.deleted for r in gone.collect()} == {digest: True, "x": False}


def test_found_pages_make_no_pairs_of_a_state(spark):
    """Few states of many pages, places that all ask for and pages that all hold: rows of no join grow beyond the input."""
    n = 2000
    header = "named_struct('component_kind', 'page', 'position_start', {}) as header"
    own = spark.range(n).selectExpr("concat('d', id) as digest", header.format("id"))  # states of many pages, a place each
    first = spark.range(n).selectExpr("concat('e', id) as digest", header.format("-1L"))  # many at one place
    hot = spark.range(1).selectExpr("'hot' as digest", header.format("-2L"))  # one that all hold
    held = spark.range(n).selectExpr("id % 3 as state_id", "concat('d', id) as digest").unionByName(spark.range(n).selectExpr("id as state_id", "concat('e', id) as digest"))
    held = held.unionByName(spark.range(n).selectExpr("id as state_id", "'hot' as digest"))
    asked = spark.range(n).selectExpr("id % 3 as state_id", "'page' as component_kind", "id as position_start")
    for at in (-1, -2):
        asked = asked.unionByName(spark.range(n).selectExpr("id as state_id", "'page' as component_kind", f"{at}L as position_start"))
    found = pages.find_pages(own.unionByName(first).unionByName(hot), asked.unionByName(asked), held)
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}):
        got = found.collect()
        want = {(i % 3, i): f"d{i}" for i in range(n)} | {(i, -1): f"e{i}" for i in range(n)} | {(i, -2): "hot" for i in range(n)}
        assert len(got) == 3 * n and {(r.state_id, r.position_start): r.digest for r in got} == want
        assert most_rows(found) <= 4 * n


def most_rows(df):
    """The most rows that one node of the executed plan gave out."""
    most, left = 0, [df._jdf.queryExecution().executedPlan()]
    while left:
        node = left.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            left.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            left.append(node.plan())
        if node.metrics().contains("numOutputRows"):
            most = max(most, node.metrics().apply("numOutputRows").value())
        left += [node.children().apply(i) for i in range(node.children().size())]
    return most


def test_scan_pages(spark, tmp_path):
    import hashlib

    name = hashlib.sha256(b"abc").hexdigest()
    (tmp_path / f"{name}.page").write_bytes(b"abc")
    (tmp_path / f"{'1' * 64}.page").write_bytes(b"abc")
    (tmp_path / ".tmp.1.page").write_bytes(b"abc")
    assert {r.digest: r.status for r in tables.scan_pages(spark, str(tmp_path)).collect()} == {name: "valid", "1" * 64: "corrupted"}


def test_kv_bytes():
    layers = [(np.arange(4), np.arange(3)), (np.arange(2), np.arange(0))]
    raw = pages.kv_bytes({"a": 1}, layers)
    manifest, back = pages.kv_layers(raw)
    assert manifest == {"a": 1} and all((x == y).all() for a, b in zip(back, layers, strict=True) for x, y in zip(a, b, strict=True))
    for bad in (raw[:5], raw[:-1], raw + b"\0\0\0\0"):
        with pytest.raises(ValueError):
            pages.kv_layers(bad)


def test_corpora(spark, tmp_path):
    shape = {"attention_type": "gqa", "num_layers": 2, "num_heads": 4, "num_kv_heads": 2, "head_dim": 8, "hidden_size": 32}
    token = lambda i: {"id": f"t{i}", "vector": [float(i)] * 64}
    (tmp_path / "one.json").write_text(json.dumps({"shape": shape, "tokens": [token(0), token(1)], "seed": 42}))
    (tmp_path / "many.json").write_text(json.dumps({"shape": shape, "shared_tokens": [token(0)], "agents": [{"id": "a", "tokens": [token(1), token(2)]}, {"id": "b", "tokens": []}]}))
    (tmp_path / "traces.json").write_text(json.dumps([{"trace_id": "x", "layer": 1, "head": 2, "scores": [0.5, 1.5]}]))
    (tmp_path / "bad.json").write_text('{"shape": 3')
    one = tables.read_corpus(spark, str(tmp_path / "one.json"))
    assert [(r.pos, r.id) for r in tables.token_range(one, 1, 5).collect()] == [(1, "t1")]
    assert sorted((r.agent_id or "", r.pos, r.id) for r in tables.read_agents(spark, str(tmp_path / "many.json")).collect()) == [("", 0, "t0"), ("a", 0, "t1"), ("a", 1, "t2")]
    assert tables.read_traces(spark, str(tmp_path / "traces.json")).first().scores == [0.5, 1.5]
    with pytest.raises(Exception):
        tables.read_corpus(spark, str(tmp_path / "bad.json")).collect()
    made = pages.synthetic_tokens(spark, agents=2, shared=3, unique=2, flat=64)
    again = pages.synthetic_tokens(spark, agents=2, shared=3, unique=2, flat=64)
    key = lambda r: (r.agent_id is None, r.agent_id or 0, r.pos)
    assert [r.vector for r in sorted(made.collect(), key=key)] == [r.vector for r in sorted(again.collect(), key=key)] and made.count() == 7
    pages.corpus_of(made.where("agent_id is null").select("pos", "id", "vector"), shape).write.text(str(tmp_path / "lines"))
    back = spark.read.json(str(tmp_path / "lines"))
    assert back.count() == 3 and back.select("shape.head_dim").distinct().first()[0] == 8


def test_lease_failures_are_errors(spark):
    rows = spark.createDataFrame([(1, "Active"), (2, "Expired")], "id int, status string")
    assert statestore.authorize(rows.where("id = 1"), F.col("status")).count() == 1
    with pytest.raises(Exception, match="lease expired"):
        statestore.authorize(rows, F.col("status")).count()


def test_stream_drops_what_is_later_than_its_delay(spark, tmp_path):
    import datetime as dt

    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "ts timestamp, event_id bigint"
    batches = [[(day(0), 1), (day(0), 1), (day(20), 2)], [(day(20), 3)], [(day(1), 4), (day(20), 2), (day(21), 5)]]
    for rows in batches:  # a file a batch
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        once = stream.withWatermark("ts", "2 days").dropDuplicatesWithinWatermark(["event_id"])
        once.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.event_id for r in spark.read.parquet(out).collect()) == [1, 2, 3, 5]
