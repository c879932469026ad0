"""The corpus operators against brute-force versions, and their edge cases."""

import gzip
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenvec.llm import decontam, linededup, media, ngramjoin, packing, pii, quality, substring, suffixdedup, warc

SCHEMA = "doc_id bigint, text string, line string, id string"


def docs(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "x", "y") for i, t in zip(ids, texts, strict=True)], SCHEMA)


def words(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    base = [words(rng, rng.choice([1, 2, 5, 12, 30, 70, 150])) for _ in range(40)]
    out = base + [None, "", " \n ", base[5], base[5], "a" * 3000]
    for t in base[:20]:
        w = t.split()
        for _ in range(rng.randrange(1, 3)):
            w[rng.randrange(len(w))] = "changed"
        out.append(" ".join(w))
    out += [base[8] + "\n" + base[9] + "\n" + base[8], "intro " + base[-1] + " outro " + base[-2]]
    return out


def test_pii_matches_plain_patterns():
    rng = random.Random(1)
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }

    def good(kind, s):
        d = re.sub(r"\D", "", s)
        return {"email": True, "ip": all(int(p) <= 255 for p in s.split(".")) if kind == "ip" else 0, "card": 16 <= len(d) <= 19 and pii.luhn(d), "phone": 8 <= len(d) <= 15}[kind]

    for _ in range(3000):
        text = "".join(rng.choice("a@.1+ -9(0)25x%_é") for _ in range(40)) + rng.choice(["", "4041894974608795", "a@b.c@d.e"])
        want = [(k, *m.span()) for k, p in plain.items() for m in re.finditer(p, text) if good(k, m[0])]
        assert [s[:3] for s in pii.spans(text) if s[0] in plain] == want
    assert pii.spans(None) == [] and pii.spans("9" * 100_000) == []
    assert any(s[0] == "iban" for s in pii.spans("GB82 WEST 1234 5698 7654 32"))


def test_iban_before_other_words():
    ibans = ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "NO93 8601 1117 947"]
    for iban in ibans:
        for tail in ("", " BIC COBADEFFXXX", " EUR 500", " X", " 12 34 56 78 90 12 34 56", ", or not", " " + ibans[0], " A" * 40):
            text = "IBAN " + iban + tail
            got = [text[a:b] for k, a, b, _ in pii.spans(text) if k == "iban"]
            assert got == [iban] + ([ibans[0]] if tail.endswith(ibans[0]) else [])
    assert not [s for s in pii.spans("DE88 3704 0044 0532 0130 00 BIC") if s[0] == "iban"]
    assert not [s for s in pii.spans("DE89 3704 0044 0532 0130 00x") if s[0] == "iban"]


def test_media_round_trip(spark, corpus):
    d = docs(spark, corpus)
    items = media.parse_sequences(media.document_html(d), "doc_id", keep=("n_bytes",)).where("kind = 'image'")
    rows = media.resolve(items, media.media_features(media.store_media(media.payloads(d)))).collect()
    assert len(rows) == len(corpus)
    for r in rows:
        raw = (corpus[r.doc_id] or "").encode()
        raw += bytes(-len(raw) % 64 or (64 if not raw else 0))
        assert r.payload_sha256 == hashlib.sha256(raw).hexdigest() and r.payload_bytes == len(raw)
    with pytest.raises(ValueError):
        media.png_decode(media.png_encode(bytes(64))[:-20] + bytes(20))
    assert [i["kind"] for i in media.parse_html("<p>a<img src=u alt=b>c</p>")] == ["text", "image", "text"]


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    p = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[p + 1 :] == b[p + 1 :] or a[p + 1 :] == b[p:] or a[p:] == b[p + 1 :]


def test_line_dedup(spark, corpus):
    lines = [(i, k, x.lower().split()) for i, t in enumerate(corpus) if t for k, x in enumerate(t.split("\n"))]
    lines = [x for x in lines if len(x[2]) >= 3]
    want = {}
    for n, (i, k, w) in enumerate(lines):
        for _, _, o in lines[:n]:
            if o == w or (min(len(o), len(w)) >= 8 and one_edit(o, w)):
                want[i, k] = "exact" if o == w else want.get((i, k), "near")
    got = {(r.doc_id, r.line): r.kind for r in linededup.removed_lines(docs(spark, corpus)).collect()}
    assert got == want
    kept = {r.doc_id: r.text for r in linededup.drop_lines(docs(spark, corpus)).collect()}
    assert kept[0] == corpus[0] and set(kept) >= {i for i, t in enumerate(corpus) if not t}


def test_decontamination(spark):
    rng = random.Random(3)
    item = words(rng, 30)
    k = int(len(item) * decontam.EDIT_RATE)
    edited = list(item)
    for p in rng.sample(range(len(item)), k):
        edited[p] = "#"
    texts = ["x " + item.upper() + " y", "".join(edited), words(rng, 200), None, "", "pre " + item[: len(item) // 2]]
    items = spark.createDataFrame([(7, item), (8, None), (9, " ")], "item_id bigint, text string")
    got = decontam.find_items(docs(spark, texts), items, block_chars=10).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(0, 7), (1, 7)}
    assert {r.distance for r in got if r.doc_id == 0} == {0} and all(r.distance <= k for r in got)
    left = {r.doc_id for r in decontam.drop_contaminated(docs(spark, texts), items).collect()}
    assert left == {2, 3, 4, 5}


def test_warc(spark):
    rows = [(1, "http://a/", "aa"), (2, "http://b/", "bb"), (3, None, "aa"), (4, "http://d/", None), (5, "u", ""), (None, "u", "bb"), (6, "u", "ü" * 100_000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    back = warc.round_trip(pages)
    got = {r.page_id: r for r in back.collect()}
    assert {k: r.record_type for k, r in got.items()} == {1: "response", 2: "response", 3: "revisit", 4: "response", 5: "revisit", None: "response", 6: "response"}
    assert got[3].refers_to == 1 and got[5].refers_to == 4 and got[3].payload_digest == warc.sha1_base32(b"aa")
    assert bytes(got[6].payload).decode() == "ü" * 100_000 and got[5].payload_bytes == 0
    assert back.where("record_type = 'revisit'").count() == 2
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_of_other_writers(spark, tmp_path):
    blocks = {"warcinfo": b"software: x", "request": b"GET / HTTP/1.1", "response": b"HTTP/1.1 200 OK\r\n\r\nabc", "metadata": b"a: b", "resource": b"\x00\xff" * 90_000, "conversion": "ü".encode() * 1000, "revisit": b"HTTP/1.1 304"}
    with open(tmp_path / "a.warc.gz", "wb") as f:
        for kind, block in blocks.items():
            f.write(gzip.compress(f"WARC/1.0\r\nWARC-Type: {kind}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"))
    blocks["revisit"] = None
    got = {r.record_type: r for r in warc.read_archive(spark, str(tmp_path)).collect()}
    assert {k: r.payload and bytes(r.payload) for k, r in got.items()} == blocks
    assert {k: r.payload_bytes for k, r in got.items()} == {k: b and len(b) for k, b in blocks.items()}
    bare = warc.read_archive(spark, str(tmp_path), payload=False).where("record_type = 'conversion'").collect()
    assert [(r.payload, r.payload_bytes) for r in bare] == [(None, 2000)]


def test_packing(spark, corpus):
    path = packing.word_bpe_path()
    out = packing.pack(docs(spark, corpus), path, capacity=64, keep_ids=True).collect()
    whole = {}
    for r in sorted(out, key=lambda r: (r.doc_id, r.piece)):
        whole[r.doc_id] = whole.get(r.doc_id, b"") + bytes(r.ids)
    enc = packing.encoder(path).tokenizer
    for i, t in enumerate(corpus):
        assert [int.from_bytes(whole[i][k : k + 4], "little") for k in range(0, len(whole[i]), 4)] == enc.encode(t or "", add_special_tokens=False).ids + [1]
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        end = 0
        for o, n in sorted(parts):
            assert o == end
            end += n
        assert end <= 64
    assert len(by) <= -(-sum(r.length for r in out) // 64) * 1.1 + 1


def test_packing_of_added_tokens():
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(packing.word_bpe_path())
    texts = ["a<|endoftext|>b", "x\n<|startoftext|> y  <|endoftext|><|endoftext|>.", "<|EndOfText|> <|endof text|>", "plain\ttext é", ""]
    for text, ids in zip(texts, packing.encoder(packing.word_bpe_path()).encode(texts), strict=True):
        assert [int.from_bytes(ids[k : k + 4], "little") for k in range(0, len(ids), 4)] == fresh.encode(text, add_special_tokens=False).ids


def test_quality(spark):
    rng = random.Random(2)
    texts = [words(rng, 60) if i % 3 else "".join(w + "%%% " for w in words(rng, 60).split()) for i in range(90)] + [None, ""]
    labels = spark.createDataFrame([(i, int(bool(i % 3))) for i in range(90)] + [(None, 1), (500, 0), (3, None)], "doc_id bigint, quality int")
    got = {r.doc_id: r for r in quality.classify(docs(spark, texts), labels).collect()}
    assert len(got) == 92 and all(0 <= r.score <= 1 for r in got.values())
    assert sum(got[i].predicted == bool(i % 3) for i in range(90)) >= 85
    none = quality.classify(docs(spark, texts), labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}


@pytest.mark.parametrize("n, percent, block", [(3, 90, 2000), (5, 80, 2000), (3, 60, 3)])
def test_ngram_join(spark, corpus, n, percent, block):
    sets = []
    for t in corpus:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()})
    up = list(range(len(sets)))
    find = lambda i: i if up[i] == i else find(up[i])
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                up[y] = x
    got = {r.doc_id: r for r in ngramjoin.similar_documents(docs(spark, corpus), n=n, percent=percent, family_block=block).collect()}
    assert {i: r.component_id for i, r in got.items()} == {i: find(i) for i in range(len(up))}
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in enumerate(sets)}


@pytest.mark.parametrize("how", [{}, {"hot_contents": 1}, {"report_length": 60}])
def test_suffix_dedup(spark, corpus, how):
    length, raws = 60, [(t or "").encode() for t in corpus]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    got = {r.doc_id: r for r in suffixdedup.dedup_substrings(docs(spark, corpus), **{"length": length, "report_length": 40, "gram": 12} | how).collect()}
    for n, r in enumerate(raws):
        gone = set()
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone.update(range(i, i + length))
        kept = bytes(b for i, b in enumerate(r) if i not in gone)
        spans = sum(i - 1 not in gone for i in gone)
        assert (got[n].n_bytes, got[n].n_removed, got[n].n_spans, got[n].kept_sha256) == (len(r), len(gone), spans, hashlib.sha256(kept).hexdigest())


def test_substring_dedup(spark):
    rng = random.Random(9)
    passage, line = words(rng, 55), words(rng, 9)
    texts = [words(rng, 80) + " " + passage, line, "pre fix " + passage + " " + words(rng, 60), line.upper() + "\nnew", words(rng, 100), None, ""]
    removed = substring.removed_spans(substring.repeated_units(docs(spark, texts)))
    got = {r.doc_id: r for r in removed.collect()}
    assert set(got) == {2, 3} and got[2].kept_ids == [0] and got[3].kept_ids == [1]
    s = got[2].spans[0]
    assert texts[2][s.start : s.end] in passage and s.end - s.start > 25
    left = {r.doc_id: r.text for r in substring.remove_spans(docs(spark, texts), removed).collect()}
    assert left[3] == "\nnew" and left[4] == texts[4]


def test_substring_short_lines(spark):
    texts = ["}\nall rights reserved.\n\n", "one\nAll  rights reserved.\n \n", "two\n}\n}"]
    removed = substring.removed_spans(substring.repeated_units(docs(spark, texts)))
    left = {r.doc_id: r.text for r in substring.remove_spans(docs(spark, texts), removed).collect()}
    assert left == {0: texts[0], 1: "one\n\n \n", 2: "two\n\n"}


def test_substring_spans_leave_no_holes(spark):
    rng = random.Random(11)
    for _ in range(20):
        text = words(rng, 600)
        found = sorted((a, b) for a, b, *_ in substring.cut(text)[1:])  # the first is the line
        assert all(a < end for (_, end), (a, _) in zip(found, found[1:], strict=False))
        assert len(text[: found[0][0]].split()) <= 23 and len(text[found[-1][1] :].split()) <= 23


@pytest.mark.parametrize("key", [None, 7])
def test_substring_rows_without_an_id_of_their_own(spark, key):
    shared = "a line that two texts begin with"
    texts = [shared + "\none", shared + "\ntwo", "other text\nthat repeats nothing at all", "pad\n" + shared]
    d = docs(spark, texts, [key] * 4)
    removed = substring.removed_spans(substring.repeated_units(d))
    left = sorted(r.text for r in substring.remove_spans(d, removed).collect())
    assert sum(t.count(shared) for t in left) == 1 and texts[2] in left
    assert sorted(t.replace(shared, "") for t in left) == sorted(t.replace(shared, "") for t in texts)


def test_empty_table(spark, corpus):
    none = docs(spark, corpus).limit(0)
    assert pii.pii_digest(none).count() == 0
    assert linededup.removed_lines(none).count() == 0
    assert ngramjoin.similar_documents(none).count() == 0
    assert suffixdedup.dedup_substrings(none).count() == 0
    assert substring.removed_spans(substring.repeated_units(none)).count() == 0
    assert packing.pack(none, packing.word_bpe_path()).count() == 0


def test_null_ids_and_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(80))
    d = docs(spark, [text, text, text, "short"], [None, 4, 4, 5])
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in ngramjoin.similar_documents(d).collect())
    assert got == [(-1, -1), (4, 4), (4, 4), (5, 5)]
    assert linededup.drop_lines(d).count() == 4
    assert substring.repeated_units(d).select(F.count("*")).first()[0] >= 1


def test_media_columns_against_plain_python(spark):
    import math
    import struct
    import zlib

    texts = ["", None, "a", "x" * 63, "x" * 64, "é" * 33, "long " * 40_000, "a"]
    d = docs(spark, texts, [None, 1, 2, 3, 4, 5, 6, 2])
    items = media.parse_sequences(media.document_html(d), "doc_id", keep=("n_bytes",)).where("kind = 'image'")
    rows = media.resolve(items, media.media_features(media.store_media(media.payloads(d)))).collect()
    assert len(rows) == len(texts)
    want = Counter()
    for i, t in zip([None, 1, 2, 3, 4, 5, 6, 2], texts, strict=True):
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 or 64 * (not raw))
        grid = b"".join(b"\0" + payload[k : k + 64] for k in range(0, len(payload), 64))
        chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
        png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 64, len(payload) // 64, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(grid, 6)) + chunk(b"IEND", b"")
        n = len(payload)
        mean = sum(payload) / n
        std = math.sqrt(sum((b - mean) ** 2 for b in payload) / n)
        bits = -sum(c / n * math.log2(c / n) for c in Counter(payload).values()) + 0.0
        want[(i, len(raw), n, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(png), hashlib.sha256(png).hexdigest(), f"h={n // 64};mean={mean:.4f};std={std:.4f};entropy={bits:.4f}")] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256, r.feature) for r in rows) == want


def test_html_items():
    items = media.parse_html("<figure><img src=a><figcaption>first<p>after</p><img src=b alt=c></figure><p>end")
    assert [(i["kind"], i["text"] or i["ref"], i["caption"]) for i in items] == [("image", "a", "first"), ("text", "after", None), ("image", "b", "first"), ("text", "end", None)]
    assert [i["caption"] for i in media.parse_html("<figure><img src=a><figcaption>open")] == ["open"]
    assert media.parse_html("<script>x</script><style>y</style>") == [] and media.parse_html("<p>a<br>b")[1]["text"] == "b"


def test_real_pages_are_sequences(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    items = media.parse_sequences(pages).collect()
    by = {}
    for r in items:
        by.setdefault(r.page_id, []).append(r.position)
    assert by and all(sorted(p) == list(range(len(p))) for p in by.values())
    assert all(r.text.strip() for r in items if r.kind == "text")


def test_several_records_in_a_gzip_member(spark, tmp_path):
    record = lambda kind, block: f"WARC/1.0\r\nWARC-Type: {kind}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    blocks = [b"one", b"", b"\r\n\r\nthree\r\n\r\n", b"x" * 200_000]
    with open(tmp_path / "a.warc.gz", "wb") as f:
        f.write(gzip.compress(b"".join(record("resource", b) for b in blocks)) + gzip.compress(record("metadata", b"five")))
    got = [bytes(r.payload) for r in warc.read_archive(spark, str(tmp_path)).collect()]
    assert got == [*blocks, b"five"]
    assert warc.read_archive(spark, str(tmp_path), payload=False).where("record_type = 'metadata'").count() == 1
    assert [r.payload_bytes for r in warc.read_archive(spark, str(tmp_path)).select("payload_bytes").collect()] == [len(b) for b in [*blocks, b"five"]]


def test_damaged_payloads_are_errors(spark, tmp_path):
    row = {"payload": b"abc", "payload_digest": warc.sha1_base32(b"abd"), "payload_bytes": None, "record_type": "response", "page_id": 1, "target_uri": None, "refers_to": None}
    (tmp_path / "a.warc.gz").write_bytes(warc.gzip_member(warc.record_bytes(row, "1970-01-01T00:00:00Z")))
    with pytest.raises(Exception, match="does not have its digest"):
        warc.read_archive(spark, str(tmp_path)).collect()
    assert warc.read_archive(spark, str(tmp_path), payload=False).first().payload is None


def test_warc_against_plain_python(spark):
    rng = random.Random(4)
    rows = [(i, f"u{i}", rng.choice([None, "", "a", "b" * 500, f"own {i}", "é"]), "clash") for i in range(80)]
    rng.shuffle(rows)
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, payload string")
    first = {}
    for i, _, html, _ in sorted(rows):
        first.setdefault(html or "", i)
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()}
    want = {}
    for i, _, html, _ in rows:
        raw, f = (html or "").encode(), first[html or ""]
        want[i] = (len(raw), warc.sha1_base32(raw), "response" if f == i else "revisit", None if f == i else f)
    assert got == want


def test_decontamination_against_plain_distance(spark):
    rng = random.Random(12)
    items = [(i, words(rng, n)) for i, n in enumerate((3, 6, 10))]
    texts = []
    for k in range(30):
        text = list(rng.choice(items)[1])
        for _ in range(k % 6):
            at = rng.randrange(len(text))
            rng.choice([lambda: text.insert(at, "q"), lambda: text.pop(at), lambda: text.__setitem__(at, "q")])()
        texts.append(words(rng, rng.randrange(0, 6)) + " " + "".join(text) + " " + words(rng, rng.randrange(0, 6)))

    def best(text, item):
        row, least = list(range(len(item) + 1)), len(item)
        for c in text.lower():
            new = [0]
            for k, p in enumerate(item):
                new.append(min(row[k] + (p != c), row[k + 1] + 1, new[k] + 1))
            row, least = new, min(least, new[-1])
        return least

    want = {(i, j) for i, t in enumerate(texts) for j, item in items if best(t, item.lower()) <= int(len(item) * decontam.EDIT_RATE)}
    test = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id int, text string, doc_id string")
    got = decontam.find_items(docs(spark, texts), test).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and 5 < len(want) < 85
    assert {r.doc_id for r in decontam.drop_contaminated(docs(spark, texts), test).collect()} == set(range(30)) - {i for i, _ in want}


@pytest.mark.parametrize("kind", ["int", "bigint", "string"])
def test_ids_of_any_type(spark, kind):
    text = " ".join(f"w{i}" for i in range(60))
    near, far = text.replace("w7 ", "x "), " ".join(f"v{i}" for i in range(60))
    d = spark.createDataFrame([(1, text), (2, near), (3, far), (None, far)], "doc_id bigint, text string").withColumn("doc_id", F.col("doc_id").cast(kind))
    got = {(r.doc_id, r.component_id) for r in ngramjoin.similar_documents(d, percent=80).collect()}
    one, two, three = (spark.range(1).select(F.lit(i).cast(kind)).first()[0] for i in (1, 2, 3))
    assert got == {(one, one), (two, one), (three, three), (None, None)}
    assert {r.doc_id for r in packing.pack(d, packing.word_bpe_path()).collect()} == {one, two, three, None}
    for rows in (pii.pii_digest(d), suffixdedup.dedup_substrings(d), media.parse_sequences(media.document_html(d), "doc_id")):
        assert {r.doc_id for r in rows.collect()} == {one, two, three, None}
    assert {r.doc_id for r in linededup.drop_lines(d).collect()} == {one, three, None}  # the only line of the second goes


def test_sets_of_one_id_are_told_apart(spark):
    rng = random.Random(21)
    a, b = words(rng, 80), words(rng, 80)
    swap = lambda t: t.replace(t.split()[40], "changed", 1)
    d = docs(spark, [a, b, swap(a), swap(b), words(rng, 80)], [1, 1, 2, 3, 4])
    got = sorted((r.doc_id, r.component_id) for r in ngramjoin.similar_documents(d, percent=80).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]
    assert sorted(r.doc_id for r in ngramjoin.keep_one(d, percent=80).collect()) == [1, 1, 4]


def test_hot_lists_are_tied_across_tasks(spark):
    rng = random.Random(22)
    base = words(rng, 60).split()
    texts = []
    for i in range(90):  # near copies: one list holds nearly all of them
        w = list(base)
        w[rng.randrange(60)] = f"x{i}"
        texts.append(" ".join(w))
    got = {r.component_id for r in ngramjoin.similar_documents(docs(spark, texts), n=1, percent=90, family_block=7).collect()}
    assert got == {0}


def chained(rng, n):
    """Texts of 60 words that share half of them with the next one: none link at 80 %."""
    parts = [words(rng, 30) for _ in range(n + 1)]
    return [f"{a} {b}" for a, b in zip(parts, parts[1:], strict=False)]


@pytest.mark.parametrize("list_members", [ngramjoin.LIST_MEMBERS, 2])
def test_shared_blocks_alone_make_no_family(spark, monkeypatch, list_members):
    rng = random.Random(23)
    texts = chained(rng, 80)
    hot = words(rng, 30)
    for _ in range(15):  # one passage in lists with pairs that link, whose head links with none
        w = f"{hot} {words(rng, 30)}".split()
        texts += [" ".join(w), " ".join(w[:45] + ["changed"] + w[46:])]
    rows, places, candidates = [], ngramjoin.places, ngramjoin.candidates
    monkeypatch.setattr(ngramjoin, "candidates", lambda *a: candidates(*a, list_members=list_members))
    monkeypatch.setattr(ngramjoin, "places", lambda member, *a: (rows.append(member.count()), places(member, *a))[1])
    got = {r.doc_id: r.component_id for r in ngramjoin.similar_documents(docs(spark, texts), n=5, percent=80).collect()}
    assert got == {i: i if i < 80 else i - i % 2 for i in range(110)}
    assert 30 <= rows[0] < 40 or list_members == 2


def test_sketches_keep_what_links():
    rng = np.random.default_rng(24)
    for percent in (80, 90):
        kept = 0
        for size in [15, 40, 63, 64, 65, 200, 1000, 1030, 5000] * 20:
            a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
            out, extra = int(rng.integers(0, size // 4)), int(rng.integers(0, size // 4))
            b = np.unique(np.concatenate([a[out:], rng.integers(0, 1 << 63, extra, dtype=np.uint64)]))
            o = len(np.intersect1d(a, b))
            near = bool(ngramjoin.told_apart([ngramjoin.sketch(a), ngramjoin.sketch(b)], percent))
            assert near or 100 * o < percent * (len(a) + len(b) - o)
            other = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
            kept += bool(ngramjoin.told_apart([ngramjoin.sketch(a), ngramjoin.sketch(other)], percent))
        assert kept < 5


def test_periodic_and_very_long_texts(spark):
    texts = ["a" * 300_000, "ab" * 60_000, "=-" * 50 + "\n", " ".join(f"w{i}" for i in range(120_000))]
    d = docs(spark, texts)
    got = {r.doc_id: r for r in suffixdedup.dedup_substrings(d).collect()}
    assert [got[i].n_removed for i in range(4)] == [300_000, 120_000, 0, 0] and got[0].n_spans == 1
    assert linededup.removed_lines(d).count() == 0
    assert {r.component_id for r in ngramjoin.similar_documents(d).collect()} == {0, 1, 2, 3}
    assert substring.repeated_units(d).where("doc_id = 3").count() == 0
    assert quality.classify(d, spark.createDataFrame([(0, 1)], "doc_id bigint, quality int")).count() == 4
    pieces = packing.pack(d, packing.word_bpe_path()).where("doc_id = 3").collect()
    assert sum(r.length for r in pieces) > 200_000 and all(r.length == packing.CAPACITY for r in pieces if r.piece < len(pieces) - 1)


def test_empty_tables_of_all_operators(spark, corpus):
    none = docs(spark, corpus).limit(0)
    labels = spark.createDataFrame([(1, 1)], "doc_id bigint, quality int")
    items = spark.createDataFrame([(1, "text of an item")], "item_id bigint, text string")
    assert media.media_features(media.store_media(media.payloads(none))).count() == 0
    assert media.parse_sequences(media.document_html(none), "doc_id").count() == 0
    assert decontam.find_items(none, items).count() == decontam.drop_contaminated(none, items).count() == 0
    assert quality.classify(none, labels).count() == quality.keep_good(none, labels).count() == 0
    some = docs(spark, corpus)
    assert decontam.find_items(some, items.limit(0)).count() == 0 and decontam.drop_contaminated(some, items.limit(0)).count() == len(corpus)
    assert quality.keep_good(some, labels.limit(0)).count() == len(corpus)
    assert linededup.drop_lines(none).count() == ngramjoin.keep_one(none).count() == 0


def test_secrets_and_scores():
    key = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce"
    found = pii.spans(f'api key "{key}" and "{"ab" * 20}" and "{"1" * 40}"')
    assert [(k, s) for k, _, _, s in found] == [("secret", 0.8)]
    alone = {k: s for k, _, _, s in pii.spans("x 10.0.0.1 y")}
    near = {k: s for k, _, _, s in pii.spans("the server address 10.0.0.1")}
    assert near["ip"] > alone["ip"]


def test_scratch_scope_removes_what_operators_wrote(spark, corpus, tmp_path):
    import os

    from lumenvec.llm.common import scratch_scope, shared_dir

    before = set(os.listdir(shared_dir(spark).removeprefix("file://")))
    with scratch_scope(spark):
        assert ngramjoin.similar_documents(docs(spark, corpus)).count() == len(corpus)
        assert set(os.listdir(shared_dir(spark).removeprefix("file://"))) != before
    assert set(os.listdir(shared_dir(spark).removeprefix("file://"))) == before


def test_plain_words_are_cut_as_the_tokenizer_does():
    """Every plain character alone, and every pair of kinds of them, against the unaltered tokenizer."""
    from tokenizers import Tokenizer

    own, fresh = packing.WordEncoder(packing.word_bpe_path()), Tokenizer.from_file(packing.word_bpe_path())
    plain = [c for c in map(chr, range(33, 0x180)) if own._PLAIN.fullmatch(c)]
    assert len(plain) > 200
    some = [c for c in plain if c in "aZz09'\"-_.,!?~@#sStTrRvVmMlLdDeEÀßéÿĀİıŉſ"]
    words_ = plain + [a + b for a in plain for b in some] + [a + "'" + b + c for a in "aZ9!" for b in "sStrvmld" for c in "aeltz' 1"]
    got = own.encode(words_)
    for word, ids, want in zip(words_, got, fresh.encode_batch(words_, add_special_tokens=False), strict=True):
        assert [int.from_bytes(ids[k : k + 4], "little") for k in range(0, len(ids), 4)] == want.ids, word


def test_contents_of_one_minimiser_are_one_suffix_array():
    """Merging levels of 60,000 bytes took over 10 ms a content; one array of the key, split over slices, finds the same."""
    rng = np.random.default_rng(3)
    base = rng.integers(97, 123, 584, np.uint8)
    raws = []
    for _ in range(300):
        text = base.copy()
        text[rng.integers(0, 584, 2)] = rng.integers(97, 123, 2)
        raws.append(text.tobytes())
    n = len(raws)
    columns = [np.repeat([7, 8], n), np.zeros(2 * n, bool), np.ones(2 * n, bool), np.zeros(2 * n, int), np.arange(2 * n), np.zeros(2 * n, np.int32), np.full(2 * n, 184, np.int32)]
    both = raws + [bytes(255 - x for x in r) for r in raws]
    batch = pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), pa.array(both, pa.binary())], schema=suffixdedup._CONTENT)
    runs = list(suffixdedup._whole_keys(iter([batch.slice(i, 77) for i in range(0, 2 * n, 77)])))
    assert [len(r[0]) for r in runs] == [n, n] and [x for r in runs for x in r[1]] == both
    for depth in (216, 400):
        windows = [[r[i : i + depth] for i in range(185)] for r in raws]
        seen = Counter(w for row in windows for w in row)
        shard = suffixdedup._Shard((depth,))
        shard.add(raws, *(np.zeros(n, int), np.arange(n), np.zeros(n, int), np.full(n, 184)), np.ones(n, bool))
        assert len(shard.families[0].levels) == 1
        got = sum(b - a + 1 for r in shard.ranges() for a, b in zip(r.column("lo").to_pylist(), r.column("hi").to_pylist(), strict=True))
        assert got == sum(seen[w] > 1 for row in windows for w in row) > 0
