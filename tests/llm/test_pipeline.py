"""run() of the pipeline stage by stage, op7 and op10 against brute force."""

import random
import re
import zlib

import numpy as np
import xxhash
from test_operators import docs, one_edit, words

import corpus_pipeline
from lumenvec.llm import decontam, packing, quality, substring


def brute_scores(rows, labels):
    """Scores by plain numpy over all rows at once; rows as (id, text)."""
    x, y = np.array([quality.statistics(t) for _, t in rows]), dict(labels)
    held = [zlib.crc32(str(i).encode()) % 5 == 0 for i, _ in rows]
    own = [np.array([v for v, (i, _), h in zip(x, rows, held, strict=True) if not h and i is not None and y.get(i) == k]) for k in (0, 1)]
    n, d = [len(o) for o in own], x.shape[1]
    covs = [np.cov(o.T, bias=True) for o in own]
    pooled = (n[0] * covs[0] + n[1] * covs[1]) / sum(n)
    target = 0.9 * pooled + 0.1 * (np.diag(np.diag(pooled)) + 1e-6 * np.eye(d))

    def z(v):
        logs = []
        for k in (0, 1):
            lean = max(0.1, d / (d + n[k]))
            cov = (1 - lean) * covs[k] + lean * target + 1e-6 * np.eye(d)
            off = v - own[k].mean(0)
            logs.append(np.log(n[k] / sum(n)) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * (off @ np.linalg.inv(cov) * off).sum(1))
        return np.arcsinh(logs[1] - logs[0])

    at = np.stack([np.clip(np.round(z(np.concatenate(own)) * 100), -4000, 4000) / 100, np.ones(sum(n))], 1)
    goal, beta = np.repeat([0.0, 1.0], n), np.array([1.0, 0.0])
    for _ in range(400):
        p = 1 / (1 + np.exp(-at @ beta))
        step = np.linalg.solve((at.T * (p * (1 - p))) @ at + 1e-3 * np.eye(2), at.T @ (goal - p) - 1e-3 * beta)
        beta = beta + np.clip(step, -0.5, 0.5)
    a, b = beta if beta[0] > 0 else (1.0, 0.0)
    return 1 / (1 + np.exp(-(a * z(x) + b)))


def brute_lines(rows):
    lines = [(i, k, x.lower().split()) for i, t in sorted((i, t) for i, t in rows if i is not None and t) for k, x in enumerate(t.split("\n"))]
    lines = [x for x in lines if len(x[2]) >= 3]
    gone = {(i, k) for m, (i, k, w) in enumerate(lines) if any(o == w or (min(len(o), len(w)) >= 8 and one_edit(o, w)) for *_, o in lines[:m])}
    out = []
    for i, t in rows:
        kept = "\n".join(x for k, x in enumerate((t or "").split("\n")) if (i, k) not in gone)
        if t is None or kept == t or kept.strip():
            out.append((i, t if t is None else kept))
    return out


def brute_near(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    up = {i: i for i in sets}
    find = lambda i: i if up[i] == i else find(up[i])
    ids = sorted(i for i in sets if i is not None)
    for m, a in enumerate(ids):
        for b in ids[:m]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return [(i, t) for i, t in rows if i is None or find(i) == i]


def holds(text, item):
    """Whether the item occurs with edits of 5 % of its characters at most."""
    text, item = (text or "").lower().replace("\n", " "), item.lower()
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for k, p in enumerate(item):
            new.append(min(row[k] + (p != c), row[k + 1] + 1, new[k] + 1))
        row, best = new, min(best, new[-1])
    return best <= int(len(item) * decontam.EDIT_RATE)


def broken(text, n):
    w = text.split()
    return "\n".join(" ".join(w[k : k + n]) for k in range(0, len(w), n))


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(4)
    items = [words(rng, 10) for _ in range(2)]
    clean = [broken(words(rng, 70), 14) for _ in range(40)]
    texts = list(clean)
    texts += ["".join(w + "%%% " for w in words(rng, 60).split()) for _ in range(25)]
    for t in clean[:8]:  # near copies, with other line ends
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        texts.append(broken(" ".join(w), 11))
    texts += [words(rng, 30) + "\n" + t.split("\n")[1] + "\n" + words(rng, 30) for t in clean[8:14]]  # repeated lines
    texts += [clean[14].replace(" ", "  ").upper()]  # loses all of its lines
    texts += [words(rng, 30) + " " + items[k % 2].upper() + " " + words(rng, 30) for k in range(3)]
    texts += [words(rng, 40) + " " + items[0][:20] + "#" + items[0][21:]]
    rows = list(enumerate(texts)) + [(900, None), (901, ""), (None, words(rng, 60))]
    labels = [(i, int(not 40 <= i < 65)) for i in range(75)]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, q in labels], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    scores = brute_scores(rows, labels)
    want = [
        [r for r, s in zip(rows, scores, strict=True) if s >= quality.THRESHOLD],
        brute_lines, brute_near, lambda rows: [r for r in rows if not any(holds(r[1], x) for x in items)],
    ]
    data, sf_dir, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path), rows
    order = lambda rows: sorted(rows, key=str)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, data, sf_dir).write.parquet(f"{tmp_path}/{k}")
        data = spark.read.parquet(f"{tmp_path}/{k}")
        before, left = left, want[k](left) if k else want[0]
        assert order((r.doc_id, r.text) for r in data.collect()) == order(left), name
        assert left != before, name

    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(packing.word_bpe_path())
    ids = {i: fresh.encode(t or "", add_special_tokens=False).ids + [1] for i, t in left}
    packed = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert {i: (r.piece, r.length, r.ids_crc32) for i, r in packed.items()} == {i: (0, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ids.items()}


def test_quality_scores(spark):
    rng = random.Random(6)
    texts = [words(rng, rng.randrange(5, 80)) + "%!" * rng.randrange(12 if i % 3 else 30) for i in range(120)]
    labels = [(i, int(bool(i % 3))) for i in range(100)]
    got = {r.doc_id: r for r in quality.classify(docs(spark, texts), spark.createDataFrame(labels, "doc_id bigint, quality int")).collect()}
    want = brute_scores(list(enumerate(texts)), labels)
    assert np.abs(want - [got[i].score for i in range(120)]).max() < 1e-4
    assert all(got[i].predicted == (got[i].score >= quality.THRESHOLD) for i in got)
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)


def brute_units(text):
    at = 0
    for line in text.split("\n"):
        if line.strip():
            yield ("line", *line.lower().split()), at, at + len(line)
        at += len(line) + 1
    found = list(re.finditer(r"\S+", text))
    w = [m[0].lower() for m in found]
    h = [xxhash.xxh3_64_intdigest(x, 2) for x in w]
    g = [((a * 0x9E3779B97F4A7C15) % (1 << 64)) ^ (b >> 7) for a, b in zip(h, h[1:], strict=False)]
    for s in {min(range(i, i + 24), key=lambda j: (g[j], j)) for i in range(len(w) - 25 - 24 + 2)}:
        yield ("span", *w[s : s + 25]), found[s].start(), found[s + 24].end()


def test_substring_units(spark):
    rng = random.Random(8)
    base = [words(rng, rng.choice([1, 3, 12, 60, 150])) for _ in range(30)]
    texts = base + [None, "", " \n \n"] + [a + rng.choice(["\n", " "]) + b.upper() for a, b in (rng.sample(base, 2) for _ in range(30))]
    first, want = {}, set()
    for i, t in enumerate(texts):
        for key, a, b in sorted(brute_units(t or ""), key=lambda u: u[1]):
            if first.setdefault(key, (i, a)) != (i, a):
                want.add((i, a, b, *first[key]))
    got = substring.repeated_units(docs(spark, texts)).select("doc_id", "start", "end", "kept_id", "kept_start").collect()
    assert {tuple(r) for r in got} == want and len(want) > 100
