"""The whole pipeline against one that does every stage by brute force, a text and a pair at a time."""

import hashlib
import itertools
import math

import numpy as np
import pyarrow as pa
import pytest

from palimpsest.llm import mixing, quality, secrets
from palimpsest.llm.tokens import tokenised

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    """(hash, bytes) of each token."""
    out = []
    for _, _, t in tokenised(pa.array([text])):
        out += [(int(h), int(b - a)) for h, a, b in zip(t.hash, t.start, t.end)]
    return out


def features(text, model):
    raw, w = text.encode(), words(text)
    n, some = max(1, len(raw)), max(1, len(w))
    count = lambda cls: sum(b in cls for b in raw) / n
    toxic = sum(h in set(model.toxic.tolist()) for h, _ in w)
    return [
        math.log1p(len(w)), sum(s for _, s in w) / some, *(count(c) for c in (b"%$#&*@^~=<>{}[]\\/+_`", b"|", b"!?", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"\n", b".,;:")),
        sum(s <= 3 for _, s in w) / some, len({h for h, _ in w}) / some, sum(h in set(model.bad.tolist()) for h, _ in w) / some, toxic / some, toxic,
    ]


def probability(m, x):
    s = m.bias
    place = lambda cuts, v: sum(v >= c for c in cuts)
    for cuts, table, v in zip(m.cuts, m.tables, x):
        s += table[place(cuts, v)]
    for a, b, table in m.pairs:
        s += table[place(m.coarse[a], x[a]), place(m.coarse[b], x[b])]
    return 1 / (1 + math.exp(-min(40, max(-40, s))))


def grams(text):
    h = [x for x, _ in words(text.lower())]
    return frozenset(tuple(h[k : k + 3]) for k in range(len(h) - 2)) or frozenset([tuple(h)] if h else [])


def leaks(text, items):
    x = [h for h, _ in words((text or "").lower())]
    for _, item in items:
        y = [h for h, _ in words((item or "").lower())]
        least = min(13, len(y))
        for d in range(-len(y) + 1, len(x)):
            equal = [x[d + q] == y[q] for q in range(max(0, -d), min(len(y), len(x) - d))]
            at = [k for k, e in enumerate(equal) if e]
            if len(y) >= 4 and any(t - s + 1 >= least and sum(equal[s : t + 1]) >= 0.8 * (t - s + 1) - 1e-9 for s in at for t in at if t >= s):
                return True
    return False


def redacted(text):
    taken = []
    for kind, rule, strength, pattern in secrets._RULES:
        for m in pattern.finditer(text):
            a, b = m.span(m.lastindex or 0)
            if not any(a < t[1] and t[0] < b for t in taken):
                v = text[a:b]
                taken.append((a, b, kind, strength or ("strong" if len(v) >= 8 and any(c.isdigit() for c in v) and secrets.entropy(v) >= 2.5 else "weak")))
    scope = lambda p: len([m for m in secrets._BLANK.finditer(text) if m.start() <= p[0]])
    linked = lambda p: any(q[2] != p[2] and "secret" in (q[2], p[2]) and scope(q) == scope(p) and max(p[0], q[0]) - min(p[1], q[1]) <= secrets.GAP for q in taken)
    for a, b, kind, _ in sorted((p for p in taken if p[2] != "endpoint" and (p[3] == "strong" or linked(p))), reverse=True):
        text = f"{text[:a]}[{kind}]{text[b:]}"
    return text


def brute(docs, items, model):
    kept = []
    for d in docs:
        if d[1] and d[1].strip() and words(d[1]):
            x = features(d[1], model)
            if round(probability(model.quality, x), 9) >= 0.5 and round(probability(model.toxicity, x), 9) < 0.5:
                kept.append(d)
    root = {d[0]: d[0] for d in kept}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = [(d[0], grams(d[1])) for d in kept]
    for (i, g), (k, h) in itertools.combinations(sets, 2):
        if g and h and len(g & h) / len(g | h) >= 0.5:
            a, b = sorted((find(i), find(k)))
            root[b] = a
    kept = [d for d in kept if find(d[0]) == d[0]]
    kept = [d for d in kept if not leaks(d[1], items)]
    kept = [(d[0], r, d[2], d[3], len(r) if r != d[1] else d[4]) for d in kept for r in [redacted(d[1])]]
    size = {}
    for d in kept:
        size[d[3]] = size.get(d[3], 0) + max(1, d[4] or 1)
    weight = {s: math.floor(math.sqrt(c) * 1024) for s, c in size.items()}
    out = []
    for s in size:
        factor = sum(size.values()) * 1.0 / (size[s] * (1 << 20)) * (weight[s] / sum(weight.values())) * float(mixing.ONE)
        unit = math.floor((1 << 20) * factor)
        u = int(hashlib.sha256(f"mix-1:={s}".encode()).hexdigest()[:8], 16)
        own = sorted((d for d in kept if d[3] == s), key=lambda d: (int(hashlib.sha256(str(d[0]).encode()).hexdigest()[:8], 16) % mixing.BUCKETS, d[0]))
        for k, d in enumerate(own):
            out += [(*d, c + 1) for c in range(((k + 1) * unit + u) // mixing.ONE - (k * unit + u) // mixing.ONE)]
    return sorted(out)


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(12)
    vocab = [f"{a}{b}" for a in ("ba", "ke", "lo", "mi", "tu", "son", "ter", "van") for b in ("ra", "nel", "dos", "pi", "kum", "th", "sel", "ga", "")]
    text = lambda n: " ".join(rng.choice(vocab, n)).capitalize() + "."
    items = [(k, text(24)) for k in range(4)]
    docs = []
    for k in range(160):
        t = text(int(rng.integers(30, 90)))
        if k % 4 == 3:
            t = "|".join(rng.choice(["$$", "BUY!!", "win#", "100%", "free"], 40)) + " " + " ".join(rng.choice(["hateful", "vile"], 6))
        if k % 12 == 1 and k:
            t = docs[k - 1][1].replace(" ", " zz ", 1)  # a near copy
        if k % 20 == 2:
            t = f"{t} {items[k % 3][1]} {text(5)}"
        if k % 16 == 5:
            t = f"{t}\nuser = bob{k}\npassword: hunter2hunter{k}\n"
        docs.append((k * 3, t, "en", ["a", "b", "a", "c"][k % 4 if k % 5 else 0], len(t)))
    docs += [(1000, None, "en", "a", None), (1001, "", "en", "b", 0), (1002, " \n", "en", "b", 2)]
    labels = [(d[0], 0 if "|" in (d[1] or "") else 1, 1 if "vile" in (d[1] or "") else 0) for d in docs[:160] if d[0] % 5]
    return docs, labels, items


def test_run_equals_brute_force(spark, tmp_path, corpus):
    import corpus_pipeline

    docs, labels, items = corpus
    frame = spark.createDataFrame(docs, SCHEMA)
    frame.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    model = quality.train(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    want = brute(docs, items, model)
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == want
    ids = {r[0] for r in got}
    assert 40 < len(ids) < 130 and any("[secret]" in r[1] for r in got) and not any("hunter2" in r[1] or "|" in r[1] for r in got)


def test_scores_equal_brute_force(spark, corpus):
    docs, labels, _ = corpus
    model = quality.train(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert model.quality.tables and model.quality.pairs
    got = {r.doc_id: r for r in quality.score(spark.createDataFrame(docs, SCHEMA), model).collect()}
    for d in docs:
        if d[1] and words(d[1]):
            x = features(d[1], model)
            assert got[d[0]].quality_score == pytest.approx(probability(model.quality, x), abs=1e-8)
            assert got[d[0]].toxic_score == pytest.approx(probability(model.toxicity, x), abs=1e-8)


def test_clashing_columns_and_odd_rows_pass_all_stages(spark, tmp_path, corpus):
    import corpus_pipeline

    docs, labels, items = corpus
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(*d, "x", 1, None, "k", "s") for d in [*docs[:12], docs[0], (None, docs[4][1], None, None, None), (None, None, None, None, None), (7, "word " * 200_000, "en", None, None)]]
    frame = spark.createDataFrame(rows, SCHEMA + ", keep string, class_id int, item_id long, `a.b` string, __gone string")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, frame, str(tmp_path))
        assert out.columns == frame.columns + (["copy"] if k == 4 else [])
        out.write.parquet(f"{tmp_path}/{k}")
        frame = spark.read.parquet(f"{tmp_path}/{k}")
