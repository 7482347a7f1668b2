"""The training-data operators against brute force, round trips and held-out labels."""

import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import chat, decontam, htmltext, licenses, mixing, neardup, quality, secrets, transport
from palimpsest.llm.tokens import tokenised

SF = "/root/testdata/sf0.001"
ODD = "doc_id long, text string, source string, n_chars long, h long, set string, place int, doc_a string, item_id string, copy string, keep string, __s string"
LONG = "lorem ipsum dolor " * 60_000


def odd(spark, texts):
    """Documents with clashing extra columns, nulls among them."""
    rows = [(i, t, s, None if t is None else len(t), None, None, None, "x", None, "y", None, "z") for i, t, s in texts]
    return spark.createDataFrame(rows, ODD)


EDGE = [(1, None, "a"), (2, "", None), (None, "some words here", "a"), (3, "one", None), (4, LONG, "b"), (4, LONG, "b"), (5, "\n\n \t", "b"), (None, None, None)]


@pytest.fixture(scope="module")
def edge(spark):
    return odd(spark, EDGE)


def tokens(text):
    return [h for _, _, t in tokenised(pa.array([text.lower()])) for h in t.hash.tolist()]


# 1


def test_transport_round_trip_and_faults(spark, edge):
    raw = bytes(range(256)) * 90
    media = spark.createDataFrame([(1, bytearray(transport.mux_one(raw)), "x"), (2, bytearray(transport.mux_one(b"")), "x"), (3, None, "x"), (4, bytearray(b"G" * 100), "x"), (5, bytearray(b"noise" * 200), "x"), (None, bytearray(transport.mux_one(b"abc")), "x")], "doc_id long, media binary, pes string")
    got = transport.demux(media).collect()
    ones = [r for r in got if r.doc_id == 1]
    assert all(r.complete and not r.gap for r in ones)
    assert any(r.random_access for r in ones) and all(r.pts is not None for r in ones)
    assert b"".join(bytes(r.data) for r in sorted(ones, key=lambda r: (r.pts, r.pid))) == raw or sorted(b"".join(bytes(r.data) for r in ones)) == sorted(raw)
    assert {r.doc_id for r in got} == {1, None}
    lost = transport.demux(spark.createDataFrame([(1, bytearray(transport.mux_one(raw, lose=11)))], "doc_id long, media binary")).collect()
    assert any(r.gap for r in lost) and any(not r.complete for r in lost)
    assert transport.demux(media.where("doc_id > 9")).collect() == []
    assert transport.demux(transport.mux(edge)).count() > 0


# 2


def test_quality_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    model = quality.train(docs, labels.where(~held))
    got = quality.score(docs.join(labels.where(held), "doc_id"), model).select("quality", "toxic", "keep", "quality_score", "toxic_score").toPandas()
    good = (got.quality == 1) & (got.toxic == 0)
    assert len(got) > 300
    assert (got.keep == good).mean() > 0.9
    assert got.keep[good].mean() > 0.95
    assert (~got.keep[got.toxic == 1]).mean() > 0.9


def test_quality_edges(spark, edge):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for labels in (none, spark.createDataFrame([(4, 1, None), (4, 0, 1), (None, 1, 0), (3, None, 1)], none.schema)):
        model = quality.train(edge, labels)
        got = quality.score(edge, model)
        assert got.count() == len(EDGE)
        assert not any(r.keep for r in got.collect() if not (r.text or "").strip())
        assert quality.score(edge.limit(0), model).collect() == []
    a = quality.Additive(0.5, [np.array([1.0]), np.array([0.0])], [np.array([-1.0, 2.0]), np.array([0.0, 4.0])], [np.array([1.0]), np.array([])], [(0, 1, np.array([[1.0], [8.0]]))])
    assert a.logits(np.array([[0.0, -1.0], [1.0, 1.0]])).tolist() == [0.5, 14.5]


# 3


def test_text_density(spark):
    para = "<p>" + "A long sentence about nothing in particular, with commas. " * 12 + "</p>"
    nav = "<ul>" + "".join(f"<li><a href='/{k}'>Link {k}</a></li>" for k in range(40)) + "</ul>"
    page = f"<html><head><title>T &amp; t</title><script>var x = '<p>no</p>'</script></head><body><div>{nav}</div><div id=m>{para * 4}</div><div>{nav}</div></body></html>"
    rows = [(1, "u", page), (2, "u", None), (3, "u", ""), (None, None, "<p>x"), (4, "u", "<div>" * 3000 + "deep" + "</p>"), (5, "u", "plain text only")]
    got = {r.page_id: r for r in htmltext.extracted(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))).collect()}
    assert len(got) == len(rows)
    assert got[1].title == "T & t" and got[1].text.count("A long sentence") == 48 and "Link" not in got[1].text and "var x" not in got[1].text
    assert (got[2].title, got[2].text, got[3].text) == ("", "", "")
    assert "deep" in got[4].text and "plain text only" in got[5].text
    root, _ = htmltext.parse(page)
    nodes = htmltext.measured(root)
    best = max(htmltext.best_under(htmltext.body_of(root)) is n for n in nodes)
    assert best


# 4


def jaccard_pairs(rows, threshold):
    sets = {}
    for i, t in rows:
        h = tokens(t or "")
        if i is not None and h:
            sets[i] = frozenset(tuple(h[k : k + 3]) for k in range(len(h) - 2)) or frozenset([tuple(h)])
    out = {}
    for a, b in itertools.combinations(sorted(sets), 2):
        j = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
        if j >= threshold:
            out[a, b] = j
    return sets, out


def test_join_against_brute_force(spark):
    rng = np.random.default_rng(2)
    words = [f"w{k}" for k in range(900)]
    rows = []
    for k in range(60):
        base = rng.choice(words, int(rng.integers(20, 120))).tolist()
        for c in range(4):
            copy = [w if rng.random() > 0.06 * c else str(rng.choice(words)) for w in base]
            rows.append((4 * k + c, " ".join(copy)))
    rows += [(1000 + k, "ein zwei") for k in range(5)] + [(1100, None), (1101, ""), (None, rows[0][1]), (1102, "zwei ein"), rows[7]]
    df = odd(spark, [(i, t, "s") for i, t in rows])
    sets, want = jaccard_pairs(rows, 0.5)
    got = {(r.doc_a, r.doc_b): r.jaccard for r in neardup.join(df).collect()}
    assert set(got) <= set(want) and all(abs(got[p] - want[p]) < 1e-12 for p in got)
    first = {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    expected = {p for p in want if (first[sets[p[0]]] == p[0] and first[sets[p[1]]] == p[1]) or (want[p] == 1 and first[sets[p[1]]] == p[0])}
    assert set(got) <= expected and len(got) > 0.9 * len(expected) > 100
    kept = {r.doc_id for r in neardup.one_of_each(df).collect()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in got:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    assert kept == {i for i in sets if find(i) == i} | {1100, 1101, None}


def test_tree_never_drops_a_true_pair():
    rng = np.random.default_rng(4)
    grams = [np.unique(rng.integers(0, 400, int(rng.integers(5, 200)))).astype(np.uint64) for _ in range(150)]
    grams += [np.unique(np.concatenate([g[: int(len(g) * 0.8)], [np.uint64(9999)]])) for g in grams[:60]]
    grams.sort(key=len)
    bits = np.zeros((len(grams), neardup.WORDS * 64), bool)
    for k, g in enumerate(grams):
        bits[k, (g & np.uint64(neardup.WORDS * 64 - 1)).astype(int)] = True
    packed = np.packbits(bits, axis=1).view(np.uint64)
    n = np.array([len(g) for g in grams])
    share = 0.5 / 1.5 - 1e-9
    found = {tuple(sorted(p)) for i, j in neardup.bucket_pairs(n, packed, share) for p in zip(*(x.tolist() for x in neardup._kept(i, j, n, packed, share)))}
    for split in (1, 70, 209):  # two trees
        order = np.concatenate([np.arange(split), split + np.argsort(n[split:], kind="stable")])
        two = {(order[x], order[y]) for i, j in neardup.bucket_pairs(n[order], packed[order], share, split) for x, y in zip(*(v.tolist() for v in neardup._kept(i, j, n[order], packed[order], share)))}
        assert {p for p in found if p[0] < split <= p[1]} <= two
    for a, b in itertools.combinations(range(len(grams)), 2):
        x = len(np.intersect1d(grams[a], grams[b]))
        if x / (len(grams[a]) + len(grams[b]) - x) >= 0.5:
            assert (a, b) in found


def test_join_edges(spark, edge):
    assert neardup.join(edge).collect() == [] and neardup.join(edge.limit(0)).collect() == []
    assert neardup.one_of_each(edge).count() == len(EDGE)
    assert neardup.one_of_each(edge).columns == edge.columns


# 5


def test_mix_is_right_to_one_copy(spark):
    rows = [(k, None, ["a", "b", None][k % 3] if k % 7 else "a", 1 + k % 50) for k in range(900)] + [(None, None, "a", None), (5, None, "z", 0), (5, None, "z", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").withColumns({"copy": F.lit("old"), "weight": F.lit(0), "__key": F.lit(1), "__row": F.lit(2), "a.b": F.lit(3)})
    got = mixing.mix(df).collect()
    size = {}
    count = {}
    for _, _, s, n in rows:
        size[s] = size.get(s, 0) + max(1, n or 0)
        count[s] = count.get(s, 0) + 1
    total, weight = sum(size.values()), {s: c**0.5 for s, c in size.items()}
    for s in size:
        expected = count[s] * total / size[s] * weight[s] / sum(weight.values())
        assert abs(sum(r.source == s for r in got) - expected) <= 1.01
    assert mixing.mix(df.limit(0)).collect() == []
    only = mixing.mix(df, spark.createDataFrame([("b", 1.0)], "source string, weight double")).collect()
    assert {r.source for r in only} == {"b"}


# 6


def test_prefix_targets(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (1, 2, "user", None), (1, 3, "assistant", ""), (2, 0, None, "x"), (None, 0, "assistant", "lost"), (3, None, "assistant", "a"), (3, None, "assistant", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("prompt", F.lit("clash"))
    got = sorted(chat.expand(df).collect(), key=lambda r: (r.conv_id, r.n_context))
    assert [(r.conv_id, r.turn, r.n_context) for r in got] == [(1, 1, 1), (1, 3, 3), (3, None, 0), (3, None, 1)]
    assert got[0].prompt == "<|user|>\nhi<|end|>\n<|assistant|>\n" and got[0].completion == "yo<|end|>"
    for r in got:
        assert (r.prompt + r.completion)[r.train_from : r.train_to] == r.completion
    assert chat.expand(df.limit(0)).collect() == []


# 7


def best_part(equal, least, ratio=0.8):
    """Whether some stretch between equal tokens is long and equal enough, by trying all."""
    at = [k for k, e in enumerate(equal) if e]
    return any(t - s + 1 >= least and sum(equal[s : t + 1]) >= ratio * (t - s + 1) - 1e-9 for s in at for t in at if t >= s)


def leaks_brute(docs, items):
    out = set()
    for (i, t), (k, b) in itertools.product(docs, items):
        if i is None or k is None or not t or not b:
            continue
        x, y = tokens(t), tokens(b)
        if any(best_part([x[d + q] == y[q] for q in range(max(0, -d), min(len(y), len(x) - d))], min(13, len(y))) for d in range(-len(y) + 1, len(x))):
            out.add((i, k))
    return out


def leaky(rng):
    words = [f"v{k}" for k in range(300)]
    items = [(k, " ".join(rng.choice(words, int(rng.integers(14, 50))))) for k in range(8)] + [(8, "p q r s t"), (9, ""), (10, None), (None, "v1 v2 v3 v4 v5"), (3, "w1 w2 w3 w4 w5 w6")]
    docs = []
    for k in range(60):
        own = rng.choice(words, int(rng.integers(5, 60))).tolist()
        if k % 3 == 0:
            q = items[int(rng.integers(0, 8))][1].split()
            own[3:3] = [w if rng.random() > 0.08 else "zz" for w in q]
        docs.append((k, " ".join(own)))
    far = f"a {items[1][1]} b"
    docs += [(100, "a p q r s t b"), (101, None), (102, ""), (None, items[0][1]), (None, "clean"), (103, far), (103, far), (104, items[2][1]), (104, "a clean text"), (105, items[2][1] + " x " + items[2][1])]
    docs += [(106, "e " * 70_000 + items[4][1] + " e" * 70_000)]
    return docs, items


def test_leaks_against_brute_force_by_both_ways(spark):
    docs, items = leaky(np.random.default_rng(9))
    df = odd(spark, [(i, t, "s") for i, t in docs])
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = leaks_brute(docs[:-1], items) | {(106, 4)}
    rows = [sorted(map(tuple, decontam.find_overlaps(df, bench, broadcast_windows=n).collect())) for n in (10**9, 0)]
    assert rows[0] == rows[1]
    got = {r[:2] for r in rows[0]}
    assert got <= want and len(got) >= 0.95 * len(want) >= 15
    assert decontam.find_overlaps(df, bench.limit(0)).collect() == []


@pytest.mark.parametrize("text,item", [("text", "item_id"), ("body", "number")])
def test_rows_without_leaks_are_the_same_by_both_ways(spark, text, item):
    docs, items = leaky(np.random.default_rng(10))
    bad = leaks_brute([(k, t) for k, (_, t) in enumerate(docs[:-1])], items)
    bench = spark.createDataFrame(items, f"{item} long, {text} string")
    df = odd(spark, [(i, t, "s") for i, t in docs]).drop("body").withColumnRenamed("text", text)
    kept = [sorted((str(r.doc_id), str(r[text])) for r in decontam.without_leaks(df, bench, text_col=text, item_col=item, broadcast_windows=n).collect()) for n in (10**9, 0)]
    assert kept[0] == kept[1]
    want = sorted((str(i), str(t)) for k, (i, t) in enumerate(docs[:-1]) if k not in {x for x, _ in bad})
    assert len(want) <= len(kept[0]) <= len(want) + 1 and not set(want) - set(kept[0])
    for x in (df.limit(0), df):
        assert decontam.without_leaks(x, bench.limit(0), text_col=text, item_col=item, broadcast_windows=-1).count() == x.count()
        assert decontam.without_leaks(x, bench.limit(0), text_col=text, item_col=item).columns == df.columns


# 8


def test_linked_secrets(spark, edge):
    key = "AKIA" + "Q7" * 8
    pairs = [
        (1, f"id {key}\nnext"), (2, "user=bob2\npassword: hunter2hunter2"), (3, "mail me at bob@example.org please"),
        (4, "bob@example.org\n" + "0123456789abcdef" * 2), (5, "bob@example.org\n\n" + "0123456789abcdef" * 2), (6, "nothing to see"),
    ]
    df = odd(spark, [(i, t, "s") for i, t in pairs])
    got = {}
    for r in secrets.scan(df).collect():
        got.setdefault(r.doc_id, []).append((r.rule, r.strength))
    assert set(got) == {1, 2, 4}
    assert ("aws_key_id", "strong") in got[1] and ("bare_hex", "weak") in got[4] and ("email", "weak") in got[4]
    clean = {r.doc_id: r for r in secrets.redact(df).collect()}
    assert key not in clean[1].text and "hunter2" not in clean[2].text and clean[3].text == pairs[2][1]
    assert clean[1].n_chars == len(clean[1].text)
    clash = edge.withColumn("__clean", F.lit("c"))
    assert secrets.redact(clash).count() == len(EDGE) and secrets.redact(clash).columns == clash.columns
    assert secrets.redact(edge).count() == len(EDGE) and secrets.scan(edge.limit(0)).collect() == []


def test_links_equal_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(50):
        parts, at = [], 0
        for _ in range(int(rng.integers(0, 12))):
            at += int(rng.integers(1, 300))
            end = at + int(rng.integers(1, 40))
            parts.append((at, end, ["secret", "identifier", "endpoint"][int(rng.integers(0, 3))], "r", "weak"))
            at = end
        want = [[j for j, q in enumerate(parts) if j != i and q[2] != p[2] and "secret" in (p[2], q[2]) and max(p[0], q[0]) - min(p[1], q[1]) <= 200] for i, p in enumerate(parts)]
        assert [sorted(x) for x in secrets.linked(parts, 200)] == want


# 9


def test_licenses_and_their_differences(spark, edge):
    rows = [(1, "Intro.\nLicensed under the Apache License, Version 2.0.\nMore."), (2, "Released under the MIT license"), (3, "I have a driving licence and a cat."), (4, "This work is licensed under the GNU General Public License, version 2."), (5, "This work is licensed under the new General Public License, version 3.")]
    got = {r.doc_id: r for r in licenses.scan(odd(spark, [(i, t, "s") for i, t in rows])).collect()}
    assert {i: r.license for i, r in got.items() if i != 5} == {1: "Apache-2.0", 2: "MIT", 4: "GPL-2.0"}
    assert got[1].exact and got[4].exact and not (5 in got and got[5].exact)
    assert rows[0][1][got[1].char_from : got[1].char_to] == "Licensed under the Apache License, Version 2.0."
    assert licenses.scan(edge).collect() == [] and licenses.scan(edge.limit(0)).collect() == []


# the pipeline


def test_pipeline_stages_keep_columns_and_take_effect(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "mixing sources to target weights"]
    before = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, before, SF).write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert after.columns == docs.columns
        if k < 3:
            assert after.exceptAll(before).isEmpty() and 0 < after.count() <= before.count()
        if k == 1:
            rows = [(r.doc_id, r.text) for r in before.collect()]
            gone = {r.doc_id for r in before.collect()} - {r.doc_id for r in after.collect()}
            assert gone <= {b for _, b in jaccard_pairs(rows, 0.5)[1]}
        if k == 2:
            assert decontam.find_overlaps(after, bench).isEmpty()
        if k == 3:
            assert after.count() == before.count()
        before = after
    assert sorted(map(str, corpus_pipeline.run(spark, SF).collect())) == sorted(map(str, before.collect()))


def test_pipeline_of_nothing_and_of_odd_rows(spark):
    import corpus_pipeline

    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    for rows in ([], [(i, t, "en", s, None if t is None else len(t)) for i, t, s in EDGE]):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert out.count() >= 0 and (rows or out.isEmpty())
            assert set(docs.columns) <= set(out.columns)
