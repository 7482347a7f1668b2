"""The registered join against all pairs by brute force, copies of copies among them."""

import itertools

import numpy as np
import pyarrow as pa
import pytest

from palimpsest.llm import neardup, queries
from palimpsest.llm.tokens import tokenised


def grams(text):
    h = [x for _, _, t in tokenised(pa.array([text.lower()])) for x in t.hash.tolist()]
    return frozenset(tuple(h[k : k + 3]) for k in range(len(h) - 2)) or frozenset([tuple(h)] if h else [])


def brute(rows, threshold=0.5):
    """(doc_id, class_id, copy_of, n_copies, n_links) of every document with a link."""
    texts = {}
    for i, t in rows:
        if i is not None and t and (g := grams(t)):
            texts.setdefault(i, set()).add(g)
    flat = sorted({(i, g) for i, gs in texts.items() for g in gs}, key=lambda x: (x[0], len(x[1])))
    root, copies, links, first = {i: i for i in texts}, dict.fromkeys(texts, 0), dict.fromkeys(texts, 0), {}
    for i, g in flat:
        first[g] = min(first.get(g, i), i)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, g), (k, h) in itertools.combinations(flat, 2):
        if len(g & h) / len(g | h) < threshold:
            continue
        x, y = sorted((find(i), find(k)))
        root[y] = x
        for z in (i, k):
            if g == h:
                copies[z] += 1
            else:
                links[z] += 1
    return {(i, find(i), min(first[g] for g in texts[i]), copies[i], links[i]) for i in texts if copies[i] or links[i]}


def near_copies(rng, groups=25):
    words = [f"w{k}" for k in range(900)]
    rows = []
    for k in range(groups):
        base = rng.choice(words, int(rng.integers(20, 120))).tolist()
        near = [w if rng.random() > 0.02 else str(rng.choice(words)) for w in base]
        for t in [base] * (11 if k < 3 else 3) + [near] * (6 if k < 3 else 2):
            rows.append((len(rows), " ".join(t)))
    return rows


def test_classes_and_links_against_brute_force(spark, tmp_path):
    rows = near_copies(np.random.default_rng(8))
    rows.append(rows[5])
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = [tuple(r) for r in queries.op4_signature_tree_join(spark, str(tmp_path)).collect()]
    want = brute(rows)
    assert len(found) == len(set(found)) and len(want) > 100
    assert len(set(found) & want) >= 0.97 * len(want) and {r[0] for r in found} <= {r[0] for r in want}


@pytest.mark.parametrize("block", [12])
def test_cut_buckets_and_places_give_the_same(spark, monkeypatch, block):
    """One group of many different near copies, whose bucket and place are cut to cells of a few sets."""
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(2000)]
    base = rng.choice(words, 150).tolist()
    rows = [(k, " ".join(w if rng.random() > 0.02 else str(rng.choice(words)) for w in base)) for k in range(90)]
    rows += [(100 + k, rows[k][1]) for k in range(0, 90, 9)] + [(300, "short text"), (301, "short text")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {tuple(r) for r in neardup.classes(df).collect()}
    pairs = {tuple(r) for r in neardup.join(df).collect()}
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "PLACE_GRAMS", 400 * block)
    monkeypatch.setattr(neardup, "SLICE", 2)
    assert {tuple(r) for r in neardup.classes(df).collect()} == want
    assert {tuple(r) for r in neardup.join(df).collect()} == pairs
    exact = brute(rows)
    assert {r[:4] for r in want} == {r[:4] for r in exact}
    assert sum(r[4] for r in want) >= 0.99 * sum(r[4] for r in exact)


def test_ids_with_several_texts_join_their_groups(spark):
    a, b = (" ".join(f"{c}{k}" for k in range(40)) for c in "ab")
    rows = [(5, a), (5, b), (7, a), (9, b), (9, b), (11, "c d e f g h"), (None, a)]
    got = {tuple(r) for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows) == {(5, 5, 5, 2, 0), (7, 5, 5, 1, 0), (9, 5, 5, 1, 0)}


def test_components_equal_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(40):
        n = int(rng.integers(1, 60))
        i, j = rng.integers(0, n, (2, int(rng.integers(0, n))))
        want = list(range(n))
        for _ in range(n):
            for x, y in zip(i, j):
                want[x] = want[y] = min(want[x], want[y])
        assert neardup.components(n, i, j).tolist() == want
