import numpy as np
import pyarrow as pa
import pytest

from palimpsest.llm import repeats
from palimpsest.llm.tokens import tokenised


def brute(rows, depth):
    """Covered token positions by (id, first)."""
    texts = {}
    for k, (i, text) in enumerate(rows):
        if i is not None and text:
            for _, _, t in tokenised(pa.array([text.lower()])):
                texts[k] = (i, t.hash.tolist())
    by = {}
    for i, h in texts.values():
        for p in range(len(h) - depth + 1):
            by.setdefault(tuple(h[p : p + depth]), set()).add(i)
    out = {}
    for i, h in texts.values():
        for p in range(len(h) - depth + 1):
            ids = by[tuple(h[p : p + depth])]
            if len(ids) > 1:
                out.setdefault((i, i == min(ids)), set()).update(range(p, p + depth))
    return out


def covered(df):
    out = {}
    for r in df.collect():
        out.setdefault((r.doc_id, r.first), set()).update(range(r.token_from, r.token_to))
    return out


def test_merged_is_the_suffix_order_and_its_common_prefixes():
    rng = np.random.default_rng(5)
    for depth in (1, 2, 3, 7, 12):
        strings = [rng.integers(1, 4, rng.integers(0, 14)).tolist() for _ in range(20)]
        shards = [np.array(sum((s + [0] for s in strings[k : k + 6]), []), np.int64) for k in range(0, 20, 6)]
        text = np.concatenate(shards).tolist()

        def suffix(p):
            return tuple(text[p : text.index(0, p)][:depth])

        at, _, lcp = repeats.merged(shards, depth, prune=False)
        assert sorted(at.tolist()) == list(range(len(text)))
        order = [suffix(p) for p in at.tolist()]
        assert order == sorted(order)
        for k in range(1, len(order)):
            a, b = order[k - 1], order[k]
            same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert min(lcp[k], depth) == same, (depth, a, b)
        got, new, _ = repeats.merged(shards, depth)
        full = [s for s in order if len(s) == depth]
        want = sorted(s for s in full if full.count(s) > 1)
        assert [suffix(p) for p in got.tolist()] == want
        assert int(new.sum()) == len(set(want))


@pytest.mark.parametrize("depth", [17, 20, 50])
def test_repeated_equals_brute_force(spark, depth):
    rng = np.random.default_rng(depth)
    words = [f"w{k}" for k in range(40)] + ["é", "ß"]
    text = lambda n: " ".join(rng.choice(words, n))
    shared = [text(n) for n in (depth, depth + 1, depth + 30, 3 * depth, depth - 1)]
    rows = []
    for k in range(60):
        parts = [text(int(rng.integers(0, 80)))]
        for s in shared:
            if rng.random() < 0.3:
                cut = s.split()[: int(rng.integers(depth - 2, 3 * depth))]
                parts += [" ".join(cut), text(int(rng.integers(0, 30)))]
        rows.append((k, " ".join(parts)))
    rows += [(100 + k, rows[3][1]) for k in range(20)]  # copies
    rows += [(200, "la " * 300), (201, "la " * 120), (202, ("x y " * 90))]
    rows += [(300, None), (301, ""), (None, rows[3][1]), (302, "one"), rows[5], (7, rows[9][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as h", "2 as n", "3 as ctx", "cast(null as string) as lead")
    assert covered(repeats.repeated(df.repartition(5), depth=depth)) == brute(rows, depth)


def test_repeats_within_one_document_only_and_empty_tables(spark):
    one = spark.createDataFrame([(1, "a b c d e f g h i j " * 40), (1, "a b c d e f g h i j " * 40)], "doc_id long, text string")
    assert repeats.repeated(one).collect() == []
    assert repeats.repeated(one.where("doc_id > 5")).collect() == []


def test_long_text(spark):
    rng = np.random.default_rng(1)
    long = " ".join(f"v{k}" for k in rng.integers(0, 5000, 400_000))
    words = long.split()
    rows = [(1, long), (2, " ".join(words[1000:1060])), (3, " ".join(words[-50:])), (4, " ".join(words[7:56]))]
    got = covered(repeats.repeated(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == {(1, True): set(range(1000, 1060)) | set(range(399_950, 400_000)), (2, False): set(range(60)), (3, False): set(range(50))}
