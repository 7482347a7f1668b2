"""Every pair at or just above the threshold is found, none is left to chance."""

import itertools

import numpy as np
import pytest
from test_copies import brute, grams

from palimpsest.llm import neardup, queries

SCHEMA = "doc_id long, text string"


def pairs_at_half(count):
    """Texts of 60 word 3-grams, two by two with 40 in common: their similarity is a half exactly."""
    rows = []
    for k in range(count):
        rows += [(2 * k + c, " ".join([f"s{k}x{i}" for i in range(42)] + [f"o{k}x{c}x{i}" for i in range(20)])) for c in (0, 1)]
    return rows


def common_words(rng, count):
    """Texts of few words, in which most n-grams are in many others, and parts of one another."""
    words = [f"w{k}" for k in range(12)]
    rows = [(k, " ".join(rng.choice(words, int(rng.integers(3, 60))))) for k in range(count)]
    for k in range(0, count, 2):
        t = rows[k][1].split()
        cut = int(len(t) * rng.uniform(0.5, 1))
        rows.append((count + k, " ".join([*t[:cut], *rng.choice(words, len(t) - cut)])))
    return rows


def exact(rows, threshold):
    first = {}
    for i, t in rows:
        first.setdefault(grams(t), i)
    return {(i, k) for (g, i), (h, k) in itertools.combinations(first.items(), 2) if len(g & h) / len(g | h) >= threshold}


def test_op4_finds_every_pair_at_the_threshold(spark, tmp_path):
    rows = pairs_at_half(400)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    found = {tuple(r) for r in queries.op4_signature_tree_join(spark, str(tmp_path)).collect()}
    assert found == brute(rows) and len(found) == 800


@pytest.mark.parametrize("threshold", [0.2, 0.5, 0.8])
def test_pairs_of_common_words_equal_brute_force(spark, monkeypatch, threshold):
    """Also with n-grams dealt to many ranges, by chunks of few texts, and cut buckets."""
    rows = common_words(np.random.default_rng(17), 240)
    want = exact(rows, threshold)
    df = spark.createDataFrame(rows, SCHEMA)
    assert len(want) > 10
    for part, chunk, block in ((neardup.PART_GRAMS, neardup.CHUNK_GRAMS, neardup.BLOCK), (60, 400, 9)):
        monkeypatch.setattr(neardup, "PART_GRAMS", part)
        monkeypatch.setattr(neardup, "CHUNK_GRAMS", chunk)
        monkeypatch.setattr(neardup, "BLOCK", block)
        got = [(r.doc_a, r.doc_b) for r in neardup.join(df, threshold=threshold).where("jaccard < 1").collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_chunks_of_one_content_lose_nothing(spark):
    """Rows repeated as whole files make chunks of one name."""
    rows = pairs_at_half(30)
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    got = {tuple(r) for r in neardup.classes(df.union(df).union(df)).collect()}
    assert got == brute(rows)


def test_pipeline_keeps_one_of_every_pair_at_the_threshold(spark):
    import corpus_pipeline

    df = spark.createDataFrame(pairs_at_half(400), SCHEMA)
    kept = sorted(r.doc_id for r in corpus_pipeline.ngram_jaccard(spark, df, "").collect())
    assert kept == list(range(0, 800, 2))


def test_ids_with_three_texts_hold_all_their_groups_together(spark):
    import corpus_pipeline

    a, b, c, d = (" ".join(f"{x}{k}" for k in range(40)) for x in "abcd")
    rows = [(9, a), (9, b), (9, c), (9, d), (1, a), (2, b), (3, c), (4, d + " end"), (20, b + " end")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {tuple(r) for r in neardup.classes(df).collect()} == brute(rows)
    assert {r.doc_id for r in corpus_pipeline.ngram_jaccard(spark, df, "").collect()} == {1}
