"""Every stretch of a diagonal against a search of all stretches."""

import numpy as np
import pytest

from palimpsest.llm import decontam


def every_stretch(equal, least, ratio):
    n = np.concatenate([[0], np.cumsum(equal)])
    return [(s, t) for s in np.nonzero(equal)[0] for t in np.nonzero(equal)[0] + 1 if t - s >= least and n[t] - n[s] >= ratio * (t - s) - 1e-9]


@pytest.mark.parametrize("rate", [0.05, 0.15, 0.25, 0.4])
def test_every_stretch_is_reported_or_meets_one_that_is(rate):
    rng = np.random.default_rng(6)
    some = 0
    for _ in range(60):
        equal = rng.random(int(rng.integers(1, 120))) > rate
        want, got = every_stretch(equal, 13, 0.8), decontam.stretches(equal, 13, 0.8)
        assert set(got) <= set(want)
        assert all(b <= c for (_, b), (c, _) in zip(got, got[1:]))
        assert all(any(s < b and a < t for a, b in got) for s, t in want)
        some += bool(want)
    assert some


def test_partly_edited_copies_and_second_overlaps_are_found(spark):
    item = [f"i{k}" for k in range(59)]
    edited = [w if k < 15 or 22 <= k < 37 or k >= 44 else f"x{k}" for k, w in enumerate(item)]
    far = [w if k < 15 or k >= 44 else f"y{k}" for k, w in enumerate(item)]
    docs = spark.createDataFrame([(1, " ".join(edited)), (2, " ".join(far)), (3, " ".join(f"z{k}" for k in range(80)))], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    for windows in (decontam.BROADCAST_WINDOWS, 0):
        got = sorted((r.doc_id, r.item_from, r.item_to) for r in decontam.find_overlaps(docs, bench, broadcast_windows=windows).collect())
        assert got == [(1, 0, 37), (1, 44, 59), (2, 0, 15), (2, 44, 59)]
    assert [r.doc_id for r in decontam.without_leaks(docs, bench).collect()] == [3]
