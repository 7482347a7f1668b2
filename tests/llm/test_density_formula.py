"""The density of every node by the formula, from counts taken by walking the tree anew for each node."""

import math
import time

import numpy as np
import pytest

from palimpsest.llm import htmltext
from palimpsest.llm.htmltext import Node


def counts(n):
    """(characters, tags, link characters, link tags) under a node."""
    c = t = lc = lt = 0
    for k in n.kids:
        if isinstance(k, str):
            c += len(" ".join(k.split()))
        else:
            a, b, x, y = counts(k)
            c, t, lc, lt = c + a, t + b + (not k.skip), lc + x, lt + y
    return (c, t, c, t + 1) if n.tag == "a" else (c, t, lc, lt)


def walk(n):
    yield n
    for k in n.kids:
        if isinstance(k, Node):
            yield from walk(k)


def page(rng, depth=0):
    out = ""
    for _ in range(int(rng.integers(1, 5))):
        words = " ".join(["word"] * int(rng.integers(0, 30)))
        tag = str(rng.choice(["div", "p", "span", "a", "ul", "li", "table", "script"]))
        inner = page(rng, depth + 1) if depth < 4 and rng.random() < 0.6 else words
        out += f"<{tag} class='x'>{inner}</{tag}>{words if rng.random() < 0.3 else ''}"
    return out


def test_densities_sums_and_choice_against_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(60):
        root, _ = htmltext.parse(f"<html><head><title>t</title></head><body>{page(rng)}</body></html>")
        htmltext.measured(root)
        body = htmltext.body_of(root)
        c_b, _, lc_b, _ = (max(1, x) for x in counts(body))
        want = {}
        for n in walk(root):
            c, t, lc, lt = counts(n)
            d = 0.0
            if c and not n.skip:
                one = lambda x: max(1, x)
                d = c / one(t) * max(0.0, math.log(c * one(t) / (one(lc) * one(lt)))) / math.log(math.log(c * one(lc) / one(c - lc) + lc_b * c / c_b + math.e))
            want[id(n)] = d
            assert n.density == pytest.approx(d, rel=1e-12)
        for n in walk(root):
            assert n.sum == pytest.approx(sum(want[id(k)] for k in n.kids if isinstance(k, Node)))
        taken, threshold, top = htmltext.content(root)
        if body.c:
            assert top == max(n.sum for n in walk(body) if not n.skip)
            best = next(n for n in walk(body) if n.sum == top and not n.skip)
            path, n = [], best
            while n is not None and n is not body:
                path.append(want[id(n)])
                n = n.parent
            assert threshold == pytest.approx(min(path, default=best.density))


def test_a_link_elsewhere_changes_no_density_but_its_own_path():
    a = "<body><p>four</p><div>{}</div></body>"
    root = [htmltext.parse(a.format(x))[0] for x in ("text here", "text her<a href=x>e</a>")]
    d = [next(n for n in htmltext.measured(r) if n.tag == "p").density for r in root]
    assert d[0] == pytest.approx(d[1], rel=0.2)


def test_quotes_only_delimit_after_an_equals_sign():
    for tag in ("<p title=it's>", "<p it's>", "<p title = 'a>b'>", '<p data-x="<b>" y=\'>\'>', "<p\nx=1\ny>"):
        assert htmltext.written_text([htmltext.parse(f"{tag}Hello there</p><p>More</p>")[0]]) == "Hello there\nMore"


@pytest.mark.parametrize("unit", ["<b>{}", "</i>{}", "<h1>{}", "<li>{}", "<p title=it's>{}", "<", "<a href=\"", "<p a='", "<table><tr><td>{}", "&amp;", "<!--", "<x/>"])
def test_hostile_pages_in_proportion(unit):
    unit = unit.replace("{}", "x")
    began = time.time()
    htmltext.extract("<div><b>" * 600 + unit * (1_000_000 // len(unit)))
    assert time.time() - began < 60


def test_deep_pages_keep_their_text():
    root, _ = htmltext.parse("".join(f"<div>word{k} " for k in range(3000)))
    assert htmltext.written_text([root]).split() == [f"word{k}" for k in range(3000)]
