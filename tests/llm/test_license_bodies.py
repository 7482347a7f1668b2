"""Whole license texts, tags, headings, several licenses of a place, and texts that are none; all templates tried on all texts."""

import time

import pytest

from palimpsest.llm import licenses
from palimpsest.llm.license_texts import BODIES

RANKER, WHOLE = licenses.Ranker(), licenses.Bodies()


def found(text):
    return [(r[2], r[-1]) for r in licenses.licenses_of(RANKER, WHOLE, text)]


@pytest.mark.parametrize("k", range(len(BODIES)), ids=[f"{n}-{k}" for k, (n, _) in enumerate(BODIES)])
def test_whole_texts(k):
    name, body = BODIES[k]
    assert found(body) == [(name, True)]
    text = f"{name} License\n\nCopyright (c) 2020 The Authors. All rights reserved.\n\n{body}\n"
    assert found(text) == [(name, True)]
    comment = "/*\n" + "\n".join(" * " + x for x in text.split("\n")) + "\n */\nint main() { return 0; }\n" + "filler words of no meaning " * 40
    assert found(comment) == [(name, True)]
    words = body.split(" ")
    edited = " ".join(w for k, w in enumerate(words) if k % 25 != 20)
    assert found(edited) == [(name, False)]


def test_brute_force_over_all_bodies():
    """The body chosen keeps the most words of all."""
    for name, body in BODIES:
        text = " ".join(w for k, w in enumerate(body.split()) if k % 30 != 25)
        words = [w.lower() for w in licenses._WORD.findall(text)]
        kept = []
        for k, other in enumerate(WHOLE.words):
            same, missing, added, changed = licenses.differences(other, words)
            kept.append(((same - added - changed) / len(other), BODIES[k][0]))
        assert max(kept)[1] == name == found(text)[0][0]


@pytest.mark.parametrize("text,want", [
    ("MIT License", {"MIT"}), ("SPDX-License-Identifier: MIT", {"MIT"}), ("// SPDX-License-Identifier: BSD-3-Clause", {"BSD-3-Clause"}), ("WTFPL license", {"WTFPL"}), ("Apache License, Version 2.0 or MIT", {"Apache-2.0", "MIT"}),
    ("Licensed under the Apache License, Version 2.0 or the MIT license", {"Apache-2.0", "MIT"}), ("Released under the MIT\nlicense", {"MIT"}), ("Licensed under the Apache\nLicense, Version 2.0.", {"Apache-2.0"}),
    ("I have a driving licence and a cat.", set()), ("Copyright 2020 MIT Press", set()), ("the public domain", set()), ("A poetic license to kill.", set()), ("", set()), ("license\n" * 500, set()),
])
def test_short_ones(text, want):
    assert {n for n, _ in found(text)} == want


def test_two_texts_and_repeats():
    mit, apache = BODIES[0][1], next(b for n, b in BODIES if n == "Apache-2.0")
    assert [n for n, _ in found(f"{mit}\n\nfiller {'of no meaning ' * 60}\n\n{apache}\n\n{mit}")] == ["MIT", "Apache-2.0", "MIT"]


def test_a_grant_of_nothing_is_none():
    assert found("Permission is hereby granted to nobody at all. This software is provided as is, by a committee.") == []


def test_long_text_in_proportion():
    began = time.time()
    found("Permission is hereby granted, free of charge, to any person obtaining a sandwich\n\n" * 10_000)
    found("a line with a license but without an end\n" * 30_000)
    assert time.time() - began < 90
