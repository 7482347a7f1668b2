"""Notices inside prose, and several licenses at one place."""

import pytest

from palimpsest.llm import licenses

PROSE = "The committee met again on Tuesday, and after a long talk about the river it was agreed that nothing could be done before spring"


def scanned(text):
    return [(text[a:b], name, got[-1]) for a, b, name, *got in licenses.notices(licenses.Ranker(), text)]


@pytest.mark.parametrize("end", [". ", ", and "])
@pytest.mark.parametrize("times", [1, 3, 6, 12])
@pytest.mark.parametrize("name,notice", [("MIT", "Released under the MIT License."), ("Apache-2.0", "Licensed under the Apache License, Version 2.0.")])
def test_prose_around_a_notice_does_not_hide_it(name, notice, times, end):
    text = (PROSE + end) * times + notice + " " + PROSE
    ((part, *got),) = scanned(text)
    assert got == [name, True] and notice in part


def test_all_licenses_of_a_place():
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    for text in (f"{mit}\n{apache}", f"{mit} {apache}", f"{mit[:-1]}\n{apache[:-1]}"):
        assert {name for _, name, _ in scanned(text)} == {"MIT", "Apache-2.0"}
    assert {n for _, n, _ in scanned("Licensed under the MIT License or the Apache License, Version 2.0, at your choice.")} == {"MIT", "Apache-2.0"}


@pytest.mark.parametrize("name", licenses.TEMPLATES)
def test_every_wording_is_its_own_license(name):
    for wording in licenses.TEMPLATES[name]:
        assert [(n, exact) for _, n, exact in scanned(wording)] == [(name, True)]
