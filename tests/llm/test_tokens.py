"""Tokens of scripts without spaces, and of texts one after another."""

import pyarrow as pa

from palimpsest.llm.tokens import tokenised


def words(*texts):
    out = []
    for i, j, t in tokenised(pa.array(texts)):
        for k in range(j - i):
            a, b = t.first[k], t.first[k + 1]
            out.append([bytes(t.raw[x:y]).decode() for x, y in zip(t.start[a:b], t.end[a:b])])
    return out


def test_unspaced_scripts():
    assert words("我们今天去,你呢") == [list("我们今天去你呢")]
    assert words("我们今天去，你呢？", "カナ。です", "한국어 말", "\U00020000\U00020001x") == [list("我们今天去你呢"), list("カナです"), ["한국어", "말"], ["\U00020000", "\U00020001", "x"]]
    assert words("abc中文def", "naïve Ünï", "", "ＡＢ１") == [["abc", "中", "文", "def"], ["naïve", "Ünï"], [], ["ＡＢ１"]]


def test_hashes_do_not_depend_on_the_place():
    a = {w: h for text in (["中文 abc"], ["x 文abc中"]) for _, _, t in tokenised(pa.array(text)) for w, h in zip((bytes(t.raw[x:y]) for x, y in zip(t.start, t.end)), t.hash.tolist())}
    b = {w: h for _, _, t in tokenised(pa.array(["文", "中", "abc"])) for w, h in zip((bytes(t.raw[x:y]) for x, y in zip(t.start, t.end)), t.hash.tolist())}
    assert all(a[w] == h for w, h in b.items())
