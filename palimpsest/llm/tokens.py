"""Vectorised tokenising of Arrow string batches with NumPy.

A token is a maximal run of ASCII letters and digits or of characters beyond ASCII; Latin-1
signs (U+0080-U+00BF but for the letters ª º µ), the general punctuation block (U+2000-U+206F),
CJK punctuation (U+3000-U+303F) and full-width punctuation separate tokens. Each character of the scripts
that are written without spaces (kana and ideographs, U+3040-U+9FFF and beyond U+20000) is a token. Text is lower-cased first: ASCII and the
two-byte Latin letters here, anything else by the caller (``F.lower``) where it matters.

Every token gets a 64-bit hash that depends only on its bytes: with prefix sums of
``byte * P**i`` (arithmetic modulo 2**64, P odd and so invertible) a token's polynomial is one
subtraction and one multiplication, whatever its length. Nothing loops over characters or words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
#: Texts are handled in groups of about so many bytes, so scratch arrays stay small.
CHUNK_BYTES = 1 << 20

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i < n, grown and kept per worker process."""
    if "p" not in _powers or len(_powers["p"]) < n:
        m = 1 << max(20, int(n - 1).bit_length())
        with np.errstate(over="ignore"):
            for name, base in (("p", _P), ("i", _P_INV)):
                x = np.full(m, base, U64)
                x[0] = 1
                _powers[name] = np.multiply.accumulate(x)
    return _powers["p"], _powers["i"]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection of 64-bit integers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def _table() -> np.ndarray:
    t = np.zeros(256, np.uint8)
    for c in b"0123456789abcdefghijklmnopqrstuvwxyz":
        t[c] = c
    for c in range(65, 91):
        t[c] = c + 32
    t[128:] = np.arange(128, 256)
    return t


_FOLD = _table()
_LATIN1_SIGN = np.ones(64, bool)
_LATIN1_SIGN[[0x2A, 0x3A, 0x35]] = False  # ª º µ


def fold(raw: np.ndarray) -> np.ndarray:
    """Lower-cased bytes; 0 where a byte separates tokens."""
    b = _FOLD[raw]
    (hi,) = np.nonzero(raw >= 0xC2)
    if len(hi):
        lead = raw[hi]
        after = raw[np.minimum(hi + 1, len(raw) - 1)]
        up = hi[(lead == 0xC3) & (after >= 0x80) & (after <= 0x9E) & (after != 0x97)] + 1
        b[up] += 0x20
        latin = hi[(lead == 0xC2) & (after >= 0x80)]
        sign = latin[_LATIN1_SIGN[raw[latin + 1] & 0x3F]] if len(latin) else latin
        b[sign] = 0
        b[sign + 1] = 0
        wide = hi[((lead == 0xE2) & ((after == 0x80) | (after == 0x81))) | ((lead == 0xE3) & (after == 0x80))]
        wide = wide[wide + 2 < len(raw)]
        wide = wide[:, None] + np.arange(3)
        full = hi[(lead == 0xEF) & (after >= 0xBC) & (after <= 0xBD)]
        full = full[full + 2 < len(raw)]
        if len(full):  # U+FF01-FF0F, FF1A-FF20, FF3B-FF40, FF5B-FF65
            c = (raw[full + 1].astype(np.int64) & 1) << 6 | raw[full + 2] & 0x3F
            full = full[(c <= 0x0F) | ((c >= 0x1A) & (c <= 0x20)) | ((c >= 0x3B) & (c <= 0x40)) | ((c >= 0x5B) & (c <= 0x65))]
            wide = np.concatenate([wide, full[:, None] + np.arange(3)])
        b[wide.ravel()] = 0
    return b


def unspaced(raw: np.ndarray) -> np.ndarray:
    """Where characters of scripts without spaces begin and end."""
    (hi,) = np.nonzero((raw >= 0xE3) & (raw <= 0xE9))
    wide = hi[(raw[hi] != 0xE3) | (raw[np.minimum(hi + 1, len(raw) - 1)] >= 0x81)]
    (hi,) = np.nonzero(raw == 0xF0)
    far = hi[raw[np.minimum(hi + 1, len(raw) - 1)] >= 0xA0]
    return np.concatenate([wide, wide + 3, far, far + 4])


class Tokens:
    """Tokens of a group of texts: ``hash`` and byte ``start``/``end`` by token, and ``first``,
    of length texts + 1, the index of each text's first token. Byte positions are relative to the
    text when ``base`` (by text) is taken off."""

    __slots__ = ("hash", "start", "end", "first", "base", "raw", "folded")

    def __init__(self, raw: np.ndarray, ends: np.ndarray):
        """raw: the texts' bytes one after another; ends: offsets, of length texts + 1, from 0."""
        self.raw, self.base = raw, ends[:-1]
        n = len(raw)
        b = self.folded = fold(raw)
        word = np.empty(n + 2, bool)
        word[0] = word[-1] = False
        np.not_equal(b, 0, out=word[1:-1])
        edge = word[1:] != word[:-1]
        inner = np.concatenate([ends[1:-1], unspaced(raw)])
        inner = inner[(inner > 0) & (inner < n)]
        cut = inner[word[inner] & word[inner + 1]] if n else inner  # a token may not cross texts
        (at,) = np.nonzero(edge)
        start, end = at[0::2], at[1::2]
        if len(cut):
            cut = np.unique(cut)
            start, end = np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([end, cut]))
        p, inv = powers(n + 1)
        with np.errstate(over="ignore"):
            sums = np.empty(n + 1, U64)
            sums[0] = 0
            np.cumsum(b * p[:n], dtype=U64, out=sums[1:])
            h = (sums[end] - sums[start]) * inv[start]
            h += (end - start).astype(U64)
        self.hash, self.start, self.end = mix(h), start, end
        self.first = np.searchsorted(start, ends).astype(np.int64)

    @property
    def doc(self) -> np.ndarray:
        """The text of each token."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets of a string or binary array; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    large = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offs, data = texts.buffers()
    o = np.frombuffer(offs, np.int64 if large else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    if texts.null_count:  # a null's slot need not be empty
        import pyarrow.compute as pc

        if (np.diff(o)[pc.is_null(texts).to_numpy(zero_copy_only=False)] > 0).any():
            return buffers(pc.fill_null(texts, ""))
    return raw, o


def groups(texts: pa.Array, chunk: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, bytes, offsets from 0) of runs of texts of about ``chunk`` bytes, a longer text alone."""
    raw, o = buffers(texts)
    i, n = 0, len(o) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(o, o[i] + chunk, "right")) - 1)
        yield i, j, raw[o[i] : o[j]], o[i : j + 1] - o[i]
        i = j


def tokenised(texts: pa.Array, chunk: int = CHUNK_BYTES) -> Iterator[tuple[int, int, Tokens]]:
    for i, j, raw, ends in groups(texts, chunk):
        yield i, j, Tokens(raw, ends)


def windows(t: Tokens, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first token of each window of n tokens that lies within one text, and its text."""
    if len(t.hash) < n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.arange(len(t.hash) - n + 1)
    doc = t.doc
    ok = doc[: len(at)] == doc[n - 1 :]
    return at[ok], doc[: len(at)][ok]


def gram_hash(h: np.ndarray, n: int) -> np.ndarray:
    """Order-dependent hash of each run of n successive tokens (also across texts: see windows)."""
    if len(h) < n:
        return np.empty(0, U64)
    m = len(h) - n + 1
    with np.errstate(over="ignore"):
        x = np.zeros(m, U64)
        for k in range(n):
            x = x * U64(_P) + h[k : k + m]
    return mix(x)
