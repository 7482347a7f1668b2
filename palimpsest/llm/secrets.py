"""Secret scans with multipart credential linking.

A credential often comes in parts: who (an access identifier), what (a secret), where (an
endpoint). Parts are found by patterns and are strong, if the pattern alone makes a credential
(``AKIA...``, ``password = ...`` with a digit in it, provider tokens, private keys), or weak, if it is
as likely something else (a bare run of hex, a user name, a host). Within a scope, which is a
paragraph (text between blank lines), parts of different kinds whose character intervals lie at most
``gap`` apart are linked by a sorted interval join; a weak part is reported only where it is linked
to a part of another kind, at least one of the two being a secret, and a strong one always.

Scopes never cross documents, so parts are joined where the text is: one pass, nothing is shuffled.
Each rule has a test (RE2) for what its pattern can't do without, and texts that pass none are turned away
first; of the others only the rules whose test they pass are searched.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.names import fresh, named
from palimpsest.storage import ship

GAP = 200
OUT = "doc_id long, scope int, kind string, rule string, strength string, char_from int, char_to int, n_links int, credential int, digest string"

_ASSIGN = r"""["']?[ \t\r\n\f]{0,3}(?:=>|:=|[:=])[ \t\r\n\f]{0,3}"""
_VALUE = r"""(?:"([^"\n]{%d,})"|'([^'\n]{%d,})'|["']?([^\s"'<>,;]{%d,}))"""
#: (kind, rule, strength, pattern, what the pattern needs); of overlapping matches the earlier rule's counts. The value is the group, or all.
#: No credential has a largest length: its characters end it. A private key goes to its END line, or without one to the end of the text.
RULES = [
    ("secret", "private_key", "strong", r"(?s)-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----(?:.*?-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----|.*)", r"-----BEGIN "),
    ("identifier", "aws_key_id", "strong", r"\b(?:AKIA|ASIA|ABIA|ACCA)[A-Z0-9]{16}\b", r"A[KSBC][IC]A[A-Z0-9]{16}"),
    ("secret", "provider_token", "strong", r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,}|xox[abeoprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35,}|sk-[A-Za-z0-9_-]{20,}|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|glpat-[A-Za-z0-9_-]{20,}|npm_[A-Za-z0-9]{36,}|hf_[A-Za-z0-9]{30,})(?![A-Za-z0-9])", r"gh[pousr]_|github_pat_|xox[abeoprs]-|AIza|sk-|[sr]k_(?:live|test)_|glpat-|npm_|hf_"),
    ("secret", "jwt", "strong", r"\beyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}", r"\.eyJ"),
    ("secret", "assigned", "", r"(?i:(?:password|passwd|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential)s?)" + _ASSIGN + _VALUE % (6, 6, 6), r"(?i)pass(?:word|wd|phrase)|pwd|secret|token|key|credential"),
    ("identifier", "assigned_name", "weak", r"(?i:\b(?:user(?:[_-]?name)?|login|client[_-]?id|account(?:[_-]?id)?|access[_-]?id|uid))" + _ASSIGN + _VALUE % (3, 3, 3), r"(?i)(?:user(?:[_-]?name)?|login|id|account)[\"']?\s{0,3}[:=]"),
    ("endpoint", "url", "weak", r"\b(?:https?|wss?|ftp|jdbc:[a-z0-9]{2,20}|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqps?)://[^\s\"'<>]{3,}", r"://"),
    ("endpoint", "host", "weak", r"(?i:\b(?:host(?:name)?|server|endpoint|region))" + _ASSIGN + _VALUE % (3, 3, 3), r"(?i)(?:host(?:name)?|server|endpoint|region)[\"']?\s{0,3}[:=]"),
    ("identifier", "email", "weak", r"\b[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+\b", r"@"),
    ("secret", "bare_hex", "weak", r"\b(?=[a-f]{0,63}[0-9])(?:[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32})\b", r"[0-9a-f]{32}"),
    ("secret", "bare_base64", "weak", r"(?<![A-Za-z0-9+/=])(?=[A-Za-z+/]{0,39}[0-9])[A-Za-z0-9+/]{40}={0,2}(?![A-Za-z0-9+/=])", r"[A-Za-z0-9+/]{40}"),
    ("endpoint", "address", "weak", r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]{2,5})?\b", r"[0-9]\.[0-9]"),
]
_RULES = [(kind, rule, strength, re.compile(p)) for kind, rule, strength, p, _ in RULES]
_NEEDS = [n for *_, n in RULES]
#: Rules that can be reported only beside a secret.
_WEAK_OTHER = [k for k, r in enumerate(RULES) if r[2] == "weak" and r[0] != "secret"]
_BLANK = re.compile(r"\n[ \t\r]*\n")


def entropy(s: str) -> float:
    """Shannon entropy in bits a character."""
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def parts_of(text: str, rules: Iterable[int] | None = None) -> list[tuple]:
    """(from, to, kind, rule, strength) of the parts of a text, in order, none overlapping; ``rules``: only those of these numbers."""
    starts: list[int] = []
    taken: list[tuple] = []
    for r in range(len(_RULES)) if rules is None else rules:
        kind, rule, strength, pattern = _RULES[r]
        mine: list[tuple] = []  # matches of one rule don't overlap
        for m in pattern.finditer(text):
            a, b = m.span(m.lastindex or 0)
            k = bisect_left(starts, b)
            if k and taken[k - 1][1] > a:  # the last part that begins before this one ends
                continue
            strong = strength
            if not strong:
                v = text[a:b]
                strong = "strong" if len(v) >= 8 and any(c.isdigit() for c in v) and entropy(v) >= 2.5 else "weak"
            mine.append((a, b, kind, rule, strong))
        if mine:
            taken = sorted(taken + mine)
            starts = [t[0] for t in taken]
    return taken


def linked(parts: list[tuple], gap: int) -> list[list[int]]:
    """For each part the others of another kind within ``gap`` characters, one of the two a secret."""
    out: list[list[int]] = [[] for _ in parts]
    starts = [p[0] for p in parts]
    for i, (a, b, kind, *_) in enumerate(parts):
        for j in range(i + 1, bisect_right(starts, b + gap, i + 1)):
            other = parts[j][2]
            if other != kind and "secret" in (other, kind):
                out[i].append(j)
                out[j].append(i)
    return out


def findings(text: str, gap: int = GAP, rules: Iterable[int] | None = None) -> list[tuple]:
    """(scope, kind, rule, strength, from, to, links, credential) of what is reported of a text.

    ``scope`` is the number of the paragraph, ``credential`` the first position of the parts that are
    linked together, directly or through others.
    """
    parts = parts_of(text, rules)
    if not parts:
        return []
    blanks = [m.start() for m in _BLANK.finditer(text)]
    scope = [bisect_right(blanks, p[0]) for p in parts]
    out = []
    i = 0
    while i < len(parts):
        j = i
        while j < len(parts) and scope[j] == scope[i]:
            j += 1
        group = parts[i:j]
        links = linked(group, gap)
        root = list(range(len(group)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for x, ys in enumerate(links):
            for y in ys:
                a, b = sorted((find(x), find(y)))
                root[b] = a
        for x, (a, b, kind, rule, strength) in enumerate(group):
            if strength == "strong" or links[x]:
                out.append((scope[i], kind, rule, strength, a, b, len(links[x]), group[find(x)][0]))
        i = j
    return out


def _candidates(texts: pa.Array) -> list[tuple[int, list[int]]]:
    """(row, rules that may match it) of the texts in which a part may be reported: those that may have a secret or a strong part."""
    tested = np.stack([pc.fill_null(pc.match_substring_regex(texts, n), False).to_numpy(zero_copy_only=False) for n in _NEEDS]) if len(texts) else np.zeros((len(_NEEDS), 0), bool)
    alone = np.ones(len(_NEEDS), bool)
    alone[_WEAK_OTHER] = False
    return [(int(k), np.nonzero(tested[:, k])[0].tolist()) for k in np.nonzero(tested[alone].any(0))[0]]


def scan(docs: DataFrame, *, gap: int = GAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a reported part (schema ``OUT``); ``digest`` is of the value, which isn't repeated.

    Character positions are into the text as it is, of any length. Null and empty texts have no parts; a null
    id stays null (ids are whole numbers); repeated rows are reported once each. Of parts that overlap, that of
    the rule listed first counts. Other columns are ignored; an empty table gives no rows.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in OUT.split(", ")]
        kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
        for batch in batches:
            ids, texts, rows = batch.column(0), batch.column(1), []
            for k, rules in _candidates(texts):
                text = texts[k].as_py()
                for f in findings(text, gap, rules):
                    rows.append((ids[k].as_py(), *f, hashlib.sha256(text[f[4] : f[5]].encode("utf-8", "replace")).hexdigest()[:16]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).alias("text")).mapInArrow(run, OUT)


def redact(docs: DataFrame, *, gap: int = GAP, text_col: str = "text", size_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with reported secrets and identifiers replaced by ``[kind]``, and the size made right.

    Endpoints stay. A text in which nothing is reported stays as it is, null and empty included. Sizes of
    rows that don't change stay as they are too. Texts may be of any length; repeated rows are changed
    alike, no row is dropped, and extra columns stay, whatever their names.
    """
    ship(docs.sparkSession)

    @F.arrow_udf("string")
    def cleaned(texts: pa.Array) -> pa.Array:
        found = {}
        for k, rules in _candidates(texts):
            text = texts[k].as_py()
            spans = [(f[4], f[5], f[1]) for f in findings(text, gap, rules) if f[1] != "endpoint"]
            if spans:
                at, out = 0, []
                for a, b, kind in sorted(spans):
                    out += [text[at:a], f"[{kind}]"]
                    at = b
                found[k] = "".join([*out, text[at:]])
        return pa.array([found.get(k) for k in range(len(texts))], pa.string())

    clean = fresh("clean", docs)
    out = docs.withColumn(clean, cleaned(named(text_col)))
    new = {text_col: F.coalesce(F.col(clean), named(text_col))}
    if size_col in docs.columns:
        new[size_col] = F.when(F.col(clean).isNotNull(), F.length(clean).cast("bigint")).otherwise(named(size_col))
    return out.select(*(new[c].alias(c) if c in new else named(c) for c in docs.columns))
