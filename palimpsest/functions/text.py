"""Scalar functions as column expressions: digests, tokens, previews, key levels."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What separates tokens; letters are folded for ASCII only, so "Ä" stays "Ä".
SEPARATORS = r"[^\p{IsAlphabetic}\p{N}]+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ascii_lower(text: Column | str) -> Column:
    return F.translate(col(text), string.ascii_uppercase, string.ascii_lowercase)


def tokens(text: Column | str) -> Column:
    """The tokens of a text in order, duplicates included; none of a null."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(col(text), F.lit(""))), SEPARATORS), "")


_FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
_ASCII = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else 32 for b in range(256))


def splitter():
    """The same tokens in Python, as a function of a text: the faster, the fewer scripts a text uses."""
    import re

    import regex

    latin, any_script = re.compile(r"[^\W_]+").findall, regex.compile(r"[\p{Alphabetic}\p{N}]+").findall

    def split(text: str) -> list[str]:
        if text.isascii():
            return text.encode().translate(_ASCII).decode().split()
        folded = text.translate(_FOLD)
        return latin(folded) if max(folded) < "\u0300" else any_script(folded)  # no combining marks below

    return split


def digest(tag: str, content: Column | str) -> Column:
    """Hex digest of content under a domain tag, so that no two kinds of object share an address."""
    return F.sha2(F.concat(F.lit(f"{tag}:").cast("binary"), col(content).cast("binary")), 256)


#: Unicode white space, which a preview is trimmed of.
_BLANK = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def preview(text: Column | str, limit: int = 96) -> Column:
    """One trimmed line of at most ``limit`` bytes, cut between characters, with dots where something was cut."""
    line = F.regexp_replace(F.regexp_replace(col(text), f"^{_BLANK}|{_BLANK}$", ""), "\n", " ")
    raw = F.encode(line, "UTF-8")
    # the byte after the cut is a continuation byte as long as the cut is within a character
    ends = [F.when(~F.rlike(F.hex(F.substring(raw, limit + 1 - k, 1)), F.lit("^[89AB]")), limit - k) for k in range(4)]
    cut = F.coalesce(*ends, F.lit(limit - 3))
    return F.when(F.octet_length(line) <= limit, line).otherwise(F.concat(F.decode(F.substring(raw, F.lit(1), cut), "UTF-8"), F.lit("...")))


def key_level(key: Column | str, bits: int = 5, most: int = 16) -> Column:
    """How many times ``bits`` leading zero bits the digest of a key has: the level up to which it ends a node."""
    hexed = F.sha2(col(key).cast("binary"), 256)
    zeros = F.length(F.regexp_extract(hexed, "^0*", 0))
    nibble = F.conv(F.substring(hexed, zeros + 1, F.lit(1)), 16, 10).cast("int")
    rest = F.when(nibble >= 8, 0).when(nibble >= 4, 1).when(nibble >= 2, 2).otherwise(3)
    return F.least(F.floor((zeros * 4 + rest) / bits).cast("int"), F.lit(most))


def prefix_end(prefix: str) -> str | None:
    """The smallest string, in order of UTF-8 bytes, above all that begin with the prefix, or None where there is no bound."""
    p = prefix
    while p and ord(p[-1]) == 0x10FFFF:
        p = p[:-1]
    if not p:
        return None
    after = ord(p[-1]) + 1
    return p[:-1] + chr(0xE000 if after == 0xD800 else after)  # surrogates are no characters


def prefix_upper(prefix: bytes) -> bytes | None:
    """The smallest bytes above all that begin with the prefix, or None where there is no bound."""
    p = prefix.rstrip(b"\xff")
    return p[:-1] + bytes([p[-1] + 1]) if p else None
