"""Plain values outside of queries: canonical bytes, digests, keys, times, comparisons."""

from __future__ import annotations

import base64
import binascii
import hashlib
import hmac
import json
import re
import time

HEX = re.compile(r"[0-9a-f]{64}")


def canonical(value) -> bytes:
    """Sorted-key JSON without blanks: equal values have equal bytes."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode()


def decoded(body: bytes | str):
    """The value of canonical bytes; ValueError if they aren't canonical."""
    body = body.encode() if isinstance(body, str) else bytes(body)
    value = json.loads(body)
    if canonical(value) != body:
        raise ValueError("not canonical")
    return value


def digest(tag: str, content: bytes) -> str:
    """Hex digest under a domain tag, the same as ``functions.text.digest`` has in a query."""
    return hashlib.sha256(tag.encode() + b":" + content).hexdigest()


def parse_hash(text: str) -> str:
    if not HEX.fullmatch(text.lower()):
        raise ValueError("a hash has 64 hexadecimal digits")
    return text.lower()


def same(a: bytes | str, b: bytes | str) -> bool:
    """Comparison in constant time."""
    return hmac.compare_digest(*(x.encode() if isinstance(x, str) else x for x in (a, b)))


def key_bytes(key: str, encoding: str = "utf8") -> bytes:
    """A key given as text, hexadecimal digits or base64."""
    try:
        return {"utf8": str.encode, "hex": bytes.fromhex, "base64": lambda k: base64.b64decode(k, validate=True)}[encoding](key)
    except KeyError:
        raise ValueError(f"unknown encoding {encoding}") from None
    except (ValueError, binascii.Error):
        raise ValueError(f"not {encoding}: {key[:40]}") from None


def b64_field(record: dict, name: str) -> bytes:
    if not isinstance(record.get(name), str):
        raise ValueError(f"{name} is missing")
    return key_bytes(record[name], "base64")


def parameters(given: dict | None, flags: list[str] = ()) -> bytes | None:
    """Canonical model parameters; ``name=value`` flags go before those given, and a value that is JSON counts as such."""
    out = dict(given or {})
    for flag in flags:
        name, at, value = flag.partition("=")
        if not at or not name:
            raise ValueError(f"not name=value: {flag}")
        try:
            out[name] = json.loads(value)
        except ValueError:
            out[name] = value
    return canonical(out) if out else None


def io_hashes(values: list[str]) -> tuple[list[str], list[str]]:
    """Inputs and outputs of ``in:<hash>`` and ``out:<hash>``."""
    found: dict[str, list[str]] = {"in": [], "out": []}
    for v in values:
        side, _, h = v.partition(":")
        if side not in found:
            raise ValueError(f"neither in: nor out: {v}")
        found[side].append(parse_hash(h))
    return found["in"], found["out"]


def embedding(content: bytes | str) -> list[float]:
    """A vector written as a JSON array of numbers, or as CBOR array of floats or doubles."""
    raw = content.encode() if isinstance(content, str) else bytes(content)
    if raw[:1].strip() == b"[" or raw.lstrip()[:1] == b"[":
        v = json.loads(raw)
    else:
        v = _cbor_floats(raw)
    if not isinstance(v, list) or not all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in v):
        raise ValueError("an embedding is an array of numbers")
    return [float(x) for x in v]


def _cbor_floats(raw: bytes) -> list[float]:
    import struct

    if not raw or raw[0] >> 5 != 4:
        raise ValueError("neither JSON nor a CBOR array")

    def size(at: int) -> tuple[int, int]:
        low = raw[at] & 31
        if low < 24:
            return low, at + 1
        if low > 27:
            raise ValueError("unsupported CBOR length")
        n = 1 << (low - 24)
        return int.from_bytes(raw[at + 1 : at + 1 + n], "big"), at + 1 + n

    n, at = size(0)
    out = []
    for _ in range(n):
        if at >= len(raw):
            raise ValueError("CBOR ends early")
        kind = raw[at]
        width = {0xF9: 2, 0xFA: 4, 0xFB: 8}.get(kind)
        if width:
            if at + 1 + width > len(raw):
                raise ValueError("CBOR ends early")
            out.append(struct.unpack(">" + {2: "e", 4: "f", 8: "d"}[width], raw[at + 1 : at + 1 + width])[0])
            at += 1 + width
        elif kind >> 5 in (0, 1):
            v, at = size(at)
            out.append(float(v if kind >> 5 == 0 else -1 - v))
        else:
            raise ValueError("not an array of numbers")
    if at != len(raw):
        raise ValueError("bytes after the CBOR array")
    return out


def now_unix() -> int:
    return int(time.time())
