"""Named references as logs: every change is a file of its own that only one writer can create.

A reference's value is what the file with the largest number says. Setting it creates the next number, which
fails if somebody else did so first: that is the compare-and-set, and what is written is whole or not there, so
there is nothing to recover after a crash.
"""

from __future__ import annotations

import json
import re

from palimpsest.engine.fs import Conflict, Folder, quoted, unquoted
from palimpsest.functions.codec import parse_hash

KINDS = ("heads", "states", "checkpoints", "queries")
DEPTH = 5
_NAME = re.compile(r"[A-Za-z0-9_./-]+")


def valid_name(name: str) -> bool:
    """Letters, digits and ``_-/.``; at most five parts, none empty or with a dot first; no ``..``, no dash first, no dot or ``.lock`` last."""
    parts = name.split("/")
    return bool(_NAME.fullmatch(name)) and len(parts) <= DEPTH and all(p and p[0] != "." for p in parts) and ".." not in name and name[0] != "-" and not name.endswith((".", ".lock"))


def check_name(name: str) -> str:
    if not isinstance(name, str) or not valid_name(name):
        raise ValueError(f"not a reference name: {name!r}")
    return name


def check_tenant(name: str) -> str:
    if "/" in check_name(name):
        raise ValueError("a tenant's name has no slash")
    return name


class Refs:
    def __init__(self, folder: Folder):
        self.folder = folder

    def _at(self, kind: str, name: str) -> str:
        if kind not in KINDS:
            raise ValueError(f"no such kind of reference: {kind}")
        return f"refs/{kind}/{quoted(check_name(name))}"

    def versions(self, kind: str, name: str) -> list[int]:
        return [int(f[:-5]) for f in self.folder.list(self._at(kind, name)) if f.endswith(".json")]

    def _last(self, kind: str, name: str) -> tuple[int, str | None]:
        found = self.versions(kind, name)
        if not found:
            return -1, None
        return found[-1], json.loads(self.folder.read(f"{self._at(kind, name)}/{found[-1]:012}.json"))["hash"]

    def get(self, kind: str, name: str) -> str | None:
        return self._last(kind, name)[1]

    def set(self, kind: str, name: str, value: str) -> None:
        """Whatever it was before."""
        while True:
            try:
                return self.swap(kind, name, self.get(kind, name), value)
            except Conflict:
                continue

    def swap(self, kind: str, name: str, expected: str | None, value: str) -> None:
        """Sets a reference that is as expected (None: that isn't there), or raises ``Conflict``."""
        n, now = self._last(kind, name)
        if now != expected:
            raise Conflict(f"{kind}/{name} is {now}, not {expected}")
        entry = {"expected": expected, "hash": parse_hash(value)}
        self.folder.write(f"{self._at(kind, name)}/{n + 1:012}.json", json.dumps(entry).encode(), new=True)

    def names(self, kind: str) -> list[str]:
        return sorted(unquoted(n) for n in self.folder.list(f"refs/{kind}"))

    def all(self, kind: str) -> dict[str, str]:
        """Values by name, in order of the names."""
        return {n: v for n in self.names(kind) if (v := self.get(kind, n)) is not None}
