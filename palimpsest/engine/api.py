"""The database's calls by route, as a server would have them: JSON in, (status, JSON) out.

``Api.handle`` needs no network: it takes a method, a path, a body and a token. A key's role says what it may do and
its tenant, if it has one, where: heads below ``tenant/``, and only what was ingested for it.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Callable
from urllib.parse import parse_qs, urlsplit

from palimpsest.engine.db import META, MIN_CHUNK, Database, Signer, verify_chunk_proof
from palimpsest.engine.fs import Conflict
from palimpsest.engine.governance import ROLES, Audit, Erasure, Keys, Policies, Sessions, compliance
from palimpsest.functions import codec

FILTERS = ("tenant", "doc_type", "language")


class Api:
    def __init__(self, db: Database, *, signer: Signer | None = None, open_access: bool = False):
        self.db, self.signer, self.open = db, signer, open_access
        self.routes: list[tuple[str, re.Pattern, str, Callable]] = [
            ("GET", r"/v1/health", "", self.health), ("GET", r"/v1/refs", "reader", self.refs), ("POST", r"/v1/blobs", "writer", self.blob_put), ("GET", r"/v1/blobs/(?P<hash>[^/]+)", "reader", self.blob_get),
            ("POST", r"/v1/state/get", "reader", self.state_get), ("POST", r"/v1/state/set", "writer", self.state_set), ("POST", r"/v1/state/delete", "writer", self.state_delete), ("POST", r"/v1/state/prove", "reader", self.state_prove),
            ("POST", r"/v1/documents", "writer", self.ingest), ("POST", r"/v1/runs", "writer", self.run), ("POST", r"/v1/commits", "writer", self.commit), ("POST", r"/v1/search", "reader", self.search),
            ("POST", r"/v1/proofs/chunk", "reader", self.proof), ("POST", r"/v1/proofs/verify", "reader", self.proof_verify), ("POST", r"/v1/sessions/append", "writer", self.session_append), ("POST", r"/v1/sessions/list", "reader", self.session_list),
            ("POST", r"/v1/checkpoints", "writer", self.checkpoint), ("POST", r"/v1/pack/export", "admin", self.export), ("POST", r"/v1/pack", "admin", self.merge), ("GET", r"/v1/compliance/summary", "reader", self.compliance),
            ("POST", r"/v1/audit/queries", "reader", self.audit), ("POST", r"/v1/audit/export", "reader", self.audit_export), ("GET", r"/v1/policy", "reader", self.policy_get), ("POST", r"/v1/policy", "admin", self.policy_set),
            ("POST", r"/v1/policy/evaluate", "reader", self.policy_evaluate), ("GET", r"/v1/events", "reader", self.events), ("POST", r"/v1/erasure", "admin", self.erase), ("GET", r"/v1/erasure", "reader", self.erasures),
        ]
        self.routes = [(m, re.compile(p), r, f) for m, p, r, f in self.routes]  # type: ignore[arg-type]

    def handle(self, method: str, path: str, body: bytes | str | dict | None = None, token: str | None = None) -> tuple[int, dict]:
        at = urlsplit(path)
        try:
            who = self._who(token)
            for verb, pattern, role, call in self.routes:
                m = pattern.fullmatch(at.path)
                if m and verb == method:
                    if role:
                        self._require(who, role)
                    given = body if isinstance(body, dict) else json.loads(body) if body else {}
                    if not isinstance(given, dict):
                        raise ValueError("the body is not an object")
                    return 200, call({k: v[-1] for k, v in parse_qs(at.query).items()} | given | m.groupdict(), who)
            known = any(p.fullmatch(at.path) for _, p, _, _ in self.routes)
            return (405, {"error": "method_not_allowed"}) if known else (404, {"error": "not_found", "detail": at.path})
        except PermissionError as e:
            return (401 if str(e) == "unauthorized" else 403), {"error": "unauthorized" if str(e) == "unauthorized" else "forbidden", "detail": str(e)}
        except Conflict as e:
            return 409, {"error": "conflict", "detail": str(e)}
        except (KeyError, FileNotFoundError) as e:
            return 404, {"error": "not_found", "detail": str(e)}
        except (ValueError, TypeError) as e:
            return 400, {"error": "bad_request", "detail": str(e)}

    def _who(self, token: str | None) -> dict:
        if token is None:
            if not self.open and Keys(self.db).load():
                return {"id": None, "role": None, "tenant": None}
            return {"id": None, "role": "admin", "tenant": None}
        found = Keys(self.db).authenticate(token)
        if found is None:
            raise PermissionError("unauthorized")
        return found

    @staticmethod
    def _require(who: dict, role: str) -> None:
        if who["role"] is None:
            raise PermissionError("unauthorized")
        if ROLES.index(who["role"]) < ROLES.index(role):
            raise PermissionError(f"this needs the role {role}")

    @staticmethod
    def _untenanted(who: dict) -> None:
        if who["tenant"]:
            raise PermissionError("keys of a tenant can't do this")

    @staticmethod
    def _text(v: dict, name: str) -> str:
        if not isinstance(v.get(name), str) or not v[name]:
            raise ValueError(f"{name} is missing")
        return v[name]

    def _head(self, v: dict, who: dict, name: str = "head") -> str:
        head = self._text(v, name)
        if who["tenant"] and not head.startswith(f"{who['tenant']}/"):
            raise PermissionError(f"{head} is not of this tenant")
        return head

    def _gate(self, op: str, head: str, who: dict, **more) -> None:
        Policies(self.db).gate(op, head, who["id"], **more)

    def health(self, v, who):
        return {"status": "ok"}

    def refs(self, v, who):
        mine = lambda n: not who["tenant"] or n.startswith(f"{who['tenant']}/")
        return {kind: {n: h for n, h in self.db.refs.all(kind).items() if mine(n)} for kind in ("heads", "states", "checkpoints")}

    def blob_put(self, v, who):
        self._gate("blobs", "", who)
        return {"hash": self.db.blobs.put(codec.b64_field(v, "data_base64"))}

    def blob_get(self, v, who):
        self._untenanted(who)
        return {"data_base64": base64.b64encode(self.db.blobs.get(codec.parse_hash(v["hash"]))).decode()}

    def _key(self, v) -> bytes:
        return codec.key_bytes(self._text(v, "key"), v.get("encoding", "utf8"))

    def state_get(self, v, who):
        head = self._head(v, who)
        value = self.db.get_state(self.db.staged(head), self._key(v))
        return {"found": value is not None, "value_base64": None if value is None else base64.b64encode(value).decode()}

    def state_set(self, v, who):
        head = self._head(v, who)
        self._gate("state", head, who)
        return {"root": self.db.set_state(head, self._key(v), codec.b64_field(v, "value_base64"))}

    def state_delete(self, v, who):
        head = self._head(v, who)
        self._gate("state", head, who)
        return {"root": self.db.delete_state(head, self._key(v))}

    def state_prove(self, v, who):
        root = self.db.staged(self._head(v, who))
        return {"root": root, "proof": self.db.prove_state(root, self._key(v))}

    def ingest(self, v, who):
        head, size = self._head(v, who), v.get("chunk_size", 512)
        overlap = v.get("overlap", min(64, size // 2) if isinstance(size, int) else None)
        if not isinstance(size, int) or not isinstance(overlap, int) or size < MIN_CHUNK or not 0 <= overlap <= size // 2:
            raise ValueError(f"chunk_size must be at least {MIN_CHUNK} and overlap at most half of it")
        meta = dict(v.get("metadata") or {})
        if who["tenant"]:
            meta["tenant"] = who["tenant"]
        if bad := set(meta) - set(META):
            raise ValueError(f"unknown metadata: {', '.join(sorted(bad))}")
        self._gate("documents", head, who)
        manifest, commit = self.db.put_document(head, self._text(v, "source"), v.get("text") if isinstance(v.get("text"), str) else self._text(v, "text"), who["id"] or "server", meta=meta, size=size, overlap=overlap)
        return {"manifest": manifest, "commit": commit}

    def run(self, v, who):
        head, model, now = self._head(v, who), self._text(v, "model"), codec.now_unix()
        lists = {k: [codec.parse_hash(h) for h in v.get(k) or []] for k in ("inputs", "outputs", "retrieved_chunks")}
        self._gate("runs", head, who, provenance=bool(isinstance(v.get("provider"), str) or lists["inputs"] or lists["retrieved_chunks"]))
        put = self.db.blobs.put
        value = {
            "model": model, "prompt": put((v.get("prompt") or "").encode()), "tool_calls": [], **lists, "started_at": v.get("started_at", now), "ended_at": v.get("ended_at", now),
            "system_prompt": put(v["system_prompt"].encode()) if isinstance(v.get("system_prompt"), str) else None,
            "model_parameters": put(codec.parameters(v["model_parameters"])) if v.get("model_parameters") else None,
            "parent_span": codec.parse_hash(v["parent_span"]) if v.get("parent_span") else None,
        } | {k: v.get(k) for k in ("provider", "sdk_version", "agent_id", "trace_id", "delegated_from", "subject")}
        manifest = self.db.put_manifest("run", value)
        commit = self.db.commit(head, who["id"] or "server", v.get("message") or f"{model} run", [manifest]) if v.get("commit", True) else None
        return {"manifest": manifest, "commit": commit}

    def commit(self, v, who):
        head = self._head(v, who)
        self._gate("commits", head, who)
        return {"commit": self.db.commit(head, who["id"] or "server", self._text(v, "message"), [codec.parse_hash(m) for m in v.get("manifests") or []])}

    def search(self, v, who):
        at = self._text(v, "at")
        whole = codec.HEX.fullmatch(at)
        if not whole:
            self._head(v, who, "at")
        given = v.get("filter") or {}
        filters = {k: given.get(k) for k in FILTERS} | ({"tenant": who["tenant"]} if who["tenant"] else {})
        mode, top = v.get("mode", "hybrid"), v.get("top_k", 10)
        commit = self.db.commit_of(at)
        hits = self.db.search(commit, v.get("query"), v.get("embedding"), top=top, mode=mode, tags=tuple(given.get("acl") or ()), time=given.get("at"), **filters)
        manifest = None
        if v.get("audit"):
            if whole:
                raise ValueError("an audited search needs a head, to which the record is committed")
            self._require(who, "writer")
            self._gate("search", at, who)
            manifest = Audit(self.db).record(at, commit, mode, hits, query=v.get("query"), embedding=v.get("embedding"), top=top, filters={k: x for k, x in filters.items() if x}, principal=who["id"])
        return {"commit": commit, "hits": hits, "audit_manifest": manifest}

    def proof(self, v, who):
        if v.get("include_content"):
            self._untenanted(who)
        return {"proof": self.db.prove_chunk(codec.parse_hash(self._text(v, "commit")), codec.parse_hash(self._text(v, "chunk")), content=bool(v.get("include_content")))}

    def proof_verify(self, v, who):
        try:
            return {"valid": True, "anchor": verify_chunk_proof(v["proof"])}
        except (ValueError, KeyError, TypeError) as e:
            return {"valid": False, "detail": str(e)}

    def session_append(self, v, who):
        head = self._head(v, who)
        self._gate("sessions", head, who)
        seq, name = Sessions(self.db).append(head, self._text(v, "session"), self._text(v, "content").encode(), role=v.get("role"), ttl=v.get("ttl_secs"))
        return {"seq": seq, "content": name}

    def session_list(self, v, who):
        now = None if v.get("all") else v.get("now", codec.now_unix())
        turns = Sessions(self.db).list(self._head(v, who), self._text(v, "session"), now)
        return {"turns": [t | {"bytes": None if t["bytes"] is None else base64.b64encode(t["bytes"]).decode()} for t in turns]}

    def checkpoint(self, v, who):
        head = self._head(v, who)
        self._gate("checkpoints", head, who)
        return {"checkpoint": self.db.checkpoint(head, signer=self.signer)}

    def export(self, v, who):
        from palimpsest.sources import snapshot

        self._untenanted(who)
        snapshot.export({n: self.db.tables.read(n) for n in ("blobs", "objects", "chunks")}, self._text(v, "to"))
        return {"written": v["to"]}

    def merge(self, v, who):
        self._untenanted(who)
        self._gate("pack", "", who)
        return self.db.merge(Database(self.db.spark, self._text(v, "from"), password=v.get("password")))

    def compliance(self, v, who):
        mine = [x for x in compliance(self.db) if not who["tenant"] or x["head"].startswith(f"{who['tenant']}/")]
        return {"heads": mine}

    def audit(self, v, who):
        return {"records": Audit(self.db).collect(self._head(v, who), int(v.get("from", 0)), v.get("to"))}

    def audit_export(self, v, who):
        to = v.get("to") if v.get("to") is not None else codec.now_unix()
        return {"bundle_base64": base64.b64encode(Audit(self.db).export(self._head(v, who), int(v.get("from", 0)), to, signer=self.signer)).decode()}

    def policy_get(self, v, who):
        return Policies(self.db).load()

    def policy_set(self, v, who):
        Policies(self.db).store(v.get("policies") or [], v.get("webhook"))
        return Policies(self.db).load()

    def policy_evaluate(self, v, who):
        return Policies(self.db).evaluate(v.get("head"))

    def events(self, v, who):
        self._untenanted(who)
        rows = [r.asDict() for r in self.db.events.since(int(v.get("since", -1))).collect()]
        out = {"events": rows}
        if v.get("verify"):
            out["valid"] = self.db.events.faults().isEmpty()
        return out

    def erase(self, v, who):
        self._untenanted(who)
        return Erasure(self.db).erase(self._text(v, "subject"), self._text(v, "reason"), requested_by=who["id"], signer=self.signer)

    def erasures(self, v, who):
        self._untenanted(who)
        return {"records": Erasure(self.db).list()}
