"""Commands on a database: ``python -m palimpsest.engine.cli ROOT GROUP COMMAND ...``, JSON on standard output.

Every command is a call of ``api.Api`` or of the database; ``bundle verify`` and ``proof verify-chunk`` read a file alone.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="palimpsest")
    p.add_argument("root")
    p.add_argument("--password")
    groups = p.add_subparsers(dest="group", required=True)

    def command(group, name: str, *args: str, **options):
        c = group.add_parser(name)
        for a in args:
            c.add_argument(a)
        for o, kind in options.items():
            c.add_argument(f"--{o.replace('_', '-')}", dest=o, **({"action": "store_true"} if kind is bool else {"action": "append"} if kind is list else {"type": kind}))

    def group(name: str):
        return groups.add_parser(name).add_subparsers(dest="command", required=True)

    g = group("db")
    command(g, "init", retention=int)
    command(g, "repack")
    command(g, "gc", prune=bool, grace=int)
    command(g, "reencrypt", "new_password")
    command(g, "merge", "source")
    g = group("blob")
    command(g, "put", "file")
    command(g, "get", "hash")
    g = group("state")
    for name, args in (("set", ("head", "key", "value")), ("get", ("head", "key")), ("del", ("head", "key")), ("scan", ("head", "prefix")), ("prove", ("head", "key"))):
        command(g, name, *args, encoding=str)
    command(g, "set-many", "head", "file")
    command(g, "del-many", "head", "file")
    g = group("manifest")
    command(g, "put-doc", "head", "source", "file", chunk_size=int, overlap=int)
    command(g, "put-run", "head", "model", prompt=str, io=list, param=list)
    g = group("commit")
    command(g, "new", "head", "message", manifest=list, key=str)
    command(g, "verify", "commit", public=str)
    g = group("search")
    for mode in ("semantic", "vector", "hybrid"):
        command(g, mode, "at", query=str, embedding=str, top=int, tenant=str, doc_type=str, language=str, acl=list, time=int)
    g = group("index")
    command(g, "stats", "at")
    g = group("log")
    command(g, "show", "at")
    g = group("object")
    command(g, "inspect", "hash")
    g = group("proof")
    command(g, "chunk", "commit", "chunk", content=bool)
    command(g, "verify-chunk", "file")
    g = group("checkpoint")
    command(g, "new", "head", key=str)
    command(g, "verify", "head", public=str, signed=bool)
    g = group("session")
    command(g, "append", "head", "session", "content", role=str, ttl=int)
    command(g, "list", "head", "session", now=int)
    command(g, "gc", "head", "now")
    g = group("audit")
    command(g, "log", "head")
    command(g, "export", "head", "file", frm=int, to=int, key=str)
    command(g, "verify", "file", public=str, signed=bool)
    g = group("policy")
    command(g, "list")
    command(g, "set", "file")
    command(g, "rm", "id")
    command(g, "eval", head=str)
    g = group("events")
    command(g, "list", since=int)
    command(g, "verify")
    g = group("erasure")
    command(g, "request", "subject", "reason", key=str)
    command(g, "list")
    g = group("auth")
    command(g, "add-key", "id", "role", tenant=str)
    command(g, "remove-key", "id")
    command(g, "list-keys")
    g = group("key")
    command(g, "generate", "file")
    return p


def run(argv: list[str], spark=None):
    """What a command returns, as plain values."""
    from palimpsest.engine import governance as G
    from palimpsest.engine.db import Database, Signer, verify_chunk_proof
    from palimpsest.functions import codec

    a = parser().parse_args(argv)
    what = f"{a.group} {a.command}"
    if what == "audit verify":
        return G.verify_bundle(Path(a.file).read_bytes(), public_key=a.public, signed=a.signed)
    if what == "proof verify-chunk":
        return {"anchor": verify_chunk_proof(json.loads(Path(a.file).read_text()))}
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.getOrCreate()
    if what == "db init":
        Database.create(spark, a.root, password=a.password, retention=a.retention)
        return {"created": a.root}
    db = Database(spark, a.root, password=a.password)
    key = lambda: Signer(bytes.fromhex(db.folder.read(f"keys/{a.key}").decode())) if a.key else None
    at = lambda k: codec.key_bytes(k, a.encoding or "utf8")
    rows = lambda df: [r.asDict() for r in df.collect()]
    text = lambda b: None if b is None else b.decode("utf-8", "replace")

    def ingest():
        manifest, commit = db.put_document(a.head, a.source, Path(a.file).read_text(), "cli", **({"size": a.chunk_size} if a.chunk_size else {}) | ({"overlap": a.overlap} if a.overlap is not None else {}))
        return {"manifest": manifest, "commit": commit}

    def record():
        ins, outs = codec.io_hashes(a.io or [])
        params = codec.parameters(None, a.param or [])
        m = db.put_manifest("run", {"model": a.model, "prompt": db.blobs.put((a.prompt or "").encode()), "inputs": ins, "outputs": outs, "model_parameters": db.blobs.put(params) if params else None})
        return {"manifest": m, "commit": db.commit(a.head, "cli", f"{a.model} run", [m])}

    def search():
        return db.search(a.at, a.query, codec.embedding(a.embedding) if a.embedding else None, top=a.top or 10, mode=a.command, tenant=a.tenant, doc_type=a.doc_type, language=a.language, tags=tuple(a.acl or ()), time=a.time)

    calls = {
        "db repack": db.compact, "db gc": lambda: db.collect_garbage(prune=a.prune, grace=a.grace or 0), "db reencrypt": lambda: {"blobs": db.rekey(a.new_password)}, "db merge": lambda: db.merge(Database(spark, a.source, password=a.password)),
        "blob put": lambda: {"hash": db.blobs.put(Path(a.file).read_bytes())}, "blob get": lambda: {"text": text(db.blobs.get(a.hash))},
        "state set": lambda: {"root": db.set_state(a.head, at(a.key), a.value.encode())}, "state get": lambda: {"value": text(db.get_state(db.staged(a.head), at(a.key)))}, "state del": lambda: {"root": db.delete_state(a.head, at(a.key))},
        "state scan": lambda: [{"key": text(bytes(r.key)), "value": text(bytes(r.value))} for r in db.scan_state(db.staged(a.head), at(a.prefix)).collect()], "state prove": lambda: {"root": db.staged(a.head), "proof": db.prove_state(db.staged(a.head), at(a.key))},
        "state set-many": lambda: {"root": db.update_state(a.head, [(x["key"].encode(), codec.b64_field(x, "value_base64")) for x in json.loads(Path(a.file).read_text())])},
        "state del-many": lambda: {"root": db.update_state(a.head, [(x.encode(), None) for x in json.loads(Path(a.file).read_text())])},
        "manifest put-doc": ingest, "manifest put-run": record, "commit new": lambda: {"commit": db.commit(a.head, "cli", a.message, a.manifest or [], signer=key())}, "commit verify": lambda: {"valid": db.verify_commit(a.commit, a.public)},
        "search semantic": search, "search vector": search, "search hybrid": search, "index stats": lambda: db.index_stats(db.commit_of(a.at)), "log show": lambda: [{"commit": n} | v for n, v in db.history(db.commit_of(a.at))],
        "object inspect": lambda: dict(zip(("kind", "value"), db.objects.inspect(a.hash))), "proof chunk": lambda: db.prove_chunk(a.commit, a.chunk, content=a.content),
        "checkpoint new": lambda: {"checkpoint": db.checkpoint(a.head, signer=key())}, "checkpoint verify": lambda: db.verify_chain(a.head, public_key=a.public, signed=a.signed),
        "session append": lambda: dict(zip(("seq", "content"), G.Sessions(db).append(a.head, a.session, a.content.encode(), role=a.role, ttl=a.ttl))), "session list": lambda: [t | {"bytes": text(t["bytes"])} for t in G.Sessions(db).list(a.head, a.session, a.now)],
        "session gc": lambda: {"deleted": G.Sessions(db).collect_garbage(a.head, int(a.now))}, "audit log": lambda: G.Audit(db).collect(a.head),
        "audit export": lambda: {"bytes": Path(a.file).write_bytes(G.Audit(db).export(a.head, a.frm or 0, codec.now_unix() if a.to is None else a.to, signer=key()))},
        "policy list": lambda: G.Policies(db).load(), "policy set": lambda: G.Policies(db).upsert(json.loads(Path(a.file).read_text())), "policy rm": lambda: {"removed": G.Policies(db).remove(a.id)}, "policy eval": lambda: G.Policies(db).evaluate(a.head),
        "events list": lambda: rows(db.events.since(-1 if a.since is None else a.since)), "events verify": lambda: {"faults": rows(db.events.faults())}, "erasure request": lambda: G.Erasure(db).erase(a.subject, a.reason, signer=key()), "erasure list": lambda: G.Erasure(db).list(),
        "auth add-key": lambda: {"token": G.Keys(db).add(a.id, a.role, a.tenant)}, "auth remove-key": lambda: {"removed": G.Keys(db).remove(a.id)}, "auth list-keys": lambda: G.Keys(db).list(),
        "key generate": lambda: {"public": _keypair(db, a.file)},
    }
    return calls[what]()


def _keypair(db, name: str) -> str:
    from palimpsest.engine.db import new_keypair

    return new_keypair(db.folder, f"keys/{name}")


def main() -> int:
    try:
        print(json.dumps(run(sys.argv[1:]), ensure_ascii=False, default=str))
        return 0
    except (ValueError, KeyError, OSError, PermissionError) as e:
        print(json.dumps({"error": str(e)}), file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
