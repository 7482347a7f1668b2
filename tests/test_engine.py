"""The database end to end: what is written is found again, what is changed is noticed."""

import base64
import json

import pytest
from pyspark.sql import functions as F

from palimpsest.engine import governance as G
from palimpsest.engine.api import Api
from palimpsest.engine.db import Database, Signer, new_keypair, signature_holds, verify_chunk_proof
from palimpsest.engine.fs import Conflict
from palimpsest.engine.refs import valid_name
from palimpsest.functions import codec
from palimpsest.plans import merkle, statetree

SECRET = bytes(range(32))


@pytest.fixture
def db(spark, tmp_path):
    return Database.create(spark, f"{tmp_path}/db", retention=100)


def test_blobs_once_and_checked(spark, db):
    a = db.blobs.put(b"one")
    db.blobs.put_many(spark.createDataFrame([("one",), ("two",), ("two",), (None,)], "bytes string"))
    assert db.blobs.listed().count() == 2 and db.blobs.get(a) == b"one" and db.blobs.exists(a) and not db.blobs.exists("0" * 64)
    with pytest.raises(KeyError):
        db.blobs.get("0" * 64)
    assert db.blobs.compact() == {"batches_before": 2, "batches_after": 1} and db.blobs.faults().isEmpty()
    db.tables.append("blobs", spark.createDataFrame([("1" * 64, bytearray(b"x"), 1, 0)], "hash string, bytes binary, n_bytes long, stored_at long"))
    assert [r.fault for r in db.blobs.faults().collect()] == ["changed"]
    with pytest.raises(ValueError):
        db.blobs.get("1" * 64)
    db.blobs.shred(spark.createDataFrame([("1" * 64,)], "hash string"))
    assert db.blobs.faults().isEmpty() and db.blobs.listed().count() == 2


def test_loose_files(spark, db, tmp_path):
    (tmp_path / "loose/ab").mkdir(parents=True)
    (tmp_path / "loose/ab/x").write_bytes(b"\0bin")
    (row,) = db.blobs.add_files(f"{tmp_path}/loose").collect()
    assert db.blobs.get(row.hash) == b"\0bin"


def test_encryption_and_rekeying(spark, tmp_path):
    db = Database.create(spark, f"{tmp_path}/e", password="first")
    h = db.blobs.put(b"secret text")
    assert bytes(db.tables.read("blobs").first().bytes) != b"secret text" and db.blobs.get(h) == b"secret text"
    for wrong in (None, "second"):
        with pytest.raises(PermissionError):
            Database(spark, f"{tmp_path}/e", password=wrong)
    assert db.rekey("second") == 1
    again = Database(spark, f"{tmp_path}/e", password="second")
    assert again.blobs.get(h) == b"secret text"
    with pytest.raises(PermissionError):
        Database(spark, f"{tmp_path}/e", password="first")


def test_references(db):
    a, b = "a" * 64, "b" * 64
    db.refs.swap("heads", "x/main", None, a)
    with pytest.raises(Conflict):
        db.refs.swap("heads", "x/main", None, b)
    db.refs.swap("heads", "x/main", a, b)
    assert db.refs.all("heads") == {"x/main": b} and db.refs.versions("heads", "x/main") == [0, 1]
    assert all(map(valid_name, ["a", "a/b/c/d/e", "A-1_.x"])) and not any(map(valid_name, ["", "/a", "a/", "-a", ".a", "a/.b", "a..b", "a//b", "a.", "a.lock", "a b", "a/b/c/d/e/f", "é"]))


def test_state_versions_and_proofs(db):
    r1 = db.set_state("main", b"k1", b"v1")
    r2 = db.update_state("main", [(b"k2", b"v2"), (b"k1", None), (b"k2", b"w2"), (b"k\xff", b"x" * 600)])
    assert db.get_state(r1, b"k1") == b"v1" and db.get_state(r2, b"k1") is None and db.get_state(r2, b"k2") == b"w2"
    assert [bytes(r.key) for r in db.scan_state(r2, b"k").collect()] == [b"k2", b"k\xff"] and db.scan_state(r2, b"k2").count() == 1
    assert {bytes(r.key): r.inline is None for r in db.state_refs(r2).collect()} == {b"k2": False, b"k\xff": True}
    for key, want in ((b"k2", statetree.value_hash(b"w2")), (b"k1", None)):
        p = db.prove_state(r2, key)
        assert p["found"] == want and statetree.proves(r2, key, p) and not statetree.proves(r1, key, p)
    other = db.update_state("other", [(b"k\xff", b"x" * 600), (b"k2", b"w2")])
    assert other == r2  # the same content has the same root
    assert db.delete_state("other", b"none") == r2 and db.staged("new") == statetree.EMPTY


def docs(spark):
    rows = [("a", "quark quark mass and energy", "t1", None, None), ("b", "the mass of a house", "t1", ["group:hr"], None), ("c", "quark from another tenant", "t2", None, 50), ("d", "Ünïcode long text " * 90, "t1", None, None)]
    return spark.createDataFrame(rows, "source string, text string, tenant string, acl array<string>, expires_at long")


def test_ingest_search_history_and_proofs(spark, db):
    made, first = db.put_documents("main", docs(spark), "me", size=256, now=10)
    assert made.count() == 4
    manifest, second = db.put_document("main", "e", "a later note on quark charm", "me", meta={"tenant": "t1"}, signer=Signer(SECRET), now=20)
    assert [h["preview"] for h in db.search("main", "quark", mode="semantic", tenant="t1")] == ["quark quark mass and energy", "a later note on quark charm"]
    assert [h["preview"] for h in db.search(first, "quark", mode="semantic", tenant="t1")] == ["quark quark mass and energy"]
    assert len(db.search("main", "mass", mode="semantic")) == 1 and len(db.search("main", "mass", mode="semantic", tags=("group:hr",))) == 2
    assert len(db.search("main", "tenant", mode="semantic", time=60)) == 0 and len(db.search("main", "tenant", mode="semantic", time=40)) == 1
    hits = {h["preview"]: h["chunk"] for h in db.search("main", "quark", mode="semantic")}
    vector = db.put_manifest("chunk", {"chunk": hits["quark quark mass and energy"], "vector": [1.0, 0.0]})
    db.commit("main", "me", "vector", [vector])
    (best,) = db.search("main", embedding=[2.0, 0.0], mode="vector")
    assert best["preview"] == "quark quark mass and energy" and best["score"] == 1.0
    assert db.search("main", "charm", [1.0, 0.0])[0]["score"] > 0 and len(db.search("main", "charm", [1.0, 0.0], top=1)) == 1
    for bad in ({"mode": "other"}, {"mode": "hybrid"}, {"mode": "vector", "query": "x"}):
        with pytest.raises(ValueError):
            db.search("main", **bad)
    stats = db.index_stats(db.commit_of("main"))
    assert stats["embeddings"] == 1 and stats["dim"] == 2 and stats["chunks"] > 8
    log = db.history(db.commit_of("main"))
    assert [v["generation"] for _, v in log] == [2, 1, 0] and db.verify_commit(second) and not db.verify_commit(first)
    assert db.is_ancestor(first, second) and not db.is_ancestor(second, first)
    proof = db.prove_chunk(db.commit_of("main"), hits["quark quark mass and energy"], content=True)
    assert verify_chunk_proof(proof) == "chunk"
    old = db.prove_chunk(second, hits["quark quark mass and energy"], content=True)
    assert verify_chunk_proof(old) == "doc" and len(old["path"]) == 2
    for change in ({"content": b"other".hex()}, {"chunk": "0" * 64}, {"commit": first}, {"path": old["path"][:1]}, {"body": old["body"].replace("quark", "x") + " "}, {"erased": True}, {"version": 2}):
        with pytest.raises(ValueError):
            verify_chunk_proof(old | change)
    blob = codec.decoded(old["body"])["chunks"][0]
    p = db.prove_blob(old["manifest"], blob)
    assert merkle.included(bytes.fromhex(p["root"]), merkle.leaf(blob.encode()), p["index"], p["count"], [bytes.fromhex(x) for x in p["path"]])
    text = "".join(r.t for r in db.tables.read("chunks").join(db.objects.rows("doc").where("body like '%\"source\":\"d\"%'").select(F.col("hash").alias("manifest")), "manifest").join(db.blobs.opened().withColumnRenamed("hash", "chunk_hash"), "chunk_hash").orderBy("ordinal").selectExpr("cast(substring(bytes, 1, case when end - start = 256 then 192 else 256 end) as string) t").collect())
    assert text.startswith("Ünïcode long text")
    with pytest.raises(KeyError):
        db.commit("main", "me", "bad", ["0" * 64])
    assert db.unindexed(second, made.select("manifest")).collect()[0].manifest == manifest


def test_checkpoints(db):
    signer = Signer(SECRET)
    for k in range(5):
        db.commit("main", "me", f"c{k}", now=k)
        db.checkpoint("main", signer=signer if k % 2 == 0 else None, now=k)
    assert db.verify_chain("main") == {"length": 5, "signed": 3} and len(db.logged("main")) == 5
    with pytest.raises(ValueError, match="unsigned"):
        db.verify_chain("main", signed=True)
    with pytest.raises(ValueError, match="signature"):
        db.verify_chain("main", public_key=Signer(b"\1" * 32).public.hex())
    chain = db.checkpoints("main")
    G.verify_checkpoints(chain, "main")
    for k in range(5):
        forged = [(n, v | {"commit": "0" * 64}) if i == k else (n, v) for i, (n, v) in enumerate(chain)]
        with pytest.raises(ValueError):
            G.verify_checkpoints(forged, "main")
        with pytest.raises(ValueError):
            G.verify_checkpoints([x for i, x in enumerate(chain) if i != k + 0][: 5 if k else 0] or chain[1:-1], "main")
    p = db.prove_logged("main", 3)
    assert p["root"] == chain[0][1]["log_root"] and merkle.included(bytes.fromhex(p["root"]), merkle.leaf(p["commit"].encode()), 3, 5, [bytes.fromhex(x) for x in p["path"]])
    q = db.prove_append_only("main", 2)
    assert q["old_root"] == chain[3][1]["log_root"] and merkle.consistent(bytes.fromhex(q["old_root"]), 2, bytes.fromhex(q["root"]), 5, [bytes.fromhex(x) for x in q["proof"]])


def test_events_sessions_and_expiry(spark, db):
    for k in range(4):
        db.events.append("test", {"k": k}, now=k)
    assert [r.seq for r in db.events.since(1).collect()] == [2, 3] and db.events.tail()["seq"] == 3 and db.events.faults().isEmpty()
    name = "events/0000000000000001.json"
    event = db.folder.json(name)
    db.folder.write(name, json.dumps(event | {"data": "{}"}).encode())
    assert [r.fault for r in db.events.faults().collect()] == ["rewritten"]
    db.folder.write(name, json.dumps(event).encode())
    db.events.stream(0, "test").writeStream.format("memory").queryName("log").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("log").count() == 3
    s = G.Sessions(db)
    assert [s.append("main", "s1", f"turn {k}".encode(), role="user", ttl=None if k == 1 else 10, now=100 + k)[0] for k in range(3)] == [0, 1, 2]
    assert s.append("main", "s10", b"other", now=100)[0] == 0
    assert [t["bytes"] for t in s.list("main", "s1")] == [b"turn 0", b"turn 1", b"turn 2"] and [t["seq"] for t in s.list("main", "s1", now=111)] == [1, 2]
    assert s.collect_garbage("main", 150) == 0 and s.collect_garbage("main", 202) == 2 and [t["seq"] for t in s.list("main", "s1")] == [1]
    for bad in ("", "a/b", "a\n"):
        with pytest.raises(ValueError):
            s.append("main", bad, b"x")


def test_audit_bundles(spark, db):
    db.put_documents("main", docs(spark), "me", now=1)
    audit, signer = G.Audit(db), Signer(SECRET)
    for k in range(4):
        commit = db.commit_of("main")
        audit.record("main", commit, "semantic", [{"chunk": "a" * 64, "score": 0.1234565}], query=f"q{k}", principal="bob" if k else None, now=100 + k)
    db.checkpoint("main", signer=signer, now=200)
    records = audit.collect("main", 101, 103)
    assert [r["seq"] for r in records] == [3, 2, 1] and records[0]["hits"][0]["score_micro"] == 123457
    bundle = audit.export("main", 100, 103, signer=signer)
    got = G.verify_bundle(bundle, public_key=signer.public.hex(), signed=True)
    assert got["retrievals"] == 4 and got["chain_complete"] and got["checkpoints_signed"] == 1
    assert not G.verify_bundle(audit.export("main", 102, 103))["chain_complete"]
    body = codec.decoded(audit.export("main", 100, 103))

    def forged(**change):
        b = {k: v for k, v in (body | change).items() if k != "digest"}
        return codec.canonical(b | {"digest": codec.digest("bundle", codec.canonical(b))})

    G.verify_bundle(forged())
    r = body["records"]
    cases = [
        {"records": r[1:]}, {"records": r[1:], "retrievals": 3}, {"records": [r[0], r[2], r[3]], "retrievals": 3}, {"records": [r[0] | {"principal": "eve"}, *r[1:]]}, {"records": [r[0] | {"hits": []}, *r[1:]]},
        {"from": 101}, {"tip": r[3]["commit"]}, {"objects": {k: v for k, v in body["objects"].items() if k != r[1]["manifest"]}}, {"records": [r[0] | {"commit": r[1]["commit"]}, *r[1:]]}, {"retrievals": 5},
        {"checkpoints": {}}, {"objects": body["objects"] | {"0" * 64: ["commit", "{}"]}},
    ]
    without = {k: v for k, v in body["objects"].items() if k != r[1]["manifest"]}
    cases.append({"records": [r[0], r[2], r[3]], "retrievals": 3, "objects": without})
    for change in cases:
        with pytest.raises(ValueError):
            G.verify_bundle(forged(**change))
    with pytest.raises(ValueError):
        G.verify_bundle(bundle.replace(b"bob", b"eve"))
    with pytest.raises(ValueError):
        G.verify_bundle(audit.export("main", 100, 103), signed=True)


def test_policies_and_the_gate(spark, db):
    p = G.Policies(db)
    rules = [("chain", "require-tamper-evident-chain"), ("signed", "require-signed-checkpoints"), ("enc", "require-encryption-at-rest"), ("who", "require-principal"), ("tip", "require-signed-commits"), ("from", "require-provenance")]
    p.store([{"id": i, "rule": {"kind": r}, "heads": ["ma*"]} for i, r in rules] + [{"id": "floor", "rule": {"kind": "retention-floor", "min_secs": 50}}])
    db.commit("main", "me", "one")
    db.commit("other", "me", "one")
    status = lambda: {s["policy_id"]: s["status"] for s in p.evaluate()["statuses"]}
    assert status() == {"chain": "fail", "signed": "fail", "enc": "fail", "who": "pass", "tip": "fail", "from": "pass", "floor": "pass"}
    db.commit("main", "me", "two", signer=Signer(SECRET))
    db.checkpoint("main", signer=Signer(SECRET))
    G.Audit(db).record("main", db.commit_of("main"), "semantic", [], query="x")
    assert status() == {"chain": "pass", "signed": "pass", "enc": "fail", "who": "fail", "tip": "fail", "from": "pass", "floor": "pass"}
    p.gate("documents", "main")  # monitored only
    assert db.events.rows().where("kind = 'policy.violation'").count() == 1
    p.upsert({"id": "who", "rule": {"kind": "require-principal"}, "mode": "enforce", "heads": ["main"]})
    with pytest.raises(PermissionError):
        p.gate("documents", "main")
    p.gate("documents", "main", "bob")
    p.gate("documents", "elsewhere")
    p.upsert({"id": "from", "rule": {"kind": "require-provenance"}, "mode": "enforce"})
    with pytest.raises(PermissionError):
        p.gate("runs", "main", "bob")
    p.gate("runs", "main", "bob", provenance=True)
    assert p.remove("who") and not p.remove("who")
    for bad in ([{"id": "", "rule": {"kind": "require-principal"}}], [{"id": "a", "rule": {"kind": "no"}}], [{"id": "a", "rule": {"kind": "retention-floor", "min_secs": 0}}], [{"id": "a", "rule": {"kind": "require-principal"}}] * 2):
        with pytest.raises(ValueError):
            p.store(bad)


def test_erasure_garbage_and_provenance(spark, db):
    rows = [("a", "only mine " * 30, "s1"), ("b", "shared words", "s1"), ("c", "shared words", "s2"), ("d", "nobody's", None)]
    db.put_documents("main", spark.createDataFrame(rows, "source string, text string, subject string"), "me")
    before = db.blobs.listed().count()
    record = G.Erasure(db).erase("s1", "asked", requested_by="bob", signer=Signer(SECRET))
    assert signature_holds(record, Signer(SECRET).public.hex()) and not signature_holds(record | {"subject": "s2"})
    assert len(record["blobs"]) == before - db.blobs.listed().count() > 0 and G.Erasure(db).covers(record["blobs"][0]) and not G.Erasure(db).covers("0" * 64)
    assert db.search("main", "mine", mode="semantic") == [] and len(db.search("main", "shared", mode="semantic")) == 1
    proof = db.prove_chunk(db.commit_of("main"), record["blobs"][0], content=True)
    assert proof["erased"] and verify_chunk_proof(proof) == "doc"
    loose = db.blobs.put(b"nothing refers to this")
    G.Sessions(db).append("main", "s", b"a turn")
    assert [r.hash for r in db.unreachable().collect()] == [loose] and db.unreachable(grace=3600).isEmpty()
    assert db.collect_garbage() == {"unreachable": 1, "bytes": 22, "pruned": False} and db.collect_garbage(prune=True)["pruned"] and not db.blobs.exists(loose)
    prov = G.Provenance(db)
    prov.put([{"claim_id": "c1", "text": "t", "confidence": 0.7, "evidence": [{"chunk": "x"}], "tags": ["a"]}, {"claim_id": "c2", "confidence": 0.2, "evidence": [{"chunk": "y"}]}])
    assert [r.claim_id for r in prov.find(tag="a").collect()] == ["c1"] and prov.find(least=0.1).count() == 2 and prov.find(claim_id="c2").count() == 1
    for bad in ({"claim_id": "", "confidence": 1, "evidence": [{}]}, {"claim_id": "a", "confidence": 1.5, "evidence": [{}]}, {"claim_id": "a", "confidence": 1, "evidence": []}):
        with pytest.raises(ValueError):
            prov.put([bad])
    s1 = db.put_manifest("summary", {"level": 1, "children": ["c" * 64], "summary": db.blobs.put(b"s")})
    s2 = db.put_manifest("summary", {"level": 2, "children": [s1]})
    assert {r.node: r.depth for r in db.summary_tree(s2).collect()}["c" * 64] == 2
    r1 = db.put_manifest("run", {"model": "m"})
    r2 = db.put_manifest("run", {"model": "m", "parent_span": r1})
    assert db.trace(r2) == [r2, r1]


def test_merging_databases(spark, db, tmp_path):
    db.put_document("main", "a", "the first text of all", "me")
    db.set_state("main", b"k", b"1")
    db.commit("main", "me", "state")
    copy = Database.create(spark, f"{tmp_path}/copy", retention=100)
    report = copy.merge(db)
    assert report["updated"] == ["main"] and copy.search("main", "first", mode="semantic") and copy.get_state(copy.staged("main"), b"k") == b"1"
    db.put_document("main", "b", "the second text", "me")
    db.checkpoint("main")
    assert copy.merge(db)["updated"] == ["main"] and copy.refs.get("checkpoints", "main") and copy.merge(db)["objects"] == 0
    copy.commit("main", "me", "own way")
    db.commit("main", "me", "other way")
    assert copy.merge(db)["skipped"] == ["main"]
    assert copy.compact()["blobs"]["batches_after"] == 1
    with pytest.raises(ValueError):
        copy.merge(Database.create(spark, f"{tmp_path}/x", password="p"))


def test_routes_roles_and_tenants(spark, db, tmp_path):
    api = Api(db, signer=Signer(SECRET))
    assert api.handle("GET", "/v1/health") == (200, {"status": "ok"})
    keys = {r: G.Keys(db).add(r, r) for r in G.ROLES} | {"t1": G.Keys(db).add("t1", "writer", "t1")}
    call = lambda who, method, path, **v: api.handle(method, path, v, keys[who])
    assert api.handle("GET", "/v1/refs")[0] == 401 and api.handle("GET", "/v1/refs", None, "wrong")[0] == 401 and call("reader", "POST", "/v1/commits", head="m", message="x")[0] == 403
    assert call("reader", "GET", "/v1/none")[0] == 404 and call("reader", "POST", "/v1/health")[0] == 405 and api.handle("POST", "/v1/commits", b"[1", keys["writer"])[0] == 400
    b64 = base64.b64encode(b"blob").decode()
    status, put = call("writer", "POST", "/v1/blobs", data_base64=b64)
    assert status == 200 and call("reader", "GET", f"/v1/blobs/{put['hash']}")[1]["data_base64"] == b64 and call("t1", "GET", f"/v1/blobs/{put['hash']}")[0] == 403
    assert call("writer", "POST", "/v1/blobs", data_base64="?")[0] == 400 and call("reader", "GET", f"/v1/blobs/{'0' * 64}")[0] == 404
    assert call("t1", "POST", "/v1/documents", head="main", source="s", text="x")[0] == 403
    status, made = call("t1", "POST", "/v1/documents", head="t1/main", source="s", text="a tenant's own text", metadata={"tenant": "t2", "language": "en"})
    assert status == 200 and call("writer", "POST", "/v1/documents", head="t1/main", source="s", text="someone else's text", metadata={"tenant": "t2"})[0] == 200
    assert call("writer", "POST", "/v1/documents", head="m", source="s", text="x", chunk_size=10)[0] == 400
    status, found = call("t1", "POST", "/v1/search", at="t1/main", query="text", mode="semantic", audit=True)
    assert status == 200 and [h["preview"] for h in found["hits"]] == ["a tenant's own text"] and found["audit_manifest"]
    assert call("reader", "POST", "/v1/search", at="t1/main", query="text", mode="semantic", audit=True)[0] == 403 and call("t1", "POST", "/v1/search", at="main", query="x")[0] == 403
    chunk = found["hits"][0]["chunk"]
    proof = call("reader", "POST", "/v1/proofs/chunk", commit=found["commit"], chunk=chunk, include_content=True)[1]["proof"]
    assert call("reader", "POST", "/v1/proofs/verify", proof=proof)[1] == {"valid": True, "anchor": "doc"} and not call("reader", "POST", "/v1/proofs/verify", proof=proof | {"chunk": "1" * 64})[1]["valid"]
    assert call("t1", "POST", "/v1/proofs/chunk", commit=found["commit"], chunk=chunk, include_content=True)[0] == 403
    assert call("writer", "POST", "/v1/state/set", head="m", key="k", value_base64=b64)[0] == 200 and call("reader", "POST", "/v1/state/get", head="m", key="6b", encoding="hex")[1]["value_base64"] == b64
    proved = call("reader", "POST", "/v1/state/prove", head="m", key="k")[1]
    assert statetree.proves(proved["root"], b"k", proved["proof"])
    assert call("writer", "POST", "/v1/state/delete", head="m", key="k")[0] == 200 and not call("reader", "POST", "/v1/state/get", head="m", key="k")[1]["found"]
    status, run = call("writer", "POST", "/v1/runs", head="m", model="x", prompt="p", model_parameters={"b": 1, "a": 2}, retrieved_chunks=[chunk], subject="s1")
    assert status == 200 and db.objects.get(run["manifest"], "run")["retrieved_chunks"] == [chunk] and db.blobs.get(db.objects.get(run["manifest"], "run")["model_parameters"]) == b'{"a":2,"b":1}'
    assert call("writer", "POST", "/v1/commits", head="m", message="x", manifests=[made["manifest"]])[0] == 200 and call("writer", "POST", "/v1/checkpoints", head="m")[0] == 200
    assert call("writer", "POST", "/v1/sessions/append", head="m", session="s", content="hello", ttl_secs=1000)[1]["seq"] == 0
    assert base64.b64decode(call("reader", "POST", "/v1/sessions/list", head="m", session="s")[1]["turns"][0]["bytes"]) == b"hello"
    assert len(call("reader", "POST", "/v1/audit/queries", head="t1/main")[1]["records"]) == 1
    assert G.verify_bundle(base64.b64decode(call("reader", "POST", "/v1/audit/export", head="t1/main")[1]["bundle_base64"]), public_key=Signer(SECRET).public.hex(), signed=True)["retrievals"] == 1
    assert [h["head"] for h in call("t1", "GET", "/v1/compliance/summary")[1]["heads"]] == ["t1/main"] and set(call("t1", "GET", "/v1/refs")[1]["heads"]) == {"t1/main"}
    policy = [{"id": "p", "rule": {"kind": "require-encryption-at-rest"}, "mode": "enforce"}]
    assert call("writer", "POST", "/v1/policy", policies=policy)[0] == 403 and call("admin", "POST", "/v1/policy", policies=policy)[0] == 200 and call("reader", "GET", "/v1/policy")[1]["policies"][0]["id"] == "p"
    assert call("writer", "POST", "/v1/blobs", data_base64=b64)[0] == 403 and call("reader", "POST", "/v1/policy/evaluate")[1]["fail"] == 1
    events = call("reader", "GET", "/v1/events?since=-1&verify=1")[1]
    assert events["valid"] and events["events"][0]["kind"] == "policy.violation"
    assert call("admin", "POST", "/v1/policy", policies=[])[0] == 200 and call("admin", "POST", "/v1/erasure", subject="s1", reason="asked")[0] == 200 and call("admin", "GET", "/v1/erasure")[1]["records"][0]["subject"] == "s1"
    other = Database.create(spark, f"{tmp_path}/other", retention=100)
    other.commit("new", "me", "x")
    assert call("admin", "POST", "/v1/pack", **{"from": f"{tmp_path}/other"})[1]["updated"] == ["new"] and call("admin", "POST", "/v1/pack/export", to=f"{tmp_path}/pack")[0] == 200
    assert G.Keys(db).remove("t1") and call("t1", "GET", "/v1/refs")[0] == 401 and {k["id"] for k in G.Keys(db).list()} == set(G.ROLES)
    assert len(new_keypair(db.folder, "key")) == 64
