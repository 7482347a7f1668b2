"""The database: blobs, objects, references, versioned state, documents, commits, the index and searches.

What is written goes to tables first; a reference is moved last, by compare-and-set, so nothing half written is ever
seen. A commit names its parents, the root of the state and the manifests that came with it; reading at a commit
is reading what its first parents brought. ``now`` may be given where a time is recorded.
"""

from __future__ import annotations

import json
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.engine.fs import Conflict, Folder
from palimpsest.engine.refs import Refs, check_name
from palimpsest.engine.store import Blobs, Crypt, Objects, Tables, new_salt
from palimpsest.functions import codec, ed25519
from palimpsest.functions.text import digest, preview
from palimpsest.operators import retrieval as R
from palimpsest.plans import merkle, statetree

MIN_CHUNK, CHUNK, MAX_TOP = 64, 512, 1000
#: Batches of state operations that are read before one with everything is written.
OPEN_BATCHES = 32
INLINE = 512
META = ("tenant", "doc_type", "language", "valid_from", "valid_to", "expires_at", "acl", "subject")
META_SCHEMA = "tenant string, doc_type string, language string, valid_from long, valid_to long, expires_at long, acl array<string>, subject string"


class Signer:
    def __init__(self, secret: bytes):
        self.secret, self.public = secret, ed25519.public(secret)

    def signed(self, value: dict) -> dict:
        """``value`` with a signature over its canonical bytes."""
        plain = {k: v for k, v in value.items() if k not in ("signature", "signed_by")}
        return plain | {"signed_by": self.public.hex(), "signature": ed25519.sign(self.secret, codec.canonical(plain)).hex()}


def signature_holds(value: dict, public_key: str | None = None) -> bool:
    """Whether a value is signed, by the key given or else by the one that it names."""
    key = public_key or value.get("signed_by")
    if not key or not value.get("signature"):
        return False
    plain = {k: v for k, v in value.items() if k not in ("signature", "signed_by")}
    try:
        return ed25519.verify(bytes.fromhex(key), codec.canonical(plain), bytes.fromhex(value["signature"]))
    except ValueError:
        return False


def new_keypair(folder: Folder, name: str) -> str:
    """Writes a secret key that isn't there yet and returns the public one."""
    secret = ed25519.generate()
    folder.write(name, secret.hex().encode(), new=True)
    return ed25519.public(secret).hex()


class Database:
    def __init__(self, spark: SparkSession, root: str, *, password: str | None = None):
        """Opens a database that ``create`` made."""
        self.spark, self.folder = spark, Folder(spark, root)
        self.config = self.folder.json("config.json")
        if self.config is None:
            raise FileNotFoundError(f"no database at {root}")
        crypt = None
        if self.config.get("encryption"):
            if password is None:
                raise PermissionError("the database is encrypted: a password is needed")
            crypt = Crypt(password, bytes.fromhex(self.config["encryption"]["salt"]))
            if not codec.same(crypt.key("check").hex(), self.config["encryption"]["check"]):
                raise PermissionError("wrong password")
        self.tables = Tables(spark, self.folder)
        self.blobs, self.objects, self.refs = Blobs(self.tables, crypt), Objects(self.tables), Refs(self.folder)

    @classmethod
    def create(cls, spark: SparkSession, root: str, *, password: str | None = None, retention: int | None = None) -> Database:
        """A new database; ``retention``: seconds for which expired session turns are kept at least."""
        folder, config = Folder(spark, root), {"version": 1, "retention_min_secs": retention, "encryption": None}
        if password is not None:
            salt = new_salt()
            config["encryption"] = {"algorithm": "AES-256-GCM", "kdf": "scrypt", "salt": salt.hex(), "check": Crypt(password, salt).key("check").hex()}
        folder.make()
        folder.write("config.json", json.dumps(config).encode(), new=True)
        return cls(spark, root, password=password)

    def rekey(self, password: str) -> int:
        """Seals all blobs with a new password's key. The configuration is changed last."""
        salt = new_salt()
        crypt = Crypt(password, salt)
        with self.folder.lock("maintenance"):
            n = self.blobs.rekey(crypt)
            self.config["encryption"] = {"algorithm": "AES-256-GCM", "kdf": "scrypt", "salt": salt.hex(), "check": crypt.key("check").hex()}
            self.folder.write("config.json", json.dumps(self.config).encode())
        return n

    def compact(self) -> dict:
        """Puts small batches of both stores together."""
        with self.folder.lock("maintenance"):
            out = {"blobs": self.blobs.compact()}
            if len(self.tables.batches("objects")) > 1:
                self.tables.rewrite("objects", self.tables.read("objects").dropDuplicates(["hash"]), "hash")
        return out | {"objects": len(self.tables.batches("objects"))}

    # commits

    def commit_of(self, at: str) -> str:
        """The commit that a head's name or 64 hexadecimal digits mean."""
        if codec.HEX.fullmatch(at):
            self.objects.get(at, "commit")
            return at
        found = self.refs.get("heads", at)
        if found is None:
            raise KeyError(f"no head {at}")
        return found

    def commit(self, head: str, author: str, message: str, manifests: list[str] = (), *, parents: list[str] | None = None, signer: Signer | None = None, now: int | None = None) -> str:
        """A commit on a head, of the state that is staged there; what it names must exist. Tried again if others commit meanwhile."""
        check_name(head)
        known = {r.hash for r in self.objects.rows().where(F.col("hash").isin(*manifests)).select("hash").collect()} if manifests else set()
        if missing := [m for m in manifests if m not in known]:
            raise KeyError(f"no manifest {missing[0]}")
        for _ in range(20):
            tip = self.refs.get("heads", head)
            above = ([tip] if tip else []) if parents is None else parents
            ancestors = [self.objects.get(p, "commit") for p in above]
            value = {
                "parents": above, "timestamp": codec.now_unix() if now is None else now, "author": author, "message": message,
                "state_root": self.staged(head), "manifests": list(manifests), "generation": max((a["generation"] for a in ancestors), default=-1) + 1,
            }
            name = self.objects.put("commit", signer.signed(value) if signer else value)
            try:
                self.refs.swap("heads", head, tip, name)
                return name
            except Conflict:
                continue
        raise Conflict(f"{head} is moved too often")

    def history(self, commit: str) -> list[tuple[str, dict]]:
        """A commit and its first parents, newest first."""
        out, at = [], commit
        if commit not in self.objects._seen:
            self.objects.fetch("commit")  # at once, where one by one would be a job each
        while at:
            value = self.objects.get(at, "commit")
            out.append((at, value))
            at = value["parents"][0] if value["parents"] else None
        return out

    log = history

    def is_ancestor(self, ancestor: str, descendant: str) -> bool:
        """Over all parents, down to the ancestor's generation."""
        least, seen, todo = self.objects.get(ancestor, "commit")["generation"], set(), [descendant]
        while todo:
            at = todo.pop()
            if at == ancestor:
                return True
            value = self.objects.get(at, "commit")
            if at not in seen and value["generation"] > least:
                seen.add(at)
                todo += value["parents"]
        return False

    def verify_commit(self, commit: str, public_key: str | None = None) -> bool:
        return signature_holds(self.objects.get(commit, "commit"), public_key)

    # state

    def staged(self, head: str) -> str:
        """The root of what is written on a head, or of its commit, or of nothing."""
        found = self.refs.get("states", head)
        if found is None and (tip := self.refs.get("heads", head)):
            found = self.objects.get(tip, "commit")["state_root"]
        return found or statetree.EMPTY

    def state(self, root: str) -> DataFrame:
        """(key, value) at a root."""
        known = self.folder.json(f"roots/{root}.json", {"batches": []} if root == statetree.EMPTY else None)
        if known is None:
            raise KeyError(f"no state {root}")
        return self._of_batches(known["batches"]) if known["batches"] else self.tables.read("state", [])

    def write_state(self, root: str, changes: DataFrame) -> str:
        """The root after (ordinal, key, value), of which the last of each key counts and a null value deletes."""
        last = changes.groupBy(F.col("key").cast("binary").alias("key")).agg(F.max_by(F.col("value").cast("binary"), "ordinal").alias("value"))
        batches = [*self.folder.json(f"roots/{root}.json", {"batches": []})["batches"], self.tables.append("state", last)]
        if len(batches) > OPEN_BATCHES:
            whole = self._of_batches(batches)
            batches = [self.tables.append("state", whole)]
        new = statetree.root(self._of_batches(batches))
        try:
            self.folder.write(f"roots/{new}.json", json.dumps({"batches": batches}).encode(), new=True)
        except Conflict:
            pass  # the same keys and values, written otherwise
        return new

    def _of_batches(self, batches: list[str]) -> DataFrame:
        parts = None
        for k, b in enumerate(batches):
            one = self.tables.read("state", [b]).withColumn("at", F.lit(k))
            parts = one if parts is None else parts.union(one)
        return parts.groupBy("key").agg(F.max_by("value", "at").alias("value")).where("value is not null")

    def update_state(self, head: str, changes: list[tuple[bytes, bytes | None]] | DataFrame) -> str:
        """Writes keys (None deletes) on a head, again from the new root if others write meanwhile."""
        check_name(head)
        if isinstance(changes, list):
            changes = self.spark.createDataFrame([(k, bytearray(a), None if b is None else bytearray(b)) for k, (a, b) in enumerate(changes)], "ordinal long, key binary, value binary")
        for _ in range(20):
            known = self.refs.get("states", head)
            new = self.write_state(self.staged(head), changes)
            try:
                self.refs.swap("states", head, known, new)
                return new
            except Conflict:
                continue
        raise Conflict(f"{head} is written too often")

    def set_state(self, head: str, key: bytes, value: bytes) -> str:
        return self.update_state(head, [(key, value)])

    def delete_state(self, head: str, key: bytes) -> str:
        return self.update_state(head, [(key, None)])

    def get_state(self, root: str, key: bytes) -> bytes | None:
        found = self.state(root).where(F.col("key") == F.lit(key)).first()
        return None if found is None else bytes(found.value)

    def scan_state(self, root: str, prefix: bytes) -> DataFrame:
        """Keys that begin with the prefix, in order of bytes."""
        from palimpsest.functions.text import prefix_upper

        found, end = self.state(root).where(F.col("key") >= F.lit(prefix)), prefix_upper(prefix)
        return (found if end is None else found.where(F.col("key") < F.lit(end))).orderBy("key")

    def state_refs(self, root: str) -> DataFrame:
        """(key, inline, value_hash): values of up to 512 bytes as they are, larger ones by their digest alone."""
        return self.state(root).select("key", F.when(F.length("value") <= INLINE, F.col("value")).alias("inline"), digest("blob", "value").alias("value_hash"))

    def prove_state(self, root: str, key: bytes) -> dict:
        """Proof that a key is there with a value, or isn't, for ``statetree.proves``."""
        entries = [(bytes(r.key), r.hash) for r in self.state(root).select("key", digest("blob", "value").alias("hash")).collect()]
        return statetree.proof(statetree.Tree(sorted(entries)), key)

    # documents, manifests and the index

    def put_documents(self, head: str, docs: DataFrame, author: str, *, size: int = CHUNK, overlap: int | None = None, message: str = "documents", signer: Signer | None = None, now: int | None = None) -> tuple[DataFrame, str]:
        """Ingests (source, text and any of ``META``), all in one commit: ((source, manifest), commit).

        The original and the chunks of ``size`` bytes become blobs, and each document a manifest of them.
        """
        overlap = min(64, size // 2) if overlap is None else overlap
        if size < MIN_CHUNK or not 0 <= overlap <= size // 2:
            raise ValueError(f"chunks have at least {MIN_CHUNK} bytes and overlap by half of that at most")
        at = codec.now_unix() if now is None else now
        have = {f.name: f for f in docs.schema}
        types = dict(x.split(" ", 1) for x in META_SCHEMA.split(", "))
        meta = F.struct(*((F.col(m) if m in have else F.lit(None)).cast(types[m]).alias(m) for m in sorted(META)))
        base = docs.select("source", F.coalesce("text", F.lit("")).alias("text"), meta.alias("meta")).withColumn("doc_id", digest("document", F.concat_ws("|", "source", digest("blob", "text"), F.to_json("meta"))))
        parts = R.chunks(base, size, overlap)
        pieces = base.join(parts, "doc_id").select(F.expr("substring(encode(text, 'UTF-8'), start + 1, end - start)").alias("bytes"))
        self.blobs.put_many(pieces.union(base.select(F.encode("text", "UTF-8").alias("bytes"))), now=at)
        lists = parts.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", "chunk_hash", "start", "end"))).alias("cs"))
        body = F.struct(
            F.transform(F.coalesce("cs", F.array().cast("array<struct<ordinal:int,chunk_hash:string,start:int,end:int>>")), lambda c: c["chunk_hash"]).alias("chunks"),
            F.lit(at).alias("created_at"), F.col("meta"), digest("blob", "text").alias("original"), F.lit(overlap).alias("overlap"), F.lit(size).alias("size"), "source",
        )
        made = base.join(lists, "doc_id", "left").select("source", "cs", F.lit("doc").alias("kind"), _canonical(F.to_json(body)).alias("body"))
        made = made.withColumn("manifest", F.sha2(F.concat(F.lit("doc:"), F.col("body")).cast("binary"), 256))
        from palimpsest.storage import removed, written

        kept = written(made, "manifests")
        self.objects.put_rows(kept.select("kind", "body"), now=at)
        self.tables.append("chunks", kept.dropDuplicates(["manifest"]).select("manifest", F.inline("cs")).join(self.tables.read("chunks").select("manifest").distinct(), "manifest", "left_anti"))
        out = self.spark.createDataFrame(kept.select("source", "manifest").collect(), "source string, manifest string")  # what the commit names
        removed(kept)
        names = sorted({r.manifest for r in out.collect()})
        return out, self.commit(head, author, message, names, signer=signer, now=at)

    def put_document(self, head: str, source: str, text: str, author: str, *, meta: dict | None = None, **options) -> tuple[str, str]:
        """(manifest, commit) of one document."""
        meta = {k: v for k, v in (meta or {}).items() if v is not None}
        if bad := set(meta) - set(META):
            raise ValueError(f"unknown metadata: {', '.join(sorted(bad))}")
        schema = "source string, text string, " + META_SCHEMA
        row = (source, text, *(meta.get(m) for m in META))
        out, commit = self.put_documents(head, self.spark.createDataFrame([row], schema), author, **options)
        return out.first().manifest, commit

    def put_manifest(self, kind: str, value: dict) -> str:
        """A manifest of a chunk, a summary (children, level of at least 1), a run, a query or provenance."""
        if kind not in ("chunk", "summary", "run", "query", "provenance"):
            raise ValueError(f"no such kind of manifest: {kind}")
        if kind == "summary" and not (isinstance(value.get("level"), int) and value["level"] >= 1 and value.get("children")):
            raise ValueError("a summary has children and a level of at least 1")
        return self.objects.put(kind, value)

    def references(self) -> DataFrame:
        """(manifest, kind, target): what manifests of every kind refer to."""
        fields = {"doc": ["original"], "chunk": ["chunk", "embedding"], "summary": ["summary"], "run": ["prompt", "system_prompt", "model_parameters", "parent_span"], "query": ["query", "embedding"]}
        lists = {"doc": ["chunks"], "summary": ["children"], "run": ["inputs", "outputs", "retrieved_chunks", "tool_calls"], "query": ["chunks"]}
        o = self.objects.rows()
        out = None
        for kind in fields:
            one = o.where(F.col("kind") == kind)
            parts = F.array(*(F.get_json_object("body", f"$.{f}") for f in fields[kind]))
            for f in lists.get(kind, []):
                parts = F.concat(parts, F.coalesce(F.from_json(F.get_json_object("body", f"$.{f}"), "array<string>"), F.array().cast("array<string>")))
            found = one.select(F.col("hash").alias("manifest"), "kind", F.explode(F.array_distinct(F.array_compact(parts))).alias("target"))
            out = found if out is None else out.union(found)
        return out

    def summary_tree(self, summary: str) -> DataFrame:
        """(node, depth): what a summary stands for, down to the chunks."""
        edges = self.references().where("kind in ('summary', 'doc', 'chunk')").select(F.col("manifest").alias("src"), F.col("target").alias("dst"))
        out = now = self.spark.createDataFrame([(summary, 0)], "node string, depth int")
        for depth in range(1, self.objects.get(summary, "summary")["level"] + 3):
            now = now.join(edges, now["node"] == edges["src"]).select(F.col("dst").alias("node"), F.lit(depth).alias("depth")).distinct()
            out = out.union(now)
        return out

    def trace(self, run: str) -> list[str]:
        """A run and the spans above it."""
        out, at = [], run
        while at and at not in out:
            out.append(at)
            at = self.objects.get(at, "run").get("parent_span")
        return out

    def visible_chunks(self, commit: str) -> DataFrame:
        """(doc_id = chunk hash, text, meta columns, generation) of what a commit's first parents brought; the last of equal chunks counts, and erased blobs are left out."""
        chain = [(m, v["generation"], k) for _, v in self.history(commit) for k, m in enumerate(v["manifests"])]
        brought = self.spark.createDataFrame(chain or [("", -1, -1)], "manifest string, generation long, place int")
        meta = F.from_json(F.get_json_object("body", "$.meta"), META_SCHEMA)
        m = self.objects.rows("doc").select(F.col("hash").alias("manifest"), meta.alias("meta"))
        rows = self.tables.read("chunks").join(F.broadcast(brought), "manifest").join(m, "manifest")
        rows = rows.groupBy(F.col("chunk_hash").alias("doc_id")).agg(F.max_by(F.struct("meta", "generation"), F.struct("generation", "place", "ordinal")).alias("r"))
        text = self.blobs.opened().select(F.col("hash").alias("doc_id"), F.make_valid_utf8(F.col("bytes").cast("string")).alias("text"))
        erased = self.erased().select(F.col("hash").alias("doc_id"))
        return rows.join(text, "doc_id").join(erased, "doc_id", "left_anti").select("doc_id", "text", "r.generation", "r.meta.*")

    def vectors(self, commit: str) -> DataFrame:
        """(doc_id = chunk hash, embedding) of chunk manifests that the commit's first parents brought."""
        names = [m for _, v in self.history(commit) for m in v["manifests"]]
        c = self.objects.rows("chunk").join(F.broadcast(self.spark.createDataFrame([(n,) for n in names] or [("",)], "hash string")), "hash")
        return c.select(F.get_json_object("body", "$.chunk").alias("doc_id"), F.from_json(F.get_json_object("body", "$.vector"), "array<double>").alias("embedding")).where("embedding is not null")

    def erased(self) -> DataFrame:
        """(hash) of blobs that a recorded erasure covers."""
        return self.events.rows().where("kind = 'erasure'").select(F.explode(F.from_json(F.get_json_object("data", "$.blobs"), "array<string>")).alias("hash"))

    @cached_property
    def events(self):
        from palimpsest.engine.governance import Events

        return Events(self)

    def search(self, at: str, query: str | None = None, embedding: list[float] | None = None, *, top: int = 10, mode: str = "hybrid", tenant: str | None = None, doc_type: str | None = None, language: str | None = None, tags: tuple[str, ...] = (), time: int | None = None) -> list[dict]:
        """Hits {chunk, score, preview}, best first, among what the caller may see at a head or commit."""
        wants = {"semantic": (True, False), "vector": (False, True), "hybrid": (query is not None, embedding is not None)}
        if mode not in wants:
            raise ValueError(f"unknown mode {mode}")
        text, vector = wants[mode]
        if text and query is None or vector and embedding is None or not (text or vector):
            raise ValueError(f"{mode} search needs a query or an embedding")
        top = max(0, min(top, MAX_TOP))
        commit = self.commit_of(at)
        docs = R.visible(self.visible_chunks(commit), tenant=tenant, doc_type=doc_type, language=language, tags=tags, at=time)
        from palimpsest.storage import removed, written

        docs = written(docs.select(F.col("doc_id").alias("chunk"), "text").withColumn("number", F.monotonically_increasing_id()), "visible")
        few = docs.select(F.col("number").alias("doc_id"), "text")
        reach = top if not (text and vector) else 4 * top
        lists = []
        if text:
            lists.append(R.ranked(R.bm25(few, self.spark.createDataFrame([(0, query)], "query_id long, text string"), reach), reach))
        if vector:
            own = self.vectors(commit).withColumnRenamed("doc_id", "chunk").join(docs.select("chunk", "number"), "chunk").select(F.col("number").alias("vec_id"), "embedding")
            lists.append(R.vector_topk(own, {0: [float(x) for x in embedding]}, reach))
        hits = R.fused(lists, top) if len(lists) == 2 else lists[0]
        rows = hits.select(F.col("doc_id").alias("number"), "score").join(docs, "number").select("chunk", "score", preview("text").alias("preview")).orderBy(F.desc("score"), "chunk").limit(top).collect()
        removed(docs)
        return [r.asDict() for r in rows]

    def index_stats(self, commit: str) -> dict:
        from palimpsest.functions.text import tokens

        docs = self.visible_chunks(commit)
        n = docs.agg(F.count(F.lit(1)), F.coalesce(F.avg(F.size(tokens("text"))), F.lit(0.0))).first()
        terms = R.terms_of(docs).distinct().count()
        v = self.vectors(commit).agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
        return {"chunks": n[0], "avg_length": n[1], "terms": terms, "embeddings": v[0], "dim": v[1]}

    def unindexed(self, commit: str, indexed: DataFrame) -> DataFrame:
        """(manifest) of the commit's history that an index built before, of manifests (manifest), doesn't have."""
        names = [(m,) for _, v in self.history(commit) for m in v["manifests"]]
        return self.spark.createDataFrame(names or [("",)], "manifest string").where("manifest <> ''").distinct().join(indexed, "manifest", "left_anti")

    # checkpoints and proofs

    def checkpoint(self, head: str, *, signer: Signer | None = None, now: int | None = None) -> str:
        """Anchors a head's commit: the next of a chain whose log root covers all commits logged before."""
        commit = self.commit_of(head)
        tip = self.refs.get("checkpoints", head)
        before = self.objects.get(tip, "checkpoint") if tip else None
        n = before["sequence"] + 1 if before else 0
        spine = merkle.appended([bytes.fromhex(x) for x in before["log_spine"]] if before else [], n, merkle.leaf(commit.encode()))
        value = {
            "head": head, "commit": commit, "sequence": n, "prev": tip, "created_at": codec.now_unix() if now is None else now,
            "log_root": merkle.seal(merkle.spine_root(spine), n + 1).hex(), "log_spine": [x.hex() for x in spine],
        }
        name = self.objects.put("checkpoint", signer.signed(value) if signer else value)
        self.refs.swap("checkpoints", head, tip, name)
        return name

    def checkpoints(self, head: str) -> list[tuple[str, dict]]:
        """The chain, newest first."""
        out, at = [], self.refs.get("checkpoints", head)
        if at:
            self.objects.fetch("checkpoint")
        while at:
            value = self.objects.get(at, "checkpoint")
            out.append((at, value))
            at = value["prev"]
        return out

    def verify_chain(self, head: str, *, public_key: str | None = None, signed: bool = False) -> dict:
        """{length, signed}; ValueError tells what is wrong with a head's checkpoints."""
        return verify_checkpoints(self.checkpoints(head), head, public_key=public_key, signed=signed)

    def logged(self, head: str) -> list[str]:
        """Commits that checkpoints anchor, the first first."""
        return [v["commit"] for _, v in reversed(self.checkpoints(head))]

    def prove_logged(self, head: str, index: int) -> dict:
        """Proof that a commit is the ``index``-th of a head's log."""
        chain = self.logged(head)
        leaves = [merkle.leaf(c.encode()) for c in chain]
        return {"commit": chain[index], "index": index, "count": len(chain), "root": merkle.sealed(leaves).hex(), "path": [x.hex() for x in merkle.inclusion(leaves, index)]}

    def prove_append_only(self, head: str, old: int) -> dict:
        """Proof that the first ``old`` commits of a head's log are the beginning of what it is now."""
        leaves = [merkle.leaf(c.encode()) for c in self.logged(head)]
        if not 0 < old <= len(leaves):
            raise ValueError(f"the log has {len(leaves)} commits")
        return {"old_root": merkle.sealed(leaves[:old]).hex(), "old_count": old, "root": merkle.sealed(leaves).hex(), "count": len(leaves), "proof": [x.hex() for x in merkle.consistency(leaves, old)]}

    def prove_blob(self, manifest: str, blob: str) -> dict:
        """Proof that a document's manifest refers to a blob."""
        value = self.objects.inspect(manifest)[1]
        refs = manifest_leaves(value)
        leaves = [merkle.leaf(r.encode()) for r in refs]
        i = refs.index(blob)
        return {"blob": blob, "index": i, "count": len(refs), "root": merkle.sealed(leaves).hex(), "path": [x.hex() for x in merkle.inclusion(leaves, i)]}

    def prove_chunk(self, commit: str, chunk: str, *, content: bool = False) -> dict:
        """Commits from the one given to that which brought the chunk, its manifest and, if asked for, the content."""
        path = []
        for name, value in self.history(commit):
            path.append(codec.canonical(value).decode())
            for m in value["manifests"]:
                kind, body = self.objects.inspect(m)
                if chunk in manifest_leaves(body):
                    out = {"version": 1, "commit": commit, "path": path, "manifest": m, "kind": kind, "body": codec.canonical(body).decode(), "chunk": chunk, "content": None, "erased": False}
                    if content:
                        try:
                            out["content"] = self.blobs.get(chunk).hex()
                        except KeyError:
                            if self.erased().where(F.col("hash") == chunk).isEmpty():
                                raise
                            out["erased"] = True
                    return out
        raise KeyError(f"nothing that leads to {commit} refers to {chunk}")

    def unreachable(self, *, grace: int = 0, now: int | None = None) -> DataFrame:
        """(hash, n_bytes) of blobs that nothing reachable from a reference refers to, and that are older than ``grace`` seconds."""
        from palimpsest.operators.memory import reachable

        kinds = {r.kind for r in self.objects.rows().select("kind").distinct().collect()}
        if unknown := kinds - {"commit", "doc", "chunk", "summary", "run", "query", "provenance", "checkpoint"}:
            raise ValueError(f"objects of unknown kinds, so nothing is taken for garbage: {', '.join(sorted(unknown))}")
        o = self.objects.rows()
        lists = [("commit", "parents"), ("commit", "manifests")]
        edges = self.references().select(F.col("manifest").alias("src"), F.col("target").alias("dst"))
        for kind, f in lists:
            edges = edges.union(o.where(F.col("kind") == kind).select("hash", F.explode(F.from_json(F.get_json_object("body", f"$.{f}"), "array<string>"))))
        for kind, f in (("checkpoint", "prev"), ("checkpoint", "commit"), ("query", "prev"), ("query", "commit")):
            edges = edges.union(o.where(F.col("kind") == kind).select("hash", F.get_json_object("body", f"$.{f}")))
        edges = edges.where("dst is not null")
        roots = [v for kind in ("heads", "checkpoints", "queries") for v in self.refs.all(kind).values()]
        live = reachable(edges, self.spark.createDataFrame([(r,) for r in roots] or [("",)], "node string"))
        held = self._state_blobs()
        old = (codec.now_unix() if now is None else now) - grace
        return self.blobs.listed().where(F.col("stored_at") <= old).join(live.withColumnRenamed("node", "hash"), "hash", "left_anti").join(held, "hash", "left_anti").select("hash", "n_bytes")

    def _state_blobs(self) -> DataFrame:
        """(hash) of blobs that session turns in any head's state refer to."""
        roots = {*self.refs.all("states").values(), *(self.objects.get(c, "commit")["state_root"] for c in self.refs.all("heads").values())}
        out = self.spark.createDataFrame([], "hash string")
        for r in sorted(roots):
            out = out.union(self.state(r).select(F.get_json_object(F.col("value").cast("string"), "$.content").alias("hash")).where("hash is not null"))
        return out.distinct()

    def collect_garbage(self, *, prune: bool = False, grace: int = 0, now: int | None = None) -> dict:
        """{unreachable, bytes}; nothing is deleted unless ``prune``."""
        gone = self.unreachable(grace=grace, now=now)
        n = gone.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_bytes"), F.lit(0))).first()
        if prune and n[0]:
            with self.folder.lock("maintenance"):
                self.blobs.shred(gone)
        return {"unreachable": n[0], "bytes": n[1], "pruned": prune}

    # replication

    def merge(self, remote: Database) -> dict:
        """Takes over what another database has: all blobs and objects that aren't here, and references that can be moved forward.

        A reference that has gone another way, or on which something is staged, is left alone.
        """
        if self.config.get("encryption") != remote.config.get("encryption"):
            raise ValueError("the databases are not encrypted alike")
        added = remote.objects.rows().join(self.objects.rows().select("hash"), "hash", "left_anti")
        n = added.count()
        self.objects.put_rows(added)
        more = remote.tables.read("blobs").join(self.tables.read("blobs").select("hash"), "hash", "left_anti").dropDuplicates(["hash"])
        m = more.count()
        self.tables.append("blobs", more)
        self.tables.append("chunks", remote.tables.read("chunks").join(self.tables.read("chunks").select("manifest").distinct(), "manifest", "left_anti"))
        for f in remote.folder.list("roots"):
            root = f[:-5]
            if not self.folder.exists(f"roots/{f}"):
                batch = self.tables.append("state", remote.state(root))
                self.folder.write(f"roots/{f}", json.dumps({"batches": [batch]}).encode())
        report = {"objects": n, "blobs": m, "updated": [], "skipped": []}
        for name, theirs in remote.refs.all("heads").items():
            ours = self.refs.get("heads", name)
            if ours == theirs:
                continue
            if ours is not None:
                staged = self.refs.get("states", name)
                if not self.is_ancestor(ours, theirs) or staged not in (None, self.objects.get(ours, "commit")["state_root"]):
                    report["skipped"].append(name)
                    continue
            self.refs.swap("heads", name, ours, theirs)
            if self.refs.get("states", name) is not None:
                self.refs.set("states", name, self.objects.get(theirs, "commit")["state_root"])
            report["updated"].append(name)
        for kind, of in (("checkpoints", "checkpoint"), ("queries", "query")):
            for name, theirs in remote.refs.all(kind).items():
                ours, at = self.refs.get(kind, name), theirs
                while at and at != ours:
                    at = self.objects.get(at, of)["prev"]
                if ours == theirs:
                    continue
                if ours is None or at == ours:
                    self.refs.set(kind, name, theirs)
                else:
                    report["skipped"].append(f"{kind}/{name}")
        return report


def _canonical(raw):
    """Canonical bytes of JSON that Spark wrote: keys in order, no nulls left out."""

    @F.pandas_udf("string")
    def sort(values):
        return values.map(lambda x: codec.canonical(json.loads(x)).decode())

    return sort(raw)


def manifest_leaves(value: dict) -> list[str]:
    """What a manifest refers to, in order, each once."""
    out: list[str] = []
    for f in ("original", "chunk", "chunks", "children", "prompt", "system_prompt", "inputs", "outputs", "retrieved_chunks", "summary"):
        v = value.get(f)
        out += [v] if isinstance(v, str) else v or []
    return list(dict.fromkeys(out))


def verify_checkpoints(chain: list[tuple[str, dict]], head: str, *, public_key: str | None = None, signed: bool = False) -> dict:
    """{length, signed} of checkpoints, newest first, that are what they say; or ValueError."""
    if not chain:
        raise ValueError(f"no checkpoints on {head}")
    n, signatures, after = chain[0][1]["sequence"], 0, None
    spine: list[bytes] = []
    for name, v in reversed(chain):  # the first first
        if codec.digest("checkpoint", codec.canonical(v)) != name:
            raise ValueError(f"checkpoint {name} is not what its hash says")
        if v["head"] != head:
            raise ValueError(f"checkpoint {name} is of another head")
        if v["prev"] != after or (v["sequence"] == 0) != (v["prev"] is None):
            raise ValueError(f"checkpoint {name} doesn't follow the one before")
        if v["sequence"] != (0 if after is None else last + 1):
            raise ValueError(f"checkpoint {name} is out of sequence")
        spine = merkle.appended(spine, v["sequence"], merkle.leaf(v["commit"].encode()))
        if [x.hex() for x in spine] != v["log_spine"] or merkle.seal(merkle.spine_root(spine), v["sequence"] + 1).hex() != v["log_root"]:
            raise ValueError(f"the log of checkpoint {name} doesn't extend the one before")
        if v.get("signature"):
            if not signature_holds(v, public_key):
                raise ValueError(f"the signature of checkpoint {name} doesn't hold")
            signatures += 1
        elif signed:
            raise ValueError(f"checkpoint {name} is unsigned")
        after, last = name, v["sequence"]
    return {"length": n + 1, "signed": signatures}


def verify_chunk_proof(proof: dict) -> str:
    """The kind of manifest that anchors the chunk, from the proof alone; ValueError tells what doesn't hold."""
    if proof.get("version") != 1 or not proof.get("path"):
        raise ValueError("no proof of a known version")
    want, value = proof["commit"], None
    for k, body in enumerate(proof["path"]):
        if want is None:
            raise ValueError("the path goes on after a root")
        if codec.digest("commit", body.encode()) != want:
            raise ValueError(f"commit {k} of the path is not what its hash says")
        value = codec.decoded(body)
        want = value["parents"][0] if value["parents"] else None
    if proof["manifest"] not in value["manifests"]:
        raise ValueError("the last commit doesn't bring the manifest")
    if codec.digest(proof["kind"], proof["body"].encode()) != proof["manifest"]:
        raise ValueError("the manifest is not what its hash says")
    if proof["chunk"] not in manifest_leaves(codec.decoded(proof["body"])):
        raise ValueError("the manifest doesn't refer to the chunk")
    if proof["content"] is not None:
        if proof["erased"]:
            raise ValueError("erased, and yet with content")
        if codec.digest("blob", bytes.fromhex(proof["content"])) != proof["chunk"]:
            raise ValueError("the content is not what the chunk's hash says")
    return proof["kind"]
