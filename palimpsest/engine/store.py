"""Tables of the shared folder, blobs and objects by their digest, packs and encryption at rest.

A table is a folder of batches; appending writes a batch and nothing is ever changed in place. Blobs and objects
are deduplicated within what is added and against what is there. A pack is a batch like any other: rewriting
puts many small ones together, or leaves out what isn't wanted, as new batches before the old ones go.
"""

from __future__ import annotations

import hashlib
import hmac
import secrets
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.engine.fs import Folder
from palimpsest.functions import codec
from palimpsest.functions.text import digest

SCHEMAS = {
    "blobs": "hash string, bytes binary, n_bytes long, stored_at long",
    "objects": "hash string, kind string, body string, stored_at long",
    "state": "key binary, value binary",
    "chunks": "manifest string, ordinal int, start long, end long, chunk_hash string",
}


class Crypt:
    """AES-GCM with a key by blob: the master key comes from a password by scrypt, a blob's by HMAC from its digest."""

    def __init__(self, password: str, salt: bytes):
        self.master = hashlib.scrypt(password.encode(), salt=salt, n=1 << 14, r=8, p=1, dklen=32)

    def key(self, name: str) -> bytes:
        return hmac.new(self.master, name.encode(), hashlib.sha256).digest()

    def _key(self, of: Column) -> Column:
        """HMAC-SHA-256 of the blob's name as a column. The plan holds the padded master key: event logs of such a session must be kept as secret as the password."""
        pad = self.master.ljust(64, b"\0")
        inner, outer = (bytes(b ^ x for b in pad) for x in (0x36, 0x5C))
        once = F.unhex(F.sha2(F.concat(F.lit(inner), of.cast("binary")), 256))
        return F.unhex(F.sha2(F.concat(F.lit(outer), once), 256))

    def sealed(self, content: Column, name: Column) -> Column:
        return F.aes_encrypt(content, self._key(name), F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), name.cast("binary"))

    def opened(self, content: Column, name: Column) -> Column:
        """Null where the key isn't the one that it was sealed with, or something was changed."""
        return F.try_aes_decrypt(content, self._key(name), F.lit("GCM"), F.lit("DEFAULT"), name.cast("binary"))


class Tables:
    def __init__(self, spark: SparkSession, folder: Folder):
        self.spark, self.folder = spark, folder

    def batches(self, name: str) -> list[str]:
        return [b for b in self.folder.list(f"tables/{name}") if self.folder.exists(f"tables/{name}/{b}/_SUCCESS")]

    def read(self, name: str, batches: list[str] | None = None) -> DataFrame:
        """All batches that were written whole, or those named."""
        found = self.batches(name) if batches is None else batches
        if not found:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(*(f"{self.folder.root}/tables/{name}/{b}" for b in found))

    def append(self, name: str, rows: DataFrame) -> str:
        batch = uuid.uuid4().hex
        wanted = self.spark.createDataFrame([], SCHEMAS[name]).schema
        rows.select(*(F.col(f.name).cast(f.dataType) for f in wanted)).write.option("compression", "zstd").parquet(f"{self.folder.root}/tables/{name}/{batch}")
        return batch

    def rewrite(self, name: str, rows: DataFrame, order: str, files: int | None = None) -> None:
        """Puts ``rows``, sorted by ranges of ``order``, in the place of all batches: first the new, then the old go."""
        old = self.batches(name)
        sorted_ = rows.repartitionByRange(files, order) if files else rows.repartitionByRange(order)
        self.append(name, sorted_.sortWithinPartitions(order))
        for b in old:
            self.folder.delete(f"tables/{name}/{b}")


class Blobs:
    """Bytes by their digest; with a ``Crypt``, encrypted where they lie."""

    def __init__(self, tables: Tables, crypt: Crypt | None = None):
        self.tables, self.crypt = tables, crypt

    def put_many(self, rows: DataFrame, column: str = "bytes", *, now: int | None = None) -> DataFrame:
        """(hash) of each row of a binary or string column; what is new is appended once, however often it comes."""
        hashed = rows.select(F.col(column).cast("binary").alias("bytes")).where("bytes is not null").withColumn("hash", digest("blob", "bytes"))
        new = hashed.groupBy("hash").agg(F.any_value("bytes").alias("bytes")).join(self.tables.read("blobs").select("hash"), "hash", "left_anti")
        content = F.col("bytes") if self.crypt is None else self.crypt.sealed(F.col("bytes"), F.col("hash"))
        self.tables.append("blobs", new.select("hash", content.alias("bytes"), F.length("bytes").cast("long").alias("n_bytes"), F.lit(codec.now_unix() if now is None else now).alias("stored_at")))
        return hashed.select("hash")

    def put(self, content: bytes) -> str:
        self.put_many(self.tables.spark.createDataFrame([(bytearray(content),)], "bytes binary"))
        return codec.digest("blob", content)

    def opened(self) -> DataFrame:
        """(hash, bytes, n_bytes) as they were put."""
        b = self.tables.read("blobs")
        return b if self.crypt is None else b.withColumn("bytes", self.crypt.opened(F.col("bytes"), F.col("hash")))

    def get(self, name: str) -> bytes:
        """The bytes, whose digest is checked; KeyError if there are none, ValueError if they are others."""
        found = self.opened().where(F.col("hash") == codec.parse_hash(name)).first()
        if found is None:
            raise KeyError(name)
        if found.bytes is None or codec.digest("blob", bytes(found.bytes)) != name:
            raise ValueError(f"blob {name} is damaged or sealed with another key")
        return bytes(found.bytes)

    def exists(self, name: str) -> bool:
        return not self.tables.read("blobs").where(F.col("hash") == name).isEmpty()

    def listed(self) -> DataFrame:
        return self.tables.read("blobs").select("hash", "n_bytes", "stored_at")

    def faults(self) -> DataFrame:
        """(hash, fault) of blobs that aren't what their digest says."""
        bad = F.when(F.col("bytes").isNull(), "unreadable").when(digest("blob", "bytes") != F.col("hash"), "changed")
        return self.opened().select("hash", bad.alias("fault")).where("fault is not null")

    def shred(self, names: DataFrame) -> None:
        """Leaves out blobs (hash) for good."""
        self.tables.rewrite("blobs", self.tables.read("blobs").join(names.select("hash"), "hash", "left_anti"), "hash")

    def compact(self) -> dict[str, int]:
        """Puts all batches together, sorted by digest, so that looking one up skips most of the files."""
        before = len(self.tables.batches("blobs"))
        if before > 1:
            self.tables.rewrite("blobs", self.tables.read("blobs").dropDuplicates(["hash"]), "hash")
        return {"batches_before": before, "batches_after": len(self.tables.batches("blobs"))}

    def add_files(self, path: str) -> DataFrame:
        """Puts every file of a folder, as loose objects lie there: (path, hash)."""
        files = self.tables.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("content").alias("bytes"))
        self.put_many(files)
        return files.select("path", digest("blob", "bytes").alias("hash"))

    def rekey(self, crypt: Crypt) -> int:
        """Seals all blobs with another key; none may be unreadable. How many there are."""
        if not self.faults().isEmpty():
            raise ValueError("some blobs can't be read: nothing was changed")
        rows = self.opened().withColumn("bytes", crypt.sealed(F.col("bytes"), F.col("hash")))
        self.tables.rewrite("blobs", rows, "hash")
        self.crypt = crypt
        return self.tables.read("blobs").count()


class Objects:
    """Canonical values under a tag by their digest: commits, manifests, checkpoints, queries."""

    def __init__(self, tables: Tables):
        self.tables = tables
        self._seen: dict[str, tuple[str, dict]] = {}

    def put_rows(self, rows: DataFrame, *, now: int | None = None) -> None:
        """Appends (kind, body) that aren't there yet; bodies must be canonical."""
        named = rows.select("kind", "body").withColumn("hash", F.sha2(F.concat(F.col("kind"), F.lit(":"), F.col("body")).cast("binary"), 256)).dropDuplicates(["hash"])
        new = named.join(self.tables.read("objects").select("hash"), "hash", "left_anti")
        self.tables.append("objects", new.withColumn("stored_at", F.lit(codec.now_unix() if now is None else now)))

    def put(self, kind: str, value: dict) -> str:
        body = codec.canonical(value)
        name = codec.digest(kind, body)
        if name not in self._seen:
            self.put_rows(self.tables.spark.createDataFrame([(kind, body.decode())], "kind string, body string"))
            self._seen[name] = (kind, value)
        return name

    def rows(self, kind: str | None = None) -> DataFrame:
        o = self.tables.read("objects")
        return o if kind is None else o.where(F.col("kind") == kind)

    def inspect(self, name: str) -> tuple[str, dict]:
        """(kind, value) of an object, whose digest is derived again from its bytes."""
        if name not in self._seen:
            if len(self._seen) > 8192:
                self._seen.clear()
            found = self.rows().where(F.col("hash") == codec.parse_hash(name)).first()
            if found is None:
                raise KeyError(name)
            if codec.digest(found.kind, found.body.encode()) != name:
                raise ValueError(f"object {name} is damaged")
            self._seen[name] = (found.kind, codec.decoded(found.body))
        return self._seen[name]

    def get(self, name: str, kind: str) -> dict:
        found, value = self.inspect(name)
        if found != kind:
            raise ValueError(f"{name} is a {found}, not a {kind}")
        return value

    def fetch(self, kind: str) -> dict[str, dict]:
        """All values of a kind of which there are few enough for the driver, such as commits of a history that is walked."""
        for r in self.rows(kind).select("hash", "body").toLocalIterator():
            self._seen.setdefault(r.hash, (kind, codec.decoded(r.body)))
        return {h: v for h, (k, v) in self._seen.items() if k == kind}

    def faults(self) -> DataFrame:
        return self.rows().where(F.sha2(F.concat(F.col("kind"), F.lit(":"), F.col("body")).cast("binary"), 256) != F.col("hash")).select("hash", F.lit("changed").alias("fault"))


def new_salt() -> bytes:
    return secrets.token_bytes(16)
