import json

import pytest

from palimpsest import storage
from palimpsest.engine import cli
from palimpsest.sources import snapshot
from palimpsest.streaming import feed

SF = "/root/testdata/sf0.001"


def test_snapshot_round_trip_and_change(spark, tmp_path):
    t = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    snapshot.export({"t": t, "none": t.where("k > 5")}, f"{tmp_path}/s")
    back = snapshot.restore(spark, f"{tmp_path}/s")
    assert sorted(map(tuple, back["t"].collect())) == [(1, "a"), (2, None)] and back["none"].isEmpty()
    t.write.mode("append").parquet(f"{tmp_path}/s/t")
    with pytest.raises(ValueError, match="t"):
        snapshot.restore(spark, f"{tmp_path}/s")


def test_feed_counts_equal_batch(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet")
    e.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = feed.events(spark, f"{tmp_path}/in", e.schema, since=100, kind="click")
    stream.writeStream.format("memory").queryName("feed").trigger(availableNow=True).start().awaitTermination()
    want = sorted(r[0] for r in e.where("event_id > 100 and event_type = 'click'").select("event_id").collect())
    assert sorted(r[0] for r in spark.table("feed").select("event_id").collect()) == want
    counts = feed.windowed_counts(feed.events(spark, f"{tmp_path}/in", e.schema))
    counts.writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("counts").agg({"n": "sum"}).first()[0] == e.count()


def test_micro_batches_of_state(spark, tmp_path):
    want = {}
    for batch in ([("a", "1", 1), ("b", "2", 2), ("a", None, 3)], [("c", "3", 4), ("b", "4", 5), ("d", "5", 6)], [("b", None, 7), ("e", None, 8)]):
        spark.createDataFrame(batch, "key string, value string, ordinal long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("key string, value string, ordinal long").parquet(f"{tmp_path}/in")
        feed.write_state(stream, f"{tmp_path}/out", f"{tmp_path}/cp", parts=4).awaitTermination()
        for k, v, _ in batch:
            want[k] = v
        assert {r.key: r.value for r in feed.read_state(spark, f"{tmp_path}/out").collect()} == {k: v for k, v in want.items() if v is not None}
    assert {tuple(r) for r in feed.read_state(spark, f"{tmp_path}/out", 1).collect()} == {("b", "2")} and feed.read_state(spark, f"{tmp_path}/none").isEmpty()
    with pytest.raises(KeyError):
        feed.read_state(spark, f"{tmp_path}/out", 9)


def test_command_line(spark, tmp_path):
    root = f"{tmp_path}/db"
    call = lambda *a: cli.run([root, *map(str, a)], spark)
    call("db", "init", "--retention", 10)
    (tmp_path / "f").write_text("some text of a document, long enough to be cut into pieces " * 5)
    made = call("manifest", "put-doc", "main", "src", tmp_path / "f", "--chunk-size", 128)
    assert call("object", "inspect", made["manifest"])["kind"] == "doc" and len(call("search", "semantic", "main", "--query", "pieces")) > 1
    root_hash = call("state", "set", "main", "k", "v")["root"]
    assert call("state", "get", "main", "6b", "--encoding", "hex") == {"value": "v"} and call("state", "prove", "main", "k")["root"] == root_hash
    (tmp_path / "many").write_text('[{"key": "a", "value_base64": "eA=="}]')
    call("state", "set-many", "main", tmp_path / "many")
    assert call("state", "scan", "main", "a") == [{"key": "a", "value": "x"}]
    public = call("key", "generate", "k1")["public"]
    commit = call("commit", "new", "main", "a message", "--key", "k1")["commit"]
    assert call("commit", "verify", commit, "--public", public) == {"valid": True} and call("log", "show", "main")[0]["commit"] == commit
    call("checkpoint", "new", "main", "--key", "k1")
    assert call("checkpoint", "verify", "main", "--signed") == {"length": 1, "signed": 1}
    call("audit", "export", "main", tmp_path / "bundle", "--key", "k1")
    assert call("audit", "verify", tmp_path / "bundle", "--public", public, "--signed")["checkpoints"] == 1
    chunk = call("search", "semantic", "main", "--query", "pieces")[0]["chunk"]
    (tmp_path / "proof").write_text(json.dumps(call("proof", "chunk", commit, chunk, "--content")))
    assert call("proof", "verify-chunk", tmp_path / "proof") == {"anchor": "doc"}
    assert call("session", "append", "main", "s", "hi")["seq"] == 0 and call("session", "list", "main", "s")[0]["bytes"] == "hi" and call("events", "verify") == {"faults": []}
    assert call("auth", "add-key", "k", "reader")["token"] and call("auth", "list-keys")[0]["role"] == "reader" and call("db", "gc")["unreachable"] == 0


def test_intermediate_tables_can_be_deleted(spark):
    df = storage.written(spark.range(3), "t")
    assert df.count() == 3 and storage.clean(spark) >= 1 and storage.clean(spark) == 0
