import hashlib
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import codec as C
from palimpsest.functions import ed25519 as E
from palimpsest.functions import text as T
from palimpsest.operators import memory as M
from palimpsest.operators import retrieval as R
from palimpsest.plans import merkle
from palimpsest.plans import statetree as S


def test_tokens_fold_ascii_only_and_previews_cut_between_characters(spark):
    df = spark.createDataFrame([("Äb CD-e1 CD",), ("",), (None,)], "text string")
    assert [r[0] for r in df.select(T.tokens("text")).collect()] == [["Äb", "cd", "e1", "cd"], [], []]
    long = spark.createDataFrame([("é" * 100,), (" a\nb ",)], "text string")
    assert [r[0] for r in long.select(T.preview("text")).collect()] == ["é" * 48 + "...", "a b"]
    assert T.prefix_end("c/1") == "c/2" and T.prefix_end("") is None


def test_chunks_end_at_the_text_s_end(spark):
    df = spark.createDataFrame([(1, "a" * 10), (2, "b" * 4), (3, ""), (4, None), (5, "c" * 11)], "doc_id long, text string")
    got = sorted((r.doc_id, r.ordinal, r.start, r.end) for r in R.chunks(df, 4, 1).collect())
    assert got == [(1, 0, 0, 4), (1, 1, 3, 7), (1, 2, 6, 10), (2, 0, 0, 4), (5, 0, 0, 4), (5, 1, 3, 7), (5, 2, 6, 10), (5, 3, 9, 11)]


def test_scores_do_not_depend_on_hidden_documents(spark):
    own = [(1, "quark mass", "a", None), (2, "other words here", "a", None)]
    hidden = [(k, "quark " * k, "b", ["group:hr"] if k % 2 else None) for k in range(3, 40)]
    q = spark.createDataFrame([(0, "quark quark")], "query_id long, text string")

    def scores(rows):
        df = spark.createDataFrame(rows, "doc_id long, text string, tenant string, acl array<string>").fillna({}).selectExpr("doc_id", "text", "tenant", "coalesce(acl, array()) acl")
        return [tuple(r) for r in R.bm25(R.visible(df, tenant="a"), q).collect()]

    assert scores(own) == scores(own + hidden) != []


def test_vectors_of_norm_zero_or_other_length_are_left_out(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0], ), (2, [0.0, 0.0]), (3, [1.0]), (4, [1.0, 1.0]), (5, None)], "vec_id long, embedding array<float>")
    got = [(r.doc_id, r["rank"]) for r in R.vector_topk(v, {0: [2.0, 0.0]}, 3).collect()]
    assert sorted(got) == [(1, 1), (4, 2)]


def test_state_against_a_dictionary(spark):
    rng = random.Random(3)
    ops = [(f"k{rng.randrange(40):03}", k, None if rng.random() < 0.33 else str(k)) for k in range(400)]
    want = {}
    for k, _, v in ops:
        want[k] = v
    df = spark.createDataFrame(ops, "key string, ordinal long, value string")
    assert {r.key: r.value for r in M.state_at(df).collect()} == {k: v for k, v in want.items() if v is not None}
    batch = M.write_many(M.state_at(df, 200).select("key", "value"), df.where("ordinal > 200"))
    assert {r.key: r.value for r in batch.collect()} == {k: v for k, v in want.items() if v is not None}


def test_chain_faults_are_found(spark):
    e = spark.createDataFrame([(1, k, "k", 10 * k, f"e{k}") for k in range(6)] + [(2, 9, None, None, None)], "log long, order long, kind string, at long, data string")
    c = M.chain(e)
    assert M.chain_faults(c).collect() == []
    assert sorted((r.log, r.seq) for r in c.collect()) == [(1, k) for k in range(6)] + [(2, 0)]
    for change in ("if(seq = 2, 'no', data) data", "if(seq = 2, 'no', kind) kind", "if(seq = 2, 7, at) at"):
        name = change.split()[-1]
        forged = c.selectExpr(*(change if x == name else x for x in c.columns))
        assert [tuple(r) for r in M.chain_faults(forged).collect()] == [(1, 2, "rewritten")]
    assert [tuple(r) for r in M.chain_faults(c.where("seq <> 3")).collect()] == [(1, 4, "unlinked"), (1, 5, "misplaced")]
    assert {r.fault for r in M.chain_faults(c.withColumn("seq", F.expr("seq + 5"))).collect()} == {"rewritten"}


def test_selectors(spark):
    cases = [("foobar", ["foo *"], False), ("foo bar", ["foo *"], True), ("foobar", ["foo*"], True), ("foo", ["x", "foo"], True), ("foo", [], True), ("foo", ["*"], True), ("foo", None, True), ("foo", ["f"], False), ("", ["*"], True), ("a*", ["a*"], True)]
    df = spark.createDataFrame(cases, "head string, heads array<string>, want boolean")
    assert all(r.got == r.want for r in df.select("want", M.head_matches("head", "heads").alias("got")).collect())


def test_fast_forward_over_all_parents(spark):
    edges = spark.createDataFrame([(2, 1), (3, 2), (4, 1), (5, 3), (5, 4), (9, 8)], "src long, dst long")
    local = spark.createDataFrame([("a", 4), ("b", 5), ("c", 3), ("d", 2), ("e", 3)], "name string, node long")
    remote = spark.createDataFrame([("a", 5), ("b", 1), ("c", 4), ("d", 2), ("f", 9)], "name string, node long")
    got = {r.name: r.verdict for r in M.fast_forward(edges, local, remote).collect()}
    assert got == {"a": "forward", "b": "behind", "c": "diverged", "d": "same", "e": "local", "f": "new"}


def test_long_chains_are_followed(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)], "src long, dst long")
    assert sorted(r.node for r in M.reachable(edges, spark.createDataFrame([(5,)], "node long")).collect()) == list(range(5, 41))


def test_reachable_and_erasable(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (7, 8)], "src long, dst long")
    assert sorted(r.node for r in M.reachable(edges, spark.createDataFrame([(1,)], "node long")).collect()) == [1, 2, 3]
    refs = spark.createDataFrame([("a", "s"), ("b", "s"), ("b", "t"), ("c", "t"), ("d", "s"), ("d", None)], "hash string, subject string")
    assert [r.hash for r in M.erasable(refs, "s").collect()] == ["a"]


def test_merkle_proofs_and_the_distributed_root(spark):
    for n in (1, 2, 3, 5, 8, 13, 31):
        h = [merkle.leaf(str(k).encode()) for k in range(n)]
        root = merkle.sealed(h)
        parts = []
        for k, x in enumerate(h):
            parts = merkle.appended(parts, k, x)
            assert parts == merkle.spine(h[: k + 1]) and merkle.seal(merkle.spine_root(parts), k + 1) == merkle.sealed(h[: k + 1])
        for i in range(n):
            path = merkle.inclusion(h, i)
            assert merkle.included(root, h[i], i, n, path)
            assert not merkle.included(root, merkle.leaf(b"x"), i, n, path)
            assert not merkle.included(root, h[i], i, n + 1, path) and not merkle.included(merkle.fold(h), h[i], i, n, path)
        for m in range(1, n + 1):
            proof = merkle.consistency(h, m)
            assert merkle.consistent(merkle.sealed(h[:m]), m, root, n, proof)
            assert not merkle.consistent(hashlib.sha256(b"no").digest(), m, root, n, proof)
            if m < n:
                assert not merkle.consistent(merkle.sealed(h[:m]), m, merkle.sealed(h[:-1]), n - 1, proof) or m == n - 1
    for n, bits in ((0, 4), (1, 4), (16, 4), (300, 4), (300, 12), (257, 2)):
        rows = spark.createDataFrame([(f"{k:05}",) for k in range(n)], "data string").repartition(7)
        got = merkle.root(rows, "data", "data", block_bits=bits).first()
        assert (got.root, got.n) == (merkle.sealed([merkle.leaf(f"{k:05}".encode()) for k in range(n)]).hex(), n)


def test_state_tree_proofs_and_the_distributed_root(spark, monkeypatch):
    rng = random.Random(5)
    for n in (0, 1, 2, 40, 700):
        entries = sorted({f"k{rng.randrange(10**6)}".encode(): S.value_hash(str(k).encode()) for k in range(n)}.items())
        tree = S.Tree(entries)
        for key, h in [*rng.sample(entries, min(30, len(entries))), (b"", None), (b"k5x", None), (b"zz", None)]:
            p = S.proof(tree, key)
            assert p["found"] == h and S.proves(tree.root, key, p)
            assert not S.proves(tree.root, key, p | {"found": "0" * 64 if h is None else None})
            assert not S.proves("1" * 64, key, p)
            if len(p["path"]) > 1:
                assert not S.proves(tree.root, key, p | {"path": p["path"][1:]}) and not S.proves(tree.root, key, p | {"path": p["path"][:-1]})
    rows = [(bytearray(f"k{rng.randrange(10**6)}".encode()), bytearray(str(k).encode())) for k in range(900)]
    rows = list({bytes(k): (k, v) for k, v in rows}.values())
    want = S.Tree(sorted((bytes(k), S.value_hash(bytes(v))) for k, v in rows)).root
    df = spark.createDataFrame(rows, "key binary, value binary").repartition(5)
    assert S.root(df) == want
    monkeypatch.setattr(S, "FEW", 3)
    assert S.root(df) == want and S.root(df.limit(0)) == S.EMPTY


def test_scores_by_joins_and_by_matrices_are_the_same(spark, monkeypatch):
    rng = random.Random(1)
    docs = spark.createDataFrame([(k, " ".join(rng.choice("abcdefgh") * rng.randrange(1, 3) for _ in range(rng.randrange(30)))) for k in range(80)] + [(99, None)], "doc_id long, text string")
    queries = spark.createDataFrame([(0, "a bb c a"), (1, "none of it"), (2, ""), (3, "h")], "query_id long, text string")
    one = sorted(map(tuple, R.bm25(docs, queries).collect()))
    top = sorted(map(tuple, R.ranked(R.bm25(docs, queries, 5), 5).collect()))
    monkeypatch.setattr(R, "WEIGHTS", 0)
    two = sorted(map(tuple, R.bm25(docs, queries).collect()))
    assert len(one) == len(two) > 50 and all(a[:2] == b[:2] and abs(a[2] - b[2]) < 2e-6 for a, b in zip(one, two))
    assert [t[:2] for t in top] == sorted((r.query_id, r.doc_id) for r in R.ranked(R.bm25(docs, queries), 5).collect())


def test_faults_of_attributes(spark):
    v = spark.createDataFrame([(None, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert sorted((r.doc_id, r["rank"]) for r in R.vector_topk(v, {0: [1.0, 0.0]}, 2).collect()) == [(1, 1), (2, 2)]
    d = spark.createDataFrame([(1, None), (2, []), (3, ["x"]), (4, ["y"])], "doc_id long, acl array<string>")
    assert sorted(r.doc_id for r in R.visible(d).collect()) == [1, 2]
    assert sorted(r.doc_id for r in R.visible(d, tags=("x",)).collect()) == [1, 2, 3]
    assert T.prefix_end("a\ud7ff") == "a\ue000" and T.prefix_upper(b"a\xff") == b"b" and T.prefix_upper(b"\xff") is None
    p = spark.createDataFrame([("\t a\nb \r\n",), ("x" * 95 + "é",), ("x" * 94 + "é",), ("x" * 95 + "\ufffd" + "y",), ("\u3000é" * 50,), (None,)], "text string")
    assert [r[0] for r in p.select(T.preview("text")).collect()] == ["a b", "x" * 95 + "...", "x" * 94 + "é", "x" * 95 + "...", ("é\u3000" * 19 + "é\u3000")[: 38] + "...", None]


def test_codec_and_signatures():
    assert C.canonical({"b": 1, "a": ["é"]}) == '{"a":["é"],"b":1}'.encode() and C.decoded(b'{"a":1}') == {"a": 1}
    for bad in (b'{"b":1,"a":2}', b"{", b'{"a": 1}'):
        with pytest.raises(ValueError):
            C.decoded(bad)
    assert C.embedding("[1, 2.5]") == [1.0, 2.5] and C.embedding(bytes([0x82, 0xFA, 0x3F, 0x80, 0, 0, 0xFB, 0x40, 4, 0, 0, 0, 0, 0, 0])) == [1.0, 2.5]
    for bad in ("{}", b"\x82\xfa", "[true]"):
        with pytest.raises(ValueError):
            C.embedding(bad)
    assert C.key_bytes("6162", "hex") == C.key_bytes("YWI=", "base64") == C.key_bytes("ab") == b"ab"
    assert C.parameters({"t": 1}, ["t=2", "n=x"]) == b'{"n":"x","t":2}' and C.io_hashes([f"in:{'a' * 64}", f"out:{'b' * 64}"]) == (["a" * 64], ["b" * 64])
    secret = bytes.fromhex("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60")  # RFC 8032, test 1
    assert E.public(secret).hex() == "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a"
    sig = E.sign(secret, b"")
    assert sig.hex().startswith("e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e06522490155")
    assert E.verify(E.public(secret), b"", sig) and not E.verify(E.public(secret), b"x", sig) and not E.verify(b"\0" * 31, b"", sig)
    other = E.generate()
    assert E.verify(E.public(other), b"m", E.sign(other, b"m")) and not E.verify(E.public(other), b"", sig)


def test_approximate_search_finds_nine_of_ten(spark):
    from palimpsest.operators.records import Cells, two_stage

    rng = random.Random(6)
    rows = [(k, [rng.gauss(0, 1) + 2 * ((k * 7 + j) % 5 == 0) for j in range(16)]) for k in range(3000)]
    v = spark.createDataFrame([*rows, (None, rows[0][1]), (9000, [0.0] * 16), (9001, [1.0])], "vec_id long, embedding array<float>").repartition(5)
    queries = {i: [x + rng.gauss(0, 0.3) for x in rows[i * 50][1]] for i in range(40)}
    exact = {(r.query_id, r.doc_id) for r in R.vector_topk(v, queries, 10).collect()}
    for got in (Cells(v, 16).search(queries, 10), two_stage(v, queries, 10)):
        found = {(r.query_id, r.doc_id) for r in got.collect()}
        assert len(found) == 400 and len(found & exact) >= 0.9 * len(exact)
    assert {(r.query_id, r.doc_id) for r in Cells(v, 16).search(queries, 10, probes=64).collect()} == exact


def test_names_as_columns_and_as_values(spark):
    from palimpsest.engine.refs import valid_name
    from palimpsest.operators.records import ref_name_holds

    rng = random.Random(8)
    names = ["".join(rng.choice("ab/.-_L. lock") for _ in range(rng.randrange(7))) + rng.choice(["", ".lock", "/x", "\n"]) for _ in range(600)] + ["a/b/c/d/e", "a/b/c/d/e/f"]
    got = spark.createDataFrame([(n,) for n in names], "name string").select("name", ref_name_holds(F.col("name")).alias("ok")).collect()
    assert {(r.name, r.ok) for r in got} == {(n, valid_name(n)) for n in names} and 20 < sum(r.ok for r in got) < 580
