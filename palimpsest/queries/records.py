"""Queries on manifests, stores, references, history, state trees, bundles, sessions and approximate vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.text import digest
from palimpsest.operators import memory as M
from palimpsest.operators import records as C
from palimpsest.operators import retrieval as R
from palimpsest.plans import statetree
from palimpsest.plans.sequences import numbered
from palimpsest.queries.catalogue import query
from palimpsest.queries.memory import _COMMITS, _OPS, _TIP, commit_edges, levels_sql, ops, seal_sql, tip, turns
from palimpsest.queries.retrieval import _META, _VECTORS_SQL, DIM, VECTORS, _top, documents, table
from palimpsest.storage import written

_BLOBS = f"SELECT doc_id, generation, subject, sha256('blob:' || text) AS hash, octet_length(encode(text)) AS n_bytes FROM ({_META}) WHERE text IS NOT NULL"
_CHUNKS = """b AS (SELECT doc_id, encode(text) AS raw, octet_length(encode(text)) AS n FROM documents WHERE length(text) > 0),
c AS (SELECT doc_id, ordinal, sha256(encode('blob:') || array_slice(raw, ordinal*1792+1, ordinal*1792+2048)) AS h FROM (SELECT *, unnest(range(0, greatest(0, ceil((n-2048)/1792.0))::BIGINT + 1)) AS ordinal FROM b))"""


def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).where("text is not null")
    return d.select("doc_id", "generation", "subject", digest("blob", "text").alias("hash"), F.octet_length("text").cast("long").alias("n_bytes"))


@query("doc_manifests", f"""WITH {_CHUNKS}, l AS (SELECT doc_id, string_agg(h, ',' ORDER BY ordinal) AS hs, count(*)::INT AS n_chunks FROM c GROUP BY doc_id)
SELECT doc_id, source, n_chunks, original, sha256('doc:' || coalesce(source, '') || chr(10) || original || chr(10) || hs) AS manifest
FROM (SELECT d.doc_id, source, coalesce(n_chunks, 0) AS n_chunks, sha256('blob:' || text) AS original, coalesce(hs, '') AS hs FROM documents d LEFT JOIN l USING (doc_id) WHERE text IS NOT NULL)""")  # fmt: skip
def doc_manifests(spark, sf_dir):
    return C.manifests(table(spark, sf_dir, "documents")).select("doc_id", "source", F.size("chunks").alias("n_chunks"), "original", "manifest")


@query("manifest_reference_root", f"""WITH {_CHUNKS}, i AS (SELECT doc_id, ordinal AS idx, sha256('\\x00'::BLOB || encode(h)) AS h FROM c), {levels_sql('i', 9, by='doc_id')}
SELECT doc_id, {seal_sql('n', 'h')} AS root, n FROM m9 JOIN (SELECT doc_id, count(*)::INT AS n FROM c GROUP BY doc_id) USING (doc_id)""")
def manifest_reference_root(spark, sf_dir):
    """The sealed root over each document's chunks."""
    m = C.manifests(table(spark, sf_dir, "documents")).where(F.size("chunks") > 0)
    return C.reference_roots(m, "doc_id", "chunks")


@query("tenant_index", f"SELECT tenant, count(*) AS n, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS docs FROM ({_META}) GROUP BY tenant")
def tenant_index(spark, sf_dir):
    d = documents(spark, sf_dir).groupBy("tenant").agg(F.sort_array(F.collect_list("doc_id")).alias("ids"))
    return d.select("tenant", F.size("ids").cast("long").alias("n"), F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("docs"))


_HALF = "(SELECT max(doc_id)//2 FROM documents)"


def half(spark: SparkSession, sf_dir: str) -> int:
    return (table(spark, sf_dir, "documents").agg(F.max("doc_id")).first()[0] or 0) // 2


@query("blobs_not_stored", f"WITH d AS ({_BLOBS}) SELECT DISTINCT hash, n_bytes FROM d WHERE doc_id > {_HALF} AND hash NOT IN (SELECT hash FROM d WHERE doc_id <= {_HALF})")
def blobs_not_stored(spark, sf_dir):
    """What putting the second half adds to a store that has the first."""
    b, at = blobs(spark, sf_dir), half(spark, sf_dir)
    return C.not_stored(b.where(F.col("doc_id") > at), b.where(F.col("doc_id") <= at)).select("hash", "n_bytes")


@query("pack_rewrite", f"WITH d AS ({_BLOBS}) SELECT hash, min(n_bytes) AS n_bytes, min(doc_id) AS first_doc FROM d WHERE hash NOT IN (SELECT hash FROM d WHERE subject = 's7') GROUP BY hash")
def pack_rewrite(spark, sf_dir):
    """A pack without the blobs of one subject."""
    b = blobs(spark, sf_dir)
    kept = b.join(b.where("subject = 's7'").select("hash"), "hash", "left_anti")
    return kept.groupBy("hash").agg(F.min("n_bytes").alias("n_bytes"), F.min("doc_id").alias("first_doc"))


@query("merge_union", f"""WITH d AS ({_BLOBS}), l AS (SELECT DISTINCT hash FROM d WHERE doc_id % 3 <> 0), r AS (SELECT DISTINCT hash FROM d WHERE doc_id % 3 <> 1)
SELECT hash, CASE WHEN hash NOT IN (SELECT hash FROM r) THEN 'local' WHEN hash NOT IN (SELECT hash FROM l) THEN 'remote' ELSE 'both' END AS side FROM (SELECT * FROM l UNION SELECT * FROM r)""")  # fmt: skip
def merge_union(spark, sf_dir):
    b = blobs(spark, sf_dir)
    return C.united(b.where("doc_id % 3 <> 0"), b.where("doc_id % 3 <> 1"))


@query("gc_stats", f"""WITH RECURSIVE {_COMMITS}, w(node) AS (SELECT {_TIP} UNION SELECT dst FROM w JOIN edges ON src = node), d AS ({_BLOBS}),
u AS (SELECT hash, min(n_bytes) AS n_bytes, bool_or(generation IN (SELECT node FROM w)) AS live, max(doc_id) AS newest FROM d GROUP BY hash)
SELECT count(*) FILTER (live) AS reachable, count(*) FILTER (NOT live) AS unreachable, count(*) FILTER (NOT live AND newest < (SELECT max(doc_id)*9//10 FROM documents)) AS old,
 sum(n_bytes) FILTER (NOT live AND newest < (SELECT max(doc_id)*9//10 FROM documents))::BIGINT AS old_bytes FROM u""")  # fmt: skip
def gc_stats(spark, sf_dir):
    """What a collection would delete: unreachable, and older than the newest tenth."""
    b = blobs(spark, sf_dir)
    live = M.reachable(commit_edges(spark, sf_dir), tip(spark, sf_dir)).select(F.col("node").alias("generation"), F.lit(True).alias("l"))
    grace = (table(spark, sf_dir, "documents").agg(F.max("doc_id")).first()[0] or 0) * 9 // 10
    u = b.join(live, "generation", "left").groupBy("hash").agg(F.min("n_bytes").alias("n"), F.max(F.coalesce("l", F.lit(False))).alias("live"), F.max("doc_id").alias("newest"))
    old = ~F.col("live") & (F.col("newest") < grace)
    return u.agg(F.count_if("live").alias("reachable"), F.count_if(~F.col("live")).alias("unreachable"), F.count_if(old).alias("old"), F.sum(F.when(old, F.col("n"))).alias("old_bytes"))


_NAMES = """SELECT doc_id, CASE doc_id % 14 WHEN 0 THEN source WHEN 1 THEN source || '/main' WHEN 2 THEN '/' || source WHEN 3 THEN source || '/' WHEN 4 THEN '-' || source WHEN 5 THEN source || '/.x' WHEN 6 THEN source || '..a'
 WHEN 7 THEN source || '.lock' WHEN 8 THEN source || ' x' WHEN 9 THEN 'a/b/c/d/' || source WHEN 10 THEN 'a/b/c/d/e/' || source WHEN 11 THEN '' WHEN 12 THEN source || '//x' ELSE source || '_1-2.z' END AS name FROM documents"""


@query("reference_names", f"""SELECT doc_id, regexp_matches(name, '^[A-Za-z0-9_./-]+$') AND len(string_split(name, '/')) <= 5 AND len(list_filter(string_split(name, '/'), lambda x: x = '' OR x[1] = '.')) = 0
 AND NOT contains(name, '..') AND NOT starts_with(name, '-') AND NOT ends_with(name, '.') AND NOT ends_with(name, '.lock') AS ok, name <> '' AND NOT contains(name, '/') AS session_ok FROM ({_NAMES})""")  # fmt: skip
def reference_names(spark, sf_dir):
    table(spark, sf_dir, "documents").createOrReplaceTempView("palimpsest_names")
    d = spark.sql(_NAMES.replace("FROM documents", "FROM palimpsest_names"))
    return d.select("doc_id", C.ref_name_holds(F.col("name")).alias("ok"), C.session_name_holds(F.col("name")).alias("session_ok"))


@query("erasure_coverage", f"""WITH d AS ({_BLOBS}), e AS (SELECT DISTINCT hash FROM d WHERE subject = 's3' AND hash NOT IN (SELECT hash FROM d WHERE subject <> 's3'))
SELECT doc_id, hash, hash IN (SELECT hash FROM e) AS erased FROM d""")  # fmt: skip
def erasure_coverage(spark, sf_dir):
    """Which documents' blobs an erasure covers, and so are left out of an index that is built again."""
    b = blobs(spark, sf_dir)
    gone = M.erasable(b.select("hash", "subject"), "s3").withColumn("e", F.lit(True))
    return b.join(gone, "hash", "left").select("doc_id", "hash", F.coalesce("e", F.lit(False)).alias("erased"))


@query("commit_log", f"WITH RECURSIVE {_COMMITS}, w(node, place) AS (SELECT {_TIP}, 0 UNION ALL SELECT dst, place + 1 FROM w JOIN edges ON src = node AND dst = src - 1) SELECT node::BIGINT AS commit, place::BIGINT AS place FROM w")
def commit_log(spark, sf_dir):
    """The first parents of the middle commit, newest first."""
    first = commit_edges(spark, sf_dir).where("dst = src - 1")
    at = tip(spark, sf_dir).first()[0]
    return M.reachable(first, tip(spark, sf_dir)).select(F.col("node").alias("commit"), (F.lit(at) - F.col("node")).alias("place"))


_REFLOG = "r AS (SELECT 'h/' || (o_custkey % 50) AS name, o_orderkey AS seq, o_orderpriority || o_custkey AS value FROM orders)"


def ref_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("h/"), (F.col("o_custkey") % 50).cast("string")).alias("name"), F.col("o_orderkey").alias("seq"), F.concat("o_orderpriority", F.col("o_custkey").cast("string")).alias("value"))


@query("refs_latest", f"WITH {_REFLOG} SELECT name, arg_max(value, seq) AS value, count(*) AS changes FROM r GROUP BY name")
def refs_latest(spark, sf_dir):
    return C.latest_refs(ref_log(spark, sf_dir))


@query("ref_log_conflicts", f"""WITH RECURSIVE {_REFLOG}, l AS (SELECT name, seq, value, CASE WHEN seq % 31 = 7 THEN 'stale' ELSE lag(value) OVER w END AS expected, row_number() OVER w AS k FROM r WINDOW w AS (PARTITION BY name ORDER BY seq)),
f(name, seq, k, now, ok) AS (SELECT name, seq, k, CASE WHEN expected IS NULL THEN value END, expected IS NULL FROM l WHERE k = 1
 UNION ALL SELECT l.name, l.seq, l.k, CASE WHEN l.expected IS NOT DISTINCT FROM f.now THEN l.value ELSE f.now END, l.expected IS NOT DISTINCT FROM f.now FROM f JOIN l ON l.name = f.name AND l.k = f.k + 1)
SELECT name, seq FROM f WHERE NOT ok""")  # fmt: skip
def ref_log_conflicts(spark, sf_dir):
    """Entries of a log that a replay leaves out, since they expected another value; one in 31 was stale when it was written."""
    from pyspark.sql import Window

    log = ref_log(spark, sf_dir).withColumn("expected", F.when(F.col("seq") % 31 == 7, "stale").otherwise(F.lag("value").over(Window.partitionBy("name").orderBy("seq"))))
    return C.ref_conflicts(log)


@query("chunk_introduced", f"""WITH d AS ({_BLOBS}) SELECT hash AS target, max(generation) AS generation, max(doc_id) AS manifest FROM d WHERE generation <= {_TIP} GROUP BY hash""")
def chunk_introduced(spark, sf_dir):
    """The newest document, at the middle commit, that has a content: where a proof begins."""
    refs = blobs(spark, sf_dir).select(F.col("hash").alias("target"), F.col("doc_id").alias("manifest"), "generation")
    return C.introduced(refs, tip(spark, sf_dir).first()[0] or 0)


@query("unindexed_suffix", f"WITH d AS ({_BLOBS}) SELECT doc_id, hash FROM d WHERE generation > {_TIP} AND hash NOT IN (SELECT hash FROM d WHERE generation <= {_TIP})")
def unindexed_suffix(spark, sf_dir):
    """What an index built at the middle commit lacks now."""
    b, at = blobs(spark, sf_dir), tip(spark, sf_dir).first()[0] or 0
    return b.where(F.col("generation") > at).join(b.where(F.col("generation") <= at).select("hash"), "hash", "left_anti").select("doc_id", "hash")


_LEVEL = "least((z*4 + CASE WHEN substr(d, z+1, 1) >= '8' THEN 0 WHEN substr(d, z+1, 1) >= '4' THEN 1 WHEN substr(d, z+1, 1) >= '2' THEN 2 ELSE 3 END)//5, 16)"
_ENTRIES = f"""{_OPS}, kv AS (SELECT key, arg_max(coalesce(value, ''), ordinal) AS value FROM ops GROUP BY key HAVING value <> ''),
z AS (SELECT key, value, sha256(key) AS d, length(regexp_extract(sha256(key), '^0*')) AS z FROM kv), n0 AS (SELECT key, sha256('blob:' || value) AS h, {_LEVEL} AS lvl FROM z)"""


def _nodes_sql(levels: int) -> str:
    """CTEs n1 to n<levels>: the nodes of each level; a single node stays as it is."""
    out = []
    for k in range(levels):
        out.append(f"""g{k} AS (SELECT key, h, lvl, count(*) OVER () AS total, coalesce(min(CASE WHEN lvl > {k} THEN key END) OVER (ORDER BY key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), '~') AS close FROM n{k}),
n{k + 1} AS (SELECT max(key) AS key, CASE WHEN max(total) = 1 AND {k} > 0 THEN max(h) ELSE sha256('node:{k}' || chr(10) || string_agg(lower(hex(encode(key))) || ':' || h || chr(10), '' ORDER BY key)) END AS h, max(CASE WHEN key = close OR close = '~' THEN lvl END) AS lvl0,
 arg_max(lvl, key) AS lvl FROM g{k} GROUP BY close)""")
    return ", ".join(out)


@query("state_root", f"WITH {_ENTRIES}, {_nodes_sql(6)} SELECT h AS root, (SELECT count(*) FROM n0) AS n FROM n6")
def state_root(spark, sf_dir):
    """The root of the tree over the state that all operations leave."""
    s = M.state_at(ops(spark, sf_dir)).select(F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"))
    return spark.createDataFrame([(statetree.root(s), s.count())], "root string, n long")


@query("state_leaves", f"WITH {_ENTRIES}, {_nodes_sql(1)} SELECT key AS last_key, h AS hash FROM n1")
def state_leaves(spark, sf_dir):
    return C.state_leaves(M.state_at(ops(spark, sf_dir)))


@query("state_value_refs", f"WITH {_OPS}, kv AS (SELECT key, arg_max(coalesce(value, ''), ordinal) AS value FROM ops GROUP BY key HAVING value <> '') SELECT key, CASE WHEN octet_length(encode(value)) <= 8 THEN value END AS inline, sha256('blob:' || value) AS value_hash FROM kv")
def state_value_refs(spark, sf_dir):
    """Values of up to eight bytes as they are, larger ones by digest alone."""
    return M.state_at(ops(spark, sf_dir)).select("key", F.when(F.octet_length("value") <= 8, F.col("value")).alias("inline"), digest("blob", "value").alias("value_hash"))


_POINTS = f"""p AS (SELECT tenant AS head, generation, count(*) AS n FROM ({_META}) GROUP BY ALL), q AS (SELECT head, row_number() OVER w - 1 AS sequence, sum(n) OVER w AS leaves FROM p WINDOW w AS (PARTITION BY head ORDER BY generation)),
t AS (SELECT head, sequence, leaves, sha256(head || '/' || sequence || '/' || leaves) AS hash FROM q), ch AS (SELECT *, lag(hash) OVER (PARTITION BY head ORDER BY sequence) AS prev FROM t)"""


@query("checkpoint_faults", f"""WITH {_POINTS}, f AS (SELECT head, CASE WHEN sequence % 17 = 5 THEN sequence + 100000 ELSE sequence END AS sequence, hash, CASE WHEN sequence % 23 = 3 THEN NULL ELSE prev END AS prev, CASE WHEN sequence % 29 = 4 THEN 1 ELSE leaves END AS leaves FROM ch WHERE sequence % 19 <> 7),
s AS (SELECT *, lag(hash) OVER w AS was, lag(leaves) OVER w AS had, row_number() OVER w - 1 AS place FROM f WINDOW w AS (PARTITION BY head ORDER BY sequence)),
r AS (SELECT head, sequence::BIGINT AS sequence, CASE WHEN (prev IS NULL) <> (sequence = 0) THEN 'genesis' WHEN sequence <> place THEN 'gap' WHEN prev IS DISTINCT FROM was THEN 'unlinked' WHEN leaves <= had THEN 'shrunk' END AS fault FROM s) SELECT * FROM r WHERE fault IS NOT NULL""")  # fmt: skip
def checkpoint_faults(spark, sf_dir):
    """Chains of checkpoints of which some were renumbered, taken out, cut from the one before, or shrunk."""
    from pyspark.sql import Window

    w = Window.partitionBy("head").orderBy("generation")
    p = documents(spark, sf_dir).groupBy(F.col("tenant").alias("head"), "generation").agg(F.count(F.lit(1)).alias("n"))
    q = p.select("head", (F.row_number().over(w) - 1).cast("long").alias("sequence"), F.sum("n").over(w).alias("leaves"))
    ch = q.withColumn("hash", F.sha2(F.concat_ws("/", "head", "sequence", "leaves"), 256)).withColumn("prev", F.lag("hash").over(Window.partitionBy("head").orderBy("sequence")))
    f = ch.where("sequence % 19 <> 7").selectExpr("head", "if(sequence % 17 = 5, sequence + 100000, sequence) sequence", "hash", "if(sequence % 23 = 3, null, prev) prev", "if(sequence % 29 = 4, 1, leaves) leaves")
    return M.checkpoint_faults(f)


_RECORDS = """a AS (SELECT event_id, event_type AS head, user_id AS principal, event_id AS executed_at, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS seq FROM events),
b AS (SELECT *, event_id || '|' || head || '|' || principal || '|' || seq AS body FROM a), m AS (SELECT *, sha256('manifest:' || body) AS manifest FROM b),
l AS (SELECT *, lag(manifest) OVER (PARTITION BY head ORDER BY seq) AS prev, 'c' || (event_id // 10) AS commit FROM m)"""


@query("audit_bundle_faults", f"""WITH {_RECORDS}, e AS (SELECT max(event_id) AS top FROM events),
r AS (SELECT manifest, head, commit, CASE WHEN event_id % 211 = 5 THEN seq - 1 ELSE seq END AS seq, CASE WHEN event_id % 223 = 6 THEN 'x' ELSE prev END AS prev, executed_at, CASE WHEN event_id % 227 = 7 THEN body || '?' ELSE body END AS body FROM l WHERE event_id % 199 <> 4),
o AS (SELECT manifest, CASE WHEN event_id % 229 = 8 THEN body || '!' ELSE body END AS body FROM l WHERE event_id % 233 <> 9), k AS (SELECT commit, manifest FROM l WHERE event_id % 239 <> 10),
s AS (SELECT *, lag(seq) OVER w AS last, lag(manifest) OVER w AS before FROM r WINDOW w AS (PARTITION BY head ORDER BY seq, manifest))
SELECT manifest, 'outside the period' AS fault FROM r, e WHERE executed_at NOT BETWEEN 0 AND top - 3
UNION ALL SELECT manifest, 'manifest missing' FROM r WHERE manifest NOT IN (SELECT manifest FROM o)
UNION ALL SELECT manifest, 'not what its hash says' FROM o WHERE sha256('manifest:' || body) <> manifest
UNION ALL SELECT manifest, 'record differs' FROM r JOIN o USING (manifest) WHERE r.body <> o.body
UNION ALL SELECT manifest, 'not carried by its commit' FROM r WHERE (commit, manifest) NOT IN (SELECT (commit, manifest) FROM k)
UNION ALL SELECT manifest, 'record withheld' FROM o WHERE manifest NOT IN (SELECT manifest FROM r)
UNION ALL SELECT manifest, CASE WHEN seq = last THEN 'repeated' WHEN seq <> last + 1 THEN 'gap' ELSE 'unlinked' END FROM s WHERE last IS NOT NULL AND (seq = last OR seq <> last + 1 OR prev <> before)""")  # fmt: skip
def audit_bundle_faults(spark, sf_dir):
    """A bundle of audit records, forged in eight ways, and what its rules find."""
    body = lambda *of: F.concat_ws("|", *of)
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("head"), F.col("user_id").alias("principal"))
    a = written(numbered(e, "head", ["event_id"], "seq", {"last_id": "event_id", "last_principal": "principal"}), "audit")  # read by every rule
    a = a.withColumn("executed_at", F.col("event_id")).withColumn("body", body("event_id", "head", "principal", "seq")).withColumn("manifest", digest("manifest", "body"))
    prev = F.when(F.col("seq") > 0, digest("manifest", body("last_id", "head", "last_principal", F.col("seq") - 1)))
    a = a.withColumns({"prev": prev, "commit": F.concat(F.lit("c"), F.expr("event_id div 10").cast("string"))})
    r = a.where("event_id % 199 <> 4").selectExpr("manifest", "head", "commit", "if(event_id % 211 = 5, seq - 1, seq) seq", "if(event_id % 223 = 6, 'x', prev) prev", "executed_at", "if(event_id % 227 = 7, concat(body, '?'), body) body")
    o = a.where("event_id % 233 <> 9").selectExpr("manifest", "if(event_id % 229 = 8, concat(body, '!'), body) body")
    top = a.agg(F.max("event_id")).first()[0] or 0
    return M.audit_faults(r, o, a.where("event_id % 239 <> 10").select("commit", "manifest"), 0, top - 3)


@query("policy_gate", """SELECT event_id, CASE WHEN user_id % 5 = 0 AND event_type IN ('click', 'purchase') THEN 'forbidden' WHEN user_id % 5 = 0 THEN 'recorded' WHEN event_type = 'view' AND value < 20 THEN 'forbidden' ELSE 'allowed' END AS verdict FROM events""")
def policy_gate(spark, sf_dir):
    """Writes and what the gate does with them: those that name nobody are forbidden on two heads and recorded on the others, and some need provenance."""
    nobody = F.col("user_id") % 5 == 0
    e = table(spark, sf_dir, "events").withColumn("selectors", F.array(F.lit("click"), F.lit("purchase*")))
    verdict = F.when(nobody & M.head_matches("event_type", "selectors"), "forbidden").when(nobody, "recorded").when((F.col("event_type") == "view") & (F.col("value") < 20), "forbidden").otherwise("allowed")
    return e.select("event_id", verdict.alias("verdict"))


@query("summary_hierarchy", "SELECT doc_id // 8 AS l1, doc_id // 64 AS l2, doc_id // 512 AS l3, count(*) AS n, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM documents GROUP BY ALL")
def summary_hierarchy(spark, sf_dir):
    """Summaries of eight documents, of eight such and of eight of those, joined level by level."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    level = lambda k: d.select(F.expr(f"doc_id div {8 ** (k - 1)}").alias("child"), F.expr(f"doc_id div {8**k}").alias(f"l{k}")).distinct()
    out = d.join(level(1), F.col("doc_id") == F.col("child")).drop("child").join(level(2), F.col("l1") == F.col("child")).drop("child").join(level(3), F.col("l2") == F.col("child"))
    return out.groupBy("l1", "l2", "l3").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"))


@query("run_spans", "SELECT a.conv_id, a.turn, a.role, b.role AS parent_role FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn - 1")
def run_spans(spark, sf_dir):
    """Each turn as a span under the one before it."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.struct("conv_id", "turn").alias("run"), F.struct("conv_id", (F.col("turn") - 1).alias("turn")).alias("parent"))
    return C.spans(c).select("conv_id", "turn", "role", "parent_role")


@query("session_content", "SELECT conv_id AS session, turn AS seq, sha256('blob:' || text) AS content, octet_length(encode(text)) AS n_bytes FROM conversations WHERE text IS NOT NULL")
def session_content(spark, sf_dir):
    """Turns joined to the blobs that they refer to."""
    c = table(spark, sf_dir, "conversations").where("text is not null")
    stored = c.select(digest("blob", "text").alias("content"), F.octet_length("text").cast("long").alias("n_bytes")).dropDuplicates(["content"])
    return c.select(F.col("conv_id").alias("session"), F.col("turn").alias("seq"), digest("blob", "text").alias("content")).join(stored, "content")


@query("session_ordered", "SELECT conv_id AS session, string_agg(role, ',' ORDER BY turn) AS roles, count(*) AS n FROM conversations GROUP BY conv_id")
def session_ordered(spark, sf_dir):
    """The turns of each session, oldest first."""
    t = turns(spark, sf_dir).groupBy("session").agg(F.sort_array(F.collect_list(F.struct("seq", "role"))).alias("ts"))
    return t.select("session", F.array_join(F.transform("ts", lambda x: x["role"]), ",").alias("roles"), F.size("ts").cast("long").alias("n"))


@query("embedding_parse", "SELECT vec_id, len(embedding)::INT AS dim, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 3) + 0 AS total FROM embeddings")
def embedding_parse(spark, sf_dir):
    """Vectors written as JSON and read again."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.to_json("embedding").alias("written"))
    v = e.select("vec_id", F.from_json("written", "array<float>").alias("v"))
    return v.select("vec_id", F.size("v").alias("dim"), (F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double")), 3) + F.lit(0.0)).alias("total"))


@query("event_tail", "SELECT event_type AS kind, max(event_id) AS seq, arg_max(user_id, event_id) AS user_id FROM events GROUP BY event_type")
def event_tail(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("kind")).agg(F.max("event_id").alias("seq"), F.max_by("user_id", "event_id").alias("user_id"))


@query("provenance_faults", "SELECT CASE WHEN event_id % 41 = 0 THEN '' ELSE 'c' || event_id END AS claim_id, CASE WHEN event_id % 41 = 0 THEN 'no id' WHEN NOT coalesce(value/50 BETWEEN 0 AND 1, false) THEN 'confidence' ELSE 'no evidence' END AS fault FROM events WHERE event_id % 41 = 0 OR NOT coalesce(value/50 BETWEEN 0 AND 1, false) OR event_id % 37 = 0")
def provenance_faults(spark, sf_dir):
    """Claims without an id, with a confidence beyond 0 to 1, or without evidence."""
    e = table(spark, sf_dir, "events")
    c = e.select(F.when(F.col("event_id") % 41 == 0, "").otherwise(F.concat(F.lit("c"), F.col("event_id").cast("string"))).alias("claim_id"), (F.col("value") / 50).alias("confidence"), F.when(F.col("event_id") % 37 == 0, F.array().cast("array<string>")).otherwise(F.array("props")).alias("evidence"))
    return C.claim_faults(c)


_CODED = f"""{_VECTORS_SQL}, u AS (SELECT vec_id, [x/sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) for x in embedding::DOUBLE[]] AS v FROM embeddings WHERE len(embedding) = 64),
us AS (SELECT vec_id, v, list_max([abs(x) for x in v])/127 AS s FROM u), uc AS (SELECT vec_id, v, s, [(sign(x)*floor(abs(x)/s + 0.5)) for x in v] AS c FROM us),
qs AS (SELECT query_id, qv, list_max([abs(x) for x in qv])/127 AS s FROM q), qc AS (SELECT query_id, qv, s, [(sign(x)*floor(abs(x)/s + 0.5)) for x in qv] AS c FROM qs),
co AS (SELECT query_id, vec_id AS doc_id, round(list_dot_product(qc.c, uc.c) * (qc.s * uc.s), 6) AS score FROM qc, uc),
ne AS (SELECT query_id, doc_id FROM ({_top('co', 40)})),
fi AS (SELECT query_id, doc_id, round(list_dot_product(embedding::DOUBLE[], qv)/sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS score FROM ne JOIN q USING (query_id) JOIN embeddings ON vec_id = doc_id)"""


@query("sq8_two_stage_top10", f"WITH {_CODED} {_top('fi', 10)}")
def sq8_two_stage_top10(spark, sf_dir):
    """Forty candidates by signed bytes, ranked again by the vectors themselves."""
    return C.two_stage(table(spark, sf_dir, "embeddings"), VECTORS, 10)


@query("ann_cells_top10")
def ann_cells_top10(spark, sf_dir):
    """Approximate search in cells; its recall against the exact one is tested."""
    return C.Cells(table(spark, sf_dir, "embeddings"), DIM).search(VECTORS, 10)


@query("hash_parse", "SELECT doc_id, sha256('blob:' || text) AS hash, length(sha256('blob:' || text)) = 64 AS ok, ('0x' || substr(sha256('blob:' || text), 1, 8))::BIGINT AS front FROM documents WHERE text IS NOT NULL")
def hash_parse(spark, sf_dir):
    b = blobs(spark, sf_dir)
    return b.select("doc_id", F.lower(F.hex(F.unhex("hash"))).alias("hash"), F.rlike("hash", F.lit("^[0-9a-f]{64}$")).alias("ok"), F.conv(F.substring("hash", 1, 8), 16, 10).cast("long").alias("front"))


@query("visible_by_tenant", f"SELECT tenant, count(*) AS n FROM ({_META}) WHERE len(acl) = 0 OR list_has_any(acl, ['group:' || 'hr']) GROUP BY tenant")
def visible_by_tenant(spark, sf_dir):
    """What the callers of each tenant see who have the tag of one group."""
    return R.visible(documents(spark, sf_dir), tags=("group:hr",)).groupBy("tenant").agg(F.count(F.lit(1)).alias("n"))
