"""Queries on state, sessions, events, audit, history, erasure and policy, over stand-ins among the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import memory as M
from palimpsest.plans import merkle
from palimpsest.plans.sequences import numbered
from palimpsest.queries.catalogue import query
from palimpsest.queries.retrieval import _META, documents, table

NOW, RETENTION = 3000, 400
_OPS = "ops AS (SELECT 'c/' || o_custkey AS key, o_orderkey AS ordinal, CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority END AS value FROM orders)"
_TURNS = "turns AS (SELECT conv_id AS session, turn AS seq, role, conv_id*10+turn AS created_at, CASE WHEN turn%3=0 THEN conv_id*10+turn+500 END AS expires_at FROM conversations)"
_AUDIT = "audit AS (SELECT event_id, event_type AS head, user_id AS principal, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS seq FROM events)"
_HEADS = f"heads AS (SELECT tenant AS head, count(*) AS n, max(generation) AS newest FROM ({_META}) GROUP BY tenant)"
POLICIES = [
    ("chain", "require-tamper-evident-chain", None, ["src1*"], "enforce", True), ("signed", "require-signed-checkpoints", None, [], "monitor", True), ("sealed", "require-encryption-at-rest", None, ["no such head"], "enforce", True),
    ("kept", "retention-floor", 500, [], "enforce", True), ("kept a little", "retention-floor", 300, [], "monitor", True), ("who", "require-principal", None, ["src3", "src5", "src1*"], "enforce", True),
    ("tips", "require-signed-commits", None, ["*"], "monitor", True), ("origin", "require-provenance", None, ["src2"], "enforce", True), ("off", "require-principal", None, [], "enforce", False), ("blank", "require-principal", None, ["src1 *"], "enforce", True),
]


def ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.concat(F.lit("c/"), F.col("o_custkey").cast("string")).alias("key"), F.col("o_orderkey").alias("ordinal"), F.when(F.col("o_orderstatus") != "F", F.col("o_orderpriority")).alias("value"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    at = F.col("conv_id") * 10 + F.col("turn")
    return c.select(F.col("conv_id").alias("session"), F.col("turn").alias("seq"), "role", at.alias("created_at"), F.when(F.col("turn") % 3 == 0, at + 500).alias("expires_at"))


def heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).groupBy(F.col("tenant").alias("head")).agg(F.count(F.lit(1)).alias("n"), F.max("generation").alias("newest"))


_MIDDLE = "(SELECT max(o_orderkey)//2 FROM orders)"


def middle(spark: SparkSession, sf_dir: str) -> int:
    """The ordinal of the operation in the middle."""
    return (table(spark, sf_dir, "orders").agg(F.max("o_orderkey")).first()[0] or 0) // 2


@query("state_at_version", f"WITH {_OPS} SELECT key, max(ordinal) AS ordinal, arg_max(coalesce(value, ''), ordinal) AS value FROM ops WHERE ordinal <= {_MIDDLE} GROUP BY key HAVING value <> ''")
def state_at_version(spark, sf_dir):
    """The state after half of all operations."""
    return M.state_at(ops(spark, sf_dir), middle(spark, sf_dir))


@query("state_prefix_scan", f"WITH {_OPS} SELECT key, arg_max(coalesce(value, ''), ordinal) AS value FROM ops WHERE starts_with(key, 'c/1') GROUP BY key HAVING value <> ''")
def state_prefix_scan(spark, sf_dir):
    return M.prefix_scan(M.state_at(ops(spark, sf_dir)), "c/1").select("key", "value")


@query("state_batch_apply", f"WITH {_OPS} SELECT key, arg_max(coalesce(value, ''), ordinal) AS value FROM ops GROUP BY key HAVING value <> ''")
def state_batch_apply(spark, sf_dir):
    o, half = ops(spark, sf_dir), middle(spark, sf_dir)
    return M.write_many(M.state_at(o, half).select("key", "value"), o.where(F.col("ordinal") > half))


@query("state_leaf_boundaries", f"""WITH {_OPS}, h AS (SELECT DISTINCT key, sha256(key) AS h FROM ops), z AS (SELECT key, h, length(regexp_extract(h, '^0*')) AS z FROM h)
SELECT key, least((z*4 + CASE WHEN substr(h, z+1, 1) >= '8' THEN 0 WHEN substr(h, z+1, 1) >= '4' THEN 1 WHEN substr(h, z+1, 1) >= '2' THEN 2 ELSE 3 END)//5, 16)::INT AS level FROM z""")  # fmt: skip
def state_leaf_boundaries(spark, sf_dir):
    return M.boundaries(ops(spark, sf_dir).select("key").distinct())


@query("session_list", f"WITH {_TURNS} SELECT * FROM turns WHERE expires_at IS NULL OR expires_at > {NOW}")
def session_list(spark, sf_dir):
    return M.live_turns(turns(spark, sf_dir), NOW)


@query("session_gc", f"WITH {_TURNS} SELECT * FROM turns WHERE NOT (expires_at IS NOT NULL AND expires_at <= {NOW} AND created_at + {RETENTION} <= {NOW})")
def session_gc(spark, sf_dir):
    return M.collected_turns(turns(spark, sf_dir), NOW, RETENTION)


@query("session_next_seq", f"WITH {_TURNS} SELECT session, max(seq)+1 AS next_seq FROM turns GROUP BY session")
def session_next_seq(spark, sf_dir):
    return M.next_seq(turns(spark, sf_dir))


@query("event_cursor", "SELECT event_id, user_id, event_type FROM events WHERE event_id > (SELECT max(event_id)//3 FROM events)")
def event_cursor(spark, sf_dir):
    """What came after a reader that has read a third."""
    e = table(spark, sf_dir, "events")
    at = (e.agg(F.max("event_id")).first()[0] or 0) // 3
    return e.where(F.col("event_id") > at).select("event_id", "user_id", "event_type")


@query("event_kind_counts", "SELECT event_type, count(*) AS n, min(event_id) AS first_seq, max(event_id) AS last_seq FROM events GROUP BY event_type")
def event_kind_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_seq"), F.max("event_id").alias("last_seq"))


_CHAIN = """e AS (SELECT user_id, event_id, event_type, props, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k FROM events),
c(log, seq, kind, "at", data, prev, hash) AS (SELECT user_id, k, event_type, event_id, props, '', sha256('|' || k || '|' || event_id || '|' || sha256(event_type) || '|' || coalesce(props, '')) FROM e WHERE k = 0
 UNION ALL SELECT log, e.k, event_type, event_id, props, hash, sha256(hash || '|' || e.k || '|' || event_id || '|' || sha256(event_type) || '|' || coalesce(props, '')) FROM c JOIN e ON e.user_id = c.log AND e.k = c.seq + 1)"""


def chained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain of each user's events."""
    return M.chain(table(spark, sf_dir, "events").select(F.col("user_id").alias("log"), F.col("event_id").alias("order"), F.col("event_type").alias("kind"), F.col("event_id").alias("at"), F.col("props").alias("data")))


@query("event_chain", f"WITH RECURSIVE {_CHAIN} SELECT log, seq::BIGINT AS seq, prev, hash FROM c")
def event_chain(spark, sf_dir):
    return chained(spark, sf_dir).select("log", "seq", "prev", "hash")


#: Three ways to forge a chain: data changed, rows taken out, the rows after one renumbered.
_FORGED = "CASE WHEN \"at\" % 97 = 0 THEN data || '!' ELSE data END AS data"


@query("event_chain_verify", f"""WITH RECURSIVE {_CHAIN}, f AS (SELECT log, CASE WHEN "at" % 89 = 0 THEN seq + 1000 ELSE seq END AS seq, kind, "at", {_FORGED}, prev, hash FROM c WHERE "at" % 101 <> 0),
s AS (SELECT *, coalesce(lag(hash) OVER w, '') AS was, row_number() OVER w - 1 AS place FROM f WINDOW w AS (PARTITION BY log ORDER BY seq)),
r AS (SELECT log, seq::BIGINT AS seq, CASE WHEN sha256(prev || '|' || seq || '|' || "at" || '|' || sha256(kind) || '|' || coalesce(data, '')) <> hash THEN 'rewritten' WHEN prev <> was THEN 'unlinked' WHEN seq <> place THEN 'misplaced' END AS fault FROM s)
SELECT * FROM r WHERE fault IS NOT NULL""")  # fmt: skip
def event_chain_verify(spark, sf_dir):
    """Data changed, rows taken out and rows renumbered, which the check finds from the hashes."""
    f = chained(spark, sf_dir).where("at % 101 <> 0").withColumns({"seq": F.expr("if(at % 89 = 0, seq + 1000, seq)"), "data": F.expr("if(at % 97 = 0, concat(data, '!'), data)")})
    return M.chain_faults(f)


@query("audit_collect", f"WITH {_AUDIT} SELECT head, seq, event_id, principal FROM audit WHERE event_id BETWEEN (SELECT max(event_id)//4 FROM events) AND (SELECT max(event_id)//4*3 FROM events)")
def audit_collect(spark, sf_dir):
    """The middle half of the period."""
    part = (table(spark, sf_dir, "events").agg(F.max("event_id")).first()[0] or 0) // 4
    return _audit(spark, sf_dir).where(F.col("event_id").between(part, 3 * part)).select("head", "seq", "event_id", "principal")


def _audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("head"), F.col("user_id").alias("principal"), "value")
    return numbered(e, "head", ["event_id"], "place").select("event_id", "head", "principal", "value", (F.col("place") + 1).alias("seq"))


@query("audit_gap_check", f"""WITH {_AUDIT}, kept AS (SELECT head, seq FROM audit WHERE value < 60),
g AS (SELECT head AS log, seq, seq - lag(seq) OVER (PARTITION BY head ORDER BY seq) - 1 AS missing FROM kept) SELECT * FROM g WHERE missing <> 0""")  # fmt: skip
def audit_gap_check(spark, sf_dir):
    """Records of a value of 60 or more are withheld, which leaves gaps."""
    return M.gaps(_audit(spark, sf_dir).where("value < 60"), "head", "seq")


@query("audit_summary_by_principal", f"WITH {_AUDIT} SELECT head, principal, count(*) AS n, max(event_id) AS last FROM audit GROUP BY ALL")
def audit_summary_by_principal(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("head"), F.col("user_id").alias("principal")).agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last"))


@query("compliance_summary", f"WITH {_AUDIT} SELECT head, count(*) AS retrievals, count(DISTINCT principal) AS principals, max(event_id) AS last FROM audit GROUP BY head")
def compliance_summary(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("head")).agg(F.count(F.lit(1)).alias("retrievals"), F.countDistinct("user_id").alias("principals"), F.max("event_id").alias("last"))


def commit_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): a commit and its parents; every fifth merges the one three before."""
    g = documents(spark, sf_dir).select("generation").distinct()
    first = g.where("generation > 0").select(F.col("generation").alias("src"), (F.col("generation") - 1).alias("dst"))
    return first.union(g.where("generation % 5 = 0 and generation >= 3").select("generation", F.col("generation") - 3))


_COMMITS = f"""g AS (SELECT DISTINCT generation FROM ({_META})), edges AS (SELECT generation AS src, generation-1 AS dst FROM g WHERE generation > 0
 UNION ALL SELECT generation, generation-3 FROM g WHERE generation%5=0 AND generation>=3)"""


@query("commit_edges", f"WITH {_COMMITS} SELECT * FROM edges")
def commit_edges_query(spark, sf_dir):
    return commit_edges(spark, sf_dir)


#: The commit from which history is followed: the one in the middle.
_TIP = f"(SELECT max(generation)//2 FROM ({_META}))"


def tip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).agg(F.expr("max(generation) div 2").alias("node"))


@query("ancestry", f"WITH RECURSIVE {_COMMITS}, w(node) AS (SELECT {_TIP} UNION SELECT dst FROM w JOIN edges ON src = node) SELECT node::BIGINT AS node FROM w")
def ancestry(spark, sf_dir):
    return M.reachable(commit_edges(spark, sf_dir), tip(spark, sf_dir))


#: Refs of two copies of a history: every source's head, the remote's moved on, back, or to a side branch (numbers above a million).
_REFS = f"""t AS (SELECT tenant AS name, max(generation) AS newest, hash AS h FROM (SELECT *, length(tenant) % 4 AS hash FROM ({_META})) GROUP BY ALL),
b AS (SELECT src, dst FROM edges UNION ALL SELECT 1000000 + generation, generation - 1 FROM g WHERE generation > 0),
l AS (SELECT name, newest - 2 AS node FROM t WHERE newest >= 2 AND name <> 'src2'),
r AS (SELECT name, CASE WHEN name < 'src13' THEN newest WHEN name < 'src16' THEN newest - 4 WHEN name < 'src4' THEN 1000000 + newest - 2 ELSE newest - 2 END AS node FROM t WHERE newest >= 4 AND name <> 'src5')"""


@query("fast_forward_check", f"""WITH RECURSIVE {_COMMITS}, {_REFS}, h AS (SELECT l.node AS n FROM l JOIN r USING (name) UNION SELECT r.node FROM l JOIN r USING (name)),
a(head, node) AS (SELECT n, n FROM h UNION SELECT head, dst FROM a JOIN b ON src = node)
SELECT name, l.node AS local, r.node AS remote, CASE WHEN r.node IS NULL THEN 'local' WHEN l.node IS NULL THEN 'new' WHEN l.node = r.node THEN 'same'
 WHEN EXISTS (SELECT 1 FROM a WHERE a.head = r.node AND a.node = l.node) THEN 'forward' WHEN EXISTS (SELECT 1 FROM a WHERE a.head = l.node AND a.node = r.node) THEN 'behind' ELSE 'diverged' END AS verdict
FROM l FULL JOIN r USING (name)""")  # fmt: skip
def fast_forward_check(spark, sf_dir):
    """Which refs of a local history could be moved to a remote's, by ancestry over all parents."""
    edges = commit_edges(spark, sf_dir)
    g = documents(spark, sf_dir).select("generation").distinct().where("generation > 0")
    edges = edges.union(g.select(F.col("generation") + 1_000_000, F.col("generation") - 1))
    t = heads(spark, sf_dir).select(F.col("head").alias("name"), "newest")
    local = t.where("newest >= 2 and name <> 'src2'").selectExpr("name", "newest - 2 as node")
    remote = t.where("newest >= 4 and name <> 'src5'").selectExpr("name", "case when name < 'src13' then newest when name < 'src16' then newest - 4 when name < 'src4' then 1000000 + newest - 2 else newest - 2 end as node")
    return M.fast_forward(edges, local, remote)


@query("gc_unreachable", f"""WITH RECURSIVE {_COMMITS}, w(node) AS (SELECT {_TIP} UNION SELECT dst FROM w JOIN edges ON src = node),
d AS (SELECT sha256('blob:' || text) AS hash, generation, octet_length(encode(text)) AS n_bytes FROM ({_META}) WHERE text IS NOT NULL)
SELECT hash, min(n_bytes) AS n_bytes FROM d WHERE hash NOT IN (SELECT hash FROM d JOIN w ON generation = node) GROUP BY hash""")  # fmt: skip
def gc_unreachable(spark, sf_dir):
    """Blobs to which neither the middle commit nor any it descends from refers."""
    d = documents(spark, sf_dir).where("text is not null").select("generation", M.blob_hash("text").alias("hash"), F.octet_length("text").cast("long").alias("n"))
    commits = M.reachable(commit_edges(spark, sf_dir), tip(spark, sf_dir))
    live = d.join(commits, F.col("generation") == F.col("node")).select("hash")
    return d.groupBy("hash").agg(F.min("n").alias("n_bytes")).join(live, "hash", "left_anti")


@query("erasure_plan", f"WITH d AS (SELECT sha256('blob:' || text) AS hash, subject FROM ({_META}) WHERE text IS NOT NULL) SELECT DISTINCT hash FROM d WHERE subject = 's3' AND hash NOT IN (SELECT hash FROM d WHERE subject <> 's3')")
def erasure_plan(spark, sf_dir):
    d = documents(spark, sf_dir).where("text is not null").select(M.blob_hash("text").alias("hash"), "subject")
    return M.erasable(d, "s3")


@query("checkpoint_chain", f"""WITH c AS (SELECT tenant AS head, generation, count(*) AS n FROM ({_META}) GROUP BY ALL)
SELECT head, generation, row_number() OVER w - 1 AS sequence, lag(generation) OVER w AS prev, sum(n) OVER w::BIGINT AS leaves FROM c WINDOW w AS (PARTITION BY head ORDER BY generation)""")  # fmt: skip
def checkpoint_chain(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("head").orderBy("generation")
    c = documents(spark, sf_dir).groupBy(F.col("tenant").alias("head"), "generation").agg(F.count(F.lit(1)).alias("n"))
    return c.select("head", "generation", (F.row_number().over(w) - 1).cast("long").alias("sequence"), F.lag("generation").over(w).alias("prev"), F.sum("n").over(w).alias("leaves"))


def _facts_sql() -> str:
    """What is known of each head: its checkpoints, its retrievals, its tip."""
    return f"""heads AS (SELECT tenant AS head, count(*) FILTER (generation % 3 = 0) AS chain_length, count(*) FILTER (generation % 3 = 0 AND (doc_id % 2 = 0 OR length(tenant) = 4)) AS chain_signed,
 min(doc_id) % 5 <> 0 AS chain_ok, count(*) AS retrievals, count(*) FILTER (subject = 's1') AS unnamed, max(generation) AS tip, max(generation) % 2 = 0 AS tip_signed FROM ({_META}) GROUP BY tenant)"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, third = documents(spark, sf_dir), F.col("generation") % 3 == 0
    return d.groupBy(F.col("tenant").alias("head")).agg(
        F.count_if(third).alias("chain_length"), F.count_if(third & ((F.col("doc_id") % 2 == 0) | (F.length("tenant") == 4))).alias("chain_signed"), (F.min("doc_id") % 5 != 0).alias("chain_ok"),
        F.count(F.lit(1)).alias("retrievals"), F.count_if(F.col("subject") == "s1").alias("unnamed"), F.max("generation").alias("tip"), (F.max("generation") % 2 == 0).alias("tip_signed"),
    )


def _policy_sql(select: str) -> str:
    rows = ", ".join(f"({i!r}, {r!r}, {'NULL' if n is None else n}, {h}::VARCHAR[], {m!r}, {str(e).lower()})" for i, r, n, h, m, e in POLICIES)
    return f"""WITH {_facts_sql()}, p AS (SELECT * FROM (VALUES {rows}) t(id, rule, min_secs, selectors, mode, enabled) WHERE enabled),
m AS (SELECT p.*, heads.* FROM p, heads WHERE rule NOT IN ('require-encryption-at-rest', 'retention-floor')
 AND (len(selectors) = 0 OR len(list_filter(selectors, lambda x: CASE WHEN x LIKE '%*' THEN starts_with(head, x[:-2]) ELSE x = head END)) > 0)),
e AS (SELECT id AS policy, rule, '(database)' AS head, mode, CASE WHEN (rule = 'require-encryption-at-rest') OR (rule = 'retention-floor' AND {RETENTION} >= min_secs) THEN 'pass' ELSE 'fail' END AS status FROM p WHERE rule IN ('require-encryption-at-rest', 'retention-floor')
 UNION ALL SELECT id, rule, head, mode, CASE rule WHEN 'require-tamper-evident-chain' THEN CASE WHEN chain_ok AND chain_length > 0 THEN 'pass' ELSE 'fail' END
  WHEN 'require-signed-checkpoints' THEN CASE WHEN chain_ok AND chain_length > 0 AND chain_signed = chain_length THEN 'pass' ELSE 'fail' END
  WHEN 'require-principal' THEN CASE WHEN unnamed = 0 THEN 'pass' ELSE 'fail' END
  WHEN 'require-signed-commits' THEN CASE WHEN tip_signed THEN 'pass' ELSE 'fail' END ELSE 'pass' END FROM m) {select}"""


def _policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.createDataFrame(POLICIES, "id string, rule string, min_secs long, heads array<string>, mode string, enabled boolean")
    return M.policy_status(p, facts(spark, sf_dir), encrypted=True, retention=RETENTION)


@query("policy_eval", _policy_sql("SELECT policy, status, count(*) AS n FROM e GROUP BY ALL"))
def policy_eval(spark, sf_dir):
    """Each of the seven rules on the heads that it is for."""
    return _policies(spark, sf_dir).groupBy("policy", "status").agg(F.count(F.lit(1)).alias("n"))


@query("policy_violations", _policy_sql("SELECT * FROM e WHERE status <> 'pass'"))
def policy_violations(spark, sf_dir):
    return _policies(spark, sf_dir).where("status <> 'pass'")


@query("manifest_edges", f"SELECT doc_id AS manifest, sha256('blob:' || text) AS blob, tenant AS head FROM ({_META}) WHERE text IS NOT NULL")
def manifest_edges(spark, sf_dir):
    return documents(spark, sf_dir).where("text is not null").select(F.col("doc_id").alias("manifest"), M.blob_hash("text").alias("blob"), F.col("tenant").alias("head"))


def levels_sql(of: str, levels: int, by: str = "", pair: str = "'\\x01'::BLOB") -> str:
    """CTEs m0 to m<levels> over (idx, h), h hexadecimal: pairs hashed, a lone last node taken along."""
    cols = f"{by}, " if by else ""
    out = [f"m0 AS (SELECT {cols}idx, h FROM {of})"]
    for k in range(levels):
        out.append(f"m{k + 1} AS (SELECT {cols}idx // 2 AS idx, CASE WHEN count(*) = 1 THEN min(h) ELSE sha256({pair} || unhex(arg_min(h, idx)) || unhex(arg_max(h, idx))) END AS h FROM m{k} GROUP BY {cols}idx // 2)")
    return ", ".join(out)


def seal_sql(n: str, h: str) -> str:
    """The seal of a tree of n leaves."""
    return f"sha256('\\x02'::BLOB || unhex(array_to_string([printf('%02x', ({n} >> (8*i)) & 255) for i in range(8)], '')) || unhex({h}))"


@query("merkle_root", f"""WITH d AS (SELECT printf('%020d/%010d', l_orderkey, l_linenumber) AS data FROM lineitem), i AS (SELECT row_number() OVER (ORDER BY data) - 1 AS idx, sha256('\\x00'::BLOB || encode(data)) AS h FROM d),
{levels_sql('i', 26)} SELECT {seal_sql('n', 'h')} AS root, n FROM m26, (SELECT count(*) AS n FROM d)""")
def merkle_root(spark, sf_dir):
    """Sealed root over all order lines, in order of (order, line)."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    data = F.concat(F.lpad(F.col("l_orderkey").cast("string"), 20, "0"), F.lit("/"), F.lpad(F.col("l_linenumber").cast("string"), 10, "0"))
    return merkle.root(rows, ["l_orderkey", "l_linenumber"], data)


@query("provenance_by_tag", "SELECT user_id, event_id, json_extract(props, '$.k')::BIGINT AS k FROM events WHERE json_extract(props, '$.k')::BIGINT >= 50")
def provenance_by_tag(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return e.where("k >= 50")
