"""Retrieval queries over documents, embeddings and benchmark texts."""

from __future__ import annotations

import math
import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.text import digest, preview, tokens
from palimpsest.operators import retrieval as R
from palimpsest.queries.catalogue import query
from palimpsest.storage import written

DIM, QUERY_VECTORS = 64, 40
_META = """SELECT doc_id, text, source AS tenant, lang AS language, (['note','report','mail'])[doc_id%3+1] AS doc_type,
 CASE WHEN doc_id%10=0 THEN ['group:hr'] ELSE []::VARCHAR[] END AS acl, doc_id*10 AS valid_from,
 CASE WHEN doc_id%4=0 THEN doc_id*10+5000 END AS valid_to, CASE WHEN doc_id%7=0 THEN 8000 END AS expires_at,
 's'||(doc_id%20) AS subject, doc_id//25 AS generation FROM documents"""
_TOKENS = f"[x for x in regexp_split_to_array(translate(coalesce(text,''),'{string.ascii_uppercase}','{string.ascii_lowercase}'), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+') if x <> '']"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with tenant, access tags, validity and generation, all derived from the id."""
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    return d.select(
        "doc_id", "text", F.col("source").alias("tenant"), F.col("lang").alias("language"),
        F.element_at(F.array(*map(F.lit, ("note", "report", "mail"))), (i % 3 + 1).cast("int")).alias("doc_type"),
        F.when(i % 10 == 0, F.array(F.lit("group:hr"))).otherwise(F.array().cast("array<string>")).alias("acl"),
        (i * 10).alias("valid_from"), F.when(i % 4 == 0, i * 10 + 5000).alias("valid_to"), F.when(i % 7 == 0, F.lit(8000).cast("long")).alias("expires_at"),
        F.concat(F.lit("s"), (i % 20).cast("string")).alias("subject"), F.expr("doc_id div 25").alias("generation"),
    )


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def query_vector(i: int, dim: int = DIM) -> list[float]:
    """A deterministic unit vector."""
    v = []
    for j in range(dim):
        x = ((i * dim + j) * 0x9E3779B97F4A7C15) % (1 << 64)
        x = ((x << 31) | (x >> 33)) % (1 << 64)
        v.append((x % 2000) / 1000 - 1)
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v]


VECTORS = {i: query_vector(i) for i in range(QUERY_VECTORS)}
_VECTORS_SQL = "q AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {[float(x) for x in v]}::DOUBLE[])" for i, v in VECTORS.items()) + ") t(query_id, qv))"


def _bm25_sql(where: str = "true") -> str:
    return f"""d AS (SELECT * FROM ({_META}) WHERE {where}), tok AS (SELECT doc_id, unnest({_TOKENS}) AS term FROM d),
 dl AS (SELECT doc_id, len({_TOKENS}) AS dl FROM d), c AS (SELECT count(*) AS n, greatest(avg(dl), 1.0) AS avgdl FROM dl),
 p AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM p GROUP BY ALL),
 qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({_TOKENS}) AS term FROM benchmark) GROUP BY ALL),
 s AS (SELECT query_id, doc_id, round(sum(qtf*ln((n-df+0.5)/(df+0.5)+1)*tf*2.5/(tf+1.5*(1-0.75+0.75*dl/avgdl))), 6) AS score
  FROM qt JOIN f USING (term) JOIN p USING (term) JOIN dl USING (doc_id), c GROUP BY ALL)"""


def _top(of: str, k: int) -> str:
    return f"SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM {of} QUALIFY rank <= {k}"


_VSCORES = "v AS (SELECT query_id, vec_id AS doc_id, round(list_dot_product(embedding::DOUBLE[], qv)/sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS score FROM embeddings, q WHERE len(embedding) = 64)"


@query("chunk_documents", """WITH b AS (SELECT doc_id, encode(text) AS raw, octet_length(encode(text)) AS n FROM documents WHERE length(text) > 0),
c AS (SELECT *, unnest(range(0, greatest(0, ceil((n-2048)/1792.0))::BIGINT + 1)) AS ordinal FROM b)
SELECT doc_id, ordinal::INT AS ordinal, (ordinal*1792)::INT AS start, least(ordinal*1792+2048, n)::INT AS "end",
 sha256(encode('blob:') || array_slice(raw, ordinal*1792+1, ordinal*1792+2048)) AS chunk_hash FROM c""")  # fmt: skip
def chunk_documents(spark, sf_dir):
    return R.chunks(table(spark, sf_dir, "documents"))


@query("blob_dedup", "SELECT sha256('blob:' || text) AS hash, count(*) AS refs, min(doc_id) AS first_doc, octet_length(encode(min(text))) AS n_bytes FROM documents GROUP BY 1")
def blob_dedup(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", digest("blob", "text").alias("hash"), F.octet_length("text").cast("long").alias("n"))
    return d.groupBy("hash").agg(F.count(F.lit(1)).alias("refs"), F.min("doc_id").alias("first_doc"), F.min("n").alias("n_bytes"))


@query("token_postings", f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents) GROUP BY ALL")
def token_postings(spark, sf_dir):
    return R.postings(table(spark, sf_dir, "documents"))


@query("corpus_stats", f"SELECT tenant, count(*) AS n, round(avg(len({_TOKENS})), 6) AS avgdl FROM ({_META}) WHERE len(acl)=0 GROUP BY tenant")
def corpus_stats(spark, sf_dir):
    d = R.visible(documents(spark, sf_dir))
    return d.groupBy("tenant").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.size(tokens("text"))), 6).alias("avgdl"))


@query("document_frequencies", f"SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents) GROUP BY term")
def document_frequencies(spark, sf_dir):
    return R.postings(table(spark, sf_dir, "documents")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


@query("bm25_scores", f"WITH {_bm25_sql()} SELECT * FROM s")
def bm25_scores(spark, sf_dir):
    return R.bm25(documents(spark, sf_dir), texts(spark, sf_dir))


@query("bm25_top10", f"WITH {_bm25_sql('len(acl)=0')} {_top('s', 10)}")
def bm25_top10(spark, sf_dir):
    return R.ranked(R.bm25(R.visible(documents(spark, sf_dir)), texts(spark, sf_dir), 10), 10)


@query("bm25_tenant_isolated", f"""WITH {_bm25_sql("len(acl)=0 AND tenant='src3'")} SELECT * FROM s""")
def bm25_tenant_isolated(spark, sf_dir):
    return R.bm25(R.visible(documents(spark, sf_dir), tenant="src3"), texts(spark, sf_dir))


@query("time_travel_search", f"WITH {_bm25_sql('len(acl)=0 AND generation <= (SELECT max(doc_id)//25 - 2 FROM documents)')} {_top('s', 10)}")
def time_travel_search(spark, sf_dir):
    """As of two generations before the newest."""
    d = documents(spark, sf_dir)
    newest = d.agg(F.max("generation")).first()[0] or 0
    return R.ranked(R.bm25(R.visible(d, generation=newest - 2), texts(spark, sf_dir), 10), 10)


@query("filter_acl", f"SELECT doc_id FROM ({_META}) WHERE len(acl)=0 OR list_has_any(acl, ['group:hr'])")
def filter_acl(spark, sf_dir):
    return R.visible(documents(spark, sf_dir), tags=("group:hr",)).select("doc_id")


@query("filter_validity", f"SELECT doc_id FROM ({_META}) WHERE len(acl)=0 AND valid_from<=6000 AND (valid_to IS NULL OR valid_to>6000) AND (expires_at IS NULL OR expires_at>6000)")
def filter_validity(spark, sf_dir):
    return R.visible(documents(spark, sf_dir), at=6000).select("doc_id")


@query("filter_lang_doctype", f"SELECT doc_id, tenant FROM ({_META}) WHERE len(acl)=0 AND language='de' AND doc_type='report'")
def filter_lang_doctype(spark, sf_dir):
    return R.visible(documents(spark, sf_dir), language="de", doc_type="report").select("doc_id", "tenant")


@query("latest_version_wins", "SELECT sha256('blob:' || text) AS chunk_hash, max(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY 1")
def latest_version_wins(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", digest("blob", "text").alias("chunk_hash"))
    return R.latest(d, "chunk_hash", "doc_id")


_BLANKS = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


@query("hit_previews", f"""WITH {_bm25_sql('len(acl)=0')}, h AS ({_top('s', 10)}), l AS (SELECT h.*, replace(regexp_replace(text, '^{_BLANKS}|{_BLANKS}$', '', 'g'), chr(10), ' ') AS line FROM h JOIN d USING (doc_id))
SELECT query_id, doc_id, score, rank, CASE WHEN octet_length(encode(line)) <= 96 THEN line ELSE left(line, list_max([n for n in range(20, 97) if octet_length(encode(left(line, n))) <= 96])) || '...' END AS preview FROM l""")  # fmt: skip
def hit_previews(spark, sf_dir):
    """The best ten of each query with a line of their text, joined after the ranking."""
    d = documents(spark, sf_dir)
    return bm25_top10(spark, sf_dir).join(d.select("doc_id", preview("text").alias("preview")), "doc_id")


@query("vector_top10", f"WITH {_VECTORS_SQL}, {_VSCORES} {_top('v', 10)}")
def vector_top10(spark, sf_dir):
    return R.vector_topk(table(spark, sf_dir, "embeddings"), VECTORS, 10)


@query("vector_top10_filtered", f"WITH {_VECTORS_SQL}, {_VSCORES}, a AS (SELECT v.* FROM v JOIN ({_META}) USING (doc_id) WHERE len(acl)=0 AND language='en') {_top('a', 10)}")
def vector_top10_filtered(spark, sf_dir):
    seen = R.visible(documents(spark, sf_dir), language="en").select(F.col("doc_id").alias("vec_id"))
    return R.vector_topk(table(spark, sf_dir, "embeddings").join(seen, "vec_id", "left_semi"), VECTORS, 10)


@query("sq8_quantise", """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v, list_max([abs(x) for x in embedding::DOUBLE[]])/127 AS scale FROM embeddings)
SELECT vec_id, round(scale, 9) AS scale, array_to_string([round(x/scale)::INT for x in v], ',') AS codes FROM v WHERE scale > 0""")  # fmt: skip
def sq8_quantise(spark, sf_dir):
    q = R.quantised(table(spark, sf_dir, "embeddings"))
    return q.select("vec_id", F.round("scale", 9).alias("scale"), F.array_join(F.transform("codes", lambda c: c.cast("string")), ",").alias("codes"))


@query("hybrid_rrf", f"""WITH {_bm25_sql('len(acl)=0')}, {_VECTORS_SQL}, {_VSCORES}, a AS (SELECT v.* FROM v JOIN d USING (doc_id)),
l AS (SELECT query_id, doc_id, rank FROM ({_top('s', 40)}) UNION ALL SELECT query_id, doc_id, rank FROM ({_top('a', 40)})),
u AS (SELECT query_id, doc_id, round(sum(1/(60+rank)::DOUBLE), 9) AS score FROM l GROUP BY ALL) {_top('u', 10)}""")  # fmt: skip
def hybrid_rrf(spark, sf_dir):
    return R.hybrid(R.visible(documents(spark, sf_dir)), table(spark, sf_dir, "embeddings"), texts(spark, sf_dir), VECTORS)


@query("index_stats", f"""SELECT (SELECT count(*) FROM documents) AS n_chunks, (SELECT count(*) FROM embeddings) AS n_embeddings,
(SELECT max(len(embedding))::INT FROM embeddings) AS dim, (SELECT count(DISTINCT term) FROM (SELECT unnest({_TOKENS}) AS term FROM documents)) AS n_terms""")  # fmt: skip
def index_stats(spark, sf_dir):
    d, e = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    terms = d.select(F.explode(tokens("text")).alias("term")).distinct().agg(F.count(F.lit(1)).alias("n_terms"))
    vectors = e.agg(F.count(F.lit(1)).alias("n_embeddings"), F.max(F.size("embedding")).alias("dim"))
    return d.agg(F.count(F.lit(1)).alias("n_chunks")).crossJoin(vectors).crossJoin(terms)  # one row each


_JUDGED = """n AS (SELECT query_id, count(*) AS n FROM qt GROUP BY query_id),
j AS (SELECT query_id, doc_id, 1 AS rel FROM qt JOIN p USING (term) JOIN n USING (query_id) GROUP BY query_id, doc_id, n HAVING count(*) * 10 >= n * 9)"""


def judged(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id, rel): documents that have nine tenths of a query's terms are relevant to it."""
    q = R.terms_of(queries, "query_id").distinct()
    p = R.terms_of(docs, "doc_id").join(q.select("term").distinct(), "term", "left_semi").distinct()
    n = q.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    both = p.join(q, "term").groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("m")).join(n, "query_id")
    return both.where("m * 10 >= n * 9").select("query_id", "doc_id", F.lit(1).alias("rel"))


@query("rank_quality", f"""WITH {_bm25_sql('len(acl)=0')}, h AS ({_top('s', 10)}), {_JUDGED},
i AS (SELECT query_id, rel, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, doc_id) AS r FROM j),
b AS (SELECT query_id, sum(rel/log2(r+1)) FILTER (r <= 10) AS best, count(*) AS n FROM i GROUP BY ALL),
g AS (SELECT query_id, sum(rel/log2(rank+1)) AS dcg, count(*) AS m FROM h JOIN j USING (query_id, doc_id) GROUP BY ALL)
SELECT query_id, round(coalesce(dcg,0)/best, 6) AS ndcg, round(coalesce(m,0)/n::DOUBLE, 6) AS recall FROM b LEFT JOIN g USING (query_id)""")  # fmt: skip
def rank_quality(spark, sf_dir):
    """How well the ranking puts the documents first that have nine tenths of a query's terms; texts are split once for both."""
    docs, queries = R.visible(documents(spark, sf_dir)), texts(spark, sf_dir)
    of = R.counted(docs, R.query_terms(queries))
    if of is None:
        return R.rank_quality(bm25_top10(spark, sf_dir), judged(docs, queries), 10)
    relevance = written(R.having(docs, of, 9), "relevance").withColumn("rel", F.lit(1))
    return R.rank_quality(R.ranked(R.scored(of, 10), 10), relevance, 10)
