"""The registered queries of this subpackage, one per operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, hmm, jaccard_join, langid, mixing, mtree, rendezvous, token_orc, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_warc_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_digest(_read(spark, sf_dir, "pages"))


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
d AS (SELECT page_id, n, sha1(html) AS h, max(page_id) OVER (PARTITION BY sha1(html)) AS origin FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, h AS payload_digest,
  CASE WHEN n >= 1000 AND page_id < origin THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id < origin THEN origin END AS refers_to
FROM d
"""


def op2_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_orc.token_digest(_read(spark, sf_dir, "documents"))


def op3_rendezvous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendezvous.shard_documents(_read(spark, sf_dir, "documents"))


def op4_signature_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_read(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 4], ' ') END AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
k AS (SELECT doc_id, array_agg(g ORDER BY g) AS gs FROM s GROUP BY doc_id),
c AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY gs) AS rep FROM k),
r AS (SELECT s.doc_id, s.g FROM s JOIN (SELECT DISTINCT rep FROM c) q ON s.doc_id = q.rep),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM r a JOIN r b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * o >= 75 * (nx.n + ny.n - o)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
t(x, y) AS (SELECT DISTINCT rep, rep FROM c UNION SELECT t.x, e.y FROM t JOIN e ON t.y = e.x),
m AS (SELECT x, min(y) AS component_id FROM t GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.component_id, d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN m ON m.x = c.rep
"""


def op8_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    return chat.chat_digest(rows.unionByName(extra))


def op5_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture_plan(_read(spark, sf_dir, "documents"))


def op6_qgram_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op7_mtree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.embedding_top_k(_read(spark, sf_dir, "embeddings"))


OP7_SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
p AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS rank, vec_id, score FROM p)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""


def op9_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_read(spark, sf_dir, "documents"))


def op10_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score_documents(_read(spark, sf_dir, "documents"))


QUERIES = {"op1_warc_index_merge": op1_warc_index_merge, "op2_token_orc": op2_token_orc, "op3_rendezvous": op3_rendezvous, "op4_signature_tree_join": op4_signature_tree_join, "op5_temperature_mixing": op5_temperature_mixing, "op6_qgram_leaks": op6_qgram_leaks, "op7_mtree_top_k": op7_mtree_top_k, "op8_chat_windows": op8_chat_windows, "op9_cross_parsing": op9_cross_parsing, "op10_hidden_markov": op10_hidden_markov}
ORACLE: dict[str, str] = {"op1_warc_index_merge": OP1_SQL, "op4_signature_tree_join": OP4_SQL, "op7_mtree_top_k": OP7_SQL}
