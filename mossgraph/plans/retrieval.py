"""Registered retrieval and text queries with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import fulltext, vector

QUERY = "tion thin ouer"
WORDS = ["tion", "thin", "ouer"]
FTS = "tion* the* ing*"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """A scan, dealt out if it keeps fewer tasks busy than there are cores.

    Partitions of a scan are byte ranges of files, and all rows of a row group go to the range that holds its middle; so a
    scan of few partitions is judged by the rows of its fullest.  Larger scans stay as they are, without a shuffle."""
    n = scan.sparkSession.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() > 4 * n:
        return scan
    held = [r["count"] for r in scan.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()]
    return scan.repartition(n) if held and (len(held) < n or max(held) > 2 * sum(held) / n) else scan


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents that aren't empty; block_id is a struct-free key made of document and line."""
    return _blocks(texts(spark, sf_dir))


def _blocks(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", F.posexplode(T.lines()).alias("line", "content"))
    return rows.where(F.trim("content") != "").select("doc_id", F.col("line").cast("long").alias("line"), "content", F.concat_ws(":", F.col("doc_id").cast("string"), F.lpad(F.col("line").cast("string"), 6, "0")).alias("block_id"))


def semantic(spark, sf_dir) -> DataFrame:
    rows = texts(spark, sf_dir)
    scored = vector.query_scores(_blocks(rows).select("block_id", T.tokens(F.col("content")).alias("tokens")), WORDS)
    return scored.select("block_id", F.round("score", 6).alias("score")).where("score > 0.01")


def semantic_topk(spark, sf_dir):
    return semantic(spark, sf_dir).orderBy(F.desc("score"), "block_id").limit(20)


SQL_B = T.SQL_BLOCKS + ", b AS (SELECT doc_id, line, content, doc_id::VARCHAR || ':' || lpad(line::VARCHAR, 6, '0') AS block_id FROM blocks)"
_wanted = vector.places(WORDS)
_norm = math.sqrt(sum(v * v for v in _wanted.values()))
SQL_SEMANTIC = SQL_B + f""", tk AS (SELECT block_id, {T.SQL_TOKENS.format('content')} AS t FROM b),
f AS (SELECT block_id, unnest(list_concat(t, list_transform(range(len(t) - 1), lambda i: t[(i + 1)::BIGINT] || ' ' || t[(i + 2)::BIGINT]))) AS feature FROM tk),
d AS (SELECT feature, {T.sql_fnv('feature')} AS h FROM (SELECT DISTINCT feature FROM f)),
w AS (SELECT block_id, (h % 384)::INT AS place, sum(CASE WHEN (h // 72057594037927936::UHUGEINT) % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS v FROM f JOIN d USING (feature) GROUP BY 1, 2),
q(place, x) AS (VALUES {', '.join(f'({k}, {v})' for k, v in _wanted.items())}),
sem AS (SELECT block_id, round(coalesce(sum(v * x), 0) / (sqrt(sum(v * v)) * {_norm!r}), 6) AS score FROM w LEFT JOIN q USING (place) GROUP BY block_id HAVING sum(v * v) > 0 AND round(coalesce(sum(v * x), 0) / (sqrt(sum(v * v)) * {_norm!r}), 6) > 0.01)"""


def tokenize_counts(spark, sf_dir):
    return texts(spark, sf_dir).select(F.explode(T.tokens(F.coalesce("text", F.lit("")))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def bigram_counts(spark, sf_dir):
    return texts(spark, sf_dir).select(T.tokens(F.coalesce("text", F.lit(""))).alias("t")).select(F.explode(T.bigrams(F.col("t"))).alias("bigram")).groupBy("bigram").agg(F.count(F.lit(1)).alias("n"))


def fnv1a_hash(spark, sf_dir):
    """Each different token is hashed once."""
    hashed = tokenize_counts(spark, sf_dir).select("token", T.fnv1a_halves(F.col("token")).alias("h"))
    return hashed.select("token", T.fnv1a_hex(F.col("h")).alias("hash"), T.bucket(F.col("h")).cast("int").alias("bucket"), T.sign(F.col("h")).cast("int").alias("sign"))


def fts_and_prefix(spark, sf_dir):
    return fulltext.match_all(blocks(spark, sf_dir), FTS).select("block_id", "length", "tf0", "tf1", "tf2")


def fts_bm25_topk(spark, sf_dir):
    return fulltext.bm25(blocks(spark, sf_dir), FTS, 20)


SQL_FTS = SQL_B + rf""", fw AS (SELECT block_id, list_filter(regexp_split_to_array(translate(lower(content), '{fulltext.MARKED}', '{fulltext.PLAIN}'), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM b),
fm AS (SELECT block_id, len(w) AS length, len(list_filter(w, lambda x: starts_with(x, 'tion'))) AS tf0, len(list_filter(w, lambda x: starts_with(x, 'the'))) AS tf1, len(list_filter(w, lambda x: starts_with(x, 'ing'))) AS tf2 FROM fw),
ft AS (SELECT count(*)::DOUBLE AS n, avg(length) AS mean, sum((tf0 > 0)::INT)::DOUBLE AS d0, sum((tf1 > 0)::INT)::DOUBLE AS d1, sum((tf2 > 0)::INT)::DOUBLE AS d2 FROM fm),
fts AS (SELECT block_id, round(greatest(ln((n - d0 + .5) / (d0 + .5)), 1e-6) * tf0 * 2.2 / (tf0 + 1.2 * (.25::DOUBLE + .75::DOUBLE * length / mean)) + greatest(ln((n - d1 + .5) / (d1 + .5)), 1e-6) * tf1 * 2.2 / (tf1 + 1.2 * (.25::DOUBLE + .75::DOUBLE * length / mean)) + greatest(ln((n - d2 + .5) / (d2 + .5)), 1e-6) * tf2 * 2.2 / (tf2 + 1.2 * (.25::DOUBLE + .75::DOUBLE * length / mean)), 6) AS score FROM fm, ft WHERE tf0 > 0 AND tf1 > 0 AND tf2 > 0)"""


def hybrid_rrf(spark, sf_dir, limit: int = 20):
    source = blocks(spark, sf_dir)
    legs = {"fts": fulltext.bm25(source, FTS, 3 * limit), "semantic": semantic(spark, sf_dir).orderBy(F.desc("score"), "block_id").limit(3 * limit)}
    return fulltext.fused(legs, limit)


def snippet_window(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", T.snippet(F.coalesce("text", F.lit("")), "Tion").alias("snippet"))


def block_split_hash(spark, sf_dir):
    return blocks(spark, sf_dir).select("doc_id", "line", F.sha2("content", 256).alias("content_hash"), F.length("content").cast("long").alias("chars"))


def word_count(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", T.visible_words(F.col("text")).alias("words"), T.token_estimate(F.coalesce("text", F.lit(""))).alias("token_estimate"))


def leading_paragraph(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", T.leading_text(F.col("text"), 240).alias("lead"))


def vector_query(spark, sf_dir) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()[0])


def vector_topk(spark, sf_dir):
    return vector.nearest_to(table(spark, sf_dir, "embeddings"), vector_query(spark, sf_dir), k=20)


def vector_threshold(spark, sf_dir):
    return vector.nearest_to(table(spark, sf_dir, "embeddings"), vector_query(spark, sf_dir), threshold=0.01)


def vector_all_pairs_topk(spark, sf_dir):
    return vector.all_pairs_topk(table(spark, sf_dir, "embeddings"), 5).withColumn("rank", F.col("rank").cast("long"))


_COS = "list_cosine_similarity({0}::DOUBLE[], {1}::DOUBLE[])"
SQL_V = "q AS (SELECT embedding AS qe FROM embeddings WHERE vec_id = 0), v AS (SELECT vec_id, round(" + _COS.format("embedding", "qe") + ", 6) AS score FROM embeddings, q)"


def queries() -> dict:
    named = [semantic_topk, tokenize_counts, bigram_counts, fnv1a_hash, fts_and_prefix, fts_bm25_topk, hybrid_rrf, snippet_window, block_split_hash, word_count, leading_paragraph, vector_topk, vector_threshold, vector_all_pairs_topk]
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    tokens = T.SQL_TOKENS.format("coalesce(text, '')")
    return {
        "semantic_topk": f"WITH {SQL_SEMANTIC} SELECT block_id, score FROM sem ORDER BY score DESC, block_id LIMIT 20",
        "tokenize_counts": f"SELECT token, count(*) AS n FROM (SELECT unnest({tokens}) AS token FROM documents) GROUP BY 1",
        "bigram_counts": f"WITH t AS (SELECT {tokens} AS t FROM documents) SELECT bigram, count(*) AS n FROM (SELECT unnest(list_transform(range(len(t) - 1), lambda i: t[(i + 1)::BIGINT] || ' ' || t[(i + 2)::BIGINT])) AS bigram FROM t) GROUP BY 1",
        "fnv1a_hash": f"WITH t AS (SELECT DISTINCT token FROM (SELECT unnest({tokens}) AS token FROM documents)), h AS (SELECT token, {T.sql_fnv('token')} AS h FROM t) SELECT token, lpad(lower(format('{{:x}}', h::UBIGINT)), 16, '0') AS hash, (h % 384)::INT AS bucket, (CASE WHEN (h // 72057594037927936::UHUGEINT) % 2 = 0 THEN 1 ELSE -1 END)::INT AS sign FROM h",
        "fts_and_prefix": f"WITH {SQL_FTS} SELECT * FROM fm WHERE tf0 > 0 AND tf1 > 0 AND tf2 > 0",
        "fts_bm25_topk": f"WITH {SQL_FTS} SELECT block_id, score FROM fts ORDER BY score DESC, block_id LIMIT 20",
        "hybrid_rrf": f"""WITH {SQL_SEMANTIC}, {SQL_FTS[len(SQL_B) + 2 :]},
r AS (SELECT block_id, 'semantic' AS leg, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY score DESC, block_id)) AS share FROM (SELECT * FROM sem ORDER BY score DESC, block_id LIMIT 60)
      UNION ALL SELECT block_id, 'fts', 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY score DESC, block_id)) FROM (SELECT * FROM fts ORDER BY score DESC, block_id LIMIT 60))
SELECT block_id, round(sum(share), 6) AS score, CASE WHEN count(DISTINCT leg) > 1 THEN 'both' ELSE min(leg) END AS matched_via FROM r GROUP BY block_id ORDER BY score DESC, block_id LIMIT 20""",
        "snippet_window": """WITH p AS (SELECT doc_id, coalesce(text, '') AS t, instr(lower(coalesce(text, '')), 'tion') AS hit FROM documents),
s AS (SELECT *, CASE WHEN hit > 0 THEN greatest(hit - 41, 0) ELSE 0 END AS a, CASE WHEN hit > 0 THEN least(hit - 1 + 144, length(t)) ELSE least(length(t), 180) END AS z FROM p)
SELECT doc_id, CASE WHEN a > 0 THEN '…' ELSE '' END || replace(substring(t, a + 1, z - a), chr(10), ' ') || CASE WHEN z < length(t) THEN '…' ELSE '' END AS snippet FROM s""",
        "block_split_hash": f"WITH {T.SQL_BLOCKS} SELECT doc_id, line, sha256(content) AS content_hash, length(content) AS chars FROM blocks",
        "word_count": r"SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '\S+')) AS words, ceil(octet_length(encode(trim(coalesce(text, '')))) / 4)::BIGINT AS token_estimate FROM documents",
        "leading_paragraph": """WITH l AS (SELECT doc_id, list_reduce(list_prepend('', list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x))), lambda s, x: CASE WHEN length(s) >= 240 OR starts_with(x, '#') THEN s WHEN x = '' THEN CASE WHEN s = '' THEN s ELSE s || chr(10) END WHEN s = '' OR ends_with(s, ' ') OR ends_with(s, chr(10)) THEN s || x ELSE s || ' ' || x END) AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) > 240 THEN substring(t, 1, 240) || '…' ELSE t END AS lead FROM l""",
        "vector_topk": f"WITH {SQL_V} SELECT * FROM v ORDER BY score DESC, vec_id LIMIT 20",
        "vector_threshold": f"WITH {SQL_V} SELECT * FROM v WHERE score > 0.01",
        "vector_all_pairs_topk": f"SELECT source, target, score, rank FROM (SELECT source, target, score, row_number() OVER (PARTITION BY source ORDER BY score DESC, target) AS rank FROM (SELECT a.vec_id AS source, b.vec_id AS target, round({_COS.format('a.embedding', 'b.embedding')}, 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)) WHERE rank <= 5",
    }
