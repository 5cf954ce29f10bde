"""The jobs as registered queries: each runs its job twice into a new folder and returns what then stands there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mossgraph.operators import fulltext, graph, postings
from mossgraph.plans import ledger as plans

from . import activity_ledger, index_documents


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{graph.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def job1_index_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every posting of the index with the maxima of its row."""
    at = new_folder(spark, "job1")
    for _ in range(2):
        index = index_documents.run(spark, f"{sf_dir}/documents.parquet", f"{at}/index", f"{at}/checkpoint")
    return index.select("segment", "term", "chunk", "piece", "n", "most_tf", "least_length", F.inline("postings")).select("segment", "term", "chunk", "n", "most_tf", "least_length", "doc_id", "line", "tf", "length")


def job2_activity_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = new_folder(spark, "job2")
    for _ in range(2):
        days = activity_ledger.run(spark, f"{sf_dir}/events.parquet", f"{at}/ledger", f"{at}/checkpoint")
    return days


def queries() -> dict:
    return {f.__name__: f for f in (job1_index_documents, job2_activity_ledger)}


def oracle_sql() -> dict[str, str]:
    return {
        "job1_index_documents": rf"""WITH d AS (SELECT doc_id, max(text) AS text FROM documents WHERE doc_id IS NOT NULL GROUP BY 1),
l AS (SELECT doc_id, unnest(l) AS content, unnest(range(len(l))) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM d)),
w AS (SELECT doc_id, line, list_filter(regexp_split_to_array(translate(lower(content), '{fulltext.MARKED}', '{fulltext.PLAIN}'), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM l WHERE trim(content) <> ''),
p AS (SELECT term, doc_id, line, count(*) AS tf, length FROM (SELECT unnest(w) AS term, doc_id, line, len(w) AS length FROM w) GROUP BY ALL
      UNION ALL SELECT '', doc_id, line, 0, len(w) FROM w UNION ALL SELECT '', doc_id, -1, 0, 0 FROM d),
k AS (SELECT *, floor(doc_id / {postings.SEGMENT})::BIGINT AS segment, floor(doc_id / {postings.CHUNK})::BIGINT AS chunk, greatest(line, 0) // {postings.LINES} AS piece FROM p)
SELECT segment, term, chunk, (count(*) FILTER (line >= 0) OVER g)::BIGINT AS n, max(tf) OVER g AS most_tf, min(CASE WHEN line >= 0 THEN length END) OVER g AS least_length, doc_id, line, tf, length
FROM k WINDOW g AS (PARTITION BY segment, term, chunk, piece)""",
        "job2_activity_ledger": f"""WITH {plans.SQL_L},
s AS (SELECT coalesce(day, 'unknown') AS day, coalesce(operation, 'unknown') AS operation, count(*) AS n, sum(coalesce(cost, 0))::BIGINT AS cost, sum(coalesce(input, 0))::BIGINT AS input, sum(coalesce(cache_write, 0))::BIGINT AS cache_write, sum(coalesce(cache_read, 0))::BIGINT AS cache_read, sum(coalesce(output, 0))::BIGINT AS output FROM l GROUP BY 1, 2)
SELECT operation, n, cost, input, cache_write, cache_read, output, round(cache_read / nullif(cache_read + cache_write + input, 0), 6) AS hit_ratio, round(cost / nullif(sum(cost) OVER (PARTITION BY day), 0), 6) AS share, sum(cost) OVER (PARTITION BY day) > 20000000 AS over, day FROM s""",
    }
