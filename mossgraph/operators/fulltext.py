"""Full-text search: postings, prefix terms joined by AND, BM25, and reciprocal-rank fusion."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import graph

K1, B = 1.2, 0.75
#: Least inverse document frequency.
LEAST_IDF = 1e-6
#: Letters with marks and what they are without, for the languages of the tables.
MARKED = "áàâäãåçéèêëíìîïñóòôöõúùûüýÿ"
PLAIN = "".join(unicodedata.normalize("NFD", c)[0] for c in MARKED)
RRF = 60


def terms_of(query: str) -> list[str]:
    """White-space separated terms, reduced to letters, digits, - and _."""
    kept = [re.sub(r"[^\w-]", "", part) for part in query.split()]
    return [t.lower().translate(str.maketrans(MARKED, PLAIN)) for t in kept if t]


def postings(blocks: DataFrame, id_col: str = "block_id", text: str = "content") -> DataFrame:
    """term, block_id, tf: folded terms of each block."""
    words = F.filter(F.split(F.translate(F.lower(F.col(text)), MARKED, PLAIN), r"[^\p{L}\p{N}]+"), lambda t: t != "")
    return blocks.select(id_col, F.explode(words).alias("term")).groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf"))


def matches(blocks: DataFrame, query: str, id_col: str = "block_id", text: str = "content") -> DataFrame:
    """block_id, length and tf0, tf1, ...: occurrences of each prefix term, in one pass and without a shuffle."""
    words = F.filter(F.split(F.translate(F.lower(F.col(text)), MARKED, PLAIN), r"[^\p{L}\p{N}]+"), lambda t: t != "")
    held = blocks.select(id_col, words.alias("words"))

    def occurrences(term: str):
        return F.size(F.filter("words", lambda w: w.startswith(term))).cast("long")

    counts = [occurrences(t).alias(f"tf{i}") for i, t in enumerate(terms_of(query))]
    return held.select(id_col, F.size("words").cast("long").alias("length"), *counts)


def match_all(blocks: DataFrame, query: str, id_col: str = "block_id") -> DataFrame:
    n = len(terms_of(query))
    found = matches(blocks, query, id_col)
    every = F.lit(n > 0)
    for i in range(n):
        every = every & (F.col(f"tf{i}") > 0)
    return found.where(every)


def bm25(blocks: DataFrame, query: str, k: int | None = None, id_col: str = "block_id") -> DataFrame:
    """block_id, score (higher is better) of the blocks that match every prefix term.

    Texts are taken apart once: lengths and occurrences, a few numbers a block, are kept, and corpus statistics and scores
    are both made from them."""
    n = len(terms_of(query))
    found = graph.checkpointed(matches(blocks, query, id_col))
    totals = found.agg(F.count(F.lit(1)).cast("double").alias("blocks"), F.avg("length").alias("mean"), *[F.sum((F.col(f"tf{i}") > 0).cast("double")).alias(f"df{i}") for i in range(n)])
    every = F.lit(n > 0)
    score = F.lit(0.0)
    for i in range(n):
        every = every & (F.col(f"tf{i}") > 0)
        idf = F.greatest(F.log((F.col("blocks") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)), F.lit(LEAST_IDF))
        tf = F.col(f"tf{i}").cast("double")
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    scored = found.where(every).crossJoin(F.broadcast(totals)).select(id_col, F.round(score, 6).alias("score"))  # one row of totals
    return scored.orderBy(F.desc("score"), id_col).limit(k) if k is not None else scored


def fused(ranked: dict[str, DataFrame], k: int, id_col: str = "block_id") -> DataFrame:
    """Reciprocal-rank fusion of result lists (id and score, each of at most a few hundred rows)."""
    every = None
    for name, hits in ranked.items():
        place = F.row_number().over(Window.orderBy(F.desc("score"), id_col))
        part = hits.select(id_col, F.lit(name).alias("leg"), (1.0 / (RRF + place)).alias("share"))
        every = part if every is None else every.unionByName(part)
    summed = every.groupBy(id_col).agg(F.round(F.sum("share"), 6).alias("score"), F.count_distinct("leg").alias("legs"), F.min("leg").alias("leg"))
    return summed.select(id_col, "score", F.when(F.col("legs") > 1, "both").otherwise(F.col("leg")).alias("matched_via")).orderBy(F.desc("score"), id_col).limit(k)


def described(hits: DataFrame, told: DataFrame, query: str, id_col: str = "block_id") -> DataFrame:
    """hits (a few hundred rows) with path, title, line and snippet.  told: id, path, title, line, content of every block.

    The hits are broadcast, so the blocks are read once and not shuffled."""
    found = told.join(F.broadcast(hits), id_col)
    return found.select(id_col, "score", "matched_via", "path", "title", "line", T.snippet(F.col("content"), query).alias("snippet")).orderBy(F.desc("score"), id_col)
