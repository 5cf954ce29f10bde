"""Preference formatting.  DataFrame functions only.

Of each pair of conversations the longest common turn prefix is rendered once as the prompt; the rest of each is its
completion, with the character spans of the completion that carry the loss (assistant turns).

Defined results: turns are ordered by number, then role, then text, so repeated turns repeat; null roles and texts count
as empty; conversations without an identifier form no pair; a pair that lacks a side gets an empty prompt and an empty
completion there; identical conversations get empty completions and no spans; markers inside texts are broken by a space
so that a text can't open or close a turn; an empty table gives an empty table.  A rendered conversation is one cell of
the result, so a conversation has to fit into a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, MARK = "<|im_start|>", "<|im_end|>", "<|"


def rendered(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), F.replace(turn["role"], F.lit(MARK), F.lit("< |")), F.lit("\n"), F.replace(turn["text"], F.lit(MARK), F.lit("< |")), F.lit(CLOSE + "\n"))


def text_of(turns: Column) -> Column:
    return F.array_join(F.transform(turns, rendered), "")


def spans_of(turns: Column, trained: str) -> Column:
    """Character spans of the trained turns' texts and end markers, as "start-stop" joined by commas."""

    def add(state: Column, turn: Column) -> Column:
        size = F.length(rendered(turn))
        start = state["at"] + F.length(F.lit(OPEN)) + F.length(F.replace(turn["role"], F.lit(MARK), F.lit("< |"))) + 1
        span = F.concat(start.cast("string"), F.lit("-"), (state["at"] + size - 1).cast("string"))
        return F.struct((state["at"] + size).alias("at"), F.when(turn["role"] == trained, F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    return F.array_join(F.aggregate(turns, F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans")), add)["spans"], ",")


def preference_pairs(turns: DataFrame, pairs: DataFrame, trained: str = "assistant") -> DataFrame:
    """pairs: pair_id, chosen_id, rejected_id.  turns: conv_id, turn, role, text.

    Returns pair_id, chosen_id, rejected_id, prompt_turns, prompt, chosen, rejected, chosen_spans, rejected_spans."""
    sides = pairs.select("pair_id", "chosen_id", "rejected_id", F.explode(F.array(F.struct(F.col("chosen_id").alias("id"), F.lit(0).alias("side")), F.struct(F.col("rejected_id").alias("id"), F.lit(1).alias("side")))).alias("s"))
    sides = sides.select("pair_id", "chosen_id", "rejected_id", F.col("s.id").alias("conv_id"), F.col("s.side").alias("side"))
    clean = turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    return _formatted(sides.join(clean, "conv_id", "left"), trained)


def _formatted(rows: DataFrame, trained: str) -> DataFrame:
    """rows: pair_id, chosen_id, rejected_id, side, t."""
    of = lambda n: F.array_sort(F.collect_list(F.when(F.col("side") == n, F.col("t"))))  # noqa: E731  nulls aren't collected
    both = rows.groupBy("pair_id", "chosen_id", "rejected_id").agg(of(0).alias("a"), of(1).alias("b"))
    shorter = F.least(F.size("a"), F.size("b"))
    same = F.zip_with(F.slice("a", 1, shorter), F.slice("b", 1, shorter), lambda x, y: (x["role"] == y["role"]) & (x["text"] == y["text"]))
    differs = F.array_position(same, False)
    both = both.withColumn("n", F.when(differs > 0, differs - 1).otherwise(shorter.cast("long")).cast("int"))
    parts = both.select(
        "pair_id",
        "chosen_id",
        "rejected_id",
        F.col("n").cast("long").alias("prompt_turns"),
        F.slice("a", F.lit(1), F.col("n")).alias("shared"),
        F.slice("a", F.col("n") + 1, F.size("a")).alias("a"),
        F.slice("b", F.col("n") + 1, F.size("b")).alias("b"),
    )
    return parts.select(
        "pair_id",
        "chosen_id",
        "rejected_id",
        "prompt_turns",
        text_of(F.col("shared")).alias("prompt"),
        text_of(F.col("a")).alias("chosen"),
        text_of(F.col("b")).alias("rejected"),
        spans_of(F.col("a"), trained).alias("chosen_spans"),
        spans_of(F.col("b"), trained).alias("rejected_spans"),
    )


def neighbouring_pairs(turns: DataFrame, trained: str = "assistant") -> DataFrame:
    """Pairs of each even conversation (chosen) with the next odd one (rejected); no join is needed to form them."""
    low = F.col("conv_id") - F.pmod(F.col("conv_id"), F.lit(2))
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        F.expr("(conv_id - pmod(conv_id, 2)) div 2").alias("pair_id"),
        low.alias("chosen_id"),
        (low + 1).alias("rejected_id"),
        F.pmod(F.col("conv_id"), F.lit(2)).alias("side"),
        F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"),
    )
    return _formatted(rows, trained)


ORACLE = r"""
WITH t AS (
  SELECT (conv_id - conv_id % 2) // 2 AS pair_id, conv_id % 2 AS side,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS rn, coalesce(role, '') AS role,
         '<|im_start|>' || replace(coalesce(role, ''), '<|', '< |') || chr(10) AS head,
         replace(coalesce(text, ''), '<|', '< |') || '<|im_end|>' || chr(10) AS body, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
m AS (
  SELECT coalesce(a.pair_id, b.pair_id) AS pair_id,
         coalesce(min(coalesce(a.rn, b.rn)) FILTER (NOT coalesce(a.role = b.role AND a.text = b.text, false)), max(coalesce(a.rn, b.rn)) + 1) - 1 AS n
  FROM (SELECT * FROM t WHERE side = 0) a FULL JOIN (SELECT * FROM t WHERE side = 1) b ON a.pair_id = b.pair_id AND a.rn = b.rn
  GROUP BY 1),
p AS (
  SELECT t.*, m.n, coalesce(sum(length(head) + length(body)) OVER (PARTITION BY t.pair_id, side ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) , 0)
           - coalesce(sum(CASE WHEN rn <= n THEN length(head) + length(body) END) OVER (PARTITION BY t.pair_id, side), 0) AS pos
  FROM t JOIN m USING (pair_id))
SELECT pair_id, pair_id * 2 AS chosen_id, pair_id * 2 + 1 AS rejected_id, max(n) AS prompt_turns,
       coalesce(string_agg(head || body, '' ORDER BY rn) FILTER (side = 0 AND rn <= n), '') AS prompt,
       coalesce(string_agg(head || body, '' ORDER BY rn) FILTER (side = 0 AND rn > n), '') AS chosen,
       coalesce(string_agg(head || body, '' ORDER BY rn) FILTER (side = 1 AND rn > n), '') AS rejected,
       coalesce(string_agg((pos + length(head))::BIGINT::VARCHAR || '-' || (pos + length(head) + length(body) - 1)::BIGINT::VARCHAR, ',' ORDER BY rn) FILTER (side = 0 AND rn > n AND role = 'assistant'), '') AS chosen_spans,
       coalesce(string_agg((pos + length(head))::BIGINT::VARCHAR || '-' || (pos + length(head) + length(body) - 1)::BIGINT::VARCHAR, ',' ORDER BY rn) FILTER (side = 1 AND rn > n AND role = 'assistant'), '') AS rejected_spans
FROM p GROUP BY pair_id
"""
