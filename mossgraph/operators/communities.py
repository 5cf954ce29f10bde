"""Community tables: members, summaries, routing of a question, and the context it gives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Characters of each lead, and bytes of a summary.
LEAD, CAP = 220, 1200


def summaries(members: DataFrame, group: str, order: str, title: str = "title", lead: str = "lead") -> DataFrame:
    """group, members, summary: a bullet a member until the next would exceed the cap.

    A bullet has five bytes at least, so no more than CAP / 5 members of a group can matter; a ranked filter (which Spark
    applies before the shuffle) keeps just those, however large a group is."""
    short = T.capped(T.squeezed(F.coalesce(lead, F.lit(""))), LEAD)
    entry = F.when(short == "", F.concat(F.lit("• "), F.col(title), F.lit("\n"))).otherwise(F.concat(F.lit("• "), F.col(title), F.lit(": "), short, F.lit("\n")))
    sizes = members.groupBy(group).agg(F.count(F.lit(1)).alias("members"))
    ranked = members.select(group, order, entry.alias("entry"), F.row_number().over(Window.partitionBy(group).orderBy(order)).alias("place")).where(F.col("place") <= CAP // 5)
    gathered = ranked.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(order, "entry"))).alias("e"))

    def add(state: Column, item: Column) -> Column:
        fits = ~state["full"] & (F.octet_length(state["text"]) + F.octet_length(item["entry"]) <= CAP)
        return F.struct(F.when(fits, F.concat(state["text"], item["entry"])).otherwise(state["text"]).alias("text"), (~fits).alias("full"))

    text = F.aggregate("e", F.struct(F.lit("").alias("text"), F.lit(False).alias("full")), add)["text"]
    return gathered.select(group, F.rtrim(F.regexp_replace(text, r"\n+$", "")).alias("summary")).join(sizes, group)


def members_of(rows: DataFrame, group: str, id_col: str, most: int = 1_000_000) -> DataFrame:
    """Membership arrays in order; a group above ``most`` members raises, since it belongs into rows."""
    out = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(id_col)).alias("members"))
    return out.withColumn("members", F.when(F.col("n") > most, F.raise_error(F.lit("too many members for an array"))).otherwise(F.col("members")))


def report(labels: DataFrame, group: str) -> DataFrame:
    """communities, covered, mean size, largest: two aggregations, no collect."""
    return labels.groupBy(group).agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("communities"), F.sum("n").alias("covered"), F.round(F.avg("n"), 6).alias("mean_size"), F.max("n").alias("largest"))


def centroids(vectors: DataFrame, group: str, col: str = "embedding") -> DataFrame:
    """Mean vector of each group by place: partial sums before the shuffle, no array of vectors."""
    return vectors.select(group, F.posexplode(col).alias("place", "v")).groupBy(group, "place").agg(F.avg(F.col("v").cast("double")).alias("v"))


def context(hits: DataFrame) -> DataFrame:
    """One row: the payload of ranked hits (rank, members, score, summary), covered members and estimated tokens."""
    part = F.format_string("## Theme %d (notes: %d, score: %.3f)\n%s\n\n", F.col("rank").cast("int"), F.col("members").cast("int"), F.col("score"), F.col("summary"))
    gathered = hits.agg(F.sort_array(F.collect_list(F.struct("rank", part.alias("p")))).alias("parts"), F.coalesce(F.sum("members"), F.lit(0)).alias("covered"))
    payload = F.trim(F.regexp_replace(F.array_join(F.transform("parts", lambda x: x["p"]), ""), r"\n+$", ""))
    return gathered.select(payload.alias("payload"), "covered", T.token_estimate(payload).alias("tokens"))


def citations(answer: Column) -> dict[str, Column]:
    """Communities and notes an answer cites, each once, in order; malformed marks are left out."""
    return {"communities": F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(r"\[C(\d+)\]"), F.lit(1)), lambda x: x.cast("long"))), "notes": F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(r"\[N:([^\[\]]+)\]"), F.lit(1)), lambda x: F.trim(x)))}


def level_report(groups: DataFrame) -> DataFrame:
    """level, communities, members, mean size and largest of each level.  groups: level, members."""
    return groups.groupBy("level").agg(F.count(F.lit(1)).alias("communities"), F.sum("members").alias("members"), F.round(F.avg("members"), 6).alias("mean_size"), F.max("members").alias("largest"))


def meta_summaries(members: DataFrame, group: str, order: str, text: str, chunk: int = 12) -> DataFrame:
    """group, chunks, summary: members in chunks of so many, each chunk's texts joined, and the chunks' texts joined again."""
    placed = members.withColumn("__chunk", F.floor((F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1) / chunk))
    inner = placed.groupBy(group, "__chunk").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda x: x[text]), "; ").alias("__part"))
    outer = inner.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("__chunk", "__part"))).alias("__parts"))
    return outer.select(group, F.size("__parts").cast("long").alias("chunks"), F.array_join(F.transform("__parts", lambda x: F.concat(F.lit("["), x["__part"], F.lit("]"))), "\n").alias("summary"))


def answer_prompt(context_: Column, question: Column) -> Column:
    """What a chat model is asked, with the themes that it may cite."""
    return F.concat(F.lit("Answer from these themes and cite them as [C<number>].\n\n"), context_, F.lit("\n\nQuestion: "), question)


def summary_prompt(title: Column, entries: Column) -> Column:
    return F.concat(F.lit("Summarise these notes on "), title, F.lit(" in a few sentences.\n\n"), entries)
