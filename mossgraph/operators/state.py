"""Ordered state by key: moving averages, learning progress, debounced triggers and fact memory."""

from __future__ import annotations

import heapq
import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ordered, vector

#: Share of the old state that a step keeps.
ALPHA = 0.82
WINDOW = 32


def scaled(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 1e-9, F.transform(v, lambda x: x / norm)).otherwise(v)


def ema(rows: DataFrame, key: str, order: list[str], col: str, dim: int, alpha: float = ALPHA) -> DataFrame:
    """key, steps, state after all rows of the key in order: an ordered fold, since scaling makes each step depend on the last.

    A key's inputs are gathered into one row; the streaming form keeps only the state."""
    gathered = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, col))).alias("xs"))
    start = F.array_repeat(F.lit(0.0), dim)
    state = F.aggregate("xs", start, lambda h, x: scaled(F.zip_with(h, x[col], lambda a, b: a * alpha + b * (1 - alpha))))
    return gathered.select(key, F.size("xs").cast("long").alias("steps"), state.alias("state"))


def blended(state: Column, asked: Column, share: float = 0.5) -> Column:
    return scaled(F.zip_with(state, asked, lambda h, x: h * share + x * (1 - share)))


def learning_progress(rows: DataFrame, key: str, order: list[str], value: str, size: int = WINDOW, largest: int = ordered.LARGEST) -> DataFrame:
    """rows with progress: mean of the older half of the last ``size`` values less that of the newer, 0 until there are so many.

    Rows are numbered in their key first, so that a key's windows can be computed in blocks."""
    by = Window.partitionBy(key, "__block").orderBy("__tick")
    half = size // 2
    old, new = by.rowsBetween(-(size - 1), -half), by.rowsBetween(-(half - 1), 0)
    full = F.col("__tick") >= size - 1
    progress = F.when(full, F.avg(value).over(old) - F.avg(value).over(new)).otherwise(F.lit(0.0))
    ticks = ordered.ticked(rows, [key], order, "__tick", largest)
    return ordered.sliding(ticks, [key], size, {"progress": progress}, "__tick", max(size, ordered.BLOCK)).drop("__tick")


def debounced(rows: DataFrame, key: str, order: list[str], fires: str, gap: int, largest: int = ordered.LARGEST) -> DataFrame:
    """key, tick of each firing: a row that fires does so only ``gap`` ticks after the last firing of its key; the first
    is exempt.  Ticks number a key's rows from 0."""
    ticks = ordered.ticked(rows.select(key, *order, fires), [key], order, "tick", largest)
    return ordered.spaced(ticks.where(fires).select(key, "tick"), key, gap)


# -- facts

#: How a sentence about oneself begins, and what negates one; fixed values.
HEADS = ("i am ", "i'm ", "i like ", "i love ", "i hate ", "i prefer ", "i live ", "i work ", "i speak ", "i don't ", "i do not ", "i never ", "i no longer ", "i used to ", "my ")
NEGATIONS = (" not ", "n't ", " no ", " never ", " no longer ")
DUPLICATE, REFINED, CONTRARY = 0.92, 0.55, 0.45


def facts_in(text: Column) -> Column:
    """Sentences about oneself, in the writer's words."""
    parts = F.transform(F.split(text, r"[.!?\n]"), lambda s: F.trim(s))
    heads = "|".join(re.escape(h) for h in HEADS)
    return F.transform(F.filter(parts, lambda s: F.lower(s).rlike(f"^(?:{heads})")), lambda s: F.regexp_replace(s, r'[,"]+$', ""))


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def negated(text: str) -> bool:
    return any(n in f" {normal(text)} " for n in NEGATIONS)


def decide(candidate: str, neighbours: list[tuple[str, str, float]]) -> tuple[str, str | None]:
    """ADD, UPDATE, DELETE or NOOP with the fact it is about.  neighbours: (id, text, similarity), the most similar first."""
    same = next((i for i, text, _ in neighbours if normal(text) == normal(candidate)), None)
    if same is not None:
        return "NOOP", same
    contrary = next((i for i, text, sim in neighbours if sim >= CONTRARY and negated(text) != negated(candidate)), None)
    if contrary is not None:
        return "DELETE", contrary
    if neighbours:
        i, text, sim = neighbours[0]
        if sim >= DUPLICATE:
            return "NOOP", i
        if sim >= REFINED and len(candidate.encode()) > len(text.encode()):
            return "UPDATE", i
    return "ADD", None


def decided(candidate: Column, neighbours: Column) -> Column:
    """``decide`` as a column: struct of op and about.  neighbours: array of (id, text, sim), the most similar first."""
    plain = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))

    def negative(c: Column) -> Column:
        padded, out = F.concat(F.lit(" "), plain(c), F.lit(" ")), F.lit(False)
        for n in NEGATIONS:
            out = out | padded.contains(n)
        return out

    same = F.get(F.filter(neighbours, lambda n: plain(n["text"]) == plain(candidate)), F.lit(0))
    flips = F.get(F.filter(neighbours, lambda n: (n["sim"] >= CONTRARY) & (negative(n["text"]) != negative(candidate))), F.lit(0))
    first = F.get(neighbours, F.lit(0))
    made = lambda op, n: F.struct(F.lit(op).alias("op"), n.alias("about"))
    refined = (first["sim"] >= REFINED) & (F.octet_length(candidate) > F.octet_length(first["text"]))
    return F.when(same.isNotNull(), made("NOOP", same["id"])).when(flips.isNotNull(), made("DELETE", flips["id"])).when(first["sim"] >= DUPLICATE, made("NOOP", first["id"])).when(refined, made("UPDATE", first["id"])).otherwise(made("ADD", F.lit(None).cast("string")))


class Memory:
    """Facts of one key, in order: each candidate sees what the ones before it changed."""

    def __init__(self, nearest: int = 5, policy=decide):
        self.nearest, self.policy, self.facts, self.history, self.count = nearest, policy, {}, [], 0
        self.lengths: dict[str, float] = {}
        self.holders: dict[int, dict[str, int]] = {}  # facts by place, with their value there

    @staticmethod
    def _places(text: str) -> dict[int, int]:
        from ..functions.text import STOPWORDS

        words = [w for w in re.split(r"[\W_]+", text.lower()) if len(w.encode()) >= 2 and w not in STOPWORDS]
        return vector.places(words)

    def take(self, candidate: str) -> str:
        own = self._places(candidate)
        length = math.sqrt(sum(x * x for x in own.values()))
        # Facts that share a place are found by it; the others' similarity is nought.
        dots: dict[str, int] = {}
        for k, v in own.items():
            for i, w in self.holders.get(k, {}).items():
                dots[i] = dots.get(i, 0) + v * w
        near = [(i, dot / (length * self.lengths[i]) if length * self.lengths[i] else 0.0) for i, dot in dots.items()]
        if sum(sim > 0 for _, sim in near) < self.nearest:
            near += [(i, 0.0) for i in self.facts if i not in dots]
        near = [(i, self.facts[i][0], sim) for i, sim in heapq.nsmallest(self.nearest, near, key=lambda n: (-n[1], n[0]))]
        op, about = self.policy(candidate, near)
        before = self.facts[about][0] if about is not None else None
        if op == "ADD":
            about, self.count = f"f{self.count:06d}", self.count + 1
        if op in ("UPDATE", "DELETE"):
            for k in self.facts.pop(about)[1]:
                del self.holders[k][about]
        if op in ("ADD", "UPDATE"):
            self.facts[about], self.lengths[about] = (candidate, own), length
            for k, v in own.items():
                self.holders.setdefault(k, {})[about] = v
        self.history.append((about, op, before, candidate))
        return op


def remembered(messages: DataFrame, key: str, order: str, text: str, extract=facts_in, policy=decide) -> DataFrame:
    """key, step, fact_id, op, prev_text, new_text: each key's history of facts.  Strictly ordered within a key.

    extract makes candidates of a text column, policy decides on one by its neighbours (as ``decide`` does)."""
    import pandas as pd

    found = messages.select(F.col(key).cast("string").alias("key"), F.col(order).cast("long").alias("at"), F.posexplode(extract(F.coalesce(text, F.lit("")))).alias("part", "fact"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        memory = Memory(policy=policy)
        for fact in frame.sort_values(["at", "part", "fact"])["fact"]:
            memory.take(fact)
        return pd.DataFrame([(frame["key"].iloc[0], k, *h) for k, h in enumerate(memory.history)], columns=["key", "step", "fact_id", "op", "prev_text", "new_text"])

    return found.groupBy("key").applyInPandas(run, "key string, step long, fact_id string, op string, prev_text string, new_text string")


def current(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last event of each key, without those that deleted it: partial maxima before the shuffle, no sort."""
    rest = [c for c in events.columns if c != key]
    last = events.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("e"))
    return last.select(key, "e.*").where("op != 'DELETE'")
