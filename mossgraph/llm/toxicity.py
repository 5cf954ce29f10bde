"""Toxicity by nearest labelled examples.

Examples are labelled texts; terms are words, the first letters of long words (``stem*``), and first letters that several
different words of the text share (``stem**``), since one such word may be chance where three are a theme.  The vocabulary
is the terms that go with label 1: of V different terms in the examples, those at least LIFT times as frequent there whose log-likelihood ratio
exceeds 2 ln V, the level that chance alone is expected not to reach among so many.  (Cosine over all terms, and over the
terms of both labels, was tried: it mostly finds texts of the same language and matter, see the README.)  Inverse document frequencies are over all documents.  A text's nearest examples by exact TF-IDF
cosine come from an inverted index whose postings are cut into blocks of examples, each with the largest weight of the
term in it: blocks are scored in the order of their upper bounds until no bound exceeds the worst of the neighbours found.
Neighbours vote with weights that fall with their distance, and an isotonic fit over the examples' own leave-one-out votes
calibrates the score.

Defined results: null and empty texts, and texts with none of the terms, get the calibrated rate of examples without any;
a null identifier is neither held out nor learnt from; identifiers are of any type; a document that is labelled twice
counts with its larger label, one that occurs with several texts as an example with the smallest, null labels don't
count; equal texts count once as examples; repeated rows repeat; empty labels give score 0 to all; an empty table gives an
empty table; ``without_toxic`` passes all columns through by place, whatever their names."""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, for_python, positional, tidy

#: Bound of the fitted sample: most labelled rows of each label that become examples.
EXAMPLES = 6_000
#: How many times as frequent a term is in examples of label 1 at least.
LIFT = 2
NEIGHBOURS, BLOCK = 15, 64
#: First letters of longer words that are a term of their own.
STEM = 5
THRESHOLD = 0.7
#: Term counts that a worker hands on at once.
PAIRS = 50_000

_WORDS = re.compile(r"\w+").findall


def terms_of(text: str | None) -> Counter:
    counts = Counter(_WORDS((text or "").lower()))
    shared = sharing(counts)
    for word, n in list(counts.items()):
        if len(word) > STEM:
            counts[word[:STEM] + "*"] += n
    counts.update({stem + "**": n for stem, n in shared.items() if n > 1})
    return counts


def sharing(words, stems: frozenset | None = None) -> Counter:
    """How many of the different words have each stem (of those asked for)."""
    return Counter(w[:STEM] for w in words if len(w) > STEM and (stems is None or w[:STEM] in stems))


@dataclass
class Model:
    """A block-max index over the examples, and the calibration."""

    terms: dict[str, int] = field(default_factory=dict)
    stems: frozenset = frozenset()
    idf: np.ndarray = field(default_factory=lambda: np.zeros(0))
    labels: np.ndarray = field(default_factory=lambda: np.zeros(0))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    ids: list = field(default_factory=list)
    #: By term: examples (ascending), their weights, where each block begins in them, and each block's largest weight.
    postings: list = field(default_factory=list)
    bounds: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    steps: tuple = ((), ())
    without: float = 0.0
    prior: float = 0.0

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Terms of a text and their weights, of length 1."""
        found: dict[int, int] = {}
        terms, stems = self.terms, self.stems
        words = _WORDS((text or "").lower())
        different = set(words)
        for word in different & terms.keys():
            found[terms[word]] = words.count(word)
        for word in [w for w in different if w[:STEM] in stems and len(w) > STEM]:
            if (t := terms.get(word[:STEM] + "*")) is not None:
                found[t] = found.get(t, 0) + words.count(word)
        for stem, n in sharing(different, stems).items():
            if n > 1 and (t := terms.get(stem + "**")) is not None:
                found[t] = n
        if not found:
            return np.zeros(0, dtype=np.int64), np.zeros(0)
        at = np.fromiter(sorted(found), dtype=np.int64)
        weight = (1 + np.log([found[t] for t in at.tolist()])) * self.idf[at]
        return at, weight / math.sqrt((weight**2).sum())

    def nearest(self, at: np.ndarray, weight: np.ndarray, k: int = NEIGHBOURS, skip: int = -1) -> list[tuple[float, int]]:
        """The k largest cosines and their examples, exactly (of equal cosines the smallest examples)."""
        upper = weight @ self.bounds[at]
        heap: list[tuple[float, int]] = []
        for block in np.argsort(-upper, kind="stable").tolist():
            if upper[block] <= 0 or len(heap) == k and upper[block] < heap[0][0] - 1e-12:
                break
            scores = np.zeros(BLOCK)
            for t, w in zip(at.tolist(), weight.tolist()):
                examples, values, begins = self.postings[t]
                a, b = begins[block], begins[block + 1]
                if a < b:
                    scores[examples[a:b] - block * BLOCK] += w * values[a:b]
            for j in np.flatnonzero(scores).tolist():
                example = block * BLOCK + j
                entry = (round(float(scores[j]), 12), -example)
                if example == skip:
                    continue
                if len(heap) < k:
                    heapq.heappush(heap, entry)
                elif entry > heap[0]:
                    heapq.heapreplace(heap, entry)
        return [(s, -e) for s, e in sorted(heap, reverse=True)]

    def vote(self, near: list[tuple[float, int]]) -> float:
        """Votes fall with distance; one vote's worth of doubt goes to the prior."""
        total, toxic = 1.0, self.prior
        for cosine, example in near:
            w = self.weights[example] / (0.05 + max(0.0, 1 - cosine))
            total += w
            toxic += w * self.labels[example]
        return toxic / total

    def calibrated(self, vote: float) -> float:
        places, values = self.steps
        return float(np.interp(vote, places, values)) if len(places) else vote

    def score(self, text: str | None) -> tuple[float, list[tuple[float, int]]]:
        at, weight = self.vector(text)
        if not len(at):
            return self.without, []
        near = self.nearest(at, weight)
        return self.calibrated(self.vote(near)), near


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending fit by pooling adjacent violators: places and values to interpolate between."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for a, b, c in zip(x[order].tolist(), y[order].tolist(), w[order].tolist()):
        pools.append([b * c, c, a, a])
        while len(pools) > 1 and (pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1] or pools[-2][3] == pools[-1][2]):
            s, n, low, high = pools.pop()
            pools[-1] = [pools[-1][0] + s, pools[-1][1] + n, pools[-1][2], high]
    places = [p for q in pools for p in (q[2], q[3])]
    return np.array(places), np.array([q[0] / q[1] for q in pools for _ in (0, 1)])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", examples: int = EXAMPLES) -> Model:
    """Learn from labelled rows that aren't held out: at most ``examples`` of each label, chosen by a hash of the identifier.

    The sample, its terms and so the index are bounded by the parameters; document frequencies are over all rows."""
    labels = labels.select(id_col, label)
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label).alias("label")).where(~held_out(F.col(id_col)))
    known = known.withColumn("label", (F.col("label") > 0).cast("int"))
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    chosen = None
    for value in sizes:
        part = known.where(F.col("label") == value).orderBy(F.xxhash64(id_col), id_col).limit(examples)
        chosen = part if chosen is None else chosen.unionByName(part)
    if chosen is None:
        return Model()
    # One text for each chosen identifier, and one identifier for each text: as many rows as the sample at most.
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    single = texts.join(F.broadcast(chosen.select(F.col(id_col).alias("id"), "label")), "id").groupBy("id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
    picked = cut(single.groupBy("text").agg(F.min("id").alias("id"), F.max("label").alias("label")))
    rows = picked.select("id", "label").toPandas().sort_values("id", ignore_index=True)
    if not len(rows):
        return Model()
    n1, n0 = int(rows["label"].sum()), int((1 - rows["label"]).sum())
    if not n1 or not n0:
        return Model(prior=float(n1 > 0), without=float(n1 > 0))
    kind = picked.schema["id"].dataType.simpleString()

    def counted(batches):
        for batch in batches:
            at, names, ns = [], [], []
            for k, text in enumerate(batch.column(2)):
                bag = terms_of(text.as_py())
                at += [k] * len(bag)
                names += bag
                ns += bag.values()
                if len(at) >= PAIRS or k + 1 == batch.num_rows:
                    places = pa.array(at, pa.int64())
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(places), batch.column(1).take(places), pa.array(names, pa.string()), pa.array(ns, pa.int64())], ["id", "label", "term", "n"])
                    at, names, ns = [], [], []

    counts = cut(for_python(picked, F.col("id"), F.col("label"), F.col("text")).mapInArrow(tidy(counted), f"id {kind}, label int, term string, n long"))
    by_term = counts.groupBy("term").agg(F.sum("label").cast("double").alias("a"), F.sum(1 - F.col("label")).cast("double").alias("b"))
    n = float(n1 + n0)

    def part(seen, total_row, total_column):
        return F.when(seen > 0, seen * F.log(seen * n / (total_row * total_column))).otherwise(0.0)

    a, b = F.col("a"), F.col("b")
    ratio = 2 * (part(a, a + b, F.lit(float(n1))) + part(b, a + b, F.lit(float(n0))) + part(n1 - a, n - a - b, F.lit(float(n1))) + part(n0 - b, n - a - b, F.lit(float(n0))))
    tested = cut(by_term.withColumn("g", ratio))
    level = 2 * math.log(max(2, tested.count()))
    chosen_terms = tested.where((F.col("g") >= level) & (a * n0 > LIFT * b * n1)).select("term")
    vocabulary = sorted(r["term"] for r in chosen_terms.collect())
    terms = {t: i for i, t in enumerate(vocabulary)}
    stems = frozenset(t.rstrip("*") for t in vocabulary if t.endswith("*"))
    bag = counts.join(F.broadcast(chosen_terms), "term").select("id", "term", "n").toPandas()

    def frequencies(batches):
        seen, total = np.zeros(len(vocabulary), dtype=np.int64), 0
        for batch in batches:
            total += batch.num_rows
            for text in batch.column(0):
                words = set(_WORDS((text.as_py() or "").lower()))
                here = words & terms.keys()
                for stem, n in sharing(words, stems).items():
                    here |= {t for t in (stem + "*", stem + "**")[: 1 + (n > 1)] if t in terms}
                for t in here:
                    seen[terms[t]] += 1
        found = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *found.tolist()], pa.int64()), pa.array([total, *seen[found].tolist()], pa.int64())], ["term", "n"])

    df = for_python(docs, F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(frequencies), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    seen = {r["term"]: r["n"] for r in df}
    idf = np.array([math.log((1 + seen.get(-1, 0)) / (1 + seen.get(i, 0))) + 1 for i in range(len(vocabulary))])
    return built(terms, stems, idf, rows, bag, {1: sizes.get(1, 0) / n1, 0: sizes.get(0, 0) / n0})


def built(terms: dict[str, int], stems: frozenset, idf: np.ndarray, rows: pd.DataFrame, bag: pd.DataFrame, weight: dict[int, float]) -> Model:
    """The index: examples without any term stay out of it and give the rate of texts without any."""
    bag = bag.assign(t=bag["term"].map(terms).astype("int64"), w=lambda x: (1 + np.log(x["n"].astype(float))) * idf[x["term"].map(terms).astype("int64")]) if len(bag) else bag.assign(t=[], w=[])
    bag = bag.assign(w=bag["w"] / np.sqrt((bag["w"] ** 2).groupby(bag["id"]).transform("sum"))) if len(bag) else bag
    label = dict(zip(rows["id"], rows["label"]))
    strongest = bag.sort_values(["id", "w", "t"], ascending=[True, False, True]).groupby("id")["t"].first() if len(bag) else {}
    with_any = sorted(strongest.keys(), key=lambda i: (strongest[i], label[i], i)) if len(bag) else []
    place = {i: k for k, i in enumerate(with_any)}
    labels = np.array([label[i] for i in with_any], dtype=float)
    weights = np.array([weight[label[i]] for i in with_any], dtype=float)
    rest = [label[i] for i in rows["id"] if i not in place]
    mass = sum(weight[y] for y in rest)
    every = sum(weight[y] for y in rows["label"])
    prior = sum(weight[1] for y in rows["label"] if y) / every
    without = (sum(weight[y] for y in rest if y) + prior) / (mass + 1)
    blocks = -(-len(with_any) // BLOCK)
    postings, bounds = [], np.zeros((len(terms), blocks))
    by_term = dict(tuple(bag.groupby("t"))) if len(bag) else {}
    for t in range(len(terms)):
        part = by_term.get(t)
        at = np.array([place[i] for i in part["id"]], dtype=np.int64) if part is not None else np.zeros(0, dtype=np.int64)
        values = part["w"].to_numpy() if part is not None else np.zeros(0)
        order = np.argsort(at)
        at, values = at[order], values[order]
        begins = np.searchsorted(at, np.arange(blocks + 1) * BLOCK)
        np.maximum.at(bounds[t], at // BLOCK, values)
        postings.append((at, values, begins))
    model = Model(terms, stems, idf, labels, weights / weights.mean() if len(weights) else weights, list(with_any), postings, bounds, without=float(without), prior=float(prior))
    if len(with_any):
        grouped = {k: (g["t"].to_numpy()[np.argsort(g["t"].to_numpy())], g["w"].to_numpy()[np.argsort(g["t"].to_numpy())]) for k, g in bag.groupby("id")}
        votes = np.array([model.vote(model.nearest(*grouped[i], skip=k)) for k, i in enumerate(with_any)])
        model.steps = isotonic(votes, labels, weights)
    return model


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", evidence: int = 3) -> DataFrame:
    """doc_id, held_out, score, predicted and evidence (identifiers of the nearest examples) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def each(batches):
        model = shared.value
        for batch in batches:
            scores, shown = [], []
            for text in batch.column(1):
                score, near = model.score(text.as_py())
                scores.append(min(1.0, max(0.0, score)))
                shown.append([model.ids[e] for _, e in near[:evidence]])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(shown, pa.list_(batch.column(0).type))], ["doc_id", "score", "evidence"])

    scored = for_python(docs, F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(each), f"doc_id {kind}, score double, evidence array<{kind}>")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs, whole, whose score is below the threshold."""
    moved, names = positional(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = names.index(text_col)

    def each(batches):
        model = shared.value
        for batch in batches:
            yield batch.filter(pa.array([model.score(t.as_py())[0] < THRESHOLD for t in batch.column(place)], pa.bool_()))

    return for_python(moved, F.col("*")).mapInArrow(tidy(each), moved.schema).toDF(*names)
