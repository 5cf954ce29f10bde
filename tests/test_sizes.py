"""What may not grow with the rows: files, batches, passes over the texts."""

import glob
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from mossgraph import catalog
from mossgraph.functions import markdown
from mossgraph.operators import graph, postings, pull, state, vector
from mossgraph.plans import vaults
from mossgraph.sources import files as sources
from mossgraph.sources import store


def test_notes_need_few_files(spark, tmp_path):
    notes = spark.range(500).select(F.concat(F.lit("2024-01-0"), (F.col("id") % 3 + 1).cast("string")).alias("day"), F.concat(F.col("id").cast("string"), F.lit(".md")).alias("name"), F.concat(F.lit("a\n\nb "), F.col("id").cast("string"), F.lit("\n")).alias("text"))
    store.write_notes(notes, f"{tmp_path}/notes")
    assert len(glob.glob(f"{tmp_path}/notes/**/*.parquet", recursive=True)) <= 3 * 4
    assert sorted(map(tuple, store.read_notes(spark, f"{tmp_path}/notes").collect())) == sorted(map(tuple, notes.collect()))
    some = notes.where("name IN ('1.md', '2.md')")
    store.note_files(some, f"{tmp_path}/vault")
    found = sources.vault(spark, f"{tmp_path}/vault", endings=".txt").select("content").collect()
    assert sorted(r["content"] for r in found) == sorted(r["text"] for r in some.collect())


def test_the_index_shuffles_texts_once(spark, tmp_path):
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.concat_ws("\n", F.lit("one two two"), F.lit(" "), F.concat(F.lit("word"), F.col("id").cast("string"))).alias("text"))
    rows = postings.rows_of(docs)
    assert rows._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    postings.updated(spark, f"{tmp_path}/index", docs)
    postings.updated(spark, f"{tmp_path}/index", docs.where("doc_id = 5").withColumn("text", F.lit("two")))
    index = postings.opened(spark, f"{tmp_path}/index")
    assert sorted(map(tuple, index.where("term = 'two'").groupBy("chunk").agg(F.sum("n"), F.max("most_tf")).collect())) == [(0, 256, 2), (1, 256, 2), (2, 88, 2)]
    assert index.where("term = 'word5'").count() == 0 and index.where("term = 'word6'").count() == 1


def test_hashed_scores_of_odd_tokens(spark):
    rows = [["ab", "ab", "cd"], [], ["ü" * 40, "x", "🙂"], ["one"], ["one", "two", "one", "two"]]
    frame = spark.createDataFrame(list(enumerate(rows)), "id long, tokens array<string>")
    asked = vector.places(["one", "two"])
    for r in vector.query_scores(frame, ["one", "two"]).collect():
        own = vector.places(rows[r["id"]])
        dot = sum(v * own.get(k, 0) for k, v in asked.items())
        assert r["score"] == (dot / (math.sqrt(sum(v * v for v in own.values())) * math.sqrt(sum(v * v for v in asked.values()))) if dot else 0)


def test_a_vault_query_reads_what_it_needs(spark, sf):
    catalog.bound(spark)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 8 << 20
    plan = vaults.vault_read(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "InPandas" not in plan and "ArrowEval" not in plan and "Scan ExistingRDD" not in plan
    plan = vaults.vault_blocks(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_words_that_a_reader_sees():
    assert markdown.visible_words("# A *b* -- c's\n\n| x | - |\n|---|---|\n| 1 | ü |\n\n> q … r\n") == 8


def test_facts_find_neighbours_by_their_places():
    memory = state.Memory()
    for k in range(50):
        memory.take(f"I like thing{k}")
    memory.take("I do not like thing7")
    assert memory.history[-1][1] == "DELETE" and memory.history[-1][2] == "I like thing7" and len(memory.facts) == 49
    assert set(memory.lengths) >= set(memory.facts) and all(set(h) <= set(memory.facts) for h in memory.holders.values())


def test_all_pairs_with_ties_and_odd_vectors(spark):
    rows = [(i, [float(i % 3), 1.0]) for i in range(40)] + [(90, [0.0, 0.0]), (91, [float("nan"), 1.0])]
    found = vector.all_pairs_topk(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 4, blocks=3).collect()
    for r in (r for r in found if r["source"] == 0):
        assert r["score"] == 1 and r["target"] == 3 * r["rank"]
    assert len([r for r in found if r["source"] == 0]) == 4 and not [r for r in found if 91 in (r["source"], r["target"])]


@pytest.mark.parametrize("far", [1, 1 << 36])
@pytest.mark.parametrize("ends", [200, 10**6])
def test_shared_neighbours_of_blocks(spark, monkeypatch, ends, far):
    """Repeated edges and queries, hubs, nodes without edges and nulls; one block and many; near ids and far ones."""
    monkeypatch.setattr(graph, "BLOCK_ENDS", ends, raising=False)
    rng = random.Random(2)
    edges = [(rng.randrange(60) * far, rng.randrange(60) * far) for _ in range(300)] + [(7 * far, n * far) for n in range(60)]
    edges += edges[:40] + [(None, 3 * far), (65_537 * far, 0)]
    query = [(rng.randrange(-2, 70) * far, rng.randrange(-2, 70) * far) for _ in range(500)] + [(7 * far, 8 * far)] * 2 + [(None, 3 * far), (0, 65_537 * far), (10**7 * far, 0)]
    near = Counter()
    for a, b in edges:
        if a is not None:
            near[a, b] += 1
            near[b, a] += 1
    of = lambda a: {n for x, n in near if x == a}
    want = [(a, b, sum(near[b, n] for n in of(a))) for a, b in query]
    frames = spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame(query, "a long, b long")
    for few in (False, True):
        assert Counter(map(tuple, graph.shared_neighbours(*frames, few=few).collect())) == Counter(want)


def test_rounds_make_no_row_for_each_end(spark):
    """Labels by brute force, with several blocks; repeated edges, loops and ends that are no nodes; no join has the edges' ends."""
    rng = random.Random(4)
    edges = [(rng.randrange(70), rng.randrange(70)) for _ in range(400)] + [(1, 900), (900, 901), (5, 5)]
    nodes = [n for n in range(72) if n != 33]
    label = {n: n for n in nodes}
    for _ in range(3):
        votes = {n: Counter() for n in nodes}
        for a, b in edges:
            if a != b and a in label and b in label:
                votes[a][label[b]] += 1
                votes[b][label[a]] += 1
        label = {n: min(v, key=lambda x: (-v[x], x)) if v else label[n] for n, v in votes.items()}
    frames = spark.createDataFrame([(n,) for n in nodes], "id long"), spark.createDataFrame(edges, "src long, dst long")
    for size in (pull.BLOCK_ENDS, 150):
        made = pull.dealt(frames[0], graph.both_ways(graph.undirected(frames[1])), ends=size)
        assert made.blocks == (1 if size > 150 else 6) and made.lists.count() == len(nodes)
        found = graph.label_propagation(*frames, 3, ends=size)
        assert dict(map(tuple, found.collect())) == label


@pytest.mark.parametrize("of", ["float", "double"])
def test_all_pairs_pass_by_each_block_once(spark, monkeypatch, of):
    """As by brute force, whatever the blocks, cells and slices; links left out; a row is sent once to each block of sources."""
    monkeypatch.setattr(vector, "CELL_ROWS", 16)
    monkeypatch.setattr(vector, "SLICE_ROWS", 70)
    rng = np.random.default_rng(4)
    v = np.round(rng.standard_normal((150, 5)), 1).astype("f4" if of == "float" else "f8")
    v[20:40] = v[:20]
    frame = spark.createDataFrame([(i, v[i].tolist()) for i in range(150)] + [(999, None)], f"vec_id long, embedding array<{of}>")
    linked = {(a, b) for a in range(0, 150, 2) for b in range(0, 60, 3)}
    unit = v.astype(float) / np.sqrt((v.astype(float) ** 2).sum(axis=1, keepdims=True))
    score = np.round(unit @ unit.T, 6)
    for links in (set(), linked):
        want = {(a, b, s) for a in range(150) for s, b in [(-s, b) for s, b in sorted((-score[a, b], b) for b in range(150) if a != b and (a, b) not in links and score[a, b] >= -0.2)[:4]]}
        for blocks in (1, 4):
            given = spark.createDataFrame(sorted(links), "source long, target long") if links else None
            found = vector.all_pairs_topk(frame, 4, -0.2, blocks=blocks, linked=given).collect()
            assert {(r["source"], r["target"], r["score"]) for r in found} == want and len(found) == len(want)


def test_an_update_takes_some_segments_at_a_time(spark, tmp_path, monkeypatch):
    """Each group sees its own segments only, and what it kept is gone afterwards; rows are those of an index built at once."""
    monkeypatch.setattr(postings, "GROUP", 2)
    texts = {n: f"one w{n % 7}\ntwo w{n % 3}" for n in [*range(0, 40), *range(4090, 4110), *range(9000, 9010), *range(20_000, 20_010), *range(40_000, 40_004)]}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    postings.updated(spark, f"{tmp_path}/index", docs)
    changed = {5: "", 4096: "new\nwords", 9001: None, 20_003: "one", 50_000: "one more", 60_000: ""}
    seen, rewritten = [], postings._rewritten
    monkeypatch.setattr(postings, "_rewritten", lambda s, p, i, d: (seen.append({r["doc_id"] // postings.SEGMENT for r in d.collect()}), rewritten(s, p, i, d)))
    postings.updated(spark, f"{tmp_path}/index", spark.createDataFrame([*changed.items(), (None, "x")], "doc_id long, text string"))
    assert len(seen) >= 3 and sum(map(len, seen)) == len(set().union(*seen)) == len({n // postings.SEGMENT for n in changed})
    postings.updated(spark, f"{tmp_path}/whole", spark.createDataFrame(list((texts | changed).items()), "doc_id long, text string"))
    of = lambda name: sorted(map(str, postings.opened(spark, f"{tmp_path}/{name}").select(*postings.COLUMNS).collect()))
    assert of("index") == of("whole")
    folder = graph.shared_folder(spark).removeprefix("file:")
    assert not glob.glob(f"{folder}/index-update-*")
