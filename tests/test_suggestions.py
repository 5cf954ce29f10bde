"""Link suggestions on packed vectors: both ways against brute force, with planted pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mossgraph.operators import graph, hyper


@pytest.fixture(scope="module")
def planted(spark):
    """Notes in families that share most of their links and words, among notes that share little; one links a sibling."""
    rng = random.Random(5)
    edges, texts = set(), {}
    for family in range(24):
        targets = rng.sample(range(10_000, 14_000), 9)
        words = [f"w{rng.randrange(4000)}" for _ in range(6)]
        for member in range(3):
            note = family * 3 + member
            edges |= {(note, t) for t in rng.sample(targets, 6)}
            texts[note] = [rng.choice([w, f"x{rng.randrange(4000)}"]) for w in words]
    for note in range(72, 260):
        edges |= {(note, t) for t in rng.sample(range(10_000, 14_000), rng.choice([4, 6, 8]))}
        texts[note] = [f"w{rng.randrange(4000)}" for _ in range(5)]
    edges.add((0, 1))
    tokens = spark.createDataFrame(list(texts.items()), "id long, tokens array<string>")
    links = spark.createDataFrame(sorted(edges), "src long, dst long")
    vectors = graph.checkpointed(hyper.combined(hyper.encoded(tokens), links))
    return vectors, links, tokens, edges


def brute(vectors, edges, least, k):
    rows = sorted((r["id"], bytes(r["hv"])) for r in vectors.collect())
    ids = [i for i, _ in rows]
    dense = np.stack([hyper.unpacked(v).astype(np.int32) for _, v in rows])
    score = np.round(dense @ dense.T / hyper.DIM, 6)
    out = []
    for i, a in enumerate(ids):
        near = sorted((-score[i, j], b) for j, b in enumerate(ids) if b != a and score[i, j] >= least and (a, b) not in edges)
        out += [(a, b, -s) for s, b in near[:k]]
    return sorted(out, key=lambda x: (-x[2], x[0], x[1]))


@pytest.mark.parametrize("blocks", [1, 3])
def test_all_pairs_of_packed_vectors(planted, blocks):
    vectors, links, _, edges = planted
    found = hyper.packed_topk(vectors, 5, 0.18, links.select(F.col("src").alias("source"), F.col("dst").alias("target")), blocks=blocks)
    got = sorted(((r["source"], r["target"], r["score"]) for r in found.collect()), key=lambda x: (-x[2], x[0], x[1]))
    want = brute(vectors, edges, 0.18, 5)
    assert got == want and len(want) > 60 and (0, 1) not in {x[:2] for x in want} and (1, 0) in {x[:2] for x in want}


@pytest.mark.parametrize("exact", [True, False, None])
def test_suggestions_find_planted_pairs(planted, exact):
    vectors, links, tokens, edges = planted
    want = brute(vectors, edges, 0.18, 5)
    family = {x for x in want if x[0] // 3 == x[1] // 3 and x[0] < 72}
    assert len(family) > 60
    found = [(r["source"], r["target"], r["score"]) for r in hyper.suggestions(vectors, links, total=400, tokens=tokens, exact=exact).collect()]
    if exact:
        assert sorted(found) == sorted(want)
    # Candidates leave out what is similar by chance only.
    assert set(found) <= set(want) and family <= set(found)
    top = hyper.suggestions(vectors, links, total=7, tokens=tokens, exact=exact).collect()
    assert [(r["source"], r["target"], r["score"]) for r in sorted(top, key=lambda r: (-r["score"], r["source"], r["target"]))] == sorted(found, key=lambda x: (-x[2], x[0], x[1]))[:7]
    near = {n: {b for a, b in edges if a == n} | {a for a, b in edges if b == n} for n in range(260)}
    assert all(r["shared"] == len(near[r["source"]] & near[r["target"]]) for r in top)


def test_candidates_reach_every_pair_of_their_cosine(planted):
    _, links, tokens, _ = planted
    weights = hyper.features(links, tokens)
    rows = {}
    for r in weights.collect():
        rows.setdefault(r["id"], {})[tuple(r["feature"])] = r["weight"]
    least = hyper.margin(0.18)
    want = {(a, b) for a in rows for b in rows if a < b and sum(w * rows[b].get(f, 0) for f, w in rows[a].items()) >= least + 1e-9}
    got = {(r["a"], r["b"]) for r in hyper.candidates(weights, hyper.prefixed(weights, least), least).collect()}
    assert want <= got and len(got) <= len(want) + 3 and len(want) > 30


def test_streams_are_those_of_single_seeds():
    seeds = [0, 1, 2**64 - 1, 77]
    many = hyper.chacha_streams(seeds, 1000)
    assert (many == np.stack([hyper.chacha_words(s, 1000) for s in seeds])).all() and hyper.chacha_streams([], 10).shape == (0, 10)


@pytest.mark.parametrize("remembered", [1, 64 << 20])
@pytest.mark.parametrize("dim", [200, 10_000])
def test_neighbourhoods_are_sums_of_the_notes_vectors(monkeypatch, remembered, dim):
    monkeypatch.setattr(hyper, "REMEMBERED", remembered)
    out, into = [[3, 9, 9], None, [5] * 300, []], [[9], [1, 2], None, []]
    vector = lambda n: hyper.random_vector(hyper.T.fnv1a(f"note:{n}"), dim).astype(int)
    found = np.full((4, dim), 99)
    for lo, hi, k, sums in hyper.neighbourhoods(out, into, dim):
        found[k, lo:hi] = sums
    zero = np.zeros(dim, dtype=int)
    want = [sum(map(vector, o or []), zero) + hyper.permute(sum(map(vector, i or []), zero)) for o, i in zip(out, into)]
    assert (found == np.stack(want)).all()


def test_a_note_is_bundled_with_its_links(spark, monkeypatch):
    """With hubs and without: the sign of the text's vector, the linked notes' and the shifted linking notes'."""
    edges = [(1, 2), (1, 3), (3, 1), (4, 1), (5, 1)] + [(6, n) for n in range(10, 40)]
    texts = hyper.encoded(spark.createDataFrame([(n, ["a", f"t{n}"]) for n in range(1, 9)], "id long, tokens array<string>"), dim=320)
    own = {r["id"]: hyper.unpacked(r["hv"], 320).astype(int) for r in texts.collect()}
    vector = lambda n: hyper.random_vector(hyper.T.fnv1a(f"note:{n}"), 320).astype(int)
    for hub in (20_000, 8):
        monkeypatch.setattr(hyper, "HUB", hub)
        found = {r["id"]: hyper.unpacked(r["hv"], 320) for r in hyper.combined(texts, spark.createDataFrame(edges, "src long, dst long"), 320).collect()}
        for n, text in own.items():
            total = text + sum(vector(b) for a, b in edges if a == n) + hyper.permute(sum((vector(a) for a, b in edges if b == n), np.zeros(320, dtype=int)))
            assert (found[n] == np.where(total >= 0, 1, -1)).all()
        assert set(found) == set(own)


def test_packed_texts_are_text_vectors():
    for dim in (100, 10_000):
        words, tokens = hyper.Words(dim, 3), hyper.Tokens(dim)
        for text in ([], ["a"], ["a", "b"], ["a", "a", "b", "c", "a", "d"] * 60):
            assert words.text(text) == hyper.packed(hyper.text_vector(text, tokens))


@pytest.mark.parametrize("features", [500, 10**6])
def test_candidates_of_blocks(planted, features):
    """As by brute force, whatever is kept and however many blocks there are."""
    _, links, tokens, _ = planted
    weights = hyper.features(links, tokens)
    rows = {}
    for r in weights.collect():
        rows.setdefault(r["id"], {})[tuple(r["feature"])] = r["weight"]
    least = hyper.margin(0.18)
    want = {(a, b) for a in rows for b in rows if a < b and sum(w * rows[b].get(f, 0) for f, w in rows[a].items()) >= least + 1e-9}
    got = [tuple(r) for r in hyper.candidates(weights, hyper.prefixed(weights, least / 2), least, features=features).collect()]
    assert want <= set(got) and len(got) == len(set(got)) <= len(want) + 3


def test_majorities_are_signs_of_sums(monkeypatch):
    """Of no row, of one, of even numbers (ties), and of more rows than are added up."""
    rng = np.random.default_rng(2)
    table = hyper.in_words(rng.integers(0, 256, (50, 40)).astype(np.uint8))
    sizes = np.array([0, 1, 2, 3, 7, 8, 64, 300])
    index = rng.integers(0, 50, sizes.sum())
    bits = np.unpackbits(table.view(np.uint8), axis=1, bitorder="little").astype(int) * 2 - 1
    for counted in (4_096, 5):
        monkeypatch.setattr(hyper, "COUNTED", counted)
        for own in (None, table[10:18]):
            found = np.unpackbits(hyper.majority(table, sizes, index, own).view(np.uint8), axis=1, bitorder="little")
            for n, rows in enumerate(np.split(index, np.cumsum(sizes)[:-1])):
                total = bits[rows].sum(axis=0) + (0 if own is None else bits[10 + n])
                assert (found[n] == (total >= 0)).all()


@pytest.mark.parametrize("ends", [8, 10**6])
@pytest.mark.parametrize("dim", [100, 320])
def test_blocks_of_notes_give_the_same_vectors(spark, monkeypatch, ends, dim):
    """As over edges, whether blocks need others' notes or not; texts without links, links to what has no text."""
    from mossgraph.operators import blocks

    monkeypatch.setattr(hyper, "REMEMBERED", 200)  # ranges of 64 places
    groups = spark.createDataFrame([(g, (g * g + k * (1 + g % 3)) % 23) for g in range(14) for k in range(1 + g % 4)], "g long, n long")
    tokens = spark.createDataFrame([(n, ["a", f"t{n}"][: n % 3]) for n in range(3, 30)], "id long, tokens array<string>")
    made = blocks.dealt(blocks.sets_of(groups, "g", "n"), ends=ends)
    want = {r["id"]: bytes(r["hv"]) for r in hyper.combined(hyper.encoded(tokens, dim=dim), graph.group_pairs(groups, "g", "n").distinct(), dim).collect()}
    found = [(r["id"], bytes(r["hv"])) for r in hyper.over_blocks(made, tokens, dim).collect()]
    assert made.closed == (ends > 8) and len(found) == len(want) and dict(found) == want


def test_pairs_in_closed_blocks(spark):
    """All that brute force over features finds, within blocks and between those, by links, by texts and by both; and which are linked."""
    from mossgraph.operators import blocks

    rng = random.Random(9)
    groups = [(g, 100 * (g % 3) + n) for g in range(60) for n in rng.sample(range(30), 4)]
    groups += [(1000 + k * 10 + e, 100 * k + n) for k in range(3) for e in range(5) for n in (40, 60 + e)] + [(1000 + k * 10 + e, 100 * k + 41) for k in range(3) for e in range(5)]
    texts = {n: [f"w{rng.randrange(30)}" for _ in range(4)] for n in [*range(0, 30), *range(100, 130), 240, 241]}
    texts |= {n: ["same", "words", f"x{n // 2}"] for n in (90, 91, 190, 191, 290, 291)}  # without links
    tokens = spark.createDataFrame([*texts.items(), (299, [])], "id long, tokens array<string>")
    items = spark.createDataFrame(groups, "g long, n long")
    edges = graph.group_pairs(items, "g", "n").distinct()
    made = blocks.dealt(blocks.sets_of(items, "g", "n"))
    assert made.closed and made.held.count() == 6
    rows = {}
    for r in hyper.features(edges, tokens).collect():
        rows.setdefault(r["id"], {})[tuple(r["feature"])] = r["weight"]
    linked = {tuple(r) for r in edges.collect()}
    for least in (0.2, 0.45):
        want = {(a, b) for a in rows for b in rows if a < b and sum(w * rows[b].get(f, 0) for f, w in rows[a].items()) >= least + 1e-9}
        found = [tuple(r) for r in hyper.candidates_of_blocks(made, tokens, least).collect()]
        assert want <= {x[:2] for x in found} and len(found) == len({x[:2] for x in found})
        assert all(x[2] == (x[:2] in linked) for x in found)
    assert (40, 41) in want and (90, 91) in want and (90, 190) in want
    vectors = hyper.over_blocks(made, tokens)
    best = {(r["source"], r["target"]) for r in hyper.suggestions(vectors, edges, tokens=tokens, made=made).collect()}
    assert best and best.isdisjoint(linked) and {(90, 91), (191, 190)} <= best
