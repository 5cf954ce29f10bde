"""The engine's own operators against known answers and against their SQL."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from mossgraph import catalog
from mossgraph.functions import links as L
from mossgraph.functions import markdown, media
from mossgraph.functions import text as T
from mossgraph.operators import communities, fulltext, graph, hyper, kernels, links, mutations, partitions, state, telemetry, vector
from mossgraph.plans import api
from mossgraph.sources import files as sources
from mossgraph.streaming import jobs

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(rows, columns):
    def one(v):
        if v is None or isinstance(v, float) and v != v:
            return "~"
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, float):
            return f"{v:.5g}" if v != int(v) else str(int(v))
        return str(v)

    return sorted(tuple(one(r[c]) for c in columns) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_like_its_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(catalog.oracle_sql()[name])
    columns = sorted(want.columns)
    rows = [dict(zip(want.columns, r)) for r in want.fetchall()]
    found = catalog.queries()[name](spark, sf)
    assert sorted(found.columns) == columns
    assert canonical([r.asDict() for r in found.collect()], columns) == canonical(rows, columns)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_runs(spark, sf, name):
    """Queries without SQL: rows of the size that their tables give, columns that hold something."""
    rows = catalog.queries()[name](spark, sf).collect()
    parts = spark.read.parquet(f"{sf}/part.parquet").count()
    if name == "leiden":
        assert {r["id"] for r in rows if r["level"] == 0} == set(range(parts)) or len({r["id"] for r in rows}) == parts
    elif name == "layout":
        assert len(rows) == parts and all(abs(r["x"]) <= 500 and abs(r["y"]) <= 500 for r in rows) and len({(r["x"], r["y"]) for r in rows}) > parts // 2
    elif name == "hdc_related":
        assert len(rows) == 20 and all(-1 <= r["score"] <= 1 for r in rows) and [r["score"] for r in rows] == sorted((r["score"] for r in rows), reverse=True)
    elif name == "hdc_suggest":
        assert all(r["score"] >= 0.18 and r["source"] != r["target"] for r in rows)
    elif name in ("vsa_recall", "fhrr_recall"):
        assert rows and sum(r["recovered"] for r in rows) >= 0.5 * sum(r["pairs"] for r in rows)
    elif name == "memory_ingest":
        assert {r["op"] for r in rows} >= {"ADD"} and all(r["new_text"] for r in rows)
    else:
        assert rows


def test_hashes_and_tokens(spark):
    row = spark.range(1).select(*[T.fnv1a_hex(T.fnv1a_halves(F.lit(v))).alias(n) for n, v in (("a", "foobar"), ("b", "a"), ("c", "äß x"), ("d", ""))], T.tokens(F.lit("Größe ä 12 the Fox_jumps—x")).alias("t")).first()
    assert list(row)[:4] == ["85944171f73967e8", "af63dc4c8601ec8c", "104f40fef2b8cdbc", "cbf29ce484222325"]
    assert row["t"] == ["größe", "ä", "12", "fox", "jumps"]
    assert T.fnv1a("foobar") == 0x85944171F73967E8


def test_embeddings(spark):
    rows = spark.createDataFrame([(1, ["one", "two"]), (2, []), (3, ["two", "one"])], "id int, tokens array<string>")
    found = {r["id"]: np.array(r["embedding"]) for r in vector.embedded(rows).collect()}
    assert np.linalg.norm(found[1]) == pytest.approx(1, abs=1e-3) and not found[2].any() and len(found[1]) == 384
    assert vector.from_bytes(vector.to_bytes([0.5, -1.0])) == [0.5, -1.0]
    scored = {r["id"]: r["score"] for r in vector.query_scores(rows, ["one", "two"]).collect()}
    assert scored[1] == pytest.approx(1) and scored[2] == 0 and 0 < scored[3] < 1


def test_links():
    assert [x[1] for x in L.scan("open [[never closed and [[Real]]")] == ["Real"]
    assert L.scan("a\nb ![[x|y]] [[ ]] [[#h]]")[0][2:] == (1, 2, True) and len(L.scan("![[x]] [[ ]] [[#h]]")) == 2
    assert L.scan(None) == [] and L.scan("[[a\nb]]") == []


def test_parsed_links(spark):
    rows = spark.createDataFrame([("Note|alt",), ("Note#Section",), ("Note#^abc",), ("#^x",), ("A#b|c#d",)], "inner string")
    found = [tuple(r)[1:] for r in rows.withColumns(L.parsed(F.col("inner"))).collect()]
    assert found == [("Note", None, None, "alt"), ("Note", "Section", None, None), ("Note", None, "abc", None), ("", None, "x", None), ("A", "b", None, "c#d")]


def test_markdown():
    five = "# Head\n\nPara one.\n\n- a\n- b\n\n> quote\n\n```py\ncode\n\nmore\n```\n"
    assert [b["block_type"] for b in markdown.blocks(five)] == ["heading", "paragraph", "list", "quote", "code"]
    assert [b["user_ref"] for b in markdown.blocks("This is a paragraph.\n^abc123\n\nAnother paragraph.")] == ["abc123", None]
    assert markdown.section("# Top\na\n## Sub\nb\n## Other\nc", "sub") == "## Sub\nb"
    assert markdown.visible_words("# Heading\n\n- one\n- two\n- three\n\n> quoted text\n") == 6
    assert markdown.title("---\ntitle: \"X y\"\n---\n# Z\n", "stem") == "X y" and markdown.title("## a\n# Z\n", "stem") == "Z" and markdown.title("a", "stem") == "stem"
    assert markdown.embedded("# a\nx\n^r\n", block_ref="r") == "x\n^r" and markdown.embedded("b") == "b"
    assert [b["block_type"] for b in markdown.blocks("a | b\n--|--\n1 | 2\n\nTitle\n===\n\n---\n<div>\n[^1]: note")] == ["table", "heading", "html"]


def test_vault(spark, tmp_path):
    (tmp_path / "Daily").mkdir()
    (tmp_path / ".hidden").mkdir()
    (tmp_path / ".git").mkdir()
    (tmp_path / "Welcome.md").write_text("---\ntitle: Welcome\n---\n# Welcome\n\nSee [[day]] and [[Missing]].\n\nlast [[Daily/day]]\n")
    (tmp_path / "Daily" / "day.md").write_text("Back to [[Welcome]].\n")
    (tmp_path / ".hidden" / "h.md").write_text("alone\n")
    (tmp_path / ".git" / "x.md").write_text("no\n")
    (tmp_path / "bad.md").write_bytes(b"\xff\xfe")
    (tmp_path / "skip.md").write_text("no\n")
    (tmp_path / ".gitignore").write_text("skip.md\n")
    engine = api.Engine.open(spark, str(tmp_path))
    assert engine.report().first()["indexed"] == 3
    assert [(r["source"], r["line"]) for r in engine.backlinks("Daily/day.md").collect()] == [("Welcome.md", 5), ("Welcome.md", 7)]
    assert [r["is_resolved"] for r in engine.outgoing("Welcome.md").collect()] == [True, False, True]
    assert [r["id"] for r in engine.orphans().collect()] == [".hidden/h.md"]
    assert {r["id"]: r["degree"] for r in engine.degrees().collect()} == {"Welcome.md": 1, "Daily/day.md": 1, ".hidden/h.md": 0}
    blocks = {r["block_id"]: r["content"] for r in engine.blocks.collect()}
    held = {r["line"]: blocks[r["block_id_as_of"]] for r in engine.link_sources().where("source = 'Welcome.md'").collect()}
    assert held[5].startswith("See") and held[7].startswith("last")
    assert engine.search("welcome").count() >= 1 and engine.search("  ").count() == 0
    out = api.dispatch(engine, {"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": "get_backlinks", "arguments": {"path": "Welcome.md"}}})
    assert out["result"]["rows"][0]["source"] == "Daily/day.md"
    assert api.dispatch(engine, {"method": "x"})["error"]["code"] == -32600 and len(api.dispatch(engine, {"jsonrpc": "2.0", "id": 2, "method": "tools/list"})["result"]["tools"]) == len(api.TOOLS)
    assert [r["path"] for r in sources.tree(engine.files).collect()][:2] == [".hidden", "Daily"]
    assert sources.safe("a/b.md") and not any(map(sources.safe, ("../x", "/x", "a\0", "")))


def test_other_sources(spark):
    files = spark.createDataFrame(
        [("a.canvas", '{"nodes":[{"id":"1","type":"file","file":"x"},{"id":"2","type":"text","text":"t"}],"edges":[{"id":"e","fromNode":"1","toNode":"2"}]}'), ("b.canvas", '{"nodes":[{"id":"1"}],"edges":[{"id":"e","fromNode":"1","toNode":"9"}]}'), ("c.canvas", '{"nodes":[{"id":"1"},{"id":"1"}]}'), ("d.canvas", ""), ("e.canvas", "{{")],
        "path string, content string",
    )
    assert [r["problem"] for r in sources.canvas(files).orderBy("path").collect()] == [None, "edge to no node", "duplicate node", None, "not JSON"]
    flows = spark.createDataFrame([("1.json", '{"name":"a","steps":[]}'), ("2.json", '{"name":" ","steps":[{"id":"s"}]}'), ("3.json", "garbage"), ("4.json", '{"name":"ok","steps":[{"id":"s","kind":"llm"}]}')], "path string, content string")
    found = {r["path"]: (r["reason"], r["threshold"]) for r in sources.workflows(flows).collect()}
    assert [k for k, v in found.items() if v[0] is None] == ["4.json"] and found["4.json"][1] == 0.7
    skills = spark.createDataFrame([("s/a/SKILL.md", "---\nname: do\ndescription: it\n---\nbody"), ("s/b/SKILL.md", "plain"), ("s/c/other.md", "x")], "path string, content string")
    assert [(r["name"], r["reason"]) for r in sources.skills(skills).orderBy("path").collect()] == [("do", None), ("", "no front matter")]
    prompts = spark.createDataFrame([("p/ask/v1.md", "one"), ("p/ask/v12.md", "two")], "path string, content string")
    defaults = spark.createDataFrame([("ask", "d"), ("say", "e")], "name string, body string")
    assert [(r["name"], r["version"]) for r in sources.prompts(prompts, defaults).collect()] == [("ask", 1), ("ask", 12), ("say", 4294967295)]


def test_graph_kernels(spark):
    edges = [(0, 1, 1), (0, 2, 1), (1, 2, 1), (3, 4, 1), (3, 5, 1), (4, 5, 1), (2, 3, 1)]
    part = graph.leiden(edges, list(range(6)))[-1]
    assert len(set(part.values())) == 2 and part[0] == part[1] == part[2] and part[3] == part[4] == part[5]
    frame = spark.createDataFrame(edges, "src long, dst long, weight long")
    labels = spark.createDataFrame(list(part.items()), "id long, label long")
    assert graph.modularity(frame, labels).first()["q"] > 0.25
    nodes = spark.createDataFrame([(i,) for i in range(8)], "id long")
    found = {r["id"]: r["label"] for r in partitions.leiden(nodes, frame).where("level = 0").collect()}
    assert len(set(found.values())) == 4
    clique = [(a, b, 1) for a in range(5) for b in range(a)]
    assert len(set(graph.leiden(clique, list(range(5)))[-1].values())) == 1 and len(set(graph.leiden([], [1, 2, 3])[-1].values())) == 3
    assert len(set(r["community"] for r in graph.relabelled(labels).collect())) == 2
    at, rounds = graph.layout(50, np.array([(i, (i + 1) % 50) for i in range(50)]), 60)
    assert at.shape == (50, 2) and np.abs(at).max() <= 500 and len(np.unique(at.round(3), axis=0)) == 50


def test_hypervectors(spark):
    a, b = hyper.random_vector(1), hyper.random_vector(2)
    assert abs(hyper.similarity(a, b)) < 0.05 and hyper.similarity(a, a) == 1 and len(hyper.packed(a)) == 1250
    assert (hyper.unpacked(hyper.packed(a)) == a).all() and (hyper.bundle([]) == 1).all() and (hyper.permute(a)[1:] == a[:-1]).all()
    texts = spark.createDataFrame([(1, ["apple"]), (2, ["brick"]), (3, ["cloud"])], "id long, tokens array<string>")
    near = hyper.combined(hyper.encoded(texts), spark.createDataFrame([(1, 8), (1, 9), (2, 8), (2, 9)], "src long, dst long"))
    query = bytes(near.where("id = 1").first()["hv"])
    found = {r["id"]: r["score"] for r in hyper.related(near, query, 5).collect()}
    assert found[1] == 1 and found[2] > found[3] + 0.1
    memory = hyper.PairMemory([("name", "ann"), ("town", "oslo"), ("pet", "cat")])
    assert memory.value("town", ["ann", "cat", "oslo"])[0] == "oslo" and memory.key("cat", ["name", "pet", "town"])[0] == "pet"
    x, y = hyper.phases(1), hyper.phases(2)
    assert hyper.complex_similarity(hyper.unbound(hyper.bound(x, y), y), x) == pytest.approx(1, abs=1e-4)
    assert np.allclose(np.abs(hyper.complex_bundle([x, -x])), 1)


def test_memory(spark):
    said = "I am from Riyadh. / I work as a backend engineer. / I love coffee. / I speak Arabic and English. / I prefer espresso. / I am from Riyadh. / I don't love coffee anymore. / My favourite colour is blue. / I work as a senior backend engineer in Riyadh. / I never drink soda.".split(" / ")
    rows = spark.createDataFrame([("s", k, t) for k, t in enumerate(said)], "k string, n long, t string")
    ops = [r["op"] for r in state.remembered(rows, "k", "n", "t").orderBy("step").collect()]
    assert ops.count("ADD") >= 5 and ops.count("NOOP") >= 1 and ops.count("DELETE") >= 1 and len(ops) == 10
    memory = state.Memory()
    for s in said:
        memory.take(s.rstrip("."))
    texts = [t for t, _ in memory.facts.values()]
    assert "I love coffee" not in texts and "I never drink soda" in texts


def test_telemetry(spark):
    counts = spark.createDataFrame([(9, 10), (5, 5), (90, 100), (48, 50), (0, 0)], "p long, n long")
    low, high = telemetry.wilson(F.col("p"), F.col("n"))
    got = [(r["l"], r["h"]) for r in counts.select(low.alias("l"), high.alias("h")).collect()]
    assert 0.55 < got[0][0] < 0.85 and 0.9 < got[0][1] <= 1 and got[1][0] < got[2][0] < got[3][0] and got[4] == (0, 0)
    cents = counts.limit(1).select(telemetry.cost_cents(F.lit("x-opus"), (F.lit(1_000_000), F.lit(0), F.lit(0), F.lit(0))).alias("c")).first()["c"]
    assert cents == 1500


def test_triggers_and_state(spark):
    rows = spark.createDataFrame([(1, t, 9.0 if t >= 100 else 0.0) for t in range(115)], "k long, t long, v double")
    fired = state.debounced(rows.withColumn("f", F.col("v") >= 5), "k", ["t"], "f", 10)
    assert sorted(r["tick"] for r in fired.collect()) == [100, 110]
    made = state.ema(spark.createDataFrame([(1, t, [1.0, 0.0] if t < 2 else [0.0, 1.0]) for t in range(43)], "k long, t long, x array<double>"), "k", ["t"], "x", 2).first()
    assert made["steps"] == 43 and made["state"][1] > made["state"][0]


def test_texts(spark):
    lead = spark.createDataFrame([("# h\n\nfirst  line\nsecond\n\nthird",), ("",), (None,)], "t string").select(T.leading_text(F.col("t"), 40).alias("l"))
    assert [r["l"] for r in lead.collect()] == ["first  line second\nthird", "", ""]
    members = spark.createDataFrame([(1, k, f"t{k}", "x" * 300) for k in range(50)] + [(2, 0, "only", "")], "g long, k long, title string, lead string")
    found = {r["g"]: r["summary"] for r in communities.summaries(members, "g", "k").collect()}
    assert len(found[1].encode()) <= 1210 and found[2] == "• only"
    cited = spark.range(1).select(*[c.alias(n) for n, c in communities.citations(F.lit("a [C2] [N:x.md] [C1] [C2] [C] [N:]")).items()]).first()
    assert cited["communities"] == [2, 1] and cited["notes"] == ["x.md"]
    assert api.substituted("Hello {{name}}, year {{year}}", {"name": "A"}) == "Hello A, year {{year}}"
    assert api.related_section("# a\n", "T").endswith("## Related\n\n- [[T]]\n") and api.related_section("## Related\n- [[T]]\n", "T") == "## Related\n- [[T]]\n"


def test_media(spark):
    a, b = media.embedding(["same", "words"], b"one" * 999), media.embedding(["same", "words"], b"two" * 999)
    assert 0.8 < float(a @ b) < 0.999
    assert np.abs(media.fingerprint(b"x" * 40_000)).max() <= 3 and not media.fingerprint(b"").any()
    rows = spark.createDataFrame([("a/b.MP3", 100), ("c.txt", 5 << 20)], "p string, n long").select(media.kind(F.col("p")).alias("k"), media.description(F.col("p"), F.col("n")).alias("d")).collect()
    assert [tuple(r) for r in rows] == [("audio", "audio b a 100B"), (None, "c 5.0MB")]


def test_numeric_kernels():
    patterns = np.eye(3)
    assert kernels.hopfield(patterns, np.array([1.0, 0.1, 0]), 50).argmax() == 0
    q, p = kernels.leapfrog(np.array([1.0]), np.array([0.0]), lambda x: x, 0.01)
    assert abs(0.5 * p[0] ** 2 + 0.5 * q[0] ** 2 - 0.5) < 1e-4
    assert kernels.log_mel(np.sin(np.arange(16_000) / 5).astype(np.float32)).shape[1] == 80
    assert len(kernels.resampled(np.ones(8_000), 8_000, 16_000)) == 16_000 and kernels.hertz(kernels.mel(440.0)) == pytest.approx(440)


def test_changes_and_mutations(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "path string, content_hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "path string, content_hash string")
    assert {tuple(r) for r in jobs.changes(old, new, "path").collect()} == {("b", "modified"), ("c", "removed"), ("d", "created")}
    assert mutations.deleted(old, new, "path").count() == 1 and mutations.replaced(old, new, "path").count() == 4


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    if not os.path.isdir(os.path.join(os.path.dirname(__spark_entry__.__file__), "mossgraph", "llm")):
        assert not any(n.startswith("op") and n[2].isdigit() for n in __spark_entry__.queries())


def test_loop(spark):
    from mossgraph.operators import loop

    rows = spark.createDataFrame([(k, t, [float(t % 3)] * 8 if t % 5 else None) for k in (1, 2) for t in range(35)], "k long, t long, x array<double>")
    found = loop.ticks(rows, "k", "t", "x").collect()
    assert sorted((r["key"], r["tick"]) for r in found) == [(k, t) for k in "12" for t in (10, 20, 30)]
    assert {r["tick"]: r["energy"] for r in found if r["key"] == "1"} == {r["tick"]: r["energy"] for r in found if r["key"] == "2"}
    marked = spark.createDataFrame([(1, 9.0, 0.0), (2, 1.0, -2.0), (3, 1.0, 0.0)], "tick long, energy double, progress double").withColumn("ts", F.lit("2024-01-02 03:04:05").cast("timestamp"))
    notes = loop.notes(loop.reflections(marked)).orderBy("name").collect()
    assert [(n["day"], n["name"]) for n in notes] == [("2024-01-02", "030405-1.md"), ("2024-01-02", "030405-2.md")] and "reason: energy" in notes[0]["text"]


def test_workflows(spark):
    from mossgraph.plans import workflow

    flow = {"steps": [{"id": "a", "kind": "llm", "args": {"prompt": "hi {{who}}"}}, {"id": "b", "kind": "write_note", "args": {"path": "n.md", "content": "{{prev_output}}!"}}, {"id": "c", "kind": "odd"}]}
    done = workflow.run(flow, {"who": "you"}, workflow.Echo())
    assert done.outputs == ["[echo] hi you", "[echo] hi you!"] and done.error.startswith("step c")
    assert workflow.pending_writes(spark, done).count() == 1
    assert workflow.run({"steps": [{"id": "x", "kind": "write_note", "args": {"path": "../n"}}]}, {}, workflow.Echo()).error
    flows = spark.createDataFrame([("a", 0.7, [1.0, 0.0]), ("b", 0.7, [0.0, 1.0]), ("c", 0.7, None)], "name string, threshold double, trigger_vector array<double>")
    assert [r["name"] for r in workflow.resonant(flows, [1.0, 0.1]).collect()] == ["a"]


@pytest.mark.parametrize("name", ["stream_window_counts", "stream_dedup", "stream_ema", "stream_triggers"])
def test_stream_of_many_files(spark, sf, tmp_path, name):
    """More files than two micro-batches take (late rows are dropped from the third on), each over the whole time: nothing counts as late, folds follow time."""
    import duckdb

    spark.read.parquet(f"{sf}/events.parquet").repartition(135).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.sql(catalog.oracle_sql()[name])
    columns = sorted(want.columns)
    rows = [dict(zip(want.columns, r)) for r in want.fetchall()]
    found = catalog.queries()[name](spark, str(tmp_path)).collect()
    assert canonical([r.asDict() for r in found], columns) == canonical(rows, columns)


def test_graph_queries_use_every_edge(spark, tmp_path):
    """Parts 1, 2 and 3 are bought together once; a part alone has no neighbours."""
    spark.createDataFrame([(1, 1), (1, 2), (2, 2), (2, 3), (3, 4)], "l_orderkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(k, f"part {k}", "T", "B") for k in (1, 2, 3, 4)], "p_partkey long, p_name string, p_type string, p_brand string").write.parquet(str(tmp_path / "part.parquet"))
    run = lambda name: catalog.queries()[name](spark, str(tmp_path)).collect()
    assert {r["id"]: r["degree"] for r in run("layout")} == {1: 1, 2: 2, 3: 1, 4: 0}
    labels = {r["id"]: r["label"] for r in run("leiden") if r["level"] == 0}
    assert labels[1] == labels[2] == labels[3] != labels[4]
    assert {(r["source"], r["target"]) for r in run("hdc_suggest")}.isdisjoint({(1, 2), (2, 3)})


def test_layout_ends_at_its_temperature(spark):
    ids = list(range(12))
    nodes = spark.createDataFrame([(i,) for i in ids], "id long")
    pairs = [(i, (i + 1) % 12) for i in ids]
    found = {r["id"]: (r["x"], r["y"]) for r in graph.layout_frame(spark, nodes, spark.createDataFrame(pairs, "src long, dst long")).collect()}
    want, rounds = graph.layout(12, np.array(sorted((min(p), max(p)) for p in pairs)), 10_000)
    assert rounds == 149 and np.allclose([found[i] for i in ids], want, atol=0.5)


def test_hypervector_queries_have_the_full_dimension(spark, sf):
    from mossgraph.plans import streams

    assert {len(r["hv"]) for r in streams._hypervectors(spark, sf).collect()} == {hyper.DIM // 8} == {1250}
    scores = [r["score"] for r in catalog.queries()["hdc_related"](spark, sf).collect()]
    assert len(scores) == 20 and all(abs(s * hyper.DIM / 2 - round(s * hyper.DIM / 2)) < 0.01 for s in scores)


def test_media_embedding_of_every_page(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html").collect()
    told = catalog.queries()["media_fingerprint"](spark, sf).select("page_id", T.tokens(F.col("description")).alias("w")).collect()
    words = {r["page_id"]: r["w"] for r in told}
    found = {r["page_id"]: r["embedding"] for r in catalog.queries()["media_embedding"](spark, sf).collect()}
    assert len(found) == len(pages) > 0
    for r in pages:
        assert np.allclose(found[r["page_id"]], media.embedding(words[r["page_id"]], (r["html"] or "").encode()), atol=1e-6)
