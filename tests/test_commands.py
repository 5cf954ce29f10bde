"""The commands of a vault, end to end on a small one."""

import io
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from mossgraph.operators import graph, kernels, state
from mossgraph.plans import api, commands


@pytest.fixture
def vault(spark, tmp_path):
    (tmp_path / "a.md").write_text("---\ntitle: Alpha\n---\n# One\n\nAbout gardens and trees, see [[b]].\n\n## Two\n\nmore ^x1\n")
    (tmp_path / "b.md").write_text("Gardens again with trees, back to [[a]] and [[c]].\n")
    (tmp_path / "c.md").write_text("Ships at sea.\n")
    (tmp_path / "d.md").write_text("Gardens and trees and nothing else.\n")
    (tmp_path / "song.MP3").write_bytes(b"\x01" * 2000)
    (tmp_path / "workflows").mkdir()
    (tmp_path / "workflows" / "w.json").write_text('{"name":"w","steps":[{"id":"1","kind":"llm","args":{"prompt":"hi {{who}}"}},{"id":"2","kind":"write_note","args":{"path":"out.md","content":"{{prev_output}}"}}]}')
    (tmp_path / "skills" / "s").mkdir(parents=True)
    (tmp_path / "skills" / "s" / "SKILL.md").write_text("---\nname: s\ndescription: d\n---\nbody\n")
    (tmp_path / "models").mkdir()
    (tmp_path / "models" / "m.bin").write_bytes(b"12345")
    return commands.Workspace(spark, str(tmp_path))


def test_every_command_has_a_method():
    assert len(set(commands.COMMANDS)) == len(commands.COMMANDS) == 52 and len(commands.DESK_COMMANDS) == 3
    assert all(callable(getattr(commands.Workspace, commands.OTHER_NAMES.get(n, n))) for n in commands.COMMANDS)


def test_files(vault):
    run = lambda name, **a: commands.call(vault, name, **a)
    assert run("create_file", path="new/e.md").first()["title"] == "e"
    with pytest.raises(ValueError):
        run("create_file", path="new/e.md")
    for path in ("../x.md", "/x.md", "x.txt"):
        with pytest.raises(ValueError):
            run("write_file", path=path, content="")
    assert run("rename_file", path="new/e.md", to="f.md").count() == 1
    run("delete_file", path="f.md")
    assert tuple(run("reindex_vault").first()) == (5, 0)
    assert run("list_files").count() == 5 and run("read_file", path="c.md").first()["content"] == "Ships at sea.\n"
    assert [(r["level"], r["text"], r["line"]) for r in run("get_outline", path="a.md").collect()] == [(1, "One", 3), (2, "Two", 7)]
    assert [r["path"] for r in run("list_link_candidates", asked="ALPHA").collect()] == ["a.md"]
    assert run("resolve_embed", target="Alpha", block_ref="x1") is not None and run("resolve_embed", target="none") is None
    assert run("resolve_embed", target="a", heading="two")["content"].startswith("## Two")
    run("apply_link_suggestion", source="d.md", target="a")
    assert {r["source"] for r in run("get_backlinks", path="a.md").collect()} == {"b.md", "d.md"}
    with pytest.raises(ValueError):
        commands.call(vault, "odd")


def test_graph_and_communities(vault):
    snapshot = vault.get_graph_snapshot(20)
    assert {r["path"]: r["degree"] for r in snapshot["nodes"].collect()} == {"a.md": 1, "b.md": 2, "c.md": 1, "d.md": 0, "skills/s/SKILL.md": 0} and snapshot["edges"].count() == 2
    related = vault.find_related("a.md", 2).collect()
    assert len(related) == 2 and related[0]["score"] >= related[1]["score"] and "a.md" not in {r["path"] for r in related}
    assert all(r["source"] != r["target"] for r in vault.suggest_links(0.0).collect())
    themes = vault.rebuild_graph_rag().collect()
    assert sum(r["members"] for r in themes if r["is_top"]) == 5
    level = vault.max_community_level().first()["level"]
    assert sum(r["members"] for r in vault.list_communities_at_level(level).collect()) == 5
    first = vault.graph_rag_query("ships sea", 1).first()
    assert "Ships" in first["summary"] and first["rank"] == 1 and vault.graph_rag_query("  ").count() == 0
    assert "## Theme 1" in vault.graph_rag_context("ships sea", 1).first()["payload"]
    talked = vault.streaming_chat("ships sea", 1)
    assert "Ships" in talked["answer"] and talked["status"]["steps"] == 1
    assert vault.ssm_step_text("ships sea")["alignment"] == pytest.approx(1) and vault.ssm_reset()["steps"] == 0
    request = {"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": "write_note", "arguments": {"path": "g.md", "content": "# G"}}}
    assert api.dispatch(vault, request, commands.TOOLS)["result"]["rows"][0]["title"] == "G"
    request["params"] = {"name": "graph_rag_query", "arguments": {"query": "ships"}}
    assert api.dispatch(vault, request, commands.TOOLS)["result"]["rows"][0]["rank"] == 1


def test_media_canvases_and_workflows(spark, vault):
    row = vault.list_media().first()
    assert row["path"] == "song.MP3" and row["kind"] == "audio" and len(vault.ingest_media("song.MP3").first()["embedding"]) == 384
    for bad in ("ftp://x", "https://x"):
        with pytest.raises(ValueError):
            vault.ingest_url(bad)
    with pytest.raises(ValueError):
        vault.delete_media("a.md")
    vault.delete_media("song.MP3")
    assert vault.list_media().count() == 0
    assert vault.create_canvas("x.canvas").first()["problem"] is None and vault.list_canvases().count() == 1
    with pytest.raises(ValueError):
        vault.write_canvas("x.canvas", {"nodes": [], "edges": [{"id": "e", "fromNode": "1", "toNode": "2"}]})
    dry = vault.run_workflow("w", {"who": "you"})
    assert dry.pending == [{"path": "out.md", "content": "[echo] hi you"}] and vault.read("out.md").count() == 0
    vault.run_workflow("w", {"who": "you"}, dry_run=False)
    assert vault.read("out.md").first()["content"] == "[echo] hi you"
    assert [r["name"] for r in vault.list_skills().collect()] == ["s"]
    manifest = spark.createDataFrame([("m", "m.bin", 5), ("n", "m.bin", 6), ("n", "o.bin", 1)], "name string, path string, size_bytes long")
    assert [tuple(r) for r in vault.embeddings_model_status(manifest).collect()] == [("m", True, 5), ("n", False, 7)]


def test_loop_and_telemetry(spark, vault):
    with pytest.raises(ValueError):
        vault.send_observation([1.0])
    vault.start_cortex()
    assert vault.send_observation([1.0] * 8)["tick"] == 1 and not vault.stop_cortex()["running"]
    with pytest.raises(ValueError):
        vault.get_recent_audit_log()
    vault.ledger = spark.sql("SELECT 1L AS event_id, timestamp'2024-01-02 03:00:00' AS ts, 25000L AS cost, 1L AS cache_read, 1L AS cache_write, 2L AS input")
    assert vault.get_today_cost_cents("2024-01-02 04:00:00").first()["cents"] == 2 and vault.get_cache_stats("2024-01-02 04:00:00").first()["ratio"] == 0.25
    assert vault.get_recent_audit_log().count() == 1


def test_desk_server_and_models(spark, tmp_path):
    (tmp_path / "a.md").write_text("# A\n\nwords here\n")
    desk = commands.Desk(spark, downloader=lambda url, folder: open(f"{folder}/m.bin", "wb").write(b"12345") and url)
    with pytest.raises(ValueError):
        desk.call("list_files")
    with pytest.raises(ValueError):
        desk.call("open_vault", root=str(tmp_path / "none"))
    assert desk.call("open_vault", root=str(tmp_path))["open"] and desk.call("list_files").count() == 1
    space = desk.workspace
    with pytest.raises(ValueError):
        space.handle({"jsonrpc": "2.0", "id": 1, "method": "ping"})
    assert desk.call("start_mcp_server")["running"]
    assert space.handle({"jsonrpc": "2.0", "id": 1, "method": "initialize"})["result"]["serverInfo"]["name"] == "mossgraph"
    assert space.handle({"jsonrpc": "2.0", "id": 2, "method": "ping"})["result"] == {}
    found = space.handle({"jsonrpc": "2.0", "id": 3, "method": "tools/call", "params": {"name": "list_notes"}})["result"]
    assert found["rows"][0]["path"] == "a.md" and not found["truncated"] and "a.md" in found["content"][0]["text"]
    assert desk.call("mcp_status")["requests"] == 3 and not desk.call("stop_mcp_server")["running"]
    (tmp_path / "models").mkdir()
    manifest = spark.createDataFrame([("m", "m.bin", 5, "https://x/m.bin")], "name string, path string, size_bytes long, url string")
    assert tuple(desk.call("download_embeddings_model", name="m", manifest=manifest).first()) == ("m", True, 5)
    assert not desk.call("close_vault")["open"]


def test_index_of_changed_files(spark):
    """Taking changed files in gives what indexing everything would."""
    kind = "path string, content string, size_bytes long, modified_at long, error string"
    rows = {"a.md": "# A\n\nsee [[b]] and [[c#^x]]", "b.md": "to [[a]]", "c.md": "text\n^x"}
    frame = lambda r: spark.createDataFrame([(p, t, len(t), 1, None) for p, t in r.items()], kind)
    engine = api.Engine(spark, frame(rows)).keep()
    changed = {"b.md": "# New\n\nto [[d]]", "d.md": "back to [[New]]"}
    engine.index(frame(changed), ["c.md"])
    whole = api.Engine(spark, frame({**rows, **changed} | {}).where("path != 'c.md'"))
    for name in ("documents", "blocks", "links"):
        assert sorted(map(str, getattr(engine, name).collect())) == sorted(map(str, getattr(whole, name).select(getattr(engine, name).columns).collect()))
    assert [(r["source"], r["context"]) for r in engine.backlinks("d.md").collect()] == [("b.md", "to [[d]]")]


def test_vault_changes_and_nested_ignore_files(spark, tmp_path):
    from mossgraph.sources import files as sources

    (tmp_path / "v" / "sub").mkdir(parents=True)
    root = tmp_path / "v"
    (root / ".gitignore").write_text("*.tmp.md\nsub/no.md\n")
    (root / "sub" / ".gitignore").write_text("hidden.md\n!no.md\n")
    for name in ("a.md", "b.tmp.md", "sub/no.md", "sub/hidden.md", "sub/c.md"):
        (root / name).write_text(name)
    assert sorted(r["path"] for r in sources.vault(spark, str(root)).collect()) == ["a.md", "sub/c.md", "sub/no.md"]
    log, seen = str(tmp_path / "log"), []

    def drain():
        made = sources.changes(spark, str(root)).writeStream.option("checkpointLocation", log).foreachBatch(lambda b, n: seen.append(sorted((r["path"], r["kind"]) for r in b.collect()))).start()
        made.processAllAvailable()
        made.stop()

    drain()
    (root / "a.md").write_text("longer than before")
    (root / "sub" / "c.md").unlink()
    (root / "d.md").write_text("d")
    drain()
    got = [x for batch in seen for x in batch]
    assert got == [("a.md", "created"), ("sub/c.md", "created"), ("sub/no.md", "created"), ("a.md", "modified"), ("d.md", "created"), ("sub/c.md", "removed")]


def test_audited_calls_encoders_and_step_kinds(spark, tmp_path):
    from mossgraph.operators import vector
    from mossgraph.plans import workflow
    from mossgraph.sources import store

    at = store.Store(spark, str(tmp_path / "s"))
    asked = workflow.Audited(workflow.Echo(), at, "some-opus", clock=lambda: 5)
    assert asked.chat("x" * 400) == "[echo] " + "x" * 400
    asked.chat("y")
    rows = {r["input_tokens"]: r for r in at.read("audit_log").collect()}
    assert len(rows) == 2 and rows[100]["status"] == "ok" and rows[100]["cost_micro_cents"] == round((100 * 1500 + 102 * 7500) / 1e6 * 10_000)

    class Never(vector.Hashed):
        def ready(self):
            return False

    class Other:
        def ready(self):
            return True

        def dim(self):
            return 2

        def encode(self, rows, text):
            return rows.withColumn("embedding", F.array(F.length(text).cast("double"), F.lit(1.0)))

    assert isinstance(vector.chosen([Never()]), vector.Hashed) and isinstance(vector.chosen([Never(), Other()]), Other)
    files = spark.createDataFrame([("a.md", "some words here", 15, 1, None)], "path string, content string, size_bytes long, modified_at long, error string")
    hits = api.Engine(spark, files, [Other()]).search("some words", "semantic").collect()
    assert hits[0]["path"] == "a.md" and hits[0]["snippet"] == "some words here"
    done = workflow.run({"steps": [{"id": "1", "kind": "up", "args": {"t": "{{v}}"}}]}, {"v": "a"}, workflow.Echo(), kinds={"up": lambda args, before, *rest: args["t"].upper()})
    assert done.outputs == ["A"] and workflow.run({"steps": [{"id": "1", "kind": "odd"}]}, {}, workflow.Echo()).error


def test_filled_and_related_columns_like_their_plain_forms(spark):
    texts = ["", "a\n", "# T\n\n## Related\n\n- [[x]]\n\n## Next\nb\n", "## Related\n", "x\n## Related\n- [[t]]\n", "# A\n\n## Related\n\n# B\n"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    found = {r["k"]: r["x"] for r in rows.select("k", api.with_related(F.col("t"), F.lit("t")).alias("x")).collect()}
    assert {k: found[k] for k in (1, 2, 3, 4)} == {k: api.related_section(texts[k], "t") for k in (1, 2, 3, 4)}
    templates = ["{{a}} {{ b }} {{c}}", "none", "{{a}}{{a}}", "", "{{a", "x {{b}}\ny {{a}} z"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(templates)], "k int, t string")
    found = {r["k"]: r["x"] for r in rows.select("k", api.filled(F.col("t"), {"a": F.lit("{{b}}"), "b": F.lit("2")}).alias("x")).collect()}
    assert found == {k: api.substituted(t, {"a": "{{b}}", "b": "2"}) for k, t in enumerate(templates)}


def test_decisions_as_columns(spark):
    near = [("1", "I like tea", 0.95), ("2", "I do not like tea", 0.6)]
    cases = ["I like tea", "i  LIKE tea", "I never like tea", "I like tea with milk and sugar", "short"]
    rows = spark.createDataFrame([(c, near) for c in cases] + [("alone", [])], "c string, n array<struct<id:string,text:string,sim:double>>")
    found = {r["c"]: tuple(r["d"]) for r in rows.select("c", state.decided(F.col("c"), F.col("n")).alias("d")).collect()}
    assert found == {c: state.decide(c, near) for c in cases} | {"alone": ("ADD", None)}


def test_sound_and_pooling(spark):
    for width, top in ((1, 255), (2, 32767), (3, (1 << 23) - 1)):
        data = io.BytesIO()
        with wave.open(data, "wb") as f:
            f.setnchannels(2)
            f.setsampwidth(width)
            f.setframerate(8000)
            f.writeframes(top.to_bytes(width, "little") * 2 * 100)
        x = kernels.wav_mono(data.getvalue())
        assert len(x) == 200 and np.allclose(x, 1, atol=0.01)
    assert len(kernels.fitted(x, 300)) == 300 and len(kernels.fitted(x, 10)) == 10
    states = np.array([[[3.0, 0.0], [1.0, 0.0], [9.0, 9.0]]])
    assert kernels.masked_mean(states, np.array([[1, 1, 0]])).tolist() == [[1.0, 0.0]]
    assert kernels.halved(np.arange(4.0)).tolist() == [0.5, 2.5]
    box = graph.framed(spark.createDataFrame([(0.0, 0.0), (10.0, 5.0)], "x double, y double"), 100, 100).first()
    assert box["scale"] == pytest.approx(9)
