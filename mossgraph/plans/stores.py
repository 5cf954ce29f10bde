"""Registered queries of stored tables, change streams, files of other kinds and requests, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import communities, graph, state, telemetry
from ..sources import files as sources
from ..sources import store as stores
from ..streaming import jobs
from . import api, workflow
from .ledger import NOW, SQL_L, ledger
from .retrieval import spread, table, texts


def _store(spark) -> stores.Store:
    return stores.Store(spark, f"{graph.shared_folder(spark)}/store-{uuid.uuid4().hex}")


def store_migration(spark, sf_dir):
    """Documents in a first version without titles, then in a second made of it: the last version is read, in today's columns."""
    at = _store(spark)
    d = table(spark, sf_dir, "documents")
    first = d.select(F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path"), F.length("text").alias("size_bytes"), F.lit("gone").alias("old_column"))
    old = at.write("documents", first)
    return at.write("documents", old.withColumn("title", F.upper("path")).where("cast(id AS long) % 5 != 0")).select("id", "path", "title", "size_bytes", "word_count")


def store_append(spark, sf_dir):
    """The audit log in two appends, as the ledger has them."""
    at, rows = _store(spark), ledger(spark, sf_dir)
    made = rows.select(F.col("event_id").cast("string").alias("id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"), F.col("actor").cast("string").alias("actor"), "operation", F.col("input").alias("input_tokens"), F.col("output").alias("output_tokens"), F.col("cost").alias("cost_micro_cents"), F.lit("ok").alias("status"))
    at.append("audit_log", made.where("cast(id AS long) % 2 = 0"))
    return at.append("audit_log", made.where("cast(id AS long) % 2 = 1")).select("id", "timestamp", "actor", "operation", "input_tokens", "output_tokens", "cost_micro_cents", "status")


def store_communities(spark, sf_dir):
    """A hierarchy of regions, nations and market segments of nations, stored from the coarsest level down."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey"))
    key = lambda *cols: F.concat_ws("/", *[F.lpad(F.col(x).cast("string"), 10, "0") for x in cols])
    levels = [(0, key("n_regionkey", "c_nationkey", "c_mktsegment"), key("n_regionkey", "c_nationkey")), (1, key("n_regionkey", "c_nationkey"), key("n_regionkey")), (2, key("n_regionkey"), F.lit(None).cast("string"))]
    groups = None
    for level, cid, parent in levels:
        part = c.groupBy(cid.alias("cid"), parent.alias("parent_cid")).agg(F.count(F.lit(1)).alias("members")).withColumn("level", F.lit(level)).withColumn("summary", F.concat(F.lit("about "), F.col("cid")))
        groups = part if groups is None else groups.unionByName(part)
    return _store(spark).write("communities", stores.with_parents(groups))


def _changes(spark, sf_dir):
    op = F.when(F.col("value") < 5, "DELETE").when(F.col("value") < 15, "ADD").when(F.col("value") < 18, "NOOP").otherwise("UPDATE")
    return table(spark, sf_dir, "events").select(F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("fact_id"), op.alias("op"), F.concat(F.lit("text "), F.col("event_id").cast("string")).alias("text"), (F.col("event_id") + 1).alias("at"))


def store_facts(spark, sf_dir):
    """Facts after the events of the first half were stored, read back, and the second half came: active ones."""
    at, rows = _store(spark), _changes(spark, sf_dir)
    half = rows.agg(F.floor(F.max("at") / 2)).first()[0] or 0
    for part in (rows.where(F.col("at") <= half), rows.where(F.col("at") > half)):
        facts, history = stores.facts_after(at.read("facts"), part)
        at.write("facts", facts)
        at.append("fact_history", history)
    return stores.active(at.read("facts")).select("id", "text", "created_at", "updated_at")


def store_fact_history(spark, sf_dir):
    _, history = stores.facts_after(stores.Store(spark, "").spark.createDataFrame([], stores.SCHEMAS["facts"]), _changes(spark, sf_dir))
    return history.select("fact_id", "op", "prev_text", "new_text", "timestamp")


def reflection_notes(spark, sf_dir):
    """Snapshots worth a note, written under their day, and read back."""
    from ..operators import loop

    snaps = table(spark, sf_dir, "events").select((F.col("event_id") * 10).alias("tick"), "ts", (F.col("value") / 10).alias("energy"), (-F.col("value") / 3).alias("progress")).where("tick % 100 = 0")
    folder = f"{graph.shared_folder(spark)}/notes-{uuid.uuid4().hex}"
    stores.write_notes(loop.notes(loop.reflections(snaps, 4.0, -6.0)), folder)
    return stores.read_notes(spark, folder).select("day", "name", F.sha2("text", 256).alias("hash"))


def lossy_channel(spark, sf_dir):
    made = table(spark, sf_dir, "events").withColumn("hour", F.date_format("ts", "yyyy-MM-dd HH"))
    return stores.lossy(made, "hour", ["ts", "event_id"], 8).select("hour", "kept", "dropped", F.col("last.event_id").alias("last"))


def debounced_changes(spark, sf_dir):
    return jobs.settled(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", "ts", "event_type", "6 HOURS", "event_id").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def conflated_ticks(spark, sf_dir):
    made = table(spark, sf_dir, "events").select(F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 600).alias("tick"), "ts", "event_id", "value")
    return jobs.conflated(made, "tick", ["ts", "event_id"], "value", 3)


def two_triggers(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value", (-F.col("value")).alias("progress"))
    return jobs.fires_twofold(rows, "user_id", ["ts", "event_id"], "value", "progress", 40.0, -20.0, 10)


def cost_by_operations(spark, sf_dir):
    return telemetry.since_midnight(ledger(spark, sf_dir), F.expr(NOW), operations=["click", "purchase"])


def cache_hits_of_actor(spark, sf_dir):
    return telemetry.cache_ratio(ledger(spark, sf_dir), F.expr(NOW), 300, actor=7, operation="view")


def community_levels(spark, sf_dir):
    groups = table(spark, sf_dir, "part").groupBy((F.col("p_size") % 4).alias("level"), "p_brand").agg(F.count(F.lit(1)).alias("members"))
    return communities.level_report(groups)


def meta_chunks(spark, sf_dir):
    return communities.meta_summaries(table(spark, sf_dir, "part"), "p_brand", "p_partkey", "p_name")


def prompts_rendered(spark, sf_dir):
    """Prompts of each page: a template with known and unknown names, and those for an answer and a summary."""
    row = table(spark, sf_dir, "pages").select("page_id", F.coalesce("url", F.lit("")).alias("url"))
    plain = api.filled(F.lit("Read {{ url }} as {{id}}, not {{other}} nor {{url}}."), {"url": F.col("url"), "id": F.col("page_id").cast("string")})
    asked = communities.answer_prompt(F.col("url"), F.concat(F.lit("what is "), F.col("page_id").cast("string"), F.lit("?")))
    return row.select("page_id", plain.alias("filled"), asked.alias("answer"), communities.summary_prompt(F.col("url"), F.lit("- x")).alias("summary"))


def citations(spark, sf_dir):
    """Answers that cite communities twice and notes once, with malformed marks between."""
    i = F.col("doc_id")
    said = lambda c: c.cast("string")
    answer = F.concat(F.lit("So [C"), said(i % 7), F.lit("] and [N: a/"), said(i), F.lit(".md ] [C"), said(i % 5 + 10), F.lit("][C"), said(i % 7), F.lit("] [Cx] [N:] [C12"))
    found = communities.citations(answer)
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return table(spark, sf_dir, "documents").select("doc_id", joined(found["communities"]).alias("communities"), joined(found["notes"]).alias("notes"))


def redactions(spark, sf_dir):
    """Keys put into whole documents come out shortened."""
    text = F.coalesce("text", F.lit(""))
    return texts(spark, sf_dir).select("doc_id", F.sha2(api.redacted(F.concat(text, F.lit(" key sk-antABCDEFGH12345678 end sk-x "), text)), 256).alias("hash"))


def valid_urls(spark, sf_dir):
    url = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("ftp://"), "url")).when(F.col("page_id") % 4 == 1, F.concat("url", F.lit(" x"))).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", F.coalesce(api.valid_url(url), F.lit(False)).alias("valid"))


def probes(spark, sf_dir):
    """Lines key=value of each event as a map, read back by key."""
    said = F.concat(F.lit("duration="), F.col("value").cast("string"), F.lit("\nformat = "), F.col("event_type"), F.lit("\nno value here\ntag=a=b\n"))
    read = api.probe(said)
    return table(spark, sf_dir, "events").select("event_id", read["duration"].alias("duration"), read["format"].alias("format"), read["tag"].alias("tag"))


def canvases(spark, sf_dir):
    """A canvas of each order: its lines as nodes, joined one after the other; some twice, some to nowhere, some not JSON."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_linenumber").cast("long").alias("n"))
    ids = F.sequence(F.lit(1).cast("long"), F.col("n"))
    odd = F.pmod(F.col("l_orderkey"), F.lit(5))
    nodes = F.transform(ids, lambda k: F.concat(F.lit('{"id":"'), F.when(odd == 1, F.lit(1)).otherwise(k).cast("string"), F.lit('","type":"text"}')))
    edges = F.transform(ids, lambda k: F.concat(F.lit('{"id":"e'), k.cast("string"), F.lit('","fromNode":"1","toNode":"'), F.when(odd == 2, k + 1).otherwise(k).cast("string"), F.lit('"}')))
    content = F.when(odd == 3, "{{").when(odd == 4, "").otherwise(F.concat(F.lit('{"nodes":['), F.array_join(nodes, ","), F.lit('],"edges":['), F.array_join(edges, ","), F.lit("]}")))
    made = sources.canvas(rows.select(F.concat(F.col("l_orderkey").cast("string"), F.lit(".canvas")).alias("path"), content.alias("content")))
    return made.select("path", F.size("nodes").cast("long").alias("nodes"), F.size("edges").cast("long").alias("edges"), "problem")


def skills_loaded(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    matter = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit('---\nname: "'), "p_name", F.lit('"\ndescription: '), "p_type", F.lit("\n---\n"))).when(F.col("p_partkey") % 3 == 1, "---\ndescription: x\n---\n").otherwise("")
    rows = p.select(F.concat(F.lit("s/"), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 10 == 9, "/other.md").otherwise("/SKILL.md")).alias("path"), F.concat(matter, F.lit("body "), "p_brand").alias("content"))
    return sources.skills(rows).select("path", "name", "description", "body", "reason")


def workflows_loaded(spark, sf_dir):
    p, k = table(spark, sf_dir, "part"), F.pmod(F.col("p_partkey"), F.lit(5))
    content = F.when(k == 0, "garbage").when(k == 1, '{"name":" ","steps":[{"id":"1"}]}').when(k == 2, '{"name":"n","steps":[]}').otherwise(F.concat(F.lit('{"name":"'), "p_name", F.lit('","trigger_threshold":'), F.when(k == 3, "0.5").otherwise("null"), F.lit(',"steps":[{"id":"1","kind":"llm"},{"id":"2","kind":"write_note"}]}')))
    rows = p.select(F.concat(F.lit("w/"), F.col("p_partkey").cast("string"), F.lit(".json")).alias("path"), content.alias("content"))
    return sources.workflows(rows).select("path", "name", "threshold", F.coalesce(F.size("steps"), F.lit(0)).cast("long").alias("steps"), "reason")


def prompts_loaded(spark, sf_dir):
    """Versions of prompts by brand on disk, over defaults for all brands and one more."""
    p = table(spark, sf_dir, "part").where("p_partkey % 2 = 0")
    files = p.select(F.concat(F.lit("p/"), F.regexp_replace("p_brand", "[^A-Za-z0-9]", "_"), F.lit("/v"), F.col("p_partkey").cast("string"), F.lit(".md")).alias("path"), F.col("p_name").alias("content"))
    brands = table(spark, sf_dir, "part").select(F.regexp_replace("p_brand", "[^A-Za-z0-9]", "_").alias("name")).distinct()
    defaults = brands.unionByName(spark.createDataFrame([("zz_other",)], "name string")).withColumn("body", F.lit("default"))
    return sources.prompts(files, defaults)


def workflow_runs(spark, sf_dir):
    """A dry run of one workflow for each nation: outputs of its steps and the note it would write; unsafe paths end it."""
    flow = {"steps": [{"id": "1", "kind": "llm", "args": {"prompt": "about {{name}} {{other}}"}}, {"id": "2", "kind": "write_note", "args": {"path": "{{path}}", "content": "{{prev_output}}!"}}]}
    rows = []
    for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").collect():  # 25 nations
        done = workflow.run(flow, {"name": r["n_name"], "path": ("../" if r["n_nationkey"] % 5 == 0 else "") + f"{r['n_nationkey']}.md"}, workflow.Echo())
        rows.append((r["n_nationkey"], len(done.outputs), done.pending[0]["path"] if done.pending else None, done.pending[0]["content"] if done.pending else None, done.error))
    return spark.createDataFrame(rows, "n_nationkey long, outputs long, path string, content string, error string")


def models_present(spark, sf_dir):
    """Models whose files are the suppliers': present if each has the size of its manifest."""
    s = table(spark, sf_dir, "supplier")
    name = F.concat(F.lit("m"), (F.col("s_suppkey") % 6).cast("string"))
    path = F.concat(F.lit("models/"), F.col("s_suppkey").cast("string"))
    files = s.where("s_suppkey % 17 != 0").select(path.alias("path"), (F.col("s_suppkey") * 3 + F.when(F.col("s_suppkey") % 6 == 2, 1).otherwise(0)).alias("size_bytes"))
    return sources.models(files, s.select(name.alias("name"), path.alias("path"), (F.col("s_suppkey") * 3).alias("size_bytes")))


def rpc_codes(spark, sf_dir):
    """Requests of every event by method and answer, counted."""
    k = F.pmod(F.col("event_id"), F.lit(9))
    method = F.when(k == 0, "initialize").when(k == 1, "ping").when(k == 2, "tools/list").when(k == 3, "odd").otherwise("tools/call")
    text = F.when(k == 8, "{{").otherwise(F.concat(F.lit('{"jsonrpc":"'), F.when(k == 7, "1.0").otherwise("2.0"), F.lit('","id":1,"method":"'), method, F.lit('","params":{"name":"'), F.when(k == 4, "nothing").otherwise("search"), F.lit('"}}')))
    return api.answered(table(spark, sf_dir, "events").select(text.alias("request")), list(api.TOOLS)).groupBy("method", "code").agg(F.count(F.lit(1)).alias("n"))


def memory_decisions(spark, sf_dir):
    """``state.decided`` on fixed neighbours for every document's first sentence: the rule's cases by the text's length."""
    text = F.concat(F.lit("I like tea"), F.when(F.col("doc_id") % 3 == 0, " with milk").when(F.col("doc_id") % 3 == 1, "").otherwise(" no longer at all"))
    near = F.array(F.struct(F.lit("1").alias("id"), F.lit("I like tea").alias("text"), F.when(F.col("doc_id") % 2 == 0, 0.6).otherwise(0.95).alias("sim")))
    made = state.decided(text, near)
    return table(spark, sf_dir, "documents").select("doc_id", made["op"].alias("op"), made["about"].alias("about"))


def graph_tables(spark, sf_dir):
    """Nodes and both ends of edges that have them, as the whole scans that graph work starts from."""
    edges = graph.co_occurrence(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey")
    nodes = spread(table(spark, sf_dir, "part").where("p_partkey % 11 != 0")).select(F.col("p_partkey").alias("id"))
    kept = edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
    return kept.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("out"), F.sum("weight").alias("weight"))


def queries() -> dict:
    named = [store_migration, store_append, store_communities, store_facts, store_fact_history, reflection_notes, lossy_channel, debounced_changes, conflated_ticks, two_triggers, cost_by_operations, cache_hits_of_actor, community_levels, meta_chunks, prompts_rendered, citations, redactions, valid_urls, probes, canvases, skills_loaded, workflows_loaded, prompts_loaded, workflow_runs, models_present, rpc_codes, memory_decisions, graph_tables]
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    change = "c AS (SELECT user_id || '/' || event_type AS id, CASE WHEN value < 5 THEN 'DELETE' WHEN value < 15 THEN 'ADD' WHEN value < 18 THEN 'NOOP' ELSE 'UPDATE' END AS op, 'text ' || event_id AS text, event_id + 1 AS ts FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts) AS k FROM c)"
    fold = change + """, r AS (SELECT id, 0::BIGINT AS k, NULL::VARCHAR AS text, NULL::BIGINT AS created_at, NULL::BIGINT AS updated_at, NULL::BIGINT AS deleted_at, NULL::VARCHAR AS op, NULL::VARCHAR AS prev_text, NULL::VARCHAR AS new_text, NULL::BIGINT AS ts FROM (SELECT DISTINCT id FROM n) UNION ALL
SELECT n.id, n.k, CASE WHEN a OR u THEN n.text ELSE r.text END, CASE WHEN a THEN n.ts ELSE r.created_at END, CASE WHEN a OR u OR d THEN n.ts ELSE r.updated_at END, CASE WHEN d THEN n.ts ELSE r.deleted_at END,
  CASE WHEN a OR u OR d OR n.op = 'NOOP' THEN n.op END, CASE WHEN r.created_at IS NOT NULL THEN r.text END, CASE WHEN a OR u THEN n.text END, n.ts
FROM (SELECT r.*, n.k AS nk, n.op = 'ADD' AND r.created_at IS NULL AS a, n.op = 'UPDATE' AND r.created_at IS NOT NULL AND r.deleted_at IS NULL AS u, n.op = 'DELETE' AND r.created_at IS NOT NULL AND r.deleted_at IS NULL AS d FROM r JOIN n ON n.id = r.id AND n.k = r.k + 1) r JOIN n ON n.id = r.id AND n.k = r.nk)"""
    pad = lambda c: f"lpad({c}::VARCHAR, 10, '0')"
    level = f"c AS (SELECT {pad('n_regionkey')} AS a, {pad('c_nationkey')} AS b, substring({pad('c_mktsegment')}, 1, 10) AS m FROM customer JOIN nation ON n_nationkey = c_nationkey)"
    numbered = "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS tick FROM events"
    size = "CASE WHEN s_suppkey % 17 = 0 THEN NULL ELSE s_suppkey * 3 + CASE WHEN s_suppkey % 6 = 2 THEN 1 ELSE 0 END END"
    brand = "regexp_replace(p_brand, '[^A-Za-z0-9]', '_', 'g')"
    return {
        "store_migration": "SELECT doc_id::VARCHAR AS id, 'd/' || doc_id AS path, upper('d/' || doc_id) AS title, length(text) AS size_bytes, NULL::BIGINT AS word_count FROM documents WHERE doc_id % 5 <> 0",
        "store_append": f"WITH {SQL_L} SELECT event_id::VARCHAR AS id, epoch_us(ts) // 1000 AS timestamp, actor::VARCHAR AS actor, operation, input AS input_tokens, output AS output_tokens, cost AS cost_micro_cents, 'ok' AS status FROM l",
        "store_communities": f"WITH {level}, g AS (SELECT 0 AS level, a || '/' || b || '/' || m AS cid, a || '/' || b AS up, count(*) AS n FROM c GROUP BY ALL UNION ALL SELECT 1, a || '/' || b, a, count(*) FROM c GROUP BY ALL UNION ALL SELECT 2, a, NULL, count(*) FROM c GROUP BY ALL), k AS (SELECT *, row_number() OVER (ORDER BY level DESC, cid) AS id FROM g) SELECT k.id, k.level::INT AS level, p.id AS parent_id, k.n AS member_count, 'about ' || k.cid AS summary_text FROM k LEFT JOIN k p ON p.level = k.level + 1 AND p.cid = k.up",
        "store_facts": f"WITH RECURSIVE {fold}, z AS (SELECT id, arg_max(text, k) AS text, arg_max(created_at, k) AS created_at, arg_max(updated_at, k) AS updated_at, max(deleted_at) AS deleted_at FROM r GROUP BY 1) SELECT id, text, created_at, updated_at FROM z WHERE created_at IS NOT NULL AND deleted_at IS NULL",
        "store_fact_history": f"WITH RECURSIVE {fold} SELECT id AS fact_id, op, prev_text, new_text, ts AS timestamp FROM r WHERE op IS NOT NULL",
        "reflection_notes": "WITH s AS (SELECT event_id * 10 AS tick, ts, value / 10 AS energy, -value / 3 AS progress FROM events WHERE (event_id * 10) % 100 = 0), w AS (SELECT *, CASE WHEN energy >= 4.0 THEN 'energy' WHEN progress <= -6.0 THEN 'progress' END AS reason FROM s) SELECT strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%H%M%S') || '-' || tick || '.md' AS name, sha256('---' || chr(10) || 'kind: reflection' || chr(10) || 'reason: ' || reason || chr(10) || 'tick: ' || tick || chr(10) || 'at: ' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || chr(10) || '---' || chr(10) || chr(10) || '# Reflection' || chr(10) || chr(10) || 'Energy ' || printf('%.3f', energy) || ', progress ' || printf('%.3f', progress) || '.' || chr(10)) AS hash FROM w WHERE reason IS NOT NULL",
        "lossy_channel": "WITH p AS (SELECT *, strftime(ts, '%Y-%m-%d %H') AS hour, row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d %H') ORDER BY ts, event_id) AS k FROM events) SELECT hour, count(*) FILTER (k <= 8) AS kept, count(*) FILTER (k > 8) AS dropped, arg_max(event_id, k) FILTER (k <= 8) AS last FROM p GROUP BY 1",
        "debounced_changes": "WITH p AS (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM events) SELECT user_id, ts::TIMESTAMP AS ts, event_type FROM p WHERE nx IS NULL OR nx >= ts + INTERVAL 6 HOUR",
        "conflated_ticks": "WITH e AS (SELECT floor(epoch(ts::TIMESTAMP) / 600)::BIGINT AS tick, * FROM events), l AS (SELECT tick, arg_max(value, (ts, event_id)) AS value, count(*) AS seen FROM e GROUP BY 1), t AS (SELECT unnest(range((SELECT min(tick) FROM e), (SELECT max(tick) FROM e) + 1)) AS tick) SELECT tick, coalesce(value, 0.0::DOUBLE) AS value, coalesce(seen, 0) AS seen FROM t LEFT JOIN l USING (tick) WHERE tick % 3 = 0",
        "two_triggers": f"""WITH RECURSIVE n AS (SELECT user_id, tick, CASE WHEN value >= 40 THEN 'energy' ELSE 'progress' END AS reason FROM ({numbered}) WHERE value >= 20),
r AS (SELECT user_id, min(tick) AS tick FROM n GROUP BY 1 UNION ALL SELECT user_id, tick FROM (SELECT r.user_id, min(n.tick) AS tick FROM r JOIN n ON n.user_id = r.user_id AND n.tick >= r.tick + 10 GROUP BY r.user_id, r.tick))
SELECT user_id, tick, reason FROM r JOIN n USING (user_id, tick)""",
        "cost_by_operations": f"WITH {SQL_L} SELECT coalesce(sum(cost), 0)::BIGINT // 10000 AS cents FROM l WHERE ts >= date_trunc('day', {NOW}) AND ts <= {NOW} AND operation IN ('click', 'purchase')",
        "cache_hits_of_actor": f"WITH {SQL_L} SELECT round(sum(cache_read)::DOUBLE / nullif(sum(cache_read) + sum(cache_write) + sum(input), 0), 6) AS ratio FROM l WHERE ts >= {NOW} - INTERVAL 300 HOUR AND ts <= {NOW} AND actor = 7 AND operation = 'view'",
        "community_levels": "SELECT level, count(*) AS communities, sum(n)::BIGINT AS members, round(avg(n), 6) AS mean_size, max(n) AS largest FROM (SELECT (p_size % 4)::INT AS level, p_brand, count(*) AS n FROM part GROUP BY 1, 2) GROUP BY 1",
        "meta_chunks": "WITH p AS (SELECT *, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) // 12 AS c FROM part), i AS (SELECT p_brand, c, string_agg(p_name, '; ' ORDER BY p_partkey) AS t FROM p GROUP BY 1, 2) SELECT p_brand, count(*) AS chunks, string_agg('[' || t || ']', chr(10) ORDER BY c) AS summary FROM i GROUP BY 1",
        "prompts_rendered": "SELECT page_id, 'Read ' || u || ' as ' || page_id || ', not {{other}} nor ' || u || '.' AS filled, 'Answer from these themes and cite them as [C<number>].' || chr(10) || chr(10) || u || chr(10) || chr(10) || 'Question: what is ' || page_id || '?' AS answer, 'Summarise these notes on ' || u || ' in a few sentences.' || chr(10) || chr(10) || '- x' AS summary FROM (SELECT page_id, coalesce(url, '') AS u FROM pages)",
        "citations": "SELECT doc_id, (doc_id % 7) || ',' || (doc_id % 5 + 10) AS communities, 'a/' || doc_id || '.md' AS notes FROM documents",
        "redactions": "SELECT doc_id, sha256(regexp_replace(t || ' key sk-antABCDEFGH12345678 end sk-x ' || t, '\\b(sk-[A-Za-z]{2,4})[A-Za-z0-9_-]{8,}', '\\1…', 'g')) AS hash FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)",
        "valid_urls": "SELECT page_id, coalesce(CASE page_id % 4 WHEN 0 THEN false WHEN 1 THEN false ELSE regexp_matches(url, '^https?://[^\\s]+$') END, false) AS valid FROM pages",
        "probes": "SELECT event_id, value::VARCHAR AS duration, event_type AS format, 'a=b' AS tag FROM events",
        "canvases": "WITH o AS (SELECT l_orderkey, max(l_linenumber)::BIGINT AS n, l_orderkey % 5 AS k FROM lineitem GROUP BY 1) SELECT l_orderkey || '.canvas' AS path, CASE WHEN k IN (3, 4) THEN 0 ELSE n END::BIGINT AS nodes, CASE WHEN k IN (3, 4) THEN 0 ELSE n END::BIGINT AS edges, CASE WHEN k = 3 THEN 'not JSON' WHEN k = 1 AND n > 1 THEN 'duplicate node' WHEN k = 2 THEN 'edge to no node' END AS problem FROM o",
        "skills_loaded": "SELECT 's/' || p_partkey || '/SKILL.md' AS path, CASE p_partkey % 3 WHEN 0 THEN p_name ELSE '' END AS name, CASE p_partkey % 3 WHEN 0 THEN p_type WHEN 1 THEN 'x' ELSE '' END AS description, 'body ' || p_brand AS body, CASE p_partkey % 3 WHEN 1 THEN 'no name' WHEN 2 THEN 'no front matter' END AS reason FROM part WHERE p_partkey % 10 <> 9",
        "workflows_loaded": "SELECT 'w/' || p_partkey || '.json' AS path, CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN ' ' WHEN 2 THEN 'n' ELSE p_name END AS name, CASE p_partkey % 5 WHEN 3 THEN 0.5 ELSE 0.7 END::DOUBLE AS threshold, CASE p_partkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 0 ELSE 2 END::BIGINT AS steps, CASE p_partkey % 5 WHEN 0 THEN 'not a workflow' WHEN 1 THEN 'no name' WHEN 2 THEN 'no steps' END AS reason FROM part",
        "prompts_loaded": f"SELECT {brand} AS name, p_partkey AS version, p_name AS body FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT name, 4294967295, 'default' FROM (SELECT DISTINCT {brand} AS name FROM part UNION ALL SELECT 'zz_other') WHERE name NOT IN (SELECT {brand} FROM part WHERE p_partkey % 2 = 0)",
        "workflow_runs": "SELECT n_nationkey::BIGINT AS n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN 1 ELSE 2 END::BIGINT AS outputs, CASE WHEN n_nationkey % 5 <> 0 THEN n_nationkey || '.md' END AS path, CASE WHEN n_nationkey % 5 <> 0 THEN '[echo] about ' || n_name || ' {{other}}!' END AS content, CASE WHEN n_nationkey % 5 = 0 THEN 'step 2: the path leaves the vault' END AS error FROM nation",
        "models_present": f"SELECT 'm' || s_suppkey % 6 AS name, bool_and(coalesce({size} = s_suppkey * 3, false)) AS present, sum(s_suppkey * 3)::BIGINT AS total_bytes FROM supplier GROUP BY 1",
        "rpc_codes": "SELECT CASE k WHEN 0 THEN 'initialize' WHEN 1 THEN 'ping' WHEN 2 THEN 'tools/list' WHEN 3 THEN 'odd' WHEN 8 THEN NULL ELSE 'tools/call' END AS method, CASE k WHEN 3 THEN -32601 WHEN 4 THEN -32602 WHEN 7 THEN -32600 WHEN 8 THEN -32700 ELSE 0 END::BIGINT AS code, count(*) AS n FROM (SELECT event_id % 9 AS k FROM events) GROUP BY 1, 2",
        "memory_decisions": "SELECT doc_id, CASE doc_id % 3 WHEN 1 THEN 'NOOP' WHEN 2 THEN 'DELETE' ELSE CASE WHEN doc_id % 2 = 0 THEN 'UPDATE' ELSE 'NOOP' END END AS op, '1' AS about FROM documents",
        "graph_tables": "WITH i AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), e AS (SELECT a.l_partkey AS src, b.l_partkey AS dst, count(*) AS weight FROM i a JOIN i b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY 1, 2), n AS (SELECT p_partkey AS id FROM part WHERE p_partkey % 11 <> 0) SELECT src AS id, count(*) AS out, sum(weight)::BIGINT AS weight FROM e WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n) GROUP BY 1",
    }
