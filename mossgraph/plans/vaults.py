"""Registered queries over a vault made of the documents table, with SQL that knows each file's parts and parses nothing.

Every document becomes a Markdown file with front matter, a list, a quote, code, links and an anchor around its words, so
that the whole way from files to blocks, links, contexts and embeds runs on the whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import markdown
from ..operators import graph, links
from ..sources import files as sources
from . import api
from .retrieval import spread, table


def files(spark, sf_dir):
    """path, content, size_bytes, modified_at, error: a third of the files have a title in front matter, a third only a
    heading, a third neither."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    i = F.col("doc_id")
    said = lambda c: c.cast("string")
    clean = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]+", " "))
    source = F.regexp_replace(F.coalesce("source", F.lit("")), "[^A-Za-z0-9]+", "")
    lang = F.coalesce("lang", F.lit(""))
    third = F.pmod(i, F.lit(3))
    matter = F.when(third == 0, F.concat(F.lit("---\ntitle: Doc "), said(i), F.lit("\ntags: "), lang, F.lit("\n---\n"))).when(third == 1, F.concat(F.lit("---\ntags: "), lang, F.lit("\n---\n"))).otherwise("")
    c = i + 3
    parts = [
        F.when(third < 2, F.concat(F.lit("# Heading "), said(i))),
        F.when(clean != "", clean),
        F.concat(F.lit("- one "), source, F.lit("\n- [x] two")),
        F.concat(F.lit("> said "), lang),
        F.concat(F.lit("```py\ncode "), said(i), F.lit("\n\nmore\n```")),
        F.lit("## Links"),
        F.concat(F.lit("See [["), said(i + 1), F.lit("]] and [[Doc "), said(i + 2), F.lit("|alias]] then ![[notes/"), said(F.pmod(c, F.lit(10))), F.lit("/"), said(c), F.lit("#Links]] or [[missing "), said(i), F.lit("]] and [["), said(i - 1), F.lit("#^r"), said(i - 1), F.lit("]].")),
        F.lit("### Deep"),
        F.concat(F.lit("last words of "), said(i), F.lit("\n^r"), said(i)),
        F.lit("## End"),
        F.lit("end."),
    ]
    content = F.concat(matter, F.array_join(F.array(*parts), "\n\n"), F.lit("\n"))  # parts that are null are left out
    path = F.concat(F.lit("notes/"), said(F.pmod(i, F.lit(10))), F.lit("/"), said(i), F.lit(".md"))
    return d.select(path.alias("path"), content.alias("content"), F.octet_length(content).cast("long").alias("size_bytes"), (i * 1000).alias("modified_at"), F.lit(None).cast("string").alias("error"))


def engine(spark, sf_dir, *keep: str):
    """The vault's engine.  Texts are made and read by the query that needs them; only what a query uses more than once
    is kept: narrow tables (titles, links, blocks without their content)."""
    made = api.Engine(spark, files(spark, sf_dir))
    if "links" in keep:
        made.titles = graph.checkpointed(made.titles)
        made.raw_links = graph.checkpointed(made.raw_links)
        names = made.titles.select(F.col("path").alias("file_id"), "path", "title")
        made.links = graph.checkpointed(links.resolved(made.raw_links, names).withColumn("is_resolved", F.col("file_id").isNotNull()))
    if "anchors" in keep:
        made.blocks = graph.checkpointed(made.blocks.drop("content"))
    if "blocks" in keep:
        made.titles = graph.checkpointed(made.titles)
        made.blocks = graph.checkpointed(made.blocks.select("block_id", "source", "line", "content"))
    return made


#: d: each file's facts; b: its blocks with their place; l: its links.  ASCII only, so that columns are bytes.
SQL_VAULT = r"""d AS (SELECT doc_id AS i, doc_id % 3 AS third, 'notes/' || doc_id % 10 || '/' || doc_id || '.md' AS path, trim(regexp_replace(coalesce(text, ''), '[^A-Za-z]+', ' ', 'g')) AS clean,
  regexp_replace(coalesce(source, ''), '[^A-Za-z0-9]+', '', 'g') AS src, coalesce(lang, '') AS lang FROM documents),
p AS (SELECT *, CASE third WHEN 0 THEN '---' || chr(10) || 'title: Doc ' || i || chr(10) || 'tags: ' || lang || chr(10) || '---' || chr(10) WHEN 1 THEN '---' || chr(10) || 'tags: ' || lang || chr(10) || '---' || chr(10) ELSE '' END AS matter,
  CASE third WHEN 0 THEN 4 WHEN 1 THEN 3 ELSE 0 END AS before,
  'See [[' || (i + 1) || ']] and [[Doc ' || (i + 2) || '|alias]] then ![[notes/' || (i + 3) % 10 || '/' || (i + 3) || '#Links]] or [[missing ' || i || ']] and [[' || (i - 1) || '#^r' || (i - 1) || ']].' AS seen,
  'last words of ' || i || chr(10) || '^r' || i AS last FROM d),
q AS (SELECT *, list_filter([
  {'k': 'heading', 'l': 1, 'c': CASE WHEN third < 2 THEN '# Heading ' || i END, 'r': NULL}, {'k': 'paragraph', 'l': 0, 'c': nullif(clean, ''), 'r': NULL}, {'k': 'list', 'l': 0, 'c': '- one ' || src || chr(10) || '- [x] two', 'r': NULL},
  {'k': 'quote', 'l': 0, 'c': '> said ' || lang, 'r': NULL}, {'k': 'code', 'l': 0, 'c': '```py' || chr(10) || 'code ' || i || chr(10) || chr(10) || 'more' || chr(10) || '```', 'r': NULL},
  {'k': 'heading', 'l': 2, 'c': '## Links', 'r': NULL}, {'k': 'paragraph', 'l': 0, 'c': seen, 'r': NULL}, {'k': 'heading', 'l': 3, 'c': '### Deep', 'r': NULL}, {'k': 'paragraph', 'l': 0, 'c': last, 'r': 'r' || i},
  {'k': 'heading', 'l': 2, 'c': '## End', 'r': NULL}, {'k': 'paragraph', 'l': 0, 'c': 'end.', 'r': NULL}], lambda x: x.c IS NOT NULL) AS bs FROM p),
o AS (SELECT i, path, before, unnest(bs) AS x, unnest(range(len(bs))) AS k FROM q),
b AS (SELECT i, path, k, x.k AS kind, x.l AS level, x.c AS content, x.r AS ref, before + coalesce(sum(length(x.c) - length(replace(x.c, chr(10), '')) + 2) OVER (PARTITION BY i ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line FROM o),
f AS (SELECT i, path, matter || array_to_string(list_transform(bs, lambda x: x.c), chr(10) || chr(10)) || chr(10) AS content FROM q),
t AS (SELECT i, path, third, matter, clean, src, lang, CASE third WHEN 0 THEN 'Doc ' || i WHEN 1 THEN 'Heading ' || i ELSE i::VARCHAR END AS title FROM p),
s AS (SELECT i, path, line, content FROM b WHERE kind = 'paragraph' AND starts_with(content, 'See [[')),
r AS (SELECT i, path, line, content, unnest([
  {'raw': '[[' || (i + 1) || ']]', 'target': (i + 1)::VARCHAR, 'heading': NULL, 'ref': NULL, 'display': NULL, 'kind': 'wiki', 'to': i + 1},
  {'raw': '[[Doc ' || (i + 2) || '|alias]]', 'target': 'Doc ' || (i + 2), 'heading': NULL, 'ref': NULL, 'display': 'alias', 'kind': 'wiki', 'to': CASE WHEN (i + 2) % 3 = 0 THEN i + 2 END},
  {'raw': '![[notes/' || (i + 3) % 10 || '/' || (i + 3) || '#Links]]', 'target': 'notes/' || (i + 3) % 10 || '/' || (i + 3), 'heading': 'Links', 'ref': NULL, 'display': NULL, 'kind': 'embed_heading', 'to': i + 3},
  {'raw': '[[missing ' || i || ']]', 'target': 'missing ' || i, 'heading': NULL, 'ref': NULL, 'display': NULL, 'kind': 'wiki', 'to': NULL},
  {'raw': '[[' || (i - 1) || '#^r' || (i - 1) || ']]', 'target': (i - 1)::VARCHAR, 'heading': NULL, 'ref': 'r' || (i - 1), 'display': NULL, 'kind': 'wiki_block', 'to': i - 1}]) AS x FROM s),
l AS (SELECT r.i, r.path AS source, r.line, instr(r.content, x.raw) - 1 AS col, x.raw AS raw, x.target AS target, x.heading AS heading, x.ref AS block_ref, x.display AS display, x.kind AS link_type, t.path AS file_id, t.i AS j, r.content AS context FROM r LEFT JOIN t ON t.i = r.x.to)"""


def vault_documents(spark, sf_dir):
    return markdown.facts(engine(spark, sf_dir).files).select("id", "path", "title", "content_hash", "size_bytes", "word_count", "frontmatter")


def vault_blocks(spark, sf_dir):
    made = engine(spark, sf_dir).placed_blocks()
    return made.select(F.col("source").alias("path"), F.col("order_index").cast("long").alias("order_index"), "block_type", F.col("level").cast("long").alias("level"), "content_hash", F.col("line").cast("long").alias("line"), "user_ref")


def vault_outline(spark, sf_dir):
    return engine(spark, sf_dir).outline().select("path", F.col("level").cast("long").alias("level"), "text", F.col("line").cast("long").alias("line"))


def vault_sections(spark, sf_dir):
    made = engine(spark, sf_dir)
    found = markdown.sections(made.placed_blocks().withColumn("file_id", F.col("source")))
    return found.select(F.col("file_id").alias("path"), "heading", F.col("line").cast("long").alias("line"), F.col("stop").cast("long").alias("stop"))


def vault_links(spark, sf_dir):
    return engine(spark, sf_dir, "links").links.select("source", "raw", F.col("line").cast("long").alias("line"), F.col("column").cast("long").alias("col"), "target", "heading", "block_ref", "display", "link_type", "file_id", "is_resolved")


def vault_backlinks(spark, sf_dir):
    """Backlinks of every file with the source's title and the block that each stands in."""
    return engine(spark, sf_dir, "links").contexts().select(F.col("file_id").alias("path"), "source", "source_title", F.col("line").cast("long").alias("line"), F.col("column").cast("long").alias("col"), "block_type", F.sha2("context", 256).alias("context_hash"))


def vault_block_refs(spark, sf_dir):
    made = engine(spark, sf_dir, "links", "anchors")
    named = made.blocks.select(F.col("block_id").alias("target_block_id"), F.col("content_hash").alias("target_hash"))
    return made.block_targets().join(named, "target_block_id", "left").select("source", "block_ref", "file_id", "target_hash")


def vault_embeds(spark, sf_dir):
    return engine(spark, sf_dir, "links").embeds().select("source", F.col("column").cast("long").alias("col"), F.sha2("shown", 256).alias("shown_hash"))


def vault_degrees(spark, sf_dir):
    return engine(spark, sf_dir, "links").degrees().select(F.col("id").alias("path"), "degree")


def vault_tree(spark, sf_dir):
    return sources.tree(files(spark, sf_dir)).select("path", "name", F.col("depth").cast("long").alias("depth"), "is_dir")


def vault_listing(spark, sf_dir):
    return sources.listing(files(spark, sf_dir))


def vault_candidates(spark, sf_dir):
    return engine(spark, sf_dir).candidates("doc 1", 40).select("path", "title", "modified_at")


def vault_read(spark, sf_dir):
    return engine(spark, sf_dir).read("notes/7/7.md").select("path", F.sha2("content", 256).alias("hash"))


def vault_suggestion(spark, sf_dir):
    """Each file with a link under "## Related": files of even number have the heading already, at the end or before
    another one, and those that eight divides with a rest of four the link too."""
    i = F.regexp_extract("path", r"/(\d+)\.md$", 1)
    rest = F.pmod(i.cast("long"), F.lit(4))
    end = F.concat("content", F.lit("\n## Related\n\n- [["), i, F.lit("]]\n"))
    middle = F.concat(F.lit("# T "), i, F.lit("\n\n## Related\n\n- [[x]]\n\n## Next\n\n"), "content")
    text = F.when(rest == 0, end).when(rest == 2, middle).otherwise(F.col("content"))
    target = F.when(F.pmod(i.cast("long"), F.lit(8)) == 4, i).otherwise(F.concat(F.lit("to "), i))
    return files(spark, sf_dir).select("path", F.sha2(api.with_related(text, target), 256).alias("hash"))


def search_hits(spark, sf_dir):
    """Hybrid hits as a user sees them: block, path, title, line and snippet, with pages as media by their descriptions."""
    from . import streams

    made = engine(spark, sf_dir, "blocks")
    pages = streams._page_files(spark, sf_dir).select("path", streams.media.description(F.col("path"), F.col("size")).alias("description"))
    found = made.search("links site audio", "hybrid", 30, pages)
    return found.select("block_id", "score", "matched_via", "path", "title", "line", "snippet")


def _sql_search() -> str:
    from ..functions import text as T
    from ..operators import fulltext, vector

    words = ["links", "site", "audio"]
    wanted = vector.places(words)
    norm = sum(v * v for v in wanted.values()) ** 0.5
    found = " + ".join(f"greatest(ln((n - d{k} + .5) / (d{k} + .5)), 1e-6) * tf{k} * 2.2 / (tf{k} + 1.2 * (.25::DOUBLE + .75::DOUBLE * length / mean))" for k in range(3))
    return SQL_VAULT + f""", pages_ AS (SELECT 'site/' || page_id || CASE page_id % 3 WHEN 0 THEN '.MP3' WHEN 1 THEN '.png' ELSE '.txt' END AS path, page_id, octet_length(encode(html)) AS z, CASE page_id % 3 WHEN 0 THEN 'audio' WHEN 1 THEN 'image' END AS kind FROM pages),
m AS (SELECT path AS block_id, path, regexp_extract(path, '[^/]+$') AS title, NULL::BIGINT AS line, coalesce(kind || ' ', '') || page_id || ' site ' || CASE WHEN z < 1024 THEN z || 'B' WHEN z < 1048576 THEN printf('%.1fKB', z / 1024.0::DOUBLE) ELSE printf('%.1fMB', z / 1048576.0::DOUBLE) END AS content FROM pages_),
bb AS (SELECT sha256(sha256(b.path) || '|' || k) AS block_id, b.path, title, line::BIGINT AS line, content FROM b JOIN t USING (i)), every AS (SELECT * FROM bb UNION ALL SELECT * FROM m),
tk AS (SELECT block_id, {T.SQL_TOKENS.format('content')} AS t FROM every),
ft0 AS (SELECT block_id, unnest(list_concat(t, list_transform(range(len(t) - 1), lambda i: t[(i + 1)::BIGINT] || ' ' || t[(i + 2)::BIGINT]))) AS feature FROM tk),
dd AS (SELECT feature, {T.sql_fnv('feature')} AS h FROM (SELECT DISTINCT feature FROM ft0)),
w AS (SELECT block_id, (h % 384)::INT AS place, sum(CASE WHEN (h // 72057594037927936::UHUGEINT) % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS v FROM ft0 JOIN dd USING (feature) GROUP BY 1, 2),
qq(place, x) AS (VALUES {', '.join(f'({k}, {v})' for k, v in wanted.items())}),
sem AS (SELECT block_id, round(coalesce(sum(v * x), 0) / (sqrt(sum(v * v)) * {norm!r}), 6) AS score FROM w LEFT JOIN qq USING (place) GROUP BY block_id HAVING sum(v * v) > 0 AND round(coalesce(sum(v * x), 0) / (sqrt(sum(v * v)) * {norm!r}), 6) > 0.01),
fw AS (SELECT block_id, list_filter(regexp_split_to_array(translate(lower(content), '{fulltext.MARKED}', '{fulltext.PLAIN}'), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM bb),
fm AS (SELECT block_id, len(w) AS length, {', '.join(f"len(list_filter(w, lambda x: starts_with(x, '{x}'))) AS tf{k}" for k, x in enumerate(words))} FROM fw),
ft AS (SELECT count(*)::DOUBLE AS n, avg(length) AS mean, {', '.join(f'sum((tf{k} > 0)::INT)::DOUBLE AS d{k}' for k in range(3))} FROM fm),
fts AS (SELECT block_id, round({found}, 6) AS score FROM fm, ft WHERE tf0 > 0 AND tf1 > 0 AND tf2 > 0),
rr AS (SELECT block_id, 'semantic' AS leg, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY score DESC, block_id)) AS share FROM (SELECT * FROM sem ORDER BY score DESC, block_id LIMIT 90)
      UNION ALL SELECT block_id, 'fts', 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY score DESC, block_id)) FROM (SELECT * FROM fts ORDER BY score DESC, block_id LIMIT 90)),
hits AS (SELECT block_id, round(sum(share), 6) AS score, CASE WHEN count(DISTINCT leg) > 1 THEN 'both' ELSE min(leg) END AS matched_via FROM rr GROUP BY block_id ORDER BY score DESC, block_id LIMIT 30)
SELECT block_id, score, matched_via, path, title, line, replace(substring(content, 1, 180), chr(10), ' ') || CASE WHEN length(content) > 180 THEN '…' ELSE '' END AS snippet FROM hits JOIN every USING (block_id)"""


def queries() -> dict:
    named = [vault_documents, vault_blocks, vault_outline, vault_sections, vault_links, vault_backlinks, vault_block_refs, vault_embeds, vault_degrees, vault_tree, vault_listing, vault_candidates, vault_read, vault_suggestion, search_hits]
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    v = f"WITH {SQL_VAULT} "
    words = "CASE WHEN third < 2 THEN 2 ELSE 0 END + CASE WHEN clean = '' THEN 0 ELSE len(string_split(clean, ' ')) END + 1 + (src <> '')::INT + 1 + 1 + (lang <> '')::INT + 3 + 1 + 12 + 1 + 5 + 1 + 1"
    body = "(SELECT array_to_string(list(content ORDER BY k), chr(10) || chr(10)) || chr(10) FROM b WHERE b.i = l.j)"
    return {
        "vault_documents": v + f"SELECT sha256(t.path) AS id, t.path, title, sha256(content) AS content_hash, octet_length(encode(content)) AS size_bytes, ({words})::BIGINT AS word_count, CASE third WHEN 0 THEN 'title: Doc ' || t.i || chr(10) || 'tags: ' || lang WHEN 1 THEN 'tags: ' || lang END AS frontmatter FROM t JOIN f USING (i)",
        "vault_blocks": v + "SELECT path, k AS order_index, kind AS block_type, level::BIGINT AS level, sha256(rtrim(content, chr(10))) AS content_hash, line::BIGINT AS line, ref AS user_ref FROM b",
        "vault_outline": v + "SELECT path, level::BIGINT AS level, trim(ltrim(content, '#')) AS text, line::BIGINT AS line FROM b WHERE kind = 'heading'",
        "vault_sections": v + "SELECT a.path, trim(ltrim(a.content, '#')) AS heading, a.line::BIGINT AS line, (SELECT min(z.line) FROM b z WHERE z.i = a.i AND z.kind = 'heading' AND z.k > a.k AND z.level <= a.level)::BIGINT AS stop FROM b a WHERE a.kind = 'heading'",
        "vault_links": v + "SELECT source, raw, line::BIGINT AS line, col, target, heading, block_ref, display, link_type, file_id, file_id IS NOT NULL AS is_resolved FROM l",
        "vault_backlinks": v + "SELECT file_id AS path, source, title AS source_title, line::BIGINT AS line, col, 'paragraph' AS block_type, sha256(context) AS context_hash FROM l JOIN t ON t.i = l.i WHERE file_id IS NOT NULL",
        "vault_block_refs": v + "SELECT source, block_ref, file_id, CASE WHEN file_id IS NOT NULL THEN sha256('last words of ' || j || chr(10) || '^r' || j) END AS target_hash FROM l WHERE block_ref IS NOT NULL",
        "vault_embeds": v + f"SELECT source, col, sha256(CASE WHEN block_ref IS NOT NULL THEN 'last words of ' || j || chr(10) || '^r' || j WHEN heading IS NOT NULL THEN (SELECT array_to_string(list(content ORDER BY k), chr(10) || chr(10)) FROM b WHERE b.i = l.j AND b.k >= (SELECT k FROM b z WHERE z.i = l.j AND z.content = '## Links') AND b.k < (SELECT k FROM b z WHERE z.i = l.j AND z.content = '## End')) ELSE {body} END) AS shown_hash FROM l WHERE file_id IS NOT NULL",
        "vault_degrees": v + "SELECT t.path, coalesce(n, 0) AS degree FROM t LEFT JOIN (SELECT e, count(*) AS n FROM (SELECT unnest([x, y]) AS e FROM (SELECT DISTINCT least(i, j) AS x, greatest(i, j) AS y FROM l WHERE j IS NOT NULL AND i <> j)) GROUP BY 1) ON e = t.i",
        "vault_tree": v + "SELECT path, regexp_extract(path, '[^/]+$') AS name, len(string_split(path, '/')) AS depth, NOT ends_with(path, '.md') AS is_dir FROM (SELECT 'notes' AS path UNION SELECT 'notes/' || i % 10 FROM d UNION SELECT path FROM d)",
        "vault_listing": v + "SELECT path, octet_length(encode(content)) AS size_bytes, i * 1000 AS modified_at FROM f",
        "vault_candidates": v + "SELECT path, title, i * 1000 AS modified_at FROM t WHERE contains(lower(path), 'doc 1') OR contains(lower(title), 'doc 1') ORDER BY i DESC, path LIMIT 40",
        "vault_read": v + "SELECT path, sha256(content) AS hash FROM f WHERE i = 7",
        "vault_suggestion": v + """, c AS (SELECT *, chr(10) || chr(10) AS z FROM f)
SELECT path, sha256(CASE WHEN i % 8 = 4 THEN content || chr(10) || '## Related' || z || '- [[' || i || ']]' || chr(10) WHEN i % 4 = 0 THEN content || chr(10) || '## Related' || z || '- [[' || i || ']]' || chr(10) || '- [[to ' || i || ']]' || chr(10)
  WHEN i % 4 = 2 THEN '# T ' || i || z || '## Related' || z || '- [[x]]' || chr(10) || '- [[to ' || i || ']]' || z || '## Next' || z || content ELSE rtrim(content, chr(10)) || z || '## Related' || z || '- [[to ' || i || ']]' || chr(10) END) AS hash FROM c""",
        "search_hits": "WITH " + _sql_search(),
    }
