"""Registered link, graph and community queries with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import links as L
from ..functions import text as T
from ..operators import blocks, communities, graph, links, partitions, vector
from .retrieval import table, vector_query


def edges_of(spark, sf_dir):
    return graph.co_occurrence(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey")


def _sets(spark, sf_dir):
    return blocks.sets_of(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey")


SQL_E = "i AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), e AS (SELECT a.l_partkey AS src, b.l_partkey AS dst, count(*) AS weight FROM i a JOIN i b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY 1, 2)"
SQL_NEAR = SQL_E + ", n AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e)"


def link_extract(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(L.hrefs(F.col("html"))).alias("place", "href")).withColumn("place", F.col("place").cast("long"))


def link_classify(spark, sf_dir):
    """Kinds of the pages' links, as if each were a wiki link to the path, an anchor or an embed by its place."""
    inner = F.concat(F.col("href"), F.when(F.col("place") % 3 == 1, "#Top").when(F.col("place") % 3 == 2, "#^ref").otherwise(""))
    made = link_extract(spark, sf_dir).withColumn("inner", inner).withColumn("embed", F.col("page_id") % 2 == 0)
    named = made.withColumns(L.parsed(F.col("inner")))
    return named.groupBy(L.link_type(F.col("embed"), F.col("block_ref"), F.col("heading")).alias("link_type")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("target").alias("targets"))


def link_resolve_priority(spark, sf_dir):
    """Names of parts that orders' clerks might type (path, file name or title), resolved to parts."""
    parts = table(spark, sf_dir, "part")
    files = parts.select(F.col("p_partkey").alias("file_id"), F.concat_ws("/", "p_brand", F.concat(F.concat_ws("-", "p_type", F.col("p_size").cast("string")), F.lit(".md"))).alias("path"), F.col("p_name").alias("title"))
    kind = F.pmod(F.col("p_partkey"), F.lit(4))
    typed = parts.select(F.col("p_partkey").alias("link_id"), F.when(kind == 0, F.concat_ws("/", "p_brand", F.concat_ws("-", "p_type", F.col("p_size").cast("string")))).when(kind == 1, F.concat_ws("-", "p_type", F.col("p_size").cast("string"))).when(kind == 2, F.col("p_name")).otherwise(F.concat(F.lit("missing "), "p_name")).alias("target"))
    return links.resolved(typed, files).select("link_id", "target", "file_id", F.col("tier").cast("int").alias("tier"))


SQL_RESOLVE = """WITH f AS (SELECT p_partkey AS file_id, p_brand || '/' || p_type || '-' || p_size || '.md' AS path, p_name AS title, p_type || '-' || p_size AS name FROM part),
l AS (SELECT p_partkey AS link_id, CASE p_partkey % 4 WHEN 0 THEN p_brand || '/' || p_type || '-' || p_size WHEN 1 THEN p_type || '-' || p_size WHEN 2 THEN p_name ELSE 'missing ' || p_name END AS target FROM part),
c AS (SELECT link_id, target, file_id, 1 AS tier, path FROM l JOIN f ON target = path OR target || '.md' = path UNION ALL SELECT link_id, target, file_id, 2, path FROM l JOIN f ON target = name UNION ALL SELECT link_id, target, file_id, 3, path FROM l JOIN f ON target = title),
r AS (SELECT *, row_number() OVER (PARTITION BY link_id ORDER BY tier, length(path), path, file_id) AS k FROM c)
SELECT l.link_id, l.target, r.file_id, r.tier::INT AS tier FROM l LEFT JOIN (SELECT * FROM r WHERE k = 1) r USING (link_id)"""


def _nodes(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))


def backlinks(spark, sf_dir):
    """Parts that are bought together with part 700 and have a smaller key."""
    found = links.backlinks(edges_of(spark, sf_dir), _nodes(spark, sf_dir), F.lit(700))
    return found.select("src", "src_name", "weight")


def outgoing_links(spark, sf_dir):
    """Orders' links to customers; each seventh order names a customer that isn't there, so its link is unresolved."""
    away = F.when(F.col("o_orderkey") % 7 == 0, F.lit(10_000_000)).otherwise(F.lit(0))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("src"), (F.col("o_custkey") + away).alias("dst"))
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return links.outgoing(orders, people).select("src", "dst", "dst_name", "is_resolved")


def orphans(spark, sf_dir):
    """Customers without a link: an order links its customer with the one whose key is the order's."""
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lower("c_name").alias("name"))
    made = table(spark, sf_dir, "orders").select((F.col("o_custkey") * 7).alias("src"), (F.col("o_orderkey") * 3).alias("dst"))
    return links.orphans(people, made).select("id", "name")


def dangling_edges(spark, sf_dir):
    """Lines whose part isn't there: each line with number 7 names one of those."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    away = F.when(F.col("l_linenumber") == 7, F.lit(10_000_000)).otherwise(F.lit(0))
    made = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), (F.col("l_partkey") + away).alias("dst"))
    return links.dangling(made, parts).groupBy("dst").agg(F.count(F.lit(1)).alias("n"))


def asof_source_block(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    bought = events.where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    clicks = events.where("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("click"))
    return links.as_of(bought, clicks, "user_id", "ts", "click").select("event_id", "user_id", "click_as_of")


def graph_degree(spark, sf_dir):
    return graph.degrees(edges_of(spark, sf_dir))


def graph_neighbours(spark, sf_dir):
    near = graph.both_ways(edges_of(spark, sf_dir))
    return near.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("neighbours"), F.min("dst").alias("first"), F.max("dst").alias("last"))


def graph_neighbour_lists(spark, sf_dir):
    """Both lists of every part, joined by commas."""
    made = graph.neighbour_lists(_nodes(spark, sf_dir), edges_of(spark, sf_dir))
    return made.select("id", *[F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c in ("links_to", "linked_from")])


def shared_neighbours(spark, sf_dir):
    made = blocks.dealt(_sets(spark, sf_dir))
    if made.closed:
        return blocks.shared(made)
    edges = graph.written(blocks.edges(made).select("src", "dst"))
    return graph.shared_neighbours(edges, edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))


def edge_weights(spark, sf_dir):
    return edges_of(spark, sf_dir)


def label_propagation_k(spark, sf_dir):
    return blocks.propagated(blocks.dealt(_sets(spark, sf_dir), _nodes(spark, sf_dir), fine=True), 3)


def modularity(spark, sf_dir):
    brands = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("label"))
    return graph.modularity(edges_of(spark, sf_dir), brands).select(F.round("q", 6).alias("q"))


def leiden(spark, sf_dir):
    return partitions.grouped(_nodes(spark, sf_dir), _sets(spark, sf_dir))


def layout(spark, sf_dir):
    return graph.layout_frame(spark, _nodes(spark, sf_dir), graph.group_pairs(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey"))


def community_members(spark, sf_dir):
    made = communities.members_of(table(spark, sf_dir, "embeddings"), "label", "vec_id")
    return made.select("label", F.col("n").alias("members"), F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("ids"))


def community_report(spark, sf_dir):
    return communities.report(table(spark, sf_dir, "embeddings"), "label")


def community_top_level(spark, sf_dir):
    """Rows of the highest level, by a scalar subquery."""
    levels = table(spark, sf_dir, "part").selectExpr("p_partkey", "p_size AS level")
    return spark.sql("SELECT p_partkey, level FROM {levels} WHERE level = (SELECT max(level) FROM {levels})", levels=levels)


def extractive_summary(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("title"), F.element_at(F.split(F.coalesce("text", F.lit("")), "\n"), 1).alias("lead"))
    return communities.summaries(docs, "source", "doc_id")


def _routed(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    wanted = vector_query(spark, sf_dir)
    means = communities.centroids(vectors, "label")
    asked = F.array(*[F.lit(float(x)) for x in wanted])
    norm = sum(float(x) ** 2 for x in wanted) ** 0.5
    scored = means.groupBy("label").agg(F.round(F.sum(F.col("v") * F.get(asked, F.col("place"))) / (F.sqrt(F.sum(F.col("v") * F.col("v"))) * norm), 6).alias("score"))
    return scored.join(vectors.groupBy("label").agg(F.count(F.lit(1)).alias("members")), "label")


def graphrag_query(spark, sf_dir):
    return _routed(spark, sf_dir).orderBy(F.desc("score"), "label").limit(3)


def graphrag_context(spark, sf_dir):
    place = F.row_number().over(Window.orderBy(F.desc("score"), "label"))  # three rows
    return communities.context(graphrag_query(spark, sf_dir).select(place.alias("rank"), "members", "score", F.concat(F.lit("label "), F.col("label").cast("string")).alias("summary")))


def queries() -> dict:
    named = [link_extract, link_classify, link_resolve_priority, backlinks, outgoing_links, orphans, dangling_edges, asof_source_block, graph_degree, graph_neighbours, graph_neighbour_lists, shared_neighbours, edge_weights, label_propagation_k, modularity, leiden, layout, community_members, community_report, community_top_level, extractive_summary, graphrag_query, graphrag_context]
    return {f.__name__: f for f in named}


def _lpa(rounds: int) -> str:
    sql = f"WITH {SQL_E}, n AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e), l0 AS (SELECT p_partkey AS id, p_partkey AS label FROM part)"
    for k in range(rounds):
        sql += f", v{k} AS (SELECT n.src AS id, l.label, count(*) AS c FROM n JOIN l{k} l ON l.id = n.dst GROUP BY 1, 2), w{k} AS (SELECT id, label, row_number() OVER (PARTITION BY id ORDER BY c DESC, label) AS k FROM v{k}), l{k + 1} AS (SELECT l.id, coalesce(w.label, l.label) AS label FROM l{k} l LEFT JOIN (SELECT * FROM w{k} WHERE k = 1) w ON w.id = l.id)"
    return f"{sql} SELECT id, label FROM l{rounds}"


_ROUTED = """v AS (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS place FROM embeddings), m AS (SELECT label, place, avg(x) AS x FROM v GROUP BY 1, 2),
q AS (SELECT unnest(embedding)::DOUBLE AS y, unnest(range(64)) AS place FROM embeddings WHERE vec_id = 0), qn AS (SELECT sqrt(sum(y * y)) AS n FROM q),
r AS (SELECT label, round(sum(x * y) / (sqrt(sum(x * x)) * any_value(n)), 6) AS score FROM m JOIN q USING (place), qn GROUP BY label),
g AS (SELECT r.label, score, c.members FROM r JOIN (SELECT label, count(*) AS members FROM embeddings GROUP BY 1) c USING (label) ORDER BY score DESC, label LIMIT 3)"""


def oracle_sql() -> dict[str, str]:
    hrefs = "SELECT page_id, unnest(h) AS href, unnest(range(len(h))) AS place FROM (SELECT page_id, regexp_extract_all(coalesce(html, ''), '<a href=\"([^\"]*)\"', 1) AS h FROM pages)"
    return {
        "link_extract": hrefs,
        "link_classify": f"WITH h AS ({hrefs}) SELECT (CASE WHEN page_id % 2 = 0 THEN 'embed' ELSE 'wiki' END) || (CASE place % 3 WHEN 1 THEN '_heading' WHEN 2 THEN '_block' ELSE '' END) AS link_type, count(*) AS n, count(DISTINCT trim(split_part(split_part(href, '|', 1), '#', 1))) AS targets FROM h GROUP BY 1",
        "link_resolve_priority": SQL_RESOLVE,
        "backlinks": f"WITH {SQL_E} SELECT src, p_name AS src_name, weight FROM e JOIN part ON p_partkey = src WHERE dst = 700",
        "outgoing_links": "SELECT o_orderkey AS src, k AS dst, c_name AS dst_name, c_name IS NOT NULL AS is_resolved FROM (SELECT o_orderkey, o_custkey + CASE WHEN o_orderkey % 7 = 0 THEN 10000000 ELSE 0 END AS k FROM orders) LEFT JOIN customer ON c_custkey = k",
        "orphans": "SELECT c_custkey AS id, lower(c_name) AS name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey * 7 FROM orders WHERE o_custkey IS NOT NULL UNION ALL SELECT o_orderkey * 3 FROM orders WHERE o_orderkey IS NOT NULL)",
        "dangling_edges": "SELECT k AS dst, count(*) AS n FROM (SELECT l_partkey + CASE WHEN l_linenumber = 7 THEN 10000000 ELSE 0 END AS k FROM lineitem) WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = k) GROUP BY 1",
        "asof_source_block": "SELECT p.event_id, p.user_id, c.event_id AS click_as_of FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON p.user_id = c.user_id AND p.ts >= c.ts",
        "graph_degree": f"WITH {SQL_NEAR} SELECT src AS id, count(*) AS degree FROM n GROUP BY 1",
        "graph_neighbours": f"WITH {SQL_NEAR} SELECT src AS id, count(*) AS neighbours, min(dst) AS first, max(dst) AS last FROM n GROUP BY 1",
        "shared_neighbours": f"WITH {SQL_NEAR} SELECT e.src AS a, e.dst AS b, count(y.dst) AS shared FROM e LEFT JOIN n x ON x.src = e.src LEFT JOIN n y ON y.src = e.dst AND y.dst = x.dst GROUP BY 1, 2",
        "graph_neighbour_lists": f"WITH {SQL_E}, t AS (SELECT src AS id, string_agg(dst::VARCHAR, ',' ORDER BY dst) AS links_to FROM e GROUP BY 1), f AS (SELECT dst AS id, string_agg(src::VARCHAR, ',' ORDER BY src) AS linked_from FROM e GROUP BY 1) SELECT p_partkey AS id, coalesce(links_to, '') AS links_to, coalesce(linked_from, '') AS linked_from FROM part LEFT JOIN t ON t.id = p_partkey LEFT JOIN f ON f.id = p_partkey",
        "edge_weights": f"WITH {SQL_E} SELECT * FROM e",
        "label_propagation_k": _lpa(3),
        "modularity": f"WITH {SQL_E}, m AS (SELECT a.p_brand AS ls, b.p_brand AS ld, weight FROM e JOIN part a ON a.p_partkey = src JOIN part b ON b.p_partkey = dst), w AS (SELECT label, sum(weight) AS ends FROM (SELECT ls AS label, weight FROM m UNION ALL SELECT ld, weight FROM m) GROUP BY 1) SELECT round((SELECT sum(weight) FROM m WHERE ls = ld)::DOUBLE / (sum(ends)::DOUBLE / 2) - sum(ends::DOUBLE * ends) / (sum(ends)::DOUBLE * sum(ends)), 6) AS q FROM w",
        "community_members": "SELECT label, count(*) AS members, string_agg(vec_id::VARCHAR, ',' ORDER BY vec_id) AS ids FROM embeddings GROUP BY 1",
        "community_report": "SELECT count(*) AS communities, sum(n)::BIGINT AS covered, round(avg(n), 6) AS mean_size, max(n) AS largest FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY 1)",
        "community_top_level": "SELECT p_partkey, p_size AS level FROM part WHERE p_size = (SELECT max(p_size) FROM part)",
        "extractive_summary": rf"""WITH RECURSIVE t AS (SELECT source, doc_id, trim(regexp_replace(split_part(coalesce(text, ''), chr(10), 1), '\s+', ' ', 'g')) AS l, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k, count(*) OVER (PARTITION BY source) AS members FROM documents),
b AS (SELECT source, k, members, '• doc ' || doc_id || CASE WHEN l = '' THEN '' ELSE ': ' || CASE WHEN length(l) > {communities.LEAD} THEN substring(l, 1, {communities.LEAD}) || '…' ELSE l END END || chr(10) AS entry FROM t),
r AS (SELECT source, 0::BIGINT AS k, ''::VARCHAR AS s, false AS stopped FROM (SELECT DISTINCT source FROM b) UNION ALL
      SELECT r.source, b.k, CASE WHEN octet_length(encode(r.s)) + octet_length(encode(b.entry)) <= {communities.CAP} THEN r.s || b.entry ELSE r.s END, octet_length(encode(r.s)) + octet_length(encode(b.entry)) > {communities.CAP} FROM r JOIN b ON b.source = r.source AND b.k = r.k + 1 WHERE NOT r.stopped)
SELECT r.source, any_value(m.members) AS members, rtrim(regexp_replace(arg_max(r.s, r.k), '\n+$', '')) AS summary FROM r JOIN (SELECT DISTINCT source, members FROM b) m USING (source) GROUP BY r.source""",
        "graphrag_context": f"""WITH {_ROUTED}, k AS (SELECT *, row_number() OVER (ORDER BY score DESC, label) AS rank FROM g),
p AS (SELECT trim(regexp_replace(string_agg('## Theme ' || rank || ' (notes: ' || members || ', score: ' || printf('%.3f', score) || ')' || chr(10) || 'label ' || label || chr(10) || chr(10), '' ORDER BY rank), '\\n+$', '')) AS payload, sum(members)::BIGINT AS covered FROM k)
SELECT payload, covered, ceil(octet_length(encode(payload)) / 4)::BIGINT AS tokens FROM p""",
        "graphrag_query": f"WITH {_ROUTED} SELECT * FROM g",
    }
