"""Registered streaming, hypervector and memory queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import media
from ..functions import text as T
from ..operators import blocks, graph, hyper, state
from ..streaming import bounded, jobs
from . import graphs
from .ledger import TYPES, _fact_events, about_oneself
from .retrieval import spread, table


def events_stream(spark, sf_dir):
    return jobs.stream_of(spark, f"{sf_dir}/events.parquet")


def stream_window_counts(spark, sf_dir):
    """Daily counts in complete form: every window, the last included."""
    made = jobs.windowed(events_stream(spark, sf_dir), late=None)
    return jobs.drained(made, "update", ["start", "event_type"]).withColumn("start", F.col("start").cast("timestamp_ntz"))


def stream_dedup(spark, sf_dir):
    kept = jobs.deduplicated(events_stream(spark, sf_dir).select("event_id", "user_id"), ["event_id"], late=None)
    return jobs.drained(kept).select("event_id", "user_id")


def stream_ema(spark, sf_dir):
    made = jobs.drained(jobs.moving_state(events_stream(spark, sf_dir), TYPES), "update", ["user_id"])
    return made.select("user_id", "steps", *[F.round(F.get("state", F.lit(i)), 6).alias(t) for i, t in enumerate(TYPES)])


def stream_triggers(spark, sf_dir):
    made = jobs.drained(jobs.triggers(events_stream(spark, sf_dir), 40, 10), "update", ["user_id"])
    return made.select("user_id", F.explode("ticks").alias("tick"))


def stream_firings_released(spark, sf_dir):
    """Firings of the rows that the watermark has passed, from a state of the rows within its delay."""
    made = bounded.firings(events_stream(spark, sf_dir), "user_id", "ts", "event_id", 40, 10, jobs.LATE)
    at = jobs.shared_folder(spark)
    return bounded.appended(made, f"{at}/out", f"{at}/log").select(F.col("key").alias("user_id"), "tick")


def stream_averages_released(spark, sf_dir):
    """The moving state of each user over the rows that the watermark has passed."""
    made = bounded.averages(events_stream(spark, sf_dir), "user_id", "ts", "event_id", "event_type", TYPES, jobs.LATE)
    at = jobs.shared_folder(spark)
    last = bounded.appended(made, f"{at}/out", f"{at}/log").groupBy("key").agg(F.max("steps").alias("steps"), F.max_by("state", "steps").alias("state"))
    return last.select(F.col("key").alias("user_id"), "steps", *[F.round(F.get("state", F.lit(i)), 6).alias(t) for i, t in enumerate(TYPES)])


def session_counts(spark, sf_dir):
    return jobs.sessions(table(spark, sf_dir, "events"))


def change_feed(spark, sf_dir):
    """Changes of facts between two days' snapshots."""
    e = _fact_events(spark, sf_dir).withColumn("content_hash", F.col("value").cast("string"))
    half = table(spark, sf_dir, "events").agg(F.floor(F.max("event_id") / 2)).first()[0] or 0
    at = lambda rows: state.current(rows, "fact_id", ["event_id"])
    return jobs.changes(at(e.where(F.col("event_id") <= half)), at(e), "fact_id")


def _part_tokens(spark, sf_dir):
    return spread(table(spark, sf_dir, "part")).select(F.col("p_partkey").alias("id"), T.tokens(F.concat_ws(" ", "p_name", "p_type", "p_brand")).alias("tokens"))


def _hypervectors(spark, sf_dir, made=None):
    return hyper.over_blocks(made or blocks.dealt(graphs._sets(spark, sf_dir)), _part_tokens(spark, sf_dir))


def hdc_related(spark, sf_dir):
    vectors = _hypervectors(spark, sf_dir)
    asked = vectors.where("id = 1").select("hv").first()
    return hyper.related(vectors.where("id != 1"), bytes(asked[0]), 20)


def hdc_suggest(spark, sf_dir):
    made = blocks.dealt(graphs._sets(spark, sf_dir))
    edges = graph.written(blocks.edges(made).select("src", "dst"))
    vectors = _hypervectors(spark, sf_dir, made)
    # A small table's pairs are compared as ``suggestions`` chooses; a large one's are found in its blocks where those are closed.
    apart = made if made.closed and vectors.count() > hyper.PAIRED else None
    return hyper.suggestions(vectors, edges, tokens=_part_tokens(spark, sf_dir), made=apart)


def vsa_recall(spark, sf_dir):
    """Each customer segment's nations as roles with the segment's count as value, stored in one vector and read back."""
    pairs = table(spark, sf_dir, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    made = hyper.recalled(pairs, "c_mktsegment", "c_nationkey", "n", hyper.DIM)
    return made.groupBy("key").agg(F.count(F.lit(1)).alias("pairs"), F.sum((F.col("value") == F.col("recalled")).cast("long")).alias("recovered"))


def fhrr_recall(spark, sf_dir):
    """The pairs of ``vsa_recall`` in complex vectors, where binding is undone by the conjugate."""
    pairs = table(spark, sf_dir, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    made = hyper.recalled_complex(pairs, "c_mktsegment", "c_nationkey", "n")
    return made.groupBy("key").agg(F.count(F.lit(1)).alias("pairs"), F.sum((F.col("value") == F.col("recalled")).cast("long")).alias("recovered"))


def _page_files(spark, sf_dir):
    path = F.concat(F.lit("site/"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 3 == 0, ".MP3").when(F.col("page_id") % 3 == 1, ".png").otherwise(".txt"))
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path"), F.octet_length("html").cast("long").alias("size"), "html")


def media_fingerprint(spark, sf_dir):
    """Pages as files: kind and description of each by its path and size; ``media_embedding`` has the fingerprints."""
    return _page_files(spark, sf_dir).select("page_id", media.kind(F.col("path")).alias("kind"), media.description(F.col("path"), F.col("size")).alias("description"))


def media_embedding(spark, sf_dir):
    """Pages as files: the description's words and the fingerprint of the bytes in one vector of each."""
    files = _page_files(spark, sf_dir).select("page_id", T.tokens(media.description(F.col("path"), F.col("size"))).alias("tokens"), "html")
    return media.embedded(spread(files), "page_id", "tokens", "html")


def memory_ingest(spark, sf_dir):
    """Facts of each conversation, in order: sentences of all turns get the heads of sentences about oneself in turn, two in seventeen none."""
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", about_oneself(F.coalesce("text", F.lit(""))).alias("text"))
    return state.remembered(said, "conv_id", "turn", "text")


def queries() -> dict:
    named = [stream_window_counts, stream_dedup, stream_ema, stream_triggers, stream_firings_released, stream_averages_released, session_counts, change_feed, hdc_related, hdc_suggest, vsa_recall, fhrr_recall, media_fingerprint, media_embedding, memory_ingest]
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    from . import ledger

    known = ledger.oracle_sql()
    passed = "FROM (SELECT * FROM events WHERE epoch_us(ts) <= (SELECT (epoch_us(max(ts)) // 1000 - 600000) * 1000 FROM events))"
    state_at = lambda cond: f"(SELECT fact_id, value FROM (SELECT fact_id, arg_max(op, event_id) AS op, arg_max(value, event_id) AS value FROM f WHERE {cond} GROUP BY 1) WHERE op <> 'DELETE')"
    return {
        "stream_window_counts": "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY 1, 2",
        "stream_dedup": "SELECT DISTINCT event_id, user_id FROM events",
        "stream_ema": known["ema_state"],
        "stream_triggers": known["debounced_trigger"],
        "stream_firings_released": known["debounced_trigger"].replace("FROM events", passed),
        "stream_averages_released": known["ema_state"].replace("FROM events", passed),
        "session_counts": "WITH s AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), n AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM s) SELECT user_id, min(ts)::TIMESTAMP AS start, count(*) AS n FROM n GROUP BY user_id, k",
        "change_feed": f"WITH f AS (SELECT user_id || '/' || event_type AS fact_id, event_id, CASE WHEN value < 5 THEN 'DELETE' WHEN value < 20 THEN 'ADD' ELSE 'UPDATE' END AS op, value FROM events), o AS {state_at('event_id <= (SELECT floor(max(event_id) / 2) FROM events)')}, n AS {state_at('true')} SELECT * FROM (SELECT coalesce(o.fact_id, n.fact_id) AS fact_id, CASE WHEN o.fact_id IS NULL THEN 'created' WHEN n.fact_id IS NULL THEN 'removed' WHEN o.value <> n.value THEN 'modified' END AS kind FROM o FULL JOIN n ON o.fact_id = n.fact_id) WHERE kind IS NOT NULL",
        "media_fingerprint": "WITH p AS (SELECT page_id, octet_length(encode(html)) AS s, CASE page_id % 3 WHEN 0 THEN 'audio' WHEN 1 THEN 'image' END AS kind FROM pages) SELECT page_id, kind, coalesce(kind || ' ', '') || page_id || ' site ' || CASE WHEN s < 1024 THEN s || 'B' WHEN s < 1048576 THEN printf('%.1fKB', s / 1024.0::DOUBLE) ELSE printf('%.1fMB', s / 1048576.0::DOUBLE) END AS description FROM p",
    }
