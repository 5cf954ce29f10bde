"""Registered telemetry, state and mutation queries with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import links, mutations, state, telemetry
from .retrieval import table, texts

NOW = "TIMESTAMP '2024-01-20 18:00:00'"
TYPES = ["click", "error", "purchase", "signup", "view"]


def ledger(spark, sf_dir):
    return ledger_of(table(spark, sf_dir, "events"))


def ledger_of(e):
    """events as a ledger: value in cents becomes cost units, k of the props becomes token counts."""
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select("event_id", "ts", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("user_id").alias("actor"), F.col("event_type").alias("operation"), telemetry.units(F.col("value")).alias("cost"), (k * 3).alias("input"), (k % 7).alias("cache_write"), (k * 2).alias("cache_read"), (k % 50).alias("output"))


SQL_L = "l AS (SELECT event_id, ts, strftime(ts, '%Y-%m-%d') AS day, user_id AS actor, event_type AS operation, round(value * 10000)::BIGINT AS cost, k * 3 AS input, k % 7 AS cache_write, k * 2 AS cache_read, k % 50 AS output FROM (SELECT *, (props::JSON->>'k')::BIGINT AS k FROM events))"


def daily_cost(spark, sf_dir):
    return telemetry.since_midnight(ledger(spark, sf_dir), F.expr(NOW))


def cache_hit_ratio(spark, sf_dir):
    return telemetry.cache_ratio(ledger(spark, sf_dir), F.expr(NOW), 24)


def recent_log(spark, sf_dir):
    return ledger(spark, sf_dir).orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "actor", "operation", "cost")


def budget_running_sum(spark, sf_dir):
    return telemetry.running_budget(ledger(spark, sf_dir), 500 * 10_000).select("event_id", "spent_before", "allowed")


def ledger_rollup(spark, sf_dir):
    made = ledger(spark, sf_dir).rollup("day", "operation").agg(F.count(F.lit(1)).alias("n"), F.sum("cost").alias("cost"), F.grouping_id().alias("level"))
    return made.select("day", "operation", "n", "cost", F.col("level").cast("long").alias("level"))


def model_costs(spark, sf_dir):
    """Cents by operation and model class, each event priced as if its operation's model had served it."""
    name = F.when(F.col("operation") == "click", "small-haiku-1").when(F.col("operation") == "view", "big-opus-2").otherwise("other")
    priced = ledger(spark, sf_dir).select("operation", telemetry.cost_cents(name, (F.col("input"), F.col("cache_write"), F.col("cache_read"), F.col("output"))).alias("cents"))
    return priced.groupBy("operation").agg(F.round(F.sum("cents"), 6).alias("cents"))


def wilson_ab(spark, sf_dir):
    rated = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    counted = rated.groupBy("source").agg(F.sum(F.col("quality").cast("long")).alias("positive"), F.count(F.lit(1)).alias("n"))
    low, high = telemetry.wilson(F.col("positive"), F.col("n"))
    return counted.select("source", "positive", "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def wilson_promotion(spark, sf_dir):
    rated = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")
    counted = rated.groupBy(F.col("lang").alias("name"), F.col("source").alias("version")).agg(F.sum(F.col("quality").cast("long")).alias("positive"), F.count(F.lit(1)).alias("n"))
    low, _ = telemetry.wilson(F.col("positive"), F.col("n"))
    return telemetry.promoted(counted.withColumn("low", F.round(low, 6)))


def champion_version(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), F.col("event_id").alias("version"), F.col("props").alias("body"))
    return telemetry.champions(e, "name", "version", "body")


def ema_state(spark, sf_dir):
    """State of each user over one-hot event types."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.array(*[(F.col("event_type") == t).cast("double") for t in TYPES]).alias("x"))
    made = state.ema(e, "user_id", ["ts", "event_id"], "x", len(TYPES))
    return made.select("user_id", "steps", *[F.round(F.get("state", F.lit(i)), 6).alias(t) for i, t in enumerate(TYPES)])


def learning_progress(spark, sf_dir):
    made = state.learning_progress(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value")
    return made.select("event_id", F.round("progress", 6).alias("progress"))


def debounced_trigger(spark, sf_dir):
    return state.debounced(table(spark, sf_dir, "events").withColumn("fires", F.col("value") >= 40), "user_id", ["ts", "event_id"], "fires", 10)


def _everyone(spark, sf_dir):
    """events as the rows of one key."""
    return table(spark, sf_dir, "events").withColumn("everyone", F.lit(0).cast("long"))


def budget_of_all(spark, sf_dir):
    """One budget for all events: one key has every row, in chunks at every size."""
    made = telemetry.running_budget(ledger(spark, sf_dir).withColumn("all", F.lit(0)), 20_000 * 10_000, "all", largest=0)
    return made.select("event_id", "spent_before", "allowed")


def progress_of_all(spark, sf_dir):
    made = state.learning_progress(_everyone(spark, sf_dir), "everyone", ["ts", "event_id"], "value", largest=0)
    return made.select("event_id", F.round("progress", 6).alias("progress"))


def debounced_of_all(spark, sf_dir):
    fires = _everyone(spark, sf_dir).withColumn("fires", F.col("value") >= 40)
    return state.debounced(fires, "everyone", ["ts", "event_id"], "fires", 10, largest=0).select("tick")


def asof_click_of_all(spark, sf_dir):
    """Each purchase with the last click of anyone at or before it; of clicks at one time, the one of the largest number."""
    events = _everyone(spark, sf_dir)
    bought = events.where("event_type = 'purchase'").select("everyone", "ts", "event_id")
    clicks = events.where("event_type = 'click'").select("everyone", "ts", F.col("event_id").alias("click"))
    return links.as_of(bought, clicks, "everyone", "ts", "click", largest=0).select("event_id", "click_as_of")


def _fact_events(spark, sf_dir):
    """Each event changes its user's fact of that type: errors below 5 delete, others add or update it."""
    op = F.when((F.col("value") < 5), "DELETE").when(F.col("value") < 20, "ADD").otherwise("UPDATE")
    return table(spark, sf_dir, "events").select(F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("fact_id"), "event_id", op.alias("op"), "value")


def fact_current_state(spark, sf_dir):
    return state.current(_fact_events(spark, sf_dir), "fact_id", ["event_id"])


def fact_history(spark, sf_dir):
    """Every change of every fact, numbered in its fact's order, with the value before it."""
    by = Window.partitionBy("fact_id").orderBy("event_id")
    return _fact_events(spark, sf_dir).select("fact_id", F.row_number().over(by).cast("long").alias("step"), "event_id", "op", F.lag("value").over(by).alias("prev_value"), F.col("value").alias("new_value"))


def fact_counts(spark, sf_dir):
    return _fact_events(spark, sf_dir).groupBy("op").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("fact_id").alias("facts"))


#: Heads in turn, and none twice: the tables hold no English prose.
_HEADS = [h[0].upper() + h[1:] for h in state.HEADS] + ["", "Nobody "]


def about_oneself(text):
    """Sentences with the heads of sentences about oneself in turn, so that each head, and none, occurs."""
    heads = F.array(*map(F.lit, _HEADS))
    said = F.transform(F.split(text, r"[.!?\n]"), lambda s, i: F.concat(F.get(heads, i % len(_HEADS)), F.trim(s)))
    return F.array_join(said, ". ")


def fact_extract(spark, sf_dir):
    """Facts in whole documents whose sentences have every head in turn."""
    return texts(spark, sf_dir).select("doc_id", F.posexplode(state.facts_in(about_oneself(F.coalesce("text", F.lit(""))))).alias("part", "fact")).withColumn("part", F.col("part").cast("long"))


def fact_decide(spark, sf_dir):
    """What each turn would do to the five turns of its conversation before it as facts, by shared words as similarity."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    before = Window.partitionBy("conv_id").orderBy("turn", "text").rowsBetween(-5, -1)
    seen = turns.withColumn("words", F.array_distinct(T.tokens(F.col("text")))).withColumn("near", F.collect_list(F.struct("turn", "text", "words")).over(before))

    def shared(n):
        union = F.size(F.array_union("words", n["words"]))
        return F.when(union > 0, F.size(F.array_intersect("words", n["words"])) / union).otherwise(F.lit(0.0))

    ranked = F.array_sort(F.transform("near", lambda n: F.struct((-shared(n)).alias("less"), n["turn"].cast("string").alias("id"), n["text"].alias("text"))))
    near = F.transform(ranked, lambda n: F.struct(n["id"].alias("id"), n["text"].alias("text"), (-n["less"]).alias("sim")))
    return seen.withColumn("d", state.decided(F.col("text"), near)).select("conv_id", "turn", F.col("d.op").alias("op"), F.col("d.about").cast("long").alias("about"))


def upsert_merge(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    new = c.where("c_mktsegment = 'BUILDING'").select((F.col("c_custkey") + F.when(F.col("c_acctbal") >= 0, 0).otherwise(10_000_000)).alias("c_custkey"), F.concat("c_name", F.lit("*")).alias("c_name"), "c_nationkey", (F.col("c_acctbal") + 1).alias("c_acctbal"), "c_mktsegment")
    return mutations.upserted(c, new, "c_custkey", ["c_name"]).select("c_custkey", "c_name", F.round("c_acctbal", 2).alias("c_acctbal"))


def replace_partition(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    new = o.where("o_orderstatus = 'F'").withColumn("o_orderstatus", F.lit("N"))
    return mutations.replaced(o, new, "o_custkey")


def cascade_delete(spark, sf_dir):
    gone = table(spark, sf_dir, "customer").where("c_acctbal < 0")
    return mutations.cascaded(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), gone, "o_custkey", "c_custkey")


def set_null_delete(spark, sf_dir):
    gone = table(spark, sf_dir, "customer").where("c_acctbal < 0")
    return mutations.nulled(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), gone, "o_custkey", "c_custkey")


def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("value"))


def queries() -> dict:
    named = [daily_cost, cache_hit_ratio, recent_log, budget_running_sum, budget_of_all, progress_of_all, debounced_of_all, asof_click_of_all, ledger_rollup, model_costs, wilson_ab, wilson_promotion, champion_version, ema_state, learning_progress, debounced_trigger, fact_current_state, fact_history, fact_counts, fact_extract, fact_decide, upsert_merge, replace_partition, cascade_delete, set_null_delete, json_props]
    return {f.__name__: f for f in named}


def _wilson(p: str, n: str) -> tuple[str, str]:
    a = f"({p}::DOUBLE / {n} + 3.8416 / (2.0::DOUBLE * {n}))"
    b = f"(1.96::DOUBLE * sqrt({p}::DOUBLE / {n} * (1 - {p}::DOUBLE / {n}) / {n} + 3.8416::DOUBLE / (4.0::DOUBLE * {n} * {n})))"
    return f"round(greatest(({a} - {b}) / (1 + 3.8416::DOUBLE / {n}), 0), 6)", f"round(least(({a} + {b}) / (1 + 3.8416::DOUBLE / {n}), 1), 6)"


def _negated() -> str:
    padded = "(' ' || lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) || ' ')"
    return "(" + " OR ".join("contains({}, '{}')".format(padded, n.replace("'", "''")) for n in state.NEGATIONS) + ")"


def oracle_sql() -> dict[str, str]:
    low, high = _wilson("positive", "n")
    rates = {"click": (100.0, 125.0, 10.0, 500.0), "view": (1500.0, 1875.0, 150.0, 7500.0)}
    price = lambda r: f"(input * {r[0]}::DOUBLE + cache_write * {r[1]}::DOUBLE + cache_read * {r[2]}::DOUBLE + output * {r[3]}::DOUBLE) / 1e6"
    onehot = ", ".join(f"(event_type = '{t}')::INT::DOUBLE" for t in TYPES)
    numbered = "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events"
    return {
        "daily_cost": f"WITH {SQL_L} SELECT coalesce(sum(cost), 0)::BIGINT // 10000 AS cents FROM l WHERE ts >= date_trunc('day', {NOW}) AND ts <= {NOW}",
        "cache_hit_ratio": f"WITH {SQL_L} SELECT round(sum(cache_read)::DOUBLE / nullif(sum(cache_read) + sum(cache_write) + sum(input), 0), 6) AS ratio FROM l WHERE ts >= {NOW} - INTERVAL 24 HOUR AND ts <= {NOW}",
        "recent_log": f"WITH {SQL_L} SELECT event_id, actor, operation, cost FROM l ORDER BY ts DESC, event_id DESC LIMIT 50",
        "budget_running_sum": f"WITH {SQL_L}, s AS (SELECT event_id, coalesce(sum(cost) OVER (PARTITION BY day ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS spent_before FROM l) SELECT *, spent_before < 5000000 AS allowed FROM s",
        "ledger_rollup": f"WITH {SQL_L} SELECT day, operation, count(*) AS n, sum(cost)::BIGINT AS cost, grouping_id(day, operation) AS level FROM l GROUP BY ROLLUP (day, operation)",
        "model_costs": f"WITH {SQL_L} SELECT operation, round(sum(CASE operation WHEN 'click' THEN {price(rates['click'])} WHEN 'view' THEN {price(rates['view'])} ELSE {price((300.0, 375.0, 30.0, 1500.0))} END), 6) AS cents FROM l GROUP BY 1",
        "wilson_ab": f"WITH c AS (SELECT source, sum(quality)::BIGINT AS positive, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1) SELECT source, positive, n, {low} AS low, {high} AS high FROM c",
        "wilson_promotion": f"WITH c AS (SELECT lang AS name, source AS version, sum(quality)::BIGINT AS positive, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2), w AS (SELECT *, {low} AS low, row_number() OVER (PARTITION BY name ORDER BY version DESC) AS k FROM c) SELECT a.name, b.version AS champion, a.version AS challenger, a.low > b.low AS promote FROM w a JOIN w b ON a.name = b.name AND a.k = 1 AND b.k = 2",
        "champion_version": "SELECT event_type AS name, arg_max(props, event_id) AS body, max(event_id) AS version FROM events GROUP BY 1",
        "ema_state": f"""WITH RECURSIVE n AS (SELECT user_id, k, [{onehot}] AS x FROM ({numbered})),
r AS (SELECT user_id, 0::BIGINT AS k, [0.0, 0.0, 0.0, 0.0, 0.0]::DOUBLE[] AS h FROM (SELECT DISTINCT user_id FROM n) UNION ALL
      SELECT r.user_id, n.k, list_transform(list_transform(range(5), lambda i: 0.82::DOUBLE * r.h[(i + 1)::BIGINT] + 0.18::DOUBLE * n.x[(i + 1)::BIGINT]), lambda v: v / sqrt(list_sum(list_transform(list_transform(range(5), lambda i: 0.82::DOUBLE * r.h[(i + 1)::BIGINT] + 0.18::DOUBLE * n.x[(i + 1)::BIGINT]), lambda u: u * u)))) FROM r JOIN n ON n.user_id = r.user_id AND n.k = r.k + 1)
SELECT user_id, max(k) AS steps, {', '.join(f'round(arg_max(h, k)[{i + 1}], 6) AS {t}' for i, t in enumerate(TYPES))} FROM r GROUP BY 1""",
        "learning_progress": "SELECT event_id, round(CASE WHEN count(*) OVER f = 32 THEN avg(value) OVER a - avg(value) OVER b ELSE 0 END, 6) AS progress FROM events WINDOW f AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 31 PRECEDING AND CURRENT ROW), a AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 31 PRECEDING AND 16 PRECEDING), b AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 15 PRECEDING AND CURRENT ROW)",
        "debounced_trigger": f"""WITH RECURSIVE n AS (SELECT user_id, k - 1 AS tick FROM ({numbered}) WHERE value >= 40),
r AS (SELECT user_id, min(tick) AS tick FROM n GROUP BY 1 UNION ALL SELECT user_id, tick FROM (SELECT r.user_id, min(n.tick) AS tick FROM r JOIN n ON n.user_id = r.user_id AND n.tick >= r.tick + 10 GROUP BY r.user_id, r.tick))
SELECT user_id, tick FROM r""",
        "budget_of_all": f"WITH {SQL_L}, s AS (SELECT event_id, coalesce(sum(cost) OVER (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS spent_before FROM l) SELECT *, spent_before < 200000000 AS allowed FROM s",
        "progress_of_all": "SELECT event_id, round(CASE WHEN count(*) OVER f = 32 THEN avg(value) OVER a - avg(value) OVER b ELSE 0 END, 6) AS progress FROM events WINDOW f AS (ORDER BY ts, event_id ROWS BETWEEN 31 PRECEDING AND CURRENT ROW), a AS (ORDER BY ts, event_id ROWS BETWEEN 31 PRECEDING AND 16 PRECEDING), b AS (ORDER BY ts, event_id ROWS BETWEEN 15 PRECEDING AND CURRENT ROW)",
        "debounced_of_all": """WITH RECURSIVE n AS (SELECT k - 1 AS tick FROM (SELECT value, row_number() OVER (ORDER BY ts, event_id) AS k FROM events) WHERE value >= 40),
r AS (SELECT min(tick) AS tick FROM n UNION ALL SELECT tick FROM (SELECT min(n.tick) AS tick FROM r JOIN n ON n.tick >= r.tick + 10 GROUP BY r.tick))
SELECT tick FROM r""",
        "asof_click_of_all": "SELECT event_id, click_as_of FROM (SELECT event_id, event_type, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (ORDER BY ts, event_type = 'purchase', event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS click_as_of FROM events WHERE event_type IN ('click', 'purchase')) WHERE event_type = 'purchase'",
        "fact_current_state": "WITH e AS (SELECT user_id || '/' || event_type AS fact_id, event_id, CASE WHEN value < 5 THEN 'DELETE' WHEN value < 20 THEN 'ADD' ELSE 'UPDATE' END AS op, value FROM events) SELECT * FROM (SELECT fact_id, max(event_id) AS event_id, arg_max(op, event_id) AS op, arg_max(value, event_id) AS value FROM e GROUP BY 1) WHERE op <> 'DELETE'",
        "fact_history": "SELECT fact_id, row_number() OVER w AS step, event_id, op, lag(value) OVER w AS prev_value, value AS new_value FROM (SELECT user_id || '/' || event_type AS fact_id, event_id, CASE WHEN value < 5 THEN 'DELETE' WHEN value < 20 THEN 'ADD' ELSE 'UPDATE' END AS op, value FROM events) WINDOW w AS (PARTITION BY fact_id ORDER BY event_id)",
        "fact_counts": "SELECT CASE WHEN value < 5 THEN 'DELETE' WHEN value < 20 THEN 'ADD' ELSE 'UPDATE' END AS op, count(*) AS n, count(DISTINCT user_id || '/' || event_type) AS facts FROM events GROUP BY 1",
        "fact_extract": rf"""WITH s AS (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '[.!?\n]') AS p, [{', '.join("'" + h.replace("'", "''") + "'" for h in _HEADS)}] AS heads FROM documents),
t AS (SELECT doc_id, array_to_string(list_transform(p, lambda x, i: heads[((i - 1) % len(heads) + 1)::BIGINT] || trim(x)), '. ') AS said FROM s),
m AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(said, '[.!?\n]'), lambda s: trim(s)), lambda s: {' OR '.join("starts_with(lower(s), '" + h.replace("'", "''") + "')" for h in state.HEADS)}) AS f FROM t)
SELECT doc_id, unnest(range(len(f))) AS part, regexp_replace(unnest(f), '[,"]+$', '') AS fact FROM m""",
        "fact_decide": f"""WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(text, '')) AS k FROM conversations),
w AS (SELECT *, list_distinct({T.SQL_TOKENS.format('text')}) AS words, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS normal, {_negated()} AS neg FROM t),
p AS (SELECT a.conv_id, a.k, a.turn, octet_length(encode(a.text)) AS size, b.turn AS id, octet_length(encode(b.text)) AS b_size, a.normal = b.normal AS same, a.neg <> b.neg AS flips,
  coalesce(len(list_intersect(a.words, b.words))::DOUBLE / nullif(len(list_distinct(a.words || b.words)), 0), 0) AS sim,
  row_number() OVER (PARTITION BY a.conv_id, a.k ORDER BY coalesce(len(list_intersect(a.words, b.words))::DOUBLE / nullif(len(list_distinct(a.words || b.words)), 0), 0) DESC, b.turn::VARCHAR, b.text) AS place
  FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.k BETWEEN a.k - 5 AND a.k - 1),
g AS (SELECT conv_id, k, arg_min(id, place) FILTER (same) AS same_id, arg_min(id, place) FILTER (flips AND sim >= {state.CONTRARY}) AS flip_id, arg_min(id, place) AS first_id, max(sim) AS first_sim, arg_min(b_size < size, place) AS longer FROM p GROUP BY 1, 2),
d AS (SELECT t.conv_id, t.turn, same_id, flip_id, first_id, CASE WHEN same_id IS NOT NULL THEN 'NOOP' WHEN flip_id IS NOT NULL THEN 'DELETE' WHEN first_sim >= {state.DUPLICATE} THEN 'NOOP' WHEN first_sim >= {state.REFINED} AND longer THEN 'UPDATE' ELSE 'ADD' END AS op FROM t LEFT JOIN g USING (conv_id, k))
SELECT conv_id, turn, op, (CASE WHEN op <> 'ADD' THEN coalesce(same_id, flip_id, first_id) END)::BIGINT AS about FROM d""",
        "upsert_merge": "WITH n AS (SELECT c_custkey + CASE WHEN c_acctbal >= 0 THEN 0 ELSE 10000000 END AS c_custkey, c_name || '*' AS c_name, c_acctbal + 1 AS c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING') SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, coalesce(o.c_name, n.c_name) AS c_name, round(coalesce(n.c_acctbal, o.c_acctbal), 2) AS c_acctbal FROM customer o FULL JOIN n ON o.c_custkey = n.c_custkey",
        "replace_partition": "WITH n AS (SELECT o_custkey, o_orderkey, 'N' AS o_orderstatus FROM orders WHERE o_orderstatus = 'F') SELECT o_custkey, o_orderkey, o_orderstatus FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM n) UNION ALL SELECT * FROM n",
        "cascade_delete": "SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)",
        "set_null_delete": "SELECT o_orderkey, CASE WHEN o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) THEN o_custkey END AS o_custkey FROM orders",
        "json_props": "SELECT (props::JSON->>'k')::BIGINT AS k, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY 1",
    }
