"""Ordered work over hot keys against plain Python: every case with chunks and without."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from mossgraph.operators import links, ordered, state, telemetry


def rows_of(seed: int, n: int = 900) -> list[tuple]:
    """(key, at, id, value): one key has two thirds of the rows, one is null, times tie and are null at times."""
    draw = random.Random(seed)
    return [(draw.choice(["hot"] * 6 + ["a", "b", None]), draw.choice([None] + list(range(200))), i, draw.choice([None, 0, 1, 5, 9])) for i in range(n)]


def in_order(rows: list[tuple]) -> dict:
    by: dict = {}
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        by.setdefault(r[0], []).append(r)
    return by


SCHEMA = "k string, at long, id long, v long"


@pytest.fixture(params=[0, 10**9], ids=["chunks", "windows"])
def largest(request):
    return request.param


def test_running_sums_and_ticks(spark, largest):
    rows = rows_of(1)
    frame = spark.createDataFrame(rows, SCHEMA)
    found = {r["id"]: (r["s"], r["tick"]) for r in ordered.ticked(ordered.running(frame, ["k"], ["at", "id"], F.col("v"), "s", largest), ["k"], ["at", "id"], "tick", largest).collect()}
    want = {}
    for held in in_order(rows).values():
        total = 0
        for tick, r in enumerate(held):
            want[r[2]] = (total, tick)
            total += r[3] or 0
    assert found == want


def test_latest_value(spark, largest):
    rows = rows_of(2)
    found = {r["id"]: r["last"] for r in ordered.latest(spark.createDataFrame(rows, SCHEMA), ["k"], ["at", "id"], "v", "last", largest).collect()}
    want = {}
    for held in in_order(rows).values():
        last = None
        for r in held:
            last = r[3] if r[3] is not None else last
            want[r[2]] = last
    assert found == want


def test_hot_key_spreads_over_the_chunks(spark):
    frame = spark.createDataFrame([("hot", i, i, 1) for i in range(4000)] + [("cold", i, i, 1) for i in range(500)], SCHEMA)
    sizes = [r["count"] for r in ordered.chunked(frame, ["k"], ["at", "id"], 8).groupBy("k", ordered.CHUNK).count().collect()]
    assert len(sizes) >= 8 and max(sizes) < 2 * 4500 / 8


def test_as_of_over_a_hot_key(spark, largest):
    draw = random.Random(4)
    left = [(draw.choice(["hot", "hot", "a", None]), draw.randrange(400), i) for i in range(500)]
    right = [(draw.choice(["hot", "hot", "a", None]), draw.randrange(400), 1000 + i) for i in range(300)]
    found = {r["id"]: r["w_as_of"] for r in links.as_of(spark.createDataFrame(left, "k string, t long, id long"), spark.createDataFrame(right, "k string, t long, w long"), "k", "t", "w", largest=largest).collect()}
    want = {i: max(((u, w) for q, u, w in right if q == k and u <= t), default=(None, None))[1] for k, t, i in left}
    assert found == want


@pytest.mark.parametrize("gap", [1, 3, 10])
@pytest.mark.parametrize("block", [16, 64])
def test_spaced_firings(spark, gap, block):
    draw = random.Random(gap * block)
    wanted = sorted({(draw.choice(["hot", "hot", "a", None]), draw.randrange(700)) for _ in range(600)}, key=str)
    frame = spark.createDataFrame([(k, t, f"r{t}") for k, t in wanted], "k string, tick long, why string")
    found = sorted(((r["k"], r["tick"], r["why"]) for r in ordered.spaced(frame, "k", gap, ["why"], block=block).collect()), key=str)
    want, last = [], {}
    for k, t in sorted(wanted, key=lambda x: x[1]):
        if k not in last or t - last[k] >= gap:
            last[k] = t
            want.append((k, t, f"r{t}"))
    assert found == sorted(want, key=str)


def test_debounce_and_progress_equal_plain_windows(spark, largest):
    rows = rows_of(5)
    frame = spark.createDataFrame([(k, a, i, float(v or 0)) for k, a, i, v in rows], "k string, at long, id long, v double")
    fired = {(r["k"], r["tick"]) for r in state.debounced(frame.withColumn("f", F.col("v") >= 5), "k", ["at", "id"], "f", 4, largest).collect()}
    want = set()
    for k, held in in_order(rows).items():
        last = None
        for tick, r in enumerate(held):
            if (r[3] or 0) >= 5 and (last is None or tick - last >= 4):
                want.add((k, tick))
                last = tick
    assert fired == want
    found = {r["id"]: r["progress"] for r in state.learning_progress(frame, "k", ["at", "id"], "v", 8, largest).collect()}
    for held in in_order(rows).values():
        values = [float(r[3] or 0) for r in held]
        for n, r in enumerate(held):
            near = values[max(0, n - 7) : n + 1]
            assert found[r[2]] == pytest.approx(sum(near[:4]) / 4 - sum(near[4:]) / 4 if len(near) == 8 else 0.0)


def test_blocks_of_sliding_windows(spark):
    ticks = spark.range(1000).select(F.lit("hot").alias("k"), F.col("id").alias("tick"), (F.col("id") * 7 % 31).alias("v"))
    frame = Window.partitionBy("k", "__block").orderBy("tick").rowsBetween(-9, 0)
    found = {r["tick"]: r["s"] for r in ordered.sliding(ticks, ["k"], 10, {"s": F.sum("v").over(frame)}, block=16).collect()}
    assert found == {t: sum(u * 7 % 31 for u in range(max(0, t - 9), t + 1)) for t in range(1000)}
    with pytest.raises(ValueError):
        ordered.sliding(ticks, ["k"], 10, {}, block=9)


def test_budget_of_one_day_and_empty_tables(spark, largest):
    ledger = spark.createDataFrame([(1, i // 3, i, 10) for i in range(500)], "day int, ts long, event_id long, cost long")
    found = {r["event_id"]: (r["spent_before"], r["allowed"]) for r in telemetry.running_budget(ledger, 1000, largest=largest).collect()}
    assert found == {i: (10 * i, 10 * i < 1000) for i in range(500)}
    none = spark.createDataFrame([], SCHEMA)
    assert ordered.ticked(none, ["k"], ["at", "id"], largest=largest).count() == ordered.latest(none, ["k"], ["at", "id"], "v", "l", largest).count() == 0
    assert ordered.spaced(none.withColumnRenamed("v", "tick"), "k", 3).count() == 0
