"""Folds by event time with bounded state: growing input, restarts and late rows, against plain Python."""

from __future__ import annotations

import datetime
import math
import random

from mossgraph.streaming import bounded

START = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
SCHEMA = "user_id long, ts timestamp, event_id long, event_type string, value double"
KINDS = ["a", "b", "c"]


def rows_of(draw: random.Random, first: int, minutes: range, n: int) -> list[tuple]:
    """One user has half of the rows; some times are null."""
    made = []
    for i in range(n):
        at = START + datetime.timedelta(minutes=draw.choice(minutes), milliseconds=draw.randrange(60_000))
        made.append((draw.choice([1, 1, 1, 2, 3, None]), None if draw.random() < 0.03 else at, first + i, draw.choice(["a", "b", "z"]), float(draw.randrange(10))))
    return made


def before(rows: list[tuple], mark: datetime.datetime) -> dict:
    by: dict = {}
    for r in sorted((r for r in rows if r[1] is not None and r[1] <= mark), key=lambda r: (r[1], r[2])):
        by.setdefault(r[0], []).append(r)
    return by


def fired(rows: list[tuple], mark: datetime.datetime, gap: int) -> set:
    found = set()
    for k, held in before(rows, mark).items():
        last = -gap
        for tick, r in enumerate(held):
            if r[4] >= 6 and tick - last >= gap:
                found.add((k, tick))
                last = tick
    return found


def mark_of(rows: list[tuple]) -> datetime.datetime:
    latest = max(r[1] for r in rows if r[1] is not None)
    return latest.replace(microsecond=latest.microsecond // 1000 * 1000) - datetime.timedelta(minutes=10)


def test_two_runs_late_rows_and_restart(spark, tmp_path):
    draw = random.Random(7)
    src, out, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    stream = lambda: bounded.firings(spark.readStream.schema(SCHEMA).parquet(src), "user_id", "ts", "event_id", 6, 3, "10 minutes")
    was = spark.conf.get(bounded.PROVIDER)
    one = rows_of(draw, 0, range(0, 60), 150)
    spark.createDataFrame(one, SCHEMA).coalesce(1).write.parquet(src)
    got = {(r["key"], r["tick"]) for r in bounded.appended(stream(), out, log).collect()}
    assert got == fired(one, mark_of(one), 3) and got
    # More rows: some within the delay of what was seen, some new, and one an hour late, which is dropped.
    two = rows_of(draw, 1000, range(55, 110), 150)
    late = (1, START + datetime.timedelta(minutes=1), 5000, "a", 9.0)
    spark.createDataFrame([*two, late], SCHEMA).coalesce(1).write.mode("append").parquet(src)
    rows = bounded.appended(stream(), out, log).collect()
    assert len(rows) == len({(r["key"], r["tick"]) for r in rows})
    assert {(r["key"], r["tick"]) for r in rows} == fired(one + two, mark_of(one + two), 3) > got
    # Nothing new: nothing changes; the session is as it was.
    assert len(bounded.appended(stream(), out, log).collect()) == len(rows)
    assert spark.conf.get(bounded.PROVIDER) == was


def test_averages_and_no_rows(spark, tmp_path):
    draw = random.Random(8)
    rows = rows_of(draw, 0, range(0, 50), 120)
    src, out, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(src)
    made = bounded.averages(spark.readStream.schema(SCHEMA).parquet(src), "user_id", "ts", "event_id", "event_type", KINDS, "10 minutes")
    found: dict = {}
    for r in bounded.appended(made, out, log).collect():
        if r["key"] not in found or found[r["key"]][0] < r["steps"]:
            found[r["key"]] = (r["steps"], r["state"])
    want = before(rows, mark_of(rows))
    assert {k: v[0] for k, v in found.items()} == {k: len(v) for k, v in want.items()}
    for k, held in want.items():
        own = [0.0] * 3
        for r in held:
            own = [0.82 * h + 0.18 * (r[3] == t) for h, t in zip(own, KINDS)]
            norm = math.sqrt(sum(h * h for h in own))
            own = [h / norm for h in own] if norm > 1e-9 else own
        assert max(abs(a - b) for a, b in zip(own, found[k][1])) < 1e-9
    empty = str(tmp_path / "none")
    spark.createDataFrame([], SCHEMA).write.parquet(empty)
    nothing = bounded.firings(spark.readStream.schema(SCHEMA).parquet(empty), "user_id", "ts", "event_id", 6, 3, "10 minutes")
    assert bounded.appended(nothing, str(tmp_path / "o2"), str(tmp_path / "l2")).count() == 0
