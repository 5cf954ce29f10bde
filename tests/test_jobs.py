"""The jobs over growing input, on copies; the stored index against the scan; the command line."""

import glob
import json
import os
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs import activity_ledger, index_documents
from jobs import queries as registered
from mossgraph.operators import fulltext, mutations, postings
from mossgraph.plans import retrieval

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def add(rows, folder, name):
    """One more file of a growing table."""
    rows.coalesce(1).write.parquet(f"{folder}/.new-{name}")
    os.makedirs(folder, exist_ok=True)
    (part,) = glob.glob(f"{folder}/.new-{name}/part-*.parquet")
    os.rename(part, f"{folder}/{name}.parquet")


def files(folder):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{folder}/**/*.parquet", recursive=True)}


def expected(name, **tables):
    con = duckdb.connect()
    for table, rows in tables.items():
        con.register(table, rows.toArrow())
    return con.sql(registered.oracle_sql()[name])


def same(found, want):
    columns = sorted(want.columns)
    assert sorted(found.columns) == columns
    assert sorted(map(tuple, found.select(*columns).collect()), key=repr) == sorted(want.select(*columns).fetchall(), key=repr)


def postings_in(index):
    return index.select("segment", "term", "chunk", "n", "most_tf", "least_length", F.inline("postings"))


def test_index_takes_only_new_files_and_replaces_documents(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    at = str(tmp_path)
    where = {"documents": f"{at}/docs", "index": f"{at}/index", "checkpoint": f"{at}/mark"}
    early, late = docs.where("doc_id < 120"), docs.where("doc_id >= 120").withColumn("doc_id", F.col("doc_id") + 10_000)
    add(early, where["documents"], "a")
    index_documents.run(spark, **where)
    first = files(where["index"])
    index_documents.run(spark, **where)
    assert files(where["index"]) == first  # nothing new: nothing was written
    add(late, where["documents"], "b")
    same(postings_in(index_documents.run(spark, **where)), expected("job1_index_documents", documents=early.unionByName(late)))
    assert {f: t for f, t in files(where["index"]).items() if "segment=0/" in f} == first  # other segments stayed as they were
    # New texts of known documents, one of them without words, one null; a row without a document; a text given twice.
    changed = spark.createDataFrame([(3, "entirely new zzqy text\nzzqy"), (4, " \n--"), (5, None), (None, "zzqy"), (7, "zzqy a"), (7, "zzqy b")], "doc_id long, text string")
    add(changed, where["documents"], "c")
    kept = early.where("doc_id NOT IN (3, 4, 5, 7)").unionByName(late).unionByName(changed)
    index = index_documents.run(spark, **where)
    same(postings_in(index), expected("job1_index_documents", documents=kept))
    assert [r["block_id"] for r in postings.search(index, "zzqy", 5).collect()] == ["3:000001", "7:000000", "3:000000"]
    # A lost mark: every file is taken again, in one batch, and the index is that of the greatest texts.
    again = index_documents.run(spark, where["documents"], where["index"], f"{at}/mark2")
    greatest = early.unionByName(late).unionByName(changed).where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("text").alias("text"))
    same(postings_in(again), expected("job1_index_documents", documents=greatest))


@pytest.mark.parametrize("query", ["tion* the* ing*", "tion thin", "heoush", "an* e* the* o*", "nothinglikeit", "", "Ther-e!"])
@pytest.mark.parametrize("probes", [1, 16])
def test_search_of_the_index_is_the_scan(spark, sf, tmp_path_factory, query, probes):
    folder = str(tmp_path_factory.getbasetemp() / "searched")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    if not os.path.exists(folder):
        postings.updated(spark, folder, docs)
    found = postings.search(postings.opened(spark, folder), query, 7, probes).collect()
    assert found == fulltext.bm25(retrieval._blocks(docs), query, 7).collect()


def test_index_reads_a_term_by_its_zones(spark, sf, tmp_path):
    postings.updated(spark, f"{tmp_path}/i", spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))
    index = postings.opened(spark, f"{tmp_path}/i")
    plan = index.where("term = ''").select("n")._jdf.queryExecution().toString()
    assert "EqualTo(term,)" in plan and "postings" not in plan.split("ReadSchema")[1]
    plan = postings._matched(index, ["the"]).select("n")._jdf.queryExecution().toString()
    assert "StringStartsWith(term,the)" in plan and "postings" not in plan.split("ReadSchema")[1]


def test_index_of_one_hot_term_and_of_nothing(spark, tmp_path):
    docs = spark.range(3000).selectExpr("id AS doc_id", "repeat('same word\n', 3) AS text")
    postings.updated(spark, f"{tmp_path}/i", docs)
    index = postings.opened(spark, f"{tmp_path}/i")
    assert index.where("term = 'same'").agg(F.max("n"), F.sum("n")).first() == (3 * postings.CHUNK, 9000)
    assert [r["block_id"] for r in postings.search(index, "word", 2).collect()] == ["0:000000", "0:000001"]
    postings.updated(spark, f"{tmp_path}/none", docs.limit(0))
    empty = postings.opened(spark, f"{tmp_path}/none")
    assert empty.count() == 0 and postings.search(empty, "word", 2).count() == 0


def test_ledger_takes_only_new_files(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    at = str(tmp_path)
    where = {"events": f"{at}/events", "ledger": f"{at}/ledger", "checkpoint": f"{at}/mark"}
    parts = [events.where(F.col("event_id") % 3 == k) for k in range(2)]  # every day is in both
    add(parts[0], where["events"], "a")
    same(activity_ledger.run(spark, **where), expected("job2_activity_ledger", events=parts[0]))
    first = files(where["ledger"])
    activity_ledger.run(spark, **where)
    assert files(where["ledger"]) == first
    add(parts[1], where["events"], "b")
    same(activity_ledger.run(spark, **where), expected("job2_activity_ledger", events=parts[0].unionByName(parts[1])))
    assert {f: t for f, t in files(f"{where['ledger']}/partials").items() if "batch=0/" in f} == {f: t for f, t in first.items() if "batch=0/" in f}
    # A late day and rows with nulls touch their own days only.
    before = files(f"{where['ledger']}/daily")
    odd = spark.createDataFrame([(None, None, None, None), ("2024-01-03 05:00:00", "click", 3.5, '{"k": 9}'), ("2024-01-03 06:00:00", None, None, "no json")], "ts string, event_type string, value double, props string")
    odd = odd.select(F.lit(-1).cast("long").alias("event_id"), F.to_timestamp("ts").cast("timestamp_ntz").alias("ts"), F.lit(1).cast("long").alias("user_id"), "event_type", "value", "props")
    add(odd, where["events"], "c")
    days = activity_ledger.run(spark, **where)
    after = files(f"{where['ledger']}/daily")
    stayed = {f for f in before if f in after and before[f] == after[f]}
    assert {f.split("day=")[1].split("/")[0] for f in set(before) - stayed} == {"2024-01-03"}
    assert days.where("day = 'unknown'").select("operation", "n", "cost", "share").collect() == [("unknown", 1, 0, None)]
    # The order of files and their split into batches change nothing.
    once = activity_ledger.run(spark, where["events"], f"{at}/ledger2", f"{at}/mark2", most_files=1)
    assert sorted(once.collect(), key=repr) == sorted(days.collect(), key=repr)


@pytest.mark.parametrize("job, table, written", [("index_documents", "documents", "index"), ("activity_ledger", "events", "ledger")])
def test_command_line(job, table, written, sf, tmp_path):
    config = {table: f"{sf}/{table}.parquet", written: "/nowhere", "checkpoint": f"{tmp_path}/mark"}
    (tmp_path / "c.json").write_text(json.dumps(config))
    for _ in range(2):
        done = subprocess.run([sys.executable, f"{ROOT}/jobs/{job}.py", "--config", f"{tmp_path}/c.json", f"--{written}", f"{tmp_path}/out"], cwd=tmp_path, capture_output=True, text=True, timeout=300, env=os.environ | {"PYSPARK_SUBMIT_ARGS": f"--master local[2] --conf spark.checkpoint.dir={tmp_path}/shared --conf spark.ui.enabled=false pyspark-shell"})
        assert done.returncode == 0, done.stderr[-2000:]
        log = [line for line in done.stderr.splitlines() if f"{job}: batch" in line]
        found = files(f"{tmp_path}/out")
        if _ == 0:
            assert log and found
            first = found
        else:
            assert not log and found == first


def test_upsert_of_the_null_key(spark):
    kind = "id long, made string, text string"
    old = spark.createDataFrame([(None, "a", "old"), (1, "b", "old"), (2, "c", None)], kind)
    new = spark.createDataFrame([(None, "x", "new"), (2, "y", "new"), (3, "z", None)], kind)
    found = {tuple(r) for r in mutations.upserted(old, new, "id", ["made"]).collect()}
    assert found == {(None, "a", "new"), (1, "b", "old"), (2, "c", "new"), (3, "z", None)}
    assert mutations.upserted(old.limit(0), new.limit(0), "id", ["made"]).count() == 0
