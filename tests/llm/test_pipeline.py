"""The stages of the corpus pipeline, each on what its predecessor kept, against brute force."""

import hashlib
import re

import corpus_pipeline
from mossgraph.llm import toxicity
from pyspark.sql import functions as F
from test_operators import brute_near

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, SF)
        made.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append(docs)
        assert name == "byte_bpe" or docs.columns == names
    first = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(first, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = {r["doc_id"]: r["score"] for r in toxicity.score_documents(first, model).collect()}
    rows = {r["doc_id"]: r for r in first.collect()}
    clean = sorted(i for i in rows if scores[i] < toxicity.THRESHOLD)
    assert sorted(map(tuple, seen[0].collect())) == [tuple(rows[i]) for i in clean]
    smallest = {}
    for i in clean:
        smallest.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", rows[i]["text"] or ""), i)
    assert sorted(r["doc_id"] for r in seen[1].collect()) == sorted(smallest.values())
    near = brute_near([(i, rows[i]["text"]) for i in smallest.values()])
    assert sorted(map(tuple, seen[2].collect())) == [tuple(rows[i]) for i in near]
    pieces = seen[3].collect()
    words = re.compile(r"[^\x20\x09-\x0D]+").findall
    sizes = {i: len(words(rows[i]["text"] or "")) for i in near}
    taken = dict.fromkeys(near, 0)
    for r in pieces:
        assert r["text"] in rows[r["doc_id"]]["text"] and r["n_chars"] == len(r["text"])
        taken[r["doc_id"]] += len(words(r["text"]))
    assert all(taken[i] <= 2 * sizes[i] for i in near)
    encoded = sorted((r["doc_id"], r["decoded_sha256"]) for r in seen[4].collect())
    assert encoded == sorted((r["doc_id"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in pieces)
    assert seen[4].where(F.col("n_tokens") < 1).count() == 0
