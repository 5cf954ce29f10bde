"""Registered queries of the numeric kernels and of hypervectors over the embeddings and parts, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import arrays, graph, hyper, kernels, vector
from .retrieval import spread, table, vector_query


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


def _rounded(rows, *names):
    return rows.withColumns({n: F.round(n, 6) + 0.0 for n in names})


def free_energy(spark, sf_dir):
    v = F.col("v")
    half, zero = F.transform(v, lambda x: x / 2), F.transform(v, lambda x: x * 0)
    return _vectors(spark, sf_dir).select("vec_id", F.round(arrays.free_energy(v, half, v, zero, 0.25), 6).alias("energy"), arrays.strongest(v).cast("long").alias("strongest"))


def drift(spark, sf_dir):
    """A seeded step of noise: the noise of a vector is the one behind it, so that it repeats."""
    rows = _vectors(spark, sf_dir)
    noise = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("noise"))
    return _places(rows.join(noise, "vec_id").select("vec_id", arrays.drifted(F.col("v"), F.col("noise"), 0.01, 50.0).alias("v")))


def _places(rows, key="vec_id"):
    return _rounded(rows.select(key, F.posexplode("v").alias("place", "x")).withColumn("place", F.col("place").cast("long")), "x")


def leapfrog(spark, sf_dir):
    v = F.col("v")
    q, p, energy = arrays.leapfrog(v, F.reverse(v), 2.0, 0.1)
    made = _vectors(spark, sf_dir).select("vec_id", q.alias("q"), p.alias("p"), energy.alias("energy"))
    return _rounded(made.select("vec_id", F.get("q", F.lit(3)).alias("q3"), F.get("p", F.lit(3)).alias("p3"), "energy"), "q3", "p3", "energy")


def hopfield(spark, sf_dir):
    found = arrays.hopfield(table(spark, sf_dir, "embeddings"), vector_query(spark, sf_dir), 8.0)
    return _rounded(found.withColumn("place", F.col("place").cast("long")), "x")


def _network(spark, sf_dir):
    """Weights from the co-purchase graph over all parts, an activity for each part, and a drive for each brand's parts."""
    edges = graph.checkpointed(graph.co_occurrence(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey"))
    weights = graph.both_ways(edges, "weight").select(F.col("src").alias("i"), F.col("dst").alias("j"), (F.col("weight") / 10.0).alias("w"))
    parts = table(spark, sf_dir, "part")
    state = parts.select(F.col("p_partkey").alias("i"), (F.col("p_size") / 50.0 - 0.5).alias("x"))
    inputs = parts.select(F.col("p_partkey").alias("i"), (F.col("p_partkey") % 5).alias("j"), F.lit(0.3).cast("double").alias("w"))
    drive = spark.range(5).select(F.col("id").alias("i"), (F.col("id") / 4.0).alias("x"))
    return state, weights, inputs, drive


def reservoir_step(spark, sf_dir):
    state, weights, inputs, drive = _network(spark, sf_dir)
    return _rounded(arrays.reservoir(state, weights, inputs, drive, 0.3), "x")


def attractor_step(spark, sf_dir):
    state, weights, inputs, drive = _network(spark, sf_dir)
    return _rounded(arrays.attractor(state, weights, arrays.times(inputs, drive), 0.01, 0.1), "x")


def hebbian_step(spark, sf_dir):
    state, weights, _, _ = _network(spark, sf_dir)
    return _rounded(arrays.hebbian(weights, state, state, 0.1, 0.01), "w")


def masked_pool(spark, sf_dir):
    return _places(arrays.pooled(_vectors(spark, sf_dir), "label", "v", F.col("vec_id") % 3 != 0), "label")


def halved(spark, sf_dir):
    return _places(_vectors(spark, sf_dir).select("vec_id", arrays.halved(F.col("v")).alias("v")))


def resampled(spark, sf_dir):
    return _places(_vectors(spark, sf_dir).select("vec_id", arrays.fitted(arrays.resampled(F.col("v"), 3, 2), 50).alias("v")))


def log_mel(spark, sf_dir):
    made = arrays.log_mel(_vectors(spark, sf_dir), "vec_id", "v", 16_000, 32, 16, 6)
    return _rounded(made.withColumns({c: F.col(c).cast("long") for c in ("frame", "band")}), "x")


def mel_filters(spark, sf_dir):
    """The filter bank of a 400-sample window at 16 kHz in 80 bands."""
    bank = kernels.mel_filters(80, 400, 16_000)
    return spark.createDataFrame([(b, f, round(float(w), 6)) for b, row in enumerate(bank) for f, w in enumerate(row) if w > 1e-9], "band long, bin long, weight double")


def hv_bundle(spark, sf_dir):
    return arrays.bundled(table(spark, sf_dir, "embeddings"), "label", "embedding").select("label", F.col("place").cast("long").alias("place"), "x")


def fhrr_bundle(spark, sf_dir):
    made = arrays.complex_bundled(_vectors(spark, sf_dir), "label", "v").withColumn("place", F.col("place").cast("long"))
    return _rounded(made, "re", "im")


def fhrr_unbind(spark, sf_dir):
    """What is bound with a key of modulus one comes back by the key's conjugate: similarity one for each vector."""
    rows = _vectors(spark, sf_dir)

    @F.pandas_udf("double")
    def back(v):
        import numpy as np
        import pandas as pd

        out = []
        for x in v:
            a, b = np.exp(1j * np.asarray(x)), np.exp(1j * np.asarray(x)[::-1] * 3)
            out.append(hyper.complex_similarity(hyper.unbound(hyper.bound(a, b), b), a))
        return pd.Series(out)

    return rows.select("vec_id", F.round(back("v"), 6).alias("similarity"))


def hv_laws(spark, sf_dir):
    """For each word of the parts' names: binding twice gives the vector back, a shift there and back too, packing loses
    nothing, and a packed vector has 1250 bytes; two different words are nearly orthogonal."""
    words = spread(table(spark, sf_dir, "part").select(F.explode(T.tokens(F.col("p_name"))).alias("token")).distinct())

    def each(frames):
        import numpy as np
        import pandas as pd

        for frame in frames:
            rows = []
            for token in frame["token"]:
                a, b = hyper.random_vector(T.fnv1a(token)), hyper.random_vector(T.fnv1a(token + "'"))
                rows.append((token, hyper.similarity(a * b * b, a), bool(np.array_equal(hyper.permute(hyper.permute(a, 3), -3), a)), bool(np.array_equal(hyper.unpacked(hyper.packed(a)), a)), len(hyper.packed(a)), abs(hyper.similarity(a, b)) < 0.06))
            yield pd.DataFrame(rows, columns=["token", "rebound", "shifted", "repacked", "bytes", "apart"])

    return words.mapInPandas(each, "token string, rebound double, shifted boolean, repacked boolean, bytes long, apart boolean")


def vector_bytes(spark, sf_dir):
    """Vectors to little-endian bytes and back, all places the same."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")

    @F.pandas_udf("boolean")
    def same(v):
        import numpy as np
        import pandas as pd

        return pd.Series([bool(np.array_equal(np.asarray(vector.from_bytes(vector.to_bytes(x)), dtype="f4"), np.asarray(x, dtype="f4"))) and len(vector.to_bytes(x)) == 4 * len(x) for x in v])

    return rows.select("vec_id", same("embedding").alias("same"))


def bounding_box(spark, sf_dir):
    rows = _vectors(spark, sf_dir).select((F.get("v", F.lit(0)) * 100).alias("x"), (F.get("v", F.lit(1)) * 100).alias("y"))
    return _rounded(graph.framed(rows, 800, 600), "left", "right", "top", "bottom", "scale")


def relabelled(spark, sf_dir):
    """Communities by brand, numbered in the order of their first part."""
    return graph.relabelled(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("label")))


def visit_order(spark, sf_dir):
    """Parts in a seeded order, by the digest of seed and key."""
    return graph.shuffled(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")), "id", 11)


def queries() -> dict:
    named = [free_energy, drift, leapfrog, hopfield, reservoir_step, attractor_step, hebbian_step, masked_pool, halved, resampled, log_mel, mel_filters, hv_bundle, fhrr_bundle, fhrr_unbind, hv_laws, vector_bytes, bounding_box, relabelled, visit_order]
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    e = "e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), x AS (SELECT vec_id, label, unnest(v) AS x, unnest(range(len(v))) AS place FROM e)"
    r = lambda c: f"round({c}, 6) + 0.0::DOUBLE"
    net = """i AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), ed AS (SELECT a.l_partkey AS a, b.l_partkey AS b, count(*) / 10.0::DOUBLE AS w FROM i a JOIN i b ON a.l_orderkey = b.l_orderkey AND a.l_partkey <> b.l_partkey GROUP BY 1, 2),
st AS (SELECT p_partkey AS i, p_size / 50.0::DOUBLE - 0.5::DOUBLE AS x, 0.3::DOUBLE * ((p_partkey % 5) / 4.0::DOUBLE) AS u FROM part)"""
    k = 2 * math.pi
    mel = "2595 * log10(1 + {} / 700.0::DOUBLE)"
    return {
        "free_energy": f"WITH {e}, s AS (SELECT vec_id, list_sum(list_transform(v, lambda a: (a - a / 2) * (a - a / 2))) AS d, list_sum(list_transform(v, lambda a: a * a)) AS n, list_transform(v, lambda a: abs(a)) AS z FROM e) SELECT vec_id, round(0.5::DOUBLE * d + 0.5::DOUBLE * 0.25 * n, 6) AS energy, (list_position(z, list_max(z)) - 1)::BIGINT AS strongest FROM s",
        "drift": f"WITH {e} SELECT a.vec_id, a.place, {r(f'a.x + {math.sqrt(2 * 0.01 / 50.0)!r}::DOUBLE * b.x')} AS x FROM x a JOIN x b ON b.vec_id = a.vec_id + 1 AND a.place = b.place",
        "leapfrog": f"WITH {e}, h AS (SELECT vec_id, place, x AS q, v[(len(v) - place)::BIGINT] - 0.05::DOUBLE * 2 * x AS h FROM x JOIN e USING (vec_id)), n AS (SELECT vec_id, place, q + 0.1::DOUBLE * h AS q, h - 0.05::DOUBLE * 2 * (q + 0.1::DOUBLE * h) AS p FROM h) SELECT vec_id, {r('max(q) FILTER (place = 3)')} AS q3, {r('max(p) FILTER (place = 3)')} AS p3, {r('0.5::DOUBLE * sum(p * p) + 0.5::DOUBLE * 2 * sum(q * q)')} AS energy FROM n GROUP BY 1",
        "hopfield": f"WITH {e}, q AS (SELECT place, x AS y FROM x WHERE vec_id = 0), s AS (SELECT vec_id, 8.0::DOUBLE * sum(x * y) AS s FROM x JOIN q USING (place) GROUP BY 1), w AS (SELECT vec_id, exp(s - (SELECT max(s) FROM s)) AS w FROM s) SELECT place, {r('sum(w * x) / sum(w)')} AS x FROM x JOIN w USING (vec_id) GROUP BY 1",
        "reservoir_step": f"WITH {net}, f AS (SELECT a AS i, sum(w * x) AS f FROM ed JOIN st ON st.i = b GROUP BY 1) SELECT i, {r('0.7::DOUBLE * x + 0.3::DOUBLE * tanh(coalesce(f, 0) + u)')} AS x FROM st LEFT JOIN f USING (i)",
        "attractor_step": f"WITH {net}, f AS (SELECT a AS i, sum(w * tanh(x)) AS f FROM ed JOIN st ON st.i = b GROUP BY 1) SELECT i, {r('x + 0.1::DOUBLE * (coalesce(f, 0) + u - x)')} AS x FROM st LEFT JOIN f USING (i)",
        "hebbian_step": f"WITH {net} SELECT a AS i, b AS j, {r('0.99::DOUBLE * w + 0.1::DOUBLE * coalesce(s.x, 0) * coalesce(t.x, 0)')} AS w FROM ed LEFT JOIN st s ON s.i = a LEFT JOIN st t ON t.i = b",
        "masked_pool": f"WITH {e}, m AS (SELECT label, place, avg(x) AS x FROM x WHERE vec_id % 3 <> 0 GROUP BY 1, 2) SELECT label, place, {r('x / greatest(sqrt(sum(x * x) OVER (PARTITION BY label)), 1e-12)')} AS x FROM m",
        "halved": f"WITH {e} SELECT vec_id, place // 2 AS place, {r('avg(x)')} AS x FROM x GROUP BY 1, 2",
        "resampled": f"WITH {e}, n AS (SELECT vec_id, v, unnest(range(50)) AS place FROM e), p AS (SELECT *, floor(len(v) * 2 / 3.0::DOUBLE) AS m, least(place * 1.5::DOUBLE, len(v) - 1) AS loc FROM n) SELECT vec_id, place, {r('CASE WHEN place >= m THEN 0 ELSE v[(floor(loc) + 1)::BIGINT] + (loc - floor(loc)) * (v[least(floor(loc) + 2, len(v))::BIGINT] - v[(floor(loc) + 1)::BIGINT]) END')} AS x FROM p",
        "log_mel": f"""WITH {e}, fr AS (SELECT vec_id, v, unnest(range(0, greatest(0, len(v) - 32) + 1, 16)) // 16 AS frame FROM e), sa AS (SELECT vec_id, frame, n, v[(frame * 16 + n + 1)::BIGINT] * (0.5::DOUBLE - 0.5::DOUBLE * cos({k!r}::DOUBLE * n / 32)) AS x FROM fr, (SELECT unnest(range(32)) AS n)),
sp AS (SELECT vec_id, frame, f, sum(x * cos({k!r}::DOUBLE * f * n / 32)) AS re, sum(x * sin({k!r}::DOUBLE * f * n / 32)) AS im FROM sa, (SELECT unnest(range(17)) AS f) GROUP BY 1, 2, 3),
ed AS (SELECT b, 700 * (pow(10.0::DOUBLE, ({mel.format('8000')}) * b / 7 / 2595) - 1) AS hz FROM (SELECT unnest(range(8)) AS b)),
bk AS (SELECT a.b AS band, f, greatest(0, least((f * 500 - a.hz) / (m.hz - a.hz), (z.hz - f * 500) / (z.hz - m.hz))) AS w FROM ed a JOIN ed m ON m.b = a.b + 1 JOIN ed z ON z.b = a.b + 2, (SELECT unnest(range(17)) AS f)),
en AS (SELECT vec_id, frame, band, log10(greatest(sum(w * (re * re + im * im)), 1e-10)) AS x FROM sp JOIN bk USING (f) GROUP BY 1, 2, 3 HAVING sum(w) > 0)
SELECT vec_id, frame, band, {r('(greatest(x, max(x) OVER (PARTITION BY vec_id) - 8) + 4) / 4')} AS x FROM en""",
        "mel_filters": f"""WITH ed AS (SELECT b, 700 * (pow(10.0::DOUBLE, ({mel.format('8000')}) * b / 81 / 2595) - 1) AS hz FROM (SELECT unnest(range(82)) AS b)),
bk AS (SELECT a.b AS band, f AS bin, greatest(0, least((f * 40 - a.hz) / (m.hz - a.hz), (z.hz - f * 40) / (z.hz - m.hz))) AS w FROM ed a JOIN ed m ON m.b = a.b + 1 JOIN ed z ON z.b = a.b + 2, (SELECT unnest(range(201)) AS f))
SELECT band, bin, round(w, 6) AS weight FROM bk WHERE w > 1e-9""",
        "hv_bundle": f"WITH {e} SELECT label, place, (CASE WHEN sum(sign(x)) >= 0 THEN 1 ELSE -1 END)::BIGINT AS x FROM x GROUP BY 1, 2",
        "fhrr_bundle": f"WITH {e}, s AS (SELECT label, place, sum(cos(x)) AS a, sum(sin(x)) AS b FROM x GROUP BY 1, 2) SELECT label, place, {r('CASE WHEN sqrt(a * a + b * b) > 1e-9 THEN a / sqrt(a * a + b * b) ELSE 1 END')} AS re, {r('CASE WHEN sqrt(a * a + b * b) > 1e-9 THEN b / sqrt(a * a + b * b) ELSE 0 END')} AS im FROM s",
        "fhrr_unbind": "SELECT vec_id, 1.0::DOUBLE AS similarity FROM embeddings",
        "hv_laws": f"SELECT token, 1.0::DOUBLE AS rebound, true AS shifted, true AS repacked, 1250::BIGINT AS bytes, true AS apart FROM (SELECT DISTINCT unnest({T.SQL_TOKENS.format('p_name')}) AS token FROM part)",
        "vector_bytes": "SELECT vec_id, true AS same FROM embeddings",
        "bounding_box": f"WITH b AS (SELECT min(x) AS l, max(x) AS r, min(y) AS t, max(y) AS u FROM (SELECT embedding[1]::DOUBLE * 100 AS x, embedding[2]::DOUBLE * 100 AS y FROM embeddings)) SELECT {r('l')} AS left, {r('r')} AS right, {r('t')} AS top, {r('u')} AS bottom, {r('0.9::DOUBLE * least(800 / greatest(r - l, 1), 600 / greatest(u - t, 1))')} AS scale FROM b",
        "relabelled": "SELECT p_partkey AS id, dense_rank() OVER (ORDER BY first) - 1 AS community FROM (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_brand) AS first FROM part)",
        "visit_order": "SELECT p_partkey AS id, row_number() OVER (ORDER BY md5('11:' || p_partkey), p_partkey) - 1 AS place FROM part",
    }
