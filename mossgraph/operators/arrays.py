"""Numeric kernels as columns and joins: the arithmetic of ``kernels`` on rows of a table, without Python.

Vectors are arrays of double; matrices are tables (i, j, w), so a product is a join and a sum, of any size."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def summed(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return summed(F.zip_with(a, b, lambda x, y: x * y))


def distance2(a: Column, b: Column) -> Column:
    return summed(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def free_energy(seen: Column, expected: Column, state: Column, prior: Column, precision: float) -> Column:
    return 0.5 * distance2(seen, expected) + 0.5 * precision * distance2(state, prior)


def strongest(v: Column) -> Column:
    """Place (from 0) of the largest size, of equals the first; null for no places."""
    sizes = F.transform(v, lambda x: F.abs(x))
    return F.array_position(sizes, F.array_max(sizes)) - 1


def drifted(state: Column, noise: Column, dt: float, beta: float) -> Column:
    return F.zip_with(state, noise, lambda x, e: x + math.sqrt(2 * dt / beta) * e)


def leapfrog(q: Column, p: Column, stiffness: float, dt: float) -> tuple[Column, Column, Column]:
    """q and p after a step in the potential stiffness * q^2 / 2, and the energy there."""
    half = F.zip_with(p, q, lambda y, x: y - dt / 2 * stiffness * x)
    q2 = F.zip_with(q, half, lambda x, y: x + dt * y)
    p2 = F.zip_with(half, q2, lambda y, x: y - dt / 2 * stiffness * x)
    return q2, p2, 0.5 * dot(p2, p2) + 0.5 * stiffness * dot(q2, q2)


def scaled(v: Column, least: float = 1e-12) -> Column:
    size = F.greatest(F.sqrt(dot(v, v)), F.lit(least))
    return F.transform(v, lambda x: x / size)


def halved(v: Column) -> Column:
    """Means of neighbouring places."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / 2).cast("int") - 1), lambda k: (F.get(v, 2 * k) + F.get(v, 2 * k + 1)) / 2)


def resampled(x: Column, rate: int, to: int) -> Column:
    """Linear resampling; beyond the last sample it stays."""
    n, last = F.greatest(F.lit(1), F.floor(F.size(x) * to / rate).cast("int")), F.size(x) - 1

    def at(k: Column) -> Column:
        place = F.least(k * (rate / to), last.cast("double"))
        low = F.floor(place).cast("int")
        return F.get(x, low) + (place - low) * (F.get(x, F.least(low + 1, last)) - F.get(x, low))

    return F.transform(F.sequence(F.lit(0), n - 1), at)


def fitted(x: Column, n: int) -> Column:
    """Exactly n samples: cut, or filled up with silence."""
    return F.slice(F.concat(x, F.array_repeat(F.lit(0.0), n)), 1, n)


# -- over groups of rows


def opened(rows: DataFrame, group: str, v: str) -> DataFrame:
    return rows.select(group, F.posexplode(F.col(v).cast("array<double>")).alias("place", "x"))


def gathered(places: DataFrame, group: str, value: str = "x") -> DataFrame:
    """group, v: the places of each group in order."""
    return places.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", value))), lambda s: s[value]).alias("v"))


def bundled(rows: DataFrame, group: str, v: str) -> DataFrame:
    """group, place, sign of the sum, ties to 1: partial sums before the shuffle, no array of vectors."""
    return opened(rows, group, v).groupBy(group, "place").agg(F.when(F.sum(F.signum("x")) >= 0, 1).otherwise(-1).cast("long").alias("x"))


def complex_bundled(rows: DataFrame, group: str, angle: str) -> DataFrame:
    """group, place, re, im: the sum of unit numbers of each place, back at modulus one; what cancels becomes one."""
    sums = opened(rows, group, angle).groupBy(group, "place").agg(F.sum(F.cos("x")).alias("a"), F.sum(F.sin("x")).alias("b"))
    size = F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b"))
    return sums.select(group, "place", F.when(size > 1e-9, F.col("a") / size).otherwise(1.0).alias("re"), F.when(size > 1e-9, F.col("b") / size).otherwise(0.0).alias("im"))


def pooled(rows: DataFrame, group: str, v: str, mask: Column) -> DataFrame:
    """group, v: the mean of the masked rows of each group, at length one."""
    means = opened(rows.where(mask), group, v).groupBy(group, "place").agg(F.avg("x").alias("x"))
    return gathered(means, group).withColumn("v", scaled(F.col("v")))


def times(matrix: DataFrame, vector: DataFrame) -> DataFrame:
    """i, x of the product.  matrix: i, j, w; vector: i, x."""
    return matrix.join(vector.select(F.col("i").alias("j"), "x"), "j").groupBy("i").agg(F.sum(F.col("w") * F.col("x")).alias("x"))


def _plus(a: DataFrame, b: DataFrame, made) -> DataFrame:
    both = a.select("i", F.col("x").alias("a")).join(b.select("i", F.col("x").alias("b")), "i", "full")
    return both.select("i", made(F.coalesce("a", F.lit(0.0)), F.coalesce("b", F.lit(0.0))).alias("x"))


def reservoir(state: DataFrame, weights: DataFrame, inputs: DataFrame, drive: DataFrame, leak: float) -> DataFrame:
    """i, x: leaky tanh step of a liquid state."""
    field = _plus(times(weights, state), times(inputs, drive), lambda a, b: a + b)
    return _plus(state, field, lambda x, f: (1 - leak) * x + leak * F.tanh(f))


def attractor(state: DataFrame, weights: DataFrame, drive: DataFrame, dt: float, tau: float) -> DataFrame:
    """i, x: Euler step of a continuous attractor network."""
    field = _plus(times(weights, state.select("i", F.tanh("x").alias("x"))), drive, lambda a, b: a + b)
    return _plus(state, field, lambda x, f: x + dt / tau * (f - x))


def hebbian(weights: DataFrame, post: DataFrame, pre: DataFrame, rate: float, decay: float) -> DataFrame:
    """i, j, w after an update: weights decay, and those of known pairs grow by both ends' activity."""
    ends = weights.join(post.select("i", F.col("x").alias("a")), "i", "left").join(pre.select(F.col("i").alias("j"), F.col("x").alias("b")), "j", "left")
    return ends.select("i", "j", ((1 - decay) * F.col("w") + rate * F.coalesce("a", F.lit(0.0)) * F.coalesce("b", F.lit(0.0))).alias("w"))


def hopfield(patterns: DataFrame, asked: list[float], beta: float, v: str = "embedding") -> DataFrame:
    """place, x: the sum of stored patterns, weighted by the softmax of their products with what is asked."""
    q = F.array(*[F.lit(float(x)) for x in asked])
    scored = patterns.select(F.col(v).cast("array<double>").alias("v")).withColumn("s", beta * dot(F.col("v"), q))
    top = scored.agg(F.max("s").alias("top"))  # one row
    weighed = scored.crossJoin(F.broadcast(top)).withColumn("e", F.exp(F.col("s") - F.col("top")))
    return weighed.select("e", F.posexplode("v").alias("place", "x")).groupBy("place").agg((F.sum(F.col("e") * F.col("x")) / F.sum("e")).alias("x"))


# -- sound


def log_mel(rows: DataFrame, key: str, v: str, rate: int, size: int, hop: int, bands: int) -> DataFrame:
    """key, frame, band, x: log mel energies of each signal's windowed frames, as ``kernels.log_mel`` gives them.

    A frame's spectrum is a product with two fixed tables (size * size numbers), and the filters are a third."""
    spark = rows.sparkSession
    waves = [(f, n, math.cos(2 * math.pi * f * n / size) * (0.5 - 0.5 * math.cos(2 * math.pi * n / size)), -math.sin(2 * math.pi * f * n / size) * (0.5 - 0.5 * math.cos(2 * math.pi * n / size))) for f in range(size // 2 + 1) for n in range(size)]
    from . import kernels

    filters = [(b, f, float(w)) for b, row in enumerate(kernels.mel_filters(bands, size, rate)) for f, w in enumerate(row) if w]
    x = F.col(v).cast("array<double>")
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(x) - size), F.lit(hop))
    frames = rows.select(key, F.posexplode(F.transform(starts, lambda s: F.slice(F.concat(x, F.array_repeat(F.lit(0.0), size)), s + 1, size))).alias("frame", "part"))
    samples = frames.select(key, "frame", F.posexplode("part").alias("n", "x"))
    table = F.broadcast(spark.createDataFrame(waves, "f int, n int, re double, im double"))
    spectrum = samples.join(table, "n").groupBy(key, "frame", "f").agg(F.sum(F.col("x") * F.col("re")).alias("re"), F.sum(F.col("x") * F.col("im")).alias("im"))
    bank = F.broadcast(spark.createDataFrame(filters, "band int, f int, w double"))
    energy = spectrum.join(bank, "f").groupBy(key, "frame", "band").agg(F.log10(F.greatest(F.sum(F.col("w") * (F.col("re") * F.col("re") + F.col("im") * F.col("im"))), F.lit(1e-10))).alias("x"))
    top = energy.groupBy(key).agg(F.max("x").alias("top"))
    return energy.join(top, key).select(key, "frame", "band", ((F.greatest("x", F.col("top") - 8) + 4) / 4).alias("x"))
