"""The cognitive loop as a keyed operator: one seeded network a key, one tick a row, a snapshot every few ticks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels


@dataclass
class Settings:
    inputs: int = 8
    reservoir: int = 64
    latent: int = 16
    leak: float = 0.3
    dt: float = 0.01
    tau: float = 0.1
    beta: float = 50.0
    recall: float = 0.0
    precision: float = 1.0
    seed: int = 7


class Network:
    """Reservoir, projection, attractor, drift, recall and free energy, in this order; weights come from the seed."""

    def __init__(self, settings: Settings = Settings()):
        s = self.settings = settings
        rng = np.random.default_rng(s.seed)
        draw = lambda a, b: rng.standard_normal((a, b)) / np.sqrt(b)
        self.inside, self.drive, self.down, self.latent = 0.9 * draw(s.reservoir, s.reservoir), draw(s.reservoir, s.inputs), draw(s.latent, s.reservoir), draw(s.latent, s.latent)
        self.up = self.down.T
        self.noise = np.random.default_rng([s.seed, 1])
        self.x, self.z, self.tick, self.patterns = np.zeros(s.reservoir), np.zeros(s.latent), 0, []

    def step(self, seen: np.ndarray) -> float:
        """Free energy of the tick; an observation of the wrong size counts as none."""
        s = self.settings
        seen = np.asarray(seen, dtype=float)
        seen = seen if seen.shape == (s.inputs,) else np.zeros(s.inputs)
        self.x = kernels.reservoir(self.x, self.inside, self.drive, seen, s.leak)
        self.z = kernels.attractor(self.z, self.latent, self.down @ self.x, s.dt, s.tau)
        self.z = kernels.drifted(self.z, s.dt, s.beta, self.noise)
        if s.recall and self.patterns:
            self.z = (1 - s.recall) * self.z + s.recall * kernels.hopfield(np.stack(self.patterns), self.z, s.beta)
        self.tick += 1
        return kernels.free_energy(self.x, self.up @ self.z, self.z, np.zeros(s.latent), s.precision)


def ticks(rows: DataFrame, key: str, order: str, seen: str, settings: Settings = Settings(), every: int = 10) -> DataFrame:
    """key, tick, energy, dominant: a snapshot every ``every`` ticks.  A key's ticks run in order in one task."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        network, out = Network(settings), []
        for value in frame.sort_values("at")["seen"]:
            energy = network.step(value if value is not None else [])
            if network.tick % every == 0:
                out.append((frame["key"].iloc[0], network.tick, energy, int(np.abs(network.z).argmax())))
        return pd.DataFrame(out, columns=["key", "tick", "energy", "dominant"])

    made = rows.select(F.col(key).cast("string").alias("key"), F.col(order).alias("at"), F.col(seen).cast("array<double>").alias("seen"))
    return made.groupBy("key").applyInPandas(run, "key string, tick long, energy double, dominant long")


def reflections(snapshots: DataFrame, energy: float = 5.0, progress: float = -1.0) -> DataFrame:
    """Snapshots that are worth a note, with why: energy first, then falling progress."""
    why = F.when(F.col("energy") >= energy, "energy").when(F.col("progress") <= progress, "progress")
    return snapshots.withColumn("reason", why).where("reason IS NOT NULL")


def notes(found: DataFrame, at: str = "ts") -> DataFrame:
    """day, name, text of a Markdown note for each reflection; written by day with ``partitionBy``."""
    text = F.concat(F.lit("---\nkind: reflection\nreason: "), F.col("reason"), F.lit("\ntick: "), F.col("tick").cast("string"), F.lit("\nat: "), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("\n---\n\n# Reflection\n\nEnergy "), F.format_string("%.3f", F.col("energy")), F.lit(", progress "), F.format_string("%.3f", F.col("progress")), F.lit(".\n"))
    return found.select(F.date_format(at, "yyyy-MM-dd").alias("day"), F.concat(F.date_format(at, "HHmmss"), F.lit("-"), F.col("tick").cast("string"), F.lit(".md")).alias("name"), text.alias("text"))
