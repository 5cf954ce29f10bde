"""Numeric kernels of the cognitive loop, as functions of arrays that a stateful operator calls once a tick."""

from __future__ import annotations

import io
import wave

import numpy as np


def reservoir(state: np.ndarray, weights: np.ndarray, inputs: np.ndarray, drive: np.ndarray, leak: float) -> np.ndarray:
    """Leaky tanh step of a liquid state."""
    return (1 - leak) * state + leak * np.tanh(weights @ state + inputs @ drive)


def attractor(state: np.ndarray, weights: np.ndarray, drive: np.ndarray, dt: float, tau: float) -> np.ndarray:
    """Euler step of a continuous attractor network."""
    return state + dt / tau * (-state + weights @ np.tanh(state) + drive)


def drifted(state: np.ndarray, dt: float, beta: float, rng: np.random.Generator) -> np.ndarray:
    return state + np.sqrt(2 * dt / beta) * rng.standard_normal(len(state))


def hopfield(patterns: np.ndarray, query: np.ndarray, beta: float) -> np.ndarray:
    """Softmax-weighted sum of stored patterns; the query itself if there are none."""
    if not len(patterns):
        return query
    score = beta * (patterns @ query)
    weight = np.exp(score - score.max())
    return weight @ patterns / weight.sum()


def hebbian(weights: np.ndarray, post: np.ndarray, pre: np.ndarray, rate: float, decay: float) -> np.ndarray:
    return (1 - decay) * weights + rate * np.outer(post, pre)


def free_energy(seen: np.ndarray, expected: np.ndarray, state: np.ndarray, prior: np.ndarray, precision: float) -> float:
    return float(0.5 * ((seen - expected) ** 2).sum() + 0.5 * precision * ((state - prior) ** 2).sum())


def leapfrog(q: np.ndarray, p: np.ndarray, gradient, dt: float) -> tuple[np.ndarray, np.ndarray]:
    half = p - dt / 2 * gradient(q)
    q = q + dt * half
    return q, half - dt / 2 * gradient(q)


def resampled(x: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear resampling."""
    if rate == to or not len(x):
        return x
    n = max(1, int(len(x) * to / rate))
    return np.interp(np.arange(n) * rate / to, np.arange(len(x)), x).astype(np.float32)


def mel(hz):
    return 2595 * np.log10(1 + np.asarray(hz) / 700)


def hertz(mels):
    return 700 * (10 ** (np.asarray(mels) / 2595) - 1)


def mel_filters(bands: int, size: int, rate: int) -> np.ndarray:
    """Triangles between equally spaced mels, a row a band."""
    edge = hertz(np.linspace(mel(0), mel(rate / 2), bands + 2))
    at = np.fft.rfftfreq(size, 1 / rate)
    up = (at - edge[:-2, None]) / (edge[1:-1] - edge[:-2])[:, None]
    down = (edge[2:, None] - at) / (edge[2:] - edge[1:-1])[:, None]
    return np.maximum(0, np.minimum(up, down))


def log_mel(x: np.ndarray, rate: int = 16_000, size: int = 400, hop: int = 160, bands: int = 80) -> np.ndarray:
    frames = np.lib.stride_tricks.sliding_window_view(np.pad(x, (0, max(0, size - len(x)))), size)[::hop]
    power = np.abs(np.fft.rfft(frames * np.hanning(size + 1)[:-1], axis=1)) ** 2
    logs = np.log10(np.maximum(power @ mel_filters(bands, size, rate).T, 1e-10))
    return (np.maximum(logs, logs.max() - 8) + 4) / 4


def wav_mono(data: bytes, rate: int = 16_000) -> np.ndarray:
    """A PCM WAV file as mono samples from -1 to 1 at one rate; channels are averaged."""
    with wave.open(io.BytesIO(data)) as f:
        width, channels, own = f.getsampwidth(), f.getnchannels(), f.getframerate()
        raw = np.frombuffer(f.readframes(f.getnframes()), dtype=np.uint8).reshape(-1, width)
    if width == 1:
        x = (raw[:, 0].astype(np.float64) - 128) / 128
    else:
        whole = np.zeros((len(raw), 4), dtype=np.uint8)
        whole[:, 4 - width :] = raw  # the sample's bytes on top keep its sign
        x = whole.view("<i4")[:, 0] / 2.0**31
    return resampled(x.reshape(-1, channels).mean(axis=1).astype(np.float32), own, rate)


def fitted(x: np.ndarray, n: int) -> np.ndarray:
    """Exactly n samples: cut, or filled up with silence."""
    return np.pad(x[:n], (0, max(0, n - len(x))))


def masked_mean(states: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean of the token states that the mask keeps, at length one; batch, token and place are the axes."""
    kept = mask[..., None].astype(np.float64)
    mean = (states * kept).sum(axis=-2) / np.maximum(kept.sum(axis=-2), 1e-9)
    return mean / np.maximum(np.sqrt((mean**2).sum(axis=-1, keepdims=True)), 1e-12)


def halved(v: np.ndarray) -> np.ndarray:
    """Means of neighbouring places: 768 to 384."""
    return v.reshape(*v.shape[:-1], -1, 2).mean(axis=-1)
