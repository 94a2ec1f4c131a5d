"""Sequential search of settings: proposals by the ratio of densities of good and bad past trials."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

# First trials are drawn at random, then the best of so many candidates is tried; the best tenth of trials, at most 25, is good.
RANDOM_TRIALS = 10
CANDIDATES = 24
GOOD_SHARE, MOST_GOOD = 0.1, 25


@dataclass(frozen=True)
class Range:
    """Values of a setting: real or whole, in steps, on a plain or a logarithmic scale."""

    low: float
    high: float
    whole: bool = False
    step: int = 1
    log: bool = False

    def inner(self) -> tuple[float, float]:
        """Bounds on the scale of the densities; whole values take half a step on both sides."""
        half = self.step / 2 if self.whole else 0.0
        low, high = self.low - half, self.high + half
        return (math.log(low), math.log(high)) if self.log else (low, high)

    def value(self, x: float) -> float:
        if self.log:
            x = math.exp(x)
        if self.whole:
            return int(min(self.high, max(self.low, self.low + self.step * round((x - self.low) / self.step))))
        return float(min(self.high, max(self.low, x)))

    def place(self, value: float) -> float:
        return math.log(value) if self.log else float(value)


def density(points: list[float], low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """Centres and widths of equally weighted normal curves, cut at the bounds: one per past value, as wide as the larger gap to its
    neighbours, and one over the whole range."""
    centres = np.array([*points, (low + high) / 2])
    order = np.argsort(centres, kind="stable")
    edged = np.concatenate([[low], centres[order], [high]])
    width = np.empty(len(centres))
    width[order] = np.maximum(edged[1:-1] - edged[:-2], edged[2:] - edged[1:-1])
    width = np.clip(width, (high - low) / min(100, 1 + len(centres)), high - low)
    width[-1] = high - low
    return centres, width


def _cdf(x):
    return 0.5 * (1 + np.vectorize(math.erf)(np.asarray(x, float) / math.sqrt(2)))


def log_density(x: np.ndarray, centres: np.ndarray, width: np.ndarray, low: float, high: float) -> np.ndarray:
    inside = _cdf((high - centres) / width) - _cdf((low - centres) / width)
    curves = np.exp(-0.5 * ((x[:, None] - centres) / width) ** 2) / (width * math.sqrt(2 * math.pi) * inside)
    return np.log(curves.mean(1) + 1e-300)


def draws(rng: np.random.Generator, n: int, centres: np.ndarray, width: np.ndarray, low: float, high: float) -> np.ndarray:
    out = np.empty(n)
    for k in range(n):
        c = rng.integers(len(centres))
        x = rng.normal(centres[c], width[c])
        while not low <= x <= high:
            x = rng.normal(centres[c], width[c])
        out[k] = x
    return out


def propose(space: dict[str, Range], past: list[tuple[dict, float]], seed: int) -> dict:
    """Settings of the next trial after ``past`` (settings, error), fixed by them and the seed.

    Every setting is chosen by itself: of CANDIDATES draws from the density of the good trials, the one where its ratio to the
    density of the others is largest."""
    rng = np.random.default_rng([seed, len(past)])
    if len(past) < RANDOM_TRIALS:
        return {name: r.value(rng.uniform(*r.inner())) for name, r in space.items()}
    ranked = sorted(range(len(past)), key=lambda k: (past[k][1], k))
    n_good = min(MOST_GOOD, math.ceil(GOOD_SHARE * len(past)))
    out = {}
    for name, r in space.items():
        low, high = r.inner()
        good, bad = ([r.place(past[k][0][name]) for k in sorted(part)] for part in (ranked[:n_good], ranked[n_good:]))
        x = draws(rng, CANDIDATES, *(own := density(good, low, high)), low, high)
        ratio = log_density(x, *own, low, high) - log_density(x, *density(bad, low, high), low, high)
        out[name] = r.value(float(x[int(np.argmax(ratio))]))
    return out
