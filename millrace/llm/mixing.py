"""Logistic mixing: what the predictors of single bits share."""

from __future__ import annotations

import numpy as np

LEVELS, APM_BINS = 6, 33
#: Steps of a mixed value from -12 to 12, for which the refined shares of a zero and a one are kept.
GRID = 4096
#: How strongly weights keep to where they begin: exact shares hold a token's own count, so that weights learnt freely on a small corpus trust them too far.
HOLD = 2000.0


def stretch(p):
    return np.log(p / (1 - p))


def squash(x):
    return 1 / (1 + np.exp(-x))


def opinion(n0: np.ndarray, n1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretched prediction and level of confidence of two counts."""
    n = n0 + n1
    return np.clip(stretch((n1 + 0.02) / (n + 0.04)), -9, 9).astype(np.float32) * (n > 0), np.minimum(LEVELS - 1, np.ceil(np.log2(n + 1) / 2)).astype(np.int8)


def between(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lower of the two entries of a probability map that a mixed value lies between, and how far it is from there to the next."""
    at = (np.clip(z, -7.999, 7.999) + 8) * ((APM_BINS - 1) / 16)
    low = at.astype(np.int64)
    return low, at - low


def bin_of(z: np.ndarray) -> np.ndarray:
    """The nearest entry of a probability map."""
    return ((np.clip(z, -7.999, 7.999) + np.float32(8)) * np.float32((APM_BINS - 1) / 16) + np.float32(0.5)).astype(np.int32)


def learn(weights: np.ndarray, curve: np.ndarray, x: list[np.ndarray], cell: np.ndarray, bit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One step of online logistic regression, one for each of at most 256 cells, on bits seen together; gives their order by cell and their mixed values in it.

    ``x`` has the inputs of all bits, input by input, to which a constant is added. A cell moves
    by its slope over ``curve``, the squares of all slopes that it has met.
    """
    order = np.argsort(cell, kind="stable")
    each = np.bincount(cell, minlength=len(weights))
    y = np.ones((len(x) + 1, len(order)), np.float32)
    for row, own in zip(y, x):
        own.take(order, out=row, mode="clip")  # no copy in between
    z, now = np.empty(len(order), np.float32), weights.astype(np.float32)
    met, end = np.flatnonzero(each), np.cumsum(each)
    ranges = [*zip(met.tolist(), (end - each)[met].tolist(), end[met].tolist())]
    for c, a, b in ranges:
        z[a:b] = now[c] @ y[:, a:b]
    np.clip(z, -12, 12, out=z)
    error = bit.take(order).astype(np.float32)
    error -= squash(z)
    y *= error
    for c, a, b in ranges:
        part = y[:, a:b]
        curve[c] += part @ part.T
    starts = (end - each)[met]
    slope = np.stack([np.add.reduceat(row, starts) for row in y], 1).astype(np.float64) if len(met) else np.zeros((0, len(y)))
    weights[met] += np.linalg.solve(curve[met], slope[..., None])[..., 0]
    return order, z


def merged(weights: np.ndarray, curves: np.ndarray) -> np.ndarray:
    """The weights of many learners as one, each as far as its curve knows them."""
    return np.linalg.solve(curves.sum(0), (curves @ weights[..., None]).sum(0))[..., 0]


def no_curve(weights: np.ndarray) -> np.ndarray:
    """What holds weights where they begin until bits are met."""
    return np.tile(HOLD * np.eye(weights.shape[-1]), (*weights.shape[:-1], 1, 1))


def step_of(z: np.ndarray) -> np.ndarray:
    """The step of the grid that a mixed value lies in."""
    return ((np.clip(z, -11.99, 11.99) + 12) * (GRID / 24)).astype(np.int64)


def refined_logs(apm: np.ndarray, least: float) -> np.ndarray:
    """(row of the map, step, bit): logarithms of the shares, half from the mix and half from the map, for the middle of each step."""
    z = (np.arange(GRID) + 0.5) * (24 / GRID) - 12
    at, part = between(z)
    p = np.clip((squash(z) + apm[:, at] * (1 - part) + apm[:, at + 1] * part) / 2, least, 1 - least)
    return np.log(np.stack((1 - p, p), -1))
