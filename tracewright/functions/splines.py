"""Spherical splines: the value at one place of the head as a weighted sum of the values at others.

After Perrin et al. (1989): ``n`` sources give a spline with one coefficient each and a constant; the
coefficients sum to zero. Positions are directions from the centre of the sphere, of any length.
"""

from __future__ import annotations

import numpy as np

STIFFNESS, TERMS, RIDGE = 4, 50, 1e-5        # order of the spline, Legendre terms, diagonal added to the system


def _kernel(cosines: np.ndarray) -> np.ndarray:
    n = np.arange(1, TERMS + 1, dtype=float)
    series = (2 * n + 1) / (n * (n + 1)) ** STIFFNESS / (4 * np.pi)
    return np.polynomial.legendre.legval(np.clip(cosines, -1.0, 1.0), np.concatenate([[0.0], series]))


def _unit(places: np.ndarray) -> np.ndarray:
    places = np.asarray(places, float).reshape(-1, 3)
    return places / np.linalg.norm(places, axis=1, keepdims=True)


def spline_weights(sources: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """(targets x sources): each row sums to 1, so a constant signal is kept."""
    a, b = _unit(sources), _unit(targets)
    n = len(a)
    system = np.ones((n + 1, n + 1))
    system[:n, :n] = _kernel(a @ a.T) + RIDGE * np.eye(n)
    system[n, n] = 0.0
    wanted = np.hstack([_kernel(b @ a.T), np.ones((len(b), 1))])
    return np.linalg.lstsq(system, wanted.T, rcond=None)[0].T[:, :n]


def subset_weights(names: tuple[str, ...], places: np.ndarray, subsets: list[list[int]]) -> np.ndarray:
    """(draws, names, names): every draw predicts all names from those of its subset."""
    out = np.zeros((len(subsets), len(names), len(names)))
    for draw, chosen in enumerate(subsets):
        out[draw][:, chosen] = spline_weights(places[chosen], places)
    return out
