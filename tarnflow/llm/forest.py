"""Components of a small graph in numpy."""

from __future__ import annotations

import numpy as np


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Labels of the components of n nodes under edges (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new
