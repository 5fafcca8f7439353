"""Graph steps that run inside one task on arrays of bounded size."""

from __future__ import annotations

import numpy as np


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of the component of each of ``n`` nodes under the edges ``a[i] - b[i]``, by hooking and pointer jumping."""
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        if np.array_equal(ra, rb):
            return root
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            jumped = root[root]
            if np.array_equal(jumped, root):
                break
            root = jumped
