"""Shapes of chunks and blocks."""

from __future__ import annotations

import math
from collections.abc import Sequence

CHUNK_LENGTH = 1_000_000


def chunk_shape(dim: Sequence[int], length: int = CHUNK_LENGTH, shape: str = "scale") -> tuple[int, ...]:
    """Chunk extents of at most ``length`` cells: all of the array, or (scale) each axis shrunk by one factor, or (first) first axes whole."""
    total = math.prod(dim)
    if total <= length or total == 0:
        return tuple(max(1, d) for d in dim)
    if shape == "scale":
        f = (length / total) ** (1 / len(dim))
        return tuple(max(1, int(d * f)) for d in dim)
    if shape != "first":
        raise ValueError(f"shape {shape!r}")
    out, left = [], length
    for d in dim:
        out.append(max(1, min(d, left)))
        left //= max(1, out[-1])
    return tuple(out)
