"""Orthogonal selections: checking, reduction to runs, and the chunks they touch.

A selection has for each axis either None (everything), or 1-based starts, or starts with counts. Everything here is
arithmetic on positions with Python's own integers, so extents beyond 32 bits need nothing special.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import pairwise

Positions = Sequence[float] | None


class SelectionError(ValueError):
    """A selection that does not fit the array."""


def _whole(values: Sequence[float], what: str, axis: int) -> list[int]:
    out = []
    for v in values:
        if v is None or isinstance(v, float) and not math.isfinite(v):
            raise SelectionError(f"{what} on axis {axis + 1} has {v}")
        out.append(round(v))
    return out


def _axes(dim: Sequence[int], starts: Sequence[Positions] | None, counts: Sequence[Positions] | None) -> list[tuple[int, list[int] | None, list[int] | None]]:
    starts = [None] * len(dim) if starts is None else list(starts)
    counts = [None] * len(dim) if counts is None else list(counts)
    if len(starts) != len(dim) or len(counts) != len(dim):
        raise SelectionError(f"{len(dim)} axes, {len(starts)} starts and {len(counts)} counts")
    found = []
    for axis, (d, s, c) in enumerate(zip(dim, starts, counts, strict=True)):
        if s is None and c is not None:
            raise SelectionError(f"counts without starts on axis {axis + 1}")
        at = None if s is None else _whole(s, "starts", axis)
        runs = None if c is None else _whole(c, "counts", axis)
        if at is not None:
            if runs is not None and len(runs) != len(at):
                raise SelectionError(f"{len(at)} starts and {len(runs)} counts on axis {axis + 1}")
            for k, p in enumerate(at):
                n = 1 if runs is None else runs[k]
                if n < 0:
                    raise SelectionError(f"count {n} on axis {axis + 1}")
                if p < 1 or d >= 0 and p + n - 1 > d:
                    raise SelectionError(f"positions {p} to {p + n - 1} on axis {axis + 1} of extent {d}")
        found.append((d, at, runs))
    return found


def check_selection(dim: Sequence[int], starts: Sequence[Positions] | None = None, counts: Sequence[Positions] | None = None) -> tuple[int, ...]:
    """The extents of the selection; an error if it does not fit. A negative extent is unbounded."""
    return tuple(d if s is None else len(s) if c is None else sum(c) for d, s, c in _axes(dim, starts, counts))


def check_ordered_selection(dim: Sequence[int], starts: Sequence[Positions] | None = None, counts: Sequence[Positions] | None = None) -> tuple[tuple[int, ...], tuple[int | None, ...]]:
    """The extents, and the number of runs on each axis; starts must ascend strictly and runs must not overlap."""
    extents, runs = [], []
    for axis, (d, s, c) in enumerate(_axes(dim, starts, counts)):
        if s is None:
            extents.append(d)
            runs.append(None)
            continue
        n = [1] * len(s) if c is None else c
        if any(b < a + k for (a, k), b in zip(zip(s, n, strict=True), s[1:], strict=False)) or any(b <= a for a, b in pairwise(s)) and c is None:
            raise SelectionError(f"starts on axis {axis + 1} do not ascend")
        extents.append(sum(n))
        runs.append(len(_runs(s, n)))
    return tuple(extents), tuple(runs)


def _runs(starts: Sequence[int], counts: Sequence[int]) -> list[tuple[int, int]]:
    """Maximal runs (start, count) of runs in ascending order; empty ones vanish."""
    out: list[tuple[int, int]] = []
    for s, n in zip(starts, counts, strict=True):
        if n == 0:
            continue
        if out and out[-1][0] + out[-1][1] == s:
            out[-1] = (out[-1][0], out[-1][1] + n)
        else:
            out.append((s, n))
    return out


def reduce_selection(dim: Sequence[int], starts: Sequence[Positions] | None = None, counts: Sequence[Positions] | None = None) -> list[list[tuple[int, int]] | None] | None:
    """The maximal runs of each axis (None: everything), or None if no axis gets fewer runs."""
    check_ordered_selection(dim, starts, counts)
    out, fewer = [], False
    for _, s, c in _axes(dim, starts, counts):
        if s is None:
            out.append(None)
            continue
        runs = _runs(s, [1] * len(s) if c is None else c)
        fewer |= len(runs) < len(s)
        out.append(runs)
    return out if fewer else None


def map_to_chunks(starts: Sequence[Positions], dim: Sequence[int], chunkdim: Sequence[int]) -> list[tuple[list[int], list[int]] | None]:
    """For each axis the ids (from 0) of the chunks that ascending starts touch, after how many starts each ends, as (ends, ids)."""
    check_ordered_selection(dim, starts)
    out: list[tuple[list[int], list[int]] | None] = []
    for s, c in zip(starts, chunkdim, strict=True):
        if s is None:
            out.append(None)
            continue
        ends, ids = [], []
        for k, p in enumerate(s, 1):
            chunk = (round(p) - 1) // c
            if ids and ids[-1] == chunk:
                ends[-1] = k
            else:
                ids.append(chunk)
                ends.append(k)
        out.append((ends, ids))
    return out


@dataclass(frozen=True)
class AxisPlan:
    """What is read of one axis: everything (runs None), or ascending runs, or positions in any order, with the runs they make up.

    Runs stay runs, whatever they hold; only positions that were asked for one by one are listed.
    """

    order: tuple[int, ...] | None
    runs: tuple[tuple[int, int], ...] | None
    chunks: tuple[tuple[int, int], ...] | None

    @property
    def extent(self) -> int | None:
        return len(self.order) if self.order is not None else None if self.runs is None else sum(n for _, n in self.runs)


#: More runs than this go by a join with the positions; up to it, by BETWEEN, which prunes row groups.
MAX_RUNS = 64


def _chunks_of(runs: Sequence[tuple[int, int]], chunk: int) -> tuple[tuple[int, int], ...]:
    out: list[tuple[int, int]] = []
    for s, n in runs:
        first, last = (s - 1) // chunk, (s + n - 2) // chunk
        if out and first < out[-1][0] + out[-1][1]:
            first = out[-1][0] + out[-1][1]
        if first <= last:
            out.append((first, last - first + 1))
    return tuple(_runs([a for a, _ in out], [n for _, n in out]))


def plan_axis(extent: int, chunk: int | None, positions: Positions, counts: Positions = None) -> AxisPlan:
    """Any order and repeats are allowed without counts; with counts the runs must ascend. A range is one run."""
    if positions is None:
        return AxisPlan(None, None, None)
    if counts is None and isinstance(positions, range) and positions.step == 1 and len(positions):
        positions, counts = [positions.start], [len(positions)]
    check_selection([extent], [positions], [counts])
    order = None
    if counts is not None:
        check_ordered_selection([extent], [positions], [counts])
        runs = tuple(_runs(positions, counts))
    else:
        order = tuple(round(p) for p in positions)
        distinct = sorted(set(order))
        runs = tuple(_runs(distinct, [1] * len(distinct)))
        if sum(n for _, n in runs) == len(order) and list(order) == distinct:
            order = None
    return AxisPlan(order, runs, _chunks_of(runs, chunk) if chunk else None)


def dense_enough(positions: Sequence[int] | None, threshold: float = 0.2) -> bool:
    """Whether to read the whole stretch from the least to the greatest position (linear), not each one by itself."""
    if positions is None:
        return True
    if not len(positions):
        return False
    return len(positions) / (max(positions) - min(positions) + 1) >= threshold


def axes_to_collapse(dim: Sequence[int], new_dim: Sequence[int]) -> tuple[int, int] | None:
    """First and last axis (from 0) of the one group of neighbours that new_dim joins; None if the extents are the same.

    Joined or not, axes end at the same running products of extents; those that new_dim leaves out stand in the joined group.
    """
    dim, new_dim = tuple(dim), tuple(new_dim)
    if dim == new_dim:
        return None
    gone = len(dim) - len(new_dim)
    if gone < 1:
        raise SelectionError("only neighbouring axes can be joined, into one")
    for first in range(len(new_dim)):
        group = dim[first : first + gone + 1]
        if dim[:first] + (math.prod(group),) + dim[first + gone + 1 :] == new_dim:
            return first, first + gone
    if math.prod(dim) != math.prod(new_dim):
        raise SelectionError(f"{dim} and {new_dim} differ in length")
    raise SelectionError(f"{new_dim} does not join one group of neighbouring axes of {dim}")
