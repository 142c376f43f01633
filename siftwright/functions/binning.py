"""Placing values between sorted edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import col


def edge_array(edges: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(e)) for e in edges])


def edges_passed(edges: Column, x: Column | str, capacity: int, *, inclusive: bool = True) -> Column:
    """How many entries of a sorted array lie at or below ``x`` (strictly below if not inclusive).

    A binary descent of log2(capacity) steps, so thousands of edges cost a dozen comparisons.
    ``capacity`` is an upper bound of the array's length; past its end an entry counts as infinite.
    """
    x = col(x)
    steps = [1 << i for i in range(max(capacity, 1).bit_length() - 1, -1, -1)]

    def descend(pos: Column, step: Column) -> Column:
        probe = F.get(edges, pos + step - 1)
        return F.when(probe <= x if inclusive else probe < x, pos + step).otherwise(pos)

    walked = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), descend)
    return F.when(x.isNotNull(), walked)


def bin_right_closed(x: Column | str, edges: Sequence[float]) -> Column:
    """1-based bin over ``(lo, hi]`` intervals; NULL outside the edges."""
    x = col(x)
    inside = (x > float(edges[0])) & (x <= float(edges[-1]))
    return F.when(inside, edges_passed(edge_array(edges), x, len(edges), inclusive=False))


def bin_left_closed(x: Column | str, edges: Sequence[float]) -> Column:
    """1-based bin over ``[lo, hi)`` intervals, the last one closed; NULL outside the edges."""
    x = col(x)
    inside = (x >= float(edges[0])) & (x <= float(edges[-1]))
    passed = edges_passed(edge_array(edges), x, len(edges))
    return F.when(inside, F.least(passed, F.lit(len(edges) - 1)))
