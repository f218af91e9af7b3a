"""Exclusive prefix sums of the totals of parts, of which there are as many as files."""

from __future__ import annotations

from itertools import accumulate


def bases(totals: list[int]) -> list[int]:
    """What comes before each part, from the parts' totals in order."""
    return [0, *accumulate(totals)][:-1]
