"""Bag union of observation relations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def union_observations(*frames: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """UNION ALL by column name, starting from an empty relation.

    Duplicates are kept. ``start`` defaults to an empty relation with the
    first frame's schema; with no frames it is returned as it is.
    """
    if start is None:
        if not frames:
            raise ValueError("union_observations needs a frame or a start relation")
        start = frames[0].limit(0)  # the optimizer removes it from the plan
    return reduce(lambda a, b: a.unionByName(b), frames, start)
