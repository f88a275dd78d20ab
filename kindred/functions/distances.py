"""Distance functions on columns. A distance is null where distortion is impossible."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Distance = Callable[[Column, Column], Column]


def levenshtein(threshold: int | None = None) -> Distance:
    """Edit distance in characters, cut off inside the JVM if there is a threshold."""
    if threshold is None:
        return lambda y, x: F.levenshtein(y, x).cast("double")

    def bounded(y: Column, x: Column) -> Column:
        d = F.levenshtein(y, x, threshold)
        return F.when(d >= 0, d.cast("double"))

    bounded.edit_threshold = threshold  # lets the similarity join generate candidates
    return bounded


def threshold_distance(distance: Distance, threshold: float, scale: float = 1.0) -> Distance:
    """scale * distance where that is at most the threshold, else impossible."""
    if threshold < 0 or scale < 0:
        raise ValueError("threshold and scale must not be negative")

    def cut(y: Column, x: Column) -> Column:
        d = distance(y, x) * scale
        return F.when(d <= threshold, d)

    own = getattr(distance, "edit_threshold", None)
    if own is not None:
        cut.edit_threshold = own if scale == 0 else min(own, int(threshold / scale))
    return cut
