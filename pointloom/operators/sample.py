"""Bounded samples for fits on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sample(points: DataFrame, limit: int, columns: tuple = ("x", "y", "z"), seed: int = 0) -> np.ndarray:
    """At most ``limit`` rows, chosen by a hash of ord, in that order: the same however the rows are dealt out."""
    rows = points.select("ord", *columns).orderBy(F.xxhash64("ord", F.lit(seed)), "ord").limit(limit).collect()
    return np.array([[float(r[c]) for c in columns] for r in rows], dtype=float).reshape(-1, len(columns))
