"""What the vector operators share: which vectors take part, and how they reach numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F


def taking_part(column: str) -> Column:
    """Not null, not empty, all components finite, one of them not zero."""
    v = F.col(column)
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def stacked(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, "float64") for v in vectors]) if len(vectors) else np.zeros((0, 0))


