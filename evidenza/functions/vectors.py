"""Vector functions as columns, in double precision."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

EPSILON = 1.1920929e-07


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null where sizes differ, a vector is empty, or the product of lengths vanishes."""
    lengths = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (lengths > EPSILON), dot(a, b) / lengths)


def cosine_to(values: Column, vector: list[float]) -> Column:
    """`cosine` against one vector, over whole Arrow batches as a matrix."""
    asked = np.asarray(vector, "float64")
    length = float(np.sqrt((asked**2).sum()))

    @F.pandas_udf("double")
    def run(vectors: pd.Series) -> pd.Series:
        out = np.full(len(vectors), np.nan)
        known = np.array([v is not None and len(v) == len(asked) > 0 for v in vectors], bool)
        if known.any():
            x = np.stack([np.asarray(v, "float64") for v in vectors[known]])
            lengths = np.sqrt((x**2).sum(1)) * length
            out[known] = np.where(lengths > EPSILON, (x * asked).sum(1) / np.where(lengths > EPSILON, lengths, 1), np.nan)
        return pd.Series(out).astype(object).where(~np.isnan(out), None)

    return run(values)


def literal(vector: list[float]) -> Column:
    return F.array(*map(F.lit, map(float, vector)))


def valid(vector: Column) -> Column:
    """Not empty and finite throughout."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
