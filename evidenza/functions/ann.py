"""Approximate vector search: signatures of sign projections, scanned by Hamming distance, reranked by exact cosine.

The index is a column: each vector's signature of `bits` signs, packed in longs. A search compares signatures with
`xor` and `bit_count` inside code generation, keeps a bounded number of nearest ones and reads only their vectors.
New vectors are indexed by computing their column, removed ones leave with their row; nothing else has to change.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..schema import StoreError
from .vectors import cosine_to


def planes(size: int, bits: int) -> np.ndarray:
    """Normals of the planes, a column for each bit: signs by a rule that SQL can follow, two rounds of multiply and shift over 32 bits."""
    h = (np.arange(size, dtype="u8")[:, None] + np.arange(bits, dtype="u8") * np.uint64(size) + np.uint64(1)) * np.uint64(2654435761) % np.uint64(1 << 32)
    h = (h ^ (h >> np.uint64(15))) * np.uint64(2246822519) % np.uint64(1 << 32)
    h = (h ^ (h >> np.uint64(13))) * np.uint64(3266489917) % np.uint64(1 << 32)
    return np.where(h >> np.uint64(31) == 1, 1.0, -1.0)


@dataclass(frozen=True)
class AnnConfig:
    """Signature bits, and how many candidates are reranked for each result, between a least and a most number."""

    bits: int = 1024
    factor: int = 16
    least: int = 64
    most: int = 4096

    def __post_init__(self) -> None:
        if self.bits <= 0 or self.bits % 64 or self.factor <= 0 or not 0 < self.least <= self.most:
            raise StoreError("signature bits are a multiple of 64, the factor is positive, the least number at most the most")

    def budget(self, n: int) -> int:
        return max(self.least, min(self.most, n * self.factor), n)

    def sign(self, x: np.ndarray) -> np.ndarray:
        """Signatures of the rows of x as signed 64-bit words."""
        return np.packbits(x @ planes(x.shape[1], self.bits) > 0, axis=1, bitorder="little").view("<i8")


def signature(values: Column, config: AnnConfig = AnnConfig()) -> Column:
    """Null for a null or empty vector; vectors of every size have planes of their own."""

    @F.pandas_udf("array<long>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vectors in batches:
            out, sizes = pd.Series([None] * len(vectors), dtype=object), vectors.map(lambda v: 0 if v is None else len(v)).to_numpy()
            for n in np.unique(sizes[sizes > 0]):
                at = np.flatnonzero(sizes == n)
                for i, row in zip(at, config.sign(np.stack([np.asarray(v, "float64") for v in vectors.iloc[at]])), strict=True):
                    out.iloc[i] = row
            yield out

    return run(values)


def indexed(vectors: DataFrame, config: AnnConfig = AnnConfig()) -> DataFrame:
    """`vectors` (claim_id, values) with their signatures."""
    return vectors.withColumn("signature", signature(F.col("values"), config))


def nearest(index: DataFrame, vector: list[float], n: int, config: AnnConfig = AnnConfig()) -> DataFrame:
    """(claim_id, cos): the n best by cosine of the nearest signatures; ties go to the smaller claim_id.

    Where no vector of the query's size has a signature, all are compared exactly.
    """
    asked = config.sign(np.asarray([vector], "float64"))[0].tolist()
    apart = sum((F.bit_count(F.get("signature", F.lit(i)).bitwiseXOR(F.lit(w))) for i, w in enumerate(asked[1:], 1)), F.bit_count(F.get("signature", F.lit(0)).bitwiseXOR(F.lit(asked[0]))))
    usable = index.filter(F.col("signature").isNotNull() & (F.size("values") == len(vector)))
    near = usable.withColumn("apart", apart).orderBy("apart", "claim_id").limit(config.budget(n)).select("claim_id", "values")
    none = usable.limit(1).agg((F.count("*") == 0).alias("none"))
    rest = index.crossJoin(F.broadcast(none)).filter("none").select("claim_id", "values")  # one row
    scored = near.union(rest).select("claim_id", cosine_to(F.col("values"), vector).alias("cos")).filter("cos is not null")
    return scored.orderBy(F.desc("cos"), "claim_id").limit(n)
