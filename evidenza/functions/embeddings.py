"""Embedding providers behind one interface, a circuit breaker, and the response shape for batches."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..schema import StoreError
from .hashing import hash_embedding
from .text import usage_tokens


class Provider(Protocol):
    """name, dimensions, and vectors for a batch of texts; one call per Arrow batch, on the worker."""

    name: str
    dimensions: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashProvider:
    name = "hash"

    def __init__(self, dimensions: int = 384, lower: bool = True):
        self.dimensions, self.lower = max(1, dimensions), lower

    def embed(self, texts: list[str]) -> list[list[float]]:
        return hash_embedding(self.dimensions, self.lower).func(pd.Series(texts, dtype=object)).tolist()


class CommandProvider:
    """Vectors that a shell command prints for each text: numbers between commas or spaces, with or without brackets."""

    name = "command"

    def __init__(self, command: str, dimensions: int | None = None):
        self.command, self.dimensions = command, dimensions

    @staticmethod
    def parse(printed: str) -> list[float]:
        bare = printed.strip()
        if not bare:
            raise StoreError("the embedding command printed nothing")
        out = []
        for token in bare.lstrip("[").rstrip("]").replace(",", " ").split():
            try:
                with np.errstate(over="ignore"):
                    value = float(np.float32(token))
            except ValueError:
                raise StoreError(f"the embedding command printed no number: {token}") from None
            if not np.isfinite(value):
                raise StoreError("the embedding command printed a number that is not finite")
            out.append(value)
        if not out:
            raise StoreError("the embedding command printed no numbers")
        return out

    def embed(self, texts: list[str]) -> list[list[float]]:
        from ..operators.extraction import run_command

        found = []
        for text in texts:
            printed, error = run_command(self.command, text.encode())
            if error:
                raise StoreError(error)
            found.append(self.parse(printed))
            if self.dimensions and len(found[-1]) != self.dimensions:
                raise StoreError(f"the embedding has {len(found[-1])} dimensions, not {self.dimensions}")
        return found


class CircuitOpenError(RuntimeError):
    pass


class CircuitBreaker:
    """Closed until `threshold` failures in a row, then open for `reset_s`, then half open for one try."""

    def __init__(self, threshold: int = 5, reset_s: float = 30.0, clock: Callable[[], float] = time.monotonic):
        self.threshold, self.reset_s, self.clock = max(1, threshold), reset_s, clock
        self.failures, self.opened, self.trying = 0, None, False

    @property
    def state(self) -> str:
        if self.opened is None:
            return "closed"
        return "half_open" if self.clock() - self.opened >= self.reset_s else "open"

    def call(self, f: Callable, *args):
        if self.state == "open" or self.trying:
            raise CircuitOpenError("circuit is open")
        self.trying = self.state == "half_open"
        try:
            out = f(*args)
        except Exception:
            self.failures += 1
            if self.trying or self.failures >= self.threshold:
                self.opened = self.clock()
            raise
        finally:
            self.trying = False
        self.failures, self.opened = 0, None
        return out


class Guarded:
    def __init__(self, inner: Provider, breaker: CircuitBreaker):
        self.inner, self.breaker, self.name, self.dimensions = inner, breaker, inner.name, inner.dimensions

    def embed(self, texts: list[str]) -> list[list[float]]:
        return self.breaker.call(self.inner.embed, texts)


def provider_for(name: str | None, dimensions: int = 384, known: dict[str, Callable[[int], Provider]] | None = None) -> Provider:
    """The provider of that name, or the hash provider for an unknown one."""
    return (known or {}).get((name or "").strip().lower(), HashProvider)(dimensions)


def embed(texts: Column, make: Callable[[], Provider]) -> Column:
    """Vectors of texts; each worker makes its provider once."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        provider = make()
        for batch in batches:
            yield pd.Series([np.asarray(v, "float32") for v in provider.embed(batch.fillna("").tolist())], dtype=object)

    return run(texts)


@F.pandas_udf(T.StringType())
def packed_base64(vectors: pd.Series) -> pd.Series:
    """Little-endian 32-bit floats as base64."""
    import base64

    return pd.Series([base64.b64encode(np.asarray(v, "<f4").tobytes()).decode() for v in vectors], dtype=object)


def response_rows(inputs: DataFrame, provider: Callable[[], Provider], encoding: str = "float") -> DataFrame:
    """(index, embedding, prompt_tokens) of inputs (index, text), as floats or base64."""
    out = inputs.withColumn("embedding", embed(F.col("text"), provider)).withColumn("prompt_tokens", usage_tokens(F.col("text")))
    return out.select("index", packed_base64("embedding").alias("embedding") if encoding == "base64" else "embedding", "prompt_tokens")
