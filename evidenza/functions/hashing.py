"""64-bit FNV hashes and what is built on them, as Arrow functions over whole batches."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import functions as F, types as T

# Fixed values of the hash: the standard offset basis, the one used for routing, the prime.
BASIS, ROUTING_BASIS, PRIME = 14695981039346656037, 1469598103934665603, 1099511628211


LOWER = {c: c + 32 for c in range(65, 91)}
SPACE = re.compile(r"\s")
#: Characters of which the tokens are held at a time.
PIECE = 1 << 18
#: Words whose hashes are held; they and those of one piece more at most.
WORDS = 50_000


def fnv1a(raw: list[bytes], basis: int = BASIS) -> np.ndarray:
    """Hashes of many byte strings at once: one step for each byte position, over all strings still that long."""
    order = np.argsort([-len(b) for b in raw], kind="stable")
    sizes = np.array([len(raw[i]) for i in order], "int64")
    state = np.full(len(raw), basis, "u8")
    if len(raw) and sizes[0]:
        flat = np.frombuffer(b"".join(raw[i] for i in order), "u1")
        begin, shorter = np.cumsum(sizes) - sizes, -sizes
        for k in range(int(sizes[0])):
            n = int(np.searchsorted(shorter, -k))  # strings longer than k
            state[:n] = (state[:n] ^ flat[begin[:n] + k]) * np.uint64(PRIME)
    out = np.empty(len(raw), "u8")
    out[order] = state
    return out


def _bytes(values: pd.Series) -> list[bytes]:
    return [v.encode("utf-8", "surrogatepass") if v is not None else b"" for v in values]


@F.pandas_udf(T.StringType())
def fnv1a_hex(values: pd.Series) -> pd.Series:
    """Sixteen hex digits; null stays null."""
    return pd.Series([f"{h:016x}" if v is not None else None for h, v in zip(fnv1a(_bytes(values)).tolist(), values, strict=True)], dtype=object)


@F.pandas_udf(T.StringType())
def payload_fingerprint(batch_size: pd.Series, claim_ids: pd.Series) -> pd.Series:
    """Over the size, the number of ids, and each id after its length; numbers as 8 little-endian bytes."""
    le = lambda n: int(n).to_bytes(8, "little")
    raw = [le(n) + le(len(ids)) + b"".join(le(len(i.encode())) + i.encode() for i in ids) for n, ids in zip(batch_size, claim_ids, strict=True)]
    return pd.Series([f"{h:016x}" for h in fnv1a(raw).tolist()], dtype=object)


def _pieces(texts: Iterable[str | None], most: int) -> Iterator[tuple[list[int], list[str]]]:
    """Texts with their places, about `most` characters at a time; longer ones are cut after white space."""
    rows, parts, left = [], [], most
    for row, text in enumerate(texts):
        at, end = 0, len(text or "")
        while at < end:
            cut = SPACE.search(text, at + left) if end - at > left else None
            stop = cut.end() if cut else end
            rows.append(row)
            parts.append(text[at:stop])
            left, at = left - (stop - at), stop
            if left <= 0:
                yield rows, parts
                rows, parts, left = [], [], most
    if rows:
        yield rows, parts


def hash_embedding(dimensions: int, lower: bool, most: int = PIECE):
    """Unit vectors of signed token counts; blank text gives the first axis. `lower`: tokens in lower case.

    Tokens are held for about `most` characters at a time, so memory follows neither the batch's texts nor the longest.
    """

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(texts: pd.Series) -> pd.Series:
        out, of = np.zeros((len(texts), dimensions)), {}
        for rows, parts in _pieces(texts, most):
            split = [p.split() for p in parts]
            if len(of) > WORDS:
                of = {}
            names = list(set().union(*split) - of.keys())
            hashes = fnv1a([(t.translate(LOWER) if lower else t).encode() for t in names])
            of.update(zip(names, ((hashes % np.uint64(dimensions)).astype("int64") * 2 + (hashes >> np.uint64(63)).astype("int64")).tolist(), strict=True))
            sizes = [len(t) for t in split]
            flat = np.fromiter(map(of.__getitem__, chain.from_iterable(split)), "int64", sum(sizes))
            at = np.repeat(np.arange(len(rows)), sizes) * dimensions + flat // 2
            np.add.at(out, rows, np.bincount(at, 1.0 - flat % 2 * 2, len(rows) * dimensions).reshape(-1, dimensions))
        norm = np.sqrt((out**2).sum(1, keepdims=True))
        out[(norm == 0).ravel(), 0] = 1.0
        return pd.Series(list((out / np.where(norm == 0, 1, norm)).astype("float32")), dtype=object)

    return embed
