"""Byte-level BPE encoding and decoding by overlapping chunks.

A text is cut into chunks that overlap. Each chunk is cut into pre-tokens on its own, whatever
stood before it, and neighbours are stitched at the first place where the pre-token boundaries of
both coincide: from such a place on, both go on alike, up to the last pre-tokens of the earlier
chunk, which its end may have changed and which are never used. The pre-tokens, the same as those
of the whole text, are then encoded by ranks, each distinct one once per worker. Decoding looks up
the raw bytes of each id and concatenates them; nothing is decoded as characters on the way.

Where neighbours share no boundary in the overlap (one pre-token longer than it), the earlier chunk
is continued instead, so results never depend on the chunk size.

Defined cases: null text counts as empty and has no ids; an empty table gives an empty result;
repeated rows give repeated rows; columns of the input with an output's name are replaced.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import arrow_batches, table, text_or_empty
from .memo import Memo, groups_by_chars

CHUNK, OVERLAP = 1 << 16, 1 << 9
#: What may follow a pre-token and still decide where it ends: contractions look 3 characters ahead.
LOOK = 3
_loaded: dict[tuple, "Codec"] = {}


class Codec:
    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        self.pattern = regex.compile(pattern)
        self.encoding = tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for raw, rank in ranks.items():
            self.bytes_of[rank] = raw
        self.memo = Memo(self._encode, unload=_loaded.clear)

    def _encode(self, pieces: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each pre-token."""
        one = self.encoding._core_bpe.encode_single_piece
        return [np.array(one(p.encode("utf-8", "surrogatepass")), "<u4").tobytes() for p in pieces]

    def cuts(self, text: str, start: int, end: int) -> list[tuple[int, int]]:
        return [m.span() for m in self.pattern.finditer(text[start:end])] if start == 0 else [(a + start, b + start) for a, b in (m.span() for m in self.pattern.finditer(text[start:end]))]

    def pretokens(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
        if len(text) <= chunk + overlap:
            return self.pattern.findall(text)
        out: list[tuple[int, int]] = []
        at, size = 0, len(text)
        while at < size:
            end = min(size, at + chunk + overlap)
            mine = self.cuts(text, at, end)
            if end == size:
                out += mine
                break
            sure = [s for s in mine if s[1] + LOOK <= end]
            begin = end - overlap
            theirs = {a for a, _ in self.cuts(text, begin, min(size, end + overlap))[1:]}
            meet = next((k for k, (a, _) in enumerate(sure) if a > begin and a in theirs), None)
            if meet is None:  # no common boundary: go on from the last sure one, with a wider chunk
                if len(sure) < 2:
                    chunk *= 2
                    continue
                meet = len(sure) - 1
            out += sure[:meet]
            at = sure[meet][0]
        return [text[a:b] for a, b in out]

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        for group in groups_by_chars(texts):
            split = [self.pretokens(t) for t in group]
            get = self.memo.of(split).__getitem__
            for pieces in split:
                yield b"".join(map(get, pieces))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = Codec(path, pattern)
    return _loaded[path, pattern]


def encode(df: DataFrame, path: str, pattern: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """`df` with `out_col`: the ids of each whole text as little-endian unsigned 32-bit integers."""

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = codec(path, pattern)
        for texts in batches:
            yield pd.Series(list(c.ids(texts.tolist())), dtype=object)

    return df.withColumn(out_col, run(text_or_empty(text_col)))


def decode(df: DataFrame, path: str, pattern: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """`df` with `out_col`: the raw bytes that the ids stand for; null ids give none."""

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = codec(path, pattern)
        for ids in batches:
            yield pd.Series([c.decode(x) for x in ids], dtype=object)

    return df.withColumn(out_col, run(F.coalesce(F.col(ids_col), F.lit(b""))))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    arrow_batches(spark)
    path, pattern = P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decode(encode(docs, path, pattern).drop("text"), path, pattern)
    return out.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
