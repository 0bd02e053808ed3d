"""Token counts: batch encoding in Arrow functions that returns lengths only.

Long texts are split at safe boundaries, places over which the tokenizer can never join two
symbols, and the pieces are encoded in batches balanced by bytes. For a SentencePiece BPE model
whose pieces hold the space mark only in front, the place before a space that follows another
character is safe: no merge crosses it, so the lengths of the parts add up to the length of the
whole. So is the place before a line feed, where no piece holds one. Parts recur, and a worker
encodes each of them once.

Defined cases: null text counts as empty (0 tokens, 0 bytes); an empty table gives an empty
result; repeated rows give repeated rows; a column of the input with an output's name is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import arrow_batches, once, table, text_or_empty
from .memo import Memo, groups_by_chars

SPACE = "▁"
#: Characters of a long text that are taken to parts at once.
WINDOW = 1 << 20
_loaded: dict[str, object] = {}


class PieceLengths:
    """Lengths by a SentencePiece model, without begin, end or added special tokens."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        # The rules below hold for a model that changes nothing but spaces and puts one in front.
        plain = all(self.model.encode(x, out_type=str) == y for x, y in (("a  b", ["▁a", "▁", "▁b"]), (" a", ["▁", "▁a"]), ("a ", ["▁a", "▁"]), ("½", ["▁", "½"])))
        self.safe = plain and not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces)
        self.lines = self.safe and not any("\n" in p for p in pieces)
        self.memo = Memo(self._lengths, unload=_loaded.clear)

    def _lengths(self, parts: list[str]) -> list[int]:
        """A part that begins with a line feed stands inside a word: the space put in front does not count."""
        found = self.model.encode(parts, num_threads=1)
        return [len(ids) - (part[:1] == "\n") if part else 1 for part, ids in zip(parts, found, strict=True)]

    def parts(self, text: str) -> list[str]:
        """Parts of a text that each encode alone. A part's first space, put in front, is left out."""
        if SPACE in text:
            return []
        spaced = text.replace("\n", " \n") if self.lines else text
        if spaced[:1] != " " and spaced[-1:] != " " and "  " not in spaced:
            return spaced.split(" ")
        out = []
        for k, part in enumerate(re.findall(r" +\Z| *[^ ]+", text)):
            head, *rest = part.split("\n") if self.lines else [part]
            out.append(head if not k else head[1:])
            out += ["\n" + x for x in rest]
        return out

    def windows(self, text: str) -> Iterator[tuple[str, bool]]:
        """A long text in parts that begin at safe boundaries (all but the first lack their first space)."""
        start = 0
        while len(text) - start > WINDOW:
            end = start + WINDOW
            while 0 < (end := text.find(" ", end)) and text[end - 1] == " ":
                end += 1
            if end < 0:
                break
            yield text[start:end], start > 0
            start = end
        yield text[start:], start > 0

    def whole(self, text: str) -> int:
        return len(self.model.encode(text))

    def count(self, texts: list[str]) -> list[int]:
        if not self.safe:
            return [len(x) for x in self.model.encode(texts, num_threads=1)]
        out = []
        for group in groups_by_chars(texts):
            split = [self.split(t) for t in group]
            get = self.memo.of([p for p in split if p]).__getitem__
            out += [0 if not t else sum(map(get, parts)) if parts is not None else self.whole(t) for t, parts in zip(group, split, strict=True)]
        return out

    def split(self, text: str) -> list[str] | None:
        if not text or SPACE in text:
            return None
        if len(text) <= WINDOW:
            return self.parts(text)
        out: list[str] = []
        for window, inner in self.windows(text):
            # a window inside the text begins with spaces, of which the first is the one put in front
            parts = self.parts(window[1:] if inner else window)
            out += parts
        return out


def groups_by_bytes(texts: list[str], most: int = WINDOW) -> Iterator[list[str]]:
    """Consecutive texts in lists of about `most` bytes; a longer text stands alone."""
    held, size = [], 0
    for text in texts:
        n = len(text.encode("utf-8", "surrogatepass"))
        if held and size + n > most:
            yield held
            held, size = [], 0
        held.append(text)
        size += n
    if held:
        yield held


class BatchLengths:
    """Lengths by a tokenizers file, in batches balanced by bytes. Texts are encoded whole: no boundary is safe for every such file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()

    def count(self, texts: list[str]) -> list[int]:
        return [len(e) for group in groups_by_bytes(texts) for e in self.model.encode_batch(group, add_special_tokens=False)]


def counter(path: str):
    if path not in _loaded:
        _loaded[path] = PieceLengths(path) if path.endswith(".model") else BatchLengths(path)
    return _loaded[path]


def count_tokens(df: DataFrame, path: str, text_col: str = "text", out_col: str = "n_tokens") -> DataFrame:
    """`df` with the number of tokens of each whole text, as the library at hand gives it."""

    @F.pandas_udf("long")
    def lengths(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = counter(path)
        for texts in batches:
            yield pd.Series(model.count(texts.tolist()), dtype="int64")

    return df.withColumn(out_col, once(lengths)(text_or_empty(text_col)))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    arrow_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", text_or_empty("text").alias("text"))
    out = count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))
