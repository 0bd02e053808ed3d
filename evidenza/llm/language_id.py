"""Language identification of code-switched text by a linear-chain conditional random field.

Each word has a label; words of more than SEEN bytes, such as the runs of scripts without spaces, are cut
at characters into pieces of at most so many, each with a label of its own. Affixes, character n-grams and lexicon membership score it; learned
transitions, trained on sequences that switch between texts of several languages, carry the context;
forward-backward gives each word's probabilities. A text's language is the one with the largest
mean probability over its words, which is also the score.

Training takes a bounded sample of labelled rows, drawn by a hash of doc_id and text over all of them:
PER_LANGUAGE rows of each of at most MOST_LANGUAGES languages, of at most TRAIN_CHARS characters each (longer rows are not
drawn; predictions always take whole texts). Only text and label are learned from.

Defined cases: null text, or text without a letter, gives `und` and score 0; with no labelled rows
everything is `und`; ties go to the language first in order; an empty table gives an empty result;
repeated rows give repeated rows; other columns are kept, those with an output's name replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import arrow_batches, once, table, text_or_empty
from .crf import ChainCRF
from .memo import Memo, groups_by_chars

PER_LANGUAGE, TRAIN_CHARS, LEXICON_WORDS, MOST_LANGUAGES = 160, 6000, 300, 256
UNKNOWN = "und"
#: Bytes below 0x80 that are not letters part words; what lies above belongs to words.
PART = bytes(i + 32 if 0x41 <= i <= 0x5A else i if i >= 0x80 or 0x61 <= i <= 0x7A else 32 for i in range(256))


#: Most bytes of a word, all of which its features see.
SEEN = 24


def pieces(word: bytes) -> list[bytes]:
    """The word in pieces of at most SEEN bytes, none of which ends within a character."""
    out, at = [], 0
    while len(word) - at > SEEN:
        end = at + SEEN
        while word[end] & 0xC0 == 0x80:
            end -= 1
        out.append(word[at:end])
        at = end
    return [*out, word[at:]]


def words_of(text: str) -> list[bytes]:
    words = text.lower().encode("utf-8", "surrogatepass").translate(PART).split()
    if words and len(max(words, key=len)) > SEEN:
        words = [p for w in words for p in pieces(w)]
    return words


class Features:
    """Features of many words at once, hashed: the word, its affixes of 1 to 4 bytes, its n-grams of 1 to 3, its lexicon."""

    def __init__(self, lexicon: dict[bytes, str]):
        self.lexicon = lexicon
        self.languages = sorted(set(lexicon.values()))

    def rows(self, words: list[bytes], rows: int) -> tuple[np.ndarray, np.ndarray]:
        seen = [b"<" + w + b">" for w in words]
        n, width = len(words), SEEN + 2
        text = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in seen), "u1").reshape(n, width).astype("u8")
        size = np.array([len(w) for w in seen], "int64")
        at = np.arange(width)
        mix = lambda h, tag: (h + np.uint64(tag)) * np.uint64(0x9E3779B97F4A7C15)
        grams, keys, kept = np.zeros((n, width), "u8"), [], []
        for k in (1, 2, 3, 4, 5):
            grams[:, : width - k + 1] = grams[:, : width - k + 1] * np.uint64(257) + text[:, k - 1 :]
            fits = at[None, :] + k <= size[:, None]
            if k <= 3:
                keys.append(mix(grams, k))
                kept.append(fits & ((at > 0) | (k > 1)) & ((at[None, :] + k < size[:, None]) | (k > 1)))
            if k >= 2:
                ends = np.stack([grams[:, 0], grams[np.arange(n), np.maximum(size - k, 0)]], 1)
                keys.append(mix(ends, 10 + k) + np.array([0, 1 << 40], "u8"))
                kept.append(np.repeat((size >= k)[:, None], 2, 1))
        whole = np.zeros(n, "u8")
        for i in range(width):
            whole = whole * np.uint64(0x100000001B3) + text[:, i]
        known = np.array([self.languages.index(self.lexicon[w]) + 1 if w in self.lexicon else 0 for w in words], "u8")
        keys.append(np.stack([np.full(n, 77, "u8"), mix(whole, 99), mix(known, 1 << 50)], 1))
        kept.append(np.stack([np.ones(n, bool), np.ones(n, bool), known > 0], 1))
        every, fits = np.concatenate(keys, 1), np.concatenate(kept, 1)
        hashed = every ^ (every >> np.uint64(31))
        hashed = (hashed * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(34)
        return (hashed[fits] % np.uint64(rows)).astype("int64"), fits.sum(1)


class Identifier:
    def __init__(self, crf: ChainCRF | None):
        self.crf = crf
        self.labels = crf.labels if crf else []

    @classmethod
    def train(cls, rows: list[tuple[str, str]], seed: int = 7) -> Identifier:
        """Rows of (text, language), in any order. Pieces of their texts, shuffled, make sequences that switch."""
        labels = sorted({lang for _, lang in rows})
        if not labels:
            return cls(None)
        counts: dict[str, Counter] = {x: Counter() for x in labels}
        pieces, random = [], np.random.default_rng(seed)
        for text, lang in sorted(rows):
            words = words_of(text)
            counts[lang].update(words)
            at = 0
            while at < len(words):
                n = int(random.integers(3, 40))
                pieces.append((words[at : at + n], labels.index(lang)))
                at += n
        common = {lang: {w for w, _ in c.most_common(LEXICON_WORDS)} for lang, c in counts.items()}
        lexicon = {w: lang for lang in labels for w in sorted(common[lang]) if all(counts[lang][w] > 3 * counts[o][w] for o in labels if o != lang)}
        crf = ChainCRF(labels, Features(lexicon))
        order = random.permutation(len(pieces))
        sequences = []
        for i in range(0, len(order), 8):
            part = [pieces[j] for j in order[i : i + 8]]
            sequences.append(([w for words, _ in part for w in words], [y for words, y in part for _ in words]))
        crf.fit(sequences, rounds=30)
        return cls(crf)

    def _emit(self, words: list[bytes]) -> list[bytes]:
        return [row.tobytes() for row in self.crf.scores(words).astype("float32")]

    def predict(self, texts: list[str]) -> Iterator[tuple[str, float, list[float]]]:
        """Of each text the language, the score, and the shares of all languages."""
        if not self.crf:
            yield from ((UNKNOWN, 0.0, []) for _ in texts)
            return
        if not hasattr(self, "memo"):
            self.memo = Memo(self._emit, unload=_loaded.clear)
        k = len(self.labels)
        for group in groups_by_chars(texts):
            split = [words_of(t) if any(map(str.isalpha, t)) else [] for t in group]
            sizes = np.array([len(w) for w in split], "int64")
            some = sizes > 0
            share = np.zeros((len(group), k))
            if some.any():
                get = self.memo.of(split).__getitem__
                emit = np.frombuffer(b"".join(b"".join(map(get, words)) for words in split), "float32").reshape(-1, k)
                mean = self.crf.marginals(emit.astype("float64"), sizes[some])
                begin = (np.cumsum(sizes) - sizes)[some]
                share[some] = np.add.reduceat(mean, begin, 0) / sizes[some][:, None]
            best = share.argmax(1)
            for i, ok in enumerate(some):
                yield (self.labels[best[i]], float(min(1.0, share[i, best[i]])), share[i].tolist()) if ok else (UNKNOWN, 0.0, [0.0] * k)


def training_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> list[tuple[str, str]]:
    """A sample of PER_LANGUAGE rows or so of each of the MOST_LANGUAGES most common languages; rows are drawn by a hash of id and text, equal ones once."""
    fit = docs.filter(F.col(label_col).isNotNull() & F.col(text_col).isNotNull() & (F.length(text_col) <= TRAIN_CHARS) & F.col(id_col).isNotNull())
    drawn = F.pmod(F.xxhash64(F.lit("language"), id_col, text_col), F.lit(1 << 30))
    have = {r[label_col]: r["count"] for r in fit.groupBy(label_col).count().orderBy(F.desc("count"), label_col).limit(MOST_LANGUAGES).collect()}
    below = F.lit(0)
    for lang, n in sorted(have.items()):
        below = F.when(F.col(label_col) == lang, min(1 << 30, -(-(PER_LANGUAGE << 30) // n))).otherwise(below)
    return [(r[text_col], r[label_col]) for r in fit.filter(drawn < below).select(text_col, label_col).distinct().collect()]


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


_loaded: dict[str, Identifier] = {}


def identify(df: DataFrame, model: Identifier, text_col: str = "text") -> DataFrame:
    """`df` with lang_pred and score for each whole text."""
    from hashlib import sha256

    spark = df.sparkSession
    name = sha256(model.crf.weights.tobytes() + model.crf.moves.tobytes() + "".join(model.labels).encode()).hexdigest() if model.crf else ""
    sent = spark.sparkContext.broadcast(model)  # the weights' size is fixed: ROWS x languages

    @F.pandas_udf("lang_pred string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if name not in _loaded:
            _loaded.clear()
            _loaded[name] = sent.value
        for texts in batches:
            yield pd.DataFrame([x[:2] for x in _loaded[name].predict(texts.tolist())], columns=["lang_pred", "score"])

    out = df.withColumn("_language", once(run)(text_or_empty(text_col)))
    return out.withColumns({"lang_pred": F.col("_language.lang_pred"), "score": F.col("_language.score")}).drop("_language")


def train(docs: DataFrame) -> Identifier:
    return Identifier.train(training_rows(docs))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_batches(spark)
    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(~held_out()).select("doc_id", "text", "lang"))
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")
