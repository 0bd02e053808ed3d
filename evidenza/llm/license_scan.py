"""Licence scans by a generalised suffix automaton of licence tokens.

The automaton of all template texts is built once per worker. A document's words stream through it
and give matching statistics: at each word the longest stretch ending there that stands somewhere
in a template. Maximal stretches of at least MIN_MATCH words are chained, per template, in the order
of the template with at most MAX_GAP foreign words between them; a chain that covers enough of its
template becomes a span. Stretches of a document without MIN_MATCH consecutive words of any
template cannot hold such a match and are passed over at once; every other word is streamed.

Fixed phrases are counted besides, over all words; their labels always stand.

Defined cases: null text counts as empty (no words, no labels, score 0); an empty table gives an
empty result; repeated rows give repeated rows; ties between chains go to the earlier start, then to
the template listed first; other columns are kept, those with an output's name replaced.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import arrow_batches, once, table, text_or_empty
from .license_templates import TEMPLATES

PHRASES = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}
MIN_MATCH, MAX_GAP, COVERAGE = 4, 6, 0.75
#: Words of a chain that suffice whatever share of a long template they are.
ENOUGH_WORDS = 25
#: All bytes that part words are mapped to a space, A-Z to a-z; bytes from 0x80 on belong to words.
FOLD = bytes(32 if i < 0x30 or 0x3A <= i <= 0x40 or 0x5B <= i <= 0x60 or 0x7B <= i <= 0x7F else i + 32 if 0x41 <= i <= 0x5A else i for i in range(256))


def fold_words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split()


class SuffixAutomaton:
    """All substrings of several token sequences; a state knows all its end positions in each sequence that holds it."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[dict[int, set[int]]] = [{}]
        for k, sequence in enumerate(sequences):
            last = 0
            for at, token in enumerate(sequence):
                last = self._extend(last, token)
                self.ends[last].setdefault(k, set()).add(at)
        for state in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            for k, places in self.ends[state].items():
                self.ends[self.link[state]].setdefault(k, set()).update(places)
        self.ends = [{k: sorted(places) for k, places in found.items()} for found in self.ends]

    def _new(self, length: int, link: int, follow: dict[int, int]) -> int:
        self.next.append(follow)
        self.link.append(link)
        self.length.append(length)
        self.ends.append({})
        return len(self.link) - 1

    def _split(self, state: int, target: int, token: int) -> int:
        """The state for the longest string of `state` and `token`, apart from longer ones that `target` holds too."""
        if self.length[target] == self.length[state] + 1:
            return target
        clone = self._new(self.length[state] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = clone
        while state >= 0 and self.next[state].get(token) == target:
            self.next[state][token] = clone
            state = self.link[state]
        return clone

    def _extend(self, last: int, token: int) -> int:
        if token in self.next[last]:
            return self._split(last, self.next[last][token], token)
        state, new = last, self._new(self.length[last] + 1, 0, {})
        while state >= 0 and token not in self.next[state]:
            self.next[state][token] = new
            state = self.link[state]
        if state >= 0:
            self.link[new] = self._split(state, self.next[state][token], token)
        return new

    def statistics(self, tokens) -> Iterator[tuple[int, int]]:
        """For each token the state and the length of the longest match that ends with it."""
        state, length = 0, 0
        for token in tokens:
            while state and token not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if token in self.next[state]:
                state, length = self.next[state][token], length + 1
            yield state, length


class Scanner:
    def __init__(self, templates: dict[str, list[str]], phrases: dict[str, str]):
        texts = [(label, fold_words(t)) for label, found in templates.items() for t in found]
        self.labels = [label for label, _ in texts]
        self.sizes = [len(words) for _, words in texts]
        spoken = [w for _, words in texts for w in words] + [w for p in phrases.values() for w in fold_words(p)]
        self.vocabulary = {w: i for i, w in enumerate(dict.fromkeys(spoken))}
        sequences = [[self.vocabulary[w] for w in words] for _, words in texts]
        self.automaton = SuffixAutomaton(sequences)
        self.phrases = [(label, [self.vocabulary[w] for w in fold_words(p)]) for label, p in phrases.items()]
        self.grams = np.unique([self._code(np.array(s[i : i + MIN_MATCH]))[0] for s in sequences for i in range(len(s) - MIN_MATCH + 1)])

    @staticmethod
    def _code(ids: np.ndarray) -> np.ndarray:
        """Hashes of the stretches of MIN_MATCH words; equal ones are only a hint that the automaton then follows."""
        n = len(ids) - MIN_MATCH + 1
        code = np.zeros(max(n, 0), "u8")
        for k in range(MIN_MATCH if n > 0 else 0):
            code = code * np.uint64(0x9E3779B97F4A7C15) + (ids[k : k + n] + 1).astype("u8")
        return code

    def scan(self, text: str) -> tuple:
        words = fold_words(text)
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), "int64", len(words))
        places, found = [], set()
        for label, phrase in self.phrases:
            n = len(ids) - len(phrase) + 1
            if n > 0:
                hit = np.flatnonzero(np.logical_and.reduce([ids[k : k + n] == w for k, w in enumerate(phrase)]))
                if len(hit):
                    places.append(hit)
                    found.add(label)
        at = np.concatenate(places) if places else np.zeros(0, "int64")
        spans = self._spans(ids)
        return len(words), len(at), int(at.min()) if len(at) else None, int(at.max()) if len(at) else None, sorted(found), *([s[k] for s in spans] for k in range(4))

    def _spans(self, ids: np.ndarray) -> list[tuple[str, int, int, float]]:
        code = self._code(ids)
        if not len(code):
            return []
        near = np.minimum(np.searchsorted(self.grams, code), len(self.grams) - 1)
        hits = np.flatnonzero(self.grams[near] == code)
        chains: dict[int, list[list[int]]] = {}
        done = -1
        for hit in hits.tolist():
            if hit <= done:
                continue
            start, end = hit, hit + MIN_MATCH
            while start > 0 and ids[start - 1] >= 0 and start - 1 > done:
                start -= 1
            while end < len(ids) and ids[end] >= 0:
                end += 1
            done = end
            before = (0, 0)
            for k, (state, length) in enumerate([*self.automaton.statistics(ids[start:end].tolist()), (0, 0)]):
                if before[1] >= MIN_MATCH and length != before[1] + 1:
                    self._chain(chains, start + k - before[1], start + k, before[0])
                before = (state, length)
        out = []
        for k, own in chains.items():
            for first, last, covered, _, _ in own:
                share = min(1.0, covered / self.sizes[k])
                if share >= COVERAGE or covered >= ENOUGH_WORDS:
                    out.append((self.labels[k], first, last, share))
        return sorted(out, key=lambda s: (s[1], s[2], s[0]))

    def _chain(self, chains: dict, first: int, end: int, state: int) -> None:
        """Join a maximal match to the chain of each template that holds it, at its next place there, or begin one."""
        for k, places in self.automaton.ends[state].items():
            own = chains.setdefault(k, [])
            later = bisect.bisect_right(places, own[-1][3]) if own else 0
            at = places[later] if later < len(places) else places[0]
            if own and first - own[-1][4] <= MAX_GAP and later < len(places):
                new = end - max(first, own[-1][4])
                own[-1][1:] = [end - 1, own[-1][2] + max(new, 0), at, end]
            else:
                own.append([first, end - 1, end - first, at, end])



def scan(df: DataFrame, text_col: str = "text", templates: dict | None = None, phrases: dict | None = None) -> DataFrame:
    """`df` with n_words, n_base, first_word, last_word, base_labels and spans (label, first_word, last_word, coverage)."""
    given = templates or TEMPLATES, phrases or PHRASES
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "span_label", "span_first", "span_last", "span_coverage"]

    @F.pandas_udf("n_words long, n_base long, first_word long, last_word long, base_labels array<string>, span_label array<string>, span_first array<long>, span_last array<long>, span_coverage array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(*given)
        for texts in batches:
            found = pd.DataFrame([scanner.scan(t) for t in texts], columns=names)
            yield found.astype({"first_word": "Int64", "last_word": "Int64"})

    spans = F.arrays_zip(F.col("_scan.span_label").alias("label"), F.col("_scan.span_first").alias("first_word"), F.col("_scan.span_last").alias("last_word"), F.col("_scan.span_coverage").alias("coverage"))
    out = df.withColumn("_scan", once(run)(text_or_empty(text_col)))
    return out.withColumns({**{n: F.col(f"_scan.{n}") for n in names[:5]}, "spans": spans}).drop("_scan")


def _joined(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_batches(spark)
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    coverage = F.array_max(F.transform("spans", lambda s: s["coverage"]))
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        _joined(F.col("base_labels")).alias("base_labels"),
        _joined(F.concat("base_labels", F.transform("spans", lambda s: s["label"]))).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce(coverage, F.lit(0.0))).alias("score"),
    )
