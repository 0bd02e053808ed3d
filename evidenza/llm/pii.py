"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

The fixed patterns (e-mail, IP address, card, phone) are found in linear time over the whole text.
The random field is trained from a small labelled table (`labelled_sentences`) and decoded by Viterbi
in numpy batches. Only words with a digit, an at or equals sign, the prefix of a key, or LONG characters can
begin or carry what it knows, so it reads stretches of such words with REACH words of context on either
side; all others are outside by construction. Secrets need no digit, all other kinds need one or an at
sign, and a card a valid check digit. What it adds never overlaps a fixed match. Stretches of more than PIECE
words are decoded in pieces that overlap by 2 * MARGIN words, of which each keeps the half next to it, so
memory does not follow the longest text. The weights are trained once on the driver and broadcast (6 MB).

Defined cases: null text counts as empty and has no spans; an empty table gives an empty result;
repeated rows give repeated rows; at equal starts spans are ordered by kind as listed in KINDS;
other columns are kept, those with an output's name replaced. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import arrow_batches, once, table, text_or_empty
from .crf import ChainCRF
from .memo import Memo

KINDS = ("email", "ip", "card", "phone", "secret")
REACH, LONG = 3, 20
#: Words of a stretch that are decoded together, words of context around a piece, words decoded in one batch.
PIECE, MARGIN, BATCH = 2048, 32, 1 << 16

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
CLUE = re.compile(r"[0-9@]")
#: What the random field looks at: also secrets without a digit.
HINT = re.compile(rf"[0-9@=]|\S{{{LONG}}}|AKIA|ghp_|sk-|xox[a-z]-")
WORD = re.compile(r"\S+")

Span = tuple[int, int, str]


def luhn(digits: str | list[str]) -> bool:
    total = sum(int(d) if i % 2 == 0 else (2 * int(d) - 9 if int(d) > 4 else 2 * int(d)) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def fixed_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind. The part before an at sign is read backwards from it."""
    out: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end(), "email"))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    if not CLUE.search(text):
        return out
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:4] or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def shape(word: str) -> str:
    """Letters to X and x, digits to 9, runs over three shortened."""
    mapped = "".join("9" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else c for c in word[:60])
    return re.sub(r"(.)\1{3,}", r"\1\1\1+", mapped)


def word_features(word: str) -> list[str]:
    """Of the shape of a word, not of its letters; `^` and `$` mark neighbours, see `Detector`."""
    mark, w = (word[0], word[1:]) if word[:1] in "\x01\x02" else ("", word)
    core = w.strip("\"'.,;:!?()[]{}#$%&*<>")
    n, digits, letters = len(core), sum(map(str.isdigit, core)), sum(map(str.isalpha, core))
    hexed = n >= 8 and all(c in "0123456789abcdefABCDEF" for c in core) and digits and letters
    parts = core.split(".")
    out = [
        "bias", f"sh{shape(core)}", f"n{min(n, 24)}", f"d{min(digits, 20)}", f"l{min(letters, 12)}", f"dots{min(core.count('.'), 5)}", f"hyphen{min(core.count('-'), 4)}",
        f"dd{min(digits, 20)}_{min(n, 24)}", f"plus{w[:1] == '+'}", f"par{w[:1] == '('}{w[-1:] == ')'}", f"at{'@' in core}", f"eq{'=' in core}", f"hex{bool(hexed)}_{n >= 16}",
        f"mix{bool(digits and letters)}_{n >= 16}", f"quad{len(parts) == 4 and all(p.isdigit() and len(p) <= 3 for p in parts)}", f"first{core[:1]}" if not letters else f"up{core[:4].isupper()}_{n >= 16}",
    ]
    if digits == 0 and len(w) <= 10:
        out.append(f"w{w.lower().strip(':=')}")
    if 12 <= digits <= 19 and digits == sum(c not in " -./" for c in core):
        out.append(f"luhn{luhn([c for c in core if c.isdigit()])}")
    if "=" in core:
        out.append(f"key{core.partition('=')[0].lower()}")
    if digits == 0 and n >= 12:
        turns = sum(a.islower() and b.isupper() for a, b in zip(core, core[1:]))
        out += [f"pre{core[:4]}", f"turns{min(turns, 4)}"]
    return [mark + f for f in out]


class Detector:
    """The random field. A word's features are its own and, marked, those of the words before and after."""

    LABELS = ["O", *(f"{edge}-{kind}" for kind in KINDS for edge in "BI")]

    def __init__(self, weights: np.ndarray | None = None, moves: np.ndarray | None = None, rounds: int = 60):
        """With the given weights, or with such as are trained here."""
        self.crf = ChainCRF(self.LABELS, lambda triple: [*word_features(triple[1]), *word_features("\x01" + triple[0])[:9], *word_features("\x02" + triple[2])[:9]], rows=1 << 16)
        if weights is None:
            self.crf.fit([(self.context(words), [self.LABELS.index(x) for x in labels]) for words, labels in labelled_sentences()], rounds=rounds)
        else:
            self.crf.weights, self.crf.moves = weights, moves
        self.memo = Memo(lambda triples: [row.tobytes() for row in self.crf.scores(triples)], 100_000)

    @staticmethod
    def context(words: list[str]) -> list[tuple[str, str, str]]:
        return list(zip(["", *words[:-1]], words, [*words[1:], ""], strict=True))

    def windows(self, text: str) -> Iterator[tuple[list[tuple[int, int]], int, int]]:
        """Stretches of words near words with a hint, in pieces: the words, and which of them count."""
        held: list[tuple[int, int]] = []  # the words of an open stretch, or the last REACH words
        until, first, i = 0, 0, -1  # a stretch ends before the word `until` if no hint follows within REACH words
        for i, m in enumerate(WORD.finditer(text)):
            held.append(m.span())
            if HINT.search(text, *m.span()):
                until = i + REACH + 1
            if not until or i > until + REACH:
                del held[:-REACH]
            elif i == until + REACH:
                n = len(held) - REACH - 1
                yield held[:n], first, n
                held, first = held[n + 1 :], 0
            elif len(held) - first >= PIECE:
                yield held, first, len(held) - MARGIN
                held, first = held[-2 * MARGIN :], MARGIN
        n = len(held) - max(0, i + 1 - until)
        if until and i < until + REACH and n > first:
            yield held[:n], first, n

    def spans(self, texts: list[str]) -> list[list[Span]]:
        labelled: list[list[tuple[list[tuple[int, int]], list[str]]]] = [[] for _ in texts]
        waiting, size = [], 0

        def decode() -> None:
            triples = [self.context([texts[i][a:b] for a, b in w]) for i, w, _, _ in waiting]
            get = self.memo.of(triples).__getitem__
            emit = np.frombuffer(b"".join(b"".join(map(get, window)) for window in triples)).reshape(-1, len(self.LABELS))
            best, at = self.crf.viterbi(emit, np.array([len(w) for _, w, _, _ in waiting])).tolist(), 0
            for i, w, first, last in waiting:
                labelled[i].append((w[first:last], [self.LABELS[x] for x in best[at + first : at + last]]))
                at += len(w)
            waiting.clear()

        for i, text in enumerate(texts):
            for w, first, last in self.windows(text) if HINT.search(text) else ():
                waiting.append((i, w, first, last))
                size += len(w)
                if size >= BATCH:
                    decode()
                    size = 0
        if waiting:
            decode()
        return [[s for words, labels in parts for s in self._merge(text, words, labels)] for text, parts in zip(texts, labelled, strict=True)]

    @staticmethod
    def _merge(text: str, words: list[tuple[int, int]], labels: list[str]) -> list[Span]:
        out: list[Span] = []
        for (a, b), label in zip(words, labels, strict=True):
            if label == "O":
                continue
            kind, last = label[2:], out[-1] if out else None
            if label[0] == "I" and last and last[2] == kind and not text[last[1] : a].strip("\"'.,;:!?#$%&* \t\r\n"):
                out[-1] = (last[0], b, kind)
            else:
                out.append((a, b, kind))
        trimmed = []
        for a, b, kind in out:  # punctuation around does not belong
            while a < b and text[a] in "\"'.,;:!?[]{}#$%&*<>" or (kind != "phone" and a < b and text[a] in "()"):
                a += 1
            while a < b and (text[b - 1] in "\"'.,;:!?[]{}#$%&*<>(" or (kind != "phone" and text[b - 1] == ")")):
                b -= 1
            if kind == "secret" and "=" in text[a:b] and text[a:b].index("=") < b - a - 1:
                a += text[a:b].index("=") + 1
            bare = kind == "secret" and text[b - 1] != "=" and any(c.isalpha() for c in text[a:b])
            digits = [c for c in text[a:b] if "0" <= c <= "9"]
            sound = kind != "card" or (12 <= len(digits) <= 19 and luhn(digits))
            if a < b and sound and (bare or any(c.isdigit() or c == "@" for c in text[a:b])):
                trimmed.append((a, b, kind))
        return trimmed


def labelled_sentences(rows: int = 900, seed: int = 11) -> list[tuple[list[str], list[str]]]:
    """The labelled table: short sentences with data of each kind, and with numbers that are none."""
    r = np.random.default_rng(seed)
    digits = lambda n: "".join(map(str, r.integers(0, 10, n)))
    pick = lambda options: options[int(r.integers(len(options)))]
    letters = lambda n: "".join(pick("abcdefghijklmnopqrstuvwxyzéüñ") for _ in range(n))
    plain = lambda: pick([letters(int(r.integers(1, 12))), letters(int(r.integers(1, 8))).capitalize(), letters(4) + ",", letters(6) + "."])
    code = lambda n, chars: "".join(pick(chars) for _ in range(n))
    hexed, base = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

    def email():
        return [pick(["", letters(5) + "."]) + code(int(r.integers(3, 9)), "abcdefghij") + digits(2) + "@" + pick(["mail", "host"]) + digits(1) + ".example." + pick(["com", "org", "net"])]

    def secret():
        kind = int(r.integers(5))
        if kind == 0:
            return ["AKIA" + code(16, base)]
        if kind == 1:
            return [pick(["password=", "secret=", "api_key=", "passwd="]) + code(int(r.integers(12, 32)), hexed)]
        if kind == 2:
            return ['"' + code(int(r.integers(24, 48)), hexed) + '"']
        return [pick(["ghp_", "sk-", "xoxb-", ""]) + code(int(r.integers(24, 40)), hexed + "ghijklmnopqrstuvwxyzABCDEFGHIJ")] if kind == 3 else [code(40, hexed)]

    def phone():
        kind, a, b, c = int(r.integers(5)), digits(3), digits(3), digits(4)
        return [[f"+{digits(1)}", f"({a})", f"{b}-{c}"], [f"+{digits(1)}-{a}-{b}-{c}"], [f"({a})", f"{b}-{c}"], [f"{a}-{b}-{c}"], [f"+{digits(2)}", digits(3), digits(3), digits(4)]][kind]

    def number(valid: bool):
        whole = pick("3456") + digits(14)
        return whole + next(d for d in (digits(1) for _ in range(1000)) if luhn(whole + d) == valid)

    def card():
        whole = number(True)
        return [[whole], ["-".join(whole[i : i + 4] for i in range(0, 16, 4))], [whole[i : i + 4] for i in range(0, 16, 4)]][int(r.integers(3))]

    def ip():
        return [".".join(str(x) for x in r.integers(1, 256, 4))]

    def none():
        year = str(int(r.integers(1900, 2100)))
        return pick([[year + pick(["", ".", ","])], [f"{year}-{digits(2)}-{digits(2)}"], [digits(int(r.integers(1, 10)))], [f"v{digits(1)}.{digits(1)}.{digits(1)}"], [f"{digits(1)}.{digits(1)}."], ["Version", "2.0."], ["CC", "BY-NC", "4.0."],
                     [f"{digits(2)}:{digits(2)}"], [f"{digits(1)},{digits(3)}"], [f"${digits(2)}.{digits(2)}"], [f"{digits(2)}%"], [f"#{digits(3)}"], [letters(5) + digits(2)], [f"{digits(2)}/{digits(2)}/{year}"], ["version", "3."], [f"({digits(1)})"], [f"{digits(1)}th"], [f"{letters(1).upper()}{digits(2)}"], ["page", digits(3)], ["@", letters(4)], ["@" + letters(6)], [number(False)], [digits(int(r.integers(11, 24)))[:11]]])

    kinds = {"email": email, "secret": secret, "phone": phone, "card": card, "ip": ip}
    out = []
    for _ in range(rows):
        words, labels = [], []
        for _ in range(int(r.integers(1, 4))):
            for _ in range(int(r.integers(0, 4))):
                words.append(plain())
                labels.append("O")
            name = pick([*kinds, "none", "none", "none"])
            found = none() if name == "none" else kinds[name]()
            if name == "secret" and found[0][0] == '"':
                words += [pick(["token", "key", "secret"]), "="]
                labels += ["O", "O"]
            if name != "none" and r.random() < 0.3:
                found = [*found[:-1], found[-1] + pick([".", ",", "###", "$$$", "&&&", "***", "%%%", "!!"])]
            words += found
            labels += ["O"] * len(found) if name == "none" else [("I-" if k else "B-") + name for k in range(len(found))]
        for _ in range(int(r.integers(0, 4))):
            words.append(plain())
            labels.append("O")
        out.append((words, labels))
    return out + undigited_sentences()


def undigited_sentences(rows: int = 400, seed: int = 12) -> list[tuple[list[str], list[str]]]:
    """More of the table: secrets without digits, and long or assigned words that are none."""
    r = np.random.default_rng(seed)
    pick = lambda options: options[int(r.integers(len(options)))]
    code = lambda a, b, chars: "".join(pick(chars) for _ in range(int(r.integers(a, b))))
    lower = "abcdefghijklmnopqrstuvwxyz"
    both = lower + lower.upper()
    plain = lambda: pick([code(1, 12, lower), code(1, 9, lower).capitalize(), code(4, 5, lower) + ",", code(6, 7, lower) + "."])
    name = lambda: code(2, 9, lower)

    def secret():
        return pick([lambda: "AKIA" + code(16, 17, lower.upper()), lambda: pick(["password=", "secret=", "api_key=", "passwd="]) + code(8, 32, pick([lower, both])), lambda: pick(["ghp_", "sk-", "xoxb-"]) + code(24, 40, both)])()

    def none():
        return pick([
            lambda: f"{pick(['class', 'lang', 'name', 'type', 'id', 'x', 'mode', name()])}={code(1, 20, lower)}", lambda: code(12, 36, lower) + pick(["", ",", "."]), lambda: code(12, 30, lower).capitalize() + pick(["", ",", "."]), *[lambda: code(12, 28, lower.upper()), lambda: code(20, 21, lower.upper())] * 2, lambda: "-".join(name() for _ in range(int(r.integers(2, 5)))),
            lambda: "_".join(name() for _ in range(int(r.integers(2, 5)))), lambda: name() + "".join(name().capitalize() for _ in range(int(r.integers(1, 4)))), lambda: f"https://www.{name()}.org/" + "/".join(name() for _ in range(int(r.integers(0, 3)))), lambda: "/".join(name() for _ in range(int(r.integers(3, 6)))), lambda: "=", lambda: pick("=-_*.#") * int(r.integers(12, 30)), lambda: pick(["password", "secret", "token", "key"]),
        ])()

    out = []
    for _ in range(rows):
        words, labels = [], []
        for _ in range(int(r.integers(1, 4))):
            before, hidden = [plain() for _ in range(int(r.integers(0, 4)))], r.random() < 0.35
            words += [*before, secret() + pick(["", "", ".", ","]) if hidden else none()]
            labels += ["O"] * len(before) + ["B-secret" if hidden else "O"]
        out.append((words, labels))
    return out


_trained: list[Detector] = []
_loaded: dict[str, Detector] = {}


def detector() -> Detector:
    """The detector of this process, trained when first asked for."""
    if not _trained:
        _trained.append(Detector())
    return _trained[0]


def sent_detector(spark: SparkSession):
    """A function that gives a worker its detector: the weights come from the driver."""
    crf = detector().crf
    sent, name = spark.sparkContext.broadcast((crf.weights, crf.moves)), zlib.crc32(crf.weights.tobytes()).to_bytes(4).hex()

    def get() -> Detector:
        if name not in _loaded:
            _loaded.clear()
            _loaded[name] = Detector(*sent.value)
        return _loaded[name]

    return get


def all_spans(texts: list[str], using: Detector | None = None) -> Iterator[tuple[list[Span], list[Span]]]:
    """Of each text the fixed matches, and those with what the random field adds."""
    for text, more in zip(texts, (using or detector()).spans(texts), strict=True):
        base = fixed_spans(text)
        taken = sorted((a, b) for a, b, _ in base)
        starts = [a for a, _ in taken]
        reach = np.maximum.accumulate([b for _, b in taken]).tolist() if taken else []
        added = []
        for a, b, kind in more:
            i = np.searchsorted(starts, b)  # those that begin before this one's end
            if not i or reach[i - 1] <= a:
                added.append((a, b, kind))
        yield base, sorted(base + added, key=lambda s: (s[0], KINDS.index(s[2])))


def written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def find(df: DataFrame, text_col: str = "text") -> DataFrame:
    """`df` with n_email, n_ip, n_card, n_phone and base_spans of the fixed patterns, n_spans and spans of all that was found."""
    get = sent_detector(df.sparkSession)

    @F.pandas_udf("n_email long, n_ip long, n_card long, n_phone long, base_spans string, n_spans long, spans string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for base, spans in all_spans(texts.tolist(), get()):
                kinds = [k for _, _, k in base]
                rows.append((*(kinds.count(k) for k in KINDS[:4]), written(base), len(spans), written(spans)))
            yield pd.DataFrame(rows, columns=names)

    names = ["n_email", "n_ip", "n_card", "n_phone", "base_spans", "n_spans", "spans"]
    out = df.withColumn("_pii", once(run)(text_or_empty(text_col)))
    return out.withColumns({n: F.col(f"_pii.{n}") for n in names}).drop("_pii")


def mask(text: str, spans: list[Span]) -> str:
    """The text with each span, or stretch of overlapping spans, replaced by the name of its first kind."""
    out, at, until = [], 0, -1
    for a, b, kind in spans:
        if a >= until:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = until = max(until, b)
    return "".join([*out, text[at:]])


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """`df` with all personal data of `text_col` masked; null text stays null."""
    get = sent_detector(df.sparkSession)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            given = texts.tolist()
            yield pd.Series([mask(t, spans) if spans else t for t, (_, spans) in zip(given, all_spans(given, get()), strict=True)], dtype=object)

    masked = once(run)(text_or_empty(text_col))
    return df.withColumn(text_col, F.when(F.col(text_col).isNotNull(), masked))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_batches(spark)
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_spans")
