"""Best-fit packing of token sequences by linear grouping.

Lengths are at most the capacity, so their histogram is bounded whatever the corpus; it alone goes
to the driver, where the plan is made. Lengths above an eighth of the capacity are large: sorted,
they form groups of equal cardinality, each rounded up to its largest length. Few sizes remain, at
most seven to a sequence, and a linear programme over configurations of them is solved by column
generation; its whole parts become sequences. Actual documents take the places of rounded ones,
what remains of large ones and all small ones go in longest first, each to the fullest sequence
that still takes it (best fit). Places are kept as runs of sequences with equal room, so the plan
grows with the number of distinct lengths, not of documents.

Documents are matched with places by their rank among those of equal length. Ranks are counted in
hash buckets of bounded share, then shifted by the counts of the buckets before, so no length,
however common, is gathered in one task.

Defined cases: null text is empty and packs as its end id alone; an empty table gives an empty
result; repeated rows are packed each; ties are broken by doc_id, piece and start; other columns
of the pieces are kept, and a column with an output's name is replaced.
"""

from __future__ import annotations

import bisect
import json
import os
import re
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import Scratch, arrow_batches, once, table, text_or_empty
from .memo import Memo, groups_by_chars

CAPACITY, END_ID = 4096, 1
#: Numbers of groups that are tried; the plan of fewest sequences is kept.
GROUPS = (8, 12, 16, 24, 32)
#: Rows of equal length that one task ranks, about.
BUCKET_ROWS = 1 << 20
_loaded: dict[str, "WordIds"] = {}


class WordIds:
    """Ids of a tokenizers file, of whole texts.

    Where the file's rules are those below, a text of plain Latin-1 characters is lower-cased and cut into
    pre-tokens here, and each distinct one goes to the BPE model once; such characters are their own NFC
    form. Without apostrophes the cuts lie where the class of the character changes, so many texts are cut
    and their pre-tokens told apart in numpy. All other texts, and all texts where a file has other rules,
    go through the whole tokenizer.
    """

    #: Fixed rules of the file that are followed here.
    RULES = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
    STEPS = ["NFC", "Replace", "Lowercase"]
    CUT = re.compile("[a-zß-öø-ÿ]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^\\sa-zß-öø-ÿ0-9]+")
    ODD = re.compile("[^\t\n\r -~À-ÿ]")

    #: Classes of lower-case Latin-1 characters: 0 white space, 1 letter, 2 digit, 3 other.
    CLASS = np.array([0 if chr(c) in "\t\n\r " else 1 if chr(c).isalpha() and c not in (0xAA, 0xB5, 0xBA) else 2 if 48 <= c <= 57 else 3 for c in range(256)], "u1")
    #: Characters of the longest pre-token that is told apart in numpy.
    LONGEST = 512

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        cuts = (rules["pre_tokenizer"] or {}).get("pretokenizers", [])
        steps = [n["type"] for n in (rules["normalizer"] or {}).get("normalizers", [])]
        cut = len(cuts) == 2 and cuts[0].get("pattern") == {"Regex": self.RULES} and cuts[0]["behavior"] == "Removed" and cuts[0]["invert"]
        self.known_rules = cut and cuts[1]["type"] == "ByteLevel" and not cuts[1]["add_prefix_space"] and not cuts[1]["use_regex"] and steps == self.STEPS
        self.added = [t["content"] for t in rules["added_tokens"]]
        self.letters = str.maketrans({chr(c): "".join(map(self._byte, chr(c).encode())) for c in range(0xC0, 0x100)})
        self.memo = Memo(self._pretokens, unload=_loaded.clear)

    @staticmethod
    def _byte(b: int) -> str:
        """The printable character that stands for a byte in byte-level vocabularies."""
        own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        return chr(b) if b in own else chr(256 + b - sum(x < b for x in own))

    def _pretokens(self, parts: list[str]) -> list[bytes]:
        tokenize, letters = self.model.model.tokenize, self.letters
        return [array("I", [t.id for t in tokenize(p if p.isascii() else p.translate(letters))]).tobytes() for p in parts]

    def plain(self, text: str) -> bool:
        return self.known_rules and not self.ODD.search(text) and not any(a in text for a in self.added)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _cut(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the pre-tokens of lower-case text without apostrophes."""
        kind = np.concatenate([[0], self.CLASS[np.frombuffer(raw, "u1")], [0]])
        change = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        starts = np.flatnonzero(change & (kind[1:] != 0))
        ends = np.flatnonzero((change | (kind[:-1] == 2)) & (kind[:-1] != 0))
        return starts, ends

    @staticmethod
    def _distinct(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """First place of each distinct pre-token, and for each pre-token its number among them; None if hashes clash."""
        words = np.ndarray(len(raw), "<u8", raw + bytes(8), strides=(1,))  # eight characters from each place on
        size = ends - starts
        keep = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], "u8")
        parts = [words[starts] & keep[np.minimum(size, 8)]]
        mix = lambda h: ((h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)) ^ (h >> np.uint64(29))
        hashed, at, more = mix(parts[0] + size.astype("u8") * np.uint64(0xC2B2AE3D27D4EB4F)), 8, np.flatnonzero(size > 8)
        while len(more):
            part = words[starts[more] + at] & keep[np.minimum(size[more] - at, 8)]
            if at == 8:
                parts.append(np.zeros_like(parts[0]))
                parts[1][more] = part
            hashed[more] = mix(hashed[more] * np.uint64(0x165667B19E3779F9) + part)
            at += 8
            more = more[size[more] > at]
        order = np.argsort(hashed)
        new = np.concatenate([[True], hashed[order[1:]] != hashed[order[:-1]]])
        first, number = order[new], np.empty(len(order), "int64")
        number[order] = np.cumsum(new) - 1
        same = all((x[first][number] == x).all() for x in (size, *parts))
        return (first, number) if same else None

    def _many(self, texts: list[str]) -> list[bytes] | None:
        """Ids of plain texts without apostrophes, all at once; None where that is not safe."""
        raw = "\n".join(texts).lower().encode("latin-1")
        starts, ends = self._cut(raw)
        if not len(starts):
            return [b""] * len(texts)
        found = self._distinct(raw, starts, ends) if (ends - starts).max() <= self.LONGEST else None
        if found is None:
            return None
        first, number = found
        names = [raw[a:b].decode("latin-1") for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        known = self.memo.of([names])
        values = [known[n] for n in names]
        ids, sizes = np.frombuffer(b"".join(values), "<u4"), np.array([len(v) // 4 for v in values])
        begin = (np.cumsum(sizes) - sizes).astype("int32")
        count = sizes[number].astype("int32")
        upto = np.cumsum(count, dtype="int32")  # a group's ids are far fewer than 2^31
        out = ids[np.repeat(begin[number] - upto + count, count) + np.arange(upto[-1], dtype="int32")]
        cuts = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))
        ends_of = np.concatenate([[0], upto])[cuts].tolist()
        return [out[a:b].tobytes() for a, b in zip([0, *ends_of[:-1]], ends_of, strict=True)]

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        for group in groups_by_chars(texts):
            plain = [self.plain(t) for t in group]
            easy = [t for t, p in zip(group, plain, strict=True) if p and "'" not in t]
            many = self._many(easy)
            easy_ids = iter(many or [])
            split = [self.CUT.findall(t.lower()) if p and (many is None or "'" in t) else None for t, p in zip(group, plain, strict=True)]
            get = self.memo.of([parts for parts in split if parts]).__getitem__
            other = iter(self.whole([t for t, p in zip(group, plain, strict=True) if not p]))
            for t, p, parts in zip(group, plain, split, strict=True):
                yield next(other) if not p else b"".join(map(get, parts)) if parts is not None else next(easy_ids)


def word_ids(path: str) -> WordIds:
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    return _loaded[path]


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, text_col: str = "text") -> DataFrame:
    """One row per piece: the input's columns without the text, piece, start, length and ids (little-endian)."""

    @F.pandas_udf("array<binary>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode, step, end = word_ids(path), 4 * capacity, np.array([end_id], "<u4").tobytes()
        for texts in batches:
            whole = [ids + end for ids in encode(texts.tolist())]
            yield pd.Series([[ids[i : i + step] for i in range(0, len(ids), step)] for ids in whole], dtype=object)

    cut = once(cut)
    taken = {"piece", "start", "length", "ids", text_col}
    kept = [c for c in docs.columns if c not in taken]
    cuts = docs.select(*kept, cut(text_or_empty(text_col)).alias("cuts"))
    return cuts.select(*kept, F.posexplode("cuts").alias("piece", "ids")).select(
        *kept, "piece", (F.col("piece").cast("long") * capacity).alias("start"), (F.octet_length("ids") / 4).cast("long").alias("length"), "ids"
    )


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[np.ndarray, float]]:
    """Configurations of a few sizes and how often each is used: column generation on the covering programme."""
    k, s, need = len(sizes), np.array(sizes), np.array(demand, float)
    basis = np.diag(capacity // s).astype(float)
    most = capacity // int(s.min())
    for _ in range(20 * k):
        worth = np.linalg.solve(basis.T, np.ones(k))
        best, taken = np.zeros((most + 1, capacity + 1)), np.full((most + 1, capacity + 1), -1)
        for n in range(1, most + 1):
            best[n] = best[n - 1]
            for g in range(k):
                if worth[g] > 0:
                    more = best[n - 1][: capacity + 1 - s[g]] + worth[g]
                    better = more > best[n][s[g] :] + 1e-12
                    best[n][s[g] :][better] = more[better]
                    taken[n][s[g] :][better] = g
        if best[most][capacity] <= 1 + 1e-7:
            break
        column, n, room = np.zeros(k), most, capacity
        while n:
            if (g := taken[n][room]) >= 0:
                column[g] += 1
                room -= s[g]
            n -= 1
        use, per = np.linalg.solve(basis, need), np.linalg.solve(basis, column)
        ratio = np.where(per > 1e-9, np.maximum(use, 0) / np.where(per > 1e-9, per, 1), np.inf)
        basis[:, int(ratio.argmin())] = column
    use = np.linalg.solve(basis, need)
    return [(basis[:, j].astype(int), float(use[j])) for j in range(k)]


class Plan:
    """Places by length and rank: a run holds (length, first rank, ranks, per sequence, first sequence, offset)."""

    def __init__(self, counts: dict[int, int], capacity: int, groups: int):
        self.capacity, self.runs, self.sequences = capacity, [], 0
        self.left = dict(sorted(counts.items()))
        self.used: dict[int, int] = defaultdict(int)
        self.rooms: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.sorted_rooms: list[int] = []
        if self.left.get(capacity):
            self._open(capacity, self.left[capacity], 1)
        self._large(groups)
        self._best_fit()
        self.runs.sort()

    def _take(self, length: int, n: int, per: int, sequence: int, offset: int) -> None:
        self.runs.append((length, self.used[length], n, per, sequence, offset))
        self.used[length] += n
        self.left[length] -= n

    def _room(self, room: int, sequence: int, n: int) -> None:
        if room > 0 and n > 0:
            if not self.rooms[room]:
                bisect.insort(self.sorted_rooms, room)
            self.rooms[room].append((sequence, n))

    def _open(self, length: int, n: int, per: int) -> None:
        """n documents into new sequences, `per` to each, fewer in the last."""
        full, rest = divmod(n, per)
        for bins, each in ((full, per), (1, rest)):
            if bins and each:
                self._take(length, bins * each, each, self.sequences, 0)
                self._room(self.capacity - each * length, self.sequences, bins)
                self.sequences += bins

    def _large(self, groups: int) -> None:
        lengths = [x for x in sorted(self.left, reverse=True) if self.capacity // 8 < x < self.capacity and self.left[x]]
        total = sum(self.left[x] for x in lengths)
        if not total:
            return
        queues: list[list[list[int]]] = [[]]
        share, held = -(-total // groups), 0
        for x in lengths:
            todo = self.left[x]
            while todo:
                if held == share:
                    queues.append([])
                    held = 0
                n = min(todo, share - held)
                queues[-1].append([x, n])
                todo, held = todo - n, held + n
        sizes = [q[0][0] for q in queues]
        found = configurations(sizes, [sum(n for _, n in q) for q in queues], self.capacity)
        for column, times in sorted(found, key=lambda f: (-f[1], f[0].tolist())):
            times = int(times + 1e-6)
            slots = [g for g, n in enumerate(column) for _ in range(n)]
            times = min([times, *(sum(n for _, n in queues[g]) // column[g] for g in set(slots))])
            if times <= 0 or not slots:
                continue
            filled = [self._draw(queues[g], times) for g in slots]
            start = 0
            while start < times:  # runs of sequences whose documents have the same lengths
                n = min(run[0][1] for run in filled)
                offset = 0
                for run in filled:
                    self._take(run[0][0], n, 1, self.sequences + start, offset)
                    offset += run[0][0]
                    run[0][1] -= n
                    if not run[0][1]:
                        run.pop(0)
                self._room(self.capacity - offset, self.sequences + start, n)
                start += n
            self.sequences += times

    @staticmethod
    def _draw(queue: list[list[int]], n: int) -> list[list[int]]:
        out = []
        while n:
            x, have = queue[0]
            take = min(have, n)
            out.append([x, take])
            n -= take
            queue[0][1] -= take
            if not queue[0][1]:
                queue.pop(0)
        return out

    def _best_fit(self) -> None:
        for length in sorted(self.left, reverse=True):
            while self.left[length]:
                at = bisect.bisect_left(self.sorted_rooms, length)
                if at == len(self.sorted_rooms):
                    self._open(length, self.left[length], self.capacity // length)
                    break
                room = self.sorted_rooms[at]
                sequence, bins = self.rooms[room].pop()
                if not self.rooms[room]:
                    self.sorted_rooms.pop(at)
                per, left = room // length, self.left[length]
                full = min(bins, left // per)
                if full:
                    self._take(length, full * per, per, sequence, self.capacity - room)
                    self._room(room - per * length, sequence, full)
                if full < bins:
                    if rest := min(left - full * per, per):
                        self._take(length, rest, rest, sequence + full, self.capacity - room)
                        self._room(room - rest * length, sequence + full, 1)
                        full += 1
                    self._room(room, sequence + full, bins - full)

    def arrays(self) -> tuple[np.ndarray, ...]:
        return tuple(np.array(x, "int64") for x in (zip(*self.runs, strict=True) if self.runs else [[]] * 6))


def pack(pieces: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ("doc_id", "piece", "start")) -> DataFrame:
    """`pieces` with sequence_id and offset. The pieces are written once to the shared folder."""
    spark = pieces.sparkSession
    scratch = Scratch(spark, "packing")
    pieces = scratch.save(pieces.drop("sequence_id", "offset"))
    counts = {int(r["length"]): int(r["count"]) for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    plan = min((Plan(counts, capacity, g) for g in GROUPS), key=lambda p: p.sequences)
    lengths, first, _, per, sequence, offset = plan.arrays()
    keys = lengths << 44 | first

    @F.pandas_udf("struct<sequence_id: long, offset: long>")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(keys, length.to_numpy("int64") << 44 | rank.to_numpy("int64"), "right") - 1
        past = rank.to_numpy("int64") - first[at]
        return pd.DataFrame({"sequence_id": sequence[at] + past // per[at], "offset": offset[at] + past % per[at] * length.to_numpy("int64")})

    place = once(place)
    buckets = max(1, -(-max(counts.values(), default=1) // BUCKET_ROWS)) * 8
    order = [c for c in order if c in pieces.columns]
    dealt = pieces.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shift = dealt.groupBy("length", "_bucket").count().withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    within = Window.partitionBy("length", "_bucket").orderBy(*order, *[c for c in ("ids_crc32",) if c in pieces.columns])
    ranked = dealt.withColumn("_rank", F.row_number().over(within) - 1).join(shift, ["length", "_bucket"])
    placed = ranked.withColumn("_place", place("length", (F.col("_rank") + F.col("_before")).cast("long")))
    return placed.select(*pieces.columns, F.col("_place.sequence_id").alias("sequence_id"), F.col("_place.offset").alias("offset"))


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents with their places and the checksum of their ids; the ids themselves come from `token_pieces`."""
    pieces = token_pieces(docs, path, capacity, end_id).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(pieces, capacity)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    arrow_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
