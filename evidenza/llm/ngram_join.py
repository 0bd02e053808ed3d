"""N-gram Jaccard join by grouped prefixes, for components of near copies.

A document's set holds the 64-bit hashes of its distinct word shingles. Sets are put in one order for
the whole corpus: by the size class of a count sketch over all documents, rare first, then by hash. Two
sets of similarity t share one of their first |x| - ceil(t|x|) + 1 elements, the prefix. The steps:

1. Equal sets become one; sets of equal prefix and size become one group, whose leader posts its prefix.
   Each set also has a bitmap of the parities of its hashed elements: two of these never differ in more
   bits than the sets in elements, so it rules out pairs inside a join, with no row made for them.
2. In each posting list, groups of like size are chained in a random order: neighbours are candidates.
   A hot cluster of k members gives k candidates to a list, not k squared, and still becomes connected.
   Lists that the sketch shows to be long are cut into several chains. Members are candidates with their leader.
3. Candidates pass if their bitmaps and prefixes still allow the similarity, and their whole sets reach it.
4. Lists whose groups are all of one component are settled. In the others each group outside the list's largest
   component meets all groups of other components, filtered by what all members of a group share: size, prefix
   and the bits that are alike in all their bitmaps. What passes expands to its members of different
   components, which are filtered by their own bitmaps and verified. No similar pair of different components
   is left out, so the components are exact; pairs within one need no look.

Sets are compared as 58 bits of 64-bit hashes: two different sets take a shingle of each other's for their own
with a chance of about |x||y| / 2^58, some 1e-12 for sets of 500.
Sets stand in no shuffle but those of candidates, made again from the text of these documents alone.
All sizes on the driver or in a broadcast are fixed: the sketch has 2^SKETCH_BITS counters.

Defined cases: null, empty or blank text has an empty set, linked with nothing; fewer words than a
shingle make one element of the whole sequence; rows that share a doc_id are one document (one
component); a null doc_id keeps its row, with a null component; ties go to the smaller doc_id; an empty
table gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import Scratch, arrow_batches, brief_shuffles, once, table, text_or_empty
from .components import components
from .memo import Memo

SKETCH_BITS, SLICES = 21, 1024
#: Binary logarithm of the groups of a chain, or 4 over that of the mean counter where this is more.
CHAIN = 16
BITMAP_WORDS = 8
BITS = [f"b{i}" for i in range(BITMAP_WORDS)]
#: Of a group the bits that all its members agree on.
ALIKE = [f"m{i}" for i in range(BITMAP_WORDS)]
#: Bytes of text that are hashed at once.
PART = 1 << 20
#: A-Z to a-z, what parts words to spaces.
FOLD = bytes(i + 32 if 0x41 <= i <= 0x5A else 32 if 9 <= i <= 13 else i for i in range(256))
BASE = 0x9E3779B97F4A7C15
SALTS = (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD)


def _mix(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(salt | 1)
    return h ^ (h >> np.uint64(29))


_powers: list[np.ndarray] = []


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        n = max(n, PART + (1 << 16))
        with np.errstate(over="ignore"):
            _powers[:] = [np.cumprod(np.full(n, b, "u8")) for b in (BASE, pow(BASE, -1, 1 << 64))]
    return _powers[0], _powers[1]


def _hash_words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of folded text, and where they start: a polynomial over a word's bytes, free of its place."""
    text = np.frombuffer(raw, "u1")
    inside = np.concatenate([[False], text != 32, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    up, down = _powers_to(len(text) + 1)
    sums = np.concatenate([np.zeros(1, "u8"), np.cumsum((text.astype("u8") + np.uint64(1)) * up[: len(text)])])
    return _mix(_mix((sums[ends] - sums[starts]) * down[starts], SALTS[0]), SALTS[1]), starts


def word_hashes(texts: list[str]) -> Iterator[np.ndarray]:
    """The hashes of each text's words, many short texts at a time and long ones in parts."""
    Memo.drop()
    held: list[bytes] = []
    size = 0

    def flush() -> Iterator[np.ndarray]:
        if held:
            hashes, starts = _hash_words(b" ".join(held))
            ends = np.cumsum([len(x) + 1 for x in held])
            yield from np.split(hashes, np.searchsorted(starts, ends[:-1]))

    for text in texts:
        raw = text.encode("utf-8", "surrogatepass").translate(FOLD)
        if len(raw) > PART:
            yield from flush()
            held, size, parts, at = [], 0, [], 0
            while at < len(raw):
                end = raw.find(b" ", at + PART) if at + PART < len(raw) else -1
                end = len(raw) if end < 0 else end
                parts.append(_hash_words(raw[at:end])[0])
                at = end
            yield np.concatenate(parts)
            continue
        if size + len(raw) > PART:
            yield from flush()
            held, size = [], 0
        held.append(raw)
        size += len(raw) + 1
    yield from flush()


def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    """The distinct shingles of n words, or the whole of fewer words as one, sorted."""
    if not len(words):
        return words
    k = min(n, len(words))
    h = np.full(len(words) - k + 1, k, "u8")
    for i in range(k):
        h = _mix(h + words[i : i + len(h)], SALTS[2 + i % 3])
    h.sort()
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def ordered(shingles: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Keys in the order of the corpus: the size class in the upper bits, below it 58 bits of the hash."""
    bits = int(len(levels)).bit_length() - 1
    keys = (levels[(shingles >> np.uint64(64 - bits)).astype("int64")].astype("u8") << np.uint64(58)) | (shingles >> np.uint64(6))
    keys.sort()
    return keys


def bitmap(keys: np.ndarray) -> np.ndarray:
    """BITMAP_WORDS longs with the parity of the elements that fall to each bit."""
    odd = np.bincount((keys % np.uint64(64 * BITMAP_WORDS)).astype("int64"), minlength=64 * BITMAP_WORDS) & 1
    return np.packbits(odd.astype(bool)).view("<i8")


def prefix_size(n: int, percent: int) -> int:
    return n + (percent * -n) // 100 + 1


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, of sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a) or 100 * len(a) < percent * len(b):
        return False
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def prefixes_allow(a: np.ndarray, na: int, b: np.ndarray, nb: int, percent: int) -> bool:
    """May sets of sizes na and nb with these prefixes be similar?

    Up to the end of the prefix that ends first both sets are known; behind it all may be shared.
    """
    end = min(a[-1], b[-1])
    a, b = a[: np.searchsorted(a, end, "right")], b[: np.searchsorted(b, end, "right")]
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum()) if len(a) and len(b) else 0
    most = both + min(na - len(a), nb - len(b))
    return (100 + percent) * most >= percent * (na + nb)


def _slots(partials: DataFrame, bits: int) -> np.ndarray:
    """Sum of partial counts, dealt by slice and added as they stream; the sum has a fixed size (4 bytes a counter) and comes in one job."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(raw, "u4")
                sums[k] = sums[k] + part if k in sums else part
        yield pa.RecordBatch.from_pydict({"slice": pa.array(sums, pa.int32()), "counts": pa.array([x.tobytes() for x in sums.values()], pa.binary())})

    out = np.zeros((SLICES, (1 << bits) // SLICES), "u4")
    with brief_shuffles(partials.sparkSession):
        rows = partials.repartition("slice").mapInArrow(add, "slice int, counts binary").collect()
    for row in rows:
        out[row["slice"]] = np.frombuffer(row["counts"], "u4")
    return out.ravel()


def _partial(counts: np.ndarray) -> pa.RecordBatch:
    parts = counts.reshape(SLICES, -1)
    some = np.flatnonzero(parts.any(1))
    return pa.RecordBatch.from_pydict({"slice": pa.array(some, pa.int32()), "counts": pa.array([parts[k].tobytes() for k in some], pa.binary())})


def size_classes(docs: DataFrame, n: int, bits: int = SKETCH_BITS) -> np.ndarray:
    """Of each counter of the sketch the binary logarithm of the documents' shingles that fall to it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held, waiting = np.zeros(1 << bits, "u4"), [], 0

        def put() -> None:
            nonlocal held, waiting
            if held:
                counts.__iadd__(np.bincount(np.concatenate(held).astype("int64"), minlength=1 << bits).astype("u4"))
            held, waiting = [], 0

        for batch in batches:
            for words in word_hashes(batch.column(0).to_pylist()):
                held.append((shingle_set(words, n) >> np.uint64(64 - bits)).astype("u4"))
                waiting += len(held[-1])
                if waiting > 1 << 20:
                    put()
        put()
        yield _partial(counts)

    found = _slots(docs.select("text").mapInArrow(count, "slice int, counts binary"), bits)
    return np.log2(np.maximum(found, 1)).astype("u1")


def _signed(digest: int) -> tuple[int, int]:
    return tuple(np.frombuffer(digest.to_bytes(16, "little"), "<i8").tolist())


def _sets(texts: list[str], n: int, levels: np.ndarray) -> Iterator[np.ndarray]:
    for words in word_hashes(texts):
        yield ordered(shingle_set(words, n), levels)


class NgramJoin:
    """One run over `docs` (doc_id, text) for shingles of n words and a similarity of `percent` or more."""

    def __init__(self, docs: DataFrame, n: int, percent: int, bits: int = SKETCH_BITS, chain: int = CHAIN):
        self.spark, self.n, self.percent = docs.sparkSession, n, percent
        self.docs = docs.select("doc_id", text_or_empty("text").alias("text"))
        self.scratch = Scratch(self.spark, "ngrams")
        levels = size_classes(self.docs, n, bits)  # 2^bits bytes
        self.levels, self.chain = self.spark.sparkContext.broadcast(levels), max(chain, int(levels.mean()) + 4)

    def documents(self) -> DataFrame:
        """doc_id, size and digest of the set, digests, keys and last key of its prefix; an empty set has size 0."""

        n, percent, levels = self.n, self.percent, self.levels

        @F.pandas_udf("n long, s1 long, s2 long, prefix binary, last long, " + ", ".join(f"{b} long" for b in BITS))
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for texts in batches:
                rows = []
                for keys in _sets(texts.tolist(), n, levels.value):
                    prefix = keys[: prefix_size(len(keys), percent)] if len(keys) else keys
                    rows.append((len(keys), *_signed(xxhash.xxh3_128_intdigest(keys.tobytes())), prefix.tobytes(), int(prefix[-1]) if len(keys) else 0, *bitmap(keys).tolist()))
                yield pd.DataFrame(rows, columns=["n", "s1", "s2", "prefix", "last", *BITS])

        found = self.docs.select("doc_id", once(run)("text").alias("s")).select("doc_id", "s.*")
        return found.withColumns({"p1": F.xxhash64("prefix"), "p2": F.xxhash64(F.lit(1), "prefix")})

    def leaders(self, docs: DataFrame, sets: DataFrame) -> DataFrame:
        """(gid, n, prefix, last, bitmap) of each group's leader."""
        own = sets.filter("rep = gid").select(F.col("rep").alias("doc_id"), "s1", "s2")
        found = docs.select("doc_id", "s1", "s2", "n", "prefix", "last", *BITS).join(own, ["doc_id", "s1", "s2"], "left_semi").dropDuplicates(["doc_id", "s1", "s2"])
        return found.select(F.col("doc_id").alias("gid"), F.col("n").cast("int").alias("n"), "prefix", "last", *BITS)

    def postings(self, lead: DataFrame) -> DataFrame:
        """(token, gid, n, before, n_before) of the groups' prefixes where a token may have two groups, with the group before in random order.

        A token's key holds the size class of its counter; lists of far more than 2^chain groups are cut into chains of about so many.
        They are dealt before the window, which would send its order's columns along.
        """

        @F.pandas_udf("array<long>")
        def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for found in batches:
                yield pd.Series([np.frombuffer(x, "<i8") for x in found], dtype=object)

        posted = lead.select("gid", "n", once(tokens)("prefix").alias("tokens")).select("gid", "n", F.explode("tokens").alias("token"))
        like = F.floor(F.log(F.col("n").cast("double")) / -F.log(F.lit(self.percent / 100))).cast("int")
        over = F.shiftrightunsigned("token", 58).cast("int") - self.chain
        chain = F.when(over > 0, F.pmod(F.xxhash64("token", "gid"), F.pow(F.lit(2.0), over).cast("long"))).otherwise(0)
        order = Window.partitionBy("token", "chain").orderBy(like, F.xxhash64("gid", "token"))
        around = posted.withColumn("chain", chain).repartition("token", "chain").withColumns({"before": F.lag("gid").over(order), "n_before": F.lag("n").over(order), "after": F.lead("gid").over(order)})
        return around.filter((over > 0) | F.col("before").isNotNull() | F.col("after").isNotNull()).drop("after", "chain")

    def _sizes(self, a: str, b: str):
        return F.least(a, b) * 100 >= F.greatest(a, b) * self.percent

    def _bits(self, a: str, b: str, na: str, nb: str, groups: bool = False):
        """Bits that differ are at most the elements that differ, of which a similar pair has (100 - p) / (100 + p) of both sizes.

        Of groups only the bits count that are alike in all members of both.
        """
        differ = [F.col(f"{a}{x}").bitwiseXOR(F.col(f"{b}{x}")) for x in BITS]
        if groups:
            differ = [d.bitwiseAND(F.col(f"{a}{m}")).bitwiseAND(F.col(f"{b}{m}")) for d, m in zip(differ, ALIKE, strict=True)]
        differ = sum(map(F.bit_count, differ[1:]), F.bit_count(differ[0]))
        return differ * (100 + self.percent) <= (F.col(na) + F.col(nb)) * (100 - self.percent)

    def _shared(self, a: str, b: str):
        """So many elements of their prefixes two similar groups have in common, at least.

        Up to the end of the prefix that ends first all common elements are known; behind it this set has the rest of its own.
        """
        na, nb, end_a, end_b = (F.col(f"{x}{y}") for y in ("n", "last") for x in (a, b))
        first = F.when(end_a < end_b, na).when(end_b < end_a, nb).otherwise(F.least(na, nb))
        behind = F.floor(first * self.percent / 100)  # n less prefix_size(n) is ceil(percent n / 100) - 1
        return F.ceil((na + nb) * self.percent / F.lit(100 + self.percent) - 1e-6).cast("long") - behind

    def bitmap_filter(self, pairs: DataFrame, lead: DataFrame) -> DataFrame:
        """Pairs (a, b) of leaders whose own bitmaps allow the similarity; other members of their groups have other ones."""
        left = lead.select(F.col("gid").alias("a"), F.col("n").alias("na"), *(F.col(x).alias(f"x_{x}") for x in BITS))
        right = lead.select(F.col("gid").alias("b"), F.col("n").alias("nb"), *(F.col(x).alias(f"y_{x}") for x in BITS))
        return pairs.join(left, "a").join(right, (pairs["b"] == right["b"]) & self._bits("x_", "y_", "na", "nb")).drop(right["b"]).select("a", "b")

    def prefix_filter(self, pairs: DataFrame, lead: DataFrame) -> DataFrame:
        """Pairs (a, b) of groups, by their leaders, whose prefixes allow the similarity."""
        percent = self.percent

        @F.pandas_udf("boolean")
        def allow(pa_: pd.Series, na: pd.Series, pb: pd.Series, nb: pd.Series) -> pd.Series:
            get = lambda x: np.frombuffer(x, "<u8")
            return pd.Series([prefixes_allow(get(x), i, get(y), j, percent) for x, i, y, j in zip(pa_, na, pb, nb, strict=True)], dtype=bool)

        left = lead.select(F.col("gid").alias("a"), F.col("n").alias("na"), F.col("prefix").alias("pa"))
        right = lead.select(F.col("gid").alias("b"), F.col("n").alias("nb"), F.col("prefix").alias("pb"))
        near = pairs.join(left, "a").join(right, "b")
        return near.filter(allow("pa", "na", "pb", "nb")).select("a", "b")

    def verify(self, pairs: DataFrame) -> DataFrame:
        """Links among candidate pairs (a, b) of documents, by their whole sets.

        A bitmap of the candidates' hashed ids, of 2^SKETCH_BITS bits, keeps most other texts from being hashed again.
        """
        n, percent, levels = self.n, self.percent, self.levels
        pairs = self.scratch.save(pairs)
        ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))
        slot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << SKETCH_BITS))
        marks = ids.select(slot.alias("slot")).groupBy(F.shiftright("slot", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("slot").bitwiseAND(32767)).alias("bits"))
        mask = np.zeros((1 << SKETCH_BITS >> 15, 4096), "u1")
        with brief_shuffles(self.spark):
            rows = marks.collect()
        for row in rows:
            mask[row["part"]] = np.frombuffer(row["bits"], "u1")
        wanted = self.spark.sparkContext.broadcast(mask)

        def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = np.unpackbits(wanted.value.ravel(), bitorder="little").view(bool)
            seen: set[tuple] = set()
            for batch in batches:
                batch = batch.filter(pa.array(bits[batch.column(2).to_numpy()]))
                rows = []
                for doc, keys in zip(batch.column(0).to_pylist(), _sets(batch.column(1).to_pylist(), n, levels.value), strict=True):
                    row = (doc, *_signed(xxhash.xxh3_128_intdigest(keys.tobytes())))
                    if row not in seen:  # rows that stand many times
                        seen.add(row)
                        rows.append((*row, keys.tobytes()))
                if len(seen) > 1 << 16:
                    seen.clear()
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["doc_id", "s1", "s2", "keys"])

        @F.pandas_udf("boolean")
        def linked(x: pd.Series, y: pd.Series) -> pd.Series:
            return pd.Series([similar(np.frombuffer(i, "<u8"), np.frombuffer(j, "<u8"), percent) for i, j in zip(x, y, strict=True)], dtype=bool)

        made = self.docs.filter("doc_id is not null").withColumn("slot", slot).mapInArrow(make, "doc_id long, s1 long, s2 long, keys binary")
        keys = self.scratch.save(made.join(ids.distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id", "s1", "s2"]).drop("s1", "s2"))  # so that a leader of many pairs is split
        left, right = keys.select(F.col("doc_id").alias("a"), F.col("keys").alias("ka")), keys.select(F.col("doc_id").alias("b"), F.col("keys").alias("kb"))
        links = self.scratch.save(pairs.join(left, "a").join(right, "b").filter(linked("ka", "kb")).select("a", "b"))
        self.scratch.drop(keys)
        self.scratch.drop(pairs)
        return links

    def run(self) -> DataFrame:
        save = self.scratch.save
        made = save(self.documents())
        full = made.filter("n > 0 and doc_id is not null")
        reps = full.groupBy("s1", "s2", "n", "p1", "p2").agg(F.min("doc_id").alias("rep"), *(F.min(x).alias(x) for x in BITS))
        groups = reps.groupBy("n", "p1", "p2").agg(F.min("rep").alias("gid"))
        sets = save(reps.join(groups, ["n", "p1", "p2"]).select("rep", "s1", "s2", "n", "gid", *BITS))
        lead = save(self.leaders(full, sets))
        docs = save(made.select("doc_id", "n", "s1", "s2"))
        self.scratch.drop(made)  # its prefixes are as large as half the text
        posted = save(self.postings(lead))

        pair = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
        chained = posted.filter(F.col("before").isNotNull() & (F.col("before") != F.col("gid")) & self._sizes("n", "n_before")).select(*pair("gid", "before")).distinct()
        inside = sets.filter("rep <> gid").select(*pair("gid", "rep"))
        likely = save(self.bitmap_filter(chained, lead))  # so that prefixes go along with few pairs
        links = self.verify(self.prefix_filter(likely, lead).union(inside))
        parts = components(links.select(F.col("b").alias("u"), F.col("a").alias("v")), self.scratch)

        member = save(sets.select("rep", "gid", "n", *BITS).join(parts, F.col("rep") == F.col("node"), "left").select("rep", "gid", "n", *BITS, F.coalesce("component", "rep").alias("part")))
        alike = [F.bitwise_not(F.bit_and(x).bitwiseXOR(F.bit_or(x))).alias(m) for x, m in zip(BITS, ALIKE, strict=True)]
        span = save(member.groupBy("gid").agg(F.min("part").alias("low"), F.max("part").alias("high"), *(F.bit_and(x).alias(x) for x in BITS), *alike))
        lists = save(posted.select("token", "gid", "n").join(span.select("gid", "low", "high"), "gid"))
        self.scratch.drop(posted)
        shares = lists.groupBy("token", "low").agg(F.count("*").alias("k"), F.max("high").alias("high"))
        main = shares.groupBy("token").agg(F.max(F.struct("k", "low"))["low"].alias("main"), F.min("low").alias("least"), F.max("high").alias("most")).filter("least < most").select("token", "main")
        unsettled = save(lists.join(main, "token").withColumn("rest", F.expr("low <> main or high <> main")).drop("main").join(span.drop("low", "high").join(lead.select("gid", "last"), "gid"), "gid"))
        x, y = unsettled.filter("rest").alias("x"), unsettled.alias("y")
        apart = (F.col("x.low") != F.col("y.low")) | (F.col("x.low") != F.col("x.high")) | (F.col("y.low") != F.col("y.high"))
        once_each = ~F.col("y.rest") | (F.col("x.gid") < F.col("y.gid"))
        across = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.gid") != F.col("y.gid")) & once_each & apart & self._sizes("x.n", "y.n") & self._bits("x.", "y.", "x.n", "y.n", True))
        # A pair stands here once for each element that both prefixes have; only pairs with enough of them meet whole prefixes.
        across = across.select(*pair("x.gid", "y.gid"), self._shared("x.", "y.").alias("least")).groupBy("a", "b", "least").count()
        across = save(across.filter("count >= least").select("a", "b"))
        self.scratch.drop(lists)
        self.scratch.drop(unsettled)
        alone = span.filter("low <> high").select(F.col("gid").alias("a"), F.col("gid").alias("b"))
        open_pairs = self.prefix_filter(across, lead).union(alone)
        left = member.select(F.col("gid").alias("a"), F.col("rep").alias("ra"), F.col("n").alias("na"), F.col("part").alias("part_a"), *(F.col(x).alias(f"x_{x}") for x in BITS))
        right = member.select(F.col("gid").alias("b"), F.col("rep").alias("rb"), F.col("n").alias("nb"), F.col("part").alias("part_b"), *(F.col(x).alias(f"y_{x}") for x in BITS))
        near = (left["part_a"] != right["part_b"]) & self._bits("x_", "y_", "na", "nb")
        expanded = open_pairs.join(left, "a").join(right, (open_pairs["b"] == right["b"]) & near).select(*pair("ra", "rb")).distinct()
        both = links.union(self.verify(expanded)).select(F.col("b").alias("u"), F.col("a").alias("v"))
        parts = components(both, self.scratch)
        for done in (lead, likely, links, member, span, across):
            self.scratch.drop(done)

        own = sets.select("s1", "s2", "rep").join(parts, F.col("rep") == F.col("node"), "left").select("s1", "s2", F.coalesce("component", "rep").alias("part"))
        found = docs.select("doc_id", "n", "s1", "s2").join(own, ["s1", "s2"], "left")
        part = F.when(F.col("doc_id").isNotNull(), F.coalesce("part", "doc_id"))
        return found.select("doc_id", F.col("n").alias("n_shingles"), part.alias("component_id"))


def ngram_join(docs: DataFrame, n: int = 5, percent: int = 80, bits: int = SKETCH_BITS, chain: int = CHAIN) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of `docs`."""
    return NgramJoin(docs, n, percent, bits, chain).run()


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_batches(spark)
    return ngram_join(table(spark, sf_dir, "documents"), 4, 85)
