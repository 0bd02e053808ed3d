"""The change log: record lines, their decoding with older widths, replay, windows, checkpoints.

A log is a DataFrame (offset, line). State comes from it by aggregates over the log, not by applying
record after record: a claim's last record wins, its vector counts only if logged after it, evidence and
edges are all kept, and a commit id must not return with another payload.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.text import escape_field, pack_floats, pack_strings, unescape_field, unpack_floats
from ..operators.filters import claim_error, edge_error, evidence_error, vector_error
from ..schema import ConflictError, StoreError
from .workspace import ranked

#: First line of a snapshot or an export as text.
SNAPSHOT_HEADER = "SNAP\t1"
KINDS = {"C": "claim", "E": "evidence", "G": "edge", "V": "vector", "B": "commit"}
WIDTHS = {"C": (6, 8, 13), "E": (6, 9, 12), "G": (6,), "V": (3,), "B": (5,)}


def _opt(c: str, text: bool = False):
    return F.coalesce(escape_field(F.col(c)) if text else F.col(c).cast("string"), F.lit("null"))


def claim_lines(claims: DataFrame) -> DataFrame:
    have = lambda c, d: F.col(c) if c in claims.columns else F.lit(None).cast(d)
    rows = claims.withColumns({"claim_type": have("claim_type", "string"), "created_at": have("created_at", "long"), "updated_at": have("updated_at", "long")})
    text = [escape_field(F.col(c)) for c in ("claim_id", "tenant_id", "canonical_text")]
    return rows.select(F.concat_ws("\t", F.lit("C"), *text, F.col("confidence").cast("string"), _opt("event_time_unix"), pack_strings(F.col("entities")), pack_strings(F.col("embedding_ids")), *map(_opt, ("claim_type", "valid_from", "valid_to", "created_at", "updated_at"))).alias("line"))


def evidence_lines(evidence: DataFrame) -> DataFrame:
    text = [escape_field(F.col(c)) for c in ("evidence_id", "claim_id", "source_id")]
    optional = {"chunk_id": "string", "span_start": "long", "span_end": "long", "doc_id": "string", "extraction_model": "string", "ingested_at": "long"}
    rows = evidence.withColumns({c: F.lit(None).cast(d) for c, d in optional.items() if c not in evidence.columns})
    return rows.select(F.concat_ws("\t", F.lit("E"), *text, "stance", F.col("source_quality").cast("string"), *(_opt(c, d == "string") for c, d in optional.items())).alias("line"))


def edge_lines(edges: DataFrame) -> DataFrame:
    text = [escape_field(F.col(c)) for c in ("edge_id", "from_claim_id", "to_claim_id")]
    return edges.select(F.concat_ws("\t", F.lit("G"), *text, "relation", F.col("strength").cast("string")).alias("line"))


def vector_lines(vectors: DataFrame) -> DataFrame:
    return vectors.select(F.concat_ws("\t", F.lit("V"), escape_field(F.col("claim_id")), pack_floats(F.col("values"))).alias("line"))


def commit_lines(commits: DataFrame) -> DataFrame:
    return commits.select(F.concat_ws("\t", F.lit("B"), escape_field(F.col("commit_id")), F.col("batch_size").cast("string"), F.col("ts_unix_ms").cast("string"), pack_strings(F.col("claim_ids"))).alias("line"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def unpack_strings(packed: pd.Series) -> pd.Series:
    """Lengths are bytes, so this is read byte by byte, for a whole batch at a time."""

    def one(raw: str) -> list[str]:
        data, at, out = raw.encode(), 0, []
        while at < len(data):
            colon = data.index(b":", at)
            end = colon + 1 + int(data[at:colon])
            out.append(data[colon + 1 : end].decode())
            at = end
        return out

    return pd.Series([one(x) if x else [] for x in packed], dtype=object)


def decode(log: DataFrame, strict: bool = True) -> DataFrame:
    """(offset, kind, f): the fields of each line; a line of unknown kind or width raises, or goes if not strict."""
    parts = log.select("offset", F.split("line", "\t", -1).alias("f"))
    kind = F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv))[F.col("f")[0]]
    fits = F.lit(False)
    for tag, widths in WIDTHS.items():
        fits = fits | ((F.col("f")[0] == tag) & F.size("f").isin(*widths))
    if not strict:
        return parts.filter(fits).select("offset", kind.alias("kind"), "f")
    checked = F.when(fits, kind).otherwise(F.raise_error(F.concat(F.lit("invalid log record at offset "), F.col("offset").cast("string"))).cast("string"))
    return parts.select("offset", checked.alias("kind"), "f")


def _f(i: int):
    return F.nullif(F.get("f", F.lit(i)), F.lit("null"))


def _text(i: int):
    return unescape_field(F.get("f", F.lit(i)))


def claims(records: DataFrame) -> DataFrame:
    """The last record of each claim, with its offset. A claim that changes its tenant is a conflict."""
    rows = records.filter(F.col("kind") == "claim").select(
        "offset", _text(1).alias("claim_id"), _text(2).alias("tenant_id"), _text(3).alias("canonical_text"), F.get("f", F.lit(4)).cast("double").alias("confidence"), _f(5).cast("long").alias("event_time_unix"),
        F.coalesce(F.get("f", F.lit(6)), F.lit("")).alias("entities"), F.coalesce(F.get("f", F.lit(7)), F.lit("")).alias("embedding_ids"),
        _f(8).alias("claim_type"), *(_f(i).cast("long").alias(c) for i, c in ((9, "valid_from"), (10, "valid_to"), (11, "created_at"), (12, "updated_at"))),
    )
    kept = [c for c in rows.columns if c not in ("claim_id", "offset")]
    last = rows.groupBy("claim_id").agg(F.max("offset").alias("offset"), F.count_distinct("tenant_id").alias("tenants"), F.max_by(F.struct(*kept), "offset").alias("r"))
    tenant = F.when(F.col("tenants") > 1, F.raise_error(F.concat(F.lit("claim changes its tenant: "), F.col("claim_id"))).cast("string")).otherwise(F.col("r.tenant_id"))
    out = last.select("claim_id", "offset", tenant.alias("tenant_id"), *(F.col(f"r.{c}").alias(c) for c in kept if c != "tenant_id"))
    return out.withColumns({"entities": unpack_strings("entities"), "embedding_ids": unpack_strings("embedding_ids")})


def evidence(records: DataFrame) -> DataFrame:
    return records.filter(F.col("kind") == "evidence").select(
        F.col("offset").alias("seq"), _text(1).alias("evidence_id"), _text(2).alias("claim_id"), _text(3).alias("source_id"), F.get("f", F.lit(4)).alias("stance"), F.get("f", F.lit(5)).cast("double").alias("source_quality"),
        _f(6).alias("chunk_id"), _f(7).cast("long").alias("span_start"), _f(8).cast("long").alias("span_end"), _f(9).alias("doc_id"), _f(10).alias("extraction_model"), _f(11).cast("long").alias("ingested_at"),
    )


def edges(records: DataFrame) -> DataFrame:
    return records.filter(F.col("kind") == "edge").select(F.col("offset").alias("seq"), _text(1).alias("edge_id"), _text(2).alias("from_claim_id"), _text(3).alias("to_claim_id"), F.get("f", F.lit(4)).alias("relation"), F.get("f", F.lit(5)).cast("double").alias("strength"))


def vectors(records: DataFrame) -> DataFrame:
    """The last vector of each claim, if no record of the claim came after it."""
    rows = records.filter(F.col("kind") == "vector").select("offset", _text(1).alias("claim_id"), F.get("f", F.lit(2)).alias("raw"))
    last = rows.groupBy("claim_id").agg(F.max("offset").alias("at"), F.max_by("raw", "offset").alias("raw"))
    changed = records.filter(F.col("kind") == "claim").groupBy(_text(1).alias("claim_id")).agg(F.max("offset").alias("changed"))
    return last.join(changed, "claim_id").filter("at > changed").select("claim_id", unpack_floats(F.col("raw")).alias("values"))


def commits(records: DataFrame) -> DataFrame:
    """The first record of each commit id; the same id with another payload is a conflict."""
    rows = records.filter(F.col("kind") == "commit").select("offset", _text(1).alias("commit_id"), F.get("f", F.lit(2)).cast("long").alias("batch_size"), F.get("f", F.lit(3)).cast("long").alias("ts_unix_ms"), F.get("f", F.lit(4)).alias("packed"))
    grouped = rows.groupBy("commit_id").agg(F.min_by(F.struct("batch_size", "ts_unix_ms", "packed"), "offset").alias("r"), F.count_distinct("batch_size", "packed").alias("payloads"), F.count("*").alias("times"))
    return grouped.select("commit_id", "r.batch_size", "r.ts_unix_ms", unpack_strings("r.packed").alias("claim_ids"), "times", (F.col("payloads") > 1).alias("conflict"))


def new_commits(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Incoming commits (commit_id, fingerprint) against stored ones: new, repeated, or a conflict."""
    known = stored.select("commit_id", F.col("fingerprint").alias("_known"))
    outcome = F.when(F.col("_known").isNull(), "new").when(F.col("_known") == F.col("fingerprint"), "repeated").otherwise("conflict")
    return incoming.join(known, "commit_id", "left").withColumn("outcome", outcome).drop("_known")


def commit_ids(records: DataFrame) -> DataFrame:
    return records.filter(F.col("kind") == "commit").select("offset", _text(1).alias("commit_id"))


def window(log: DataFrame, start: int, most: int) -> DataFrame:
    """Records [start, start + most)."""
    return log.filter((F.col("offset") >= start) & (F.col("offset") < start + most))


def needs_resync(log: DataFrame, start: int) -> bool:
    last = log.agg(F.max("offset")).first()[0]
    return start > (-1 if last is None else last) + 1


def numbered(lines: DataFrame, first: int = 0, *order: str) -> DataFrame:
    """(offset, line): lines numbered in the given order without a task that holds them all."""
    return ranked(lines, *order).select((F.col("_rank") + first).alias("offset"), "line")


class ChangeLog:
    """A log in a folder: Parquet batches of (offset, line), a snapshot that a checkpoint writes, switched by a pointer."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("log").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def generation(self) -> int:
        """The newest checkpoint that was written to its end; 0 before the first."""
        fs, found = self._fs(), [0]
        if fs.exists(self._path("snapshot")):
            names = [s.getPath().getName() for s in fs.listStatus(self._path("snapshot"))]
            found += [int(n) for n in names if n.isdigit() and fs.exists(self._path(f"snapshot/{n}/_SUCCESS"))]
        return max(found)

    def _log(self, g: int) -> str:
        return f"{self.root}/log/{g}"

    def read(self) -> DataFrame:
        """Snapshot and then the log, by offset."""
        g, empty = self.generation(), self.spark.createDataFrame([], "offset long, line string")
        fs = self._fs()
        log = self.spark.read.schema(empty.schema).parquet(self._log(g)) if fs.exists(self._path(f"log/{g}")) else empty
        return log.union(self.spark.read.parquet(f"{self.root}/snapshot/{g}").select("offset", "line")) if g else log

    def append(self, lines: DataFrame, *order: str) -> int:
        """Add lines after the last offset; a write that fails leaves nothing that is read."""
        first = self.boundary()["next_offset"]
        out = numbered(lines, first, *(order or ("line",)))
        decode(out).write.format("noop").mode("overwrite").save()  # refuse before anything is written
        out.write.mode("append").parquet(self._log(self.generation()))
        return first

    def write(self, records: DataFrame) -> None:
        records.write.mode("append").parquet(self._log(self.generation()))

    def tail(self) -> DataFrame:
        """What came after the newest snapshot."""
        path = self._log(self.generation())
        return self.spark.read.schema("offset long, line string").parquet(path) if self._fs().exists(self._path(f"log/{self.generation()}")) else self.spark.createDataFrame([], "offset long, line string")

    def _files(self) -> set[str]:
        path = self._path(f"log/{self.generation()}")
        return {s.getPath().getName() for s in self._fs().listStatus(path)} if self._fs().exists(path) else set()

    def rollback_point(self) -> tuple[int, frozenset[str]]:
        """The generation and the files of its log as they are now."""
        return self.generation(), frozenset(self._files())

    def rollback(self, point: tuple[int, frozenset[str]]) -> None:
        """Remove what was appended since; a checkpoint in between cannot be undone."""
        g, kept = point
        if g != self.generation():
            raise StoreError("the log was checkpointed since")
        for name in self._files() - kept:
            self._fs().delete(self._path(f"log/{g}/{name}"), True)

    def export(self) -> DataFrame:
        """The whole log, for a follower that starts anew, under its generation."""
        return self.read().withColumn("generation", F.lit(self.generation()))

    def replace(self, export: DataFrame) -> int:
        """Become the exported log: checked and written as a snapshot of its own, then switched to."""
        decode(export).write.format("noop").mode("overwrite").save()
        at = max(self.generation() + 1, (export.agg(F.max("generation")).first()[0] or 0))
        export.select("offset", "line").write.mode("overwrite").parquet(f"{self.root}/snapshot/{at}")
        return at

    def boundary(self) -> dict[str, int]:
        row = self.read().agg(F.count("*").alias("n"), F.coalesce(F.max("offset") + 1, F.lit(0)).alias("next_offset")).first()
        return {"records": row["n"], "next_offset": row["next_offset"], "generation": self.generation()}

    def checkpoint(self) -> int:
        """Write the state's records as a snapshot and begin a new log; the old one counts until the snapshot is whole."""
        g, records = self.generation(), decode(self.read())
        parts = [claim_lines(claims(records)), vector_lines(vectors(records)), evidence_lines(evidence(records)), edge_lines(edges(records)), commit_lines(commits(records))]
        lines = parts[0].withColumn("part", F.lit(0))
        for i, part in enumerate(parts[1:], 1):
            lines = lines.union(part.withColumn("part", F.lit(i)))
        order = F.when(F.col("part") == 0, 0).otherwise(F.col("part"))
        numbered(lines.withColumn("part", order), 0, "part", "line").write.parquet(f"{self.root}/snapshot/{g + 1}")
        return g + 1

    def snapshot_text(self, path: str) -> None:
        """The state's records as text below the header, in one order."""
        header = self.spark.createDataFrame([(-1, SNAPSHOT_HEADER)], "offset long, line string")
        header.union(self.read().select("offset", "line")).repartitionByRange("offset").sortWithinPartitions("offset").select("line").write.text(path)


def read_snapshot_text(spark: SparkSession, path: str) -> DataFrame:
    """(offset, line) of a snapshot written as text; refused without its header."""
    lines = spark.read.text(path).withColumnRenamed("value", "line")
    if not lines.filter(F.col("line") == SNAPSHOT_HEADER).limit(1).count():
        raise StoreError("not a snapshot")
    return numbered(lines.filter(F.col("line") != SNAPSHOT_HEADER), 0, "line")


@dataclass(frozen=True)
class CheckpointPolicy:
    """Checkpoint when the log beyond the snapshot has this many records or bytes; none of either: never."""

    records: int | None = None
    bytes: int | None = None


def checkpoint_due(log: ChangeLog, policy: CheckpointPolicy) -> bool:
    facts = log.tail().agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("line") + 1), F.lit(0)).alias("bytes")).first()
    return any(most is not None and now >= most for most, now in ((policy.records, facts["n"]), (policy.bytes, facts["bytes"])))


def _refuse(rows: DataFrame | None, error, what: str) -> None:
    wrong = rows.select(error.alias("error")).filter("error is not null").first() if rows is not None else None
    if wrong:
        raise StoreError(f"{what}: {wrong['error']}")


def ingest(
    log: ChangeLog, commit: str, claim_rows: DataFrame, evidence_rows: DataFrame | None = None, edge_rows: DataFrame | None = None, vector_rows: DataFrame | None = None,
    fingerprint: str | None = None, most: int = 128, policy: CheckpointPolicy | None = None, publish: Callable[[DataFrame], object] | None = None,
) -> str:
    """One batch, all or nothing: claims with their evidence, edges and vectors.

    Refused before anything is written: an empty or too large batch, claims of several tenants, a record that the
    validation rejects, evidence or edges of claims that are neither in the batch nor in the log, a commit id that
    stands for another payload. If the write or `publish` fails, the log is as it was. `policy` may ask for a checkpoint.
    """
    if claim_rows.limit(most + 1).count() > most:
        raise StoreError("a batch needs 1 to %d items" % most)
    facts = claim_rows.agg(F.count("*").alias("n"), F.count_distinct("tenant_id").alias("tenants"), F.array_sort(F.collect_set("claim_id")).alias("ids")).first()
    if not facts["n"]:
        raise StoreError("a batch needs 1 to %d items" % most)
    if facts["tenants"] > 1:
        raise StoreError("a batch has one tenant")
    _refuse(claim_rows.withColumns({c: F.lit(None).cast(kind) for c, kind in (("valid_from", "long"), ("valid_to", "long"), ("entities", "array<string>"), ("embedding_ids", "array<string>")) if c not in claim_rows.columns}), claim_error(), "claim")
    if evidence_rows is not None:
        _refuse(evidence_rows.withColumns({c: F.lit(None).cast("long") for c in ("span_start", "span_end") if c not in evidence_rows.columns}), evidence_error(), "evidence")
    _refuse(edge_rows, edge_error(), "edge")
    _refuse(vector_rows, vector_error(), "vector")
    records = decode(log.read())
    ids = claims(records).select("claim_id").union(claim_rows.select("claim_id"))
    for rows, key, what in ((evidence_rows, "claim_id", "evidence"), (edge_rows, "from_claim_id", "edge"), (vector_rows, "claim_id", "vector")):
        if rows is not None and rows.join(ids, rows[key] == ids["claim_id"], "left_anti").limit(1).count():
            raise StoreError(f"{what} of an unknown claim")
    parts = [claim_lines(claim_rows), *([evidence_lines(evidence_rows)] if evidence_rows is not None else []), *([edge_lines(edge_rows)] if edge_rows is not None else []), *([vector_lines(vector_rows)] if vector_rows is not None else [])]
    mark = fingerprint or _payload_of(parts)
    known = commits(records).filter(F.col("commit_id") == commit).first()
    if known:
        if sorted(known["claim_ids"]) != sorted([f"#{mark}", *facts["ids"]]):
            raise ConflictError("the commit id stands for another payload")
        return "repeated"
    spark = log.spark
    parts.append(commit_lines(spark.createDataFrame([(commit, facts["n"], 0, [f"#{mark}", *facts["ids"]])], "commit_id string, batch_size long, ts_unix_ms long, claim_ids array<string>")))
    whole = None
    for i, part in enumerate(parts):
        part = part.withColumn("part", F.lit(i))
        whole = part if whole is None else whole.union(part)
    point = log.rollback_point()
    try:
        log.append(whole, "part", "line")
        if publish:
            publish(claim_rows)
    except Exception:
        log.rollback(point)
        raise
    if policy and checkpoint_due(log, policy):
        log.checkpoint()
    return "committed"


def _payload_of(parts: list[DataFrame]) -> str:
    """A fingerprint of a batch's lines that their order does not change."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.union(part)
    row = whole.agg(F.count("*").alias("n"), F.sum(F.xxhash64("line").cast("decimal(38,0)")).alias("s")).first()
    return f"{row['n']}-{row['s']}"


def apply_delta(log: ChangeLog, delta: DataFrame, next_offset: int) -> int:
    """Append a leader's records (offset, line) all or nothing; refused where they leave a gap, overlap, or contradict the state."""
    facts = delta.agg(F.count("*").alias("n"), F.min("offset").alias("first"), F.max("offset").alias("last"), F.count_distinct("offset").alias("distinct")).first()
    here = log.boundary()["next_offset"]
    if not facts["n"]:
        return here
    if facts["first"] != here or facts["last"] - facts["first"] + 1 != facts["n"] or facts["distinct"] != facts["n"] or facts["last"] + 1 != next_offset:
        raise StoreError("the delta does not continue the log")
    both = decode(log.read().union(delta.select("offset", "line")))
    claims(both).write.format("noop").mode("overwrite").save()  # a claim that changes its tenant is refused here
    if commits(both).filter("conflict").limit(1).count():
        raise ConflictError("a commit id stands for another payload")
    log.write(delta.select("offset", "line"))
    return next_offset


def pull(follower: ChangeLog, leader: ChangeLog, node: str, most: int = 512) -> dict[str, object]:
    """One tick of a follower: the next records, or the whole log where its offset is beyond the leader's or the leader
    made a checkpoint since; then the acknowledgement. A follower makes no checkpoints of its own."""
    here, there = follower.boundary(), leader.boundary()
    if here["next_offset"] > there["next_offset"] or there["generation"] > here["generation"]:
        follower.replace(leader.export())
        outcome, applied = "resync", follower.boundary()["next_offset"]
    else:
        delta = window(leader.read(), here["next_offset"], most)
        applied = apply_delta(follower, delta, min(here["next_offset"] + most, there["next_offset"]))
        outcome = "delta" if applied > here["next_offset"] else "idle"
    return {"node": node, "outcome": outcome, "next_offset": applied, "lag": there["next_offset"] - applied}
