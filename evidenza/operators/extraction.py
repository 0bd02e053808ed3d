"""Claims out of raw documents: sentences with byte spans, derived ids, batches with evidence."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import SENTENCE_END, decode_base64, normalize_whitespace, sanitize_id, trimmed

MIN_CHARS, MAX_CLAIMS, MOST_CLAIMS = 24, 32, 512
#: Types, beside text/*, whose payload is read as text.
TEXT_TYPES = ("application/json", "application/xml", "application/yaml", "application/x-yaml", "application/markdown", "application/csv")


def sentence_array(text: Column, min_chars: int = MIN_CHARS, max_claims: int = MAX_CLAIMS) -> Column:
    """Structs (text, span_start, span_end) of a text's sentences; spans are bytes, the end inclusive.

    A part's place is the bytes of the parts before it and one for each end mark, so the spans come from
    running sums of byte lengths; nothing leaves the JVM. Only kept parts are held, so time is linear in the text.
    """
    most = min(max_claims, MOST_CLAIMS)
    parts = F.split(text, SENTENCE_END, -1)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<raw:string,at:bigint>>").alias("out"))
    placed = F.aggregate(
        parts, start,
        lambda s, p: F.struct(
            (s["at"] + F.octet_length(p) + 1).alias("at"),
            F.when((F.size(s["out"]) < most) & (F.length(normalize_whitespace(p)) >= max(1, min_chars)), F.concat(s["out"], F.array(F.struct(p.alias("raw"), s["at"].alias("at"))))).otherwise(s["out"]).alias("out"),
        ),
        lambda s: s["out"],
    )
    lead = lambda r: F.octet_length(r) - F.octet_length(F.regexp_replace(r, "(?U)^\\s+", ""))
    tail = lambda r: F.octet_length(r) - F.octet_length(F.regexp_replace(r, "(?U)\\s+$", ""))
    return F.transform(
        placed,
        lambda p: F.struct(normalize_whitespace(p["raw"]).alias("text"), (p["at"] + lead(p["raw"])).alias("span_start"), (p["at"] + F.octet_length(p["raw"]) - tail(p["raw"]) - 1).alias("span_end")),
    )


def sentences(docs: DataFrame, min_chars: int = MIN_CHARS, max_claims: int = MAX_CLAIMS, text_col: str = "text") -> DataFrame:
    """One row per sentence, with its ordinal from 1."""
    kept = [c for c in docs.columns if c not in (text_col, "ordinal", "sentence", "span_start", "span_end")]
    found = docs.select(*kept, F.posexplode(sentence_array(F.col(text_col), min_chars, max_claims)).alias("at", "s"))
    return found.select(*kept, (F.col("at") + 1).alias("ordinal"), F.col("s.text").alias("sentence"), F.col("s.span_start").alias("span_start"), F.col("s.span_end").alias("span_end"))


def claims_and_evidence(docs: DataFrame, confidence: float = 0.7, quality: float = 0.8, min_chars: int = MIN_CHARS, max_claims: int = MAX_CLAIMS) -> tuple[DataFrame, DataFrame]:
    """Of documents (tenant_id, document_id, source_id, text) a claim per sentence, and evidence that supports it."""
    found = sentences(docs, min_chars, max_claims)
    name = lambda kind: F.concat(F.lit("raw:"), sanitize_id(F.col("tenant_id"), 48), F.lit(":"), sanitize_id(F.col("document_id"), 80), F.lit(f":{kind}"), F.lpad(F.col("ordinal").cast("string"), 4, "0"))
    claims = found.select(name("c").alias("claim_id"), "tenant_id", F.col("sentence").alias("canonical_text"), F.lit(confidence).alias("confidence"))
    evidence = found.select(
        name("e").alias("evidence_id"), name("c").alias("claim_id"), "source_id", F.lit("supports").alias("stance"), F.lit(quality).alias("source_quality"),
        F.concat(F.lit("sentence-"), F.col("ordinal").cast("string")).alias("chunk_id"), "span_start", "span_end", F.col("document_id").alias("doc_id"),
    )
    return claims, evidence


def commit_id(tenant: Column, document: Column, provider: str = "builtin", embedding: str = "none", min_chars: int = MIN_CHARS, max_claims: int = MAX_CLAIMS) -> Column:
    return F.concat(F.lit("raw:"), sanitize_id(tenant, 48), F.lit(":"), sanitize_id(document, 80), F.lit(f":p{provider}:e{embedding}:m{min_chars}:k{max_claims}"))


def document_text(mime: Column, payload: Column) -> Column:
    """Text of a base64 payload of a text type; null for other types."""
    kind = F.lower(F.trim(F.split_part(mime, F.lit(";"), F.lit(1))))
    return F.when(kind.startswith("text/") | kind.isin(*TEXT_TYPES), F.decode(decode_base64(payload), "UTF-8"))


#: Variable of a parser command's environment that holds the document's type.
MIME_VARIABLE = "DOCUMENT_MIME_TYPE"


def parse_documents(requests: DataFrame, command: str | None = None, variable: str = MIME_VARIABLE) -> DataFrame:
    """Document requests (mime_type, text, content_base64) with `body`, `parser` and, where there is no text, `error`.

    Text given in the request counts first; else the payload is decoded. Text types are UTF-8; other types go as bytes
    to `command`, a shell command that prints their text, and are an error without one. What the request holds besides
    is kept. Texts are trimmed.
    """
    kind = F.lower(trimmed(F.coalesce("mime_type", F.lit(""))))
    plain = F.split_part(kind, F.lit(";"), F.lit(1))
    given, payload = trimmed(F.coalesce("text", F.lit(""))), F.regexp_replace(F.coalesce("content_base64", F.lit("")), "(?U)\\s+", "")
    broken = payload.rlike("[^A-Za-z0-9+/_=-]") | payload.rlike("=[^=]") | (F.length(F.regexp_replace(payload, "=", "")) % 4 == 1)
    rows = requests.withColumns({"_kind": kind, "_text": F.trim(plain).startswith("text/") | F.trim(plain).isin(*TEXT_TYPES), "_raw": F.when((given == "") & (payload != "") & ~broken, decode_base64(payload))})
    error = F.when(kind == "", "mime_type is required").when(given != "", None).when(payload == "", "either text or content_base64 is required").when(broken, "content_base64 is not valid")
    utf8 = F.is_valid_utf8(F.col("_raw").cast("string")) if hasattr(F, "is_valid_utf8") else F.lit(True)
    body = F.when(given != "", given).when(F.col("_text") & utf8, trimmed(F.decode("_raw", "UTF-8")))
    parser = F.when(given != "", "inline_text").when(F.col("_text"), "builtin").when(F.lit(command is not None), "command")
    error = error.when(given != "", None).when(F.col("_text") & ~utf8, "payload is not valid UTF-8").when(~F.col("_text") & F.lit(command is None), F.concat(F.lit("no parser for "), kind))
    rows = rows.withColumns({"body": body, "parser": parser, "error": error})
    if command is not None:
        rows = rows.withColumn("_out", _commanded(command, variable)(F.when(F.col("error").isNull() & (F.col("parser") == "command"), F.col("_raw")), F.col("_kind")))
        rows = rows.withColumns({"error": F.coalesce("error", "_out.error"), "body": F.coalesce("body", trimmed(F.col("_out.text")))}).drop("_out")
    empty = F.col("error").isNull() & (F.coalesce("body", F.lit("")) == "")
    rows = rows.withColumn("error", F.when(empty, "document parser yielded empty text").otherwise(F.col("error")))
    return rows.withColumn("body", F.when(F.col("error").isNull(), F.col("body"))).drop("_kind", "_text", "_raw")


def _commanded(command: str, variable: str):
    @F.pandas_udf("text string, error string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for raws, kinds in batches:
            yield pd.DataFrame([run_command(command, raw, {variable: kind}) if raw is not None else (None, None) for raw, kind in zip(raws, kinds, strict=True)], columns=["text", "error"])

    return run.asNondeterministic()


def run_command(command: str, given: bytes, environment: dict[str, str] | None = None) -> tuple[str | None, str | None]:
    """What a shell command prints for the given input, or what went wrong."""
    import os
    import subprocess

    out = subprocess.run(["sh", "-c", command], input=bytes(given), capture_output=True, env=os.environ | (environment or {}), check=False)
    if out.returncode:
        said = out.stderr.decode(errors="replace").strip()
        return None, f"command exited with status {out.returncode}" + (f": {said}" if said else "")
    try:
        return out.stdout.decode(), None
    except UnicodeDecodeError:
        return None, "command output is not valid UTF-8"


def by_command(rows: DataFrame, command: list[str], text_col: str = "text", out_col: str = "line") -> DataFrame:
    """Each text through an external command's standard input; one row per line that it prints."""
    kept = [c for c in rows.columns if c not in (text_col, out_col)]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*kept).schema) + f", {out_col} string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import subprocess

        for batch in batches:
            lines = [subprocess.run(command, input=t or "", capture_output=True, text=True, check=True).stdout.splitlines() for t in batch[text_col]]
            yield batch[kept].assign(**{out_col: lines}).explode(out_col).dropna(subset=[out_col])

    return rows.select(*kept, text_col).mapInPandas(run, schema)
