"""Predicates: tenant, time, entities, embeddings, stance; and validation with the first failure's name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import schema as S
from ..functions.text import index_key
from ..functions.vectors import valid


def in_range(value: Column, start: int | None, end: int | None) -> Column:
    """Inclusive; a missing bound is open."""
    ok = F.lit(True)
    if start is not None:
        ok = ok & (value >= start)
    if end is not None:
        ok = ok & (value <= end)
    return ok


def windows_overlap(start: Column, end: Column, low: int | None, high: int | None) -> Column:
    ok = F.lit(True)
    if high is not None:
        ok = ok & F.coalesce(start <= high, F.lit(True))
    if low is not None:
        ok = ok & F.coalesce(end >= low, F.lit(True))
    return ok


def matches_time(start: int | None, end: int | None) -> Column:
    """Event time and validity window must both match where present; a claim with neither does not."""
    if start is None and end is None:
        return F.lit(True)
    event, window = F.col("event_time_unix"), F.col("valid_from").isNotNull() | F.col("valid_to").isNotNull()
    at, over = in_range(event, start, end), windows_overlap(F.col("valid_from"), F.col("valid_to"), start, end)
    return F.when(event.isNotNull() & window, at & over).when(event.isNotNull(), at).when(window, over).otherwise(False)


def metadata(entities: list[str] | None, embeddings: list[str] | None) -> Column:
    """Any of the entities (trimmed, ASCII case ignored) and any of the embedding ids (trimmed)."""
    ok = F.lit(True)
    if entities:
        wanted = [e.strip().translate({c: c + 32 for c in range(65, 91)}) for e in entities]
        ok = ok & F.exists("entities", lambda x: index_key(x).isin(wanted))
    if embeddings:
        ok = ok & F.exists("embedding_ids", lambda x: F.trim(x).isin([e.strip() for e in embeddings]))
    return F.coalesce(ok, F.lit(False))


#: Columns of claims that filters read.
METADATA = ("event_time_unix", "valid_from", "valid_to", "entities", "embedding_ids")


def passes_options(columns: list[str]) -> Column:
    """Time, entities and embedding ids by columns _time_from, _time_to, _entities and _embedding_ids, null where open."""
    value = lambda c, kind: F.col(c) if c in columns else F.lit(None).cast(kind)
    low, high = F.coalesce("_time_from", F.lit(-(1 << 63))), F.coalesce("_time_to", F.lit((1 << 63) - 1))
    event, start, end = (value(c, "long") for c in METADATA[:3])
    window = start.isNotNull() | end.isNotNull()
    at = (event >= low) & (event <= high)
    over = F.coalesce(start <= high, F.lit(True)) & F.coalesce(end >= low, F.lit(True))
    time = F.when(F.col("_time_from").isNull() & F.col("_time_to").isNull(), True).when(low > high, False).when(event.isNotNull() & window, at & over).when(event.isNotNull(), at).when(window, over).otherwise(False)
    any_of = lambda wanted, have, key: F.when(F.coalesce(F.size(wanted), F.lit(0)) <= 0, True).otherwise(F.coalesce(F.arrays_overlap(F.transform(have, key), F.transform(wanted, key)), F.lit(False)))
    return time & any_of(F.col("_entities"), value("entities", "array<string>"), index_key) & any_of(F.col("_embedding_ids"), value("embedding_ids", "array<string>"), F.trim)


def stance_allows(mode: str) -> Column:
    return ~(F.col("contradicts") > F.col("supports")) if mode == "support_only" else F.lit(True)


def _first(*rules: tuple[Column, str]) -> Column:
    found = F.when(F.coalesce(rules[0][0], F.lit(True)), rules[0][1])
    for bad, name in rules[1:]:
        found = found.when(F.coalesce(bad, F.lit(True)), name)
    return found


def _blank(c: str) -> Column:
    return F.coalesce(F.regexp_replace(c, "(?U)\\s+", "") == "", F.lit(True))


def _outside(c: str) -> Column:
    return ~F.col(c).between(0.0, 1.0) | F.isnan(c)


def _some_blank(c: str) -> Column:
    return F.coalesce(F.exists(c, lambda x: F.coalesce(F.regexp_replace(x, "(?U)\\s+", "") == "", F.lit(True))), F.lit(False))


def claim_error() -> Column:
    """Null for a valid claim, else what fails first."""
    backwards = F.coalesce(F.col("valid_from") > F.col("valid_to"), F.lit(False))
    return _first(
        (_blank("claim_id"), "claim_id"), (_blank("tenant_id"), "tenant_id"), (_blank("canonical_text"), "canonical_text"),
        (_outside("confidence"), "confidence"), (_some_blank("entities"), "entities"), (_some_blank("embedding_ids"), "embedding_ids"), (backwards, "valid_window"),
    )


def evidence_error() -> Column:
    spans = F.col("span_start").isNull() != F.col("span_end").isNull()
    return _first(
        (_blank("evidence_id"), "evidence_id"), (_blank("claim_id"), "claim_id"), (_blank("source_id"), "source_id"), (_outside("source_quality"), "source_quality"),
        (~F.col("stance").isin(*S.STANCES), "stance"), (spans, "span"), (F.coalesce(F.col("span_start") > F.col("span_end"), F.lit(False)), "span_order"),
    )


def edge_error() -> Column:
    return _first(
        (_blank("edge_id"), "edge_id"), (_blank("from_claim_id"), "from_claim_id"), (_blank("to_claim_id"), "to_claim_id"), (_outside("strength"), "strength"), (~F.col("relation").isin(*S.RELATIONS), "relation")
    )


def vector_error() -> Column:
    return F.when(F.coalesce(F.size("values") <= 0, F.lit(True)), "empty").when(~valid(F.col("values")), "not_finite")


def split_valid(rows: DataFrame, error: Column) -> tuple[DataFrame, DataFrame]:
    checked = rows.withColumn("error", error)
    return checked.filter("error is null").drop("error"), checked.filter("error is not null")


#: Fixed limits of a safe log: records between syncs, records in the buffer, milliseconds between syncs.
SAFE_SYNC_EVERY, SAFE_BUFFER, SAFE_INTERVAL_MS = 256, 256, 5000


def durability_violations(sync_every: int, buffer: int, interval_ms: int | None, flush_ms: int | None, background_only: bool) -> list[str]:
    """What a log's settings risk: too many records, or too long a time, that are not yet on disk."""
    rules = {
        "sync_every_records": sync_every > SAFE_SYNC_EVERY,
        "append_buffer_records": buffer > SAFE_BUFFER,
        "sync_interval_ms": (interval_ms or 0) > SAFE_INTERVAL_MS,
        "async_flush_interval_ms": (flush_ms or 0) > SAFE_INTERVAL_MS,
        "batching_without_interval": not background_only and max(sync_every, buffer) > 1 and interval_ms is None,
        "background_without_flush": background_only and flush_ms is None,
    }
    return [name for name, broken in rules.items() if broken]
