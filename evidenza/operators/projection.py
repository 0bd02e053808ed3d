"""Columns that results are shown with: bands, stances, risks, temporal notes, tiers, routing keys."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import schema as S
from .filters import in_range, windows_overlap


def confidence_band(value: Column) -> Column:
    return F.when(value >= S.BAND_HIGH, "high").when(value >= S.BAND_MEDIUM, "medium").otherwise("low")


def dominant_stance(supports: Column, contradicts: Column) -> Column:
    return F.when(supports > contradicts, "supports").when(contradicts > supports, "contradicts").when(supports > 0, "balanced")


def contradiction_risk(supports: Column, contradicts: Column) -> Column:
    return contradicts / F.nullif(supports + contradicts, F.lit(0))


def temporal_mode(start: int | None, end: int | None, known: Column | None = None) -> Column:
    if start is None and end is None:
        return F.lit(None).cast("string")
    event, window = F.col("event_time_unix").isNotNull(), F.col("valid_from").isNotNull() | F.col("valid_to").isNotNull()
    mode = F.when(event & window, "event_and_validity_window").when(event, "event_time").when(window, "validity_window").otherwise("no_temporal_data")
    return mode if known is None else F.when(~known, "missing_claim").otherwise(mode)


def temporal_match(start: int | None, end: int | None) -> Column:
    if start is None and end is None:
        return F.lit(None).cast("boolean")
    event, window = F.col("event_time_unix").isNotNull(), F.col("valid_from").isNotNull() | F.col("valid_to").isNotNull()
    at, over = in_range(F.col("event_time_unix"), start, end), windows_overlap(F.col("valid_from"), F.col("valid_to"), start, end)
    return F.when(event & window, at & over).when(event, at).when(window, over).otherwise(False)


def tier(confidence: Column) -> Column:
    return F.when(confidence >= S.TIER_HOT, "hot").when(confidence >= S.TIER_WARM, "warm").otherwise("cold")


def promotion_state(has_base: Column, delta: Column) -> Column:
    return F.when(~has_base, "replay_only").when(delta == 0, "fully_promoted").otherwise("promotion_in_transition")


def promotion_code(state: Column) -> Column:
    return F.when(state == "replay_only", 0).when(state == "promotion_in_transition", 1).otherwise(2)


def write_key(entities: Column, claim_id: Column) -> Column:
    """The first entity that is not blank, else the claim's id."""
    return F.coalesce(F.get(F.filter(entities, lambda e: F.trim(e) != ""), F.lit(0)), claim_id)


def read_key(entity_filters: list[str] | None, query: str) -> str:
    return next((e for e in entity_filters or [] if e.strip()), query)
