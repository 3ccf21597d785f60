"""Table contracts: column lists and the published CSV headers they come from."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# --- fixed values: contract columns -> published CSV headers -----------------
HEADERS = {
    "actor": "candidate_name", "area": "district", "activity_type": "campaign_activity_type",
    "target_group": "target_voter_group", "label": "gold_label_0_3", "label_reason": "gold_label_reason",
    "presence": "online_offline", "use_for_place": "use_for_place_recommendation",
    "use_for_message": "use_for_message_recommendation", "place_key": "normalized_place_key",
    "rec_name": "recommended_place_name", "rec_area": "recommended_district",
    "rec_type": "recommended_place_type", "base_score": "baseline_score",
    "area_bonus": "district_bonus", "type_bonus": "place_type_bonus",
}
GOLD = [
    "gold_id", "actor", "date", "day_of_week", "d_day", "time", "area", "place_name", "address",
    "event_title", "place_type", "activity_type", "presence", "target_group", "context_tags", "label",
    "label_reason", "use_for_place", "use_for_message", "source_image",
]
GOLD_REVIEW = ["review_required", "review_reason", "ocr_text"]
QUERIES = [
    "query_id", "evaluation_context", "gold_id", "actor", "date", "day_of_week", "time", "area",
    "place_name", "address", "place_type", "activity_type", "target_group", "context_tags", "label",
    "source_image", "relevance", "is_strong_positive", "place_key",
]
RAW_CANDIDATES = [
    "query_id", "actor", "date", "time", "area", "place_type", "target_group", "context_tags",
    "raw_rank", "rec_name", "rec_area", "rec_type", "base_score", "place_id", "candidate_source",
]
RECOMMENDATIONS = ["query_id", "rank", "rec_name"]
EVAL_GOLD = ["query_id", "gold_id", "place_name", "area", "relevance"]
ALIASES = ["canonical_name", "alias_name", "area", "place_type", "source", "note"]
JSON_WRAPPERS = ["recommendations", "predictions", "items", "timeline", "data"]


def from_published(df: DataFrame) -> DataFrame:
    """Published headers -> contract names; other columns stay."""
    back = {v: k for k, v in HEADERS.items()}
    return df.select([F.col(f"`{c}`").alias(back.get(c, c)) for c in df.columns])


def to_published(df: DataFrame) -> DataFrame:
    return df.select([F.col(f"`{c}`").alias(HEADERS.get(c, c)) for c in df.columns])
