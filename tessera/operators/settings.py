"""Settings within their bounds, as columns, so that many sites' settings are checked at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Lowest and highest, by setting.
WHOLE = {
    "max_questions": (5, 20), "rag_top_k": (1, 10), "rag_rate_limit": (0, 200), "rag_daily_budget": (0, 10_000), "rag_max_tokens": (64, 2048),
    "generations_keep_rows": (0, 5000), "generations_keep_days": (0, 3650), "qa_log_keep_rows": (0, 20_000), "qa_log_keep_days": (0, 3650),
}
TENTHS = {"temperature": (0.0, 1.0), "rag_temperature": (0.0, 1.0)}
CHOICES = {"language": ["pl", "en", "de"], "rag_rate_window": ["godzina", "doba"]}
#: Floors of the thresholds, and least and most of a thinking budget that isn't off (0) or free (-1).
SOFT_FLOOR, HARD_FLOOR, LEAST_THINKING, MOST_THINKING = 0.70, 0.65, 128, 24_576


def within(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def thinking_budget(value: Column) -> Column:
    return F.when(value < -1, -1).when((value > 0) & (value < LEAST_THINKING), LEAST_THINKING).when(value > MOST_THINKING, MOST_THINKING).otherwise(value).cast("int")


def clamped(settings: DataFrame) -> DataFrame:
    """settings with each known column within its bounds. What is null stays so: the value before holds. The hard
    threshold isn't above the soft one; a choice that isn't known is null, except that of the window, which is an hour."""
    have, out = set(settings.columns), {}
    for name, (low, high) in WHOLE.items():
        out[name] = F.when(F.col(name).isNotNull(), within(F.col(name).cast("long"), low, high)).cast("int") if name in have else None
    for name, (low, high) in TENTHS.items():
        out[name] = F.when(F.col(name).isNotNull(), within(F.round(F.col(name).cast("double"), 1), low, high)) if name in have else None
    for name, known in CHOICES.items():
        default = F.when(F.col(name).isNotNull(), F.lit("godzina")) if name == "rag_rate_window" else F.lit(None).cast("string")
        out[name] = F.when(F.col(name).isin(known), F.col(name)).otherwise(default) if name in have else None
    if "rag_threshold" in have:
        soft = within(F.round(F.col("rag_threshold").cast("double"), 2), SOFT_FLOOR, 1.0)
        out["rag_threshold"] = F.when(F.col("rag_threshold").isNotNull(), soft)
        if "rag_threshold_hard" in have:
            hard = F.least(within(F.round(F.col("rag_threshold_hard").cast("double"), 2), HARD_FLOOR, 1.0), soft)
            out["rag_threshold_hard"] = F.when(F.col("rag_threshold_hard").isNotNull(), hard)
    if "rag_thinking_budget" in have:
        out["rag_thinking_budget"] = thinking_budget(F.col("rag_thinking_budget").cast("long"))
    return settings.withColumns({k: v for k, v in out.items() if v is not None})
