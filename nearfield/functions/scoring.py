"""Column suitability scores and worker health labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# These name lists and thresholds decide the results and must equal the published ones.
SEMANTIC_NAMES = [
    "description", "body", "content", "text", "summary", "notes", "note", "bio", "review", "comment",
    "message", "details", "abstract", "excerpt", "title", "question", "answer",
]
LOW_VALUE_NAMES = ["id", "status", "code", "type", "slug", "url", "email", "phone", "uuid", "hash", "token"]
LONG_TEXT, MEDIUM_TEXT = 200, 50
STARS = {2.5: "★★★", 1.5: "★★☆", 0.0: "★☆☆"}
RUNNING_SECONDS, STALE_SECONDS = 30, 300


def column_score(name: Column, avg_length: Column) -> Column:
    by_length = F.when(avg_length > LONG_TEXT, 3.0).when(avg_length >= MEDIUM_TEXT, 2.0).otherwise(1.0)
    bonus = F.when(name.isin(SEMANTIC_NAMES), 0.5).otherwise(0.0)
    return F.when(name.isin(LOW_VALUE_NAMES), 1.0).otherwise(by_length + bonus)


def stars(score: Column) -> Column:
    (high, three), (middle, two), (_, one) = STARS.items()
    return F.when(score >= high, three).when(score >= middle, two).otherwise(one)


def _age_seconds(since: Column, now: Column) -> Column:
    return (F.unix_micros(now.cast("timestamp")) - F.unix_micros(since.cast("timestamp"))) / F.lit(1_000_000)


def worker_status(last_heartbeat: Column, now: Column) -> Column:
    age = _age_seconds(last_heartbeat, now)
    return F.when(age < RUNNING_SECONDS, "running").when(age < STALE_SECONDS, "stale").otherwise("stopped")


def uptime(started_at: Column, now: Column) -> Column:
    minutes = F.floor(_age_seconds(started_at, now) / 60)
    return F.concat(
        F.floor(minutes / 60).cast("string"), F.lit("h "), (minutes % 60).cast("string"), F.lit("m")
    )


def coverage_pct(embedded: Column, total: Column) -> Column:
    """Share of rows with an embedding, in percent; 0 for an empty table, never above 100."""
    share = F.coalesce(F.try_divide(F.lit(100.0) * embedded, total), F.lit(0.0))
    return F.round(F.least(F.lit(100.0), share), 1)
