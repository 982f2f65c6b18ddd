"""Player reports: parsing and clamping of uploaded JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelens import fixed
from usagelens.functions import variants as V
from usagelens.functions.names import ok_label

_PERIODS = ["day", "week", "month"]


def _number(v: Column, path: str) -> Column:
    """Value read as a number the lenient way: numeric text counts, anything else is 0."""
    return F.coalesce(V.number(v, path), F.lit(0.0))


def _rounded(c: Column) -> Column:
    return F.floor(c + 0.5)


def _clamped(v: Column, name: str) -> Column:
    limit = float(fixed.CLAMP_LIMITS[name])
    return F.greatest(F.lit(0.0), F.least(F.lit(limit), _rounded(_number(v, f"$.{name}")))).cast("long")


def _shares(v: Column, path: str) -> Column:
    """Up to eight (name, percent) pairs with publishable names."""
    none = F.expr("cast(array() as array<variant>)")
    items = F.slice(F.coalesce(V.get(v, path, "array<variant>"), none), 1, 8)
    pairs = F.filter(items, lambda p: V.is_string(p, "$[0]"))
    named = F.transform(
        pairs,
        lambda p: F.struct(
            F.substring(V.get(p, "$[0]", "string"), 1, 60).alias("name"),
            F.greatest(F.lit(0.0), F.least(F.lit(100.0), _rounded(_number(p, "$[1]")))).cast("long").alias("pct"),
        ),
    )
    return F.filter(named, lambda s: ok_label(s["name"]))


def clamp_report(v: Column) -> Column:
    """Report body limited to plausible magnitudes and publishable labels, as a struct."""
    day = V.get(v, "$.day", "string")
    roi = V.number(v, "$.roi_ratio")
    roi_limit = float(fixed.CLAMP_LIMITS["roi_ratio"])
    by_period = F.struct(*[
        F.when(V.is_array(v, f"$.models_by_period.{p}"), F.slice(_shares(v, f"$.models_by_period.{p}"), 1, 1)).alias(p)
        for p in _PERIODS
    ])
    has_period = None
    for p in _PERIODS:
        present = V.is_array(v, f"$.models_by_period.{p}")
        has_period = present if has_period is None else has_period | present
    return F.struct(
        F.substring(F.coalesce(V.get(v, "$.id", "string"), F.lit("")), 1, 64).alias("id"),
        F.substring(F.coalesce(V.get(v, "$.name", "string"), F.lit("")), 1, 32).alias("name"),
        F.when(day.rlike(r"^\d{4}-\d{2}-\d{2}$"), day).alias("day"),
        _clamped(v, "day_tokens").alias("day_tokens"),
        _clamped(v, "day_requests").alias("day_requests"),
        _clamped(v, "week_tokens").alias("week_tokens"),
        # an absent month is unknown, not zero
        F.when(V.is_number(v, "$.month_tokens"), _clamped(v, "month_tokens")).alias("month_tokens"),
        F.when(
            roi.isNotNull(),
            F.greatest(F.lit(0.0), F.least(F.lit(roi_limit), _rounded(roi * 10) / 10)),
        ).alias("roi_ratio"),
        _shares(v, "$.models").alias("models"),
        F.when(has_period, by_period).alias("models_by_period"),
        _shares(v, "$.tools").alias("tools"),
    )


def _strict(v: Column, name: str) -> Column:
    """Counter as sent: absent stays null, a wrong type becomes NaN."""
    path = f"$.{name}"
    return F.when(V.present(v, path), F.coalesce(V.strict_number(v, path), F.lit(float("nan"))))


def _judged(bodies: DataFrame) -> DataFrame:
    """Uploads with their parsed body and why they are no reports; null for reports."""
    v = F.col("v")
    small = F.octet_length("value") <= fixed.REPORT_MAX_BYTES
    return bodies.withColumn("small", small).select(
        "*", V.once(V.parse(F.when(F.col("small"), F.col("value")))).alias("v")
    ).withColumn(
        "reason",
        F.when(~F.col("small"), "too large")
        .when(v.isNull(), "malformed")
        .when(~F.coalesce(V.number(v, "$.v") == 1, F.lit(False)), "version")
        .when(~F.coalesce(V.text(v, "$.id").rlike(fixed.UUID4_PATTERN), F.lit(False)), "id"),
    ).drop("small")


def rejected_reports(bodies: DataFrame) -> DataFrame:
    """Uploads that :func:`read_player_reports` leaves out: (ord, received_ms, reason, n_bytes)."""
    return _judged(bodies).filter("reason IS NOT NULL").select(
        "ord", "received_ms", "reason", F.octet_length("value").alias("n_bytes")
    )


def read_player_reports(bodies: DataFrame) -> DataFrame:
    """Uploads (value, received_ms, ord) that are reports: JSON, at most 16 KiB, version 1, UUIDv4 id.

    Others are listed by :func:`rejected_reports`. Counters stay as sent, for the plausibility checks; ``clamped``
    holds the limited report.
    Works on batch and streaming frames alike.
    """
    v = F.col("v")
    rows = _judged(bodies).filter("reason IS NULL")
    return rows.select(
        V.number(v, "$.v").cast("int").alias("v"),
        V.text(v, "$.id").alias("id"),
        V.get(v, "$.name", "string").alias("name"),
        V.get(v, "$.day", "string").alias("day"),
        *[_strict(v, n).alias(n) for n in ("day_tokens", "day_requests", "week_tokens", "month_tokens")],
        clamp_report(v).alias("clamped"),
        "received_ms",
        "ord",
    )
