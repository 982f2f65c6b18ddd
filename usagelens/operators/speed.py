"""Model speed: latency and output rate per model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelens import fixed
from usagelens.functions.predicates import in_range
from usagelens.operators.quantiles import median_and_p90


def model_speed(events: DataFrame, days: int, now_ms: int, tz: str = "UTC") -> DataFrame:
    """Requests, median and p90 latency, median and p90 output rate of each model.

    Short outputs count for latency only; estimated latencies are flagged.
    """
    rows = in_range(events, days, now_ms, tz).filter(
        F.col("model").isNotNull()
        & (F.col("model") != "")
        & F.col("duration_ms").between(fixed.MIN_DURATION_MS, fixed.MAX_DURATION_MS)
    )
    rate = F.when(
        F.col("output_tokens") >= fixed.MIN_OUTPUT_FOR_SPEED,
        F.col("output_tokens") / (F.col("duration_ms") / 1000),
    )
    base = rows.groupBy("model").agg(
        F.count(F.lit(1)).alias("requests"),
        F.count(rate).alias("speed_samples"),
        F.array_sort(F.collect_set("tool")).alias("tools"),
    )
    samples = rows.select(
        "model",
        F.explode(
            F.array(
                F.struct(F.lit("ms").alias("metric"), F.col("duration_ms").cast("double").alias("value")),
                F.struct(F.lit("tps").alias("metric"), rate.alias("value")),
            )
        ).alias("s"),
    ).select("model", "s.*").filter(F.col("value").isNotNull())
    quantiles = median_and_p90(samples, ["model", "metric"])

    def pick(metric: str, column: str):
        return F.max(F.when(F.col("metric") == metric, F.col(column)))

    def round1(c):
        return F.floor(c * 10 + 0.5) / 10

    per_model = quantiles.groupBy("model").agg(
        round1(pick("tps", "median")).alias("median_tps"),
        round1(pick("tps", "p90")).alias("p90_tps"),
        pick("ms", "median").alias("median_ms"),
        pick("ms", "p90").cast("long").alias("p90_ms"),
    )
    approx = F.lit(False)
    for tool in fixed.APPROXIMATE_TOOLS:
        approx = approx | F.array_contains("tools", tool)
    return base.join(per_model, "model").withColumn("approx", approx)
