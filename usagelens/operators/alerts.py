"""Alert values, evaluation and rule validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelens import fixed
from usagelens.operators.skew import literal_table

RULE_SCHEMA = "id string, metric string, enabled boolean, warn double, crit double, provider string"


def default_rules(spark: SparkSession) -> DataFrame:
    return literal_table(spark, [(*r, None) for r in fixed.DEFAULT_ALERT_RULES], RULE_SCHEMA)


def metric_values(
    quota: DataFrame, balances: DataFrame, today: DataFrame, block: DataFrame
) -> DataFrame:
    """One row per observed value: (metric, suffix, provider, value, currency).

    ``quota`` has used_percent per window, ``balances`` provider, id, balance and currency,
    ``today`` today_tokens over all devices, ``block`` the open 5 h block.
    """
    blank = F.lit(None).cast("string")

    def shaped(df: DataFrame, metric: str, value: Column, **columns: Column) -> DataFrame:
        return df.select(
            F.lit(metric).alias("metric"),
            columns.get("suffix", blank).alias("suffix"),
            columns.get("provider", blank).alias("provider"),
            value.cast("double").alias("value"),
            columns.get("currency", blank).alias("currency"),
        )

    parts = [
        shaped(quota.agg(F.max("used_percent").alias("v")), "codex_quota_pct", F.col("v")),
        shaped(
            balances,
            "balance",
            F.col("balance"),
            suffix=F.coalesce("id", "provider"),
            provider=F.col("provider"),
            currency=F.col("currency"),
        ),
        shaped(today, "today_tokens", F.col("today_tokens")),
        shaped(block.filter("active"), "claude_5h_tokens", F.col("window_tokens")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.filter(F.col("value").isNotNull() & ~F.isnan("value"))


def uri_component(c: Column) -> Column:
    """Percent-encoding that leaves the unreserved marks of URI components alone."""
    out = F.url_encode(c)
    for encoded, plain in [("\\+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")]:
        out = F.regexp_replace(out, encoded, plain)
    return out


def evaluate_alerts(values: DataFrame, rules: DataFrame) -> DataFrame:
    """Values beyond a threshold of an enabled rule, critical before warning.

    Balances alert below their threshold, everything else at or above it.
    """
    r = rules.filter("enabled").select(
        F.col("id").alias("rule_id"), "metric", "warn", "crit", F.col("provider").alias("only_provider")
    )
    wanted = (
        F.col("only_provider").isNull()
        | (F.col("only_provider") == F.col("provider"))
        | (F.col("only_provider") == F.col("suffix"))
    )

    def hit(threshold: str) -> Column:
        below = F.col("value") < F.col(threshold)
        return F.when(F.col("metric") == "balance", below).otherwise(
            F.col("value") >= F.col(threshold)
        )

    level = F.when(hit("crit"), F.lit("crit")).when(hit("warn"), F.lit("warn"))
    key = F.concat(
        F.col("metric"),
        F.coalesce(F.concat(F.lit(":"), uri_component(F.col("suffix"))), F.lit("")),
        F.when(
            F.col("rule_id") != F.col("metric"),
            F.concat(F.lit(":rule:"), uri_component(F.col("rule_id"))),
        ).otherwise(F.lit("")),
    )
    return (
        values.join(r, "metric")
        .filter(wanted)
        .withColumn("level", level)
        .filter(F.col("level").isNotNull())
        .select(
            key.alias("key"),
            "rule_id",
            "metric",
            "level",
            "value",
            F.when(F.col("level") == "crit", F.col("crit")).otherwise(F.col("warn")).alias("threshold"),
        )
        .orderBy(F.when(F.col("level") == "crit", 0).otherwise(1), "key")
    )


def validate_rules(rules: DataFrame) -> DataFrame:
    """One row per fault: (pos, error). ``pos`` numbers the rules of the list from 1."""
    known = F.col("metric").isin(fixed.ALERT_METRICS)
    blank_id = F.col("id").isNull() | (F.trim("id") == "")
    # a later rule with an id already taken
    first_use = rules.groupBy("id").agg(F.min("pos").alias("first_pos"))
    falling = F.col("metric") == "balance"

    def threshold_fault(name: str) -> Column:
        c = F.col(name)
        wrong = (c < 0) | F.isnan(c) | (c == float("inf"))
        over = (F.col("metric") == "codex_quota_pct") & (c > 100)
        return F.when(F.coalesce(wrong | over, F.lit(False)), F.lit(f"{name} out of range"))

    order_wrong = F.when(falling, F.col("warn") < F.col("crit")).otherwise(
        F.col("warn") > F.col("crit")
    )
    provider_wrong = F.col("provider").isNotNull() & (
        ~F.coalesce(falling, F.lit(False)) | (F.trim("provider") == "")
    )
    faults = F.array(
        F.when(blank_id, F.lit("id must not be blank")),
        F.when(~blank_id & (F.col("pos") > F.col("first_pos")), F.lit("duplicate id")),
        F.when(~F.coalesce(known, F.lit(False)), F.lit("unknown metric")),
        F.when(F.col("enabled").isNull(), F.lit("enabled must be boolean")),
        F.when(provider_wrong, F.lit("provider only fits balance")),
        threshold_fault("warn"),
        threshold_fault("crit"),
        F.when(
            F.col("enabled") & F.col("warn").isNull() & F.col("crit").isNull(),
            F.lit("enabled rule without threshold"),
        ),
        F.when(F.coalesce(order_wrong, F.lit(False)), F.lit("thresholds in wrong order")),
    )
    return (
        rules.join(first_use, "id", "left")
        .select("pos", F.explode(F.array_compact(faults)).alias("error"))
    )
