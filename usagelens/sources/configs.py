"""Small configuration inputs: prices, subscriptions, alert rules, exchange rate, balances."""

from __future__ import annotations

import json
import logging
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from usagelens import fixed
from usagelens.functions import variants as V
from usagelens.operators.alerts import RULE_SCHEMA, default_rules, validate_rules
from usagelens.operators.cost import UNIT, price_book, subscriptions
from usagelens.operators.skew import literal_table

_CATALOG_COSTS = (
    "struct<input_cost_per_token:double,cache_read_input_token_cost:double,"
    "output_cost_per_token:double,cache_creation_input_token_cost:double>"
)

_LOG = logging.getLogger(__name__)


# ------------------------------------------------------------------------ price catalog


def _provider_rank(key: Column) -> Column:
    """Direct name 0, vendor 1, cloud 2, aggregator 3."""
    return (
        F.when(~key.contains("/"), 0)
        .when(key.rlike(fixed.CATALOG_AGGREGATORS), 3)
        .when(key.rlike(fixed.CATALOG_CLOUDS), 2)
        .otherwise(1)
    )


def _pick_catalog(entries: DataFrame) -> DataFrame:
    """One row per bare model name: lowest provider rank, then first in the file."""
    bare = F.element_at(F.split("key", "/"), -1)
    best = W.partitionBy("catalog_model").orderBy("rank", "pos")

    def per_million(c: str) -> Column:
        return F.round(F.coalesce(F.col(c), F.lit(0.0)) * 1e6, 6).cast(UNIT)

    return (
        entries.filter(F.col("input_cost").isNotNull())
        .withColumn("catalog_model", bare)
        .withColumn("rank", _provider_rank(F.col("key")))
        .withColumn("rn", F.row_number().over(best))
        .filter("rn = 1")
        .select(
            "catalog_model",
            per_million("input_cost").alias("input"),
            per_million("cached_cost").alias("cached"),
            per_million("output_cost").alias("output"),
            per_million("write_cost").alias("write"),
        )
    )


def load_price_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Catalog JSON (model -> costs per token) as prices per million tokens by bare name."""
    whole = spark.read.option("wholetext", "true").text(path)
    costs = F.from_json(F.col("value"), f"map<string,{_CATALOG_COSTS}>")
    entries = whole.select(F.posexplode(F.map_entries(costs)).alias("pos", "e")).select(
        "pos",
        F.col("e.key").alias("key"),
        F.col("e.value.input_cost_per_token").alias("input_cost"),
        F.col("e.value.cache_read_input_token_cost").alias("cached_cost"),
        F.col("e.value.output_cost_per_token").alias("output_cost"),
        F.col("e.value.cache_creation_input_token_cost").alias("write_cost"),
    )
    return _pick_catalog(entries)


def price_catalog_rows(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Catalog from literal rows (key, input, cached, output, write cost per token)."""
    entries = literal_table(
        spark,
        [(i, *r) for i, r in enumerate(rows)],
        "pos int, key string, input_cost double, cached_cost double, output_cost double, write_cost double",
    )
    return _pick_catalog(entries)


# ------------------------------------------------------------------------ JSON settings


def _read_json(spark: SparkSession, path: str):
    """A settings file through Spark's file systems; None, and a warning, when it can't be read."""
    try:
        rows = spark.read.option("wholetext", "true").text(path).take(1)
        return json.loads(rows[0]["value"]) if rows else None
    except Exception as error:  # noqa: BLE001 - any unreadable settings file means defaults
        _LOG.warning("settings file %s is not used: %s", path, str(error).split("\n", 1)[0])
        return None


def load_price_book(spark: SparkSession, path: str) -> tuple[DataFrame, Decimal | None]:
    """User prices and the manual exchange rate, if it is switched on; defaults otherwise."""
    body = _read_json(spark, path)
    models = body.get("models") if isinstance(body, dict) else None
    if not isinstance(models, dict):
        return price_book(spark), None
    rows = [
        (
            name,
            entry.get("currency", "CNY"),
            entry.get("input_miss"),
            entry.get("input_hit"),
            entry.get("output"),
            entry.get("input_write"),
            entry.get("off_peak"),
        )
        for name, entry in models.items()
        if isinstance(entry, dict)
    ]
    manual = body.get("usd_to_cny") if body.get("usd_to_cny_manual") is True else None
    return price_book(spark, rows), Decimal(str(manual)) if manual else None


def load_subscriptions(spark: SparkSession, path: str) -> DataFrame | None:
    """Subscription list; None while nothing is configured."""
    body = _read_json(spark, path)
    monthly = body.get("monthly") if isinstance(body, dict) else None
    if not isinstance(monthly, dict):
        return None
    rows = []
    for key, entry in monthly.items():
        if not isinstance(entry, dict):
            continue
        tool = entry.get("tool") if isinstance(entry.get("tool"), str) else None
        models = entry.get("models") if isinstance(entry.get("models"), str) else None
        price = {k: float(entry[k]) for k in ("price_cny", "price_usd") if entry.get(k) is not None}
        rows.append(
            (key, tool or None, entry.get("name") or None, models or None, price.get("price_cny"), price.get("price_usd"))
        )
    return subscriptions(spark, rows) if rows else None


def load_alert_rules(spark: SparkSession, path: str) -> DataFrame:
    """Alert rules; the default rules when the file is missing, malformed or invalid."""
    body = _read_json(spark, path)
    try:
        if body["version"] != 1 or not isinstance(body["rules"], list):
            raise ValueError("unknown version or no list of rules")
        rows = [
            (
                i,
                r["id"],
                r["metric"],
                r["enabled"] if isinstance(r["enabled"], bool) else None,
                None if r["warn"] is None else float(r["warn"]),
                None if r["crit"] is None else float(r["crit"]),
                r.get("provider"),
            )
            for i, r in enumerate(body["rules"], start=1)
        ]
    except (KeyError, TypeError, ValueError):
        return default_rules(spark)
    rules = literal_table(spark, rows, f"pos long, {RULE_SCHEMA}")
    if validate_rules(rules).limit(1).count():
        return default_rules(spark)
    return rules.drop("pos")


# --------------------------------------------------------------------- rates, balances


def fx_rate_asof(rates: DataFrame, now_ms: int, manual: float | None = None) -> DataFrame:
    """One row: the manual rate, else the newest plausible rate up to ``now``, else the default."""
    usable = rates.filter(
        (F.col("ts_ms") <= now_ms) & F.col("rate").between(*fixed.FX_RANGE)
    )
    newest = F.max_by("rate", F.struct("ts_ms", "rate"))
    default = float(fixed.DEFAULT_FX)
    picked = F.round(F.coalesce(newest, F.lit(default)), 4)
    chosen = F.lit(float(manual)) if manual and manual > 0 else picked
    return usable.agg(chosen.alias("rate"), (F.count(F.lit(1)) > 0).alias("found"))


def read_balance_snapshots(payloads: DataFrame) -> DataFrame:
    """Provider payloads (provider, ts_ms, body) to balances; unknown shapes give no row."""
    body = V.parse(F.col("body"))

    def loose(v: Column, path: str) -> Column:
        """A number, or a string that holds one."""
        return V.number(v, path)

    cny = F.filter(
        V.get(body, "$.balance_infos", "array<variant>"),
        lambda b: V.get(b, "$.currency", "string") == "CNY",
    )
    deepseek = loose(F.get(cny, F.lit(0)), "$.total_balance")
    kimi = F.coalesce(loose(body, "$.data.available_balance"), loose(body, "$.available_balance"))
    glm = F.coalesce(
        loose(body, "$.data.balanceTotal"), loose(body, "$.data.balance"), loose(body, "$.balanceTotal")
    )
    balance = (
        F.when(F.col("provider") == "deepseek", deepseek)
        .when(F.col("provider") == "kimi", kimi)
        .when(F.col("provider") == "glm", glm)
    )
    return payloads.select("provider", "ts_ms", balance.alias("balance")).filter(
        F.col("balance").isNotNull()
    )
