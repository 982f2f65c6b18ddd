"""Cost, reconciliation and subscription return.

Prices are decimals per million tokens and join to grouped rows, never to single events. Costs
stay decimals (in millionths) until a report divides once, so sums do not depend on their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelens import fixed
from usagelens.functions.names import pricing_model
from usagelens.functions.predicates import (
    is_long_context,
    model_prefix,
    model_prefix_loose,
    since,
)
from usagelens.functions.times import (
    is_peak,
    local_day,
    local_day_start,
    local_month_start,
    local_range_start,
)
from usagelens.operators.sequence import balance_delta
from usagelens.operators.skew import literal_table, salted_join

UNIT = "decimal(12,6)"
_PRICE_FIELDS = ["input", "cached", "output", "write"]
_KINDS = [("fi", "input_tokens"), ("ci", "cached_input"), ("cw", "cache_write"), ("oi", "output_tokens")]


def money(cost_e6: Column) -> Column:
    """Decimal millionths to a double with six places."""
    return F.round(cost_e6.cast("double") / 1e6, 6)


# ------------------------------------------------------------------------ price tables


def price_book(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    """User price book: model, currency, four unit prices, off-peak factor (null where unset)."""
    rows = fixed.SEED_PRICES if rows is None else rows
    raw = literal_table(
        spark,
        [tuple(None if v is None else str(v) for v in r) for r in rows],
        "book_model string, currency string, input string, cached string, output string, "
        "write string, off_peak string",
    )
    return raw.select(
        "book_model",
        "currency",
        *[F.col(c).cast(UNIT).alias(c) for c in _PRICE_FIELDS],
        F.col("off_peak").cast("decimal(3,2)").alias("off_peak"),
    )


def official_prices(spark: SparkSession, now_ms: int) -> DataFrame:
    """List prices valid at the report instant."""
    valid = [
        (model, tool, long, currency, *prices)
        for model, tool, long, start, end, currency, *prices in fixed.OFFICIAL_PRICES
        if (start is None or now_ms >= start) and (end is None or now_ms < end)
    ]
    raw = literal_table(
        spark,
        valid,
        "list_model string, list_tool string, list_long boolean, currency string, input string, "
        "cached string, output string, write string",
    )
    return raw.select(
        "list_model",
        "list_tool",
        "list_long",
        "currency",
        *[F.col(c).cast(UNIT).alias(c) for c in _PRICE_FIELDS],
    )


def official_price(
    groups: DataFrame, now_ms: int, fx: str = str(fixed.DEFAULT_FX)
) -> DataFrame:
    """Groups (tool, model, long_context) with their list price in CNY, null where none is known.

    A price that changes over time follows the report instant, not the event time.
    """
    canonical = pricing_model(F.col("model"), F.col("tool"))
    listed = official_prices(groups.sparkSession, now_ms)
    keyed = groups.withColumn("canonical", canonical)
    match = (
        (keyed["canonical"] == listed["list_model"])
        & (listed["list_tool"].isNull() | (listed["list_tool"] == keyed["tool"]))
        & (listed["list_long"].isNull() | (listed["list_long"] == keyed["long_context"]))
    )
    joined = keyed.join(listed, match, "left")
    return joined.select(
        *groups.columns,
        *[_to_cny(F.col(c), F.col("currency"), fx).alias(f"official_{c}") for c in _PRICE_FIELDS],
    )


def _to_cny(price: Column, currency: Column, fx: str) -> Column:
    rate = F.lit(fx).cast("decimal(8,4)")
    return F.when(currency == "USD", F.round(price * rate, 6)).otherwise(price).cast(UNIT)


def _seed_off_peak(canonical: Column) -> Column:
    out = None
    for model, *_, factor in fixed.SEED_PRICES:
        if factor is not None:
            hit = canonical == model
            out = (F if out is None else out).when(hit, F.lit(factor).cast("decimal(3,2)"))
    return out


# ------------------------------------------------------------------------- cost chain


def cost_groups(
    events: DataFrame,
    since_ms: int = 0,
    until_ms: int | None = None,
    extra: dict[str, Column] | None = None,
) -> DataFrame:
    """Four token sums by tool, model, peak and long context, plus any extra group columns."""
    rows = since(events, since_ms)
    if until_ms is not None:
        rows = rows.filter(F.col("ts_ms") < until_ms)
    long_context = is_long_context(
        F.col("tool"), F.col("input_tokens"), F.col("cached_input"), F.col("cache_write")
    )
    return rows.groupBy(
        "tool",
        "model",
        is_peak(F.col("ts_ms")).alias("peak"),
        long_context.alias("long_context"),
        *[column.alias(name) for name, column in (extra or {}).items()],
    ).agg(*[F.sum(column).alias(short) for short, column in _KINDS])


def resolve_price(
    groups: DataFrame,
    now_ms: int,
    fx: str = str(fixed.DEFAULT_FX),
    book: DataFrame | None = None,
    catalog: DataFrame | None = None,
) -> DataFrame:
    """Unit prices in CNY for each group; ``priced`` is false where no price is known.

    Order: user book by raw name, by canonical name, list price, catalog by raw name, by
    canonical name. The cache-write price falls back to the list price, then 0; the off-peak
    factor to the default book, then 1.
    """
    spark = groups.sparkSession
    book = price_book(spark) if book is None else book
    keyed = official_price(groups, now_ms, fx).withColumn(
        "canonical", pricing_model(F.col("model"), F.col("tool"))
    )

    def side(frame: DataFrame, prefix: str, key: str) -> DataFrame:
        return frame.select(
            *[F.col(c).alias(f"{prefix}_{'key' if c == key else c}") for c in frame.columns]
        )

    out = keyed
    out = out.join(side(book, "u1", "book_model"), F.col("model") == F.col("u1_key"), "left")
    out = out.join(side(book, "u2", "book_model"), F.col("canonical") == F.col("u2_key"), "left")
    if catalog is not None:
        alias_raw, alias_canonical = F.col("model"), F.col("canonical")
        for known, replacement in fixed.CATALOG_ALIASES.items():
            alias_raw = F.when(F.col("model") == known, F.lit(replacement)).otherwise(alias_raw)
            alias_canonical = F.when(F.col("canonical") == known, F.lit(replacement)).otherwise(
                alias_canonical
            )
        out = out.withColumn("_raw", alias_raw).withColumn("_can", alias_canonical)
        out = out.join(side(catalog, "c1", "catalog_model"), F.col("_raw") == F.col("c1_key"), "left")
        out = out.join(side(catalog, "c2", "catalog_model"), F.col("_can") == F.col("c2_key"), "left")

    def book_price(prefix: str, field: str) -> Column:
        return _to_cny(F.col(f"{prefix}_{field}"), F.col(f"{prefix}_currency"), fx)

    in_book = F.col("u1_key").isNotNull() | F.col("u2_key").isNotNull()
    listed = F.col("official_input").isNotNull()

    def unit(field: str) -> Column:
        own = (
            F.when(F.col("u1_key").isNotNull(), book_price("u1", field))
            .when(F.col("u2_key").isNotNull(), book_price("u2", field))
            .when(listed, F.col(f"official_{field}"))
        )
        if field == "write":
            own = F.coalesce(
                own, F.col("official_write"), F.when(in_book, F.lit(0).cast(UNIT))
            )
        if catalog is None:
            return own.cast(UNIT)
        usd = F.lit("USD")
        from_catalog = F.when(
            F.col("c1_key").isNotNull(), _to_cny(F.col(f"c1_{field}"), usd, fx)
        ).when(F.col("c2_key").isNotNull(), _to_cny(F.col(f"c2_{field}"), usd, fx))
        return F.when(in_book | listed, own).otherwise(from_catalog).cast(UNIT)

    own_factor = F.when(F.col("u1_key").isNotNull(), F.col("u1_off_peak")).when(
        F.col("u2_key").isNotNull(), F.col("u2_off_peak")
    )
    off_peak = F.coalesce(own_factor, _seed_off_peak(F.col("canonical")), F.lit(1)).cast("decimal(3,2)")
    return out.select(
        *groups.columns,
        *[unit(f).alias(f"{f}_cny") for f in _PRICE_FIELDS],
        off_peak.alias("off_peak"),
    ).withColumn("priced", F.col("input_cny").isNotNull())


def price_groups(priced: DataFrame) -> DataFrame:
    """Cost of each group in millionths; groups without tokens are dropped, unpriced stay null."""
    pairs = [("fi", "input_cny"), ("ci", "cached_cny"), ("cw", "write_cny"), ("oi", "output_cny")]
    cost = None
    for tokens, price in pairs:
        part = F.col(tokens).cast("decimal(18,0)") * F.col(price)
        cost = part if cost is None else cost + part
    factor = F.when(F.col("peak"), F.lit(1).cast("decimal(3,2)")).otherwise(F.col("off_peak"))
    return (
        priced.withColumn("tokens", F.col("fi") + F.col("ci") + F.col("cw") + F.col("oi"))
        .filter(F.col("tokens") > 0)
        .withColumn("cost_e6", F.when(F.col("priced"), cost * factor))
    )


def costs(
    events: DataFrame,
    now_ms: int,
    since_ms: int = 0,
    fx: str = str(fixed.DEFAULT_FX),
    book: DataFrame | None = None,
    catalog: DataFrame | None = None,
    extra: dict[str, Column] | None = None,
) -> DataFrame:
    """Grouped events with their cost: the whole chain in one call."""
    groups = cost_groups(events, since_ms, extra=extra)
    return price_groups(resolve_price(groups, now_ms, fx, book, catalog))


def cost_by(priced_groups: DataFrame, *keys: str) -> DataFrame:
    """Cost and tokens of priced groups by the given keys."""
    return (
        priced_groups.filter("priced")
        .groupBy(*keys)
        .agg(money(F.sum("cost_e6")).alias("cost_cny"), F.sum("tokens").alias("tokens"))
    )


def unpriced_models(priced_groups: DataFrame) -> DataFrame:
    return priced_groups.filter("NOT priced").select("model").distinct()


def unpriced_tokens(priced_groups: DataFrame) -> DataFrame:
    return (
        priced_groups.filter("NOT priced")
        .groupBy("tool", "model")
        .agg(F.sum("tokens").alias("tokens"))
    )


def cost_windows(events: DataFrame, now_ms: int, tz: str = "UTC", **prices) -> DataFrame:
    """One row: cost of today, of the last 7 days, and of all history; one scan."""
    priced = costs(events, now_ms, extra={"age": _age(now_ms, tz)}, **prices)

    def window(at_least: int) -> Column:
        return money(F.coalesce(F.sum(F.when(F.col("age") >= at_least, F.col("cost_e6"))), F.lit(0)))

    return priced.agg(
        window(2).alias("today_cny"), window(1).alias("last7d_cny"), window(0).alias("all_cny")
    )


def _age(now_ms: int, tz: str) -> Column:
    return (
        F.when(F.col("ts_ms") >= local_day_start(now_ms, 0, tz), 2)
        .when(F.col("ts_ms") >= local_range_start(7, now_ms, tz), 1)
        .otherwise(0)
    )


def cost_by_day_model(
    events: DataFrame, days: int, now_ms: int, tz: str = "UTC", **prices
) -> DataFrame:
    """Cost by local day and model within the range."""
    start = local_range_start(days, now_ms, tz)
    priced = costs(
        events, now_ms, start, extra={"day": local_day(F.col("ts_ms"), tz)}, **prices
    )
    return cost_by(priced, "day", "model").drop("tokens")


def cost_by_day_map(day_model: DataFrame) -> DataFrame:
    """One row per day with a map model -> cost and the total; null models carry an empty name."""
    entry = F.struct(F.coalesce("model", F.lit("")).alias("model"), F.col("cost_cny"))
    return day_model.groupBy("day").agg(
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("models"),
        F.round(F.sum(F.col("cost_cny").cast("decimal(28,6)")).cast("double"), 6).alias("total"),
    )


# ---------------------------------------------------------------- money against accounts


def api_billed_tools() -> list[str]:
    return [tool for tool, _, _, _, billed, _ in fixed.SOURCES if billed]


def subscription_tools() -> list[str]:
    return [tool for tool, *_, subscribed in fixed.SOURCES if subscribed]


def balance_recon(
    balances: DataFrame, events: DataFrame, now_ms: int, hours: int = 24, **prices
) -> DataFrame:
    """Balance change against computed spend per provider over the last hours.

    Spend counts tools billed to the user's own wallet and models of the direct account.
    """
    since_ms = now_ms - hours * fixed.HOUR_MS
    order = F.struct("ts_ms", "event_id") if "event_id" in balances.columns else F.col("ts_ms")
    newest = balances.groupBy("provider").agg(F.max_by("balance", order).alias("balance"))
    provider = F.lit(None).cast("string")
    known = F.lit(False)
    for name, prefix in fixed.PROVIDER_PREFIXES.items():
        provider = F.when(model_prefix(F.col("model"), prefix), F.lit(name)).otherwise(provider)
        known = known | (F.col("provider") == name)
    billed = events.filter(F.col("tool").isin(api_billed_tools()))
    spend = (
        costs(billed, now_ms, since_ms, **prices)
        .withColumn("provider", provider)
        .filter(F.col("provider").isNotNull())
        .groupBy("provider")
        .agg(F.sum("cost_e6").alias("spent"))
    )
    joined = newest.join(balance_delta(balances, since_ms), "provider", "left").join(
        spend, "provider", "left"
    )
    return joined.select(
        "provider",
        "balance",
        "delta",
        F.when(
            F.col("delta").isNotNull() & known, money(F.coalesce("spent", F.lit(0)))
        ).alias("spend"),
        F.lit(hours).alias("hours"),
    )


SUBSCRIPTION_SCHEMA = (
    "key string, tool string, name string, models string, price_cny double, price_usd double"
)


def subscriptions(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Subscription list: key, tool (null = key), name, model prefix, monthly price."""
    return literal_table(spark, rows, SUBSCRIPTION_SCHEMA).withColumn(
        "tool", F.coalesce("tool", "key")
    )


def subscription_roi(
    events: DataFrame,
    credits: DataFrame,
    subs: DataFrame,
    now_ms: int,
    tz: str = "UTC",
    fx: str = str(fixed.DEFAULT_FX),
    **prices,
) -> DataFrame:
    """API-equivalent value of the local month against each monthly fee."""
    start = local_month_start(now_ms, tz)
    priced = costs(events, now_ms, start, fx=fx, **prices)
    usage = priced.groupBy("tool", "model").agg(
        F.sum("cost_e6").alias("cost_e6"),
        F.sum(F.when(~F.col("priced"), F.col("tokens"))).alias("unpriced"),
    )
    matched = F.col("models").isNull() | model_prefix_loose(F.col("model"), F.col("models"))
    per_sub = (
        usage.join(subs, "tool")
        .filter(matched)
        .groupBy("key")
        .agg(
            F.coalesce(F.sum("cost_e6"), F.lit(0)).alias("cost_e6"),
            F.coalesce(F.sum("unpriced"), F.lit(0)).alias("unpriced"),
        )
    )
    month_credits = (
        since(credits, start)
        .groupBy("tool")
        .agg(F.sum(F.col("amount").cast("decimal(28,6)")).cast("double").alias("tool_credits"))
    )
    labels = literal_table(
        events.sparkSession, [(t, label) for t, label, *_ in fixed.SOURCES], "tool string, label string"
    )
    joined = (
        subs.join(per_sub, "key", "left")
        .join(month_credits, "tool", "left")
        .join(labels, "tool", "left")
    )
    api = F.coalesce(F.col("cost_e6"), F.lit(0)).cast("double") / 1e6
    unpriced = F.coalesce(F.col("unpriced"), F.lit(0))
    credit = F.when(F.col("models").isNull(), F.col("tool_credits"))
    paid = F.coalesce(F.col("price_cny"), F.col("price_usd") * float(fx))
    missing = F.when(
        credit.isNull() & (unpriced > 0), F.when(api > 0, F.lit("partial")).otherwise(F.lit("all"))
    )
    ratio = F.when(
        paid.isNotNull() & credit.isNull() & ~F.coalesce(missing == "all", F.lit(False)),
        F.when(api > 0, F.try_divide(api, paid)).otherwise(F.lit(0.0)),
    )

    def rounded(c: Column, scale: int) -> Column:
        return F.floor(c * scale + 0.5) / scale

    return joined.select(
        "key",
        "tool",
        F.lower("models").alias("models"),
        F.coalesce("name", "label", "tool").alias("name"),
        rounded(api, 10_000).alias("api_cny"),
        credit.alias("credits"),
        rounded(paid, 100).alias("paid_cny"),
        ratio.alias("ratio"),
        missing.alias("price_missing"),
        unpriced.cast("long").alias("unpriced_tokens"),
    )


def roi_hint(events: DataFrame, now_ms: int, tz: str = "UTC", **prices) -> DataFrame:
    """Month's API-equivalent spend of subscription tools, shown while no fee is configured."""
    rows = events.filter(F.col("tool").isin(subscription_tools()))
    priced = costs(rows, now_ms, local_month_start(now_ms, tz), **prices)
    spend = F.coalesce(F.sum("cost_e6"), F.lit(0)).cast("double") / 1e6
    return priced.agg(spend.alias("s")).select(
        F.when(F.col("s") > 0, F.floor(F.col("s") * 100 + 0.5) / 100).alias("sub_tools_api_cny")
    )


def blended_roi(roi: DataFrame) -> DataFrame:
    """Ratio of sums over paid, priced, token-billed entries, one decimal."""
    counted = roi.filter(
        F.col("paid_cny").isNotNull()
        & ~F.coalesce(F.col("price_missing") == "all", F.lit(False))
        & F.col("credits").isNull()
    )
    sums = counted.agg(
        F.sum(F.col("api_cny").cast("decimal(28,4)")).cast("double").alias("api"),
        F.sum(F.col("paid_cny").cast("decimal(28,2)")).cast("double").alias("paid"),
    )
    meaningful = (F.col("paid") > 0) & (F.col("api") > 0)
    return sums.select(
        F.when(meaningful, F.floor(F.col("api") / F.col("paid") * 10 + 0.5) / 10).alias("roi_ratio")
    )


# ------------------------------------------------------------------ learned credit rates


def read_credit_map(ledger: DataFrame, column: str = "credit_json") -> DataFrame:
    """Credits per trace from JSON maps; the last row of a trace wins, bad rows are skipped."""
    order = "ord" if "ord" in ledger.columns else column
    return (
        ledger.select(
            F.explode(F.from_json(F.col(column), "map<string,double>")).alias("trace_id", "credits"),
            F.col(order).alias("o"),
        )
        .groupBy("trace_id")
        .agg(F.max_by("credits", "o").alias("credits"))
    )


def learn_credit_rates(
    events: DataFrame, credit_map: DataFrame, tool: str = "workbuddy", min_samples: int = 3
) -> DataFrame:
    """Credits per million fresh, cached and output tokens of each model, by least squares.

    The normal equations are exact decimal sums per model; only single-model traces count.
    Models with a singular system or a negative rate give no row.
    """
    per_trace = (
        events.filter((F.col("tool") == tool) & F.col("trace_id").isNotNull())
        .groupBy("trace_id", "model")
        .agg(
            F.sum("input_tokens").alias("fi"),
            F.sum("cached_input").alias("ci"),
            F.sum("output_tokens").alias("oi"),
        )
        .groupBy("trace_id")
        .agg(
            F.count(F.lit(1)).alias("models"),
            F.max_by(F.struct("model", "fi", "ci", "oi"), F.struct("model", "fi")).alias("r"),
        )
        .filter((F.col("models") == 1) & F.col("r.model").isNotNull())
        .select("trace_id", "r.*")
    )
    samples = per_trace.join(credit_map, "trace_id").filter(F.col("credits").isNotNull())
    names = ["fi", "ci", "oi"]
    exact = {n: F.col(n).cast("decimal(18,0)") for n in names}
    credit = F.col("credits").cast("decimal(18,6)")

    def moment(a: Column, b: Column, scale: float) -> Column:
        return F.sum(a * b).cast("double") / scale

    sums = samples.groupBy("model").agg(
        F.count(F.lit(1)).alias("turns"),
        *[
            moment(exact[a], exact[b], 1e12).alias(f"{a}_{b}")
            for i, a in enumerate(names)
            for b in names[i:]
        ],
        *[moment(exact[a], credit, 1e6).alias(f"{a}_cr") for a in names],
    )
    m = {
        (a, b): F.col(f"{a}_{b}" if i <= j else f"{b}_{a}")
        for i, a in enumerate(names)
        for j, b in enumerate(names)
    }
    columns = [[m[a, b] for a in names] for b in names]
    right = [F.col(f"{a}_cr") for a in names]

    def det3(c: list[list[Column]]) -> Column:
        (a, d, g), (b, e, h), (cc, f, i) = c
        return a * (e * i - f * h) - b * (d * i - f * g) + cc * (d * h - e * g)

    minor2 = m["fi", "fi"] * m["ci", "ci"] - m["fi", "ci"] * m["fi", "ci"]
    solved = (
        sums.filter(F.col("turns") >= min_samples)
        .withColumn("det", det3(columns))
        .withColumn("minor2", minor2)
        # the three pivots of the symmetric system
        .filter(F.col("fi_fi") >= 1e-12)
        .filter(F.try_divide("minor2", "fi_fi") >= 1e-12)
        .filter(F.try_divide("det", "minor2") >= 1e-12)
        .select(
            "model",
            "turns",
            F.try_divide(det3([right, columns[1], columns[2]]), F.col("det")).alias("fresh_rate"),
            F.try_divide(det3([columns[0], right, columns[2]]), F.col("det")).alias("cache_rate"),
            F.try_divide(det3([columns[0], columns[1], right]), F.col("det")).alias("out_rate"),
        )
        .filter("fresh_rate >= 0 AND cache_rate >= 0 AND out_rate >= 0")
    )
    fitted = (
        F.col("fresh_rate") * F.col("fi") + F.col("cache_rate") * F.col("ci") + F.col("out_rate") * F.col("oi")
    ) / 1e6
    residual = (
        salted_join(samples, solved, ["model"], spread_by="trace_id")
        .groupBy("model")
        .agg(F.max(F.abs(fitted - F.col("credits"))).alias("max_residual"))
    )
    return solved.join(residual, "model")
