"""Queries: prices, costs, reconciliation, subscription return, learned rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from usagelens import fixed
from usagelens.functions.times import local_day_start, local_month_start, local_range_start
from usagelens.operators import cost
from usagelens.plans import views as v
from usagelens.plans.registry import query
from usagelens.plans.views import FX, NOW_MS
from usagelens.sources import configs

LATER_MS = 1_796_083_200_000 + 1  # after a listed price change


def _sql_value(x) -> str:
    if x is None:
        return "NULL"
    return str(x).lower() if isinstance(x, bool) else f"'{x}'"


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(_sql_value(x) for x in row) + ")" for row in rows)


PEAK = """(isodow(epoch_ms(ts_ms)) <= 5 AND (hour(epoch_ms(ts_ms)) BETWEEN 1 AND 3 OR hour(epoch_ms(ts_ms)) BETWEEN 6 AND 9))"""
LONG = "(tool NOT IN ('cursor', 'grok') AND input_tokens + cached_input + cache_write >= 200000)"
SUMS = """CAST(sum(input_tokens) AS BIGINT) AS fi, CAST(sum(cached_input) AS BIGINT) AS ci,
      CAST(sum(cache_write) AS BIGINT) AS cw, CAST(sum(output_tokens) AS BIGINT) AS oi"""


def price_views(now_ms: int = NOW_MS, source: str = "usage_events") -> dict[str, str]:
    """The price chain as SQL: groups by age and day, then unit prices, then cost."""
    listed = [
        (m, t, long, c, *p)
        for m, t, long, start, end, c, *p in fixed.OFFICIAL_PRICES
        if (start is None or now_ms >= start) and (end is None or now_ms < end)
    ]
    money = "CASE WHEN {p}.currency = 'USD' THEN CAST(round({p}.{f} * 7.2, 6) AS DECIMAL(12,6)) ELSE {p}.{f} END"

    def unit(f: str) -> str:
        u, o = money.format(p="u", f=f), money.format(p="o", f=f)
        if f == "write":
            return f"CASE WHEN u.model IS NOT NULL AND u.{f} IS NOT NULL THEN {u} WHEN o.model IS NOT NULL THEN {o} WHEN u.model IS NOT NULL THEN 0 END"
        return f"CASE WHEN u.model IS NOT NULL THEN {u} WHEN o.model IS NOT NULL THEN {o} END"

    def cells(alias: str) -> str:
        return ", ".join(f"CAST({c} AS DECIMAL(12,6)) AS {c}" for c in ("input", "cached", "output", "write"))

    return {
        "listed": f"SELECT model, tool, CAST(long AS BOOLEAN) AS long, currency, {cells('l')} FROM (VALUES {_values(listed)}) l(model, tool, long, currency, input, cached, output, write)",
        "book": f"SELECT model, currency, {cells('b')}, CAST(off_peak AS DECIMAL(3,2)) AS off_peak FROM (VALUES {_values(fixed.SEED_PRICES)}) b(model, currency, input, cached, output, write, off_peak)",
        "cost_groups": f"""SELECT tool, model, {PEAK} AS peak, {LONG} AS long_context, CAST(epoch_ms(ts_ms) AS DATE) AS day,
            CASE WHEN ts_ms >= {local_day_start(NOW_MS)} THEN 2 WHEN ts_ms >= {local_range_start(7, NOW_MS)} THEN 1 ELSE 0 END AS age,
            ts_ms >= {NOW_MS - 86_400_000} AS recent, {SUMS}
          FROM {source} GROUP BY ALL""",
        "priced": f"""SELECT g.*, {unit('input')} AS pi, {unit('cached')} AS pc, {unit('write')} AS pw, {unit('output')} AS po,
            coalesce(u.off_peak, 1) AS off_peak, fi + ci + cw + oi AS tokens
          FROM cost_groups g LEFT JOIN book u ON u.model = g.model
          LEFT JOIN listed o ON o.model = g.model AND (o.tool IS NULL OR o.tool = g.tool) AND (o.long IS NULL OR o.long = g.long_context)
          WHERE fi + ci + cw + oi > 0""",
        "charged": """SELECT *, pi IS NOT NULL AS has_price, (CAST(fi AS DECIMAL(18,0)) * CAST(pi AS DECIMAL(12,6)) + CAST(ci AS DECIMAL(18,0)) * CAST(pc AS DECIMAL(12,6))
            + CAST(cw AS DECIMAL(18,0)) * CAST(pw AS DECIMAL(12,6)) + CAST(oi AS DECIMAL(18,0)) * CAST(po AS DECIMAL(12,6)))
            * CAST(CASE WHEN peak THEN 1 ELSE off_peak END AS DECIMAL(3,2)) AS cost_e6 FROM priced""",
    }


VIEWS = price_views()
MONEY = "round(CAST(sum(cost_e6) AS DOUBLE) / 1e6, 6)"


@query(
    "cost_groups",
    f"""SELECT tool, model, {PEAK} AS peak, {LONG} AS long_context, {SUMS} FROM usage_events GROUP BY ALL""",
)
def _(spark, d):
    return cost.cost_groups(v.usage_events(spark, d))


@query(
    "official_price",
    """SELECT DISTINCT g.tool, g.model, g.long_context,
      CAST(CASE WHEN o.currency = 'USD' THEN round(o.input * 7.2, 6) ELSE o.input END AS DOUBLE) AS input_cny,
      CAST(CASE WHEN o.currency = 'USD' THEN round(o.output * 7.2, 6) ELSE o.output END AS DOUBLE) AS output_cny
    FROM cost_groups g LEFT JOIN listed o ON o.model = g.model AND (o.tool IS NULL OR o.tool = g.tool) AND (o.long IS NULL OR o.long = g.long_context)""",
    VIEWS,
)
def _(spark, d):
    groups = cost.cost_groups(v.usage_events(spark, d)).select("tool", "model", "long_context").distinct()
    return cost.official_price(groups, NOW_MS, FX).select(
        "tool",
        "model",
        "long_context",
        F.col("official_input").cast("double").alias("input_cny"),
        F.col("official_output").cast("double").alias("output_cny"),
    )


# the same requests billed under models whose list price changes over time or depends on the tool
DATED = """SELECT * REPLACE (CASE k % 5 WHEN 0 THEN 'gemini-4-argon' WHEN 1 THEN 'gemini-3.8-flash' WHEN 2 THEN 'grok-4.7-fast'
    WHEN 3 THEN 'claude-opus-5-5-max' ELSE 'step-5-preview' END AS model) FROM usage_rows"""


@query(
    "official_price_dated",
    f"SELECT tool, model, {MONEY} AS cost_cny, CAST(sum(tokens) AS BIGINT) AS tokens FROM charged WHERE has_price GROUP BY tool, model",
    {"dated_events": DATED, **price_views(LATER_MS, "dated_events")},
)
def _(spark, d):
    k = F.col("k")
    model = (
        F.when(k % 5 == 0, "gemini-4-argon")
        .when(k % 5 == 1, "gemini-3.8-flash")
        .when(k % 5 == 2, "grok-4.7-fast")
        .when(k % 5 == 3, "claude-opus-5-5-max")
        .otherwise("step-5-preview")
    )
    rows = v.usage_rows(spark, d).withColumn("model", model)
    return cost.cost_by(cost.costs(rows, LATER_MS, fx=FX), "tool", "model")


@query(
    "price_groups",
    """SELECT tool, model, peak, long_context, CAST(sum(tokens) AS BIGINT) AS tokens, round(CAST(sum(cost_e6) AS DOUBLE) / 1e6, 6) AS cost_cny
    FROM charged GROUP BY ALL""",
    VIEWS,
)
def _(spark, d):
    priced = cost.costs(v.usage_events(spark, d), NOW_MS, fx=FX)
    return priced.select(
        "tool", "model", "peak", "long_context", "tokens", cost.money(F.col("cost_e6")).alias("cost_cny")
    )


# a user book overriding a list price, and a catalog for models without one
USER_BOOK = [
    ("claude-opus-5-5", "USD", "3", "0.3", "15", None, None),
    ("deepseek-v4-pro", "USD", "1", "0.05", "2", "1.5", "0.25"),
]


@query(
    "resolve_price",
    """WITH cat AS (SELECT * FROM (VALUES ('mystery-model', 0.5, 0.1, 2.0, 0.25)) c(model, i, c, o, w)),
    g AS (SELECT DISTINCT tool, model, long_context FROM cost_groups)
    SELECT g.tool, g.model, g.long_context, CAST(CASE WHEN g.model = 'claude-opus-5-5' THEN 21.6 WHEN g.model = 'deepseek-v4-pro' THEN 7.2
        WHEN l.model IS NOT NULL THEN CASE l.currency WHEN 'USD' THEN round(l.input * 7.2, 6) ELSE l.input END
        WHEN cat.model IS NOT NULL THEN cat.i * 7.2 END AS DOUBLE) AS input_cny,
      CAST(CASE WHEN g.model = 'claude-opus-5-5' THEN 36 WHEN g.model = 'deepseek-v4-pro' THEN 10.8
        WHEN l.model IS NOT NULL THEN CASE l.currency WHEN 'USD' THEN round(l.write * 7.2, 6) ELSE l.write END
        WHEN cat.model IS NOT NULL THEN cat.w * 7.2 END AS DOUBLE) AS write_cny,
      CAST(CASE WHEN g.model = 'deepseek-v4-pro' THEN 0.25 ELSE 1 END AS DOUBLE) AS off_peak
    FROM g LEFT JOIN listed l ON l.model = g.model AND (l.tool IS NULL OR l.tool = g.tool) AND (l.long IS NULL OR l.long = g.long_context)
    LEFT JOIN cat ON cat.model = g.model""",
    VIEWS,
)
def _(spark, d):
    groups = cost.cost_groups(v.usage_events(spark, d)).select("tool", "model", "long_context").distinct()
    catalog = configs.price_catalog_rows(
        spark,
        [("azure/mystery-model", 9e-7, 1e-7, 2e-6, 1e-7), ("vendor/mystery-model", 5e-7, 1e-7, 2e-6, 2.5e-7)],
    )
    out = cost.resolve_price(groups, NOW_MS, FX, cost.price_book(spark, USER_BOOK), catalog)
    return out.select(
        "tool",
        "model",
        "long_context",
        F.col("input_cny").cast("double"),
        F.col("write_cny").cast("double"),
        F.col("off_peak").cast("double"),
    )


@query(
    "cost_by_model",
    f"SELECT model, {MONEY} AS cost_cny, CAST(sum(tokens) AS BIGINT) AS tokens FROM charged WHERE has_price GROUP BY model",
    VIEWS,
)
def _(spark, d):
    return cost.cost_by(cost.costs(v.usage_events(spark, d), NOW_MS, fx=FX), "model")


@query(
    "cost_by_tool",
    f"SELECT tool, {MONEY} AS cost_cny, CAST(sum(tokens) AS BIGINT) AS tokens FROM charged WHERE has_price GROUP BY tool",
    VIEWS,
)
def _(spark, d):
    return cost.cost_by(cost.costs(v.usage_events(spark, d), NOW_MS, fx=FX), "tool")


@query(
    "cost_by_tool_model",
    f"SELECT tool, model, {MONEY} AS cost_cny, CAST(sum(tokens) AS BIGINT) AS tokens FROM charged WHERE has_price GROUP BY tool, model",
    VIEWS,
)
def _(spark, d):
    return cost.cost_by(cost.costs(v.usage_events(spark, d), NOW_MS, fx=FX), "tool", "model")


@query("unpriced_models", "SELECT DISTINCT model FROM charged WHERE NOT has_price", VIEWS)
def _(spark, d):
    return cost.unpriced_models(cost.costs(v.usage_events(spark, d), NOW_MS, fx=FX))


@query(
    "unpriced_tokens",
    "SELECT tool, model, CAST(sum(tokens) AS BIGINT) AS tokens FROM charged WHERE NOT has_price GROUP BY tool, model",
    VIEWS,
)
def _(spark, d):
    return cost.unpriced_tokens(cost.costs(v.usage_events(spark, d), NOW_MS, fx=FX))


def _window(age: int) -> str:
    return f"round(CAST(coalesce(sum(cost_e6) FILTER (age >= {age}), 0) AS DOUBLE) / 1e6, 6)"


@query(
    "cost_windows",
    f"SELECT {_window(2)} AS today_cny, {_window(1)} AS last7d_cny, {_window(0)} AS all_cny FROM charged",
    VIEWS,
)
def _(spark, d):
    return cost.cost_windows(v.usage_events(spark, d), NOW_MS, fx=FX)


@query(
    "cost_today_by_tool",
    f"SELECT tool, {MONEY} AS cost_cny, CAST(sum(tokens) AS BIGINT) AS tokens FROM charged WHERE has_price AND age = 2 GROUP BY tool",
    VIEWS,
)
def _(spark, d):
    start = local_day_start(NOW_MS)
    return cost.cost_by(cost.costs(v.usage_events(spark, d, start), NOW_MS, start, fx=FX), "tool")


@query(
    "cost_by_day_model",
    f"SELECT day, model, {MONEY} AS cost_cny FROM charged WHERE has_price AND age >= 1 GROUP BY day, model",
    VIEWS,
)
def _(spark, d):
    start = local_range_start(7, NOW_MS)
    return cost.cost_by_day_model(v.usage_events(spark, d, start), 7, NOW_MS, fx=FX)


@query(
    "cost_by_day",
    f"""WITH m AS (SELECT day, model, {MONEY} AS cost_cny FROM charged WHERE has_price AND age >= 1 GROUP BY day, model)
    SELECT day, string_agg(coalesce(model, ''), ',' ORDER BY coalesce(model, '')) AS models,
      round(CAST(sum(CAST(cost_cny AS DECIMAL(28,6))) AS DOUBLE), 6) AS total FROM m GROUP BY day""",
    VIEWS,
)
def _(spark, d):
    start = local_range_start(7, NOW_MS)
    day_model = cost.cost_by_day_model(v.usage_events(spark, d, start), 7, NOW_MS, fx=FX)
    out = cost.cost_by_day_map(day_model)
    return out.withColumn("models", F.array_join(F.array_sort(F.map_keys("models")), ","))


@query(
    "balance_recon",
    f"""WITH n AS (SELECT provider, first(balance ORDER BY ts_ms DESC, event_id DESC) AS balance FROM balance_history GROUP BY 1),
    dl AS (SELECT provider, count(*) AS points, CAST(last(CAST(balance AS DECIMAL(28,6)) ORDER BY ts_ms, event_id)
        - first(CAST(balance AS DECIMAL(28,6)) ORDER BY ts_ms, event_id) AS DOUBLE) AS delta
      FROM balance_history WHERE ts_ms >= {NOW_MS - 86_400_000} GROUP BY 1),
    s AS (SELECT split_part(model, '-', 1) AS provider, sum(cost_e6) AS spent FROM charged
      WHERE recent AND has_price AND tool IN ('ccmr', 'dsh') AND split_part(model, '-', 1) IN ('deepseek', 'kimi', 'glm') GROUP BY 1)
    SELECT provider, balance, CASE WHEN points >= 2 THEN delta END AS delta,
      CASE WHEN points >= 2 THEN round(CAST(coalesce(spent, 0) AS DOUBLE) / 1e6, 6) END AS spend, 24 AS hours
    FROM n LEFT JOIN dl USING (provider) LEFT JOIN s USING (provider)""",
    VIEWS,
)
def _(spark, d):
    return cost.balance_recon(
        v.balance_history(spark, d), v.usage_events(spark, d, NOW_MS - 86_400_000), NOW_MS, fx=FX
    )


SUBS = [
    ("claude-code", None, "Max plan", None, None, 200.0),
    ("codex-kimi", "codex", None, "Kimi", 49.0, None),
    ("codex-all", "codex", None, "grok", None, None),
    ("cursor", None, None, None, None, 20.0),
    ("pi-mystery", "pi", "Pi", "mystery", 10.0, None),
    ("hermes", None, None, None, 30.0, None),
]
MONTH = local_month_start(NOW_MS)
ROI_SQL = f"""
    WITH subs AS (SELECT * FROM (VALUES ('claude-code', 'claude-code', 'Max plan', NULL, 200 * 7.2), ('codex-kimi', 'codex', 'Codex', 'kimi', 49),
        ('codex-all', 'codex', 'Codex', 'grok', NULL), ('cursor', 'cursor', 'Cursor', NULL, 20 * 7.2),
        ('pi-mystery', 'pi', 'Pi', 'mystery', 10), ('hermes', 'hermes', 'Hermes', NULL, 30)) s(key, tool, name, models, paid)),
    u AS (SELECT tool, model, sum(cost_e6) AS cost_e6, sum(tokens) FILTER (NOT has_price) AS unpriced FROM charged WHERE day >= DATE '2024-01-01' GROUP BY 1, 2),
    p AS (SELECT s.key, coalesce(sum(cost_e6), 0) AS cost_e6, coalesce(sum(unpriced), 0) AS unpriced FROM subs s JOIN u ON u.tool = s.tool
      AND (s.models IS NULL OR starts_with(lower(coalesce(u.model, '')), s.models)) GROUP BY 1),
    c AS (SELECT tool, CAST(sum(CAST(amount AS DECIMAL(28,6))) AS DOUBLE) AS credits FROM credit_usage WHERE ts_ms >= {MONTH} GROUP BY 1),
    j AS (SELECT s.key, s.tool, s.models, s.name, CAST(coalesce(p.cost_e6, 0) AS DOUBLE) / 1e6 AS api, CAST(coalesce(p.unpriced, 0) AS BIGINT) AS unpriced_tokens,
        CASE WHEN s.models IS NULL THEN c.credits END AS credits, CAST(s.paid AS DOUBLE) AS paid
      FROM subs s LEFT JOIN p USING (key) LEFT JOIN c ON c.tool = s.tool),
    m AS (SELECT *, CASE WHEN credits IS NOT NULL OR unpriced_tokens <= 0 THEN NULL WHEN api > 0 THEN 'partial' ELSE 'all' END AS price_missing FROM j)"""


@query(
    "subscription_roi",
    ROI_SQL
    + """
    SELECT key, tool, models, name, floor(api * 10000 + 0.5) / 10000 AS api_cny, credits, floor(paid * 100 + 0.5) / 100 AS paid_cny,
      CASE WHEN paid IS NULL OR credits IS NOT NULL OR price_missing = 'all' THEN NULL WHEN api > 0 THEN api / paid ELSE CAST(0 AS DOUBLE) END AS ratio,
      price_missing, unpriced_tokens FROM m""",
    VIEWS,
)
def _(spark, d):
    return _roi(spark, d)


def _roi(spark, d):
    return cost.subscription_roi(
        v.usage_events(spark, d, MONTH),
        v.credit_usage(spark, d, MONTH),
        cost.subscriptions(spark, SUBS),
        NOW_MS,
        fx=FX,
    )


@query(
    "blended_roi",
    ROI_SQL
    + """,
    b AS (SELECT CAST(sum(CAST(floor(api * 10000 + 0.5) / 10000 AS DECIMAL(28,4))) AS DOUBLE) AS a,
      CAST(sum(CAST(floor(paid * 100 + 0.5) / 100 AS DECIMAL(28,2))) AS DOUBLE) AS p FROM m
      WHERE paid IS NOT NULL AND credits IS NULL AND coalesce(price_missing, '') <> 'all')
    SELECT CASE WHEN a > 0 AND p > 0 THEN floor(a / p * 10 + 0.5) / 10 END AS roi_ratio FROM b""",
    VIEWS,
)
def _(spark, d):
    return cost.blended_roi(_roi(spark, d))


@query(
    "roi_hint",
    """SELECT floor(CAST(sum(cost_e6) AS DOUBLE) / 1e6 * 100 + 0.5) / 100 AS sub_tools_api_cny FROM charged
    WHERE day >= DATE '2024-01-01' AND tool IN ('claude-code', 'codex', 'zcode', 'grok', 'workbuddy', 'antigravity', 'kimi', 'qoder', 'doubao', 'doubaowork', 'cursor')""",
    VIEWS,
)
def _(spark, d):
    return cost.roi_hint(v.usage_events(spark, d, MONTH), NOW_MS, fx=FX)


# one model per trace; credits follow the token sums up to a small trace-dependent error
RATE_ROWS = """SELECT 't' || user_id || '-' || (k % 20) AS trace_id, CASE WHEN k % 20 < 17 THEN 'm' || user_id % 3 ELSE 'm' || k % 7 END AS model,
    input_tokens, cached_input, output_tokens * (1 + k % 7) AS output_tokens, user_id FROM usage_rows"""


def _rate_rows(spark, d):
    k, user = F.col("k"), F.col("user_id")
    trace = F.concat(F.lit("t"), user.cast("string"), F.lit("-"), (k % 20).cast("string"))
    model = F.concat(F.lit("m"), F.when(k % 20 < 17, user % 3).otherwise(k % 7).cast("string"))
    return v.usage_rows(spark, d).select(
        F.lit("workbuddy").alias("tool"),
        trace.alias("trace_id"),
        model.alias("model"),
        "input_tokens",
        "cached_input",
        # output must not be a multiple of the input, or the system is singular
        (F.col("output_tokens") * (1 + k % 7)).alias("output_tokens"),
        "user_id",
    )


def _det(a: str, b: str, c: str) -> str:
    (a1, a2, a3), (b1, b2, b3), (c1, c2, c3) = (x.split() for x in (a, b, c))
    return f"({a1} * ({b2} * {c3} - {c2} * {b3}) - {b1} * ({a2} * {c3} - {c2} * {a3}) + {c1} * ({a2} * {b3} - {b2} * {a3}))"


CF, CC, CO, CR = "ff fc fo", "fc cc co", "fo co oo", "fr cr orr"


@query(
    "learn_credit_rates",
    f"""WITH t AS (SELECT trace_id, model, sum(input_tokens) AS fi, sum(cached_input) AS ci, sum(output_tokens) AS oi FROM rate_rows GROUP BY 1, 2),
    s AS (SELECT trace_id, any_value(model) AS model, CAST(any_value(fi) AS DECIMAL(18,0)) AS fi, CAST(any_value(ci) AS DECIMAL(18,0)) AS ci, CAST(any_value(oi) AS DECIMAL(18,0)) AS oi
      FROM t GROUP BY 1 HAVING count(*) = 1),
    c AS (SELECT trace_id, CAST(sum(3 * input_tokens + cached_input + 8 * output_tokens) // 1000 AS DOUBLE) AS cr FROM rate_rows GROUP BY 1),
    n AS (SELECT model, count(*) AS turns, CAST(sum(fi * fi) AS DOUBLE) / 1e12 AS ff, CAST(sum(fi * ci) AS DOUBLE) / 1e12 AS fc, CAST(sum(fi * oi) AS DOUBLE) / 1e12 AS fo,
        CAST(sum(ci * ci) AS DOUBLE) / 1e12 AS cc, CAST(sum(ci * oi) AS DOUBLE) / 1e12 AS co, CAST(sum(oi * oi) AS DOUBLE) / 1e12 AS oo,
        CAST(sum(fi * CAST(cr AS DECIMAL(18,6))) AS DOUBLE) / 1e6 AS fr, CAST(sum(ci * CAST(cr AS DECIMAL(18,6))) AS DOUBLE) / 1e6 AS cr,
        CAST(sum(oi * CAST(cr AS DECIMAL(18,6))) AS DOUBLE) / 1e6 AS orr
      FROM s JOIN c USING (trace_id) GROUP BY model HAVING count(*) >= 3),
    x AS (SELECT model, turns, {_det(CF, CC, CO)} AS det, ff * cc - fc * fc AS m2, ff, {_det(CR, CC, CO)} AS d1, {_det(CF, CR, CO)} AS d2, {_det(CF, CC, CR)} AS d3 FROM n),
    r AS (SELECT model, turns, d1 / det AS fresh_rate, d2 / det AS cache_rate, d3 / det AS out_rate FROM x
      WHERE ff >= 1e-12 AND m2 / ff >= 1e-12 AND det / m2 >= 1e-12)
    SELECT r.model, turns, round(fresh_rate, 3) AS fresh_rate, round(cache_rate, 3) AS cache_rate, round(out_rate, 2) AS out_rate,
      round(max(abs((fresh_rate * fi + cache_rate * ci + out_rate * oi) / 1e6 - cr)), 3) AS max_residual
    FROM r JOIN s USING (model) JOIN c USING (trace_id) WHERE fresh_rate >= 0 AND cache_rate >= 0 AND out_rate >= 0 GROUP BY ALL""",
    {"rate_rows": RATE_ROWS},
)
def _(spark, d):
    rows = _rate_rows(spark, d)
    points = 3 * F.col("input_tokens") + F.col("cached_input") + 8 * F.col("output_tokens")
    ledger = (
        rows.groupBy("trace_id")
        .agg(F.floor(F.sum(points) / 1000).cast("double").alias("credits"))
        .select(F.to_json(F.create_map("trace_id", "credits")).alias("credit_json"))
    )
    out = cost.learn_credit_rates(rows, cost.read_credit_map(ledger))
    return out.select(
        "model",
        "turns",
        F.round("fresh_rate", 3).alias("fresh_rate"),
        F.round("cache_rate", 3).alias("cache_rate"),
        F.round("out_rate", 2).alias("out_rate"),
        F.round("max_residual", 3).alias("max_residual"),
    )


@query(
    "trace_credits",
    """WITH t AS (SELECT trace_id, model, CAST(sum(input_tokens) AS BIGINT) AS fi FROM rate_rows GROUP BY 1, 2),
    c AS (SELECT trace_id, CAST(sum(3 * input_tokens + cached_input + 8 * output_tokens) // 1000 AS DOUBLE) AS credits FROM rate_rows WHERE user_id % 2 = 0 GROUP BY 1)
    SELECT trace_id, model, fi, credits FROM t JOIN c USING (trace_id)""",
    {"rate_rows": RATE_ROWS},
)
def _(spark, d):
    rows = _rate_rows(spark, d)
    points = 3 * F.col("input_tokens") + F.col("cached_input") + 8 * F.col("output_tokens")
    ledger = (
        rows.filter("user_id % 2 = 0")
        .groupBy("trace_id")
        .agg(F.floor(F.sum(points) / 1000).cast("double").alias("credits"))
        .select(F.to_json(F.create_map("trace_id", "credits")).alias("credit_json"))
    )
    per_trace = rows.groupBy("trace_id", "model").agg(F.sum("input_tokens").alias("fi"))
    return per_trace.join(cost.read_credit_map(ledger), "trace_id")


@query(
    "fx_rate_asof",
    """WITH r AS (SELECT ts_ms, 5 + (v % 600) / 100 AS rate, event_id FROM usage_rows WHERE ts_ms <= 1706626800000)
    SELECT round(coalesce(first(rate ORDER BY ts_ms DESC, rate DESC), 7.2), 4) AS rate, count(*) > 0 AS found FROM r WHERE rate BETWEEN 5.5 AND 9.5""",
)
def _(spark, d):
    rates = v.usage_rows(spark, d).select("ts_ms", (5 + (F.col("v") % 600) / 100).alias("rate"))
    return configs.fx_rate_asof(rates, NOW_MS)
