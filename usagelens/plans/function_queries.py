"""Queries: column functions over whole texts and tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from usagelens import fixed
from usagelens.functions import keys, names, predicates, times
from usagelens.functions import variants as V
from usagelens.plans import views as v
from usagelens.plans.registry import query
from usagelens.plans.views import NOW_MS

WS = fixed.WHITESPACE


def _trim_sql(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def _norm_sql(c: str) -> str:
    n = f"nullif(lower({_trim_sql(c)}), '')"
    n = f"regexp_replace({n}, '^cursor-(.+)$', '\\1')"
    n = f"regexp_replace({n}, '^(.+?)(?:-(?:low|medium|high))+$', '\\1')"
    return f"CASE {n} WHEN 'deepseek-flash' THEN 'deepseek-v4.1-flash' WHEN 'deepseek-v4-flash' THEN 'deepseek-v4.1-flash' ELSE {n} END"


# raw model spellings derived from the table
RAW_MODEL = """CASE k % 8 WHEN 0 THEN ' Cursor-GPT-' || user_id || '-medium-high ' WHEN 1 THEN 'DeepSeek-V4-Flash' WHEN 2 THEN 'medium'
    WHEN 3 THEN 'glm-' || k || '-Low' WHEN 4 THEN '   ' WHEN 5 THEN 'cursor-deepseek-flash-high' WHEN 6 THEN '-medium-high' ELSE upper(model) END"""


def _raw_model():
    k = F.col("k")
    return (
        F.when(k % 8 == 0, F.concat(F.lit(" Cursor-GPT-"), F.col("user_id").cast("string"), F.lit("-medium-high ")))
        .when(k % 8 == 1, "DeepSeek-V4-Flash")
        .when(k % 8 == 2, "medium")
        .when(k % 8 == 3, F.concat(F.lit("glm-"), k.cast("string"), F.lit("-Low")))
        .when(k % 8 == 4, "   ")
        .when(k % 8 == 5, "cursor-deepseek-flash-high")
        .when(k % 8 == 6, "-medium-high")
        .otherwise(F.upper("model"))
    )


@query(
    "normalize_model",
    f"WITH r AS (SELECT event_id, {RAW_MODEL} AS raw FROM usage_rows) SELECT event_id, raw, {_norm_sql('raw')} AS model FROM r",
)
def _(spark, d):
    rows = v.usage_rows(spark, d).select("event_id", _raw_model().alias("raw"))
    return rows.withColumn("model", names.normalize_model(F.col("raw")))


@query(
    "pricing_model",
    """WITH r AS (SELECT event_id, CASE k % 5 WHEN 0 THEN 'antigravity' WHEN 1 THEN 'kimi' WHEN 2 THEN 'workbuddy' WHEN 3 THEN 'grok' ELSE 'pi' END AS tool,
      CASE v % 7 WHEN 0 THEN 'gemini-3.8-flash-n' WHEN 1 THEN 'k3' WHEN 2 THEN 'kimi-k3-1' WHEN 3 THEN 'hy4-preview-f' WHEN 4 THEN 'grok-4.6-build' WHEN 5 THEN 'grok-4.7-build' ELSE model END AS model FROM usage_rows)
    SELECT event_id, CASE WHEN tool = 'antigravity' AND model = 'gemini-3.8-flash-n' THEN 'gemini-3.8-flash' WHEN tool = 'kimi' AND model = 'k3' THEN 'kimi-k3'
      WHEN tool = 'workbuddy' AND model = 'kimi-k3-1' THEN 'kimi-k3' WHEN tool = 'workbuddy' AND model = 'hy4-preview-f' THEN 'hy4-preview'
      WHEN tool = 'grok' AND regexp_matches(model, '^grok-4\\.[67]-build$') THEN replace(model, '-build', '') ELSE model END AS priced FROM r""",
)
def _(spark, d):
    k, n = F.col("k"), F.col("v")
    tool = F.when(k % 5 == 0, "antigravity").when(k % 5 == 1, "kimi").when(k % 5 == 2, "workbuddy")
    tool = tool.when(k % 5 == 3, "grok").otherwise("pi")
    model = F.when(n % 7 == 0, "gemini-3.8-flash-n").when(n % 7 == 1, "k3").when(n % 7 == 2, "kimi-k3-1")
    model = model.when(n % 7 == 3, "hy4-preview-f").when(n % 7 == 4, "grok-4.6-build")
    model = model.when(n % 7 == 5, "grok-4.7-build").otherwise(F.col("model"))
    return v.usage_rows(spark, d).select("event_id", names.pricing_model(model, tool).alias("priced"))


@query(
    "local_day",
    """SELECT event_id, CAST((epoch_ms(ts_ms) AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Berlin' AS DATE) AS berlin,
      CAST((epoch_ms(ts_ms) AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS DATE) AS new_york, CAST(epoch_ms(ts_ms) AS DATE) AS utc FROM usage_rows""",
)
def _(spark, d):
    ts = F.col("ts_ms")
    return v.usage_rows(spark, d).select(
        "event_id",
        times.local_day(ts, "Europe/Berlin").alias("berlin"),
        times.local_day(ts, "America/New_York").alias("new_york"),
        times.utc_day(ts).alias("utc"),
    )


# order dates span several years, so both daylight-saving changes occur
@query(
    "local_day_start",
    """SELECT o_orderkey, epoch_ms(((date_trunc('day', (l AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York') - INTERVAL 6 DAY) AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC') AS start_ms
    FROM (SELECT o_orderkey, o_orderdate + INTERVAL 3 HOUR AS l FROM orders)""",
)
def _(spark, d):
    orders = v.table(spark, d, "orders")
    ts = F.unix_millis(F.col("o_orderdate").cast("timestamp")) + 3 * fixed.HOUR_MS
    return orders.select(
        "o_orderkey", times.local_day_start_col(ts, -6, "America/New_York").alias("start_ms")
    )


@query(
    "is_peak",
    """SELECT event_id, isodow(epoch_ms(ts_ms)) <= 5 AND hour(epoch_ms(ts_ms)) IN (1, 2, 3, 6, 7, 8, 9) AS peak FROM usage_rows""",
)
def _(spark, d):
    return v.usage_rows(spark, d).select("event_id", times.is_peak(F.col("ts_ms")).alias("peak"))


@query(
    "is_long_context",
    """SELECT event_id, tool NOT IN ('cursor', 'grok') AND input_tokens + cached_input + cache_write >= 200000 AS long_context FROM usage_rows""",
)
def _(spark, d):
    long_context = predicates.is_long_context(
        F.col("tool"), F.col("input_tokens"), F.col("cached_input"), F.col("cache_write")
    )
    return v.usage_rows(spark, d).select("event_id", long_context.alias("long_context"))


CJK = fixed.CJK_CLASS


@query(
    "estimate_tokens",
    f"""WITH t AS (SELECT doc_id, text || '中文かな' || lang AS s FROM documents)
    SELECT doc_id, CAST(length(s) - length(regexp_replace(s, '{CJK}', '', 'g')) + ceil(length(regexp_replace(s, '{CJK}', '', 'g')) / 4) AS BIGINT) AS tokens FROM t""",
)
def _(spark, d):
    text = F.concat("text", F.lit("中文かな"), "lang")
    return v.table(spark, d, "documents").select("doc_id", names.estimate_tokens(text).alias("tokens"))


@query(
    "estimate_tokens_conversations",
    f"""SELECT conv_id, CAST(sum(length(text) - length(regexp_replace(text, '{CJK}', '', 'g')) + ceil(length(regexp_replace(text, '{CJK}', '', 'g')) / 4)) AS BIGINT) AS tokens
    FROM conversations GROUP BY conv_id""",
)
def _(spark, d):
    return (
        v.table(spark, d, "conversations")
        .groupBy("conv_id")
        .agg(F.sum(names.estimate_tokens(F.col("text"))).alias("tokens"))
    )


TITLE = """CASE k % 4 WHEN 0 THEN 'Gemini ' || k || '.' || user_id % 9 || ' Flash (Medium)' WHEN 1 THEN 'Models/Claude Opus ' || k || ' Thinking'
    WHEN 2 THEN '  My  Local_' || event_type || ' XHIGH ' ELSE '(x)' END"""
SLUG = r"regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(trim(t), '\([^)]*\)', ' ', 'g'), '(?i)\b(thinking|xhigh|high|medium|low|fast)\b', ' ', 'g')), '[^a-z0-9.]+', '-', 'g'), '^-+|-+$', '', 'g')"


def _title():
    k = F.col("k")
    ks, us = k.cast("string"), (F.col("user_id") % 9).cast("string")
    return (
        F.when(k % 4 == 0, F.concat(F.lit("Gemini "), ks, F.lit("."), us, F.lit(" Flash (Medium)")))
        .when(k % 4 == 1, F.concat(F.lit("Models/Claude Opus "), ks, F.lit(" Thinking")))
        .when(k % 4 == 2, F.concat(F.lit("  My  Local_"), "event_type", F.lit(" XHIGH ")))
        .otherwise("(x)")
    )


DISPLAY = """CASE WHEN trim(t) = '' OR s = '' THEN NULL WHEN contains(s, 'gemini') THEN pre(substr(s, instr(s, 'gemini')))
    WHEN contains(s, 'claude') THEN pre(substr(s, instr(s, 'claude'))) WHEN contains(s, 'gpt') THEN pre(substr(s, instr(s, 'gpt'))) ELSE 'antigravity-' || s END"""


def _display_sql() -> str:
    import re

    return re.sub(
        r"pre\((substr\(s, instr\(s, '\w+'\)\))\)",
        r"CASE WHEN regexp_matches(\1, '^(gemini|claude|gpt)-') THEN \1 ELSE 'antigravity-' || \1 END",
        DISPLAY,
    )


@query(
    "normalize_display_model",
    f"""WITH a AS (SELECT event_id, {TITLE} AS t FROM usage_rows), b AS (SELECT event_id, t, {SLUG} AS s FROM a)
    SELECT event_id, {_display_sql()} AS model FROM b""",
)
def _(spark, d):
    return v.usage_rows(spark, d).select("event_id", names.normalize_display_model(_title()).alias("model"))


@query(
    "parse_model_selection",
    f"""WITH a0 AS (SELECT event_id, CASE WHEN v % 3 = 0 THEN 'nothing changed' ELSE 'User changed setting `Model Selection` from None to ' || {TITLE} || '. Fine.' END AS m FROM usage_rows),
    a AS (SELECT event_id, nullif(regexp_extract(m, '(?i)changed setting `Model Selection` from .*? to ([^`\\n]+?)(?:\\s*\\([^)]*\\))?\\.(?:\\s+|$)', 1), '') AS t FROM a0),
    b AS (SELECT event_id, t, {SLUG} AS s FROM a)
    SELECT event_id, CASE WHEN t IS NULL THEN NULL ELSE {_display_sql()} END AS model FROM b""",
)
def _(spark, d):
    message = F.when(F.col("v") % 3 == 0, "nothing changed").otherwise(
        F.concat(F.lit("User changed setting `Model Selection` from None to "), _title(), F.lit(". Fine."))
    )
    return v.usage_rows(spark, d).select("event_id", names.parse_model_selection(message).alias("model"))


WORDS = " OR ".join(f"contains(lower(n), '{w}')" for w in fixed.BLOCKED_WORDS)
LINK = fixed.LINK_PATTERN


@query(
    "sanitize_name",
    f"""WITH a AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN split_part(text, '.', 1) WHEN 1 THEN split_part(text, ' ', 2) || chr(8203) || '  ' || split_part(text, ' ', 3)
        WHEN 2 THEN split_part(text, ' ', 1) || '.com' ELSE ' 管理' || lang || doc_id END AS raw FROM documents),
    b AS (SELECT doc_id, trim(regexp_replace(regexp_replace(raw, '{fixed.INVISIBLE_CLASS}', '', 'g'), '{WS}+', ' ', 'g')) AS n FROM a)
    SELECT doc_id, CASE WHEN n = '' OR regexp_matches(n, '{LINK}') OR contains(n, '@') OR {WORDS} OR length(n) > 16 THEN NULL ELSE n END AS name FROM b""",
)
def _(spark, d):
    doc = F.col("doc_id")
    raw = (
        F.when(doc % 4 == 0, F.split_part(F.col("text"), F.lit("."), F.lit(1)))
        .when(
            doc % 4 == 1,
            F.concat(
                F.split_part(F.col("text"), F.lit(" "), F.lit(2)),
                F.lit("\u200b  "),
                F.split_part(F.col("text"), F.lit(" "), F.lit(3)),
            ),
        )
        .when(doc % 4 == 2, F.concat(F.split_part(F.col("text"), F.lit(" "), F.lit(1)), F.lit(".com")))
        .otherwise(F.concat(F.lit(" 管理"), "lang", doc.cast("string")))
    )
    return v.table(spark, d, "documents").select("doc_id", names.sanitize_name(raw).alias("name"))


@query(
    "ok_label",
    f"""WITH a AS (SELECT page_id, unnest([url, replace(replace(url, 'http://', ''), 'https://', ''), split_part(url, '/', 4)]) AS n FROM pages)
    SELECT page_id, n AS label, regexp_matches(n, '{fixed.LABEL_PATTERN}') AND NOT regexp_matches(n, '{LINK}') AND NOT ({WORDS}) AS ok FROM a""",
)
def _(spark, d):
    bare = F.replace(F.replace(F.col("url"), F.lit("http://"), F.lit("")), F.lit("https://"), F.lit(""))
    parts = F.array("url", bare, F.split_part(F.col("url"), F.lit("/"), F.lit(4)))
    rows = v.table(spark, d, "pages").select("page_id", F.explode(parts).alias("label"))
    return rows.withColumn("ok", names.ok_label(F.col("label")))


@query(
    "to_millis",
    f"""WITH a AS (SELECT event_id, CASE k % 5 WHEN 0 THEN ts_ms // 1000 WHEN 1 THEN ts_ms WHEN 2 THEN ts_ms * 1000 + 7 WHEN 3 THEN 1000000000 ELSE -5 END AS n FROM usage_rows),
    b AS (SELECT event_id, n, CASE WHEN n > 1e14 THEN n // 1000 WHEN n < 1e11 THEN n * 1000 ELSE n END AS m FROM a)
    SELECT event_id, CASE WHEN n > 0 AND m BETWEEN 1672531200000 AND {NOW_MS + fixed.DAY_MS} THEN m END AS ms,
      CASE WHEN regexp_matches(CAST(n AS VARCHAR), '^\\d{{10,16}}$') AND m BETWEEN 1672531200000 AND {NOW_MS + fixed.DAY_MS} THEN m END AS text_ms FROM b""",
)
def _(spark, d):
    k, ts = F.col("k"), F.col("ts_ms")
    n = F.when(k % 5 == 0, F.floor(ts / 1000)).when(k % 5 == 1, ts).when(k % 5 == 2, ts * 1000 + 7)
    n = n.when(k % 5 == 3, F.lit(1_000_000_000)).otherwise(F.lit(-5))
    return v.usage_rows(spark, d).select(
        "event_id",
        times.to_millis(n, NOW_MS).alias("ms"),
        times.to_millis(n.cast("string"), NOW_MS, is_text=True).alias("text_ms"),
    )


@query(
    "source_device",
    """SELECT DISTINCT path, CASE WHEN starts_with(path, '/home/u/.pi/') THEN 'windows' WHEN starts_with(path, '/home/u/.codex/s8-0/') THEN 'unknown'
      WHEN starts_with(path, '/home/u/.codex/') OR starts_with(path, '/home/u/.ccmr/') THEN 'local' ELSE 'unknown' END AS origin FROM file_rows""",
)
def _(spark, d):
    path = F.regexp_replace("path", "^/home/u/[.]pi/", "/data/remote/windows-usage/")
    origin = keys.source_device(
        path, "/data", ["/home/u/.codex", "/home/u/.ccmr/"], ["/home/u/.codex/s8-0"]
    )
    return v.file_rows(spark, d).select("path", origin.alias("origin")).distinct()


@query(
    "range_days",
    """WITH a AS (SELECT event_id, CASE k % 6 WHEN 0 THEN CAST(k AS VARCHAR) WHEN 1 THEN ' ' || k || '.0 ' WHEN 2 THEN '' WHEN 3 THEN '-' || k WHEN 4 THEN CAST(v AS VARCHAR) ELSE 'x' || k END AS s, k, v FROM usage_rows)
    SELECT event_id, CAST(CASE k % 6 WHEN 0 THEN k WHEN 1 THEN k WHEN 4 THEN least(v, 3650) ELSE 30 END AS INTEGER) AS days FROM a""",
)
def _(spark, d):
    k = F.col("k")
    ks = k.cast("string")
    s = F.when(k % 6 == 0, ks).when(k % 6 == 1, F.concat(F.lit(" "), ks, F.lit(".0 "))).when(k % 6 == 2, "")
    s = s.when(k % 6 == 3, F.concat(F.lit("-"), ks)).when(k % 6 == 4, F.col("v").cast("string"))
    s = s.otherwise(F.concat(F.lit("x"), ks))
    return v.usage_rows(spark, d).select("event_id", predicates.range_days(s).alias("days"))


@query(
    "valid_session_id",
    "SELECT doc_id, length(text) BETWEEN 1 AND 256 AND NOT regexp_matches(text, '[\\x{00}-\\x{1f}\\x{7f}]') AS valid FROM documents",
)
def _(spark, d):
    return v.table(spark, d, "documents").select(
        "doc_id", predicates.valid_session_id(F.col("text")).alias("valid")
    )


@query(
    "window_label",
    """WITH a AS (SELECT event_id, CASE k % 4 WHEN 0 THEN 10080 WHEN 1 THEN k * 1440 WHEN 2 THEN k * 60 ELSE k END AS m FROM usage_rows)
    SELECT event_id, CASE WHEN m = 10080 THEN '每周' WHEN m > 0 AND m % 1440 = 0 THEN m // 1440 || ' 天' WHEN m > 0 AND m % 60 = 0 THEN m // 60 || ' 小时' ELSE m || ' 分钟' END AS label FROM a""",
)
def _(spark, d):
    k = F.col("k")
    m = F.when(k % 4 == 0, 10080).when(k % 4 == 1, k * 1440).when(k % 4 == 2, k * 60).otherwise(k)
    return v.usage_rows(spark, d).select("event_id", names.window_label(m).alias("label"))


@query(
    "display_model",
    r"""WITH a AS (SELECT event_id, CASE k % 4 WHEN 0 THEN 'claude-opus-' || k || '-' || user_id % 10 || CASE WHEN v % 2 = 0 THEN '-max' ELSE '' END
        WHEN 1 THEN 'gpt-4-0613-' || k WHEN 2 THEN 'deepseek-' || k ELSE model END AS m FROM usage_rows)
    SELECT event_id, regexp_replace(m, '^(.*?)-(\d+)-(\d)(-|$)', '\1-\2.\3\4') AS pretty,
      regexp_replace(CASE WHEN starts_with(m, 'deepseek') THEN 'deepseek-v4.1-flash' ELSE m END, '^(.*?)-(\d+)-(\d)(-|$)', '\1-\2.\3\4') AS display FROM a""",
)
def _(spark, d):
    k = F.col("k")
    ks = k.cast("string")
    tail = F.when(F.col("v") % 2 == 0, "-max").otherwise("")
    m = (
        F.when(k % 4 == 0, F.concat(F.lit("claude-opus-"), ks, F.lit("-"), (F.col("user_id") % 10).cast("string"), tail))
        .when(k % 4 == 1, F.concat(F.lit("gpt-4-0613-"), ks))
        .when(k % 4 == 2, F.concat(F.lit("deepseek-"), ks))
        .otherwise(F.col("model"))
    )
    return v.usage_rows(spark, d).select(
        "event_id", names.pretty_model(m).alias("pretty"), names.display_model(m).alias("display")
    )


def _fixed_sql(x: str, digits: int) -> str:
    bump = f"CASE WHEN ({x}) * {2 ** (digits + 1)} % 2 = 1 THEN ({x}) + 1e-{digits + 3} ELSE ({x}) END"
    return f"printf('%.{digits}f', {bump})"


@query(
    "fmt_compact",
    f"""WITH a AS (SELECT event_id, CAST(total_tokens AS DOUBLE) * CASE k % 4 WHEN 0 THEN 1 WHEN 1 THEN 125 WHEN 2 THEN 40000 ELSE 0.001 END AS x FROM usage_rows)
    SELECT event_id, CASE WHEN x >= 1e9 THEN {_fixed_sql('x / 1e9', 2)} || 'B' WHEN x >= 1e6 THEN {_fixed_sql('x / 1e6', 1)} || 'M'
        WHEN x >= 1e3 THEN {_fixed_sql('x / 1e3', 1)} || 'K' ELSE CAST(CAST(floor(x + 0.5) AS BIGINT) AS VARCHAR) END AS kmb,
      CASE WHEN x >= 1e8 THEN {_fixed_sql('x / 1e8', 2)} || ' 亿' WHEN x >= 1e4 THEN {_fixed_sql('x / 1e4', 1)} || ' 万' ELSE CAST(CAST(floor(x + 0.5) AS BIGINT) AS VARCHAR) END AS cn FROM a""",
)
def _(spark, d):
    k = F.col("k")
    factor = F.when(k % 4 == 0, F.lit(1.0)).when(k % 4 == 1, F.lit(125.0)).when(k % 4 == 2, F.lit(40000.0)).otherwise(F.lit(0.001))
    x = F.col("total_tokens").cast("double") * factor
    return v.usage_rows(spark, d).select(
        "event_id", names.fmt_compact(x, "kmb").alias("kmb"), names.fmt_compact(x, "cn").alias("cn")
    )


@query(
    "fmt_countdown",
    f"""WITH a AS (SELECT event_id, ({NOW_MS} - ts_ms) // (1 + k % 50) AS ms FROM usage_rows),
    b AS (SELECT *, ms // 86400000 AS d, (ms % 86400000) // 3600000 AS h, lpad(CAST((ms % 3600000) // 60000 AS VARCHAR), 2, '0') AS m, lpad(CAST((ms % 60000) // 1000 AS VARCHAR), 2, '0') AS s FROM a)
    SELECT event_id, CASE WHEN ms <= 0 THEN '已结束' WHEN d > 0 THEN d || '天 ' || h || ':' || m WHEN h > 0 THEN h || ':' || m || ':' || s ELSE m || ':' || s END AS label FROM b""",
)
def _(spark, d):
    left = F.expr(f"({NOW_MS} - ts_ms) div (1 + k % 50)")
    return v.usage_rows(spark, d).select("event_id", names.fmt_countdown(left).alias("label"))


@query(
    "safe_category",
    f"""SELECT page_id, CASE WHEN url IS NULL OR url = '' THEN '未标注工具' WHEN regexp_matches(n, '{fixed.CATEGORY_PATTERN}') AND NOT regexp_matches(n, '{fixed.KEY_LIKE_PATTERN}') THEN n
      ELSE '未规范标识' END AS category FROM (SELECT page_id, url, CASE page_id % 3 WHEN 0 THEN 'sk-' || url ELSE url END AS n FROM pages)""",
)
def _(spark, d):
    label = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("sk-"), "url")).otherwise(F.col("url"))
    return v.table(spark, d, "pages").select(
        "page_id", names.safe_category(label, fixed.UNKNOWN_TOOL).alias("category")
    )


@query(
    "masked_id",
    """WITH a AS (SELECT event_id, sha256('claude-session:' || coalesce(session_id, '')) AS h FROM usage_rows)
    SELECT event_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS masked FROM a""",
)
def _(spark, d):
    return v.usage_rows(spark, d).select(
        "event_id", keys.masked_id("claude-session", F.col("session_id")).alias("masked")
    )


@query(
    "json_fields",
    """SELECT event_id, k AS number, k % 4 <> 0 AS valid, CASE WHEN k % 4 <> 0 THEN 'BIGINT' END AS kind FROM
      (SELECT event_id, k FROM usage_rows WHERE true)""".replace(
        "k AS number", "CASE WHEN k % 4 <> 0 THEN CAST(k AS DOUBLE) END AS number"
    ),
)
def _(spark, d):
    broken = F.when(F.col("event_id").isNotNull() & (F.col("k") % 4 == 0), F.regexp_replace("props", "[}]$", "")).otherwise(F.col("props"))
    events = v.table(spark, d, "events").withColumn(
        "k", F.regexp_extract("props", "([0-9]+)", 1).cast("long")
    )
    body = V.parse(broken)
    return events.select(
        "event_id",
        V.number(body, "$.k").alias("number"),
        body.isNotNull().alias("valid"),
        V.type_of(body, "$.k").alias("kind"),
    )


@query(
    "url_basename",
    r"SELECT page_id, regexp_extract(url, '([^/\\]+)[/\\]*$', 1) AS name FROM pages",
)
def _(spark, d):
    return v.table(spark, d, "pages").select("page_id", names.basename(F.col("url")).alias("name"))


@query(
    "model_prefix",
    """SELECT event_id, coalesce(model = 'kimi' OR starts_with(model, 'kimi-'), false) AS direct,
      starts_with(lower(coalesce(model, '')), 'kim') AS loose FROM usage_rows""",
)
def _(spark, d):
    m = F.col("model")
    return v.usage_rows(spark, d).select(
        "event_id",
        predicates.model_prefix(m, "kimi").alias("direct"),
        predicates.model_prefix_loose(m, "Kim").alias("loose"),
    )


@query(
    "safe_count",
    "SELECT event_id, v - 500 BETWEEN 0 AND 9007199254740991 AS ok FROM usage_rows",
)
def _(spark, d):
    return v.usage_rows(spark, d).select(
        "event_id", predicates.safe_count(F.col("v") - 500).alias("ok")
    )
