"""The given parquet tables seen as usage data, for Spark and (as SQL text) for DuckDB.

``events`` supplies the requests; ids, tools, models and counters are derived from its columns
by fixed arithmetic, so every view grows with the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelens.session import configure

#: report instant of every registered query: 2024-01-30 15:00:00 UTC
NOW_MS = 1_706_626_800_000
FX = "7.2"

_TOOL_OF = [("click", "claude-code"), ("view", "codex"), ("purchase", "ccmr"), ("signup", "cursor")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _key(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix), *[p.cast("string") for p in parts])


def usage_base(spark: SparkSession, sf_dir: str, since_ms: int | None = None) -> DataFrame:
    """One row per event; ``since_ms`` is pushed down to the parquet scan."""
    events = table(spark, sf_dir, "events")
    if since_ms is not None:
        start = F.timestamp_millis(F.lit(since_ms)).cast("timestamp_ntz")
        events = events.filter(F.col("ts") >= start)
    return events.select(
        "event_id",
        "user_id",
        "event_type",
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"),
        F.regexp_extract("props", "([0-9]+)", 1).cast("long").alias("k"),
        F.round(F.col("value") * 100).cast("long").alias("v"),
        "value",
    )


def usage_rows(spark: SparkSession, sf_dir: str, since_ms: int | None = None) -> DataFrame:
    """Usage events plus the raw columns the other views derive from."""
    b = usage_base(spark, sf_dir, since_ms)
    k, v, user, kind = F.col("k"), F.col("v"), F.col("user_id"), F.col("event_type")
    tool = F.when(kind == _TOOL_OF[0][0], _TOOL_OF[0][1])
    for source, name in _TOOL_OF[1:]:
        tool = tool.when(kind == source, name)
    models = ["deepseek-v4-pro", "kimi-k3", "grok-4.7", "claude-opus-5-5", "mystery-model"]
    model = F.when(k % 6 == 0, models[0])
    for i, name in enumerate(models[1:], start=1):
        model = model.when(k % 6 == i, name)
    device = (
        F.when(user % 4 == 0, "local").when(user % 4 == 1, "vps").when(user % 4 == 2, "windows")
    )
    return b.select(
        _key("ev:", F.col("event_id")).alias("dedup_key"),
        "ts_ms",
        tool.otherwise("pi").alias("tool"),
        model.alias("model"),
        F.when(k != 99, F.concat(_key("s", user), F.lit("-"), (k % 4).cast("string"))).alias("session_id"),
        F.when(user % 7 != 0, _key("p", user % 7)).alias("project"),
        (v * 10).alias("input_tokens"),
        (v * (k % 5)).alias("cached_input"),
        (v * (k % 3)).alias("cache_write"),
        v.alias("output_tokens"),
        (v % 17).alias("reasoning_tokens"),
        (v * (11 + k % 5 + k % 3)).alias("total_tokens"),
        F.when(k % 3 != 0, 500 + (v * 7) % 20000).alias("duration_ms"),
        device.otherwise("unknown").alias("device"),
        _key("t", user).alias("trace_id"),
        "event_id",
        "user_id",
        "event_type",
        "k",
        "v",
        "value",
    )


_RAW = ["event_id", "user_id", "event_type", "k", "v", "value"]


def usage_events(spark: SparkSession, sf_dir: str, since_ms: int | None = None) -> DataFrame:
    """One row per request, in the event layout."""
    return usage_rows(spark, sf_dir, since_ms).drop(*_RAW)


def usage_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrivals of the same keys: originals, later partial copies, exact copies."""
    # one scan: each row is repeated for the arrivals it takes part in
    rows = usage_rows(spark, sf_dir)
    k = F.col("k")
    arrivals = F.filter(
        F.array(
            F.lit(0),
            F.when(k % 3 == 0, F.lit(1)),
            F.when(k % 10 == 0, F.lit(2)),
        ),
        lambda a: a.isNotNull(),
    )
    out = rows.withColumn("arrival", F.explode(arrivals))
    partial = F.col("arrival") == 1
    output = F.when(
        partial, F.greatest(F.col("output_tokens") + k - 30, F.lit(0).cast("long"))
    ).otherwise(F.col("output_tokens"))
    return (
        out.withColumn(
            "total_tokens", F.col("total_tokens") - F.col("output_tokens") + output
        )
        .withColumn("output_tokens", output)
        .withColumn("model", F.when(~partial, F.col("model")))
        .withColumn("ord", F.col("arrival").cast("long") * 1_000_000_000 + F.col("event_id"))
    )


def usage_claude(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrivals keyed by message id, with transcript and audit quality and some old-style keys."""
    a = usage_arrivals(spark, sf_dir)
    legacy = F.col("arrival") == 0
    is_old = legacy & (F.col("k") % 7 == 0)
    key = F.when(
        is_old, F.concat(_key("claude-code:", F.col("event_id")), F.lit(":r1"))
    ).otherwise(_key("claude-code:message:", F.col("event_id")))
    quality = F.when(is_old, F.lit(0)).otherwise(
        (1 + (F.col("event_id") + F.col("arrival")) % 2).cast("int")
    )
    return a.withColumn("dedup_key", key).withColumn("tool", F.lit("claude-code")).withColumn(
        "usage_quality", quality
    )


def usage_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrivals with quality 1 (estimate), 2 (context) or 3 (exact)."""
    a = usage_arrivals(spark, sf_dir)
    return a.withColumn(
        "usage_quality", (1 + (F.col("event_id") + F.col("arrival")) % 3).cast("int")
    )


def tool_calls(spark: SparkSession, sf_dir: str, since_ms: int | None = None) -> DataFrame:
    r = usage_rows(spark, sf_dir, since_ms)
    name = F.concat(F.col("event_type"), F.lit("_"), (F.col("k") % 20).cast("string"))
    return r.select(
        _key("tc:", F.col("event_id")).alias("dedup_key"),
        "ts_ms",
        "tool",
        name.alias("name"),
        "session_id",
        "device",
    )


def credit_usage(spark: SparkSession, sf_dir: str, since_ms: int | None = None) -> DataFrame:
    r = usage_rows(spark, sf_dir, since_ms).filter(F.col("event_type") == "signup")
    return r.select(
        _key("cr:", F.col("event_id")).alias("dedup_key"),
        "ts_ms",
        "tool",
        (F.col("v") / 100).alias("amount"),
        "device",
    )


def balance_history(spark: SparkSession, sf_dir: str, since_ms: int | None = None) -> DataFrame:
    r = usage_rows(spark, sf_dir, since_ms).filter(F.col("event_type") == "purchase")
    k = F.col("k")
    provider = F.when(k % 3 == 0, "deepseek").when(k % 3 == 1, "kimi").otherwise("glm")
    return r.select(
        "event_id", "ts_ms", provider.alias("provider"), (F.col("v") / 100).alias("balance")
    )


def file_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per log file: the newest observation of each path."""
    r = usage_rows(spark, sf_dir)
    e, k = F.col("event_id"), F.col("k")
    suffix = (
        F.when(k % 10 == 0, ".sync-conflict-20240101.jsonl")
        .when(k % 10 == 1, " (1).jsonl")
        .when(k % 10 == 2, ".jsonl.zst")
        .otherwise(".jsonl")
    )
    path = F.concat(
        F.lit("/home/u/."),
        F.col("tool"),
        F.lit("/"),
        F.coalesce(F.col("session_id"), F.lit("none")),
        F.lit("/f"),
        (e % 50).cast("string"),
        suffix,
    )
    keyed = r.select(path.alias("path"), "tool", "session_id", "device", "v", "ts_ms")
    return keyed.groupBy("path", "tool", "device").agg(
        F.max("session_id").alias("session_id"),
        F.sum("v").alias("size"),
        F.max("ts_ms").alias("mtime_ms"),
        (F.max("v") % 2 + 1).cast("int").alias("version"),
    )


def player_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user and UTC day totals, with a stable id in UUIDv4 form."""
    r = usage_rows(spark, sf_dir)
    day = F.date_from_unix_date(F.floor(F.col("ts_ms") / 86_400_000).cast("int"))
    return (
        r.withColumn("day", day.cast("string"))
        .groupBy("user_id", "day")
        .agg(
            F.sum("total_tokens").alias("day_tokens"),
            F.count(F.lit(1)).alias("day_requests"),
            F.max("ts_ms").alias("at_ms"),
        )
        .withColumn("id", uuid_of(F.col("user_id")))
    )


def uuid_of(user: Column) -> Column:
    h = F.md5(user.cast("string"))
    return F.concat(
        F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-4"), F.substring(h, 14, 3),
        F.lit("-8"), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12),
    )


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = usage_rows(spark, sf_dir).filter(F.col("event_type") == "error")
    return r.select(
        _key("c", F.col("event_id")).alias("hash"),
        F.coalesce(F.col("project"), F.lit("none")).alias("cwd"),
        "ts_ms",
        _key("subject ", F.col("k")).alias("subject"),
        (F.col("k") % 8 == 0).alias("is_merge"),
    )


SQL_VIEWS: dict[str, str] = {
    "usage_base": """
        SELECT event_id, user_id, event_type, epoch_us(ts) // 1000 AS ts_ms,
               CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k,
               CAST(round(value * 100) AS BIGINT) AS v, value
        FROM events""",
    "usage_rows": """
        SELECT 'ev:' || CAST(event_id AS VARCHAR) AS dedup_key, ts_ms,
          CASE event_type WHEN 'click' THEN 'claude-code' WHEN 'view' THEN 'codex'
            WHEN 'purchase' THEN 'ccmr' WHEN 'signup' THEN 'cursor' ELSE 'pi' END AS tool,
          CASE k % 6 WHEN 0 THEN 'deepseek-v4-pro' WHEN 1 THEN 'kimi-k3' WHEN 2 THEN 'grok-4.7'
            WHEN 3 THEN 'claude-opus-5-5' WHEN 4 THEN 'mystery-model' ELSE NULL END AS model,
          CASE WHEN k = 99 THEN NULL
            ELSE 's' || CAST(user_id AS VARCHAR) || '-' || CAST(k % 4 AS VARCHAR) END AS session_id,
          CASE WHEN user_id % 7 = 0 THEN NULL ELSE 'p' || CAST(user_id % 7 AS VARCHAR) END AS project,
          v * 10 AS input_tokens, v * (k % 5) AS cached_input, v * (k % 3) AS cache_write,
          v AS output_tokens, v % 17 AS reasoning_tokens, v * (11 + k % 5 + k % 3) AS total_tokens,
          CASE WHEN k % 3 = 0 THEN NULL ELSE 500 + (v * 7) % 20000 END AS duration_ms,
          CASE user_id % 4 WHEN 0 THEN 'local' WHEN 1 THEN 'vps' WHEN 2 THEN 'windows'
            ELSE 'unknown' END AS device,
          't' || CAST(user_id AS VARCHAR) AS trace_id,
          event_id, user_id, event_type, k, v, value
        FROM usage_base""",
    "usage_events": """
        SELECT dedup_key, ts_ms, tool, model, session_id, project, input_tokens, cached_input,
          cache_write, output_tokens, reasoning_tokens, total_tokens, duration_ms, device, trace_id
        FROM usage_rows""",
    "usage_arrivals": """
        SELECT *, 0 AS arrival, event_id AS ord FROM usage_rows
        UNION ALL
        SELECT * REPLACE (NULL AS model,
            greatest(output_tokens + k - 30, 0) AS output_tokens,
            total_tokens - output_tokens + greatest(output_tokens + k - 30, 0) AS total_tokens),
          1 AS arrival, 1000000000 + event_id AS ord
        FROM usage_rows WHERE k % 3 = 0
        UNION ALL
        SELECT *, 2 AS arrival, 2000000000 + event_id AS ord FROM usage_rows WHERE k % 10 = 0""",
    "usage_claude": """
        SELECT * REPLACE ('claude-code' AS tool,
            CASE WHEN arrival = 0 AND k % 7 = 0 THEN 'claude-code:' || event_id || ':r1'
              ELSE 'claude-code:message:' || event_id END AS dedup_key),
          CASE WHEN arrival = 0 AND k % 7 = 0 THEN 0 ELSE 1 + (event_id + arrival) % 2 END AS usage_quality
        FROM usage_arrivals""",
    "usage_quality": """
        SELECT *, 1 + (event_id + arrival) % 3 AS usage_quality FROM usage_arrivals""",
    "tool_calls": """
        SELECT 'tc:' || event_id AS dedup_key, ts_ms, tool,
          event_type || '_' || CAST(k % 20 AS VARCHAR) AS name, session_id, device
        FROM usage_rows""",
    "credit_usage": """
        SELECT 'cr:' || event_id AS dedup_key, ts_ms, tool, v / 100 AS amount, device
        FROM usage_rows WHERE event_type = 'signup'""",
    "balance_history": """
        SELECT event_id, ts_ms, CASE k % 3 WHEN 0 THEN 'deepseek' WHEN 1 THEN 'kimi' ELSE 'glm' END AS provider,
          v / 100 AS balance
        FROM usage_rows WHERE event_type = 'purchase'""",
    "file_keys": """
        SELECT '/home/u/.' || tool || '/' || coalesce(session_id, 'none') || '/f' || CAST(event_id % 50 AS VARCHAR)
            || CASE k % 10 WHEN 0 THEN '.sync-conflict-20240101.jsonl' WHEN 1 THEN ' (1).jsonl'
                 WHEN 2 THEN '.jsonl.zst' ELSE '.jsonl' END AS path,
          tool, session_id, device, v, ts_ms
        FROM usage_rows""",
    "file_rows": """
        SELECT path, tool, device, max(session_id) AS session_id, CAST(sum(v) AS BIGINT) AS size,
          max(ts_ms) AS mtime_ms, CAST(max(v) % 2 + 1 AS INTEGER) AS version
        FROM file_keys GROUP BY path, tool, device""",
    "player_days": """
        SELECT user_id, day, CAST(sum(total_tokens) AS BIGINT) AS day_tokens, count(*) AS day_requests,
          max(ts_ms) AS at_ms,
          substr(md5(CAST(user_id AS VARCHAR)), 1, 8) || '-' || substr(md5(CAST(user_id AS VARCHAR)), 9, 4)
            || '-4' || substr(md5(CAST(user_id AS VARCHAR)), 14, 3) || '-8'
            || substr(md5(CAST(user_id AS VARCHAR)), 18, 3) || '-' || substr(md5(CAST(user_id AS VARCHAR)), 21, 12) AS id
        FROM (SELECT *, strftime(epoch_ms(ts_ms), '%Y-%m-%d') AS day FROM usage_rows)
        GROUP BY user_id, day""",
    "commits": """
        SELECT 'c' || event_id AS hash, coalesce(project, 'none') AS cwd, ts_ms,
          'subject ' || k AS subject, k % 8 = 0 AS is_merge
        FROM usage_rows WHERE event_type = 'error'""",
}
