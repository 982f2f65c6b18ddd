"""Queries: deduplication, upsert, key migration, device attribution, ledgers, file listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelens.functions.keys import canonical_key
from usagelens.functions.names import file_stem
from usagelens.operators import dedup, joins
from usagelens.operators.skew import literal_table
from usagelens.plans import views as v
from usagelens.plans.registry import query
from usagelens.schema import USAGE_COLUMNS
from usagelens.sources import files, tables

EVENT_COLS = [
    "dedup_key", "ts_ms", "tool", "model", "session_id", "project", *USAGE_COLUMNS, "trace_id", "device",
]
IDS = ["ts_ms", "tool", "model", "session_id", "project", "trace_id", "device"]
USAGE = USAGE_COLUMNS



def _pick(columns: list[str], order: str) -> str:
    """First value in an order, nulls included, as a DuckDB aggregate."""
    return ", ".join(f"first({c} ORDER BY {order}) AS {c}" for c in columns)


DEDUP_SQL = f"""
    SELECT dedup_key, {_pick(IDS, 'ord')}, {_pick(USAGE, 'output_tokens DESC, ord')}
    FROM usage_arrivals GROUP BY dedup_key"""


@query("dedup_events", DEDUP_SQL)
def _(spark, d):
    return dedup.dedup_events(v.usage_arrivals(spark, d)).select(*EVENT_COLS)


@query("upsert_events", DEDUP_SQL)
def _(spark, d):
    arrivals = v.usage_arrivals(spark, d)
    base = dedup.dedup_events(arrivals.filter("arrival = 0")).select(*EVENT_COLS)
    batch = arrivals.filter("arrival > 0").select(*EVENT_COLS, "ord")
    return dedup.merge_upsert(base, batch)


CLAUDE_RANK = "q DESC, output_tokens DESC, total_tokens DESC, ord"
CLAUDE_SQL = f"""
    WITH a AS (SELECT *, CASE WHEN usage_quality = 0 THEN 2 ELSE usage_quality END AS q,
        'claude-code:message:' || event_id AS canon, dedup_key LIKE 'claude-code:message:%' AS is_new FROM usage_claude),
    o AS (SELECT canon FROM a WHERE is_new GROUP BY canon),
    g AS (SELECT a.*, CASE WHEN o.canon IS NULL THEN a.dedup_key ELSE a.canon END AS gkey FROM a LEFT JOIN o USING (canon)),
    w AS (SELECT gkey, {_pick(['ord'], CLAUDE_RANK)}, {_pick([*IDS, *USAGE, 'q'], CLAUDE_RANK)} FROM g GROUP BY gkey),
    l AS (SELECT w.gkey, first(g.model ORDER BY g.ord) FILTER (g.model IS NOT NULL) AS lm,
        first(g.project ORDER BY g.ord) FILTER (g.project IS NOT NULL) AS lp,
        first(g.session_id ORDER BY g.ord) FILTER (g.session_id IS NOT NULL) AS ls
      FROM w JOIN g ON g.gkey = w.gkey AND g.ord > w.ord GROUP BY w.gkey)
    SELECT w.gkey AS dedup_key, ts_ms, tool, coalesce(model, lm) AS model, coalesce(session_id, ls) AS session_id,
      coalesce(project, lp) AS project, {', '.join(USAGE)}, trace_id, device, CAST(q AS INTEGER) AS usage_quality
    FROM w LEFT JOIN l USING (gkey)"""


@query("dedup_claude", CLAUDE_SQL)
def _(spark, d):
    return dedup.dedup_claude(v.usage_claude(spark, d)).select(*EVENT_COLS, "usage_quality")


@query(
    "dedup_request_alias",
    """SELECT dedup_key, total_tokens FROM usage_arrivals a WHERE arrival = 0 AND NOT
      (tool = 'pi' AND EXISTS (SELECT 1 FROM usage_arrivals b WHERE b.arrival = 2 AND b.event_id = a.event_id))""",
)
def _(spark, d):
    arrivals = v.usage_arrivals(spark, d)
    seen = arrivals.filter("arrival = 2").select(
        F.concat(F.lit("req:"), "dedup_key").alias("dedup_key"), F.col("dedup_key").alias("legacy_key")
    )
    return dedup.dedup_request_alias(arrivals.filter("arrival = 0"), seen, "pi").select(
        "dedup_key", "total_tokens"
    )


QUALITY_METRIC = "CASE usage_quality WHEN 2 THEN output_tokens WHEN 1 THEN total_tokens ELSE 0 END"
QUALITY_SQL = f"""
    WITH a AS (SELECT *, {QUALITY_METRIC} AS m FROM usage_quality),
    r AS (SELECT *, max((usage_quality, m)) OVER (PARTITION BY dedup_key ORDER BY ord) AS best FROM a),
    km AS (SELECT dedup_key, last(model ORDER BY ord) AS model FROM r
      WHERE model IS NOT NULL AND (usage_quality, m) = best GROUP BY dedup_key)
    SELECT dedup_key, {_pick([c for c in IDS if c != 'model'], 'ord')}, any_value(km.model) AS model,
      {_pick([*USAGE, 'usage_quality'], 'usage_quality DESC, m DESC, ord DESC')}
    FROM a LEFT JOIN km USING (dedup_key) GROUP BY dedup_key"""


@query("dedup_quality", QUALITY_SQL.replace("any_value(km.model)", "any_value(km.model)"))
def _(spark, d):
    return dedup.dedup_quality(v.usage_quality(spark, d)).select(*EVENT_COLS, F.col("usage_quality").cast("long"))


# arrivals of all tools in one stream: default rule, message rule and quality rule
MIXED_VIEWS = {
    "mixed_default": """SELECT *, 0 AS usage_quality FROM usage_arrivals WHERE tool NOT IN ('claude-code', 'antigravity')""",
    "mixed_graded": """SELECT * REPLACE ('antigravity' AS tool, 'antigravity:' || event_id AS dedup_key) FROM usage_quality""",
}
MIXED_FACTS = "dedup_key, device, ord, CASE WHEN arrival > 0 AND v > 500 THEN v - 500 END AS duration_ms"
MIXED_COLS = ", ".join(c for c in [*EVENT_COLS, "usage_quality"] if c not in ("device", "usage_quality"))


@query(
    "upsert_mixed_tools",
    f"""
    WITH d AS ({DEDUP_SQL.replace('usage_arrivals', 'mixed_default')}),
    c AS ({CLAUDE_SQL}),
    q AS ({QUALITY_SQL.replace('FROM usage_quality)', 'FROM mixed_graded)')}),
    m AS (SELECT {MIXED_COLS}, device, 0 AS usage_quality FROM d
      UNION ALL SELECT {MIXED_COLS}, device, usage_quality FROM c
      UNION ALL SELECT {MIXED_COLS}, device, usage_quality FROM q),
    a AS (SELECT {MIXED_FACTS} FROM mixed_default UNION ALL SELECT {MIXED_FACTS} FROM usage_claude
      UNION ALL SELECT {MIXED_FACTS} FROM mixed_graded),
    f AS (SELECT dedup_key, CAST(max(duration_ms) AS BIGINT) AS duration_ms,
        first(device ORDER BY ord) FILTER (device <> 'unknown') AS known FROM a GROUP BY dedup_key)
    SELECT {MIXED_COLS}, coalesce(f.known, m.device) AS device, f.duration_ms, CAST(usage_quality AS INTEGER) AS usage_quality
    FROM m LEFT JOIN f USING (dedup_key)""",
    MIXED_VIEWS,
)
def _(spark, d):
    graded = v.usage_quality(spark, d).withColumn("tool", F.lit("antigravity")).withColumn(
        "dedup_key", F.concat(F.lit("antigravity:"), F.col("event_id").cast("string"))
    )
    plain = v.usage_arrivals(spark, d).filter(~F.col("tool").isin("claude-code", "antigravity"))
    late = (F.col("arrival") > 0) & (F.col("v") > 500)
    arrivals = (
        plain.withColumn("usage_quality", F.lit(0)).unionByName(v.usage_claude(spark, d)).unionByName(graded)
    ).withColumn("duration_ms", F.when(late, F.col("v") - 500))
    columns = [*EVENT_COLS, "duration_ms", "usage_quality"]
    base = arrivals.filter("arrival = 0").select(*columns)
    return dedup.merge_upsert(base, arrivals.filter("arrival > 0").select(*columns, "ord"))


@query(
    "note_duration",
    """SELECT dedup_key, greatest(e.duration_ms, p.d) AS duration_ms FROM usage_events e LEFT JOIN
      (SELECT dedup_key, max(v - 500) AS d FROM usage_arrivals WHERE arrival > 0 AND v - 500 > 0 GROUP BY 1) p USING (dedup_key)""",
)
def _(spark, d):
    pairs = v.usage_arrivals(spark, d).filter("arrival > 0").select(
        "dedup_key", (F.col("v") - 500).alias("duration_ms")
    )
    return dedup.note_duration(v.usage_events(spark, d), pairs).select("dedup_key", "duration_ms")


@query(
    "latest_snapshot",
    """SELECT provider, max(ts_ms) AS ts_ms, first(balance ORDER BY ts_ms DESC, event_id) AS balance
    FROM balance_history GROUP BY provider""",
)
def _(spark, d):
    return dedup.latest_snapshot(v.balance_history(spark, d), ["provider"], "event_id").select(
        "provider", "ts_ms", "balance"
    )


@query(
    "dedup_ledger",
    f"""WITH c AS (SELECT 'tc:' || user_id || ':' || k AS dedup_key, ts_ms, tool, event_type AS name, event_id AS ord FROM usage_rows)
    SELECT dedup_key, {_pick(['ts_ms', 'tool', 'name'], 'ord')} FROM c GROUP BY dedup_key""",
)
def _(spark, d):
    key = F.concat(
        F.lit("tc:"), F.col("user_id").cast("string"), F.lit(":"), F.col("k").cast("string")
    )
    rows = v.usage_rows(spark, d).select(
        key.alias("dedup_key"), "ts_ms", "tool", F.col("event_type").alias("name"), F.col("event_id").alias("ord")
    )
    return dedup.dedup_ledger(rows)


STEM_KEY = "'codex:file:u' || user_id || ':' || event_id"


def _stem_rows(spark, d) -> DataFrame:
    key = F.concat(
        F.lit("codex:file:u"), F.col("user_id").cast("string"), F.lit(":"), F.col("event_id").cast("string")
    )
    return v.usage_arrivals(spark, d).withColumn("dedup_key", key)


@query(
    "replace_file_rows",
    f"""WITH a AS (SELECT *, {STEM_KEY} AS k2 FROM usage_arrivals),
    s AS (SELECT DISTINCT user_id FROM a WHERE arrival = 2 AND user_id % 3 <> 0)
    SELECT k2 AS dedup_key, total_tokens, arrival FROM a WHERE arrival = 0 AND user_id NOT IN (SELECT user_id FROM s)
    UNION ALL SELECT k2, total_tokens, arrival FROM a WHERE arrival = 2 AND user_id % 3 <> 0""",
)
def _(spark, d):
    rows = _stem_rows(spark, d)
    stem = F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("stem")
    batch = rows.filter("arrival = 2 AND user_id % 3 <> 0")
    return dedup.replace_file_rows(
        rows.filter("arrival = 0"),
        batch,
        rows.filter("arrival = 2").select(stem),
        rows.filter("user_id % 3 = 0").select(stem).distinct(),
    ).select("dedup_key", "total_tokens", F.col("arrival"))


@query(
    "drop_old_key_version",
    """WITH a AS (SELECT *, 'pi:' || user_id || ':' || event_id || CASE WHEN k % 2 = 0 THEN ':x' ELSE '' END AS k2 FROM usage_rows)
    SELECT k2 AS dedup_key FROM a WHERE NOT (tool = 'pi' AND k % 2 = 1)""",
)
def _(spark, d):
    key = F.concat(
        F.lit("pi:"), F.col("user_id").cast("string"), F.lit(":"), F.col("event_id").cast("string"),
        F.when(F.col("k") % 2 == 0, ":x").otherwise(""),
    )
    rows = v.usage_rows(spark, d).withColumn("dedup_key", key)
    return dedup.drop_old_key_version(rows, "pi").select("dedup_key")


# the same request under a path key and, for some, under its canonical key
MIGRATE_ROWS = """
    SELECT CASE WHEN arrival = 0 THEN 'codex:/h/s' || user_id || '/r' || user_id || '.jsonl:' || event_id
        ELSE 'codex:file:r' || user_id || ':' || event_id END AS k0,
      'codex:file:r' || user_id || ':' || event_id AS canon, 'codex' AS tool, output_tokens, total_tokens, session_id, arrival
    FROM usage_arrivals WHERE arrival < 2"""


def _migrate_rows(spark, d) -> DataFrame:
    user, event = F.col("user_id").cast("string"), F.col("event_id").cast("string")
    path_key = F.concat(
        F.lit("codex:/h/s"), user, F.lit("/r"), user, F.lit(".jsonl:"), event
    )
    canon = F.concat(F.lit("codex:file:r"), user, F.lit(":"), event)
    rows = v.usage_arrivals(spark, d).filter("arrival < 2")
    return rows.select(
        F.when(F.col("arrival") == 0, path_key).otherwise(canon).alias("dedup_key"),
        F.lit("codex").alias("tool"),
        "output_tokens",
        "total_tokens",
        "session_id",
        "arrival",
    )


@query(
    "migrate_keys",
    f"""SELECT canon AS dedup_key, {_pick(['tool', 'output_tokens', 'total_tokens', 'session_id', 'arrival'],
      'output_tokens DESC, total_tokens DESC, (k0 = canon) DESC')} FROM migrate_rows GROUP BY canon""",
    {"migrate_rows": MIGRATE_ROWS},
)
def _(spark, d):
    return dedup.migrate_keys(_migrate_rows(spark, d))[0]


@query(
    "migrate_keys_audit",
    """SELECT k0 AS dedup_key, tool, output_tokens, total_tokens, session_id, arrival FROM migrate_rows
    WHERE canon IN (SELECT canon FROM migrate_rows WHERE k0 <> canon)""",
    {"migrate_rows": MIGRATE_ROWS},
)
def _(spark, d):
    return dedup.migrate_keys(_migrate_rows(spark, d))[1]


@query(
    "tag_device",
    """SELECT 'u' || user_id || ':' || k AS dedup_key,
      coalesce(first(device ORDER BY event_id) FILTER (device <> 'unknown'), 'unknown') AS device
    FROM usage_rows GROUP BY 1""",
)
def _(spark, d):
    key = F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(":"), F.col("k").cast("string"))
    rows = v.usage_rows(spark, d).select(
        key.alias("dedup_key"), "device", F.col("event_id").alias("ord")
    )
    return dedup.tag_device(rows)


@query(
    "attribute_device",
    """WITH f AS (SELECT tool, session_id, device FROM usage_rows WHERE device <> 'unknown' AND k % 2 = 0 AND session_id IS NOT NULL),
    s AS (SELECT DISTINCT tool, 's:' || session_id AS h, device FROM f),
    st AS (SELECT DISTINCT 'codex' AS tool, 'f:u' || user_id AS h, CASE k % 3 WHEN 0 THEN 'vps' ELSE 'local' END AS device FROM usage_rows WHERE k < 3),
    c AS (SELECT * FROM s UNION ALL SELECT * FROM st),
    e AS (SELECT 'codex:file:u' || user_id || ':' || event_id AS dedup_key, tool, session_id, user_id,
      CASE WHEN k % 5 = 0 THEN 'windows' ELSE 'unknown' END AS device FROM usage_rows),
    m AS (SELECT e.dedup_key, count(DISTINCT c.device) AS n, min(c.device) AS device FROM e JOIN c
      ON c.tool = e.tool AND (c.h = 's:' || e.session_id OR c.h = 'f:u' || e.user_id) WHERE e.device = 'unknown' GROUP BY 1)
    SELECT e.dedup_key, CASE WHEN e.device <> 'unknown' THEN e.device WHEN m.n = 1 THEN m.device WHEN m.n > 1 THEN 'unknown'
      WHEN e.tool = 'pi' THEN 'local' ELSE 'unknown' END AS device FROM e LEFT JOIN m USING (dedup_key)""",
)
def _(spark, d):
    rows = v.usage_rows(spark, d)
    user = F.col("user_id").cast("string")
    by_session = rows.filter("device <> 'unknown' AND k % 2 = 0 AND session_id IS NOT NULL").select(
        "tool", "session_id", F.lit(None).cast("string").alias("stem"), "device"
    )
    by_stem = rows.filter("k < 3").select(
        F.lit("codex").alias("tool"),
        F.lit(None).cast("string").alias("session_id"),
        F.concat(F.lit("u"), user).alias("stem"),
        F.when(F.col("k") % 3 == 0, "vps").otherwise("local").alias("device"),
    )
    events = rows.select(
        F.concat(F.lit("codex:file:u"), user, F.lit(":"), F.col("event_id").cast("string")).alias("dedup_key"),
        "tool",
        "session_id",
        F.when(F.col("k") % 5 == 0, "windows").otherwise("unknown").alias("device"),
    )
    defaults = literal_table(spark, [("pi", "local")], "tool string, default_device string")
    return dedup.attribute_device(events, by_session.unionByName(by_stem), defaults).select(
        "dedup_key", "device"
    )


@query(
    "normalize_model_backfill",
    """SELECT dedup_key, CASE m WHEN 'deepseek-v4-flash' THEN 'deepseek-v4.1-flash' ELSE m END AS model FROM (
      SELECT dedup_key, CASE k % 5 WHEN 0 THEN 'grok-4.6' WHEN 1 THEN 'glm-5.3-flash' WHEN 2 THEN 'deepseek-v4-flash' WHEN 3 THEN NULL ELSE model END AS m
      FROM usage_rows)""",
)
def _(spark, d):
    k = F.col("k")
    raw = (
        F.when(k % 5 == 0, " Cursor-Grok-4.6-medium-HIGH ")
        .when(k % 5 == 1, "GLM-5.3-Flash")
        .when(k % 5 == 2, "DeepSeek-V4-Flash")
        .when(k % 5 == 3, "  ")
        .otherwise(F.col("model"))
    )
    rows = v.usage_rows(spark, d).withColumn("model", raw)
    return dedup.normalize_model_backfill(rows).select("dedup_key", "model")


@query(
    "correct_input",
    """SELECT dedup_key, CASE WHEN k % 4 = 0 THEN v * 3 ELSE input_tokens END AS input_tokens,
      CASE WHEN k % 4 = 0 THEN v * 3 + output_tokens + reasoning_tokens ELSE total_tokens END AS total_tokens FROM usage_rows""",
)
def _(spark, d):
    rows = v.usage_rows(spark, d)
    fixes = rows.filter("k % 4 = 0").select("dedup_key", (F.col("v") * 3).alias("input_tokens"))
    return dedup.correct_input(rows, fixes).select("dedup_key", "input_tokens", "total_tokens")


# ------------------------------------------------------------------------- file listings


@query(
    "drop_sync_conflicts",
    """SELECT DISTINCT path FROM file_rows WHERE NOT contains(path, '.sync-conflict-') AND NOT contains(path, ' (1).')""",
)
def _(spark, d):
    return files.drop_sync_conflicts(v.file_rows(spark, d)).select("path").distinct()


@query(
    "match_source_path",
    """SELECT path, tool FROM file_rows WHERE path LIKE '%.jsonl' OR (tool = 'codex' AND path LIKE '%.jsonl.zst')""",
)
def _(spark, d):
    return files.match_source_path(v.file_rows(spark, d)).select("path", "tool")


LEDGER = """SELECT path, tool, device, size - CASE WHEN size % 4 = 0 THEN 1 ELSE 0 END AS size, mtime_ms, version FROM file_rows WHERE size % 5 <> 0"""


def _ledger(spark, d) -> DataFrame:
    rows = v.file_rows(spark, d).filter("size % 5 <> 0")
    return rows.withColumn("size", F.col("size") - F.when(F.col("size") % 4 == 0, 1).otherwise(0))


@query(
    "new_or_changed_files",
    """SELECT f.path, f.tool, f.size, l.size IS NOT NULL AND l.size > f.size AS restart
    FROM file_rows f LEFT JOIN (SELECT path, device, max(size) AS size, max(mtime_ms) AS mtime_ms, max(version) AS version FROM ledger GROUP BY 1, 2) l
      ON l.path = f.path AND l.device = f.device
    WHERE l.size IS NULL OR l.size <> f.size OR l.mtime_ms <> f.mtime_ms OR l.version <> 2""",
    {"ledger": LEDGER},
)
def _(spark, d):
    listing = v.file_rows(spark, d).withColumn("path", F.concat_ws("|", "device", "path"))
    ledger = _ledger(spark, d).withColumn("path", F.concat_ws("|", "device", "path"))
    changed = files.new_or_changed_files(listing, ledger, 2)
    path = F.element_at(F.split("path", "[|]"), 2).alias("path")
    return changed.select(path, "tool", "size", "restart")


@query(
    "prune_ledger",
    """SELECT path, device FROM ledger WHERE size % 7 <> 0 OR NOT (starts_with(path, '/home/u/.pi/') OR starts_with(path, '/home/u/.codex/'))""",
    {"ledger": LEDGER},
)
def _(spark, d):
    ledger = _ledger(spark, d).withColumn("path", F.concat(F.col("path"), F.lit("|"), F.col("device")))
    seen = ledger.filter("size % 7 <> 0").select("path")
    kept = files.prune_ledger(ledger, seen, ["/home/u/.pi", "/home/u/.codex/"])
    parts = F.split("path", "[|]")
    return kept.select(F.element_at(parts, 1).alias("path"), F.element_at(parts, 2).alias("device"))


@query(
    "mirror_health",
    """WITH r AS (SELECT * FROM (VALUES ('pi', '/home/u/.pi'), ('codex', '/home/u/.codex/s8-0'), ('ccmr', '/mnt/none')) r(tool, root)),
    f AS (SELECT r.tool, r.root, count(f.path) AS files, max(f.mtime_ms) AS newest_ms FROM r LEFT JOIN file_rows f
      ON f.tool = r.tool AND starts_with(f.path, r.root || '/') GROUP BY 1, 2)
    SELECT tool, root, files, newest_ms, CAST(floor((1706626800000 - newest_ms) / 86400000) AS BIGINT) AS idle_days,
      coalesce(floor((1706626800000 - newest_ms) / 86400000) > 7, false) AS warn FROM f""",
)
def _(spark, d):
    from usagelens.operators.health import mirror_health

    roots = [("pi", "/home/u/.pi"), ("codex", "/home/u/.codex/s8-0"), ("ccmr", "/mnt/none")]
    rows = v.file_rows(spark, d)
    out = mirror_health(rows, roots, v.NOW_MS)
    return out


@query(
    "source_health",
    """WITH src AS (SELECT * FROM (VALUES ('claude-code'), ('ccmr'), ('codex'), ('zcode'), ('dsh'), ('grok'), ('workbuddy'), ('pi'), ('opencode'),
      ('antigravity'), ('kimi'), ('qoder'), ('doubao'), ('doubaowork'), ('cursor'), ('hermes')) s(tool)),
    e AS (SELECT tool, count(*) AS n, max(ts_ms) AS ts FROM usage_events WHERE NOT (tool = 'ccmr' AND ts_ms > 1706620000000) GROUP BY 1),
    c AS (SELECT tool, count(*) AS n, max(ts_ms) AS ts FROM credit_usage GROUP BY 1),
    f AS (SELECT tool, count(*) AS n, max(mtime_ms) AS m FROM file_rows GROUP BY 1),
    s AS (SELECT tool, CAST(sum(CASE WHEN k = 7 THEN 1 ELSE 0 END) AS BIGINT) AS pe FROM usage_rows WHERE tool = 'codex' GROUP BY 1),
    j AS (SELECT src.tool, coalesce(e.n, 0) AS events, coalesce(c.n, 0) AS cn, greatest(e.ts, c.ts) AS last_event_ts,
      coalesce(f.n, 0) AS files, f.m AS last_file_mtime, coalesce(s.pe, 0) AS parse_errors
      FROM src LEFT JOIN e USING (tool) LEFT JOIN c USING (tool) LEFT JOIN f USING (tool) LEFT JOIN s USING (tool))
    SELECT tool, CASE WHEN parse_errors > 0 THEN 'error' WHEN events + cn = 0 THEN 'empty'
        WHEN last_file_mtime > 1706626800000 - 1800000 AND last_file_mtime - last_event_ts > 1800000 THEN 'stale' ELSE 'ok' END AS status,
      events, last_event_ts, files, last_file_mtime, parse_errors,
      CASE WHEN parse_errors > 0 THEN 'bad line' END AS last_error FROM j""",
)
def _(spark, d):
    from usagelens.operators.health import source_health

    rows = v.usage_rows(spark, d)
    stats = (
        rows.filter("tool = 'codex'")
        .groupBy("tool")
        .agg(F.sum(F.when(F.col("k") == 7, 1).otherwise(0)).alias("parse_errors"))
        .withColumn("last_error", F.when(F.col("parse_errors") > 0, "bad line"))
    )
    events = rows.filter("NOT (tool = 'ccmr' AND ts_ms > 1706620000000)")
    return source_health(
        events, v.credit_usage(spark, d), v.file_rows(spark, d), stats, v.NOW_MS
    )


@query(
    "read_table_since",
    """SELECT event_id FROM usage_rows WHERE ts_ms > 1706500000000 - 60000""",
)
def _(spark, d):
    rows = v.usage_rows(spark, d, 1706500000000 - 60000)
    return tables.read_table_since(rows, "ts_ms", 1706500000000, lookback=60_000).select("event_id")


@query("next_watermark", "SELECT max(event_id) AS watermark FROM usage_rows")
def _(spark, d):
    return tables.next_watermark(v.usage_rows(spark, d), "event_id")


# ---------------------------------------------------------------------------------- joins


@query(
    "session_lookup",
    """WITH dim AS (SELECT session_id, '/w/' || max(project) AS directory FROM usage_rows WHERE session_id IS NOT NULL AND k % 2 = 0 GROUP BY 1)
    SELECT dedup_key, regexp_extract(directory, '([^/]+)$', 1) AS name FROM usage_rows LEFT JOIN dim USING (session_id)""",
)
def _(spark, d):
    from usagelens.functions.names import basename

    rows = v.usage_rows(spark, d)
    dim = (
        rows.filter("session_id IS NOT NULL AND k % 2 = 0")
        .groupBy("session_id")
        .agg(F.concat(F.lit("/w/"), F.max("project")).alias("directory"))
    )
    return joins.lookup(rows, dim, "session_id").select(
        "dedup_key", basename(F.col("directory")).alias("name")
    )


@query(
    "pair_requests",
    """WITH q AS (SELECT user_id, k % 3 AS ref, ts_ms AS sent_ms FROM usage_rows WHERE event_type = 'click'),
    p AS (SELECT dedup_key, user_id, k % 3 AS ref, ts_ms FROM usage_rows WHERE event_type = 'view'),
    m AS (SELECT dedup_key, p.ts_ms, max(q.sent_ms) AS sent_ms FROM p JOIN q ON p.user_id = q.user_id AND p.ref = q.ref
      AND q.sent_ms < p.ts_ms GROUP BY dedup_key, p.ts_ms)
    SELECT dedup_key, ts_ms - sent_ms AS duration_ms FROM m WHERE ts_ms - sent_ms <= 90000000""",
)
def _(spark, d):
    rows = v.usage_rows(spark, d)
    ref = (F.col("k") % 3).alias("ref")  # ids are sent again and again
    sent = rows.filter("event_type = 'click'").select("user_id", ref, F.col("ts_ms").alias("sent_ms"))
    replies = rows.filter("event_type = 'view'").select("dedup_key", "user_id", ref, "ts_ms")
    return joins.pair_requests(sent, replies, ["user_id", "ref"], 90_000_000).select(
        "dedup_key", "duration_ms"
    )


@query(
    "session_outcomes",
    """WITH s AS (SELECT session_id, tool, coalesce(project, 'none') AS cwd, min(ts_ms) AS first_ts, max(ts_ms) AS last_ts
      FROM usage_rows WHERE session_id IS NOT NULL GROUP BY 1, 2, 3),
    u AS (SELECT session_id || '@' || cwd AS session_id, tool, cwd, first_ts, last_ts FROM s),
    h AS (SELECT u.session_id, u.tool, c.hash, row_number() OVER (PARTITION BY u.session_id, u.tool ORDER BY c.ts_ms DESC, c.hash DESC) AS rn
      FROM u JOIN commits c ON c.cwd = u.cwd AND NOT c.is_merge AND c.ts_ms BETWEEN u.first_ts AND u.last_ts + 1800000
      WHERE u.tool IN ('claude-code', 'ccmr', 'codex')),
    g AS (SELECT session_id, tool, count(*) AS n, string_agg(hash, ',' ORDER BY rn) FILTER (rn <= 20) AS hashes FROM h GROUP BY 1, 2)
    SELECT u.session_id, u.tool, CASE WHEN u.tool IN ('claude-code', 'ccmr', 'codex') THEN coalesce(n, 0) END AS commits, hashes
    FROM u LEFT JOIN g USING (session_id, tool)""",
)
def _(spark, d):
    cwd = F.coalesce("project", F.lit("none"))
    sessions = (
        v.usage_rows(spark, d)
        .filter("session_id IS NOT NULL")
        .groupBy("session_id", "tool", cwd.alias("cwd"))
        .agg(F.min("ts_ms").alias("first_ts"), F.max("ts_ms").alias("last_ts"))
        .withColumn("session_id", F.concat_ws("@", "session_id", "cwd"))
    )
    out = joins.session_outcomes(sessions, v.commits(spark, d), newest=20)
    hashes = F.array_join(F.transform("commit_list", lambda e: e["hash"]), ",")
    return out.select("session_id", "tool", "commits", hashes.alias("hashes"))


@query(
    "canonical_key",
    """WITH a AS (SELECT *, CASE k % 4 WHEN 0 THEN 'codex:/h/s' || user_id || '/r' || k || '.jsonl:' || event_id
        WHEN 1 THEN 'codex:tc:C:\\x\\R' || k || '.JSONL.zst:' || event_id WHEN 2 THEN 'codex:file:r' || k || ':' || event_id
        ELSE 'pi:' || event_id END AS k0 FROM usage_rows)
    SELECT k0, CASE k % 4 WHEN 0 THEN 'codex:file:r' || k || ':' || event_id WHEN 1 THEN 'codex:tc:file:R' || k || ':' || event_id
      ELSE k0 END AS k1 FROM a""",
)
def _(spark, d):
    k, event = F.col("k"), F.col("event_id").cast("string")
    ks, user = k.cast("string"), F.col("user_id").cast("string")
    key = (
        F.when(k % 4 == 0, F.concat(F.lit("codex:/h/s"), user, F.lit("/r"), ks, F.lit(".jsonl:"), event))
        .when(k % 4 == 1, F.concat(F.lit("codex:tc:C:\\x\\R"), ks, F.lit(".JSONL.zst:"), event))
        .when(k % 4 == 2, F.concat(F.lit("codex:file:r"), ks, F.lit(":"), event))
        .otherwise(F.concat(F.lit("pi:"), event))
    )
    return v.usage_rows(spark, d).select(key.alias("k0")).withColumn("k1", canonical_key(F.col("k0")))


@query(
    "file_stem",
    """SELECT DISTINCT path, CASE WHEN path LIKE '%.jsonl.zst' THEN replace(regexp_extract(path, '([^/]+)$', 1), '.jsonl.zst', '')
      ELSE replace(regexp_extract(path, '([^/]+)$', 1), '.jsonl', '') END AS stem FROM file_rows""",
)
def _(spark, d):
    return v.file_rows(spark, d).select("path", file_stem(F.col("path")).alias("stem")).distinct()
