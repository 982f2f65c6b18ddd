"""Deduplication and upsert rules. All are order-exact: ``ord`` is the arrival order.

Every rule is an aggregate with a map-side part, so copies of one key fold before the shuffle
and a key that holds a large share of the rows does not gather in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelens.functions.keys import canonical_key, key_stem
from usagelens.functions.names import normalize_model
from usagelens.operators.skew import running, salted_join
from usagelens.schema import USAGE_COLUMNS
from usagelens.session import cut_lineage


def _of(rule: Column | None, value: Column) -> Column:
    """A value of the rows that follow a rule; without one, of all."""
    return value if rule is None else F.when(rule, value)


def _own_key() -> Column:
    """The key as a column of its own, so that stored folds join the arrivals they come from."""
    return F.col("dedup_key").alias("dedup_key")


def _events_folds(columns: list[str], rule: Column | None = None) -> list[Column]:
    first = F.struct(*[c for c in columns if c not in {"dedup_key", "ord", *USAGE_COLUMNS}])
    largest = F.struct(F.col("output_tokens"), -F.col("ord"))
    return [
        F.min_by(first, _of(rule, F.col("ord"))).alias("f"),
        F.max_by(F.struct(*USAGE_COLUMNS), _of(rule, largest)).alias("u"),
    ]


def dedup_events(arrivals: DataFrame) -> DataFrame:
    """Identity from the first arrival, usage from the earliest row with the largest output."""
    merged = arrivals.groupBy("dedup_key").agg(*_events_folds(arrivals.columns))
    return merged.select("dedup_key", "f.*", "u.*").select(
        "dedup_key", *[c for c in arrivals.columns if c not in ("dedup_key", "ord")]
    )


_CLAUDE_KEY = "claude-code:message:"
_CLAUDE_FILLED = ["model", "project", "session_id"]


def _is_message_key() -> Column:
    return F.col("dedup_key").startswith(_CLAUDE_KEY)


def _message_key() -> Column:
    """The key of a message under either kind of key."""
    message = F.regexp_extract("dedup_key", r"^claude-code:([^:]+):", 1)
    return F.when(_is_message_key(), F.col("dedup_key")).otherwise(F.concat(F.lit(_CLAUDE_KEY), message))


def _message_quality() -> Column:
    return F.when(F.col("usage_quality") == 0, 2).otherwise(F.col("usage_quality")).cast("int")


def _claude_folds(columns: list[str], rule: Column | None = None) -> list[Column]:
    """Of a key: the winner, and of each field to fill its first known value and the last instant it was known."""
    quality = _message_quality()
    kept = [quality.alias(c) if c == "usage_quality" else F.col(c) for c in columns if c not in ("dedup_key", "ord")]
    rank = F.struct(quality.alias("q"), "output_tokens", "total_tokens", -F.col("ord"))
    folds = [F.max_by(F.struct(*kept, "ord"), _of(rule, rank)).alias("w")]
    for c in _CLAUDE_FILLED:
        known = F.col(c).isNotNull() & F.col("ord").isNotNull()
        known = known if rule is None else known & rule
        folds.append(F.min(F.when(known, F.struct("ord", F.col(c).alias("value")))).alias(f"first_{c}"))
        folds.append(F.max(F.when(known, F.col("ord"))).alias(f"last_{c}"))
    return folds


def dedup_claude(arrivals: DataFrame) -> DataFrame:
    """One row per message id by (quality, output, total), the earliest of equals.

    Old-style keys of a message that was observed join its group; unobserved ones stay. Fields
    the winner lacks are taken from the next arrival that has them.
    """
    folded = cut_lineage(arrivals.groupBy(_own_key()).agg(*_claude_folds(arrivals.columns)))
    return _messages(folded, arrivals)


def _messages(folded: DataFrame, arrivals: DataFrame, facts: list[str] | None = None) -> DataFrame:
    """Merged messages from the folds of their original keys, so that unobserved old keys remain apart.

    ``facts`` are columns of ``folded`` that belong to a key itself. Arrivals are looked at again only for winners that
    lack a field which was known before them and after them.
    """
    facts = facts or []
    kept = [c for c in arrivals.columns if c not in ("dedup_key", "ord")]
    per_key = folded.withColumn("old_key", F.when(~_is_message_key(), F.col("dedup_key"))).withColumn("dedup_key", _message_key())
    is_new = F.col("old_key").isNull()
    fills = [f(f"{when}_{c}").alias(f"{when}_{c}") for c in _CLAUDE_FILLED for when, f in (("first", F.min), ("last", F.max))]
    observed = per_key.groupBy("dedup_key").agg(
        F.max(is_new).alias("observed"),
        F.max_by("w", F.struct("w.usage_quality", "w.output_tokens", "w.total_tokens", -F.col("w.ord"))).alias("w"),
        *fills,
        *[F.max(F.when(is_new, F.col(c))).alias(c) for c in facts],
    )
    winners = observed.filter("observed").drop("observed")
    unobserved = (
        per_key.filter(F.col("old_key").isNotNull())
        .join(per_key.filter(is_new).select("dedup_key"), "dedup_key", "left_anti")
        .select(F.col("old_key").alias("dedup_key"), *[F.col(f"w.{c}") for c in kept], *facts)
    )

    def known_around(c: str) -> Column:
        return F.col(f"w.{c}").isNull() & (F.col(f"first_{c}.ord") <= F.col("w.ord")) & (F.col(f"last_{c}") > F.col("w.ord"))

    lacking = winners.filter(known_around("model") | known_around("project") | known_around("session_id")).select(
        "dedup_key", F.col("w.ord").alias("won_at")
    )
    rows = arrivals.filter(F.coalesce(*[F.col(c).cast("string") for c in _CLAUDE_FILLED]).isNotNull()).withColumn("dedup_key", _message_key())
    later = (
        salted_join(rows.select("dedup_key", "ord", *_CLAUDE_FILLED), lacking, ["dedup_key"], spread_by="ord")
        .filter(F.col("ord") > F.col("won_at"))
        .groupBy("dedup_key")
        .agg(
            *[
                F.min_by(c, F.when(F.col(c).isNotNull(), F.col("ord"))).alias(f"later_{c}")
                for c in _CLAUDE_FILLED
            ]
        )
    )

    def filled(c: str) -> Column:
        first = F.col(f"first_{c}")
        return F.coalesce(f"w.{c}", F.when(first["ord"] > F.col("w.ord"), first["value"]), f"later_{c}").alias(c)

    found = winners.join(later, "dedup_key", "left").select(
        "dedup_key", *[filled(c) if c in _CLAUDE_FILLED else F.col(f"w.{c}") for c in kept], *facts
    )
    return found.unionByName(unobserved)


def dedup_request_alias(events: DataFrame, seen_legacy_keys: DataFrame, tool: str = "dsh") -> DataFrame:
    """Drop old-style rows whose key was met in the snapshot that produced request keys.

    ``seen_legacy_keys`` has one row per (dedup_key, legacy_key).
    """
    stale = (
        seen_legacy_keys.filter(F.col("legacy_key") != F.col("dedup_key"))
        .select(F.col("legacy_key").alias("dedup_key"), F.lit(tool).alias("tool"))
        .distinct()
    )
    return events.join(stale, ["dedup_key", "tool"], "left_anti")


def _strength() -> Column:
    metric = (
        F.when(F.col("usage_quality") == 2, F.col("output_tokens"))
        .when(F.col("usage_quality") == 1, F.col("total_tokens"))
        .otherwise(F.lit(0))
    )
    return F.struct("usage_quality", metric.alias("m"))


def _quality_folds(columns: list[str], rule: Column | None = None) -> list[Column]:
    usage = [*USAGE_COLUMNS, "usage_quality"]
    first = [c for c in columns if c not in {"dedup_key", "ord", *usage, "model"}]
    strongest = F.struct(_strength().alias("strength"), "ord")
    return [
        F.min_by(F.struct(*first), _of(rule, F.col("ord"))).alias("qf"),
        F.max_by(F.struct(*usage, "model"), _of(rule, strongest)).alias("qu"),
        F.max(_of(rule, F.when(F.col("model").isNotNull(), F.struct(_strength().alias("strength"), "ord", "model")))).alias("best_known"),
        F.min(_of(rule, F.when(F.col("model").isNull(), F.col("ord")))).alias("first_unknown"),
    ]


def dedup_quality(arrivals: DataFrame, chunk_size: int = 1_000_000) -> DataFrame:
    """Better quality wins; equals by latest (exact), output (context) or total (estimate).

    Identity follows the first arrival. The model is the last known one among the rows that
    were accepted when they arrived; only keys whose winner has no model, and whose folds leave it open, need that look-back.
    """
    folded = cut_lineage(arrivals.groupBy(_own_key()).agg(*_quality_folds(arrivals.columns)))
    return _graded(folded, arrivals, chunk_size)


def _graded(folded: DataFrame, arrivals: DataFrame, chunk_size: int = 1_000_000, facts: list[str] | None = None) -> DataFrame:
    """Merged graded rows from the folds of their keys; ``facts`` are columns of ``folded`` that go along."""
    facts = facts or []
    rows = arrivals.withColumn("strength", _strength())
    # the strongest row with a model was accepted for certain if all rows before it have one
    certain = F.coalesce(F.col("best_known.ord") < F.col("first_unknown"), F.lit(False))
    resolved = folded.select(
        "dedup_key", "qf.*", "qu.*", F.when(certain, F.col("best_known.model")).alias("certain_model"),
        (F.col("best_known").isNotNull() & ~certain).alias("open_model"), *facts,
    )
    lacking = resolved.filter(F.col("model").isNull() & F.col("open_model")).select("dedup_key")
    history = salted_join(
        rows.select("dedup_key", "ord", "model", "strength"), lacking, ["dedup_key"], "left_semi", "ord"
    ).withColumn("slice", F.floor(F.col("ord") / chunk_size))
    accepted = running(
        history, ["dedup_key"], "slice", ["ord"], {"best": ("max", F.col("strength"))}
    ).filter(F.col("strength") == F.col("best"))
    last_model = accepted.groupBy("dedup_key").agg(
        F.max_by("model", F.when(F.col("model").isNotNull(), F.col("ord"))).alias("known_model")
    )
    out = resolved.join(last_model, "dedup_key", "left").withColumn(
        "model", F.coalesce("model", "certain_model", "known_model")
    )
    return out.select("dedup_key", *[c for c in arrivals.columns if c not in ("dedup_key", "ord")], *facts)


def note_duration(events: DataFrame, pairs: DataFrame) -> DataFrame:
    """Attach request latencies: positive, and only ever growing."""
    longest = (
        pairs.filter(F.col("duration_ms") > 0)
        .groupBy("dedup_key")
        .agg(F.max("duration_ms").alias("noted"))
    )
    return (
        events.join(longest, "dedup_key", "left")
        .withColumn("duration_ms", F.greatest("duration_ms", "noted"))
        .drop("noted")
    )


def latest_snapshot(snapshots: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """The strictly newest snapshot per key; equal instants keep the first arrival."""
    rest = [c for c in snapshots.columns if c not in keys]
    return (
        snapshots.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.struct(F.col("ts_ms"), -F.col(order))).alias("s"))
        .select(*keys, "s.*")
    )


def dedup_ledger(rows: DataFrame) -> DataFrame:
    """Tool calls and credits: the first arrival of a key stays."""
    rest = [c for c in rows.columns if c not in ("dedup_key", "ord")]
    return (
        rows.groupBy("dedup_key")
        .agg(F.min_by(F.struct(*rest), "ord").alias("f"))
        .select("dedup_key", "f.*")
    )


def replace_file_rows(
    base: DataFrame, batch: DataFrame, stems: DataFrame, current_stems: DataFrame
) -> DataFrame:
    """Full rescan of files: their old rows go first, unless a sibling copy is already current."""
    stale = stems.select("stem").distinct().join(current_stems.select("stem"), "stem", "left_anti")
    kept = (
        base.withColumn("stem", key_stem(F.col("dedup_key")))
        .join(stale, "stem", "left_anti")
        .select(*base.columns)
    )
    return kept.unionByName(batch, allowMissingColumns=True)


def drop_old_key_version(events: DataFrame, tool: str) -> DataFrame:
    """Rows of a tool whose key has fewer than four segments belong to an old key format."""
    old = (F.col("tool") == tool) & (F.size(F.split("dedup_key", ":")) < 4)
    return events.filter(~old)


def migrate_keys(events: DataFrame, tool: str = "codex") -> tuple[DataFrame, DataFrame]:
    """Rename path keys to canonical keys; returns (events, audit copy of touched rows).

    On collision the larger (output, total) stays, then the row that was canonical already. A
    row of another tool under the same key raises when the result is computed.
    """
    rows = events.withColumn("old_key", F.col("dedup_key")).withColumn(
        "dedup_key",
        F.when(F.col("tool") == tool, canonical_key(F.col("dedup_key"))).otherwise(F.col("dedup_key")),
    )
    renamed = F.col("old_key") != F.col("dedup_key")
    rest = [c for c in events.columns if c != "dedup_key"]
    order = F.struct("output_tokens", "total_tokens", ~renamed, "old_key")
    grouped = rows.groupBy("dedup_key").agg(
        F.max_by(F.struct(*rest), order).alias("w"),
        F.count_distinct("tool").alias("tools"),
        F.max(renamed).alias("touched"),
    )
    foreign = (F.col("tools") > 1) & F.col("touched")
    checked = grouped.withColumn(
        "dedup_key",
        F.when(
            foreign, F.raise_error(F.concat(F.lit("conflicting tool for key "), F.col("dedup_key")))
        ).otherwise(F.col("dedup_key")),
    )
    touched = rows.filter(renamed).select("dedup_key").distinct()
    audit = rows.join(touched, "dedup_key", "left_semi").select(
        F.col("old_key").alias("dedup_key"), *rest
    )
    return checked.select("dedup_key", *[F.col(f"w.{c}").alias(c) for c in rest]), audit


def tag_device(arrivals: DataFrame) -> DataFrame:
    """Device per key: the first known device; unknown only if no arrival knew better."""
    known = F.when(F.col("device") != "unknown", F.col("ord"))
    return arrivals.groupBy("dedup_key").agg(
        F.coalesce(F.min_by("device", known), F.lit("unknown")).alias("device")
    )


def attribute_device(events: DataFrame, files: DataFrame, tool_defaults: DataFrame) -> DataFrame:
    """Device of rows without one, from the files of their session or file stem.

    One candidate decides, several leave it unknown, none falls back to the tool's default.
    ``files`` has tool, session_id, stem and device; ``tool_defaults`` has tool and default_device.
    """
    by_session = files.filter(F.col("session_id").isNotNull()).select(
        "tool", F.concat(F.lit("s:"), "session_id").alias("handle"), "device"
    )
    by_stem = files.filter(F.col("stem").isNotNull()).select(
        "tool", F.concat(F.lit("f:"), "stem").alias("handle"), "device"
    )
    # at most one row per handle: the device, or null when files disagree
    handles = (
        by_session.unionByName(by_stem)
        .groupBy("tool", "handle")
        .agg(F.min("device").alias("lo"), F.max("device").alias("hi"))
    )
    open_rows = events.filter(F.col("device") == "unknown")
    stem = key_stem(F.col("dedup_key"))
    wanted = open_rows.select(
        "dedup_key",
        "tool",
        F.explode(
            F.filter(
                F.array(
                    F.concat(F.lit("s:"), "session_id"),
                    F.concat(F.lit("f:"), stem),
                ),
                lambda h: h.isNotNull(),
            )
        ).alias("handle"),
    )
    found = (
        salted_join(wanted, handles, ["tool", "handle"], spread_by="dedup_key")
        .groupBy("dedup_key")
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    )
    decided = (
        events.join(found, "dedup_key", "left")
        # one row per registered tool
        .join(F.broadcast(tool_defaults), "tool", "left")
    )
    device = (
        F.when(F.col("device") != "unknown", F.col("device"))
        .when(F.col("lo").isNotNull() & (F.col("lo") == F.col("hi")), F.col("lo"))
        .when(F.col("lo").isNotNull(), F.lit("unknown"))
        .otherwise(F.coalesce("default_device", F.lit("unknown")))
    )
    return decided.withColumn("device", device).select(*events.columns)


def normalize_model_backfill(events: DataFrame) -> DataFrame:
    """Stored model names brought to the present normal form."""
    return events.withColumn("model", normalize_model(F.col("model")))


def correct_input(events: DataFrame, fixes: DataFrame) -> DataFrame:
    """Overwrite the input of given keys; their total becomes input + output + reasoning."""
    joined = events.join(
        fixes.select("dedup_key", F.col("input_tokens").alias("fixed_input")), "dedup_key", "left"
    )
    fixed_total = F.col("fixed_input") + F.col("output_tokens") + F.col("reasoning_tokens")
    return (
        joined.withColumn("total_tokens", F.coalesce(fixed_total, F.col("total_tokens")))
        .withColumn("input_tokens", F.coalesce("fixed_input", "input_tokens"))
        .select(*events.columns)
    )


_MESSAGE_TOOL, _QUALITY_TOOL = "claude-code", "antigravity"


def merge_upsert(base: DataFrame, batch: DataFrame, legacy_keys: DataFrame | None = None) -> DataFrame:
    """Rows of ``base`` after ``batch`` arrived: base rows count as the first arrivals.

    Both carry the event columns; ``batch`` also has ``ord``. Messages of one tool follow
    ``dedup_claude``, those with graded usage ``dedup_quality``, all others ``dedup_events``. A key's
    duration only grows and its device is the first known one, whichever arrival brings it.
    ``legacy_keys`` (dedup_key, legacy_key) names the old keys that request keys replace. Applying the
    same batch twice gives the same table.
    """
    names = [c for c in batch.columns if c != "ord"]
    stored = base.withColumn("ord", F.lit(-1).cast("long"))
    arrivals = stored.unionByName(batch, allowMissingColumns=True)
    if "usage_quality" not in names:
        arrivals = arrivals.withColumn("usage_quality", F.lit(0))
    message = (F.col("tool") == _MESSAGE_TOOL) & F.col("dedup_key").startswith(f"{_MESSAGE_TOOL}:")
    graded = F.col("tool") == _QUALITY_TOOL
    plain = ~message & ~graded
    # All rules and the facts of a key are folded in one pass; arrivals are read again for look-backs only.
    facts = {}
    if "duration_ms" in names:
        facts["_noted"] = F.max(F.when(F.col("duration_ms") > 0, F.col("duration_ms")))
    if "device" in names:
        facts["_known"] = F.min_by("device", F.when(F.col("device") != "unknown", F.col("ord")))
    columns = arrivals.columns
    folded = cut_lineage(
        arrivals.groupBy(_own_key()).agg(
            *[F.max(F.coalesce(rule, F.lit(False))).alias(n) for n, rule in (("_plain", plain), ("_message", message), ("_graded", graded))],
            *_events_folds(columns, plain),
            *_claude_folds(columns, message),
            *_quality_folds(columns, graded),
            # a null key is no key: its rows share no facts
            *[F.when(F.col("dedup_key").isNotNull(), fact).alias(n) for n, fact in facts.items()],
        )
    )
    merged = (
        folded.filter("_plain").select("dedup_key", "f.*", "u.*", *facts)
        .unionByName(_messages(folded.filter("_message"), arrivals.filter(message), list(facts)))
        .unionByName(_graded(folded.filter("_graded"), arrivals.filter(graded), facts=list(facts)))
    )
    if legacy_keys is not None:
        merged = dedup_request_alias(merged, legacy_keys)
    if "duration_ms" in names:
        merged = merged.withColumn("duration_ms", F.greatest("duration_ms", "_noted"))
    if "device" in names:
        merged = merged.withColumn("device", F.coalesce("_known", "device"))
    return merged.select(*[c for c in base.columns if c in names])
