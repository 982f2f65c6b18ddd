"""Model names, labels, display names and other text functions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from usagelens import fixed


def trim_all(c: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    ws = fixed.WHITESPACE
    return F.regexp_replace(c, f"^{ws}+|{ws}+$", "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def normalize_model(c: Column) -> Column:
    """Trimmed lower-case id without vendor prefix and effort suffixes; aliases resolved."""
    name = blank_to_null(F.lower(trim_all(c)))
    name = F.regexp_replace(name, fixed.VENDOR_PREFIX, "$1")
    name = F.regexp_replace(name, fixed.EFFORT_SUFFIXES, "$1")
    # nested replacements evaluate the name once; a CASE would evaluate it per branch
    for alias, model in fixed.MODEL_ALIASES.items():
        name = F.regexp_replace(name, f"^{re.escape(alias)}$", model)
    return name


def pricing_model(model: Column, tool: Column) -> Column:
    """Same-price aliases, valid only for the source that uses them."""
    out = None
    for source, alias, priced in fixed.PRICING_ALIASES:
        hit = (tool == source) & (model == alias)
        out = (F if out is None else out).when(hit, F.lit(priced))
    return out.otherwise(model)


def basename(c: Column) -> Column:
    """Last path component, for both separators; a trailing separator is ignored."""
    return F.regexp_extract(c, r"([^/\\]+)[/\\]*$", 1)


def parent_dir(c: Column) -> Column:
    """Everything before the last separator."""
    return F.regexp_replace(c, r"[/\\]+[^/\\]*$", "")


def file_stem(c: Column) -> Column:
    """File name without its log suffix."""
    return F.regexp_replace(basename(c), fixed.LOG_SUFFIX, "")


def estimate_tokens(text: Column) -> Column:
    """One token per CJK character, one per started group of four others; null counts 0."""
    whole = F.length(text)
    other = F.length(F.regexp_replace(text, fixed.CJK_CLASS, ""))
    return F.coalesce((whole - other) + F.ceil(other / 4), F.lit(0)).cast("long")


def normalize_display_model(name: Column) -> Column:
    """Human-readable model title to slug: effort words dropped, known family kept."""
    slug = F.regexp_replace(trim_all(name), r"\([^)]*\)", " ")
    slug = F.regexp_replace(slug, fixed.DISPLAY_EFFORT_WORDS, " ")
    slug = F.regexp_replace(F.lower(slug), r"[^a-z0-9.]+", "-")
    slug = F.regexp_replace(slug, r"^-+|-+$", "")
    earlier = ""
    for family in fixed.DISPLAY_FAMILIES:
        # families are tried in order: one that occurs hides the later ones
        guard = f"(?!.*(?:{earlier}))" if earlier else ""
        slug = F.regexp_replace(slug, f"^{guard}.*?({family}.*)$", "$1")
        earlier = f"{earlier}|{family}" if earlier else family
    slug = F.regexp_replace(slug, f"^(?!(?:{earlier})-)(.+)$", "antigravity-$1")
    return blank_to_null(slug)


def parse_model_selection(text: Column) -> Column:
    """Model named in a settings-change message, as slug; null when there is none."""
    title = F.regexp_extract(text, fixed.MODEL_SELECTION, 1)
    return normalize_display_model(blank_to_null(title))


def _has_blocked_word(c: Column) -> Column:
    low = F.lower(c)
    return reduce(lambda a, b: a | b, [low.contains(w) for w in fixed.BLOCKED_WORDS])


def sanitize_name(c: Column) -> Column:
    """Public nickname: invisible characters removed, blanks squeezed; invalid gives null."""
    name = F.regexp_replace(c, fixed.INVISIBLE_CLASS, "")
    name = trim_all(F.regexp_replace(name, fixed.WHITESPACE + "+", " "))
    bad = (
        (name == "")
        | name.rlike(fixed.LINK_PATTERN)
        | name.contains("@")
        | _has_blocked_word(name)
        | (F.length(name) > fixed.NAME_MAX)
    )
    return F.when(~bad, name)


def ok_label(c: Column) -> Column:
    """Identifier-shaped model or tool name without links or blocked words."""
    return c.rlike(fixed.LABEL_PATTERN) & ~c.rlike(fixed.LINK_PATTERN) & ~_has_blocked_word(c)


def safe_category(c: Column, unknown: str) -> Column:
    """Category label safe to publish; key-like or irregular values get a fixed label."""
    regular = c.rlike(fixed.CATEGORY_PATTERN) & ~c.rlike(fixed.KEY_LIKE_PATTERN)
    return (
        F.when(c.isNull() | (c == ""), F.lit(unknown))
        .when(regular, c)
        .otherwise(F.lit(fixed.UNREGULATED_CATEGORY))
    )


def masked_model(c: Column) -> Column:
    """A model id only if it looks like one and not like a key."""
    return F.when(c.rlike(fixed.MASKED_MODEL_PATTERN) & ~c.rlike(fixed.MASKED_KEY_LIKE), c)


def pretty_model(c: Column) -> Column:
    """Dotted minor version for display (``x-5-5`` to ``x-5.5``); only the first match."""
    return F.regexp_replace(c, r"^(.*?)-(\d+)-(\d)(-|$)", "$1-$2.$3$4")


def display_model(c: Column) -> Column:
    """Chart name: one family is merged, the rest is only prettified."""
    family, merged = fixed.MERGED_CHART_FAMILY
    return pretty_model(F.when(c.startswith(family), F.lit(merged)).otherwise(c))


def window_label(minutes: Column) -> Column:
    """Quota windows named by their length."""
    m = F.coalesce(minutes, F.lit(0)).cast("long")
    return (
        F.when(m == 10080, F.lit("每周"))
        .when((m > 0) & (m % 1440 == 0), F.concat((m / 1440).cast("long").cast("string"), F.lit(" 天")))
        .when((m > 0) & (m % 60 == 0), F.concat((m / 60).cast("long").cast("string"), F.lit(" 小时")))
        .otherwise(F.concat(m.cast("string"), F.lit(" 分钟")))
    )


def to_fixed(d: Column, digits: int) -> Column:
    """Decimal text of a double, half-way cases upward and decided on the exact binary value."""
    power = float(2 ** (digits + 1))
    halfway = F.pmod(d * power, F.lit(2.0)) == 1.0
    nudged = F.when(halfway, d + 10.0 ** -(digits + 3)).otherwise(d)
    pattern = "0" if digits == 0 else "0." + "0" * digits
    return F.call_function("format_number", nudged, F.lit(pattern))


def fmt_compact(n: Column, style: str = "kmb") -> Column:
    """Compact number: ``kmb`` (K/M/B), ``cn`` (万/亿) or ``axis`` (K/M/亿)."""
    x = F.coalesce(n, F.lit(0)).cast("double")
    steps = {
        "kmb": [(1e9, 2, "B"), (1e6, 1, "M"), (1e3, 1, "K")],
        "cn": [(1e8, 2, " 亿"), (1e4, 1, " 万")],
        "axis": [(1e8, 1, "亿"), (1e6, 1, "M"), (1e3, 0, "K")],
    }[style]
    out = None
    for limit, digits, unit in steps:
        text = F.concat(to_fixed(x / limit, digits), F.lit(unit))
        out = (F if out is None else out).when(x >= limit, text)
    return out.otherwise(F.floor(x + 0.5).cast("string"))


def fmt_countdown(ms: Column) -> Column:
    """Remaining time as ``D天 H:MM``, ``H:MM:SS`` or ``MM:SS``."""
    total = ms.cast("long")
    days = F.floor(total / 86_400_000)
    hours = F.floor((total % 86_400_000) / 3_600_000).cast("string")
    minutes = F.lpad(F.floor((total % 3_600_000) / 60_000).cast("string"), 2, "0")
    seconds = F.lpad(F.floor((total % 60_000) / 1000).cast("string"), 2, "0")
    return (
        F.when(total.isNull() | (total <= 0), F.lit("已结束"))
        .when(days > 0, F.concat(days.cast("string"), F.lit("天 "), hours, F.lit(":"), minutes))
        .when(total >= 3_600_000, F.concat_ws(":", hours, minutes, seconds))
        .otherwise(F.concat_ws(":", minutes, seconds))
    )
