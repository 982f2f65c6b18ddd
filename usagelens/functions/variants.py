"""Access to parsed JSON (variant) columns. Wrong types read as null, never as an error.

The plain readers cost one path lookup each and convert leniently, as the log formats need;
only the strict ones look at the JSON type.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from usagelens import fixed


def parse(text: Column) -> Column:
    """Parsed JSON, null for malformed text."""
    return F.try_parse_json(text)


def once(c: Column) -> Column:
    """A costly column evaluated once per row, for use in a select.

    Predicates on a projected column move below the projection and take its expression with
    them, one copy per use; they do not move below a generator.
    """
    return F.explode(F.array(c))


def get(v: Column, path: str, type_name: str) -> Column:
    return F.try_variant_get(v, path, type_name)


def text(v: Column, path: str) -> Column:
    """A scalar field as text; blank or absent gives null."""
    return F.nullif(get(v, path, "string"), F.lit(""))


def number(v: Column, path: str) -> Column:
    """Numeric field as double; numeric text counts."""
    return get(v, path, "double")


def count(v: Column, path: str) -> Column:
    """Token counter: absent, null or unreadable counts as 0."""
    return F.coalesce(get(v, path, "double"), F.lit(0.0)).cast("long")


def present(v: Column, path: str) -> Column:
    """Field exists and is not JSON null."""
    value = get(v, path, "variant")
    return value.isNotNull() & ~F.is_variant_null(value)


def is_object(v: Column, path: str) -> Column:
    return get(v, path, "map<string,variant>").isNotNull()


def is_array(v: Column, path: str) -> Column:
    return get(v, path, "array<variant>").isNotNull()


def is_container(v: Column) -> Column:
    return is_object(v, "$") | is_array(v, "$")


# ---------------------------------------------------------------------------------- strict


def type_of(v: Column, path: str) -> Column:
    """Type name of a small field (``STRING``, ``BIGINT``, ``DOUBLE``, ...); null when absent."""
    return F.schema_of_variant(get(v, path, "variant"))


def is_string(v: Column, path: str) -> Column:
    return F.coalesce(type_of(v, path) == "STRING", F.lit(False))


def is_number(v: Column, path: str) -> Column:
    return F.coalesce(type_of(v, path).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.lit(False))


def strict_number(v: Column, path: str) -> Column:
    """Numeric field as double; text does not count."""
    return F.when(is_number(v, path), get(v, path, "double"))


def safe_int(v: Column, path: str) -> Column:
    """Non-negative safe integer given as a number, or null."""
    value = get(v, path, "double")
    whole = is_number(v, path) & (value == F.floor(value)) & value.between(0, float(fixed.MAX_SAFE_INTEGER))
    return F.when(whole, value.cast("long"))
