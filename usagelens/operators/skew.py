"""Building blocks that keep hot keys from landing in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: rows up to which a frame may be broadcast by hint
BROADCAST_ROWS = 100_000
#: default number of pieces a hot key is cut into
SALTS = 16


def _cell(value, type_name: str) -> str:
    if value is None:
        return f"CAST(NULL AS {type_name})"
    if isinstance(value, str):
        text = value.replace("\\", "\\\\").replace("'", "\\'")
        return f"CAST('{text}' AS {type_name})"
    return f"CAST({str(value).lower() if isinstance(value, bool) else repr(value)} AS {type_name})"


def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A dimension made of literals: an inline table, so its size is known to the planner."""
    fields = T.StructType.fromDDL(schema).fields
    types = [f.dataType.simpleString() for f in fields]
    names = ", ".join(f"`{f.name}`" for f in fields)
    if not rows:
        return spark.createDataFrame([], schema)
    body = ", ".join("(" + ", ".join(_cell(v, t) for v, t in zip(row, types)) + ")" for row in rows)
    table = spark.sql(f"SELECT * FROM VALUES {body} AS t({names})")
    return F.broadcast(table) if len(rows) <= BROADCAST_ROWS else table


def salted_join(
    big: DataFrame,
    small: DataFrame,
    keys: list[str],
    how: str = "inner",
    spread_by: str | None = None,
    salts: int = SALTS,
) -> DataFrame:
    """Equi-join whose hot keys are cut into ``salts`` pieces.

    Each row of ``big`` goes to one piece, each row of ``small`` is copied to every piece, so
    ``small`` should hold few rows per key. Null keys never match; for a left join their rows
    spread over the pieces like all others. ``how`` may be inner, left, left_semi or left_anti.
    """
    source = spread_by or next(c for c in big.columns if c not in keys)
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(source), F.lit(salts)).cast("int"))
    pieces = F.sequence(F.lit(0), F.lit(salts - 1))
    copies = small.withColumn("_salt", F.explode(pieces))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")


def running(
    df: DataFrame,
    keys: list[str],
    chunk: str,
    order: list[str],
    specs: dict[str, tuple[str, Column]],
    null_keys: bool = False,
) -> DataFrame:
    """Ordered running values per key, computed chunk by chunk.

    ``specs`` maps an output column to ``(kind, value)`` with kind ``sum``, ``max`` or ``last``
    (last value that is not null), up to the current row; ``sum_before``, ``max_before`` and
    ``last_before`` leave the current row out. ``chunk`` is a column that rises with the order
    and bounds the rows of one window partition (a file split, a time slice); the value entering
    a chunk comes from the chunk totals, one row per chunk. So one huge key is spread over as
    many tasks as it has chunks. Set ``null_keys`` where a key may be null.
    """
    chunked = W.partitionBy(*keys, chunk).orderBy(*order)
    upto = chunked.rowsBetween(W.unboundedPreceding, W.currentRow)
    before = chunked.rowsBetween(W.unboundedPreceding, -1)
    chunks_before = W.partitionBy(*keys).orderBy(chunk).rowsBetween(W.unboundedPreceding, -1)
    position = F.struct(*order)
    plan = {n: (k.removesuffix("_before"), k.endswith("_before"), v) for n, (k, v) in specs.items()}

    def windowed(kind: str, value: Column, window) -> Column:
        if kind == "last":
            return F.last(value, ignorenulls=True).over(window)
        return (F.sum if kind == "sum" else F.max)(value).over(window)

    def whole(kind: str, value: Column) -> Column:
        if kind == "last":
            return F.max_by(value, F.when(value.isNotNull(), position))
        return (F.sum if kind == "sum" else F.max)(value)

    def merged_value(kind: str, name: str) -> Column:
        local, carry = F.col(f"_in_{name}"), F.col(f"_pre_{name}")
        if kind == "last":
            return F.coalesce(local, carry)
        if kind == "max":
            return F.greatest(local, carry)
        return F.coalesce(local, F.lit(0)) + F.coalesce(carry, F.lit(0))

    rows = df.select(
        "*",
        *[
            windowed(kind, value, before if excluded else upto).alias(f"_in_{n}")
            for n, (kind, excluded, value) in plan.items()
        ],
    )
    carry = (
        df.groupBy(*keys, chunk)
        .agg(*[whole(kind, value).alias(f"_all_{n}") for n, (kind, _, value) in plan.items()])
        .select(
            *[F.col(c).alias(f"_k_{c}") for c in [*keys, chunk]],
            *[
                windowed(kind, F.col(f"_all_{n}"), chunks_before).alias(f"_pre_{n}")
                for n, (kind, _, _) in plan.items()
            ],
        )
    )
    matched = None
    for c in [*keys, chunk]:
        same = F.col(c).eqNullSafe(F.col(f"_k_{c}")) if null_keys else F.col(c) == F.col(f"_k_{c}")
        matched = same if matched is None else matched & same
    return rows.join(carry, matched, "left").select(
        *df.columns, *[merged_value(kind, n).alias(n) for n, (kind, _, _) in plan.items()]
    )
