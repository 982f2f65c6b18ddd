"""Global ranks without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from usagelens.session import cut_lineage

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number in its low 33 bits


def global_rank(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """Row number over the whole frame in a total order.

    Rows are range-partitioned and sorted, then written to the checkpoint folder together with
    their place inside the partition, so a lost executor cannot move the borders. The rows that
    precede a partition come from the partition sizes.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut_lineage(
        df.repartitionByRange(partitions, *order)
        .sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    part = F.shiftright("_at", _ROW_BITS)
    # one row per partition
    offsets = (
        placed.groupBy(part.alias("_part"))
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(
            "_part",
            F.coalesce(
                F.sum("_rows").over(
                    W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
                ),
                F.lit(0),
            ).alias("_before"),
        )
    )
    inside = F.col("_at").bitwiseAND((1 << _ROW_BITS) - 1)
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, (inside + F.col("_before") + 1).cast("long"))
        .drop("_at", "_part", "_before")
    )
