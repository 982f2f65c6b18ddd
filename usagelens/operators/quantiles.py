"""Exact median and 90th percentile per key, without gathering a key's values in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: histogram steps per factor e; bounds both the buckets of a key and the values of a bucket
_STEPS = 4096


def median_and_p90(samples: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Median (mean of the middle two) and nearest-rank 90th percentile of positive values.

    A logarithmic histogram finds the buckets that hold the wanted ranks; only their rows are
    counted by value. Histogram and counts have map-side parts, and the windows run over
    buckets or distinct values of one bucket.
    """
    rows = samples.withColumn("_b", F.floor(F.log(F.col(value)) * _STEPS))
    histogram = rows.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_c"))
    ordered = W.partitionBy(*keys).orderBy("_b")
    upto = ordered.rowsBetween(W.unboundedPreceding, W.currentRow)
    n = F.col("_n")
    ranks = F.array(
        F.struct(F.lit("lo").alias("label"), F.floor((n + 1) / 2).alias("rank")),
        F.struct(F.lit("hi").alias("label"), (F.floor(n / 2) + 1).alias("rank")),
        F.struct(
            F.lit("p90").alias("label"),
            F.greatest(F.lit(1).cast("long"), F.ceil(n * F.lit(0.9))).alias("rank"),
        ),
    )
    wanted = (
        histogram.withColumn("_upto", F.sum("_c").over(upto))
        .withColumn("_n", F.sum("_c").over(W.partitionBy(*keys)))
        .withColumn(
            "_ranks",
            F.filter(
                ranks,
                lambda r: (r["rank"] <= F.col("_upto")) & (r["rank"] > F.col("_upto") - F.col("_c")),
            ),
        )
        .filter(F.size("_ranks") > 0)
        .select(*keys, "_b", "_n", "_ranks", (F.col("_upto") - F.col("_c")).alias("_before"))
    )
    counted = (
        rows.join(wanted, [*keys, "_b"])
        .groupBy(*keys, "_b", value)
        .agg(
            F.count(F.lit(1)).alias("_c"),
            F.first("_n").alias("_n"),
            F.first("_ranks").alias("_ranks"),
            F.first("_before").alias("_before"),
        )
    )
    within = W.partitionBy(*keys, "_b").orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow)
    hits = (
        counted.withColumn("_upto", F.col("_before") + F.sum("_c").over(within))
        .select(*keys, value, "_n", "_upto", "_c", F.explode("_ranks").alias("r"))
        .filter((F.col("r.rank") <= F.col("_upto")) & (F.col("r.rank") > F.col("_upto") - F.col("_c")))
    )

    def at(label: str):
        return F.max(F.when(F.col("r.label") == label, F.col(value)))

    return hits.groupBy(*keys).agg(
        F.max("_n").alias("n"),
        ((at("lo") + at("hi")) / 2).alias("median"),
        at("p90").alias("p90"),
    )
