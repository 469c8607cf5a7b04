"""Per-key results when a few keys hold most rows.

Every aggregate here is algebraic, so each map task folds its rows into one
state per key (Spark's hash aggregate, which spills sorted states when its
memory is used up) and only those states shuffle: a key with a third of all
rows arrives as at most one row from each map task.

Results by case: rows with a null key are left out; a null, NaN or infinite
weight counts for the degree and adds nothing to the sum, every finite weight
adds its whole value; a key whose weights are all null has sum 0; a sum beyond
the range of doubles is infinite; repeated rows count each; an empty table gives an
empty result; other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Weights from here on are summed as doubles.
LARGE = 1e12
#: A power of two by which large weights are divided, so that no sum of them overflows on the way.
SCALE = 2.0**70


def sum_parts(weight: Column) -> dict[str, Column]:
    """Partial sums of all finite weights, which may be added up again over groups.

    Weights below LARGE are summed in decimals of six places: the same for every order of rows and number of
    partitions.  What they have beyond six places, and larger weights, are summed as doubles, whose last bits may
    depend on the order.
    """
    size = F.abs(weight)
    small = F.when(size < F.lit(LARGE), weight)
    places = small.cast("decimal(20,6)")
    large = F.when((size >= F.lit(LARGE)) & (size < F.lit(float("inf"))), weight / F.lit(SCALE))
    return {"_places": F.sum(places), "_beyond": F.sum(small - places.cast("double")), "_large": F.sum(large)}


def sum_of(places: Column, beyond: Column, large: Column) -> Column:
    return sum((F.coalesce(x, F.lit(0.0)) for x in (beyond, large * F.lit(SCALE))), F.coalesce(places.cast("double"), F.lit(0.0)))


def whole_sum(weight: Column) -> Column:
    """Sum of all finite weights."""
    return sum_of(*sum_parts(weight).values())


def key_totals(df: DataFrame, key: str, weight: str, name: str = "vertex") -> DataFrame:
    """(name, degree, sum_weight) of every key."""
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias(name), F.col(weight).cast("double").alias("_w"))
    return rows.groupBy(name).agg(F.count(F.lit(1)).alias("degree"), whole_sum(F.col("_w")).alias("sum_weight"))


def frequent_keys(df: DataFrame, key: str, share: float, name: str = "vertex") -> DataFrame:
    """Keys that hold at least `share` of the rows with a key: (name, n, total).

    The total comes from the per-key counts, not from a second scan; it is one row.
    """
    counts = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(name)).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total), F.col("n") >= F.col("total") * F.lit(share))
