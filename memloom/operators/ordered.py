"""Running totals over ordered groups of any size.

A window over a whole group puts it into one task.  Here a group is cut into buckets of its integer order column: totals
run within the buckets, the buckets' own totals run over the few rows that they are, and the two are added.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Span of the order column that one window sorts.
BUCKET = 10_000


def running(df: DataFrame, group: str, order: Sequence[str], values: dict[str, Column], bucket: int = BUCKET) -> DataFrame:
    """The rows with running sums of ``values`` in each group, in the order of ``order``; its first column is an integer.

    Null groups make one group; rows with a null in the first order column come first; null values count as 0.
    """
    cut = df.withColumn("_bucket", F.coalesce(F.floor(F.col(order[0]) / bucket), F.lit(-(2**40))))
    for name, value in values.items():
        cut = cut.withColumn(f"_v_{name}", F.coalesce(value.cast("long"), F.lit(0)))
    totals = cut.groupBy(group, "_bucket").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in values])
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col(group).alias("_g"), F.col("_bucket").alias("_b"), *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in values])
    within = Window.partitionBy(group, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    for name in values:
        cut = cut.withColumn(f"_r_{name}", F.sum(f"_v_{name}").over(within))
    joined = cut.join(offsets, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_bucket") == F.col("_b")))
    return joined.select(*[F.col(c) for c in df.columns], *[(F.col(f"_r_{n}") + F.col(f"_o_{n}")).alias(n) for n in values])
