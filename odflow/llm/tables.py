"""Reading the tables, and sums that run over a whole table without one task seeing all rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shielded(docs: DataFrame, own: Sequence[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with all columns but ``own`` under names that nothing else has, and what gives them their names back."""
    names = {c: c if c in own else f"_extra_{i}" for i, c in enumerate(docs.columns)}
    hidden = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    return hidden, lambda frame: frame.select(*[F.col(n).alias(c) for c, n in names.items()])


def width(spark: SparkSession) -> int:
    """Tasks of a shuffle, as the session sets them."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def running_start(frame: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str, parts: int) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the same keys that stand before the row.

    A key's rows are dealt to ``parts`` hashed parts; the order is part, then ``order``. Parts are summed first,
    their few sums run per key, and each part's rows run on from there, so that a hot key is never sorted in one
    task. ``order`` must tell rows apart, or tied rows must be equal in ``value``.
    """
    dealt = frame.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int"))
    sums = dealt.groupBy(*keys, "_part").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_part").alias("_k_part"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    same = F.col("_part") == F.col("_k_part")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    earlier = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        dealt.withColumn(out, F.coalesce(F.sum(value).over(earlier), F.lit(0)))
        .join(sums, same)
        .withColumn(out, F.col(out) + F.col("_base"))
        .drop("_part", "_k_part", "_base", *[f"_k_{k}" for k in keys])
    )
