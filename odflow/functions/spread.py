"""Joins that stay balanced when a few keys hold most rows, and hash-seeded draws."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odflow.session import salt_count, shuffle_width

_SALT = "_salt"
# The only key a flow table may leave NULL; it compares NULL-safe.
_NULLABLE = ("date",)


def lookup_join(
    rows: DataFrame,
    table: DataFrame,
    on: Sequence[str] | Mapping[str, str],
    how: str = "inner",
    spread: Sequence[str] = ("origin", "destination"),
) -> DataFrame:
    """Join ``rows`` to a smaller table, usually one row per key.

    ``on`` names shared columns, or maps a column of ``rows`` to one of ``table``. A table that the planner sizes under its
    broadcast threshold is joined as it is, and broadcast without copies. Above it, both sides shuffle on key *and*
    salt, so a key with a third of all rows is still shared by ``salt_count`` tasks; copies are only made on that path.
    """
    pairs = dict(on) if isinstance(on, Mapping) else {c: c for c in on}
    carried = [c for c in table.columns if c not in pairs.values()]
    if planned_small(table):
        named = table.select(*[F.col(c).alias(f"_on_{i}") for i, c in enumerate(pairs.values())], *carried)
        return rows.join(named, _same(pairs), how).drop(*[f"_on_{i}" for i in range(len(pairs))])
    salts = salt_count(rows.sparkSession)
    # Bits of the hash, never NULL: no filter on the salt sinks below the join, where it would keep
    # steps on the same rows from sharing an exchange.
    salted = rows.withColumn(
        _SALT, F.xxhash64(*[F.col(c) for c in spread]).bitwiseAND(F.lit(salts - 1).cast("long"))
    )
    renamed = [F.col(c).alias(f"_on_{i}") for i, c in enumerate(pairs.values())]
    copies = table.select(
        *renamed, *carried, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("_on_salt")
    )
    joined = salted.join(copies, (F.col(_SALT) == F.col("_on_salt")) & _same(pairs), how)
    return joined.drop(_SALT, "_on_salt", *[f"_on_{i}" for i in range(len(pairs))])


def _same(pairs: Mapping[str, str]) -> Column:
    condition = F.lit(True)
    for i, left in enumerate(pairs):
        right = F.col(f"_on_{i}")
        condition = condition & (F.col(left).eqNullSafe(right) if left in _NULLABLE else F.col(left) == right)
    return condition


def planned_small(table: DataFrame, least: int = 0) -> bool:
    """Whether the planner's size of the table is under the threshold up to which it broadcasts, or under ``least`` where it broadcasts at all."""
    spark = table.sparkSession
    size = int(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    threshold = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return size <= threshold or 0 <= threshold and size <= least


def dealt(rows: DataFrame, tasks: int, columns: Sequence[str]) -> DataFrame:
    """Rows dealt to ``tasks`` by the columns where that is more than the shuffle width; a join or sum by them shuffles no more."""
    return rows.repartition(tasks, *columns) if tasks > shuffle_width(rows.sparkSession) else rows


def hash_order(*cols: Column | str, seed: int = 0) -> Column:
    """A pseudo-random sort key that depends on row ids only, never on partitioning."""
    parts = [F.col(c) if isinstance(c, str) else c for c in cols]
    return F.xxhash64(*parts, F.lit(int(seed)))


def hash_uniform(*cols: Column | str, seed: int = 0) -> Column:
    """A draw in [0, 1) from row ids."""
    return F.pmod(hash_order(*cols, seed=seed), F.lit(1 << 53)).cast("double") / F.lit(float(1 << 53))
