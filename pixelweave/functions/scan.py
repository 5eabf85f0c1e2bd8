"""Running values over ordered rows without putting a whole key into one task.

A window ``PARTITION BY session ORDER BY n`` sends every row of a session to one
task.  One session may hold a third of the data, so the functions here work in two
levels: rows are cut into blocks, each block is scanned on its own, and the block
totals (one row per block) are scanned and joined back.

Blocks come from a dense number (``number_blocks``) or, where the order has no
such number, from a range partitioning that is written once to the checkpoint
folder (``range_blocks``), so that both levels see the same cut.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle

BLOCK = "_block"


def number_blocks(df: DataFrame, number: str | Column, size: int = 4096) -> DataFrame:
    """Blocks of ``size`` consecutive values of a dense number."""
    number = F.col(number) if isinstance(number, str) else number
    return df.withColumn(BLOCK, F.floor(number / size).cast("long"))


def range_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[Column], partitions: int | None = None) -> DataFrame:
    """Balanced blocks from a range partitioning on (keys, order).

    A key that fills many partitions simply gets many blocks.
    """
    cols = [F.col(k) for k in keys] + list(order)
    spread = df.repartitionByRange(partitions, *cols) if partitions else df.repartitionByRange(*cols)
    return settle(spread.withColumn(BLOCK, F.spark_partition_id().cast("long")))


def _agg(kind: str, value: Column, order_key: Column) -> Column:
    return {
        "sum": lambda: F.sum(value),
        "min": lambda: F.min(value),
        "max": lambda: F.max(value),
        # last non-null value in order
        "last": lambda: F.max_by(value, F.when(value.isNotNull(), order_key)),
    }[kind]()


def _merge(kind: str, here: Column, carried: Column) -> Column:
    return {
        "sum": lambda: F.coalesce(here, F.lit(0)) + F.coalesce(carried, F.lit(0)),
        "min": lambda: F.least(here, carried),
        "max": lambda: F.greatest(here, carried),
        "last": lambda: F.coalesce(here, carried),
    }[kind]()


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: Mapping[str, tuple[str, Column]],
) -> DataFrame:
    """Add running values (current row included) to a blocked ``df``.

    ``values`` maps a new column to ``(kind, column)``; kinds are sum, min, max and
    last (last non-null).  ``order`` names must give a total order within a key.
    """
    order_key = F.struct(*[F.col(c) for c in order])
    in_block = (
        Window.partitionBy(*keys, BLOCK).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    before = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)

    def over(kind: str, value: Column, window) -> Column:
        if kind == "last":
            return F.last(value, ignorenulls=True).over(window)
        return {"sum": F.sum, "min": F.min, "max": F.max}[kind](value).over(window)

    totals = df.groupBy(*keys, BLOCK).agg(
        *[_agg(kind, value, order_key).alias(f"_t_{name}") for name, (kind, value) in values.items()]
    )
    carried = totals.select(
        *keys, BLOCK, *[over(kind, F.col(f"_t_{name}"), before).alias(f"_c_{name}") for name, (kind, _) in values.items()]
    )
    scanned = df.select("*", *[over(kind, value, in_block).alias(f"_i_{name}") for name, (kind, value) in values.items()])
    joined = scanned.join(carried, [*keys, BLOCK], "left")
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[_merge(kind, F.col(f"_i_{name}"), F.col(f"_c_{name}")).alias(name) for name, (kind, _) in values.items()],
    )


def previous(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Mapping[str, Column]
) -> DataFrame:
    """Add the value of the preceding row of the same key (``lag``) to a blocked ``df``."""
    order_key = F.struct(*[F.col(c) for c in order])
    in_block = Window.partitionBy(*keys, BLOCK).orderBy(*order)
    before = Window.partitionBy(*keys).orderBy(BLOCK)
    packed = F.struct(*[v.alias(name) for name, v in values.items()])
    totals = df.groupBy(*keys, BLOCK).agg(F.max_by(packed, order_key).alias("_t"))
    carried = totals.select(*keys, BLOCK, F.lag("_t").over(before).alias("_c"))
    scanned = df.select("*", F.lag(packed).over(in_block).alias("_i"))
    joined = scanned.join(carried, [*keys, BLOCK], "left").withColumn("_p", F.coalesce("_i", "_c"))
    return joined.select(*[F.col(c) for c in df.columns], *[F.col(f"_p.{name}").alias(name) for name in values])


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "rn") -> DataFrame:
    """``row_number`` within a key over a blocked ``df``."""
    return running(df, keys, order, {name: ("sum", F.lit(1).cast("long"))})


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, points: Mapping[str, float]) -> DataFrame:
    """Exact interpolated percentiles per key from distributed ranks.

    Range blocks cut a crowded key into many tasks; only the one or two rows around each
    point are kept, so no task ever holds the values of a key.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).filter("_v IS NOT NULL")
    blocked = range_blocks(rows.withColumn("_u", F.monotonically_increasing_id()), keys, [F.col("_v"), F.col("_u")])
    ranked = numbered(blocked, keys, ["_v", "_u"], "_rank").drop("_u", BLOCK)
    totals = blocked.groupBy(*keys).agg(F.count("*").alias("_n"))
    r = ranked.join(totals, list(keys))
    at = {name: (F.col("_n") - 1) * F.lit(float(q)) for name, q in points.items()}
    near = None
    for position in at.values():
        hit = F.abs(F.col("_rank") - 1 - position) < 1.0
        near = hit if near is None else near | hit
    shares = [
        F.sum(F.greatest(1.0 - F.abs(F.col("_rank") - 1 - position), F.lit(0.0)) * F.col("_v")).alias(name)
        for name, position in at.items()
    ]
    return r.filter(near).groupBy(*keys).agg(*shares)


def unblocked(df: DataFrame) -> DataFrame:
    return df.drop(BLOCK)
