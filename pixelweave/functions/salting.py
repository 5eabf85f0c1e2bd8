"""Equi-joins on cells with crowded cells split by measured size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# rows of the larger side that one (cell, salt) should hold at most
CELL_ROWS = 20_000
# heavy cells, and salts of one, at most; a cell that is not among the HEAVY largest has under 1/HEAVY of all rows
HEAVY = 4096
# rows of the smaller side up to which it goes to the larger one
FEW_ROWS = 400_000


def heavy_cells(rows: DataFrame, keys: list[str], limit: int = CELL_ROWS) -> DataFrame:
    """keys and ``_salts`` (two or more) of the largest cells with more rows than the limit; at most HEAVY of them."""
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > limit)
    salts = F.least(F.ceil(F.col("_rows") / limit), F.lit(HEAVY)).cast("int")
    return sizes.orderBy(F.desc("_rows"), *keys).limit(HEAVY).select(*keys, salts.alias("_salts"))


def salted_join(many: DataFrame, few: DataFrame, keys: list[str], spread: Column, limit: int = CELL_ROWS, partitions: int | None = None) -> DataFrame:
    """Inner join on ``keys``. A heavy cell of ``many`` is dealt over its salts by ``spread``; rows of ``few`` in it get
    one copy per salt. Rows in other cells have a single copy.

    ``many`` is read twice (its cells are counted first), so it should be stored or cheap. ``partitions``: the number of join partitions
    where the result is far larger than the input, which would otherwise be coalesced into few tasks.
    """
    heavy = F.broadcast(heavy_cells(many, keys, limit))
    salts = F.coalesce("_salts", F.lit(1))
    left = many.join(heavy, keys, "left").withColumn("_salt", F.pmod(F.hash(spread), salts)).drop("_salts")
    right = few.join(heavy, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    on = [*keys, "_salt"]
    if partitions is not None:
        left = left.repartition(partitions, *on)
    return left.join(right, on).drop("_salt")


def cell_join(many: DataFrame, few: DataFrame, keys: list[str], spread: Column, limit: int = CELL_ROWS, most: int = FEW_ROWS) -> DataFrame:
    """Inner join on ``keys``: where ``few`` has at most ``most`` rows, counted, it is sent to the rows of ``many``, which keep their
    partitions and their order; otherwise `salted_join`."""
    if few.count() <= most:
        return many.join(F.broadcast(few), keys)
    return salted_join(many, few, keys, spread, limit, int(many.sparkSession.conf.get("spark.sql.shuffle.partitions")))
