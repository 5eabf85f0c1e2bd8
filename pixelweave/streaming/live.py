"""Live stacking: per-batch partial sums in Parquet, merged by levels while the stream runs.

Every batch writes under its own ``batch_id`` and reads only what earlier batches wrote,
so a repeated batch replaces its own output and nothing else.  FAN tables of one level are merged into one
of the next when the last of them is written, so a reader meets at most FAN - 1 tables per level; tables that a merged one
covers are removed FAN batches later, when no repeat can need them.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Weighting
from ..functions import scan
from ..model import FRAME, PIXEL
from ..operators import lucky as L
from ..operators import stack as K

LIMITS = ("min_fwhm", "max_fwhm", "min_snr", "max_snr")
FAN = 8


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def _before(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    df = _read(spark, path)
    return None if df is None else df.filter(F.col("batch_id") < batch_id)


def _store(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


# ---- levels ----------------------------------------------------------------------


def _tables(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """(level, batch_id) of the tables under ``path`` that have rows; few, since merged ones are removed."""
    df = _read(spark, path)
    return [] if df is None else sorted((r.level, r.batch_id) for r in df.select("level", "batch_id").distinct().collect())


def _covers(upper: tuple[int, int], lower: tuple[int, int]) -> bool:
    """A table of level k holds the FAN**k batches that end with its own."""
    return lower[0] < upper[0] and upper[1] - FAN ** upper[0] < lower[1] <= upper[1]


def _place(path: str, table: tuple[int, int]) -> str:
    return f"{path}/level={table[0]}/batch_id={table[1]}"


def _union(spark: SparkSession, path: str, tables: list[tuple[int, int]]) -> DataFrame | None:
    return spark.read.parquet(*[_place(path, t) for t in tables]) if tables else None


def _held(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The rows of all batches (before one), each batch once."""
    tables = [t for t in _tables(spark, path) if before is None or t[1] < before]
    return _union(spark, path, [t for t in tables if not any(_covers(u, t) for u in tables)])


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def _put(df: DataFrame, path: str, batch_id: int, merged) -> None:
    """Write a batch's rows and merge the levels that are full with it; ``merged`` makes one table of several."""
    spark = df.sparkSession
    known = _tables(spark, path)
    for t in known:
        if any(_covers(u, t) and u[1] < batch_id - FAN for u in known):
            _remove(spark, _place(path, t))
    df.write.mode("overwrite").parquet(_place(path, (0, batch_id)))
    level = 1
    while (batch_id + 1) % FAN**level == 0:
        parts = [t for t in _tables(spark, path) if t[0] == level - 1 and _covers((level, batch_id), t)]
        whole = _union(spark, path, parts)
        if whole is not None:
            merged(whole).write.mode("overwrite").parquet(_place(path, (level, batch_id)))
        level += 1


# ---- the stack -------------------------------------------------------------------


def live_weights(quality: DataFrame, earlier: DataFrame | None, config: Weighting, block: int = 4096) -> tuple[DataFrame, DataFrame]:
    """(weights of this batch, limits after it: one row per session) given the limits before it.

    ``quality``: session, frame_id, frame_number, fwhm, snr; ``earlier``: session and limits.
    """
    values = {
        "min_fwhm": ("min", F.col("fwhm")),
        "max_fwhm": ("max", F.col("fwhm")),
        "min_snr": ("min", F.col("snr")),
        "max_snr": ("max", F.col("snr")),
    }
    extreme = lambda c: F.min if c.startswith("min") else F.max
    r = scan.running(scan.number_blocks(quality, "frame_number", block), ["session"], ["frame_number"], values).drop(scan.BLOCK)
    if earlier is not None:
        e = earlier.groupBy("session").agg(*[extreme(c)(c).alias(f"_{c}") for c in LIMITS])
        r = r.join(e, "session", "left")
        for c in LIMITS:
            r = r.withColumn(c, (F.least if c.startswith("min") else F.greatest)(F.col(c), F.col(f"_{c}")))
    after = r.select("session", *LIMITS)
    if earlier is not None:
        # sessions that this batch does not touch keep theirs
        after = after.unionByName(earlier.select("session", *LIMITS))
    after = after.groupBy("session").agg(*[extreme(c)(c).alias(c) for c in LIMITS])
    weight = F.lit(1.0) if config.disabled else K.weight_expr(config)
    return r.withColumn("weight", weight).select(*FRAME, "frame_number", "weight"), after


def add_batch(pixels: DataFrame, quality: DataFrame, path: str, batch_id: int, config: Weighting = Weighting()) -> None:
    """Stack one batch of aligned frames into ``path``.

    A frame whose rows come in several batches counts once and keeps the weight of its first.
    """
    spark = pixels.sparkSession
    limits = f"{path}/limits"
    before = [t for t in _tables(spark, limits) if t[1] < batch_id]
    weights, after = live_weights(quality, _union(spark, limits, before[-1:]), config)
    seen = _held(spark, f"{path}/frames", batch_id)
    if seen is not None:
        first = seen.join(quality.select(*FRAME).distinct(), FRAME, "left_semi").select(*FRAME, F.col("weight").alias("_first"))
        weights = weights.join(first, FRAME, "left")
        again = weights.filter("_first IS NOT NULL")
        used = weights.withColumn("weight", F.coalesce("_first", "weight")).drop("_first")
        fresh = weights.join(again.select(*FRAME), FRAME, "left_anti").drop("_first")
    else:
        used = fresh = weights
    after.write.mode("overwrite").parquet(_place(limits, (0, batch_id)))
    _put(fresh, f"{path}/frames", batch_id, lambda df: df)
    sums = K.accumulate(K.drop_border(pixels).join(used, FRAME), PIXEL, "weight")
    _put(sums, f"{path}/sums", batch_id, K.merge)
    # only the newest limits are read; those of a few batches stay for repeats
    for t in before[:-1]:
        if t[1] < batch_id - FAN:
            _remove(spark, _place(limits, t))


def current_stack(spark: SparkSession, path: str) -> DataFrame:
    """Stack and coverage of everything stored so far."""
    sums = K.merge(_held(spark, f"{path}/sums"))
    counts = _held(spark, f"{path}/frames").groupBy("session").agg(F.count("*").alias("frames"))
    return K.coverage(K.finish(sums), counts)


def compact(spark: SparkSession, path: str, target: str) -> None:
    """Merge all partial sums into one batch of a new folder; stop the stream first."""
    last = max(t[1] for t in _tables(spark, f"{path}/sums"))
    K.merge(_held(spark, f"{path}/sums")).write.mode("overwrite").parquet(_place(f"{target}/sums", (0, last)))
    _held(spark, f"{path}/frames").write.mode("overwrite").parquet(_place(f"{target}/frames", (0, last)))
    newest = _tables(spark, f"{path}/limits")[-1:]
    _union(spark, f"{path}/limits", newest).write.mode("overwrite").parquet(_place(f"{target}/limits", (0, last)))


def live_stack(stream: DataFrame, path: str, checkpoint: str, config: Weighting = Weighting(), trigger: dict | None = None):
    """Stack a stream of aligned pixel rows that carry frame_number, fwhm and snr.

    A frame's rows may arrive over several batches.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        quality = batch.groupBy(*FRAME, "frame_number").agg(F.first("fwhm").alias("fwhm"), F.first("snr").alias("snr"))
        add_batch(batch.select(*FRAME, "ch", "y", "x", "v"), quality, path, batch_id, config)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def live_best(stream: DataFrame, path: str, checkpoint: str, n: int, trigger: dict | None = None):
    """Keep the n best frames of each session from a stream of session, frame_id, quality.

    The buffer after a batch is the best n of the buffer before it and the batch.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(*FRAME, "quality")
        earlier = _before(spark, path, batch_id)
        if earlier is not None:
            newest = earlier.agg(F.max("batch_id")).first()[0]
            if newest is not None:
                rows = rows.unionByName(earlier.filter(F.col("batch_id") == newest).select(*FRAME, "quality"))
        _store(L.best_n(rows, n).select(*FRAME, "quality"), path, batch_id)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def current_best(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    newest = df.agg(F.max("batch_id").alias("batch_id"))
    return df.join(newest, "batch_id", "left_semi").drop("batch_id")


def latest_only(stream: DataFrame, sink, checkpoint: str, keys: list[str], order: list[str], payload: list[str], trigger: dict | None = None):
    """Hand ``sink(batch_df, batch_id)`` only the newest row per key of every batch, with the number skipped."""
    from ..operators.health import latest_only as batch_form

    def each(batch: DataFrame, batch_id: int) -> None:
        sink(batch_form(batch, keys, order, payload), batch_id)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
