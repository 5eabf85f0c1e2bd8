from pyspark.sql import functions as F

from pixelweave.model import FRAME
from pixelweave.operators import background as B
from pixelweave.operators import stats as S
from pixelweave.operators import tone as R


def frames_and_pixels(spark):
    rows = [(0, f, c, y, x, ((f * 7 + c * 5 + y * 3 + x) % 11) / 11.0) for f in range(4) for c in range(3) for y in range(6) for x in range(6)]
    pixels = spark.createDataFrame(rows, "session bigint, frame_id bigint, ch int, y int, x int, v double")
    return pixels, pixels.select(*FRAME).distinct().selectExpr("*", "6 AS width", "6 AS height", "3 AS channels")


def test_tasks_follow_the_samples(spark):
    _, frames = frames_and_pixels(spark)
    assert [S.tasks_for(frames, n) for n in (10**6, 432, 431, 10)] == [1, 1, 2, 44]
    assert S.tasks_for(frames.drop("channels"), 36) == 4
    assert S.tasks_for(frames.filter("false")) == 1


def test_groups_of_a_median_are_dealt_by_samples(spark, monkeypatch):
    pixels, frames = frames_and_pixels(spark)
    queries = {
        "stats": lambda: S.image_stats(pixels, frames),
        "luminance": lambda: S.luminance_stats(pixels, frames),
        "background": lambda: S.detection_background(pixels.filter("ch = 0").drop("ch"), frames, 2.0),
        "balance": lambda: R.grid_white_balance(pixels, frames, 2, 35.0),
        "blocks": lambda: B.block_medians(pixels, frames, 2, 2),
    }
    before = {name: sorted(map(tuple, q().collect())) for name, q in queries.items()}
    # adaptive execution would merge the small inputs into few tasks, and the sorted copies of a window are many
    monkeypatch.setattr(S.tasks_for, "__defaults__", (36,))
    for name, q in queries.items():
        df = q()
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "RepartitionByExpression" in plan and ", 12" in plan.replace("\n", " "), name
        assert sorted(map(tuple, df.collect())) == before[name]


def test_pixels_are_dealt_by_frame_or_by_row(spark):
    pixels, frames = frames_and_pixels(spark)
    for samples, tasks, keys in ((108, 4, FRAME), (50, 9, [*FRAME, "y"])):
        out = S.dealt(pixels, frames, samples).withColumn("task", F.spark_partition_id())
        # a frame larger than a task's share is dealt by its rows, and no key is split
        assert out.rdd.getNumPartitions() == tasks
        assert out.select(*keys, "task").distinct().count() == pixels.select(*keys).distinct().count()
        assert out.count() == pixels.count()
