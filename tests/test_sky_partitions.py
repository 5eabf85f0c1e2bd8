from pixelweave.operators import sky as N


def test_pairs_keep_their_partitions(spark):
    rows = [(i, i * 0.7 % 360, i * 0.3 % 170 - 85.0) for i in range(300)]
    entries = spark.createDataFrame(rows, "entry_id bigint, ra double, dec double")
    at = entries.withColumnRenamed("entry_id", "position_id").filter("position_id % 10 = 0")
    near = N.within_radius(at, entries, 4.0)
    # adaptive execution would merge the small inputs into few tasks, and the pairs are many
    assert "RepartitionByExpression" in near._jdf.queryExecution().optimizedPlan().toString()
