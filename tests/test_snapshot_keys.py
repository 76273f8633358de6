"""The last version of a snapshot's rows is only shuffled for where a key comes twice."""

from lexivec.streaming.index_stream import last_version_per_key


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_rows_are_shuffled_for_repeated_keys_only(spark, tmp_path):
    spark.createDataFrame([(1, "a", 1), (None, "b", 1)], "k long, t string, v int").write.parquet(f"{tmp_path}/once")
    spark.createDataFrame([(1, "a", 1), (1, "b", 2), (None, "c", 1), (None, "d", 2)], "k long, t string, v int").write.parquet(f"{tmp_path}/twice")
    once, twice = (spark.read.parquet(f"{tmp_path}/{x}") for x in ("once", "twice"))
    for version in (None, "v"):
        same = last_version_per_key(once, ("k",), version)
        assert sorted(r.t for r in same.collect()) == ["a", "b"] and exchanges(same) == 0
    assert sorted(r.t for r in last_version_per_key(twice, ("k",), "v").collect()) == ["b", "d"]
    assert last_version_per_key(twice, ("k",), None).count() == 2
