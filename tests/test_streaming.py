from gleaner.streaming.usage import watch_usage


def test_states_only_grow(spark, tmp_path):
    src = tmp_path / "in"
    put = lambda n, rows: spark.createDataFrame(rows, "path string, status int").coalesce(1).write.mode("append").parquet(str(src))
    put(1, [("a", 1), ("b", 0)])
    q = watch_usage(spark.readStream.schema("path string, status int").parquet(str(src)), ["path"], "states")
    try:
        q.processAllAvailable()
        put(2, [("a", 0), ("b", 2)])
        q.processAllAvailable()
        assert {r.path: r.status for r in spark.table("states").collect()} == {"a": 1, "b": 2}
    finally:
        q.stop()
