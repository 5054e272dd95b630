"""Keyed state of streams: retries, timers, restarts, and the one event of a request."""

from linesmith.streaming import state as K

OUTCOMES = "id string, ok boolean, t long"


def outcomes(spark, folder, rows):
    spark.createDataFrame(rows, OUTCOMES).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(OUTCOMES).parquet(folder).selectExpr("id", "ok", "timestamp_seconds(t) AS at")


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_ladder_survives_restarts_and_its_timers_fire(spark, tmp_path):
    folder, path = f"{tmp_path}/in", f"{tmp_path}/out"
    steps = K.drain(K.retry_ladder(outcomes(spark, folder, [("a", False, 1000), ("b", True, 1000), ("a", True, 1100), (None, True, 1), ("c", None, 1000)])), path)
    first = [("a", "scheduled", 1, 1120, 1000), ("b", "committed", 0, None, 1000)]
    assert rows_of(steps) == first  # the success of a at 1100 was not due
    assert rows_of(K.drain(K.retry_ladder(spark.readStream.schema(OUTCOMES).parquet(folder).selectExpr("id", "ok", "timestamp_seconds(t) AS at")), path)) == first  # nothing new
    steps = K.drain(K.retry_ladder(outcomes(spark, folder, [("z", True, 1200)])), path)
    due, told = ("a", "due", 1, 1120, 1120), ("z", "committed", 0, None, 1200)
    assert rows_of(steps) == sorted(first + [due, told])  # time passed the wait of a
    steps = K.drain(K.retry_ladder(outcomes(spark, folder, [("a", False, 1300), ("b", False, 1300)])), path)
    assert rows_of(steps) == sorted(first + [due, told, ("a", "scheduled", 2, 1540, 1300)])  # b is committed for good


def test_the_sixth_failure_is_the_last_and_reaches_all_lines(spark, tmp_path):
    tries = [("a", False, t) for t in (60, 180, 420, 900, 1860, 3780)] + [("a", True, 9000), ("b", False, 60), ("b", False, 0)]
    steps = K.retry_ladder(outcomes(spark, f"{tmp_path}/in", tries))
    members = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "id string, line_id long")
    assert rows_of(K.drain(K.failures(steps, members), f"{tmp_path}/out")) == [(1, "AI_ERROR"), (2, "AI_ERROR")]


def test_a_request_is_done_once(spark, tmp_path):
    schema, folder, path = "request_id long, id long, status string, at_s long", f"{tmp_path}/in", f"{tmp_path}/out"
    totals = spark.createDataFrame([(1, 2), (2, 2), (3, 1), (4, None)], "request_id long, total long")

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        return rows_of(K.drain(K.first_done(spark.readStream.schema(schema).parquet(folder), totals), path))

    assert run([(1, 10, "done", 5), (1, 10, "done", 6), (2, 20, "done", 5), (2, 21, "pending", 6), (4, 1, "done", 1), (5, 1, "done", 1), (3, None, "done", 1)]) == []
    assert run([(1, 11, "error", 9), (1, 10, "done", 7), (2, 20, "error", 8)]) == [("1", 2, 9)]
    assert run([(1, 12, "done", 11), (1, 11, "done", 12), (3, 1, "done", 1)]) == [("1", 2, 9), ("3", 1, 1)]


def test_the_session_keeps_its_own_store(spark):
    before = spark.conf.get(K._PROVIDER)
    with K.keyed_state(spark):
        assert spark.conf.get(K._PROVIDER) != before
    assert spark.conf.get(K._PROVIDER) == before
