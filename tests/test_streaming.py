from murmura.sources.sinks import Table
from murmura.streaming import jobs


def run(df, mode, name, spark):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.sql(f"select * from {name}").collect()


def source(spark, tmp_path, batches):
    schema = "id long, ts timestamp, kind string"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "id long, ts string, kind string").selectExpr("id", "cast(ts as timestamp) ts", "kind").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")


BATCHES = [
    [(1, "2024-01-07 16:00:00", "a"), (2, "2024-01-07 17:00:00", "a"), (1, "2024-01-07 16:00:00", "a")],
    [(3, "2024-01-20 00:00:00", "b"), (2, "2024-01-07 17:00:00", "c")],
    [(5, "2024-02-20 00:00:00", "a")],
    [(6, "2024-02-21 00:00:00", "b")],
    [(4, "2024-01-01 00:00:00", "a")],  # late by then
]


def test_weekly_counts(spark, tmp_path):
    rows = run(jobs.weekly_counts(source(spark, tmp_path, BATCHES), "kind"), "append", "weeks", spark)
    found = {(str(r.week), r.kind): r.n for r in rows}
    assert found[("2023-12-31 16:30:00", "a")] == 2 and found[("2024-01-07 16:30:00", "a")] == 1 and found[("2024-01-14 16:30:00", "b")] == 1


def test_first_seen(spark, tmp_path):
    rows = run(jobs.first_seen(source(spark, tmp_path, BATCHES), ["id"], late="30 days"), "append", "firsts", spark)
    assert sorted(r.id for r in rows) == [1, 2, 3, 5, 6]


def test_state(spark, tmp_path):
    stream = source(spark, tmp_path, BATCHES)
    q = stream.writeStream.foreachBatch(jobs.state_writer(f"{tmp_path}/state", ["id"], "ts")).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    state = Table(spark, f"{tmp_path}/state", "id long, ts timestamp, kind string")
    assert sorted(r.id for r in state.read().collect()) == [1, 2, 3, 4, 5, 6] and len(state.versions()) == 3
    assert {r.kind for r in state.read().where("id = 2").collect()} <= {"a", "c"}


def test_index_follows_changes(spark, tmp_path):
    batches = [[("f", "added", 1), ("g", "added", 1)], [("f", "modified", 2), ("g", "deleted", 0)], [("h", "added", 3)]]
    schema = "source_file string, operation string, n int"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    write = jobs.index_writer(f"{tmp_path}/index")
    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    index = Table(spark, f"{tmp_path}/index", "source_file string, n int")
    assert sorted(map(tuple, index.read().collect())) == [("f", 2), ("h", 3)]
    write(spark.createDataFrame(batches[2], schema), 2)  # run again
    assert sorted(map(tuple, index.read().collect())) == [("f", 2), ("h", 3)]
