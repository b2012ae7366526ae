"""Places within keys that are dealt over many tasks."""

import random

from murmura.operators import reports as R
from pyspark.sql import functions as F


def test_hot_key_is_numbered_in_many_parts(spark):
    r = random.Random(2)
    rows = [(r.choice(["hot"] * 8 + ["b", None]), i) for i in range(4_000)]
    r.shuffle(rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as few rows would go to one part
    found = R.numbered(spark.createDataFrame(rows, "k string, i long").repartition(3), ["k"], [F.col("i").desc()], "place")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {}
    for k, i in sorted(rows, key=lambda x: -x[1]):
        want.setdefault(k, []).append(i)
    assert sorted(((x.k or "", x.place, x.i) for x in found.collect())) == sorted((k or "", n, i) for k, v in want.items() for n, i in enumerate(v, 1))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.split("\n") if "Window" in line and "row_number" in line]
    assert windows and all("__part" in line for line in windows)
    # the parts of the hot key that were written
    parts = spark.read.parquet(next(p.rsplit("/", 1)[0] for p in found.inputFiles()))
    assert parts.where("k = 'hot'").select("__part").distinct().count() > 1


def test_long_histories_come_in_chunks(spark):
    rows = spark.range(250).selectExpr("'c' creator", "timestamp'2024-01-01' dt", "lpad(id, 3, '0') text", "1 source_no")
    found = R.chunked_lines(R.timeline(rows), ["creator"], "position", F.col("text"), 100, "history").orderBy("chunk").collect()
    assert [len(x.history.split("\n")) for x in found] == [100, 100, 50]
    assert "\n".join(x.history for x in found).split("\n") == [f"{i:03}" for i in range(250)]
