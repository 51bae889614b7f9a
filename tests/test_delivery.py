"""Notifications: a restart and a repeated batch tell nothing twice."""

import os

from pyspark.sql import functions as F

from corpusloom.streaming import delivery


def test_restart_and_repeated_batches(spark, tmp_path):
    source, out, check = (f"file://{tmp_path}/{n}" for n in ("in", "out", "check"))
    schema = "task_id long, run int, changed boolean, always boolean"

    def arrive(first, n):
        spark.range(first, first + n).select(F.col("id").alias("task_id"), F.lit(1).alias("run"), (F.col("id") % 2 == 0).alias("changed"), (F.col("id") % 3 == 0).alias("always")).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        delivery.deliver(stream, out, check, ~F.col("always")).awaitTermination()
        rows = delivery.delivered(spark, out, stream.schema).collect()
        assert len({r.task_id for r in rows}) == len(rows)
        return {r.task_id for r in rows}

    def want(n):
        return {i for i in range(n) if i % 2 == 0 or i % 3 == 0}

    arrive(0, 30)
    arrive(30, 30)
    assert run() == want(60)
    arrive(60, 30)
    assert run() == want(90)
    commits = f"{tmp_path}/check/commits"
    last = max(int(f) for f in os.listdir(commits) if f.isdigit())
    assert last >= 2
    for name in (str(last), f".{last}.crc"):  # as if the driver had died after the write and before the commit
        if os.path.exists(f"{commits}/{name}"):
            os.remove(f"{commits}/{name}")
    arrive(90, 10)
    assert run() == want(100)


def test_a_batch_written_again_is_itself(spark, tmp_path):
    rows = spark.createDataFrame([(1, True), (2, False)], "task_id long, changed boolean")
    for _ in range(3):
        delivery.write_batch(rows, 7, f"file://{tmp_path}/out")
    delivery.write_batch(rows.limit(0), 8, f"file://{tmp_path}/out")
    got = delivery.delivered(spark, f"file://{tmp_path}/out", rows.schema).collect()
    assert sorted((r.task_id, r.batch) for r in got) == [(1, 7), (2, 7)]
