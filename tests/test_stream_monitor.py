"""The monitor as a stream against the same changes in one batch."""

from pyspark.sql import functions as F

from corpusloom.operators import monitor
from corpusloom.streaming import monitor as streamed

EVENTS = "/root/testdata/sf0.001/events.parquet"


def test_micro_batches_and_a_restart_equal_the_batch(spark, tmp_path):
    events = spark.read.parquet(EVENTS).select("user_id", "event_id", F.when(F.col("event_id") % 11 != 0, F.col("event_type")).alias("event_type"), (F.col("event_id") % 3).alias("size"))
    events = events.unionByName(spark.range(10**7, 10**7 + 9).select(F.lit(None).cast(events.schema["user_id"].dataType).alias("user_id"), F.col("id").cast(events.schema["event_id"].dataType).alias("event_id"), F.lit("x").alias("event_type"), (F.col("id") % 2).alias("size"))).cache()
    parts = [r[0] for r in events.select(F.percentile("event_id", F.array(F.lit(0.0), F.lit(0.3), F.lit(0.6), F.lit(1.0))).alias("p")).select(F.explode("p")).collect()]
    source, out, check = (f"file://{tmp_path}/{n}" for n in ("in", "out", "check"))

    def run():
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
        (streamed.changes(stream, "user_id", "event_id", ["event_type", "size"]).writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination())

    for i, (a, b) in enumerate(zip(parts, parts[1:])):
        rows = events.filter((F.col("event_id") > a if i else F.lit(True)) & (F.col("event_id") <= b))
        rows.orderBy(F.desc("event_id")).coalesce(1).write.mode("append").parquet(source)
        if i != 0:  # two batches in the first run, a restart with the state for the third
            run()
    got = sorted(map(repr, (tuple(r) for r in spark.read.parquet(out).select("user_id", "event_id", "changed").collect())))
    want = monitor.changes(events, "user_id", "event_id", ["event_type", "size"]).select("user_id", "event_id", "changed").collect()
    assert got == sorted(map(repr, (tuple(r) for r in want))) and len(got) == events.count()
