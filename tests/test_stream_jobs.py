"""Jobs as a stream against their histories replayed by hand."""

import random

from pyspark.sql import functions as F

from corpusloom.streaming import jobs

STALE, RETRIES = 300, 2


def replay(history, now):
    """Decisions of one job's events (second, kind) when the clock stands at now."""
    out, running, last, failed = [], False, 0, 0
    for at, kind in [*history, (now, "clock")]:
        if running and at > last + STALE:
            failed += 1
            out.append((last + STALE, "requeue" if failed <= RETRIES else "dead", failed))
            failed, running = (0 if failed > RETRIES else failed), False
        if kind == "start":
            running, last = True, at
        elif running and kind == "heartbeat":
            last = at
        elif running and kind == "complete":
            out.append((at, "completed", failed + 1))
            running, failed = False, 0
        elif running and kind == "fail":
            failed += 1
            out.append((at, "requeue" if failed <= RETRIES else "dead", failed))
            failed, running = (0 if failed > RETRIES else failed), False
    return out


def test_timers_retries_and_a_restart(spark, tmp_path):
    pick, histories = random.Random(3), {}
    for j in range(40):
        at, rows = 1_700_000_000 + pick.randrange(200), []
        while at < 1_700_003_000:
            rows.append((at, "start" if not rows or pick.random() < .3 else pick.choice(["heartbeat", "heartbeat", "complete", "fail"])))
            at += pick.choice([20, 100, 250, 310, 700])
        histories[f"j{j}"] = rows
    histories["quiet"] = [(1_700_000_050, "start")]  # nothing is heard of it again
    schema = "job_id string, at timestamp, kind string"
    source, out, check = (f"file://{tmp_path}/{n}" for n in ("in", "out", "check"))

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        (jobs.decisions(stream, "0 seconds", STALE, RETRIES).writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination())
        return sorted((r.job_id, r.s, r.action, r.attempt) for r in spark.read.parquet(out).select("*", F.unix_seconds("at").alias("s")).collect())

    def arrive(low, high, *more):
        rows = [(j, a, k) for j, h in histories.items() for a, k in h if low <= a - 1_700_000_000 < high] + list(more)
        pick.shuffle(rows)
        spark.createDataFrame(rows, "job_id string, s long, kind string").select("job_id", F.timestamp_seconds("s").alias("at"), "kind").coalesce(1).write.mode("append").parquet(source)

    arrive(0, 300, (None, 1_700_000_000, "start"), ("odd", None, "start"), ("odd", 1_700_000_010, "other"))
    arrive(300, 1000)
    first = run()
    assert ("quiet", 1_700_000_350, "requeue", 1) in first  # no event of its own after the start
    arrive(1000, 4000)
    arrive(9000, 9001, ("clock", 1_700_009_000, "heartbeat"))
    got = run()
    assert set(first) <= set(got)
    assert got == sorted((j, *d) for j, h in histories.items() for d in replay(sorted(h), 1_700_009_000))
    assert {"requeue", "dead", "completed"} == {r[2] for r in got}
