"""Fetch, queue and host operations folded from event logs."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappush, heapreplace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.operators.scans import Ordered, ranked


def outcome_counts(events: DataFrame, key: str) -> DataFrame:
    """Counts of each host; a failed fetch that fell back to a browser counts if the
    column browser_fallback is there."""
    fallback = F.count_if(F.col("browser_fallback")) if "browser_fallback" in events.columns else F.lit(0).cast("long")
    return events.groupBy(key).agg(
        fallback.alias("n_fallbacks"),
        F.count_if(F.col("success")).alias("n_success"), F.count_if(F.col("blocked")).alias("n_blocked"),
        F.count_if(F.col("retry_reason").isNotNull()).alias("n_retries"), F.avg("latency_ms").alias("avg_latency_ms"))


def host_policy(events: DataFrame, host: str = "host", order: str = "ord") -> DataFrame:
    """Success rate, shell rate and preferred strategy per host from (outcome, shell).

    The shell rate moves only on shell events, so it is a fold in event order:
    a shell event at attempt n sets r to (r (n - 1) + 1) / n, else r stays.
    The product form lets partial sums be running sums instead of one long array.
    """
    good = F.col("outcome").startswith("success") | F.col("outcome").isin("blocked_robots", "blocked_policy")
    events = events.select(host, order, "outcome", "shell")
    # log of the factor (n - 1) / n of later shell events scales an earlier one
    factor = F.when(F.col("shell") & (F.col("n") > 1), F.log((F.col("n") - 1) / F.col("n"))).otherwise(0.0)
    rows = Ordered(events, host, order).running(n=F.lit(1)).running(f=factor).done()
    rows = rows.withColumns({"left": F.col("n_total") - F.col("n") + 1, "after": F.col("f_total") - F.col("f")})
    out = rows.groupBy(host).agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if(good).alias("successes"),
        F.coalesce(F.sum(F.when(F.col("shell"), F.exp("after") / F.col("n"))), F.lit(0.0)).alias("shell_rate"),
        F.count_if((F.col("left") <= 20) & F.col("outcome").isin("success_browser", "success_retry")).alias("browser"),
        F.count_if((F.col("left") <= 20) & (F.col("outcome") == "success_static")).alias("static"))
    pick = (F.when(F.col("attempts") < 3, "unknown").when(F.col("shell_rate") > 0.3, "browser")
            .when((F.col("browser") > F.col("static") * 2) & (F.col("browser") >= 3), "browser")
            .when((F.col("static") > F.col("browser") * 2) & (F.col("static") >= 3), "static").otherwise("unknown"))
    return out.select(host, "attempts", (F.col("successes") / F.col("attempts")).alias("success_rate"), "shell_rate", pick.alias("strategy"))


def ewma(events: DataFrame, key: str, order: str, value: Column, keep: float = 0.9) -> DataFrame:
    """(key, state) of s = keep s + (1 - keep) v from the first value on, as one weighted
    sum: a scan numbers the values, so no key's values are gathered; nulls are skipped."""
    rows = events.select(key, F.col(order).alias("_o"), value.alias("_value")).filter("_value is not null")
    rows = Ordered(rows, key, "_o").running(_n=F.lit(1)).done()
    weight = F.pow(F.lit(keep), F.col("_n_total") - F.col("_n")) * F.when(F.col("_n") == 1, 1.0).otherwise(1.0 - keep)
    return rows.groupBy(key).agg(F.sum(F.col("_value") * weight).alias("state"))


def proxy_health(events: DataFrame, key: str = "proxy", order: str = "ord", least: float = 0.3) -> DataFrame:
    """(proxy, latency, successes, failures, health, healthy, recovered) of outcomes
    (success, latency_ms).

    The latency starts at 0 and moves only on a success; the health is the share of
    successes once there are more than ten outcomes, 1 before; recovered counts the
    outcomes that turned an unhealthy proxy healthy."""
    scan = Ordered(events.select(key, order, "success", "latency_ms"), key, order)
    scan.running(_n=F.lit(1), _ok=F.coalesce(F.col("success"), F.lit(False)).cast("long"))
    scan.rows = scan.rows.withColumn("_good", (F.col("_n") <= 10) | (F.col("_ok") / F.col("_n") >= least))
    rows = scan.previous("_row", "_good").done().withColumns({"_left": F.col("_ok_total") - F.col("_ok"), "_was": F.coalesce("_row._good", F.lit(True))})
    n = F.count(F.lit(1))
    ok = F.count_if(F.col("success"))
    return rows.groupBy(key).agg(
        F.coalesce(F.sum(F.when(F.col("success"), F.col("latency_ms") * 0.1 * F.pow(F.lit(0.9), "_left"))), F.lit(0.0)).alias("latency"),
        ok.alias("successes"), (n - ok).alias("failures"), F.when(n > 10, ok / n).otherwise(1.0).alias("health"),
        ((n <= 10) | (ok / n >= least)).alias("healthy"), F.count_if(F.col("_good") & ~F.col("_was")).alias("recovered"))


def gaps(events: DataFrame, key: str, at: str, order: str) -> DataFrame:
    """events with ``before``: the time of the event before of its key, null for the first."""
    return Ordered(events, key, [at, order]).previous("_row", at).done().withColumn("before", F.col(f"_row.{at}")).drop("_row")


def proxy_stats(proxies: DataFrame) -> DataFrame:
    """(total, healthy, unhealthy)."""
    return proxies.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("healthy")).alias("healthy"), F.count_if(~F.col("healthy")).alias("unhealthy"))


def pick_proxies(requests: DataFrame, proxies: DataFrame, strategy: str = "round-robin", order: str = "ord", seed: int = 0) -> DataFrame:
    """requests (ord: 0, 1, ...) with the proxy that a strategy picks among the healthy
    ones (proxy, ord, successes, healthy): in turn, by a hash of the request (random),
    or always the least used.  Each healthy proxy has its place in the pool's order, and
    requests are joined to it; no request has a proxy if none is healthy."""
    pool = proxies.filter("healthy").select("proxy", F.col("successes") if strategy == "least-used" else F.lit(0).alias("successes"), "ord")
    if strategy == "least-used":
        best = pool.orderBy("successes", "ord", "proxy").limit(1).select("proxy")
        return requests.join(best, F.lit(True), "left")
    n = pool.count()
    if not n:
        return requests.withColumn("proxy", F.lit(None).cast(pool.schema["proxy"].dataType))
    placed = ranked(pool, [F.col("ord"), F.col("proxy")], "_place").select("proxy", (F.col("_place") - 1).alias("_place"))
    at = {"round-robin": F.pmod(F.col(order), F.lit(n)), "random": F.pmod(F.xxhash64(order, F.lit(seed)), F.lit(n))}[strategy].cast("long")
    return requests.withColumn("_place", at).join(placed, "_place", "left").drop("_place")


def limited_starts(requests: DataFrame, key: str = "host", ts_ms: str = "ms", took_ms: str = "took", order: str = "ord", slots: int = 3, gap_ms: int = 1000) -> DataFrame:
    """(host, ord, start_ms) of requests in order of arrival: at most ``slots`` at a time
    and ``gap_ms`` between two starts of a host.  A start waits for the request, for the
    gap, and, if all slots are taken, for the first to be free.

    Each start depends on the one before it, so a host's requests are read once in order
    by one task, which keeps the last start and the ends of the taken slots alone."""
    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        never = float("inf")  # the end of a request of unknown length
        last, ends = None, []
        for batch in batches:
            out = []
            for first, at, took in zip(*(c.to_pylist() for c in batch.columns[2:])):
                if first:
                    last, ends = None, []
                full = len(ends) >= slots
                begin = at
                if last is not None and (begin is None or last + gap_ms > begin):
                    begin = last + gap_ms
                if full and ends[0] != never and (begin is None or ends[0] > begin):
                    begin = ends[0]
                end = never if begin is None or took is None else begin + took
                if full:
                    heapreplace(ends, end)
                else:
                    heappush(ends, end)
                last = begin
                out.append(begin)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.int64())], names=[key, "ord", "start_ms"])

    rows = requests.select(key, F.col(order).alias("_ord"), F.col(ts_ms).cast("long").alias("_at"), F.col(took_ms).cast("long").alias("_took"))
    w = W.partitionBy(key).orderBy("_at", "_ord", "_took")
    rows = rows.withColumn("_first", F.row_number().over(w) == 1).select(key, F.col("_ord").cast("long"), "_first", "_at", "_took")
    return rows.mapInArrow(starts, T.StructType([requests.schema[key], T.StructField("ord", T.LongType()), T.StructField("start_ms", T.LongType())]))


def ordered_fold(events: DataFrame, key: str, order: str, value: Column, start: Column, step) -> DataFrame:
    """Fold of a key's values in order, for states that no sum expresses (token buckets)."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v")))), lambda x: x["v"])
    return events.groupBy(key).agg(F.aggregate(rows, start, step).alias("state"))


# Retry reasons and what they mean; the first three are shells.
RETRY_LABELS = {
    "js_app_shell_detected": "JS app shell detected (React/Next/Nuxt/Remix markers)",
    "noscript_shell_detected": "Noscript shell detected",
    "dom_shell_detected": "Empty DOM with high script count",
    "low_confidence": "Low extraction confidence score",
    "low_text_high_script_ratio": "Low text content with high script ratio",
    "thin_static_content": "Thin static content detected",
    "http_error_retry": "HTTP error triggered retry",
    "timeout_retry": "Timeout triggered retry",
}
SHELL_REASONS = list(RETRY_LABELS)[:3]


def classified(reason: Column, auto_retried: Column) -> Column:
    """struct(retry_count, needed_retry, shell, label) of a fetch's retry reason."""
    needed = F.coalesce(auto_retried, F.lit(False)) | (F.coalesce(reason, F.lit("")) != "")
    label = F.try_element_at(F.create_map(*[F.lit(x) for kv in RETRY_LABELS.items() for x in kv]), F.coalesce(reason, F.lit("")))
    return F.struct(needed.cast("int").alias("retry_count"), needed.alias("needed_retry"),
                    F.coalesce(reason.isin(SHELL_REASONS), F.lit(False)).alias("shell"), label.alias("label"))


def assign_workers(jobs: DataFrame, workers: DataFrame, most: int = 100_000) -> DataFrame:
    """(job_id, worker_id, region) of jobs (job_id, namespace, preferred_region, ord[,
    completes]) over workers (worker_id, region, namespaces, active, capacity): in the
    job's order a worker of the preferred region, then the least active, with room.
    A row whose completes names an earlier job ends that one and is not assigned.

    Each choice depends on all before it, so it is one ordered fold on the driver
    over a cluster's tables; more than ``most`` jobs are refused, not cut."""
    todo = jobs.orderBy("ord").limit(most + 1).collect()
    if len(todo) > most:
        raise ValueError(f"more than {most} jobs in one assignment")
    pool = [r.asDict() for r in workers.orderBy("worker_id").collect()]
    out = []
    at: dict = {}
    for j in todo:
        done = j.completes if "completes" in jobs.columns else None
        if done is not None:
            if done in at:
                w = at.pop(done)
                w["active"] = max(0, w["active"] - 1)
            continue
        able = [w for w in pool if j.namespace in w["namespaces"] and w["active"] < w["capacity"]]
        w = min(able, key=lambda x: (j.preferred_region is not None and x["region"] != j.preferred_region, x["active"]), default=None)
        if w:
            w["active"] += 1
            at[j.job_id] = w
        out.append((j.job_id, w and w["worker_id"], w and w["region"]))
    return jobs.sparkSession.createDataFrame(out, "job_id string, worker_id string, region string")


def queue_state(events: DataFrame, max_retries: int = 2) -> DataFrame:
    """(job_id, state, retries) from (job_id, event, ord): fail requeues until the
    retries are used up, then the job is dead."""
    per = events.groupBy("job_id").agg(F.count_if(F.col("event") == "fail").alias("fails"), F.max_by("event", "ord").alias("last"))
    state = (F.when(F.col("fails") > max_retries, "dead_letter").when(F.col("last") == "complete", "completed")
             .when(F.col("last") == "dequeue", "running").otherwise("queued"))
    return per.select("job_id", state.alias("state"), F.least("fails", F.lit(max_retries + 1)).alias("retries"))


def token_bucket(events: DataFrame, key: str, ts_ms: str, rps: float = 2.0, burst: float = 5.0, kind: str | None = None, cooldown_ms: int = 30_000) -> DataFrame:
    """(key, admitted, rejected, cooling) of a bucket that refills at rps up to burst.

    kind: a column in which ``backoff`` empties the bucket and begins a cooldown, in
    which requests are refused (counted as cooling), not queued."""
    start = F.struct(F.lit(burst).alias("t"), F.lit(None).cast("long").alias("at"), F.lit(0).cast("long").alias("until"), F.lit(0).cast("long").alias("ok"),
                     F.lit(0).cast("long").alias("no"), F.lit(0).cast("long").alias("cool"))

    def step(acc: Column, v: Column) -> Column:
        back, cool = v["b"], ~v["b"] & (v["at"] < acc["until"])
        have = F.least(F.lit(burst), acc["t"] + F.coalesce(v["at"] - acc["at"], F.lit(0)) / 1000.0 * rps)
        ok = ~back & ~cool & (have >= 1.0)
        left = F.when(back, F.lit(0.0)).when(cool, acc["t"]).when(ok, have - 1.0).otherwise(have)
        one = F.lit(1).cast("long")
        return F.struct(left.alias("t"), F.when(cool, acc["at"]).otherwise(v["at"]).alias("at"), F.when(back, v["at"] + cooldown_ms).otherwise(acc["until"]).alias("until"),
                        F.when(ok, acc["ok"] + one).otherwise(acc["ok"]).alias("ok"), F.when(back | cool | ok, acc["no"]).otherwise(acc["no"] + one).alias("no"),
                        F.when(cool, acc["cool"] + one).otherwise(acc["cool"]).alias("cool"))

    what = F.struct(F.col(ts_ms).alias("at"), (F.coalesce(F.col(kind) == "backoff", F.lit(False)) if kind else F.lit(False)).alias("b"))
    folded = ordered_fold(events, key, ts_ms, what, start, step)
    return folded.select(key, F.col("state.ok").alias("admitted"), F.col("state.no").alias("rejected"), F.col("state.cool").alias("cooling"))


def live_workers(heartbeats: DataFrame, now: Column, interval_ms: int = 30_000) -> DataFrame:
    """(worker_id, last_seen, alive): a worker is gone two intervals after its last heartbeat (worker_id, at)."""
    seen = heartbeats.groupBy("worker_id").agg(F.max("at").alias("last_seen"))
    return seen.withColumn("alive", F.col("last_seen") + F.make_dt_interval(secs=F.lit(2 * interval_ms / 1000)) > now)


def reclaimed_jobs(processing: DataFrame, now: Column, gone: DataFrame | None = None, age_ms: int = 300_000) -> DataFrame:
    """job_ids of processing (job_id, worker_id, started_at) to queue again: too old, or
    of a worker that has shut down (worker_id)."""
    old = processing.filter(F.col("started_at") + F.make_dt_interval(secs=F.lit(age_ms / 1000)) < now).select("job_id")
    return old if gone is None else old.union(processing.join(gone.select("worker_id"), "worker_id", "left_semi").select("job_id")).distinct()


def cluster_metrics(workers: DataFrame) -> DataFrame:
    """(kind, name, workers, active_jobs): counts per namespace (of each that a worker
    serves) and region, and the total."""
    by_ns = workers.select(F.explode("namespaces").alias("name"), "active").groupBy("name").agg(F.count(F.lit(1)).alias("workers"), F.sum("active").alias("active_jobs"))
    by_rg = workers.groupBy(F.col("region").alias("name")).agg(F.count(F.lit(1)).alias("workers"), F.sum("active").alias("active_jobs"))
    total = workers.agg(F.count(F.lit(1)).alias("workers"), F.coalesce(F.sum("active"), F.lit(0)).alias("active_jobs")).withColumn("name", F.lit(None).cast("string"))
    parts = [x.select(F.lit(k).alias("kind"), "name", "workers", "active_jobs") for k, x in (("namespace", by_ns), ("region", by_rg), ("total", total))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def counters(events: DataFrame, name: str = "event_type", at: str = "ord") -> DataFrame:
    """(name, n) of the events since the last ``reset``: counters derived from the log."""
    reset = events.filter(F.col(name) == "reset").agg(F.max(at).alias("_reset"))
    since = events.crossJoin(F.broadcast(reset)).filter((F.col(name) != "reset") & (F.col("_reset").isNull() | (F.col(at) > F.col("_reset"))))
    return since.groupBy(name).agg(F.count(F.lit(1)).alias("n"))


def schedule_ms(text: Column) -> Column:
    """Milliseconds of ``every N unit``; an hour for anything else."""
    n = F.regexp_extract(text, "(?i)^every\\s+(\\d+)\\s*([smhd])", 1).try_cast("long")
    unit = F.lower(F.regexp_extract(text, "(?i)^every\\s+(\\d+)\\s*([smhd])", 2))
    per = F.when(unit == "s", 1000).when(unit == "m", 60_000).when(unit == "h", 3_600_000).when(unit == "d", 86_400_000)
    return F.coalesce(n * per, F.lit(3_600_000)).cast("long")
