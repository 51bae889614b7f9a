"""Snapshots, changes, signals and digests over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.operators.scans import Ordered


def changes(snapshots: DataFrame, target: str, order: str, fields: list[str]) -> DataFrame:
    """Each snapshot with the names of the fields that differ from the one before."""
    out = Ordered(snapshots, target, order).previous("_prev", *fields).done()
    diff = F.array_compact(F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"_prev.{f}")), F.lit(f)) for f in fields]))
    return out.withColumn("changed", F.when(F.col("_prev").isNull(), F.array(F.lit("initial_snapshot"))).otherwise(diff)).drop("_prev")


def signals(current: Column, previous: Column) -> dict[str, Column]:
    return {"new": F.array_except(current, previous), "persistent": F.array_intersect(current, previous), "dropped": F.array_except(previous, current)}


def severity(n_new: Column, n_changed: Column, n_dropped: Column) -> Column:
    return F.when((n_new >= 3) | (n_changed >= 3), "critical").when((n_new > 0) | (n_dropped > 0), "watch").otherwise("info")


def history(df: DataFrame, key: str, order: str, value: str, keep: int = 10) -> DataFrame:
    """Each row with the last ``keep`` values of its key, oldest first."""
    return Ordered(df, key, order).tail("history", value, keep).done()


def live_targets(jobs: DataFrame, removed: DataFrame, key: str = "target") -> DataFrame:
    """Monitor jobs without the removed targets."""
    return jobs.join(removed.select(key).distinct(), key, "left_anti")


def topic_targets(tasks: DataFrame, found: DataFrame, templates: int = 3, per_template: int = 2, most: int = 5) -> DataFrame:
    """(task_id, targets) to monitor of tasks (task_id, topic, watch_domains, templates):
    the watched domains; else the first URLs that a search found for the first
    templates, found (task_id, template_pos, rank, url), each once; else a placeholder
    per template."""
    none = F.array().cast("array<string>")
    near = found.filter((F.col("template_pos") < templates) & (F.col("rank") <= per_template) & (F.coalesce("url", F.lit("")) != ""))
    urls = near.groupBy("task_id").agg(F.slice(F.array_distinct(F.transform(
        F.array_sort(F.collect_list(F.struct("template_pos", "rank", "url"))), lambda x: x["url"])), 1, most).alias("_found"))
    watched = F.transform(F.coalesce("watch_domains", none), lambda d: F.when(F.startswith(d, F.lit("http")), d).otherwise(F.concat(F.lit("https://"), d)))
    # Fixed value: the address that stands for a search without results.
    instead = F.transform(F.slice(F.coalesce("templates", none), 1, templates), lambda t: F.concat(
        F.lit("https://search.invalid/?q="), F.replace(F.url_encode(F.concat_ws(" ", t, "topic")), F.lit("+"), F.lit("%20"))))
    got = F.coalesce("_found", none)
    targets = F.when(F.size(watched) > 0, watched).when(F.size(got) > 0, got).otherwise(instead)
    return tasks.join(urls, "task_id", "left").select("task_id", targets.alias("targets"))


def topic_runs(checks: DataFrame, tasks: DataFrame) -> DataFrame:
    """Every run of topic monitors: checks (task_id, run, pos, target, checked, changed,
    alerts) of its targets and tasks (task_id, topic) give (task_id, topic, run, status,
    changed, alerts, signals, new, persistent, dropped, refresh, finding).

    A run's signals are its changed targets and their alerts, each once; they are
    compared with those of the run before.  refresh: the first run and those with a
    change ask for the topic's research anew."""
    none = F.array().cast("array<string>")
    item = F.struct("pos", "target", "changed", F.coalesce("alerts", none).alias("alerts"))
    per = checks.groupBy("task_id", "run").agg(F.array_sort(F.collect_list(item)).alias("r"), F.bool_or("checked").alias("_checked"))
    hit = F.filter("r", lambda x: x["changed"])
    per = per.select("task_id", "run", F.when(F.col("_checked"), "checked").otherwise("created").alias("status"),
                     F.transform(hit, lambda x: x["target"]).alias("changed"), F.flatten(F.transform(hit, lambda x: x["alerts"])).alias("alerts"))
    per = per.withColumn("signals", F.array_distinct(F.filter(F.concat("changed", "alerts"), lambda x: F.coalesce(x, F.lit("")) != "")))
    before = F.coalesce(F.lag("signals").over(W.partitionBy("task_id").orderBy("run")), none)
    per = per.withColumn("_before", before)
    n = F.size("changed")
    # The finding of a run.
    finding = F.when(n > 0, F.format_string('%d monitored pages changed for topic "%s".', n, "topic")).otherwise(
        F.format_string('No changed pages detected yet for topic "%s".', "topic"))
    return (per.join(tasks.select("task_id", "topic"), "task_id").withColumns({**signals(F.col("signals"), F.col("_before")),
            "refresh": (F.col("run") == 1) | (n > 0), "finding": finding}).drop("_before"))


def due(tasks: DataFrame, now: Column, most: int | None = 20) -> DataFrame:
    """Tasks whose next_run_at has come, the longest overdue first."""
    out = tasks.filter(F.col("next_run_at") <= now).orderBy("next_run_at", "task_id")
    return out if most is None else out.limit(most)


def lease(holder: Column, expires_at: Column, wanted_by: Column, now: Column, ttl_ms: int = 300_000) -> Column:
    """struct(granted, holder, expires_at): a cycle's lease goes to who asks once the
    one before has run out or been given back (holder null)."""
    free = holder.isNull() | (expires_at <= now)
    return F.struct(free.alias("granted"), F.when(free, wanted_by).otherwise(holder).alias("holder"),
                    F.when(free, now + F.make_dt_interval(secs=F.lit(ttl_ms / 1000))).otherwise(expires_at).alias("expires_at"))


def due_cycle(tasks: DataFrame, outcomes: DataFrame, now: Column, most: int = 20) -> DataFrame:
    """One row (due, succeeded, failed) of a cycle: the due tasks and how their runs,
    outcomes (task_id, ok), ended; a task without an outcome failed."""
    got = due(tasks, now, most).select("task_id").join(outcomes, "task_id", "left")
    ids = (lambda ok: F.array_sort(F.collect_list(F.when(F.coalesce("ok", F.lit(False)) == ok, F.col("task_id")))))
    return got.agg(F.count(F.lit(1)).alias("due"), ids(True).alias("succeeded"), ids(False).alias("failed"))
