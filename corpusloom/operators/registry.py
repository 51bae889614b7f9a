"""Task registry, deliveries, digests and briefings from event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.monitor import severity
from corpusloom.sources.tables import latest


def registered(events: DataFrame) -> DataFrame:
    """Current tasks of an upsert log (task_id, task_type, topic, status, related,
    at): the last status and type, the last topic given, all related ids in order
    of appearance, the first and the last time."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("at", "related"))), lambda x: x["related"])
    return events.groupBy("task_id").agg(
        F.max_by("task_type", "at").alias("task_type"), F.max_by("topic", F.when(F.col("topic").isNotNull(), F.col("at"))).alias("topic"),
        F.max_by("status", "at").alias("status"), F.array_distinct(F.flatten(F.filter(ordered, lambda x: x.isNotNull()))).alias("related"),
        F.min("at").alias("created_at"), F.max("at").alias("updated_at"))


def related(tasks: DataFrame) -> DataFrame:
    """(of, task...) the registered tasks that each task relates to; unknown ids have no row."""
    links = tasks.select(F.col("task_id").alias("of"), F.posexplode("related").alias("pos", "task_id"))
    return links.join(tasks.drop("related"), "task_id")


def merged(events: DataFrame, key: str, at: str, columns: list[str]) -> DataFrame:
    """Current rows of a log of partial updates: the last value given of each column."""
    return events.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(at))).alias(c) for c in columns], F.max(at).alias(at))


def hydrated(index: DataFrame, entities: DataFrame, key: str = "task_id") -> DataFrame:
    """The entities that an index (task_id, pos) lists, in its order; ids without one are left out."""
    return index.join(entities, key).orderBy("pos")


def frontiers(events: DataFrame) -> DataFrame:
    """Saved discovery frontiers (task_id, topic, queries, candidate_urls, seed_count,
    expanded_count, at): what was saved last, latest first."""
    cols = [c for c in events.columns if c not in ("task_id", "at")]
    last = events.groupBy("task_id").agg(F.max_by(F.struct(*cols), "at").alias("r"), F.min("at").alias("created_at"), F.max("at").alias("updated_at"))
    return last.select("task_id", "r.*", "created_at", "updated_at").orderBy(F.desc("updated_at"), "task_id")


def monitor_events(saved: DataFrame) -> DataFrame:
    """Registry events of saved monitor tasks (task_id, topic, status, research_ids, at):
    the task itself, and each research task that it relates to, with a link back."""
    own = saved.select("task_id", F.lit("monitor_topic").alias("task_type"), "topic", "status", F.col("research_ids").alias("related"), "at")
    back = saved.select(F.explode("research_ids").alias("r"), "topic", "task_id", "at").select(
        F.col("r").alias("task_id"), F.lit("research_topic").alias("task_type"), "topic", F.lit("completed").alias("status"), F.array("task_id").alias("related"), "at")
    return own.unionByName(back)


def kept_deliveries(deliveries: DataFrame, keep: int = 100) -> DataFrame:
    """The last ``keep`` deliveries, latest first."""
    return deliveries.orderBy(F.desc("delivered_at"), "task_id").limit(keep)


def topic_digests(deliveries: DataFrame, most: int = 5, highlights: int = 8) -> DataFrame:
    """(topic, deliveries, severities, latest_summary, highlights) over each topic's
    latest deliveries (topic, delivered_at, severity, summary, bullets)."""
    top = latest(deliveries, ["topic"], ["delivered_at"], most)
    recent = F.sort_array(F.collect_list(F.struct("delivered_at", "severity", "summary", "bullets")), asc=False)
    found = top.groupBy("topic").agg(recent.alias("r"))
    return found.select(
        "topic", F.size("r").alias("deliveries"), F.array_distinct(F.transform("r", lambda x: x["severity"])).alias("severities"),
        F.get("r", 0)["summary"].alias("latest_summary"),
        F.slice(F.flatten(F.transform("r", lambda x: F.coalesce(x["bullets"], F.array().cast("array<string>")))), 1, highlights).alias("highlights"))


def notifications(runs: DataFrame, only_on_change: Column) -> DataFrame:
    """Runs to tell about: changed ones, and all where changes are not asked for."""
    return runs.filter(F.col("changed") | ~only_on_change)


def digest(runs: DataFrame) -> DataFrame:
    """Runs (topic, run, new, persistent, dropped, changed - arrays of strings) with
    severity, title, summary, bullets and the trend's summary."""
    n = {c: F.size(c) for c in ("new", "persistent", "dropped", "changed")}
    level = severity(n["new"], n["changed"], n["dropped"])
    # The sentences of a digest.
    title = (F.when(level == "critical", F.format_string("Critical monitoring update for %s", "topic"))
             .when(level == "watch", F.format_string("Monitoring changes detected for %s", "topic"))
             .otherwise(F.format_string("Monitoring digest for %s", "topic")))
    summary = F.when(F.col("run") == 1, F.format_string(
        'Initial digest for "%s": %d active signals detected in the first monitoring pass.', "topic", n["new"])).otherwise(F.format_string(
            'Run %d digest for "%s": %d new, %d persistent, %d dropped signals.', "run", "topic", n["new"], n["persistent"], n["dropped"]))
    trend = F.when(F.col("run") == 1, F.format_string(
        'Initial monitoring baseline created for "%s" with %d active signals.', "topic", n["new"])).otherwise(F.format_string(
            'Monitoring trend for "%s": %d new signals, %d persistent signals, %d dropped signals.', "topic", n["new"], n["persistent"], n["dropped"]))
    bullets = F.array_compact(F.array(
        F.format_string("%d new signals", n["new"]), F.format_string("%d persistent signals", n["persistent"]), F.format_string("%d dropped signals", n["dropped"]),
        F.when(n["new"] > 0, F.concat(F.lit("Top new signal: "), F.get("new", 0))),
        F.when(n["persistent"] > 0, F.concat(F.lit("Top persistent signal: "), F.get("persistent", 0)))))
    return runs.withColumns({"severity": level, "title": title, "summary": summary, "trend": trend, "bullets": bullets})


def task_briefings(tasks: DataFrame, details: DataFrame) -> DataFrame:
    """(task_id, task_type, topic, status, summary, highlights, related_tasks); details
    (task_id, summary, insights, second) of research tasks have contradictions in
    second, those of monitoring tasks have bullets in insights and report insights there."""
    research = F.col("task_type") == "research_topic"
    none = F.array().cast("array<string>")
    first, more = F.coalesce("insights", none), F.coalesce("second", none)
    points = F.when(research, F.concat(F.slice(first, 1, 4), F.slice(more, 1, 2))).otherwise(F.concat(first, F.slice(more, 1, 3)))
    near = related(tasks).groupBy(F.col("of").alias("task_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "task_id"))), lambda x: x["task_id"]).alias("related_tasks"))
    told = F.when(research, F.coalesce("summary", F.format_string("Research task %s is %s.", "task_id", "status"))).otherwise(F.col("summary"))
    return (tasks.join(details, "task_id").join(near, "task_id", "left")
            .select("task_id", "task_type", "topic", "status", told.alias("summary"), F.slice(points, 1, 6).alias("highlights"),
                    F.coalesce("related_tasks", none).alias("related_tasks")))


def topic_briefings(tasks: DataFrame, deliveries: DataFrame) -> DataFrame:
    """(topic, latest_tasks, latest_titles, and the topic's digest)."""
    t = latest(tasks.filter("topic is not null"), ["topic"], ["updated_at"], 6).groupBy("topic").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("updated_at", "task_id")), asc=False), lambda x: x["task_id"]).alias("latest_tasks"))
    d = latest(deliveries, ["topic"], ["delivered_at"], 5).groupBy("topic").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("delivered_at", "title")), asc=False), lambda x: x["title"]).alias("latest_titles"))
    return t.join(d, "topic", "full").join(topic_digests(deliveries), "topic", "left")
