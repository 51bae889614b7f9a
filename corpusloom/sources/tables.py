"""Tables, caches and logs: Parquet first, JSON and XML readers where the data has them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; a temporary one
    is set only where that is unset and there is one machine."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(at or "file://" + tempfile.mkdtemp(prefix="loom-"))
    return sc.getCheckpointDir().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


#: Spark's setting by which a query's shuffle files are removed when it ends.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet in the shared folder and read again: smaller than a
    checkpoint, and the shuffle files that made it go when it is there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
    before = spark.conf.get(FREE_SHUFFLES)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(FREE_SHUFFLES, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


def together(tables: list[DataFrame]) -> DataFrame:
    """The rows of stored tables of one schema."""
    return tables[0].sparkSession.read.schema(tables[0].schema).parquet(*[x._stored_path for x in tables])


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for x in tables:
        path = x.sparkSession._jvm.org.apache.hadoop.fs.Path(x._stored_path)
        path.getFileSystem(x.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON log; a line that is no JSON gives a row of nulls, which is left out."""
    rows = spark.read.schema(schema).json(path)
    return rows.filter(F.greatest(*[F.col(c).isNotNull() for c in rows.columns]))


# ---- key-value cache: an event log, so that writers never wait ---------------------

def kv_state(log: DataFrame) -> DataFrame:
    """Current entries (key, value, created_at, expires_at) of a log (op set, delete or
    clear; key, value, ttl_s, at): what was set last and not deleted or cleared since.
    A ttl of 0 or null never expires; equal times go to the set."""
    cleared = log.agg(F.max(F.when(F.col("op") == "clear", F.col("at"))).alias("_clear"))
    rank = F.struct("at", (F.col("op") == "set").alias("s"))
    last = log.filter("op <> 'clear'").groupBy(kv_key(F.col("key")).alias("key")).agg(F.max_by(F.struct("op", "value", "ttl_s", "at"), rank).alias("r"))
    live = last.crossJoin(F.broadcast(cleared)).filter("r.op = 'set' and (_clear is null or r.at > _clear)")
    until = F.when(F.coalesce("r.ttl_s", F.lit(0)) > 0, F.col("r.at") + F.make_dt_interval(secs=F.col("r.ttl_s")))
    return live.select("key", F.col("r.value").alias("value"), F.col("r.at").alias("created_at"), until.alias("expires_at"))


def kv_key(key: Column) -> Column:
    return F.regexp_replace(key, "[^A-Za-z0-9_]", "_")


def kv_stats(lookups: DataFrame, entries: DataFrame, now: Column) -> DataFrame:
    """(hits, misses) of looked-up keys against the entries that still hold."""
    found = lookups.select(kv_key(F.col("key")).alias("key")).join(unexpired(entries, now).select("key", F.lit(True).alias("_hit")), "key", "left")
    return found.agg(F.count_if(F.col("_hit")).alias("hits"), F.count_if(F.col("_hit").isNull()).alias("misses"))


def append_log(df: DataFrame, path: str) -> None:
    """Append rows as JSON lines."""
    df.write.mode("append").json(path)


def unexpired(cache: DataFrame, now: Column) -> DataFrame:
    """Entries of (key, value, created_at, expires_at) that still hold; null never expires."""
    return cache.filter(F.col("expires_at").isNull() | (F.col("expires_at") >= now))


def latest(df: DataFrame, keys: list[str], by: list[str], keep: int = 1) -> DataFrame:
    """The last ``keep`` rows of each key."""
    w = W.partitionBy(*keys).orderBy(*[F.desc(c) for c in by])
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= keep).drop("_n")


def revalidated(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Fetches with status 304 take body and missing headers from the page cache."""
    p = previous.select("url", F.col("html").alias("_html"), F.col("headers").alias("_headers"))
    unchanged = F.col("status") == 304
    none = F.create_map().cast("map<string,string>")
    merged = F.map_concat(
        F.map_filter(F.coalesce("_headers", none), lambda k, v: ~F.map_contains_key(F.coalesce("headers", none), k)), F.coalesce("headers", none))
    return current.join(p, "url", "left").select(
        "url", "status", F.when(unchanged, F.coalesce("_html", "html")).otherwise(F.col("html")).alias("html"),
        F.when(unchanged, merged).otherwise(F.col("headers")).alias("headers"))


def sitemap_entries(docs: DataFrame) -> DataFrame:
    """(sitemap, loc, lastmod, changefreq, priority, is_index) of (url, xml) rows."""
    def all_of(node: str, name: str) -> Column:
        one = F.regexp_extract(node, f"(?is)<(?:\\w+:)?{name}[^>]*>\\s*(.*?)\\s*</", 1)
        return F.nullif(one, F.lit(""))

    nodes = F.regexp_extract_all("xml", F.lit("(?is)<(?:\\w+:)?(?:url|sitemap)>(.*?)</(?:\\w+:)?(?:url|sitemap)>"), 1)
    out = docs.select(F.col("url").alias("sitemap"), F.lower("xml").contains("<sitemapindex").alias("is_index"), F.posexplode(nodes).alias("pos", "node"))
    return out.select("sitemap", "is_index", "pos", all_of("node", "loc").alias("loc"), all_of("node", "lastmod").alias("lastmod"),
                      all_of("node", "changefreq").alias("changefreq"), all_of("node", "priority").try_cast("double").alias("priority")).filter("loc is not null")


def discovered_sitemap(candidates: DataFrame, docs: DataFrame) -> DataFrame:
    """discovered of fetched documents (url, xml)."""
    return discovered(candidates, sitemap_entries(docs))


def discovered(candidates: DataFrame, entries: DataFrame) -> DataFrame:
    """(origin, loc, lastmod, changefreq, priority, found_at) of each origin's first
    candidate (origin, ordinal, url) that lists any URL; entries are those of the
    fetched maps (sitemap, loc, lastmod, changefreq, priority, is_index).  An index gives the
    entries of the sitemaps it names, one level deep; those that could not be
    fetched are left out."""
    own = entries.filter(~F.col("is_index")).select("sitemap", "loc", "lastmod", "changefreq", "priority")
    named = entries.filter("is_index").select(F.col("sitemap").alias("index"), F.col("loc").alias("sitemap"))
    below = own.join(named, "sitemap").select(F.col("index").alias("sitemap"), "loc", "lastmod", "changefreq", "priority")
    listed = candidates.withColumnRenamed("url", "sitemap").join(own.unionByName(below), "sitemap")
    first = listed.groupBy("origin").agg(F.min("ordinal").alias("ordinal"))
    return listed.join(first, ["origin", "ordinal"]).select("origin", "loc", "lastmod", "changefreq", "priority", F.col("sitemap").alias("found_at"))
