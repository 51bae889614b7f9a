"""The chain by which a page is got: cache, host policy, route, browser retry, record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import html as H
from corpusloom.functions.documents import extract_documents
from corpusloom.operators.ops import classified


def fetched(requests: DataFrame, static: DataFrame, rendered: DataFrame, cache: DataFrame, policies: DataFrame) -> DataFrame:
    """What each request (url, ord) gets: (url, ord, html, status, cache_hit, initial_strategy,
    final_strategy, fallback_used, route_reason, auto_retried, retry_reason, outcome,
    retry_count, shell).

    static (url, html, status) and rendered (url, html, status, error) hold what a plain
    fetch and a browser give, one row per URL; a URL without a rendered row has no
    browser, one without a static row fails.  cache (url, html, status, via) holds one
    row per URL, policies (host, strategy) one per host.

    A cached page is taken as it is.  Otherwise the host's policy picks the route; a
    browser that is not available falls back to a plain fetch where the route allows
    it, and a page got plainly that looks unfinished is tried with a browser, or kept
    (``failed_browser``) if there is none.  Any other error of the browser makes the
    request ``failed``, with neither page nor record.  Every URL is fetched once, by
    its first request in order of ord; later ones find it in the cache, or fail as
    well.  A null URL or one that has no host is fetched without a policy.

    Each table is joined by URL or host once and pages are judged once per URL."""
    first = requests.groupBy("url").agg(F.min("ord").alias("_first"))
    old = cache.select("url", F.struct("html", "status", "via").alias("_old"))
    todo = first.join(old, "url", "left").withColumn("_host", F.lower(F.try_parse_url("url", F.lit("HOST"))))
    todo = todo.join(policies.select(F.lower("host").alias("_host"), F.col("strategy").alias("_policy")), "_host", "left")
    plain = static.select("url", F.struct("html", "status").alias("_static"))
    seen = static.join(todo.filter("_old is null").select("url"), "url", "left_semi")
    why = F.when(F.col("html").isNotNull(), H.retry_reason(F.col("html"), F.col("text"), F.col("markdown"), F.col("n_words"), F.col("confidence")))
    judged = extract_documents(seen).join(seen.select("url", "html"), "url").select("url", why.alias("_why"))
    browser = rendered.select("url", F.struct("html", "status").alias("_rendered"), F.col("error").alias("_error"), F.lit(True).alias("_tried"))
    rows = todo.join(plain, "url", "left").join(judged, "url", "left").join(browser, "url", "left")

    # the page as yet unread: a route is chosen without its text
    route = H.route(F.lit(None).cast("string"), F.coalesce("_policy", F.lit("unknown")), F.lit(None).cast("double"), mode="crawl")
    rows = rows.withColumn("_route", route).withColumn("_error", F.when(F.col("_tried").isNull(), "BROWSER_UNAVAILABLE").otherwise(F.col("_error")))
    routed = F.when(F.col("_route.strategy") == "browser", H.with_fallback(F.col("_error"), F.col("_route.allow_fallback"))).otherwise("static")
    rows = rows.withColumn("_end", F.when(F.col("_old").isNotNull(), "cached").when((routed != "browser") & F.col("_static").isNull(), "failed").otherwise(routed))
    plainly = F.col("_end").isin("static", "static_fallback")
    again = plainly & F.col("_why").isNotNull()
    outcome = (F.when(F.col("_end") == "cached", "success_static").when(F.col("_end") == "failed", "failed").when(F.col("_end") == "browser", "success_browser")
               .when(~again, "success_static").when(F.col("_error").isNull(), "success_retry").when(F.col("_error") == "BROWSER_UNAVAILABLE", "failed_browser").otherwise("failed"))
    rows = rows.withColumn("outcome", outcome)
    retried = F.col("outcome") == "success_retry"
    via = F.when(F.col("_end") == "cached", F.coalesce("_old.via", F.lit("static"))).when(F.col("outcome").isin("success_browser", "success_retry"), "browser").when(F.col("outcome") != "failed", "static")
    page = F.when(F.col("_end") == "cached", F.struct("_old.html", "_old.status")).when(via == "browser", F.col("_rendered")).when(via == "static", F.col("_static"))
    rows = rows.select("url", "_first", "_route", "_end", "outcome", via.alias("_via"), page.alias("_page"), retried.alias("_retried"), F.when(again & (F.col("outcome") != "failed"), F.col("_why")).alias("_why"))

    out = requests.join(rows.withColumnRenamed("url", "_url"), F.col("url").eqNullSafe(F.col("_url")))
    failed = F.col("outcome") == "failed"
    hit = (F.col("_end") == "cached") | (~failed & (F.col("ord") > F.col("_first")))

    def fresh(value: Column, cached: Column) -> Column:
        return F.when(hit, cached).otherwise(value)

    none = F.lit(None).cast("string")
    kind = classified(fresh(F.col("_why"), none), fresh(F.col("_retried"), F.lit(False)))
    return out.select("url", "ord", F.col("_page.html").alias("html"), F.col("_page.status").alias("status"), hit.alias("cache_hit"),
                      fresh(F.col("_route.strategy"), F.col("_via")).alias("initial_strategy"), F.col("_via").alias("final_strategy"),
                      fresh(F.col("_end") == "static_fallback", F.lit(False)).alias("fallback_used"), fresh(F.col("_route.reason"), F.lit("cached")).alias("route_reason"),
                      fresh(F.col("_retried"), F.lit(False)).alias("auto_retried"), fresh(F.col("_why"), none).alias("retry_reason"),
                      fresh(F.col("outcome"), F.lit("success_static")).alias("outcome"), kind["retry_count"].alias("retry_count"), kind["shell"].alias("shell"))


def outcomes(results: DataFrame) -> DataFrame:
    """(host, ord, outcome, shell) to record for the host policies of ``ops.host_policy``:
    a row per page that was fetched; cached and failed ones are not recorded."""
    return results.filter("not cache_hit and outcome <> 'failed'").select(F.lower(F.try_parse_url("url", F.lit("HOST"))).alias("host"), "ord", "outcome", "shell").filter("host is not null")


def cached(results: DataFrame, cache: DataFrame) -> DataFrame:
    """The cache after the requests: (url, html, status, via) with a row for each page fetched."""
    new = results.filter("not cache_hit and outcome <> 'failed'").select("url", "html", "status", F.col("final_strategy").alias("via"))
    return cache.select("url", "html", "status", "via").join(new.select("url"), "url", "left_anti").unionByName(new)
