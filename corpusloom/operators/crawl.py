"""Robots rules, scope, site maps and crawls over tables of fetched pages."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import documents as D
from corpusloom.functions import html as H
from corpusloom.functions import text as T
from corpusloom.functions import urls as U
from corpusloom.operators.scans import Ordered
from corpusloom.sources.tables import cut


def robots_rules(robots: DataFrame, agent: str = "*") -> DataFrame:
    """(origin, pattern, allow) of (origin, body): the rules for agents whose name holds
    the agent's, without regard to case, else those for ``*``."""
    lines = robots.select("origin", F.posexplode(F.split("body", "\r?\n")).alias("pos", "line"))
    lines = lines.select("origin", "pos", F.trim(F.regexp_replace("line", "#.*$", "")).alias("line")).filter("line like '%:%'")
    lines = lines.select("origin", "pos", F.lower(F.trim(F.substring_index("line", ":", 1))).alias("field"),
                         F.trim(F.expr("substr(line, instr(line, ':') + 1)")).alias("value"))
    w = W.partitionBy("origin").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    lines = lines.withColumn("agent", F.last(F.when(F.col("field") == "user-agent", F.lower("value")), ignorenulls=True).over(w))
    rules = lines.filter("field in ('allow', 'disallow') and value <> '' and agent is not null")
    rules = rules.select("origin", "agent", F.when(F.startswith("value", F.lit("/")), F.col("value")).otherwise(F.concat(F.lit("/"), F.col("value"))).alias("pattern"),
                         (F.col("field") == "allow").alias("allow"))
    own = rules.filter(F.col("agent") == "*" if agent == "*" else F.contains("agent", F.lit(agent.lower())))
    return own.unionByName(rules.filter("agent = '*'").join(own.select("origin").distinct(), "origin", "left_anti").select(rules.columns)).drop("agent").distinct()


@dataclass
class Robots:
    """What robots files say: origins (origin, state, sizes) - state is ``rules``, ``none``
    (404) or ``unavailable``, sizes are the lengths of its patterns - and rules (origin,
    pattern, allow), each pattern once."""

    origins: DataFrame
    rules: DataFrame

    def kept(self) -> Robots:
        """The same, read from checkpoints: for many uses."""
        return Robots(cut(self.origins), cut(self.rules))


def robots_tables(robots: DataFrame, agent: str = "*") -> Robots:
    """The tables of fetched (origin, status, body), one row per origin."""
    state = F.when(F.col("status").between(200, 299), "rules").when(F.col("status") == 404, "none").otherwise("unavailable")
    known = robots.select("origin", "body", state.alias("state"))
    rules = single_rules(robots_rules(known.filter("state = 'rules'").select("origin", "body"), agent))
    return Robots(known.drop("body").join(pattern_sizes(rules), "origin", "left"), rules)


def single_rules(rules: DataFrame) -> DataFrame:
    """Each pattern of an origin once; if it is both allowed and not, it is allowed."""
    return rules.groupBy("origin", "pattern").agg(F.bool_or("allow").alias("allow"))


def pattern_sizes(rules: DataFrame) -> DataFrame:
    return rules.groupBy("origin").agg(F.collect_set(F.length("pattern")).alias("sizes"))


def longest_rule(urls: DataFrame, sizes: DataFrame, rules: DataFrame) -> DataFrame:
    """(origin, path, fits) of the distinct paths that some rule is a prefix of; fits is
    whether the longest one allows.

    A path is cut at the lengths that its origin's patterns have, and the prefixes meet
    the rules by equality of (origin, prefix): a hash join, however many origins and
    rules there are, and a hot origin's rows differ in their prefixes."""
    paths = urls.select("origin", "path").distinct().join(sizes.select("origin", "sizes"), "origin")
    cuts = paths.select("origin", "path", F.explode("sizes").alias("n")).filter(F.col("n") <= F.length("path")).withColumn("pattern", F.substr("path", F.lit(1), F.col("n")))
    return cuts.join(rules, ["origin", "pattern"]).groupBy("origin", "path").agg(F.max_by("allow", "n").alias("fits"))


def robots_decisions(urls: DataFrame, robots: DataFrame | Robots, mode: str = "balanced", agent: str = "*") -> DataFrame:
    """urls (origin, path, ...) with allowed and reason (off, allowed, disallowed,
    unavailable).  An origin without a robots row counts as unavailable; strict
    denies those, balanced allows them.  The longest matching prefix wins, a tie allows,
    none allows."""
    if mode not in ("off", "balanced", "strict"):
        raise ValueError(f"unknown robots mode {mode}")
    if mode == "off":
        return urls.withColumns({"allowed": F.lit(True), "reason": F.lit("off")})
    known = robots if isinstance(robots, Robots) else robots_tables(robots, agent)
    fits = longest_rule(urls, known.origins.filter("sizes is not null"), known.rules).withColumnRenamed("fits", "_fits")
    out = urls.join(known.origins.select("origin", F.col("state").alias("_state")), "origin", "left").join(fits, ["origin", "path"], "left")
    state = F.coalesce("_state", F.lit("unavailable"))
    allowed = F.when(state == "unavailable", F.lit(mode == "balanced")).otherwise((state == "none") | F.coalesce("_fits", F.lit(True)))
    reason = F.when(state == "unavailable", "unavailable").otherwise(F.when(allowed, "allowed").otherwise("disallowed"))
    return out.withColumns({"allowed": allowed, "reason": reason}).drop("_state", "_fits").select(*urls.columns, "allowed", "reason")


def robots_allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls with allowed, by the rules (origin, pattern, allow) of their origin."""
    rules = single_rules(rules)
    fits = longest_rule(urls, pattern_sizes(rules), rules)
    return urls.join(fits, ["origin", "path"], "left").select(*urls.columns, F.coalesce("fits", F.lit(True)).alias("allowed"))


def robots_counters(decisions: DataFrame) -> DataFrame:
    """(blocked, unavailable) over decisions."""
    return decisions.agg(F.count_if(~F.col("allowed")).alias("blocked"), F.count_if(F.col("reason") == "unavailable").alias("unavailable"))


# ---- sitemap filter and policies -----------------------------------------------

def domain_policy(urls: DataFrame, url: str = "url", allow: list[str] = (), deny: list[str] = ()) -> DataFrame:
    """urls with permitted: not below a denied domain, and below an allowed one if there are any."""
    return urls.withColumn("permitted", U.domain_allowed(F.lower(F.try_parse_url(F.col(url), F.lit("HOST"))), allow, deny))


def in_sitemap(entries: DataFrame, seed_host: Column, include: list[str] = (), deny: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """The entries whose URL is in the scope of a host (without ``www.``) and holds no excluded text."""
    full = U.resolve(F.col("loc"), F.concat(F.lit("https://"), seed_host, F.lit("/")))
    ok = U.in_scope(full, seed_host, list(deny), list(include))
    return entries.filter(ok & ~T.contains_any(full, list(exclude)) if exclude else ok)


def filter_sitemap(entries: DataFrame, seed_host: str, include: list[str] = (), deny: list[str] = (), exclude: list[str] = (), order: str = "pos") -> DataFrame:
    """(loc, first) of the entries in scope whose URL holds no excluded text, each once, first order of each."""
    kept = in_sitemap(entries, F.lit(seed_host.lower().removeprefix("www.")), include, deny, exclude)
    return kept.groupBy("loc").agg(F.min(order).alias("first"))


# ---- maps and crawls -------------------------------------------------------------

@dataclass
class Walk:
    """The result of maps or crawls.

    urls: (url, depth, discovered_from, discovered_by, ord) in the order of ord;
    summary: one row (visited, discovered, excluded, errors, robots_blocked,
    robots_unavailable, stopped_reason).  Those of many seeds have the seed before."""

    urls: DataFrame
    summary: DataFrame


class RobotsDenied(ValueError):
    """The seed is closed by robots rules."""


def link_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst, pos) of the links of pages, in page order; those without target are left out."""
    links = pages.select(F.col(url).alias("src"), F.posexplode(H.links(F.col(html), F.col(url))).alias("pos", "dst"))
    return links.filter("dst is not null").select("src", "dst", "pos")


def gated(seeds: DataFrame, known: Robots, mode: str) -> DataFrame:
    """(seed, limit, host, allowed, reason) of seeds (seed, limit): each seed once, with the
    largest of its limits (null, and so any null, is none)."""
    most = F.when(F.bool_and(F.col("limit").isNotNull()), F.max("limit")).cast("long")
    at = F.col("seed")
    rows = seeds.groupBy("seed").agg(most.alias("limit")).withColumns({"host": U.host(at), "origin": U.origin(at), "path": U.path(at)})
    return cut(robots_decisions(rows, known, mode).drop("origin", "path"))


def walks(pages: DataFrame, robots: DataFrame, seeds: DataFrame, mode: str = "balanced", **options) -> Walk:
    """Maps (or with ``extracting`` crawls) from many seeds (seed, limit), as walk does for
    one, all in one loop: a level of all seeds is one join, so a thousand seeds take no
    more rounds than one.

    Every seed has its own visited URLs, scope, limit and counters, and its row of the
    summary: ``robots_denied`` is why a seed that robots rules close stopped,
    ``invalid_seed`` why one without a host did (null among them).  A seed given
    twice is one walk.  sitemap: entries (seed, loc, pos)."""
    known = robots_tables(robots).kept()
    return _walks(pages, known, gated(seeds, known, mode), mode, **options)


def _walks(pages: DataFrame, known: Robots, starts: DataFrame, mode: str, max_depth: int = 3, include: list[str] = (), deny: list[str] = (),
           exclude_paths: list[str] = (), sitemap: DataFrame | None = None, extracting: bool = False, edges: DataFrame | None = None) -> Walk:
    """The loop of walks.  Rows of a level carry their seed's host and what is left of its
    limit, so no level is joined with the seeds."""
    fetched = pages.filter(F.coalesce("status", F.lit(0)).between(200, 399)).select(F.col("url")).distinct()
    closed = T.contains_any(U.path(F.col("url")), list(exclude_paths)) if exclude_paths and extracting else F.lit(False)
    columns = ["seed", "host", "left", "url", "depth", "discovered_from", "discovered_by", "ord"]
    counts = (F.col("state") == "ok" if extracting else F.lit(True)).cast("long")

    def judged(df: DataFrame) -> DataFrame:
        at = F.col("url")
        return robots_decisions(df.withColumns({"origin": U.origin(at), "path": U.path(at)}), known, mode).drop("origin", "path")

    def with_state(df: DataFrame) -> DataFrame:
        """What became of each URL of a level: skipped, ok or error."""
        found = df.join(fetched.withColumn("_here", F.lit(True)), "url", "left")
        return found.select(*columns, F.when(closed, "skipped").when(F.col("_here"), "ok").otherwise("error").alias("state"))

    def upto(df: DataFrame) -> DataFrame:
        """The rows of each seed up to the one that fills its limit, and what is left then."""
        if not limited:
            return df
        rows = Ordered(df, "seed", "ord").running(_n=counts).done().filter(F.col("left").isNull() | (F.col("_n") - counts < F.col("left")))
        return rows.withColumn("left", F.greatest(F.col("left") - F.col("_n_total"), F.col("left") * 0)).drop("_n", "_n_total")

    def counted(links: DataFrame) -> None:
        """Count what a level's links are not followed for; a crawl does not count those out of scope."""
        shut = F.col("scope") & ~F.col("allowed")
        excluded = shut if extracting else shut | ~F.col("scope")
        counters.append(links.groupBy("seed").agg(F.count_if(excluded).alias("excluded"), F.count_if(shut).alias("blocked"),
                                                  F.count_if(F.col("scope") & (F.col("reason") == "unavailable")).alias("unavailable")))

    valid = F.col("host").isNotNull()
    counters = [starts.filter(valid).select("seed", F.lit(0).cast("long").alias("excluded"), (~F.col("allowed")).cast("long").alias("blocked"), (F.col("reason") == "unavailable").cast("long").alias("unavailable"))]
    opened = starts.filter(valid & F.col("allowed")).select("seed", "host", F.col("limit").alias("left"))
    limited = opened.filter("left is not null").limit(1).count() > 0
    nowhere = F.lit(None).cast("string").alias("discovered_from")
    rows, listed = opened, None
    if sitemap is not None:
        entries = in_sitemap(sitemap.select("seed", "loc", "pos").join(opened, "seed"), F.col("host"), include, deny, exclude_paths)
        entries = entries.groupBy("seed", "host", "left", "loc").agg(F.min("pos").alias("first"))
        if limited:
            entries = Ordered(entries, "seed", ["first", "loc"]).running(_n=F.lit(1)).done().filter("left is null or _n <= left").drop("_n", "_n_total")
        listed = cut(judged(entries.withColumnRenamed("loc", "url").withColumn("ord", F.lpad(F.col("first").cast("string"), 12, "0"))))
        counted(listed.withColumn("scope", F.lit(True)))
        rows = opened.join(listed.select("seed").distinct(), "seed", "left_anti")
    front = cut(upto(with_state(rows.select("seed", "host", "left", F.col("seed").alias("url"), F.lit(0).alias("depth"), nowhere, F.lit("bfs").alias("discovered_by"), F.lit("").alias("ord")))))
    seen = front
    edges = link_edges(pages) if edges is None else edges
    if front.limit(1).count():
        edges = cut(edges.join(fetched.withColumnRenamed("url", "src"), "src", "left_semi"))  # parsed once, read at every level
    for depth in range(1, max_depth + 1):
        front = front.filter("state = 'ok' and (left is null or left > 0)")
        if not front.limit(1).count():
            break
        out = edges.join(front.select("seed", "host", "left", F.col("url").alias("src"), F.col("ord").alias("_ord")), "src")
        out = out.withColumnRenamed("dst", "url").join(seen.select("seed", "url"), ["seed", "url"], "left_anti")
        out = cut(judged(out.withColumn("scope", U.in_scope(F.col("url"), F.col("host"), list(deny), list(include)))))
        counted(out)
        at = F.concat("_ord", F.lit("/"), F.lpad(F.col("pos").cast("string"), 8, "0"))
        nxt = out.filter("scope and allowed").groupBy("seed", "host", "left", "url").agg(F.min(F.struct(at.alias("ord"), "src")).alias("by"))
        nxt = with_state(nxt.select("seed", "host", "left", "url", F.lit(depth).alias("depth"), F.col("by.src").alias("discovered_from"), F.lit("bfs").alias("discovered_by"), F.col("by.ord").alias("ord")))
        front = cut(upto(cut(nxt) if limited else nxt))
        seen = seen.unionByName(front)
    if listed is not None:
        seen = seen.unionByName(cut(with_state(listed.filter("allowed").select("seed", "host", "left", "url", F.lit(0).alias("depth"), nowhere, F.lit("sitemap").alias("discovered_by"), "ord"))))
    urls = seen.withColumn("ord", F.concat(F.lpad(F.col("depth").cast("string"), 4, "0"), F.lit(":"), "ord")).drop("host", "left")
    return Walk(urls.filter("state = 'ok'") if extracting else urls, _summary(starts, seen, listed, reduce(DataFrame.unionByName, counters), extracting))


def _summary(starts: DataFrame, seen: DataFrame, listed: DataFrame | None, counters: DataFrame, extracting: bool) -> DataFrame:
    """A row per seed of what was seen, listed in site maps and not followed."""
    total = counters.groupBy("seed").agg(F.sum("excluded").alias("_out"), F.sum("blocked").alias("robots_blocked"), F.sum("unavailable").alias("robots_unavailable"))
    facts = seen.groupBy("seed").agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col("state") == s).alias(f"_{s}") for s in ("ok", "skipped", "error")])
    out = starts.join(facts, "seed", "left").join(total, "seed", "left")
    if listed is not None:
        out = out.join(listed.groupBy("seed").agg(F.count(F.lit(1)).alias("_listed")), "seed", "left")
    none = F.lit(0).cast("long")
    n = {c: F.coalesce(c, none) for c in ("_n", "_ok", "_skipped", "_error", "_out", "robots_blocked", "robots_unavailable")}
    found = n["_ok"] if extracting else n["_n"]
    stopped = F.when(F.col("host").isNull(), "invalid_seed").when(~F.col("allowed"), "robots_denied").when(found >= F.col("limit"), "limit_reached").otherwise("scope_exhausted")
    return out.select("seed", (n["_n"] if listed is None else F.coalesce("_listed", "_n", none)).alias("visited"), found.alias("discovered"), (n["_out"] + (n["_skipped"] if extracting else none)).alias("excluded"),
                      (n["_error"] if extracting else none).alias("errors"), n["robots_blocked"].alias("robots_blocked"), n["robots_unavailable"].alias("robots_unavailable"), stopped.alias("stopped_reason"))


def walk(pages: DataFrame, robots: DataFrame, seed: str, limit: int | None, mode: str = "balanced", sitemap: DataFrame | None = None, **options) -> Walk:
    """Map (or with ``extracting`` crawl) a site held as a table of fetched pages
    (url, html, status) from a seed.

    Every level of the breadth-first search is one join of the frontier with the
    links of fetched pages, written before the next; links out of scope or closed
    by robots rules are not followed but counted.  A URL is found by the first
    link to it, in the order of discovery, and the limit is filled in that order
    (None: no limit).  URLs without a page are visited and have no links; a crawl
    counts them as errors and leaves out pages whose path holds an excluded text.
    sitemap: entries (loc, pos); if any is in scope they are taken instead.
    options: max_depth, include and deny (domains), exclude_paths, extracting, edges.
    """
    known = robots_tables(robots).kept()
    starts = gated(pages.sparkSession.createDataFrame([(seed, limit)], "seed string, limit long"), known, mode)
    first = starts.first()
    if first.host is None:
        raise ValueError(f"no host in {seed}")
    if not first.allowed:
        raise RobotsDenied(f"{seed}: {first.reason}")
    found = _walks(pages, known, starts, mode, sitemap=None if sitemap is None else sitemap.withColumn("seed", F.lit(seed)), **options)
    return Walk(found.urls.drop("seed"), found.summary.drop("seed"))


def map_site(pages: DataFrame, robots: DataFrame, seed: str, limit: int | None, **options) -> Walk:
    """URLs that can be reached from the seed, or those of its sitemap."""
    return walk(pages, robots, seed, limit, **options)


def crawl_site(pages: DataFrame, robots: DataFrame, seed: str, limit: int | None, **options) -> tuple[DataFrame, DataFrame]:
    """(documents, summary): a map of the site with every page extracted."""
    found = walk(pages, robots, seed, limit, extracting=True, **options)
    documents = found.urls.drop("state").join(D.extract_documents(pages), "url")
    return documents, found.summary


def map_sites(pages: DataFrame, robots: DataFrame, seeds: DataFrame, **options) -> Walk:
    """URLs that can be reached from each of the seeds (seed, limit), or those of its sitemap."""
    return walks(pages, robots, seeds, **options)


def crawl_sites(pages: DataFrame, robots: DataFrame, seeds: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """(documents, summary) of the seeds (seed, limit); a page that several reach is extracted once."""
    found = walks(pages, robots, seeds, extracting=True, **options)
    reached = pages.join(found.urls.select("url").distinct(), "url", "left_semi")
    return found.urls.drop("state").join(D.extract_documents(reached), "url"), found.summary


def crawl_domain(pages: DataFrame, robots: DataFrame, domain: str, max_pages: int | None, depth: int = 3, **options) -> dict[str, DataFrame]:
    """A map of a domain: mapped (url, depth, category, ord), by_category (category,
    place, url, n), recommended (the first 20 that are docs, pricing, blog or product)."""
    host = domain.split("://", 1)[-1].split("/", 1)[0]
    found = walk(pages, robots, f"https://{host}", max_pages, max_depth=depth, **options)
    mapped = found.urls.select("url", "depth", U.category(F.col("url")).alias("category"), "ord")
    return {"mapped": mapped, "by_category": by_category(mapped), "recommended": recommended(mapped)}


def crawl_domains(pages: DataFrame, robots: DataFrame, domains: DataFrame, depth: int = 3, **options) -> dict[str, DataFrame]:
    """Maps of many domains (domain, limit), as crawl_domain for each but in one loop; all
    tables have the host as seed ``https://<host>``, and summary has a row for each."""
    seeds = domains.select(F.concat(F.lit("https://"), F.substring_index(F.regexp_replace("domain", "^.*?://", ""), "/", 1)).alias("seed"), "limit")
    found = walks(pages, robots, seeds, max_depth=depth, **options)
    mapped = found.urls.select("seed", "url", "depth", U.category(F.col("url")).alias("category"), "ord")
    placed = Ordered(mapped.withColumn("_key", F.struct("seed", "category")), "_key", "ord").running(place=F.lit(1)).done().drop("_key").withColumnRenamed("place_total", "n")
    good = mapped.filter(F.col("category").isin([c for c, _ in U.CATEGORIES]))
    first = Ordered(good, "seed", "ord").running(_n=F.lit(1)).done().filter("_n <= 20").drop("_n", "_n_total")
    return {"mapped": mapped, "by_category": placed.select("seed", "category", "place", "url", "n"), "recommended": first, "summary": found.summary}


def by_category(mapped: DataFrame, order: str = "ord") -> DataFrame:
    """(category, place, url, n): the URLs of each category in map order, numbered from
    1, and how many it has; a row each, as a category may hold the whole domain."""
    rows = Ordered(mapped.select("category", "url", order), "category", order).running(place=F.lit(1)).done()
    return rows.select("category", "place", "url", F.col("place_total").alias("n"))


def category_lists(rows: DataFrame) -> DataFrame:
    """(category, urls, n) of by_category, one list each, for reports on maps of limited size."""
    items = F.array_sort(F.collect_list(F.struct("place", "url")))
    return rows.groupBy("category").agg(F.transform(items, lambda x: x["url"]).alias("urls"), F.count(F.lit(1)).alias("n"))


def recommended(mapped: DataFrame, order: str = "ord", most: int = 20) -> DataFrame:
    """The first URLs, in map order, of the four categories worth extracting."""
    return mapped.filter(F.col("category").isin([c for c, _ in U.CATEGORIES])).orderBy(order).limit(most)


def bfs(edges: DataFrame, seed: str, max_depth: int, limit: int | None) -> DataFrame:
    """(url, depth, discovered_from) reached from seed over edges (src, dst).

    One level a round, each a join of frontier and edges without what was seen;
    of several parents the smallest counts, and the limit (None: none) is filled
    in URL order.
    """
    spark = edges.sparkSession
    edges = cut(edges.select("src", "dst").filter("src <> dst").distinct())
    seen = spark.createDataFrame([(seed, 0, None)], "url string, depth int, discovered_from string")
    front, left = seen, None if limit is None else limit - 1
    for depth in range(1, max_depth + 1):
        if left is not None and left <= 0:
            break
        nxt = (edges.join(front.select(F.col("url").alias("src")), "src").groupBy(F.col("dst").alias("url")).agg(F.min("src").alias("discovered_from"))
               .join(seen.select("url"), "url", "left_anti").select("url", F.lit(depth).alias("depth"), "discovered_from"))
        nxt = cut(nxt if left is None else nxt.orderBy("url").limit(left))
        n = nxt.count()
        if not n:
            break
        left = None if left is None else left - n
        seen, front = seen.unionByName(nxt), nxt
    return seen
