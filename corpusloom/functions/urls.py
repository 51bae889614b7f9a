"""URL functions as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import contains_any

# Path words of the page categories and of pages worth expanding.
CATEGORIES = [
    ("docs", ["/docs", "/guide", "/reference"]),
    ("pricing", ["/pricing", "/plan"]),
    ("blog", ["/blog", "/news", "/article"]),
    ("product", ["/feature", "/product", "/solution"]),
]
EXPANSION = ["docs", "guide", "reference", "pricing", "plan", "blog", "news", "feature", "product", "solution"]
SITEMAP_PATHS = ["/sitemap.xml", "/sitemap-index.xml", "/sitemap-news.xml", "/sitemap_products.xml", "/sitemap.xml.gz"]


def sitemap_candidates(origin_: Column) -> Column:
    """The URLs at which an origin may have its site map, in the order they are tried."""
    return F.array(*[F.concat(origin_, F.lit(p)) for p in SITEMAP_PATHS])


def host(url: Column) -> Column:
    """Lower-case host without ``www.``; null for what is no URL."""
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), "^www\\.", "")


def plain_host(url: Column) -> Column:
    """What the plain pattern ``^[a-z]+://([^/?#:]*)`` finds, in lower case without ``www.``;
    empty for what it does not fit.  Letters become lower case one by one, as in SQL."""
    found = F.regexp_extract(url, "^[a-z]++://([^/?#:]*+)", 1)
    return F.regexp_replace(F.lower(F.translate(found, "\u0130\u03a3", "i\u03c3")), "^www\\.", "")


def path(url: Column) -> Column:
    p = F.try_parse_url(url, F.lit("PATH"))
    return F.when(p == "", "/").otherwise(p)


def category(url: Column) -> Column:
    p, out = F.lower(path(url)), None
    for name, words in CATEGORIES:
        out = F.when(contains_any(p, words), name) if out is None else out.when(contains_any(p, words), name)
    return out.otherwise("general")


def worth_expanding(url: Column) -> Column:
    return contains_any(F.lower(path(url)), EXPANSION)


def synthetic_title(url: Column) -> Column:
    words = F.trim(F.regexp_replace(path(url), "[-_/]+", " "))
    h = F.lower(F.try_parse_url(url, F.lit("HOST")))
    return F.when(words == "", h).otherwise(F.concat_ws(" ", h, words))


def shard(url: Column, n: int) -> Column:
    return (F.conv(F.substring(F.md5(url), 1, 8), 16, 10).cast("long") % n).cast("long")


def cache_key(*cols: Column) -> Column:
    """Key of a request: 24 hex digits of the SHA-256 of its fields as JSON, nulls
    and separators kept apart."""
    fields = F.to_json(F.array(*[F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"}) for c in cols]))
    return F.substring(F.sha2(fields, 256), 1, 24)


def region(url: Column, regions: list[str]) -> Column:
    """The region that a URL's hash picks."""
    return F.element_at(F.array(*[F.lit(r) for r in regions]), (shard(url, len(regions)) + 1).cast("int"))


def mine(url: Column, n: int, own: int) -> Column:
    """Whether a worker of n processes the URL."""
    return shard(url, n) == own


def namespace(base: Column, cluster: Column) -> Column:
    return F.concat_ws(":", cluster, base)


def value_hash(value: Column) -> Column:
    """Hash of a text or a structured value; only equality of hashes has a meaning."""
    return F.sha2(value, 256)


def origin(url: Column) -> Column:
    return F.regexp_extract(url, "^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)


# The forms of a domain: each use has its own rules.
def plain_domain(d: Column) -> Column:
    """Of a policy: trimmed, lower-case, without a leading dot."""
    return F.regexp_replace(F.lower(F.trim(d)), "^\\.", "")


def bare_host(url: Column) -> Column:
    """Of a limiter or host memory: the host of a URL without ``www.``, else the text as it is, in lower case."""
    return F.coalesce(host(url), F.lower(url))


def domain_of(text: Column) -> Column:
    """Of a crawled domain: without scheme and path."""
    return F.regexp_replace(F.regexp_replace(text, "^https?://", ""), "/.*$", "")


def traced_host(url: Column) -> Column:
    """Of a trace: the host as it is, ``unknown`` for what is no URL."""
    return F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("unknown"))


def domain_allowed(host_: Column, allow: list[str] = (), deny: list[str] = ()) -> Column:
    """Not below a denied domain, and below an allowed one if there are any."""
    h = plain_domain(host_)

    def under(domains: list[str]) -> Column:
        out = F.lit(False)
        for d in (x.strip().lower().removeprefix(".") for x in domains):
            out = out | (h == d) | F.endswith(h, F.lit("." + d))
        return out

    return F.coalesce(~under(deny) & (under(allow) if allow else F.lit(True)), F.lit(False))


# ---- cookies -----------------------------------------------------------------

def cookie(header: Column, fallback_domain: Column, now: Column) -> Column:
    """struct(name, value, domain, path, expires_at) of a Set-Cookie header; null
    without a name.  The later of Expires and Max-Age in the header counts; now and
    expires_at are timestamps."""
    parts = F.transform(F.split(header, ";"), lambda x: F.trim(x))
    pair, attrs = F.get(parts, 0), F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    at = F.instr(pair, "=")

    def last(name: str) -> Column:
        hits = F.filter(attrs, lambda x: F.lower(F.substring_index(x, "=", 1)) == name)
        return F.nullif(F.get(F.split(F.element_at(F.concat(F.array(F.lit("")), hits), -1), "="), 1), F.lit(""))

    def expiry(x: Column) -> Column:
        k, v = F.lower(F.substring_index(x, "=", 1)), F.get(F.split(x, "="), 1)
        date = F.try_to_timestamp(F.regexp_replace(v, "^[A-Za-z]+,\\s*|\\s*GMT$", ""), F.lit("d MMM yyyy HH:mm:ss"))
        seconds = F.regexp_extract(v, "^\\s*([+-]?\\d+)", 1).try_cast("long")
        return F.when(k == "expires", date).when(k == "max-age", now + F.make_dt_interval(secs=seconds))

    times = F.array_compact(F.transform(attrs, expiry))
    fields = F.struct(F.substring_index(pair, "=", 1).alias("name"), F.substr(pair, at + 1).alias("value"),
                      F.coalesce(plain_domain(last("domain")), fallback_domain).alias("domain"), last("path").alias("path"),
                      F.when(F.size(times) > 0, F.element_at(F.when(F.size(times) > 0, times).otherwise(F.array(now)), -1)).alias("expires_at"))
    return F.when(at > 0, fields)


def cookie_fits(c: Column, host_: Column, path_: Column, now: Column) -> Column:
    """Whether a cookie is sent to a host and path."""
    h, d = plain_domain(host_), plain_domain(c["domain"])
    way = F.coalesce(c["path"], F.lit("/"))
    below = (path_ == way) | F.startswith(path_, F.concat(F.regexp_replace(way, "/$", ""), F.lit("/")))
    return (c["expires_at"].isNull() | (c["expires_at"] > now)) & ((h == d) | F.endswith(h, F.concat(F.lit("."), d))) & ((way == "/") | below)


def in_scope(url: Column, seed_host: str | Column, deny: list[str] = (), allow: list[str] = ()) -> Column:
    """Host equal to the seed's or below it, not denied, and allowed if a list is given."""
    h = host(url)

    def under(d: str | Column) -> Column:
        return (h == d) | F.endswith(h, F.concat(F.lit("."), F.lit(d)))

    ok = under(seed_host)
    for d in deny:
        ok = ok & ~under(d)
    if allow:
        some = F.lit(False)
        for d in allow:
            some = some | under(d)
        ok = ok & some
    return F.coalesce(ok, F.lit(False))


def without_dots(url: Column) -> Column:
    """The URL with ``.`` and ``..`` segments of its path applied."""
    head = F.regexp_extract(url, "^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)([^?#]*)", 1)
    way = F.regexp_extract(url, "^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)([^?#]*)", 2)
    tail = F.regexp_extract(url, "^[^?#]*(.*)$", 1)
    parts = F.split(F.substr(way, F.lit(2)), "/")
    end = F.when(F.element_at(parts, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when(x == ".", acc).when(
        x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))))
    return F.when(way.rlike("/[.]{1,2}(/|$)"), F.concat(head, F.lit("/"), F.array_join(F.concat(kept, end), "/"), tail)).otherwise(url)


def resolve(href: Column, base: Column) -> Column:
    """Absolute URL of a link on a page; null if it has no target."""
    origin = F.regexp_extract(base, "^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, "^([a-zA-Z][a-zA-Z0-9+.-]*):", 1)
    folder = F.regexp_replace(F.regexp_replace(base, "[?#].*$", ""), "(://[^/]+.*/)[^/]*$|(://[^/]+)$", "$1$2")
    return without_dots(F.when(href.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
            .when(F.startswith(href, F.lit("//")), F.concat(scheme, F.lit(":"), href))
            .when(F.startswith(href, F.lit("/")), F.concat(origin, href))
            .when(F.startswith(href, F.lit("#")), F.concat(F.regexp_replace(base, "#.*$", ""), href))
            .when(F.startswith(href, F.lit("?")), F.concat(F.regexp_replace(base, "[?#].*$", ""), href))
            .when(href == "", base).otherwise(F.concat(folder, href)))
