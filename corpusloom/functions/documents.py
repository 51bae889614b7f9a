"""Extracted documents: every page field in one projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import html as H
from corpusloom.functions import structured as S


def extract_documents(pages: DataFrame, links: bool = True, structured: bool = False, closed: bool = False) -> DataFrame:
    """(url, title, description, canonical, lang, text, markdown, links, n_words,
    n_links, confidence, source_quality, status[, structured, normalised]) of
    fetched pages (url, html, status), one row each and without a shuffle; links
    are [] if they are not asked for.  structured adds the fields of the page's kind.
    closed: title and text decode only character references that end in ``;``."""
    tags, base = F.col("_tags"), F.col("url")
    out = pages.select("url", "html", F.coalesce("status", F.lit(200)).alias("status"), H.marks(F.col("html"), H.FIELDS).alias("_tags"))
    out = out.select("url", "html", "status", H.title_of(tags, closed).alias("title"), H.description_of(tags).alias("description"),
                     H.canonical_of(tags, base).alias("canonical"), H.lang_of(tags).alias("lang"), H.body_text(F.col("html"), closed).alias("text"),
                     (H.links_of(tags, base) if links else F.array().cast("array<string>")).alias("links"))
    out = out.withColumns({"markdown": H.markdown(F.col("title"), F.col("text")), "n_words": H.word_count(F.col("text")), "n_links": F.size("links").cast("long")})
    out = out.withColumns({"confidence": H.confidence(F.col("html"), F.col("title"), F.col("n_words"), F.col("n_links")), "source_quality": H.status_quality(F.col("status"))})
    if structured:
        out = out.withColumn("structured", S.structured(F.col("html"), F.col("url"), closed)).withColumn("normalised", S.normalised(F.col("structured")))
    return out.drop("html")


def extract(pages: DataFrame, allow: list[str] = (), deny: list[str] = (), **options) -> tuple[DataFrame, DataFrame]:
    """(documents, rejected): pages of permitted domains extracted, the others as (url, host)."""
    from corpusloom.functions import urls as U
    host = F.lower(F.try_parse_url("url", F.lit("HOST")))
    ok = U.domain_allowed(host, allow, deny)
    return extract_documents(pages.filter(ok), **options), pages.filter(~ok).select("url", host.alias("host"))
