"""Site maps from files: XML, plain or gzipped, read an element a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The elements of an entry of the sitemap protocol.
ENTRY = "loc string, lastmod string, changefreq string, priority string"


def read_sitemaps(spark: SparkSession, path: str | list[str], url: Column | None = None) -> DataFrame:
    """(sitemap, loc, lastmod, changefreq, priority, is_index, block, pos) of the site maps
    and indexes below a path.

    Spark's XML reader makes a row of every ``url`` and ``sitemap`` element, whatever
    its namespace prefix, so no file is held whole and a large plain one is read in
    parts; gzipped ones are told by their ending.  Entities are decoded, an empty
    element is null, a priority that is no number too; entries without a loc, and what
    follows the first broken element of a file, are left out.  (block, pos) is the order
    of a file's entries.  url: the map's URL in terms of ``file`` (by default the file)."""
    def elements(tag: str) -> DataFrame:
        rows = spark.read.format("xml").schema(ENTRY).options(rowTag=tag, ignoreNamespace=True).load(path)
        rows = rows.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
        return rows.withColumns({"pos": F.monotonically_increasing_id(), "is_index": F.lit(tag == "sitemap")})

    rows = elements("url").unionByName(elements("sitemap"))
    text = {c: F.nullif(F.trim(c), F.lit("")) for c in ("loc", "lastmod", "changefreq", "priority")}
    out = rows.select((F.col("file") if url is None else url).alias("sitemap"), *[text[c].alias(c) for c in ("loc", "lastmod", "changefreq")],
                      text["priority"].try_cast("double").alias("priority"), "is_index", "block", "pos")
    return out.filter("loc is not null")


def write_sitemaps(entries: DataFrame, path: str, name: str = "map") -> None:
    """Write entries (map, loc and any of lastmod, changefreq, priority) as gzipped site
    maps, one folder ``<name>=<map>`` for the files of each.

    Every row becomes an element; what Spark writes of a map in one task is one file."""
    rows = entries.repartition(name).sortWithinPartitions(name, "loc")
    rows.write.format("xml").options(rootTag="urlset", rowTag="url", compression="gzip").partitionBy(name).save(path)
