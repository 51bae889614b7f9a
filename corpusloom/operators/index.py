"""Search over a large corpus by an inverted index.

The index is a table (bucket, term, block, docs): for each word and each block of
``BLOCK`` documents in key order, the documents that hold it.  It is partitioned by a
hash of the word and sorted by word and block, so a query reads only its words' row
groups.  The number of a query's words that a block has is the most that one of its
documents can hold.  A search goes down from all words to one: at each step only blocks
that can hold that many words are opened, and it stops as soon as enough documents are
found, as no other block can hold better ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import scans

BLOCK, BUCKETS = 1024, 64


def bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def build_index(corpus: DataFrame, path: str, key: str = "doc_id", text: str = "text", host: str = "domain", block: int = BLOCK, buckets: int = BUCKETS) -> None:
    """Write the index of a corpus with unique keys to ``path``.  The empty word stands for
    all documents.  A row of the index holds a block's documents at most, so the most
    frequent word needs no large rows, and its rows may lie in many files."""
    rows = scans.ranked(corpus.select(F.col(key).alias("key"), F.col(host).alias("host"), F.array_distinct(T.tokens(F.col(text))).alias("words")), [F.col("key")], "at")
    rows = rows.select(((F.col("at") - 1) / block).cast("long").alias("block"), F.struct("key", "host").alias("doc"), F.explode(F.concat(F.array(F.lit("")), "words")).alias("term"))
    posts = rows.groupBy("term", "block").agg(F.array_sort(F.collect_list("doc")).alias("docs")).withColumn("bucket", bucket(F.col("term"), buckets))
    (posts.repartitionByRange(buckets, "bucket", "term", "block").sortWithinPartitions("bucket", "term", "block")
     .write.partitionBy("bucket").option("parquet.block.size", 8 << 20).parquet(path))


def postings(spark: SparkSession, path: str, words: list[str], buckets: int = BUCKETS) -> DataFrame:
    """(term, block, docs) of some words, from their partitions alone."""
    listed = spark.createDataFrame([(w,) for w in words], "w string").select(bucket(F.col("w"), buckets)).distinct().collect() if words else []
    return spark.read.parquet(path).filter(F.col("bucket").isin([r[0] for r in listed]) & F.col("term").isin(words)).drop("bucket")


def search(spark: SparkSession, path: str, query: str, limit: int, key: str = "doc_id", exclude: list[str] = (), include: list[str] = (), buckets: int = BUCKETS) -> DataFrame:
    """(key, score, rank): the same as ``research.search`` over the whole corpus."""
    words = spark.range(1).select(F.array_distinct(T.tokens(F.lit(query)))).first()[0]

    def permitted(docs: DataFrame) -> DataFrame:
        name = F.lower(F.coalesce("doc.host", F.lit("")))
        if exclude:
            docs = docs.filter(~T.contains_any(name, [w.lower() for w in exclude]))
        return docs.filter(T.contains_any(name, [w.lower() for w in include])) if include else docs

    posts = postings(spark, path, words, buckets)
    bounds = posts.groupBy("block").agg(F.count(F.lit(1)).alias("bound"))
    best, found = spark.createDataFrame([], posts.select(F.explode("docs").alias("d")).select(F.col("d.key").alias("key"), F.lit(0).cast("long").alias("n")).schema), 0
    for least in range(len(words), 0, -1):
        opened = posts.join(bounds.filter(F.col("bound") >= least).select("block"), "block", "left_semi").select(F.explode("docs").alias("doc"))
        held = permitted(opened).groupBy(F.col("doc.key").alias("key")).agg(F.count(F.lit(1)).alias("n"))
        best = held.filter(F.col("n") >= least).orderBy(F.desc("n"), "key").limit(limit)
        rows = best.collect()  # at most ``limit`` rows
        best, found = spark.createDataFrame(rows, best.schema), len(rows)
        if found >= limit:
            break
    if found < limit:  # the first documents without any of the words
        rest = permitted(postings(spark, path, [""], buckets).select(F.explode("docs").alias("doc"))).select("doc.key").join(best.select("key"), "key", "left_anti")
        best = best.unionByName(rest.orderBy("key").limit(limit - found).withColumn("n", F.lit(0).cast("long")))
    score = F.when(F.col("n") == 0, F.lit(0.2)).otherwise(F.least(F.lit(1.0), F.lit(0.2) + F.lit(0.8) * (F.col("n") / F.lit(max(len(words), 1)))))
    top = best.select("key", score.alias("score"))
    return top.select(F.col("key").alias(key), "score", F.row_number().over(W.orderBy(F.desc("score"), "key")).alias("rank"))  # ``limit`` rows
