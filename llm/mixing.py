"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies (target of
the source over its size).  Within a source the documents are laid in one order,
the expected copies are prefix-summed, one random offset is added, and a
document is emitted once per integer boundary its interval crosses.  The order
runs by size, so the words taken stay close to the target.

A source may hold any share of the rows: ranks come from counts of
(source, size, salt) groups, so no task sees a whole source.

Defined cases: a null text has size 0; null sources form one source, the last;
a null doc_id sorts first; repeated rows are documents of their own; a source of
size 0 has target 0; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from llm.common import table
from llm.quality_rules import SPACE, SPACE_CHARS

#: Groups that one (source, size) is dealt into.
SALTS = 1021
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2


def word_count(text: Column) -> Column:
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, SPACE))).cast("long")


def offset(source: Column, seed: int) -> Column:
    """The source's random offset in [0, 1)."""
    key = F.concat(F.coalesce(source, F.lit("\x00")), F.lit(f"|{seed}"))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long").cast("double") / F.lit(4294967296.0)


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from (source, size, n) rows.

    Weights 3, 1, 2 repeat over the sources in code point order, null last.  A
    target stops at MOST times its source's size; what it leaves goes to the
    others by weight until none is above: with sources ordered by cap per unit
    of weight, those below the final level are capped and the rest share.
    """
    per = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    i = F.row_number().over(W.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (i % len(WEIGHTS) + 1).cast("int"))
    per = per.withColumn("w", weight.cast("long")).withColumn("cap", F.col("source_size") * MOST)
    by = W.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    before = by.rowsBetween(W.unboundedPreceding, -1)
    after = by.rowsBetween(0, W.unboundedFollowing)
    per = per.withColumns({
        "capped_before": F.coalesce(F.sum("cap").over(before), F.lit(0)),
        "w_left": F.sum("w").over(after),
        "total": F.sum("source_size").over(W.partitionBy()),
    })
    level = (F.col("total") * SHARE - F.col("capped_before")) / F.col("w_left")
    per = per.withColumn("level", level)
    # the first source that the level does not fill sets the level for all behind it
    found = F.min(F.when(F.col("level") * F.col("w") < F.col("cap"),
                         F.struct(F.col("cap") / F.col("w"), F.col("level").alias("v")))).over(W.partitionBy())
    share = F.coalesce(found["v"] * F.col("w"), F.col("cap").cast("double"))
    return per.select("source", "source_size", F.least(share, F.col("cap").cast("double")).alias("target"))


def with_copies(docs: DataFrame, size: Column, source: str = "source", key: str = "doc_id", seed: int = 7) -> DataFrame:
    """(_row, _size, _source_size, _target, _copies): each document and the copies
    the mix takes; size is a Column of docs, its number of words."""
    rows = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("_row"),
        docs[source].alias("source"), docs[key].alias("_key"), size.alias("size"),
        F.pmod(F.coalesce(docs[key].cast("long"), F.lit(0)), F.lit(SALTS)).alias("salt"),
    )
    groups = rows.groupBy("source", "size", "salt").agg(F.count(F.lit(1)).alias("n"))
    per_size = groups.groupBy("source", "size").agg(F.sum("n").alias("n"))
    targets = source_targets(per_size)
    upto = W.unboundedPreceding, -1
    size_start = per_size.select(
        "source", "size",
        F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy("size").rowsBetween(*upto)), F.lit(0)).alias("before_size"))
    starts = groups.select(
        "source", "size", "salt",
        F.coalesce(F.sum("n").over(W.partitionBy("source", "size").orderBy("salt").rowsBetween(*upto)), F.lit(0)).alias("before_salt"))

    def same(a: DataFrame, b: DataFrame, *cols: str) -> Column:
        cond = a["source"].eqNullSafe(b["source"])
        for c in cols:
            cond = cond & (a[c] == b[c])
        return cond

    starts = (starts.join(size_start, same(starts, size_start, "size"))
              .select(starts["source"], starts["size"], "salt", (F.col("before_size") + F.col("before_salt")).alias("before")))
    starts = (starts.join(targets, same(starts, targets))
              .select(starts["source"], "size", "salt", "before", "source_size", "target"))
    ranked = rows.withColumn("rank", F.row_number().over(
        W.partitionBy("source", "size", "salt").orderBy("_key")))
    joined = ranked.join(starts, same(ranked, starts, "size", "salt")).select(
        "_row", ranked["source"].alias("_source"), ranked["size"].alias("_size"), "source_size", "target",
        (F.col("before") + F.col("rank")).alias("k"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    u = offset(F.col("_source"), seed)
    copies = F.floor(u + rate * F.col("k")) - F.floor(u + rate * (F.col("k") - 1))
    return joined.select("_row", "_size", F.col("source_size").alias("_source_size"),
                         F.col("target").alias("_target"), copies.cast("long").alias("_copies"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", seed: int = 7) -> DataFrame:
    """The mixed corpus: rows of docs, each as often as the mix takes it."""
    return (with_copies(docs, word_count(docs[text]), source, key, seed)
            .select("_row", F.explode(F.array_repeat(F.lit(0), F.col("_copies").cast("int"))).alias("_i"))
            .select("_row.*"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the sizes are enough here: the texts are not shuffled
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("n_words"))
    return with_copies(docs, docs["n_words"]).select(
        F.col("_row.doc_id").alias("doc_id"), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"), (F.col("_copies") * F.col("_size")).alias("taken"))


def sql(seed: int = 7) -> str:
    """The query in DuckDB SQL; the level by trying every number of capped sources."""
    w = "CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END"
    return f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
p AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, 2 * source_size AS cap, {w} AS w FROM p),
o AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS c0,
        sum(w) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS w1,
        sum(source_size) OVER ()::BIGINT AS total FROM w),
l AS (SELECT *, (total * 1.5::DOUBLE - c0) / w1 AS level FROM o),
f AS (SELECT arg_min(level, cap / w) AS v FROM l WHERE level * w < cap),
t AS (SELECT source, source_size, least(coalesce(v * w, cap::DOUBLE), cap::DOUBLE) AS target FROM l LEFT JOIN f ON true),
k AS (SELECT doc_id, source, size, row_number() OVER (PARTITION BY source ORDER BY size, coalesce(doc_id, 0) % {SALTS}, doc_id NULLS FIRST) AS k FROM d),
r AS (SELECT k.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate,
        ('0x' || substr(md5(coalesce(k.source, chr(0)) || '|{seed}'), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u
      FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  ((floor(u + rate * k) - floor(u + rate * (k - 1))) * size)::BIGINT AS taken FROM r"""
