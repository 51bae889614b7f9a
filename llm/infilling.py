"""Fill-in-the-middle: texts cut at units and rearranged, as a relational plan.

A unit is a run of white space with the word after it (or white space at the end).
Units of a text become rows (posexplode), a window sums their lengths, the two cut
requests of a document meet the sums by unit ordinal, the offsets are aggregated per
document and the text is cut by substring.  Only documents that are cut take part,
with their units up to the second cut; their texts are shuffled once, and the window,
the join and the aggregation use that partitioning.

Defined cases: a null text counts as empty and stays plain, as does one that holds a
marker; a null key is hashed as an empty string; rows equal in key and text share one
calculation and come back as often as they were; other columns are ignored, whatever
their names; an empty table gives no rows.  A text is one row, so the units of the
longest text must fit the memory of a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from llm.common import table

UNIT = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of documents that are cut, and of those that put the suffix first.
CUT, SUFFIX_FIRST = 50, 80


def draws(key: Column, seed: int) -> list[Column]:
    """Four numbers below 2**32 that depend on the seed and the key alone."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def _cuts(key: Column, n: Column, seed: int) -> tuple[Column, Column]:
    a, b = (h % (n + 1) for h in draws(key, seed)[:2])
    return F.least(a, b), F.greatest(a, b)


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 42, cut: int = CUT, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every document; form is
    plain, psm (prefix, suffix, middle) or spm (suffix, prefix, middle)."""
    body = F.coalesce(docs[text], F.lit(""))
    docs = docs.select(docs[key].cast("long").alias("doc_id"), body.alias("text")).withColumn("n", F.regexp_count("text", F.lit(UNIT)).cast("long"))
    whole = F.lit(False)
    for marker in (PREFIX, SUFFIX, MIDDLE):
        whole = whole | F.contains("text", F.lit(marker))
    is_plain = (F.col("text") == "") | whole | (draws(F.col("doc_id"), seed)[2] % 100 >= cut)
    none = F.lit(None).cast("long")
    plain = docs.filter(is_plain).select("doc_id", "n", F.lit("plain").alias("form"), none.alias("prefix_chars"), none.alias("middle_chars"), F.col("text").alias("output"))

    # Equal rows are one; the branches below use the same columns, so Spark shuffles the texts once.
    at = ["k", "d"]
    rows = docs.filter(~is_plain).withColumns({"k": F.xxhash64("doc_id", "text"), "d": F.coalesce("doc_id", F.lit(0))})
    rows = rows.groupBy(*at).agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.first("n").alias("n"), F.count(F.lit(1)).alias("times"))
    low, high = _cuts(F.col("doc_id"), F.col("n"), seed)

    # An empty unit before the first one: the sum at ordinal i is the offset of cut i.
    matches = F.concat(F.array(F.lit("")), F.regexp_extract_all("text", F.lit(UNIT), 0))
    units = rows.select(*at, high.alias("high"), F.posexplode(matches).alias("ordinal", "unit")).filter("ordinal <= high")
    ends = F.sum(F.length("unit")).over(W.partitionBy(*at).orderBy("ordinal").rowsBetween(W.unboundedPreceding, 0))
    units = units.select(*at, "ordinal", ends.alias("end"))
    requests = rows.select(*at, "doc_id", "text", "n", "times", low.alias("low"), high.alias("high"))
    met = units.join(requests, at).filter((F.col("ordinal") == F.col("low")) | (F.col("ordinal") == F.col("high")))
    per = met.groupBy(*at).agg(*[F.first(c).alias(c) for c in ("doc_id", "text", "n", "times")],
                               F.max(F.when(F.col("ordinal") == F.col("low"), F.col("end"))).alias("p"), F.max(F.when(F.col("ordinal") == F.col("high"), F.col("end"))).alias("q"))
    p, q = F.col("p").cast("int"), F.col("q").cast("int")
    parts = per.select("doc_id", "n", "times", "p", "q", F.substr("text", F.lit(1), p).alias("prefix"), F.substr("text", p + 1, q - p).alias("middle"), F.substr("text", q + 1).alias("suffix"),
                       F.when(draws(F.col("doc_id"), seed)[3] % 100 < suffix_first, "spm").otherwise("psm").alias("form"))
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    made = parts.select("doc_id", "n", "form", F.col("p").alias("prefix_chars"), (F.col("q") - F.col("p")).alias("middle_chars"),
                        F.when(F.col("form") == "spm", spm).otherwise(psm).alias("output"), "times")
    made = made.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).drop("times", "_")
    return plain.unionByName(made)


def restored(output: Column, form: Column) -> Column:
    """The text that an output of fill_in_middle was made from.

    A cut text holds no marker and a marker's first character is not in the rest of
    it, so the first occurrence of each marker is the one that was put there."""
    def between(first: str, second: str) -> tuple[Column, Column, Column]:
        tail = F.substr(output, F.lit(len(first) + 1))
        a = F.substring_index(tail, second, 1)
        tail = F.substr(tail, F.length(a) + len(second) + 1)
        b = F.substring_index(tail, MIDDLE, 1)
        return a, b, F.substr(tail, F.length(b) + len(MIDDLE) + 1)

    suffix, prefix, middle = between(SUFFIX, PREFIX)
    spm = F.concat(prefix, middle, suffix)
    prefix, suffix, middle = between(PREFIX, SUFFIX)
    return F.when(form == "plain", output).when(form == "spm", spm).otherwise(F.concat(prefix, middle, suffix))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def sql() -> str:
    unit = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
    return f"""
with d as (select doc_id, coalesce(text, '') as text, sha256('42:' || coalesce(doc_id::varchar, '')) as h from documents),
u as (select *, regexp_extract_all(text, '{unit}') as units, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2,
             ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4 from d),
c as (select *, len(units) as n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) as lo, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) as hi,
             case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 50 then 'plain'
                  when h4 % 100 < 80 then 'spm' else 'psm' end as form from u),
s as (select *, array_to_string(units[1:lo], '') as p, array_to_string(units[lo + 1:hi], '') as m, array_to_string(units[hi + 1:], '') as x from c)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(p) end::bigint as prefix_chars, case when form <> 'plain' then length(m) end::bigint as middle_chars,
       sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || x || '<M>' || m else '<S>' || x || '<P>' || p || '<M>' || m end) as output_sha256,
       sha256(text) as restored_sha256 from s"""
