"""Quality rules: a threshold table compiled into one Spark projection.

Every measure is a Column built from built-in functions, so the whole rule set
runs in the JVM in one pass over the text, without user functions or a shuffle.

Defined cases: a null or empty text has no words, measures 0 and fails the base
rule; ratios over nothing are 0; repeated rows are judged one by one; a table
without rows gives none; extra columns are ignored by the query and kept by
``quality_filter``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import table

SPACE = "[\\x20\\x09-\\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

#: Function words of four languages; a running text has some of them.
STOP_WORDS = (
    "the of and to in is that for it as was with be by on not he are or his this from at which but have an had they you were there "
    "le la les de des du et en un une que qui est dans pour sur par pas au avec ce il elle "
    "der die das und in den von zu mit sich ist des auf nicht eine ein dem als auch es an er "
    "el los las y que en un una por con para del se no su al lo como mas"
).split()


@dataclass(frozen=True)
class Rule:
    """A document is kept only if low <= measure <= high."""

    name: str
    measure: str
    low: float
    high: float


RULES = (
    Rule("word_length", "mean_word_chars", 2.0, 15.0),
    Rule("symbols", "symbol_ratio", 0.0, 0.25),
    Rule("stop_words", "stop_ratio", 0.03, 1.0),
    Rule("shouting", "upper_ratio", 0.0, 0.5),
    Rule("repeated_lines", "dup_line_ratio", 0.0, 0.3),
)


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def _repeat_words() -> Column:
    """Words covered by 3-word windows that occur at least twice.

    Hashes of windows are sorted with their positions; neighbours of one hash and
    the same words are repeats.  Covered words are counted from the sorted
    positions: each window covers min(3, distance to the next repeated window)
    words of its own.
    """
    def same(x: Column, y: Column) -> Column:
        ok = x["w"] == y["w"]
        for j in range(3):
            ok = ok & (F.get("_words", x["i"] + j) == F.get("_words", y["i"] + j))
        return F.coalesce(ok, F.lit(False))

    repeats = F.filter("_sorted", lambda x, i: same(x, F.get("_sorted", i - 1)) | same(x, F.get("_sorted", i + 1)))
    return F.sort_array(F.transform(repeats, lambda x: x["i"]))


def measures(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the measures (prefixed names are dropped again)."""
    t = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.btrim(t, F.lit(SPACE_CHARS))
    df = df.withColumns({
        "_text": t,
        "_words": F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE)),
        "_lines": F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != ""),
    })
    df = df.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": F.regexp_count("_text", F.lit(f"[{SYMBOLS}]")).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_stop": F.size(F.filter("_words", lambda w: (F.length(w) <= max(map(len, STOP_WORDS))) & F.lower(w).isin(STOP_WORDS))).cast("long"),
        "n_upper": F.size(F.filter("_words", lambda w: (F.upper(w) == w) & (F.length(w) > 1) & (F.lower(w) != w))).cast("long"),
        "_hashes": F.transform("_words", lambda w: F.xxhash64(w)),
    })
    df = df.withColumn("_windows", F.when(F.size("_hashes") >= 3, F.transform(
        F.slice("_hashes", 1, F.greatest(F.size("_hashes") - 2, F.lit(1))), lambda h, i: F.xxhash64(h, F.get("_hashes", i + 1), F.get("_hashes", i + 2)))))
    # Most texts repeat no window: only the others are sorted.
    df = df.withColumn("_sorted", F.when(
        F.size(F.array_distinct("_windows")) < F.size("_windows"),
        F.sort_array(F.transform("_windows", lambda w, i: F.struct(w.alias("w"), i.alias("i")))),
    ))
    df = df.withColumn("_at", _repeat_words())
    covered = F.aggregate(
        F.transform("_at", lambda p, i: F.least(F.coalesce(F.get("_at", i + 1) - p, F.lit(3)), F.lit(3))),
        F.lit(0).cast("long"), lambda acc, x: acc + x,
    )
    return df.withColumns({
        "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
        "mean_word_chars": _ratio(F.col("word_chars"), F.col("n_words")),
        "symbol_ratio": _ratio(F.col("n_symbols"), F.col("n_words")),
        "stop_ratio": _ratio(F.col("n_stop"), F.col("n_words")),
        "upper_ratio": _ratio(F.col("n_upper"), F.col("n_words")),
        "dup_line_ratio": _ratio(F.col("n_dup_lines"), F.col("n_lines")),
    }).drop("_text", "_words", "_lines", "_hashes", "_windows", "_sorted", "_at")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """The threshold table as one boolean Column."""
    ok = F.lit(True)
    for r in rules:
        ok = ok & F.col(r.measure).between(r.low, r.high)
    return ok


def judge(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """df with the measures, base_failed and kept."""
    return (measures(df, text)
            .withColumn("base_failed", base_failed())
            .withColumn("kept", ~F.col("base_failed") & verdict(rules)))


def quality_filter(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows that pass, with all their own columns (also those named as a measure)."""
    inner = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs[text].alias("_judged"))
    judged = judge(inner, "_judged", rules)
    # A plain filter would be pushed below the projections and repeat their
    # expressions; one on a generator's output stays above them.
    kept = judged.select(F.explode_outer(F.array_repeat("_row", F.col("kept").cast("int"))).alias("_row"))
    return kept.filter("_row is not null").select("_row.*")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The query in DuckDB SQL."""
    stop = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    ok = " AND ".join(f"{r.measure} BETWEEN {r.low} AND {r.high}" for r in rules)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
s AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
g AS (SELECT rid, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS t
      FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM s)),
c AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, t) AS n FROM g),
r AS (SELECT rid, count(DISTINCT p) AS n_repeat_words
      FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM c WHERE n >= 2) GROUP BY rid),
m AS (SELECT s.rid, doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
        length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
        len(list_filter(w, lambda x: lower(x) IN ({stop}))) AS n_stop,
        len(list_filter(w, lambda x: length(x) > 1 AND upper(x) = x AND lower(x) <> x)) AS n_upper
      FROM s LEFT JOIN r ON s.rid = r.rid),
q AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
        CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS mean_word_chars,
        CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END AS symbol_ratio,
        CASE WHEN n_words > 0 THEN n_stop / n_words ELSE 0 END AS stop_ratio,
        CASE WHEN n_words > 0 THEN n_upper / n_words ELSE 0 END AS upper_ratio,
        CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_line_ratio FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND ({ok}) AS kept
FROM q"""
