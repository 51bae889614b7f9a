"""URL filter: host and path rules, and boosted trees over lexical features.

A URL that a rule fits gets the verdict of the longest one.  All others are
judged by gradient-boosted trees over length, depth, digit ratio, entropy,
parameter counts and statistics of the host's suffix.

Labels come from the table given, or else from the rules: what a rule blocks or
allows is a labelled URL.  Such labels are not independent of the suffix, so a
suffix never decides by itself:

* the label rate of a suffix is out-of-fold: a training URL's rate is counted
  over the labelled URLs of the other folds only (all labelled URLs, not those
  of the sample);
* trees may split on suffix statistics only if ``MIN_SUFFIXES`` suffixes lie on
  both sides;
* the trees are tried on whole suffixes held out (hosts, if there are fewer than
  ``FOLDS`` suffixes), and block only at scores at which ``PRECISION`` of the
  held-out URLs were blocked, both labels weighing the same.  Without such
  evidence they allow.

Every feature is a Column of built-in functions; the trees run on Arrow batches
of numbers, for URLs that no rule fits only.

Defined cases: a null url or one without ``://`` has empty host and path, fits
no rule and is judged by the trees like any other; without labelled URLs, or
with one label only, all others are allowed; URLs of any length are read whole;
repeated rows are judged alike; rules of equal length go by the later one; extra
columns are kept in ``_row``, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import BROADCAST_ROWS, ship, table, written

#: (verdict, host, path); a host stands for all its subdomains.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
#: Most labelled URLs that the trees are trained on.
TRAIN_URLS = 20_000
TREES, DEPTH, RATE, BINS, MIN_LEAF = 40, 4, 0.2, 32, 20
#: Folds of suffix rates and of the trial, suffixes on each side of a split on
#: their statistics, and the share of held-out URLs blocked at a blocking score.
FOLDS, MIN_SUFFIXES, PRECISION = 5, 20, 0.9

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    raw = F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(raw, F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


# ---- features ---------------------------------------------------------------

def suffix_of(host: Column) -> Column:
    """The last two labels of the host."""
    return F.substring_index(host, ".", -2)


def _count(text: Column, char: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))).cast("double")


def _entropy(text: Column) -> Column:
    """Bits per character."""
    n = F.length(text)
    counts = F.transform(F.array_distinct(F.filter(F.split(text, ""), lambda c: c != "")), lambda c: n - F.length(F.replace(text, c, F.lit(""))))
    return F.when(n > 0, F.log2(n) - F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * F.log2(c)) / n).otherwise(0.0)


def lexical(url: Column, host: Column) -> dict[str, Column]:
    """The features of a URL by itself, without its scheme and suffix: their
    letters and lengths would tell a suffix by another name."""
    sub = F.substring(host, F.lit(1), F.length(host) - F.length(suffix_of(host)))
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*", "")
    path = F.regexp_extract(rest, "(?s)^[^?#]*", 0)
    query = F.regexp_extract(rest, r"(?s)^[^?#]*\?([^#]*)", 1)
    bare = F.concat(sub, rest)
    n = F.length(bare)
    return {
        "length": n.cast("double"), "host_length": F.length(sub).cast("double"), "path_length": F.length(path).cast("double"),
        "depth": _count(path, "/"), "dots": _count(sub, "."), "hyphens": _count(bare, "-"),
        "digit_ratio": F.when(n > 0, (n - F.length(F.translate(bare, "0123456789", ""))) / n).otherwise(0.0),
        "entropy": _entropy(bare),
        "parameters": F.when(query == "", 0.0).otherwise(_count(query, "&") + 1),
        "parameter_length": F.length(query).cast("double"),
    }


#: Statistics of a suffix: label rate (out of fold) and logarithm of its labelled URLs.
SUFFIX_FEATURES = ("suffix_rate", "suffix_count")


def fold_of(url: Column) -> Column:
    return F.pmod(F.xxhash64(url, F.lit("fold")), F.lit(FOLDS)).cast("int")


# ---- boosted trees ----------------------------------------------------------

class BoostedTrees:
    """Logistic gradient boosting over histogram-binned features."""

    def __init__(self, prior: float):
        self.base = math.log(prior / (1 - prior)) if 0 < prior < 1 else (50.0 if prior >= 1 else -50.0)
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, group: np.ndarray | None = None,
            grouped: tuple[int, ...] = (), trees: int = TREES) -> BoostedTrees:
        """group: the number of each row's suffix; columns in ``grouped`` are the same
        within a group and are split on only with MIN_SUFFIXES groups on both sides."""
        weight = np.ones(len(y)) if weight is None else weight
        model = cls(float(np.average(y, weights=weight)) if len(y) else 0.0)
        if len(y) == 0 or y.min() == y.max():
            return model
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
        score = np.full(len(y), model.base)
        nodes = 2 ** (DEPTH + 1) - 1
        for _ in range(trees):
            p = 1 / (1 + np.exp(-score))
            grad, hess = weight * (y - p), weight * p * (1 - p)
            feature, cut, value = np.full(nodes, -1), np.zeros(nodes), np.zeros(nodes)
            at = np.zeros(len(y), np.int64)
            for node in range(nodes):
                rows = np.flatnonzero(at == node)
                if not len(rows):
                    continue
                g, h = grad[rows].sum(), hess[rows].sum()
                value[node] = RATE * g / (h + 1.0)
                if node >= nodes // 2 or len(rows) < 2 * MIN_LEAF:
                    continue
                best = (1e-6, -1, 0)
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    b = binned[rows, j]
                    gl = np.cumsum(np.bincount(b, grad[rows], len(e) + 1))[:-1]
                    hl = np.cumsum(np.bincount(b, hess[rows], len(e) + 1))[:-1]
                    nl = np.cumsum(np.bincount(b, minlength=len(e) + 1))[:-1]
                    gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
                    bad = (nl < MIN_LEAF) | (len(rows) - nl < MIN_LEAF)
                    if j in grouped:
                        pairs = np.unique(group[rows] * (len(e) + 1) + b)
                        left = np.cumsum(np.bincount(pairs % (len(e) + 1), minlength=len(e) + 1))[:-1]
                        bad |= (left < MIN_SUFFIXES) | (len(pairs) - left < MIN_SUFFIXES)
                    gain[bad] = -1
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (gain[k], j, k)
                if best[1] < 0:
                    continue
                feature[node], cut[node] = best[1], edges[best[1]][best[2]]
                left = binned[rows, best[1]] <= best[2]
                at[rows] = np.where(left, 2 * node + 1, 2 * node + 2)
            score += value[at]
            model.trees.append((feature, cut, value))
        return model

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1."""
        score = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                f = feature[at]
                go = f >= 0
                left = x[rows, np.maximum(f, 0)] <= cut[at]
                at = np.where(go, np.where(left, 2 * at + 1, 2 * at + 2), at)
            score += value[at]
        return 1 / (1 + np.exp(-score))


def auc(y: np.ndarray, score: np.ndarray) -> float:
    """Chance that a blocked URL scores above an allowed one (ties count half)."""
    _, inverse, n = np.unique(score, return_inverse=True, return_counts=True)
    rank = (np.cumsum(n) - (n - 1) / 2)[inverse]
    bad = y == 1
    a, b = bad.sum(), (~bad).sum()
    return float((rank[bad].sum() - a * (a + 1) / 2) / (a * b)) if a and b else 0.5


@dataclass
class UrlModel:
    """Trees, the least score that blocks, and how they fared on URLs held out."""

    trees: BoostedTrees
    threshold: float = math.inf
    auc: float = 0.5
    held_out_by: str = ""
    importance: dict[str, int] = field(default_factory=dict)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, suffix: list[str], host: list[str], names: list[str]) -> UrlModel:
        y = np.asarray(y, float)
        if len(y) == 0 or y.min() == y.max():
            return cls(BoostedTrees(0.0))
        weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))  # both labels weigh the same
        grouped = tuple(j for j, n in enumerate(names) if n in SUFFIX_FEATURES)
        group = np.unique(suffix, return_inverse=True)[1]
        by = "suffix" if len(set(suffix)) >= FOLDS else "host"
        unit = np.unique(suffix if by == "suffix" else host, return_inverse=True)[1]
        fold = (unit * 2654435761 % (1 << 32)) % FOLDS
        score = np.full(len(y), 0.5)
        for f in range(FOLDS):
            held = fold == f
            if held.any() and not held.all():
                score[held] = BoostedTrees.fit(x[~held], y[~held], weight[~held], group[~held], grouped).predict(x[held])
        model = cls(BoostedTrees.fit(x, y, weight, group, grouped), auc=auc(y, score), held_out_by=by)
        # the lowest score from which on enough of the held-out URLs were blocked (never one below even odds)
        order = np.argsort(-score, kind="stable")
        bad, all_ = np.cumsum((weight * y)[order]), np.cumsum(weight[order])
        ends = np.append(score[order][1:] != score[order][:-1], True)
        good = np.flatnonzero(ends & (bad >= PRECISION * all_) & (np.arange(1, len(y) + 1) >= MIN_LEAF))
        if len(good):
            model.threshold = max(0.5, float(score[order][good[-1]]))
        for feature, _, _ in model.trees.trees:
            for j in feature[feature >= 0]:
                model.importance[names[j]] = model.importance.get(names[j], 0) + 1
        return model


# ---- labels -----------------------------------------------------------------

def suffix_counts(labelled: DataFrame) -> DataFrame:
    """(suffix, n, bad, folds) over all labelled URLs: folds maps a fold to its (n, bad)."""
    per = labelled.groupBy("suffix", fold_of(F.col("url")).alias("fold")).agg(F.count(F.lit(1)).alias("n"), F.sum("blocked").alias("bad"))
    return written(per.groupBy("suffix").agg(
        F.sum("n").alias("all_n"), F.sum("bad").alias("all_bad"),
        F.map_from_entries(F.collect_list(F.struct("fold", F.struct("n", "bad")))).alias("folds")), "suffixes")


def with_suffix_features(df: DataFrame, counts: DataFrame, prior: float, few: bool, fold: Column | None = None) -> DataFrame:
    """df with SUFFIX_FEATURES; fold: the fold whose labels do not count for the row.

    A rate is drawn to the prior by ten URLs.  few: the counts can be broadcast."""
    out = df.join(F.broadcast(counts) if few else counts.hint("merge"), "suffix", "left")
    n, bad = F.coalesce("all_n", F.lit(0)), F.coalesce("all_bad", F.lit(0))
    if fold is not None:
        own = F.col("folds")[fold]
        n, bad = n - F.coalesce(own["n"], F.lit(0)), bad - F.coalesce(own["bad"], F.lit(0))
    return out.withColumns({"suffix_rate": (bad + 10 * prior) / (n + 10), "suffix_count": F.log2(n + 1.0)}).drop("all_n", "all_bad", "folds")


def train(labelled: DataFrame, counts: DataFrame, total: int, prior: float, limit: int = TRAIN_URLS) -> UrlModel:
    """The trees, from at most ``limit`` distinct labelled URLs: those below a hash
    that about 95 % of the limit lie under."""
    share = min(1.0, 0.95 * limit / max(total, 1))
    picked = labelled if share == 1.0 else labelled.filter(F.xxhash64("url") < F.lit(int(-2**63 + share * (2**64 - 1))))
    picked = picked.groupBy("url", "host", "suffix").agg(F.max("blocked").alias("blocked")).limit(limit)
    few = counts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = with_suffix_features(picked, counts, prior, few, fold_of(F.col("url")))
    own = lexical(F.col("url"), F.col("host"))
    names = [*own, *SUFFIX_FEATURES]
    rows = rows.select("url", "host", "suffix", "blocked", F.array(*own.values(), *SUFFIX_FEATURES).alias("x")).collect()
    rows.sort(key=lambda r: r.url)
    return UrlModel.fit(np.array([r.x for r in rows], float).reshape(len(rows), len(names)), [r.blocked for r in rows],
                        [r.suffix for r in rows], [r.host for r in rows], names)


def parsed_urls(df: DataFrame, url: str) -> DataFrame:
    """(_row, _url, host, path, suffix) of every row."""
    out = df.select(F.struct(*[df[c] for c in df.columns]).alias("_row"), df[url].alias("_url"), host_of(df[url]).alias("host"), path_of(df[url]).alias("path"))
    return out.withColumn("suffix", suffix_of(F.col("host")))


def fit_urls(parsed: DataFrame) -> tuple[UrlModel, DataFrame, float]:
    """The model, suffix counts and prior of labelled (url, host, suffix, blocked) rows."""
    labelled = parsed.filter("url is not null and blocked is not null")
    counts = suffix_counts(labelled)
    n, bad = counts.agg(F.sum("all_n"), F.sum("all_bad")).first()
    prior = bad / n if n else 0.0
    return train(labelled, counts, n or 0, prior), counts, prior


def filter_urls(pages: DataFrame, url: str = "url", rules=RULES, labelled: DataFrame | None = None) -> DataFrame:
    """(_row, host, path, rule, verdict, score): rule verdicts first, else the trees'.

    labelled: (url, blocked 0/1); without it the rules label the URLs they fit.
    score is null where a rule decides."""
    ship(pages.sparkSession)
    parsed = parsed_urls(pages, url).withColumn("_m", matched_rule(F.col("host"), F.col("path"), rules))
    if labelled is None:
        known = parsed.filter("_m is not null").select(F.col("_url").alias("url"), "host", "suffix", (F.col("_m.verdict") == "block").cast("long").alias("blocked"))
    else:
        known = parsed_urls(labelled, "url").select(F.col("_url").alias("url"), "host", "suffix", F.col("_row.blocked").cast("long").alias("blocked"))
    model, counts, prior = fit_urls(known)
    trees = model.trees

    @F.pandas_udf("double")
    def score(x):
        import pandas as pd
        out = pd.Series(np.full(len(x), np.nan))
        todo = np.flatnonzero(x.notna())
        if len(todo):
            out.iloc[todo] = trees.predict(np.stack(x.iloc[todo].to_numpy()))
        return out.astype(object).where(out.notna(), None)

    few = counts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = with_suffix_features(parsed, counts, prior, few)
    own = lexical(F.col("_url"), F.col("host"))
    scored = rows.withColumn("score", score(F.when(F.col("_m").isNull(), F.array(*own.values(), *SUFFIX_FEATURES))))
    return scored.select(
        "_row", "host", "path", F.col("_m.rule").alias("rule"),
        F.coalesce(F.col("_m.verdict"), F.when(F.col("score") >= F.lit(model.threshold), "block").otherwise("allow")).alias("verdict"), "score")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages).select(F.col("_row.page_id").alias("page_id"), "host", "path", "rule", "verdict", "score")
