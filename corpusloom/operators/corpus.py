"""Ranking and deduplication of sources and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions.text import is_thin, jaccard, normalized, overlap_score, source_quality, tokens
from corpusloom.sources.tables import discard, stored, together

SIMILAR = 0.88


def first_seen(df: DataFrame, key: str, order: str) -> DataFrame:
    """Distinct by key; the row that comes first in order stays.  Null is a key too."""
    first = df.groupBy(F.col(key).alias("_key")).agg(F.min(order).alias("_first"))
    return df.join(first, df[key].eqNullSafe(first["_key"]) & (df[order] == first["_first"])).drop("_key", "_first")


#: What the first, second and third source of a domain add to its evidence.
DIVERSITY = (0.15, 0.1, 0.05)


def evidence(sources: DataFrame, topic: str, domain: str = "domain", order: str = "ord") -> DataFrame:
    """Scores by relevance, quality and diversity; sources has title and snippet.

    Only the first three sources of a domain differ by their place.  They are found
    by a top-three per domain, which Spark limits in every task before the shuffle,
    and joined back, so no task sees a whole domain."""
    t = F.concat_ws(" ", "title", "snippet")
    place = F.row_number().over(W.partitionBy("_d").orderBy("_o"))
    first = sources.select(F.col(domain).alias("_d"), F.col(order).alias("_o")).withColumn("_n", place).filter(F.col("_n") <= len(DIVERSITY))
    rows = sources.join(first, sources[domain].eqNullSafe(first["_d"]) & (sources[order] == first["_o"]), "left").drop("_d", "_o")
    boost = F.coalesce(F.get(F.array(*[F.lit(x) for x in DIVERSITY]), F.col("_n") - 1), F.lit(0.0))
    return (rows.withColumns({
        "relevance": overlap_score(F.array_distinct(tokens(F.lit(topic))), tokens(t)), "quality": source_quality(t), "diversity": boost})
        .withColumn("evidence", F.least(F.lit(1.0), 0.5 * F.col("relevance") + 0.35 * F.col("quality") + F.col("diversity"))).drop("_n"))


def evidence_for_topics(topics: DataFrame, sources: DataFrame) -> DataFrame:
    """(topic_id, url, relevance) of every source for each topic (topic_id, topic).  Spark
    chooses the join by the measured size of the topics: a few are held by each task."""
    t = topics.select("topic_id", F.array_distinct(tokens(F.col("topic"))).alias("_words"))
    rows = sources.withColumn("_text", tokens(F.concat_ws(" ", "title", "snippet")))
    return rows.crossJoin(t).select("topic_id", "url", overlap_score(F.col("_words"), F.col("_text")).alias("relevance"))


def by_evidence(documents: DataFrame, order: str = "ord", most: int | None = None) -> DataFrame:
    """Documents by evidence, best first, none counting as 0; ties keep their order."""
    out = documents.orderBy(F.desc(F.coalesce("evidence", F.lit(0.0))), order)
    return out if most is None else out.limit(most)


def token_sets(docs: DataFrame, key: str, domain: str, text: str, chars: int = 600) -> DataFrame:
    return docs.select(F.col(key).alias("id"), F.col(domain).alias("domain"), F.array_distinct(tokens(F.substring(text, 1, chars))).alias("s"))


def similar_pairs(docs: DataFrame, key: str = "doc_id", domain: str = "source", text: str = "text", threshold: float = SIMILAR) -> DataFrame:
    """(a, b, similarity), a < b, of the documents of one domain at the threshold or above."""
    return similar_sets(token_sets(docs, key, domain, text), threshold)


def prefixes(sets: DataFrame, threshold: float = SIMILAR) -> DataFrame:
    """(id, t, n): the first n - ceil(threshold n) + 1 tokens of each set, rarest first by
    the frequency in the domain; similar sets share one of them.  Tokens of one document
    alone are left out.  t is a hash of domain and token: two of one hash can only add
    candidates, which are compared by their tokens."""
    sets = sets.filter((F.size("s") > 0) & F.col("domain").isNotNull())
    exploded = sets.select("id", F.size("s").alias("n"), F.explode(F.transform("s", lambda w: F.xxhash64("domain", w))).alias("t"))
    freq = exploded.groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    ranked = exploded.join(freq, "t").withColumn("r", F.row_number().over(W.partitionBy("id").orderBy("df", "t")))
    return ranked.filter((F.col("r") <= F.col("n") - F.ceil(threshold * F.col("n")) + 1) & (F.col("df") > 1)).select("id", "t", "n")


def verified(candidates: DataFrame, sets: DataFrame, threshold: float = SIMILAR) -> DataFrame:
    """(a, b, similarity) of the candidates (a, b) of one domain at the threshold or above."""
    left, right = (sets.select(F.col("id").alias(x), F.col("domain").alias(f"d{x}"), F.col("s").alias(f"s{x}")) for x in "ab")
    return (candidates.join(left, "a").join(right, "b").filter("da = db").withColumn("similarity", jaccard(F.col("sa"), F.col("sb")))
            .filter(F.col("similarity") >= threshold).select("a", "b", "similarity"))


def shared_prefix(some: DataFrame, others: DataFrame, threshold: float = SIMILAR) -> DataFrame:
    """(a, b), a < b, that share a token of their prefixes and are of like size."""
    a, b = some.alias("a"), others.alias("b")
    return (a.join(b, (F.col("a.t") == F.col("b.t")) & (F.col("a.id") < F.col("b.id"))
                   & (F.least("a.n", "b.n") >= threshold * F.greatest("a.n", "b.n")))
            .select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct())


#: Least candidates that are compared at once.
WAVE_PAIRS = 100_000


def verified_in_waves(some: DataFrame, others: DataFrame, sets: DataFrame, threshold: float = SIMILAR) -> list[DataFrame]:
    """verified(shared_prefix(some, others)) as (a, b), a stored table per wave.

    A candidate takes two ids on disk, but the tokens of two documents when it is
    compared; so a wave has about as many candidates as there are documents, and its
    shuffle files go before the next."""
    pairs = stored(shared_prefix(some, others, threshold))
    n = max(1, -(-pairs.count() // max(WAVE_PAIRS, sets.count())))
    mine = lambda key, i: F.pmod(F.xxhash64(key), F.lit(n)) == i
    out = []
    for i in range(n):
        here = pairs.filter(mine("a", i)) if n > 1 else pairs
        out.append(stored(verified(here, sets, threshold).select("a", "b")))
    discard(pairs)
    return out


def similar_sets(sets: DataFrame, threshold: float = SIMILAR) -> DataFrame:
    """(a, b, similarity), a < b, of (id, domain, s).

    Prefix filter: with each set ordered by token frequency, rarest first, similar sets
    share one of their first n - ceil(t n) + 1 tokens; only sets that do are compared.
    """
    prefix = prefixes(sets, threshold)
    return verified(shared_prefix(prefix, prefix, threshold), sets, threshold)


def similar_links(docs: DataFrame, key: str = "doc_id", domain: str = "source", text: str = "text", threshold: float = SIMILAR) -> DataFrame:
    """(id, class_id, n_links) of every document: documents of a domain with one token
    set are a class, named by its smallest id, and n_links counts the documents
    similar to it.  Classes are compared, so copies never make pairs; a document
    without tokens is its own class without links."""
    sets = token_sets(docs, key, domain, text).withColumn("g", F.when(F.size("s") > 0, F.md5(F.array_join(F.array_sort("s"), " "))))
    classes = sets.filter("g is not null").groupBy("domain", "g").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("n"), F.first("s").alias("s"))
    pairs = similar_sets(classes.select(F.col("class_id").alias("id"), "domain", "s"), threshold)
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    size = classes.select(F.col("class_id").alias("b"), "n")
    links = both.join(size, "b").groupBy(F.col("a").alias("class_id")).agg(F.sum("n").alias("others"))
    per = classes.join(links, "class_id", "left").select("domain", "g", "class_id", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    same = sets["domain"].eqNullSafe(per["domain"]) & (sets["g"] == per["g"])
    return sets.join(per, same, "left").select("id", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def signature(domain, title, text):
    """What two documents must have in common to be copies: domain, and title and
    beginning with case and white space apart."""
    return F.concat_ws(":", domain, normalized(title), normalized(F.substring(text, 1, 300)))


#: Documents with one prefix token that are thinned by stars before pairs are made.
CROWD = 64


def _thinned(first: DataFrame, sets: DataFrame, prefix: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(decided, open): what stars decide of documents (id, g) in crowds.

    A document that is the first open one under each of its prefix tokens and in its
    signature has no open earlier neighbour: it is kept.  It is compared with the others
    under its tokens, and those like it are dropped.  There is one such document to a
    token at most, so a round makes no more rows than there are prefix tokens.  Rounds go
    on while a crowd is left and one was dropped; decided has (id, kept, by).
    """
    spark, rounds = first.sparkSession, False
    open_, decided = first.select("id", "g"), spark.createDataFrame([], first.select("id", F.lit(True).alias("kept"), F.col("id").alias("by")).schema)
    while True:
        here = prefix.join(open_, "id")
        groups = stored(here.groupBy("t").agg(F.min("id").alias("lead"), F.count(F.lit(1)).alias("size")))
        if not groups.filter(F.col("size") > CROWD).limit(1).count():
            discard(groups)
            return decided, open_
        heads = open_.groupBy("g").agg(F.min("id").alias("head"))
        of = here.join(groups, "t").groupBy("id", "g").agg(F.bool_and(F.col("id") == F.col("lead")).alias("leads"), F.max("size").alias("size"))
        stars = of.filter(F.col("leads") & (F.col("size") > CROWD)).join(heads, "g").filter(F.col("id") == F.col("head")).select("id", "g")
        stars = stored(stars)
        found = verified_in_waves(prefix.join(stars, "id", "left_semi"), here, sets)
        near = together(found)
        same = open_.join(stars.select("g", F.col("id").alias("a")), "g").filter("id > a").select("a", F.col("id").alias("b"))
        dropped = stored(near.unionByName(same).groupBy("b").agg(F.min("a").alias("by")).select(F.col("b").alias("id"), F.lit(False).alias("kept"), "by"))
        now = stars.select("id", F.lit(True).alias("kept"), F.col("id").alias("by")).unionByName(dropped)
        decided = decided.unionByName(now)
        left = stored(open_.join(now.select("id"), "id", "left_anti"))
        discard(groups, *found, *[open_] * rounds)
        open_, rounds = left, True
        if not dropped.limit(1).count():
            return decided, open_


def _decided(docs: DataFrame, key: str, domain: str, text: str, title: str | None) -> DataFrame:
    """(id, kept, by, head, domain, g) of the first document of each beginning that is not thin."""
    name = F.col(title) if title else F.lit("")
    heads = docs.filter(~is_thin(F.col(text))).select(
        F.col(key).alias("id"), F.col(domain).alias("domain"), F.substring(text, 1, 600).alias("head"), F.md5(signature(F.col(domain), name, F.col(text))).alias("g"))
    first = stored(heads.groupBy("domain", "head", "g").agg(F.min("id").alias("id")))
    sets = token_sets(first, "id", "domain", "head")
    prefix = stored(prefixes(sets))
    decided, left = _thinned(first, sets, prefix)
    here = prefix.join(left, "id", "left_semi")
    found = verified_in_waves(here, here, sets)
    edges = together(found)
    again = left.groupBy("g").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("g")
    touched = edges.select(F.col("a").alias("id")).union(edges.select("b")).union(left.join(again, "g").select("id")).distinct()
    state = stored(left.join(touched, "id").select("id", "g", F.lit(None).cast("boolean").alias("kept"), F.lit(None).cast(first.schema["id"].dataType).alias("by")))
    while state.filter("kept is null").limit(1).count():
        near = (edges.join(state.select(F.col("id").alias("a"), F.col("kept").alias("k")), "a").groupBy(F.col("b").alias("id"))
                .agg(F.min(F.when(F.col("k"), F.col("a"))).alias("near"), F.bool_or(F.col("k").isNull()).alias("near_open")))
        same = state.groupBy("g").agg(F.min(F.when(F.col("kept"), F.col("id"))).alias("has"), F.min(F.when(F.col("kept").isNull(), F.col("id"))).alias("may"))
        like = F.least("near", F.when(F.col("has") < F.col("id"), F.col("has")))
        waits = F.coalesce("near_open", F.lit(False)) | F.coalesce(F.col("may") < F.col("id"), F.lit(False))
        open_ = F.col("kept").isNull()
        before, state = state, stored(state.join(near, "id", "left").join(same, "g", "left").select(
            "id", "g", F.when(~open_, F.col("kept")).when(like.isNotNull(), F.lit(False)).when(~waits, F.lit(True)).alias("kept"),
            F.when(~open_, F.col("by")).when(like.isNotNull(), like).when(~waits, F.col("id")).alias("by")))
        discard(before)
    discard(prefix, *found)
    lone = left.join(state.select("id"), "id", "left_anti").select("id", F.lit(True).alias("kept"), F.col("id").alias("by"))
    return first.join(decided.unionByName(state.select("id", "kept", "by")).unionByName(lone), "id")


def greedy_dedup(docs: DataFrame, key: str = "doc_id", domain: str = "source", text: str = "text", title: str | None = None) -> DataFrame:
    """(id, kept): in order of the key a document is dropped if it is thin, or has
    the signature of a kept one, or is similar to a kept one of its domain.

    That is the first independent set in key order of the neighbour graph.  Crowds of
    near copies are thinned by stars first, so they never make pairs; what is left is
    decided in rounds: a document with no undecided earlier neighbour is decided.
    A signature needs no pairs: what counts of its earlier documents is whether one is
    kept and whether one is open.  Copies of one beginning are dropped at once.
    """
    found = _decided(docs, key, domain, text, title).select("id", "kept")
    return docs.select(F.col(key).alias("id")).join(found, "id", "left").select("id", F.coalesce("kept", F.lit(False)).alias("kept"))


def star_links(docs: DataFrame, key: str = "doc_id", domain: str = "source", text: str = "text", title: str | None = None) -> DataFrame:
    """(id, representative) of every document: a kept one (greedy_dedup) that it equals in
    its beginning or signature or is similar to, itself if it is kept; null if thin.  One
    row each, however many copies there are."""
    name = F.col(title) if title else F.lit("")
    found = _decided(docs, key, domain, text, title).select(F.col("domain").alias("_domain"), F.col("head").alias("_head"), F.col("g").alias("_g"), "by")
    rows = docs.select(F.col(key).alias("id"), F.col(domain).alias("_d"), F.substring(text, 1, 600).alias("_h"), F.md5(signature(F.col(domain), name, F.col(text))).alias("_s"), is_thin(F.col(text)).alias("_thin"))
    same = rows["_d"].eqNullSafe(found["_domain"]) & rows["_h"].eqNullSafe(found["_head"]) & (rows["_s"] == found["_g"])
    return rows.join(found, same & ~F.coalesce(rows["_thin"], F.lit(True)), "left").select("id", F.col("by").alias("representative"))
