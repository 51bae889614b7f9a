"""Scans over the rows of a key in order, however many one key has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.sources.tables import cut

#: Rows of a key that one task may hold; a key with more is scanned in chunks.
HOT = 1_000_000


class Ordered:
    """Running sums, previous rows and tails of the rows of each key, in order.

    If no key has more than ``hot`` rows these are windows.  Otherwise the rows are
    dealt by ranges of (key, order), so that a key's rows lie in as many chunks as they
    need; each chunk is summed up, the sums are carried along the chunks of a key (a row
    per key and chunk), and every row adds its chunk's carry to its place in the chunk.
    No task holds more than a chunk of a key.  Ties in the order have no defined order,
    as in a window; a null key is a key."""

    def __init__(self, df: DataFrame, key: str, order: str | list[str], hot: int | None = None):
        self.key, self.order = key, [order] if isinstance(order, str) else list(order)
        limit = HOT if hot is None else hot
        sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("n")).first()
        self.chunks = (sizes.most or 0) > limit
        if self.chunks:
            parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-sizes.n // max(limit, 1)))
            df = cut(df.repartitionByRange(min(parts, 100_000), key, *self.order).withColumn("_chunk", F.spark_partition_id()))
        self.rows = df

    @property
    def window(self):
        return W.partitionBy(self.key, *["_chunk"] * self.chunks).orderBy(*self.order)

    def _carry(self, chunks: DataFrame, carried: dict[str, Column]) -> None:
        """Join each chunk's carries, made by windows over the chunks of its key, to its rows."""
        right = chunks.select(F.col(self.key).alias("_carry_key"), F.col("_chunk").alias("_carry_chunk"), *[c.alias(n) for n, c in carried.items()])
        same = self.rows[self.key].eqNullSafe(right["_carry_key"]) & (self.rows["_chunk"] == right["_carry_chunk"])
        self.rows = self.rows.join(right, same).drop("_carry_key", "_carry_chunk")

    def running(self, **values: Column) -> Ordered:
        """Add the sum of each value up to each row, and that of all of the key's rows as ``<name>_total``."""
        upto, all_ = self.window.rowsBetween(W.unboundedPreceding, 0), W.partitionBy(self.key)
        self.rows = self.rows.withColumns({f"_v_{n}": v for n, v in values.items()})
        if not self.chunks:
            out = {n: F.sum(f"_v_{n}").over(upto) for n in values} | {f"{n}_total": F.sum(f"_v_{n}").over(all_) for n in values}
            self.rows = self.rows.withColumns(out)
        else:
            sums = self.rows.groupBy(self.key, "_chunk").agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in values])
            before = all_.orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
            carried = {f"_c_{n}": F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)) for n in values} | {f"{n}_total": F.sum(f"_s_{n}").over(all_) for n in values}
            self._carry(sums, carried)
            self.rows = self.rows.withColumns({n: F.sum(f"_v_{n}").over(upto) + F.col(f"_c_{n}") for n in values}).drop(*[f"_c_{n}" for n in values])
        self.rows = self.rows.drop(*[f"_v_{n}" for n in values])
        return self

    def previous(self, name: str, *columns: str) -> Ordered:
        """Add the struct of some columns of the row before as ``name``; null for a key's first row."""
        here = F.lag(F.struct(*columns)).over(self.window)
        if self.chunks:
            last = self.rows.groupBy(self.key, "_chunk").agg(F.max_by(F.struct(*columns), F.struct(*self.order)).alias("_last"))
            self._carry(last, {"_before": F.lag("_last").over(W.partitionBy(self.key).orderBy("_chunk"))})
            here = F.coalesce(here, F.col("_before"))
        self.rows = self.rows.withColumn(name, here).drop("_before")
        return self

    def latest(self, name: str, value: Column) -> Ordered:
        """Add the last value up to each row that is not null."""
        self.rows = self.rows.withColumn("_value", value)
        here = F.last("_value", ignorenulls=True).over(self.window.rowsBetween(W.unboundedPreceding, 0))
        if self.chunks:
            last = self.rows.groupBy(self.key, "_chunk").agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.struct(*self.order))).alias("_last"))
            self._carry(last, {"_before": F.last("_last", ignorenulls=True).over(W.partitionBy(self.key).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1))})
            here = F.coalesce(here, F.col("_before"))
        self.rows = self.rows.withColumn(name, here).drop("_value", "_before")
        return self

    def tail(self, name: str, column: str, keep: int) -> Ordered:
        """Add the values of the last ``keep`` rows up to each row, oldest first, without nulls."""
        here = F.collect_list(F.struct(F.col(column).alias("v"))).over(self.window.rowsBetween(-(keep - 1), 0))
        if self.chunks:
            back = W.partitionBy(self.key, "_chunk").orderBy(*[F.desc(c) for c in self.order])
            ends = self.rows.withColumn("_n", F.row_number().over(back)).filter(F.col("_n") < keep)
            ends = ends.groupBy(self.key, "_chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("_n")).alias("at"), F.struct(F.col(column).alias("v")).alias("x")))), lambda e: e["x"]).alias("_ends"))
            chunks = self.rows.select(self.key, "_chunk").distinct()
            same = chunks[self.key].eqNullSafe(ends[self.key]) & (chunks["_chunk"] == ends["_chunk"])
            chunks = chunks.join(ends, same, "left").select(chunks[self.key], chunks["_chunk"], "_ends")
            before = W.partitionBy(self.key).orderBy("_chunk").rowsBetween(-max(keep - 1, 1), -1)
            self._carry(chunks, {"_before": F.flatten(F.collect_list("_ends").over(before))})
            here = F.concat(F.col("_before"), here)
        last = F.slice(F.col("_all"), F.greatest(F.size("_all") - keep + 1, F.lit(1)), keep)
        self.rows = self.rows.withColumn("_all", here).withColumn(name, F.transform(F.filter(last, lambda x: x["v"].isNotNull()), lambda x: x["v"])).drop("_all", "_before")
        return self

    def done(self) -> DataFrame:
        return self.rows.drop("_chunk")


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, tie: str, name: str = "found", hot: int | None = None) -> DataFrame:
    """left with ``name``: the struct of the last row of right with the same key and a
    time not after that of the left row, null if there is none; of equal times the row
    with the larger ``tie`` counts.  Both have key and at.

    The two tables are put in one order and scanned once, so nothing is gathered per key
    and a hot key is scanned in chunks.  A null key or time finds nothing."""
    mine = left.select(F.col(key).alias("_key"), F.col(at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[tie].dataType).alias("_tie"),
                       F.struct(*left.columns).alias("_left"), F.lit(None).cast(right.schema).alias("_right"))
    other = right.filter(F.col(key).isNotNull() & F.col(at).isNotNull()).select(
        F.col(key).alias("_key"), F.col(at).alias("_at"), F.lit(0).alias("_side"), F.col(tie).alias("_tie"), F.lit(None).cast(left.schema).alias("_left"), F.struct(*right.columns).alias("_right"))
    rows = Ordered(mine.unionByName(other), "_key", ["_at", "_side", "_tie"], hot).latest(name, F.col("_right")).done()
    return rows.filter("_side = 1").select("_left.*", name)


def ranked(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """df with the place of each row by ascending values of the order, from 1; it must tell
    all rows apart.

    Rows are dealt by ranges of the order and numbered in each; only the ranges' counts
    are summed in one place, so no task numbers all rows."""
    names = [f"_o{i}" for i in range(len(order))]
    rows = df.withColumns(dict(zip(names, order)))
    rows = cut(rows.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *names).withColumn("_chunk", F.spark_partition_id()))
    counts = rows.groupBy("_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    place = F.row_number().over(W.partitionBy("_chunk").orderBy(*names))
    return rows.join(before, "_chunk").withColumn(name, (place + F.col("_before")).cast("long")).drop("_chunk", "_before", *names)

