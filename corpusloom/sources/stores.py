"""Saved state: tables of one row per key that are updated by merging rows into them."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusloom.operators.registry import merged


@dataclass
class Store:
    """A table of one row per key below a shared path, in hash buckets of the key.

    A save writes only the buckets that its rows fall into, as a new folder, and then
    one small file that names the folder of every bucket: the new version.  That file
    appears whole or not at all, so readers see the version before or after a save,
    and a save that fails changes nothing.  Of two saves at once the second to finish
    fails (its file would have the same version) and has to be repeated.  Folders of
    earlier versions stay; ``rows(version)`` reads them.  A null key is a key."""

    spark: SparkSession
    path: str
    key: str
    schema: StructType

    @property
    def versions(self) -> str:
        return f"{self.path.rstrip('/')}/versions"

    def create(self, buckets: int = 64) -> Store:
        """Begin an empty store; an error if there is one.  A bucket is what one save
        rewrites at least, so there should be one per some 100 MB of rows expected."""
        self._publish(0, [(b, None) for b in range(buckets)])
        return self

    def _publish(self, version: int, folders: list[tuple[int, str | None]]) -> None:
        rows = self.spark.createDataFrame(folders, "bucket int, folder string")
        rows.coalesce(1).write.mode("errorifexists").json(f"{self.versions}/version={version}")

    def folders(self, version: int | None = None) -> tuple[int, dict[int, str | None]]:
        """(version, bucket -> folder) of the last version, or of a given one; a row per bucket."""
        known = self.spark.read.schema("bucket int, folder string, version int").option("basePath", self.versions).json(self.versions)
        at = known.agg(F.max("version")).first()[0] if version is None else version
        found = {r.bucket: r.folder for r in known.filter(F.col("version") == at).collect()}
        if not found:
            raise ValueError(f"no version {at} below {self.path}")
        return at, found

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(buckets)).cast("int")

    def _read(self, folders: dict[int, str | None], wanted: set[int] | None = None) -> DataFrame:
        at = [f"{f}/_bucket={b}" for b, f in sorted(folders.items()) if f and (wanted is None or b in wanted)]
        return self.spark.read.schema(self.schema).parquet(*at) if at else self.spark.createDataFrame([], self.schema)

    def rows(self, version: int | None = None) -> DataFrame:
        """All rows of the last version, or of a given one."""
        return self._read(self.folders(version)[1])

    def get(self, keys: list) -> DataFrame:
        """The rows of some keys, read from their buckets alone."""
        _, folders = self.folders()
        asked = self.spark.createDataFrame([(k,) for k in keys], StructType([self.schema[self.key]]))
        wanted = {r[0] for r in asked.select(self._bucket(len(folders))).distinct().collect()}
        same = F.lit(False)
        for k in keys:
            same = same | F.col(self.key).eqNullSafe(F.lit(k))
        return self._read(folders, wanted).filter(same)

    def save(self, changes: DataFrame, combine: Callable[[DataFrame], DataFrame]) -> int:
        """Merge rows into the store and give the new version.

        combine makes one row per key out of the saved and the new rows, and must give
        the same for rows that were combined before as for all rows at once (sums,
        extremes, last values given).  Rows without a change keep the version."""
        version, folders = self.folders()
        new = changes.select(*self.schema.names)
        touched = {r[0] for r in new.select(self._bucket(len(folders)).alias("b")).distinct().collect()}  # as many as there are buckets at most
        if not touched:
            return version
        at = f"{self.path.rstrip('/')}/rows/{version + 1:08d}-{uuid.uuid4().hex}"
        rows = combine(self._read(folders, touched).unionByName(new)).select(*[F.col(f.name).cast(f.dataType) for f in self.schema])
        rows.withColumn("_bucket", self._bucket(len(folders))).repartition("_bucket").write.partitionBy("_bucket").parquet(at)
        self._publish(version + 1, [(b, at if b in touched else f) for b, f in sorted(folders.items())])
        return version + 1


def last_given(key: str, at: str, columns: list[str]) -> Callable[[DataFrame], DataFrame]:
    """A combine for partial updates: the last value given of each column (a null changes
    nothing), and the time of the last update.  Changes of a key at one time have no order."""
    return lambda rows: merged(rows, key, at, columns)


def registry_rows(rows: DataFrame) -> DataFrame:
    """A combine for task registries (task_id, task_type, topic, status, related, created_at,
    updated_at): the last of each, all related ids once in order of appearance, the first
    time of creation.  An event is a row whose two times are equal; those of a task must
    be saved in the order of their times."""
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("updated_at"))).alias(c) for c in ("task_type", "topic", "status")]
    ids = F.array_sort(F.collect_list(F.when(F.col("related").isNotNull(), F.struct("updated_at", "related"))))
    return rows.groupBy("task_id").agg(*last, F.array_distinct(F.flatten(F.transform(ids, lambda x: x["related"]))).alias("related"),
                                       F.min("created_at").alias("created_at"), F.max("updated_at").alias("updated_at"))
