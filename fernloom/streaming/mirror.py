"""An exactly-once mirror of a change feed, and the feed of the mirror's own changes.

A change is ``(key, rev, deleted, columns...)``; of each key the highest revision counts, whatever the
order of arrival.  The mirror is a set of buckets (hash of the key), each a Parquet folder of its
own, deleted keys kept as tombstones so that an older change cannot bring them back.  A batch
rewrites the buckets it touches and then writes a manifest with its number, which makes it
visible: a batch that died half-way leaves only files no manifest names, and one that comes again
after its manifest is known by its number and changes nothing.

Readers take a manifest's version, so a reader and a writer do not disturb each other; ``changes``
gives what a version has beyond a revision, tombstones included, to refresh an index by.

Defined cases: changes without a key or revision are not taken; equal revisions of a key are one
change (the greatest row); an empty batch is recorded and changes no bucket.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Mirror:
    """A mirrored table in a folder that all executors share.

    ``columns`` is the DDL of the rows without ``rev`` and ``deleted``; ``key`` is one of its columns.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, columns: str, buckets: int = 32):
        self.spark, self.path, self.key = spark, path, key
        self.schema = f"{columns}, rev long, deleted boolean"
        if not self._versions():
            self._commit({"version": 0, "batch": -1, "rev": None, "buckets": buckets, "parts": {}})

    def _versions(self) -> list[dict]:
        """All manifests, one line each; a folder without any is new."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest-*")
        if not self.spark._jvm.org.apache.hadoop.fs.FileSystem.get(folder.toUri(), self.spark._jsc.hadoopConfiguration()).globStatus(folder):
            return []
        return [json.loads(r["value"]) for r in self.spark.read.text(f"{self.path}/manifest-*").collect()]

    @property
    def manifest(self) -> dict:
        return max(self._versions(), key=lambda m: m["version"])

    def _commit(self, manifest: dict) -> None:
        self.spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{self.path}/manifest-{manifest['version']:08d}")

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(buckets)).cast("int")

    def _stored(self, parts: list[str]) -> DataFrame:
        reader = self.spark.read.schema(self.schema)
        return reader.parquet(*[f"{self.path}/{p}" for p in parts]) if parts else self.spark.createDataFrame([], self.schema)

    def apply(self, batch: DataFrame, number: int) -> bool:
        """Take in batch ``number``; false if it is in already."""
        old = self.manifest
        if number <= old["batch"]:
            return False
        names = [f.name for f in self._stored([]).schema.fields]
        new = batch.where(F.col(self.key).isNotNull() & F.col("rev").isNotNull()).select(*[c if c != "deleted" else F.coalesce("deleted", F.lit(False)).alias("deleted") for c in names])
        touched = sorted(r[0] for r in new.select(self._bucket(old["buckets"])).distinct().collect())  # at most the number of buckets
        parts = dict(old["parts"])
        top = old["rev"]
        if touched:
            both = self._stored([parts[str(b)] for b in touched if str(b) in parts]).unionByName(new)
            rest = [c for c in names if c not in (self.key, "rev")]
            last = both.groupBy(self.key).agg(F.max(F.struct("rev", *rest)).alias("last")).select(self.key, *[F.col(f"last.{c}").alias(c) for c in ("rev", *rest)]).select(names)
            folder = f"batch-{number:08d}-{uuid.uuid4().hex}"
            last.withColumn("bucket", self._bucket(old["buckets"])).repartition(len(touched), "bucket").write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
            parts |= {str(b): f"{folder}/bucket={b}" for b in touched}
            top = max(x for x in (top, new.agg(F.max("rev")).first()[0]) if x is not None)
        self._commit({**old, "version": old["version"] + 1, "batch": number, "rev": top, "parts": parts})
        return True

    def all_rows(self, version: int | None = None) -> DataFrame:
        """Rows and tombstones, of the newest or an older version."""
        m = self.manifest if version is None else next(x for x in self._versions() if x["version"] == version)
        return self._stored(sorted(m["parts"].values()))

    def rows(self, version: int | None = None) -> DataFrame:
        """The mirrored table."""
        return self.all_rows(version).where("NOT deleted").drop("deleted", "rev")

    def changes(self, rev: int) -> DataFrame:
        """Rows and tombstones above a revision: what a reader that stands there has to take in."""
        return self.all_rows().where(F.col("rev") > rev)

    def follow(self, changes: DataFrame, checkpoint: str, before: Callable[[DataFrame, int], None] | None = None):
        """Take in what a stream of changes has now; batches that come again after a failure are ignored.  ``before`` sees each batch first."""

        def take(batch: DataFrame, number: int) -> None:
            if before:
                before(batch, number)
            self.apply(batch, number)

        return changes.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newer_than(source: DataFrame, mark, *stamps: str) -> DataFrame:
    """Rows with a stamp above the high-water mark (all, where there is no mark yet)."""
    if mark is None:
        return source
    return source.where(F.greatest(*[F.coalesce(F.col(s), F.lit(0)) for s in stamps]) > F.lit(mark)) if len(stamps) > 1 else source.where(F.col(stamps[0]) > F.lit(mark))
