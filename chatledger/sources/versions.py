"""Tables that are brought up to date key by key, in versions that appear at once.

A version writes the new rows of the chats it touches, and nothing else, to folders of its own number:

* ``<table>/version=V/bucket=B``: all rows of the touched chats of a bucket
* ``touched/version=V/bucket=B``: the touched chats themselves, also those that have lost all rows
* ``manifest/version=V``: which versions hold the rows of each bucket; written last

A reader takes the newest manifest that is complete (its ``_SUCCESS`` marker is there) and of every chat the rows of the
latest listed version that touched it. A version that broke off before its manifest is never seen, and running it again
replaces its folders. A bucket with more than ``MOST_DELTAS`` listed versions is written anew as a whole, so that reading
stays cheap and writing follows the touched chats, not the size of their buckets. The last ``KEEP`` manifests stay
readable; folders that none of them lists are deleted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatledger.plans.materialize import cut_lineage

#: Versions that may hold the rows of a bucket before it is written anew.
MOST_DELTAS = 8

#: Manifests that stay readable.
KEEP = 3

OFFSETS = "partition int, from_offset bigint, to_offset bigint"


@dataclass(frozen=True)
class Versions:
    """Tables below ``root``; ``tables`` names each with its column that holds the chat. A manifest has at most
    ``most_deltas`` + 1 rows for every bucket, so it may come to the driver and be broadcast."""

    spark: SparkSession
    root: str
    tables: dict[str, str]
    most_deltas: int = MOST_DELTAS
    keep: int = KEEP

    def _files(self, folder: str):
        """The Hadoop file system of the tables and a folder's path in it."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{folder}".rstrip("/"))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def remove(self, folder: str) -> None:
        """Delete a folder below the root, if it is there."""
        files, path = self._files(folder)
        files.delete(path, True)

    def _numbers(self, folder: str, complete: bool = False) -> list[int]:
        """The versions that have a subfolder here, ascending; ``complete``: with a success marker."""
        files, path = self._files(folder)
        if not files.exists(path):
            return []
        found = []
        for status in files.listStatus(path):
            name = status.getPath().getName()
            marker = self.spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
            if name.startswith("version=") and (not complete or files.exists(marker)):
                found.append(int(name.removeprefix("version=")))
        return sorted(found)

    def finished(self, upto: int | None = None) -> int:
        """The last complete version (up to a given one), -1 before the first."""
        return max((v for v in self._numbers("manifest", complete=True) if upto is None or v <= upto), default=-1)

    def applied(self, upto: int) -> DataFrame:
        """What ``applied`` held in the last complete version up to ``upto``."""
        last = self.finished(upto)
        if last < 0:
            return self.spark.createDataFrame([], OFFSETS)
        return self.spark.read.schema(OFFSETS).parquet(f"{self.root}/applied/version={last}")

    def _manifest(self, version: int) -> DataFrame:
        """bucket, version: where the rows of each bucket are."""
        if version < 0:
            return self.spark.createDataFrame([], "bucket int, version bigint")
        return self.spark.read.parquet(f"{self.root}/manifest/version={version}").select(
            "bucket", F.col("holds").alias("version"))

    def _part(self, name: str, manifest: DataFrame, upto: int) -> DataFrame | None:
        """The listed folders of a table, or None if it has none at all yet. Folders after version ``upto``, which may be
        replaced meanwhile, are not looked into."""
        try:
            rows = self.spark.read.parquet(f"{self.root}/{name}")
        except AnalysisException as error:
            if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return None
        rows = rows.where(F.col("version") <= upto).withColumn("version", F.col("version").cast("bigint"))
        return rows.join(F.broadcast(manifest), ["bucket", "version"])

    def _rows(self, name: str, manifest: DataFrame, upto: int) -> DataFrame | None:
        """The rows of a table, with ``bucket``."""
        rows, touched = self._part(name, manifest, upto), self._part("touched", manifest, upto)
        if rows is None or touched is None:
            return None
        latest = touched.groupBy("chat_id").agg(F.max("version").alias("latest_")).withColumnRenamed(
            "chat_id", self.tables[name])
        return rows.join(latest, self.tables[name]).where("version = latest_").drop("version", "latest_")

    def read(self, name: str, version: int | None = None) -> DataFrame | None:
        """A table as of the newest complete version, or the newest up to ``version``; None before it has any rows."""
        last = self.finished(version)
        rows = self._rows(name, self._manifest(last), last)
        return None if rows is None else rows.drop("bucket")

    def commit(self, version: int, touched: DataFrame, tables: dict[str, DataFrame]) -> None:
        """Write a version: the rows (with ``bucket``) of the touched chats (``chat_id``, ``bucket``)."""
        base = self.finished(version - 1)
        manifest = cut_lineage(self._manifest(base))
        changed = touched.select("bucket").distinct()
        full = manifest.join(F.broadcast(changed), "bucket", "left_semi").groupBy("bucket").agg(
            F.count(F.lit(1)).alias("n")).where(F.col("n") >= self.most_deltas).select("bucket")
        full = cut_lineage(full)
        some_full = not full.isEmpty()
        listed = touched
        if some_full:
            inside = manifest.join(F.broadcast(full), "bucket", "left_semi")
            before = self._part("touched", inside, base)
            listed = touched.unionByName(before.select("chat_id", "bucket")).distinct()
        for name, rows in tables.items():
            chat = self.tables[name]
            old = self._rows(name, inside, base) if some_full else None
            if old is not None:
                mine = touched.select(F.col("chat_id").alias(chat))
                rows = rows.unionByName(old.join(mine, chat, "left_anti"))
            rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/{name}/version={version}")
        listed.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/touched/version={version}")
        kept = manifest.join(F.broadcast(full), "bucket", "left_anti") if some_full else manifest
        rows = kept.unionByName(changed.withColumn("version", F.lit(version).cast("bigint")))
        rows.select("bucket", F.col("version").alias("holds")).coalesce(1).write.mode("overwrite").parquet(
            f"{self.root}/manifest/version={version}")
        self._retain()

    def _retain(self) -> None:
        """Delete the manifests before the last ``keep``, and every version's folders of buckets none of these lists."""
        complete = self._numbers("manifest", complete=True)
        kept = complete[-self.keep:]
        if kept == complete:
            return
        listed = {(r.bucket, r.version) for v in kept for r in self._manifest(v).collect()}
        for old in complete[: -self.keep]:
            self.remove(f"manifest/version={old}")
        for name in [*self.tables, "touched"]:
            for version in self._numbers(name):
                if version > kept[-1]:  # being written
                    continue
                files, path = self._files(f"{name}/version={version}")
                names = [s.getPath().getName() for s in files.listStatus(path)]
                parts = [n for n in names if n.startswith("bucket=")]
                gone = [n for n in parts if (int(n.removeprefix("bucket=")), version) not in listed]
                if len(gone) == len(parts):
                    self.remove(f"{name}/version={version}")
                else:
                    for n in gone:
                        self.remove(f"{name}/version={version}/{n}")
        for version in self._numbers("applied"):
            if version < kept[0]:
                self.remove(f"applied/version={version}")
