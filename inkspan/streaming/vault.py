"""Changes of a folder of notes, found by comparing what is there with what was there.

A snapshot is a table of files (path, size, mtime, hash). A poll lists the folder, joins the list with the last snapshot, opens only files that are new or
whose size or mtime differ, and commits the next snapshot together with its changes as one version: a poll that dies leaves nothing, two
pollers cannot commit the same version, and the changes of a version never change, so a reader may take them again.

- A file that is gone and one that is new and has the same bytes are a rename, if no other file of the poll has these bytes; else a delete and a create,
  which leave the same index.
- A file that changed between the list and the end of the reading keeps its old place in the snapshot (or none) and comes up again.
- A file whose bytes are the same as before is no change, whatever its mtime.
- Files above the size limit are not opened; they come without text, which removes a note.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspan import schema
from inkspan.functions.policy import MAX_BYTES
from inkspan.sources.notes import markdown_files, relative_path, title_of
from inkspan.streaming.segments import SegmentedIndex
from inkspan.streaming.versions import VersionLog

#: Files that are found by their size and time in the scan; beyond, by their least time.
FEW = 200
_SNAPSHOT = "path string, size long, mtime long, hash string"


class VaultWatcher:
    """Snapshots and changes of the notes below ``vault``, kept below ``root``."""

    def __init__(self, spark: SparkSession, vault: str, root: str, max_bytes: int = MAX_BYTES):
        self.spark, self.vault, self.root, self.max_bytes = spark, vault, root.rstrip("/"), max_bytes
        self.log = VersionLog(spark, f"{self.root}/log")

    def listing(self) -> DataFrame:
        """(path, size, mtime) of the files that are there now; Spark lists, nothing is opened."""
        files = markdown_files(self.spark, self.vault)
        return files.select(relative_path(self.vault).alias("path"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime"))

    def snapshot(self) -> DataFrame:
        """The files of the last version."""
        state = self.log.latest()[1]
        return self.spark.read.schema(_SNAPSHOT).parquet(f"{self.root}/work/{state['work']}/snapshot") if state else self.spark.createDataFrame([], _SNAPSHOT)

    def _contents(self, touched: DataFrame) -> DataFrame:
        """(path, text, hash, _size, _mtime) of the touched files as they are read."""
        files = markdown_files(self.spark, self.vault)
        pairs = touched.where(F.col("size") <= self.max_bytes).select("size", "mtime").distinct().limit(FEW + 1).collect()
        at = lambda ms: F.timestamp_millis(F.lit(ms))
        if len(pairs) <= FEW:
            wanted = reduce(Column.__or__, ((F.col("length") == p["size"]) & (F.col("modificationTime") == at(p["mtime"])) for p in pairs), F.lit(False))
        else:
            wanted = F.col("modificationTime") >= at(touched.agg(F.min("mtime")).first()[0])
        rows = files.where(wanted).where(F.col("length") <= self.max_bytes)
        rows = rows.select(relative_path(self.vault).alias("path"), F.decode("content", "UTF-8").alias("text"), F.sha2("content", 256).alias("hash"), F.col("length").alias("_size"), F.unix_millis("modificationTime").alias("_mtime"))
        return rows.join(touched.select("path"), "path", "left_semi")

    def _write(self, df: DataFrame, path: str) -> DataFrame:
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def poll(self) -> int | None:
        """Look once; the version with the changes, or None if there are none."""
        self._publish()
        version, _ = self.log.latest()
        name = uuid.uuid4().hex
        work = f"{self.root}/work/{name}"
        before = self.snapshot().select("path", F.col("size").alias("size0"), F.col("mtime").alias("mtime0"), F.col("hash").alias("hash0"))
        seen = self._write(self.listing().join(before, "path", "full"), f"{work}/seen")
        touched = seen.where("size is not null and (size0 is null or size <> size0 or mtime <> mtime0)")
        if seen.where("size is null").isEmpty() and touched.isEmpty():
            return None
        read = self._write(self._contents(touched), f"{work}/read")
        after = self.listing().select("path", F.col("size").alias("_size2"), F.col("mtime").alias("_mtime2"))
        # a file is taken if list, reading and the list behind it agree; large files are not read
        known = touched.join(read, "path", "left").join(after, "path", "left")
        large = F.col("size") > self.max_bytes
        agree = (F.col("_size2") == F.col("size")) & (F.col("_mtime2") == F.col("mtime")) & (large | ((F.col("_size") == F.col("size")) & (F.col("_mtime") == F.col("mtime"))))
        mark = F.when(large, F.concat(F.lit("large "), F.col("size"), F.lit(" "), F.col("mtime"))).otherwise(F.col("hash"))
        taken = self._write(known.where(F.coalesce(agree, F.lit(False))).select("path", "size", "mtime", mark.alias("hash"), "text", "hash0"), f"{work}/taken")
        gone = seen.where("size is null").select("path", F.col("hash0").alias("hash"))
        rows = self._changes(taken, gone, version + 1)
        same = seen.where("size is not null").join(taken.select("path"), "path", "left_anti").where("size0 is not null")
        kept = same.select("path", F.col("size0").alias("size"), F.col("mtime0").alias("mtime"), F.col("hash0").alias("hash"))
        self._write(kept.unionByName(taken.select("path", "size", "mtime", "hash")), f"{work}/snapshot")
        found = self._write(rows, f"{work}/changes").count()
        new = self.log.commit(version, {"work": name, "changes": found})
        self._publish()
        return new if found else None

    @staticmethod
    def _changes(taken: DataFrame, gone: DataFrame, stamp: int) -> DataFrame:
        """Changes as rows of the feed, all of one stamp."""
        created = taken.where("hash0 is null")
        # bytes that one new and one lost file have
        alone = lambda rows, name: rows.groupBy("hash").agg(F.count("*").alias("_n"), F.min("path").alias(name)).where("_n = 1").drop("_n")
        moved = alone(created, "path").join(alone(gone, "old_path"), "hash").select("path", "old_path")
        fresh = taken.where("hash0 is null or hash <> hash0").join(moved, "path", "left")
        kind = F.when(F.col("old_path").isNotNull(), "rename").when(F.col("hash0").isNull(), "create").otherwise("modify")
        upserts = fresh.select(kind.alias("kind"), "path", "old_path", "mtime", "text")
        lost = gone.join(moved.select(F.col("old_path").alias("path")), "path", "left_anti")
        deletes = lost.select(F.lit("delete").alias("kind"), "path", F.lit(None).cast("string").alias("old_path"), F.lit(None).cast("long").alias("mtime"), F.lit(None).cast("string").alias("text"))
        tags = F.array().cast("array<string>")
        return upserts.unionByName(deletes).select(F.lit(stamp).cast("long").alias("stamp"), "kind", "path", "old_path", "mtime", title_of("path").alias("title"), "text", tags.alias("tags"))

    def _publish(self) -> None:
        """Move the changes of committed versions to where streams look; what a poller that died has left is moved by the next."""
        Path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = Path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())
        fs.mkdirs(Path(f"{self.root}/changes"))
        for version in reversed(self.log.versions()):
            target = Path(f"{self.root}/changes/v={version}")
            if fs.exists(target):
                return  # earlier ones are there, as every poll begins with this
            fs.rename(Path(f"{self.root}/work/{self.log.read(version)['work']}/changes"), target)

    def changes(self, version: int) -> DataFrame:
        """The changes of one version."""
        return self.spark.read.schema(schema.CHANGE).parquet(f"{self.root}/changes/v={version}")

    def stream(self) -> DataFrame:
        """A streaming frame of the changes of all versions, as they come."""
        self._publish()
        return self.spark.readStream.schema(schema.CHANGE).parquet(f"{self.root}/changes")

    def feed(self, index: SegmentedIndex) -> int:
        """Apply the versions that ``index`` has not had yet, each as the batch of its number; how many."""
        self._publish()
        had = index.log.latest()[1].get("batch", -1)
        due = [v for v in self.log.versions() if v > had]
        for version in due:
            index.apply(self.changes(version), version)
        return len(due)

    def unchanged(self, ops: DataFrame) -> DataFrame:
        """Operations whose file still has the mtime of its change; a ``recheck`` for SegmentedIndex. Others come up again in a later poll."""
        now = self.listing().select("path", F.col("mtime").alias("_now"))
        return ops.join(now, "path").where(F.col("mtime") == F.col("_now")).drop("_now")
