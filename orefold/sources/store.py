"""Content-addressed snapshots with optimistic commits.

A snapshot is a manifest of (path, sha); a text is stored once, whatever number of snapshots hold it. A branch is a row of
numbered heads: a commit writes texts and a manifest that nobody refers to yet, then puts the next number, which only one writer can.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orefold.functions import paths


class Conflict(Exception):
    """The branch has moved since the base of a commit."""


def digest(files: DataFrame) -> str:
    """The id of a set of rows (path, sha) in any order: a hash of their number and of the sums of parts of their hashes."""
    h = F.sha2(F.concat_ws("\0", "path", "sha"), 256)
    part = lambda i: F.sum(F.conv(F.substring(h, 15 * i + 1, 15), 16, 10).cast("decimal(38,0)"))
    row = files.agg(F.count("*"), *[F.coalesce(part(i), F.lit(0)) for i in range(4)]).first()
    return hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()


class Store:
    """Snapshots below a folder that driver and executors share.

    ``blobs`` hold (bucket, sha, text), ``manifests/<id>`` (path, sha), ``heads/<branch>/<number>`` the id of a snapshot. Names appear whole: a head is
    written aside and then linked or renamed to a name that must not exist, which local folders and HDFS do in one step. Stores without such a
    step (plain object stores) need their own ``_claim``.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _exists(self, at: str) -> bool:
        return self._fs.exists(self._path(f"{self.root}/{at}"))

    def _names(self, at: str) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/{at}"))] if self._exists(at) else []

    def _claim(self, at: str, said: str) -> bool:
        """Puts a small file under a name unless there is one; False if there is."""
        aside = f"{self.root}/aside/{uuid.uuid4().hex}"
        out = self._fs.create(self._path(aside), False)
        out.write(bytearray(said.encode()))
        out.close()
        target = self._path(f"{self.root}/{at}")
        self._fs.mkdirs(target.getParent())
        if self._fs.getScheme() == "file":
            try:
                os.link(self._path(aside).toUri().getPath(), target.toUri().getPath())
                return True
            except FileExistsError:
                return False
            finally:
                self._fs.delete(self._path(aside), False)
        try:
            none = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.NONE
            context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration())
            options = self.spark.sparkContext._gateway.new_array(none.getClass(), 1)
            options[0] = none
            context.rename(self._path(aside), target, options)
            return True
        except Exception:
            if self._fs.exists(target):
                return False
            raise

    # ------------------------------------------------------------------ snapshots

    def put(self, files: DataFrame) -> str:
        """Stores a snapshot of rows (path, text) and returns its id; texts and manifests that are there already are not written again.

        Paths are normalized (B1). A null text is an empty one; of rows with one path the greatest text counts; rows without a
        path are left out. Without rows the snapshot is empty. Two writers of one snapshot write the same rows.
        """
        # the texts are read twice: for the manifest, and for the blobs that are missing
        p = paths.normalize(F.col("path"))
        rows = files.select(p.alias("path"), F.coalesce("text", F.lit("")).alias("text")).where("path <> ''")
        sha = F.sha2(F.col("text").cast("binary"), 256).alias("sha")
        manifest = rows.groupBy("path").agg(F.max(F.struct(F.col("text").alias("t"), sha)).alias("m")).select("path", "m.sha") if not _unique(rows) else rows.select("path", sha)
        aside = f"{self.root}/aside/{uuid.uuid4().hex}"
        manifest.write.parquet(aside)
        known = self.spark.read.schema("path string, sha string").parquet(aside)
        name = digest(known)
        if not self._exists(f"manifests/{name}/_SUCCESS"):
            wanted = known.select("sha").distinct()
            if self._exists("blobs"):
                wanted = wanted.join(self._blobs().select("sha"), "sha", "left_anti")
            new = rows.select(sha, "text").join(wanted, "sha", "left_semi").dropDuplicates(["sha"]).withColumn("bucket", F.substring("sha", 1, 2))
            new.write.mode("append").partitionBy("bucket").parquet(f"{self.root}/blobs")
            self._fs.mkdirs(self._path(f"{self.root}/manifests"))
            self._fs.rename(self._path(aside), self._path(f"{self.root}/manifests/{name}"))
        if self._fs.exists(self._path(aside)):
            self._fs.delete(self._path(aside), True)
        return name

    def _blobs(self) -> DataFrame:
        return self.spark.read.schema("sha string, text string, bucket string").parquet(f"{self.root}/blobs")

    def manifest(self, snapshot: str) -> DataFrame:
        """(path, sha) of a snapshot."""
        return self.spark.read.schema("path string, sha string").parquet(f"{self.root}/manifests/{snapshot}")

    def files(self, snapshot: str) -> DataFrame:
        """(path, sha, text) of a snapshot. Blobs that two writers stored at once count once."""
        blobs = self._blobs().select("sha", "text").dropDuplicates(["sha"])
        return self.manifest(snapshot).join(blobs, "sha").select("path", "sha", "text")

    # ------------------------------------------------------------------ branches

    def head(self, branch: str) -> tuple[int, str | None]:
        """The number and snapshot of a branch's newest commit; (0, None) before the first."""
        numbers = [int(n) for n in self._names(f"heads/{branch}") if n.isdigit()]
        if not numbers:
            return 0, None
        n = max(numbers)
        stream = self._fs.open(self._path(f"{self.root}/heads/{branch}/{n:010}"))
        said = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return n, json.loads(said)["snapshot"]

    def commit(self, branch: str, base: int, files: DataFrame, message: str = "") -> tuple[int, str]:
        """Makes a snapshot the branch's next commit if the newest is still ``base``; else ``Conflict``, and the branch stays as it was."""
        if self.head(branch)[0] != base:
            raise Conflict(f"{branch} is at {self.head(branch)[0]}, not {base}")
        return self._publish(branch, base, self.put(files), message)

    def _publish(self, branch: str, base: int, snapshot: str, message: str) -> tuple[int, str]:
        if not self._claim(f"heads/{branch}/{base + 1:010}", json.dumps({"snapshot": snapshot, "message": message})):
            raise Conflict(f"{branch} has moved from {base}")
        return base + 1, snapshot

    def change(self, branch: str, base: int, changes: DataFrame, message: str = "") -> tuple[int, str]:
        """Commits the newest snapshot with changes (path, text, before): a null text removes the file, ``before`` is the sha that it must have (null: it must not exist).

        A change whose file is not as it says is a ``Conflict``, as is a path that two changes name, and nothing is published. Unchanged
        texts are neither read nor written.
        """
        n, snapshot = self.head(branch)
        if n != base:
            raise Conflict(f"{branch} is at {n}, not {base}")
        old = self.manifest(snapshot) if snapshot else self.spark.createDataFrame([], "path string, sha string")
        c = changes.select(paths.normalize(F.col("path")).alias("path"), "text", "before").where("path <> ''")
        twice = c.groupBy("path").count().where("count > 1").select("path").first()
        if twice:
            raise Conflict(f"two changes of {twice.path}")
        stale = c.join(old, "path", "left").where(~F.col("before").eqNullSafe(F.col("sha"))).select("path").first()
        if stale:
            raise Conflict(f"{stale.path} is not as the change says")
        fresh = self.put(c.where("text is not null").select("path", "text"))
        rest = old.join(c.select("path"), "path", "left_anti").unionByName(self.manifest(fresh))
        aside = f"{self.root}/aside/{uuid.uuid4().hex}"
        rest.write.parquet(aside)
        name = digest(self.spark.read.schema("path string, sha string").parquet(aside))
        if self._exists(f"manifests/{name}/_SUCCESS"):
            self._fs.delete(self._path(aside), True)
        else:
            self._fs.rename(self._path(aside), self._path(f"{self.root}/manifests/{name}"))
        return self._publish(branch, base, name, message)

    def drop_unused(self, keep: int) -> list[str]:
        """Removes manifests that are in none of the newest ``keep`` commits of any branch, and returns their ids; texts stay."""
        used = set()
        for branch in self._names("heads"):
            for n in sorted((x for x in self._names(f"heads/{branch}") if x.isdigit()), reverse=True)[:keep]:
                stream = self._fs.open(self._path(f"{self.root}/heads/{branch}/{n}"))
                used.add(json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["snapshot"])
                stream.close()
        gone = sorted(set(self._names("manifests")) - used)
        for name in gone:
            self._fs.delete(self._path(f"{self.root}/manifests/{name}"), True)
        return gone


def _unique(rows: DataFrame) -> bool:
    """Whether no path stands twice; paths alone are counted."""
    return rows.groupBy("path").count().where("count > 1").isEmpty()
