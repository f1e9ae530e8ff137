"""Repository archives (tar.gz) as a Spark source, read in one pass each."""

from __future__ import annotations

import gzip
import io
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Files of a repository, and bytes of a file with text.
MOST_FILES = 12_000
MOST_BYTES = 512 * 1024
ENDING = ".tar.gz"


class Archive(InputPartition):
    def __init__(self, uri: str):
        super().__init__(uri)


def _at(uri: str):
    """The file system of a folder or file and the path in it; a path without a scheme is local."""
    return fs.FileSystem.from_uri(uri if ":" in uri.split("/")[0] else f"file://{uri}")


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.at = options["path"]
        self.most_files, self.most_bytes = int(options.get("maxfiles", MOST_FILES)), int(options.get("maxbytes", MOST_BYTES))
        self.texts = options.get("texts", "true").lower() == "true"
        if self.most_files < 1 or self.most_bytes < 1:
            raise ValueError("limits of archives must be positive")

    def partitions(self) -> list[Archive]:
        system, path = _at(self.at)
        if system.get_file_info(path).type == fs.FileType.File:
            return [Archive(self.at)]
        root = self.at.rstrip("/")
        found = [i.path for i in system.get_file_info(fs.FileSelector(path, recursive=True)) if i.is_file and i.path.endswith(ENDING)]
        return [Archive(root + f[len(path.rstrip("/")):]) for f in sorted(found)]

    def read(self, part: Archive) -> Iterator[tuple]:
        system, path = _at(part.value)
        name, files = path.rsplit("/", 1)[-1].removesuffix(ENDING), 0
        # gzip raises an error where a stream ends early, which the archive reader by itself takes for the end
        with system.open_input_stream(path, compression=None) as raw, gzip.GzipFile(fileobj=raw) as plain, tarfile.open(fileobj=plain, mode="r|") as tar:
            for member in tar:
                inner = member.name.partition("/")[2]
                if not member.isreg() or not inner:
                    continue
                files += 1
                if files > self.most_files:
                    raise ValueError(f"{part.value} holds more than {self.most_files} files")
                small = self.texts and member.size <= self.most_bytes
                yield name, files, inner, member.size, tar.extractfile(member).read().decode("utf-8", "replace") if small else None
                tar.members.clear()  # a stream is not read twice; its headers need not stay
            while plain.read(1 << 20):  # to the checksum
                pass


class ArchiveSource(DataSource):
    """``spark.read.format("archive").load(folder or file)``: (archive, seq, path, size, text), a task an archive.

    Paths are those below an archive's first folder, ``seq`` is the place in it; folders, links and files outside that folder are none. Files of
    more than ``maxBytes`` have no text and are skipped unread, with ``texts`` false all are; a file is in memory by itself. Bytes that are no
    UTF-8 become replacement characters. An archive of more than ``maxFiles`` files is an error, as is a broken one; none is ever cut.
    """

    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return "archive string, seq int, path string, size bigint, text string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader({k.lower(): v for k, v in self.options.items()})


def read(spark: SparkSession, at: str, **options) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("archive").options(**options).load(at)


def wanted(found: DataFrame, listing: DataFrame) -> DataFrame:
    """A5: (archive, path, size, text): the texts of the files that ``listing`` (archive, path, size) names; of repeated paths the last in the archive counts.

    A listed file that its archive lacks is an error, as is one larger than listed; smaller ones and files that nobody listed are none. Errors are raised by the task
    that finds them. A null size sets no limit; a listing's repeated rows count once, with the least size.
    """
    last = found.groupBy("archive", "path").agg(F.max_by(F.struct("size", "text"), "seq").alias("f"))
    rows = listing.where("archive is not null and path is not null").groupBy("archive", "path").agg(F.min("size").alias("listed")).join(last, ["archive", "path"], "left")
    name = F.concat_ws("/", "archive", "path")
    missing = F.raise_error(F.concat(F.lit("archive has no listed file "), name)).cast("bigint")
    larger = F.raise_error(F.concat(F.lit("archive's file is larger than listed: "), name)).cast("bigint")
    size = F.when(F.col("f").isNull(), missing).when(F.col("f.size") > F.col("listed"), larger).otherwise(F.col("f.size"))
    return rows.select("archive", "path", size.alias("size"), F.col("f.text").alias("text"))


def write(files: DataFrame, at: str, parts: int) -> None:
    """Archives ``at/<archive>.tar.gz`` of rows (archive, path, text), by path; null texts are empty, rows without archive or path are left out.

    Rows are dealt to ``parts`` tasks by archive. Each writes one archive after the other, a file at a time, under another name until it is
    whole, so a task that runs again replaces what it wrote.
    """
    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = _at(at)
        system.create_dir(root, recursive=True)
        now = raw = tar = None

        def close():
            if tar:
                tar.close()
                raw.close()
                system.move(f"{root}/{now}.part", f"{root}/{now}{ENDING}")

        for batch in batches:
            for archive, path, text in zip(batch["archive"], batch["path"], batch["text"]):
                if archive != now:
                    close()
                    now, raw = archive, system.open_output_stream(f"{root}/{archive}.part", compression=None)
                    tar = tarfile.open(fileobj=raw, mode="w|gz")
                data = (text or "").encode()
                info = tarfile.TarInfo(f"{archive}/{path}")
                info.size = len(data)
                tar.addfile(info, io.BytesIO(data))
                tar.members.clear()
        close()
        yield pd.DataFrame({"archive": [now]})

    rows = files.select("archive", "path", F.coalesce("text", F.lit("")).alias("text")).where("archive is not null and path <> ''")
    rows.repartition(parts, "archive").sortWithinPartitions("archive", "path").mapInPandas(put, "archive string").write.format("noop").mode("overwrite").save()
