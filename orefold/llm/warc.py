"""WARC archives through a chunked record table (operator 10)."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orefold.llm.common import Scratch
from orefold.llm.files import AtomicFile, open_store

#: Bytes of payload in a chunk row; least payload that a revisit stands for; payload bytes (about) in an archive.
CHUNK, LEAST, ARCHIVE = 1 << 18, 1000, 16 << 20
#: Parts into which the revisits of one response are dealt.
SALTS = 64
EPOCH = "1970-01-01T00:00:00Z"

CHUNKS = T.StructType([
    T.StructField("record_id", T.StringType()), T.StructField("chunk_no", T.LongType()), T.StructField("data", T.BinaryType()), T.StructField("size", T.LongType()),
    T.StructField("sha1", T.StringType()), T.StructField("last", T.BooleanType()), T.StructField("type", T.StringType()), T.StructField("uri", T.StringType()),
    T.StructField("payload_digest", T.StringType()), T.StructField("refers_to", T.StringType())])


def records(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url") -> DataFrame:
    """(id, uri, payload, bytes, digest): each row's payload as bytes."""
    uri = F.col(url_col).cast("string") if url_col in pages.columns else F.lit(None).cast("string")
    base = pages.select(F.col(id_col).cast("long").alias("id"), uri.alias("uri"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    return base.withColumn("bytes", F.octet_length("payload").cast("long")).withColumn("digest", F.sha1("payload"))


def revisits(recs: DataFrame, least: int = LEAST) -> DataFrame:
    """(id, digest, refers_to) of the records that repeat another: of equal payloads of at least ``least`` bytes the largest id is the response.

    Only ids and digests are shuffled, not payloads; digests are counted before they are joined back.
    """
    thin = recs.where((F.col("bytes") >= least) & F.col("id").isNotNull()).select("id", "digest").distinct()
    often = thin.groupBy("digest").agg(F.max("id").alias("refers_to"), F.count("*").alias("c")).where("c > 1").select("digest", "refers_to")
    return thin.join(often, "digest").where("id <> refers_to").select("id", "digest", "refers_to")


def _urn(i: int | None, digest: str, again: str = "") -> str:
    """A record's name: its row's id and digest, and, for rows after the first of the same two and for rows without id, their archive and place."""
    return f"<urn:x-record:{'none' if i is None else i}:{digest}{again}>"


def write(recs: DataFrame, repeats: DataFrame, folder: str, archives: int, *, chunk: int = CHUNK) -> DataFrame:
    """Archives of gzip members, one for each record; returns (path, records, bytes) of each archive.

    Payloads become chunk rows (record, number, bytes), which are shuffled once, to archives by id, so a writer holds one Arrow batch of
    chunks of an oversized payload at a time, compresses them one by one and carries the digest along; a payload whose chunks don't give its
    digest stops the job. A row of ``repeats`` (see ``revisits``) is dealt the same way and comes just before
    the chunks of its id and digest, which then are written as revisits without payload. Each archive appears when
    complete, under a name that a repeated task uses again.
    """
    n = max(1, archives)
    rows = recs.withColumn("uid", F.monotonically_increasing_id()).withColumn("chunk_no", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.floor((F.col("bytes") - 1) / chunk)))))
    data = F.when(F.col("bytes") > 0, F.substring(F.col("payload"), (F.col("chunk_no") * chunk + 1).cast("int"), F.lit(chunk)))
    rows = rows.select("id", "digest", "uid", "chunk_no", "uri", "bytes", F.lit(None).cast("long").alias("refers_to"), data.alias("data"))
    marks = repeats.select("id", "digest", F.lit(-1).cast("long").alias("uid"), F.lit(-1).cast("long").alias("chunk_no"), F.lit(None).cast("string").alias("uri"), F.lit(0).cast("long").alias("bytes"), "refers_to", F.lit(None).cast("binary").alias("data"))
    rows = rows.unionAll(marks).withColumn("archive", F.pmod(F.xxhash64(F.coalesce("id", "uid")), F.lit(n)).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, archive, count, gz, paths, mark, last, digest = None, None, 0, None, [], (None, None, None), None, None

        def end_record() -> None:
            out.write(gz.compress(b"\r\n\r\n") + gz.flush())
            if digest.hexdigest() != last[1]:
                raise ValueError(f"the chunks of record {last} are not its payload")

        def end_archive() -> None:
            end_record()
            out.commit()
            paths.append((out.path, count, out.size))

        try:
            for batch in batches:
                data = batch.column("data")
                for i, r in enumerate(batch.drop_columns("data").to_pylist()):
                    if r["chunk_no"] < 0:
                        mark = (r["id"], r["digest"], r["refers_to"])
                        continue
                    target = mark[2] if r["id"] is not None and mark[:2] == (r["id"], r["digest"]) else None
                    if r["archive"] != archive:
                        if out:
                            end_archive()
                        archive, count, gz = r["archive"], 0, None
                        out = AtomicFile(folder, f"part-{archive:06d}.warc.gz")
                    if r["chunk_no"] == 0:
                        if gz:
                            end_record()
                        gz, digest = zlib.compressobj(5, zlib.DEFLATED, 31), hashlib.sha1()
                        kind = "response" if target is None else "revisit"
                        again = f":{archive}-{count}" if r["id"] is None or last == (r["id"], r["digest"]) else ""
                        last = (r["id"], r["digest"])
                        head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_urn(*last, again)}", f"WARC-Date: {EPOCH}", f"WARC-Payload-Digest: sha1:{r['digest']}"]
                        if r["uri"]:
                            head.append("WARC-Target-URI: " + "".join(r["uri"].splitlines()))
                        if target is not None:
                            head += [f"WARC-Refers-To: {_urn(target, r['digest'])}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
                        head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {r['bytes'] if target is None else 0}", "", ""]
                        out.write(gz.compress("\r\n".join(head).encode()))
                        count += 1
                    chunk_bytes = data[i].as_buffer() if r["bytes"] else b""
                    digest.update(chunk_bytes)
                    if target is None and r["bytes"]:
                        out.write(gz.compress(chunk_bytes))
            if out:
                end_archive()
                out = None
        finally:
            if out and not out.out.closed:
                out.abort()
        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in paths], k) for i, k in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["path", "records", "bytes"])

    dealt = rows.repartitionById(n, F.col("archive")) if n > 1 else rows.coalesce(1)
    return dealt.sortWithinPartitions("archive", "id", "digest", "uid", "chunk_no").mapInArrow(run, "path string, records long, bytes long")


class _Stream:
    """The inflated bytes of an archive, read piece by piece; gzip members follow one another, or the file is plain."""

    def __init__(self, source, piece: int):
        self.source, self.piece, self.held, self.ended = source, piece, b"", False
        self.rest = source.read(piece)
        self.gz = zlib.decompressobj(31) if self.rest[:2] == b"\x1f\x8b" else None

    def more(self) -> bool:
        """Adds some bytes to what is held; False at the end."""
        if self.ended:
            return False
        if self.gz is None:
            data, self.rest = self.rest, self.source.read(self.piece)
            self.held += data
            self.ended = not self.rest
            return bool(data)
        while True:
            if self.gz.eof:
                self.rest = self.gz.unused_data or self.source.read(self.piece)
                if not self.rest:
                    self.ended = True
                    return False
                self.gz = zlib.decompressobj(31)
            if not self.rest:
                self.rest = self.source.read(self.piece)
                if not self.rest:
                    raise ValueError("the archive ends inside a record")
            data = self.gz.decompress(self.rest, self.piece)
            self.rest = self.gz.unconsumed_tail
            if data:
                self.held += data
                return True

    def until(self, mark: bytes) -> bytes | None:
        at = 0
        while (i := self.held.find(mark, at)) < 0:
            at = max(0, len(self.held) - len(mark))
            if not self.more():
                return None
        out, self.held = self.held[:i], self.held[i + len(mark):]
        return out

    def take(self, n: int) -> bytes:
        while len(self.held) < n and self.more():
            pass
        if len(self.held) < n:
            raise ValueError("the archive ends inside a record")
        out, self.held = self.held[:n], self.held[n:]
        return out


def chunks_of(source, chunk: int, with_data: bool = True) -> Iterator[tuple]:
    """CHUNKS rows of one open archive; sha1 is of the record's payload up to and with the chunk."""
    stream = _Stream(source, chunk)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        lines = head.strip(b"\r\n").decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        field = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        left, no, digest = int(field["content-length"]), 0, hashlib.sha1()
        while True:
            data = stream.take(min(chunk, left))
            digest.update(data)
            left -= len(data)
            yield (field["warc-record-id"], no, data if with_data else None, len(data), digest.hexdigest(), left == 0, field["warc-type"], field.get("warc-target-uri"), field.get("warc-payload-digest"), field.get("warc-refers-to"))
            no += 1
            if not left:
                break
        stream.until(b"\r\n\r\n")


def read(spark: SparkSession, paths: DataFrame, folder: str, *, chunk: int = CHUNK, with_data: bool = True) -> DataFrame:
    """The chunk rows (see CHUNKS) of the archives named in column ``path``; one archive is one task's stream."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = open_store(folder)

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=CHUNKS.names)

        for b in batches:
            for path in b.column(0).to_pylist():
                rows, held = [], 0
                with store.open_input_stream(path) as source:
                    for r in chunks_of(source, chunk, with_data):
                        rows.append(r)
                        held += r[3] if with_data else 100
                        if held > 4 << 20:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)

    return paths.select("path").mapInArrow(run, CHUNKS)


def round_trip(spark: SparkSession, pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url", *, least: int = LEAST, chunk: int = CHUNK) -> DataFrame:
    """Writes a record for each row, reads the archives back: (page_id, payload_bytes, payload_digest, record_type, refers_to).

    Bytes and digest are those of the payload read back; a revisit's are those of the response it refers to, by its id and digest, so
    rows of one id with other payloads are records of their own. Null payloads are empty responses; rows without id are
    responses with a null page_id; repeated rows with one id and payload are each a response or revisit as their id is.
    Extra columns are not read.
    """
    s = Scratch(spark, "warc")
    folder = f"{s.path}/archives"
    total = pages.agg(F.sum(F.octet_length(F.col(payload_col).cast("string")))).first()[0] or 0
    recs = records(pages, id_col, payload_col, url_col)
    made = s.save(write(recs, revisits(recs, least), folder, int(-(-total // ARCHIVE)), chunk=chunk), "index")
    n = made.count()
    got = read(spark, made.repartition(max(1, n)) if n > 1 else made, folder, chunk=chunk, with_data=False)
    whole = got.where("last").select("record_id", "type", "refers_to", "payload_digest", (F.col("chunk_no") * chunk + F.col("size")).alias("bytes"), "sha1")
    number = lambda c: F.regexp_extract(c, r"record:(-?\d+):", 1).try_cast("long")
    whole = s.save(whole.select(number("record_id").alias("page_id"), "type", number("refers_to").alias("refers_to"), "bytes", "sha1", F.substring_index("payload_digest", ":", -1).alias("digest")), "read")
    # A response that a third of all records refer to: the triples of target, digest and salt are few, and each record joins one of them.
    again = whole.where("refers_to is not null").withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)))
    first = whole.where("type = 'response' and page_id is not null").groupBy(F.col("page_id").alias("refers_to"), "digest").agg(F.min(F.struct("bytes", "sha1")).alias("f"))
    salted = again.select("refers_to", "digest", "salt").distinct().join(first, ["refers_to", "digest"])
    again = again.join(salted, ["refers_to", "digest", "salt"], "left").select("page_id", F.coalesce("f.bytes", "bytes").alias("bytes"), F.coalesce("f.sha1", "sha1").alias("sha1"), "type", "refers_to")
    out = whole.where("refers_to is null").select(again.columns).unionAll(again)
    return out.select("page_id", F.col("bytes").cast("long").alias("payload_bytes"), F.col("sha1").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")
