"""Training-order materialisation of token ids in fixed-stride shards (operator 1)."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orefold.llm import bpe
from orefold.llm.common import Scratch, text_bytes
from orefold.llm.files import AtomicFile, open_store

#: Tokens of a sequence, sequences of a shard, rounds of the Feistel network.
LENGTH, IN_SHARD, ROUNDS = 2048, 4096, 6
#: Byte-level ids: a text's UTF-8 bytes are its ids, one byte each; these two never occur in UTF-8.
END, PAD = 0xFF, 0xFE
#: A record: sequence number (u64), tokens that aren't padding (u32), then LENGTH ids (little-endian, of 1, 2 or 4 bytes).
HEADER = "<QI"
HEADER_BYTES = struct.calcsize(HEADER)


def permute(index, size: int, key: int):
    """Slots of the sequence numbers ``index`` (below size) under a keyed bijection of [0, size).

    A balanced Feistel network permutes the least square of a power of two that holds size; numbers that land outside
    are permuted again (cycle walking) until they are inside. Works on a whole array.
    """
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = [np.uint64(int.from_bytes(hashlib.blake2b(f"{key}:{r}".encode(), digest_size=8).digest(), "little")) for r in range(ROUNDS)]
    x = np.asarray(index, dtype=np.uint64).copy()
    todo = np.ones(len(x), dtype=bool)
    with np.errstate(over="ignore"):
        while todo.any():
            left, right = x[todo] >> shift, x[todo] & mask
            for k in keys:
                f = (right ^ k) * np.uint64(0x9E3779B97F4A7C15)
                f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                left, right = right, left ^ ((f >> np.uint64(32)) & mask)
            x[todo] = (left << shift) | right
            todo = x >= np.uint64(size)
    return x.astype(np.int64)


def id_bytes(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a column's lists as bytes, ``width`` each, and where each list starts (and the last ends); null lists are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten()
    sizes = pa.compute.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    if values.null_count:
        raise ValueError("a list of ids holds null")
    ids = values.to_numpy(zero_copy_only=False)
    if len(ids) and (ids.min() < 0 or int(ids.max()) >= 1 << 8 * width):
        raise ValueError(f"ids from {ids.min()} to {ids.max()} don't fit {width} bytes")
    return ids.astype(f"<u{width}").view(np.uint8), np.r_[0, np.cumsum(sizes, dtype=np.int64)] * width


def _packed(batches: Iterator[pa.RecordBatch], base: int, length: int, end: bytes, width: int) -> Iterator[tuple[int, int, bytes]]:
    """(sequence, place in it, tokens): the texts' bytes or the lists' ids, each followed by end, cut where sequences end; base bytes come before.

    Places and the length of a sequence are in bytes, too.
    """
    held, first = [], base
    size = 0
    for batch in batches:
        col = batch.column(0)
        raw, bounds = id_bytes(col, width) if pa.types.is_list(col.type) or pa.types.is_large_list(col.type) else text_bytes(col)
        for i in range(len(bounds) - 1):
            for piece in (raw[bounds[i]: bounds[i + 1]].tobytes(), end):
                a = 0
                while a < len(piece):
                    room = length - (first + size) % length
                    part = piece[a: a + room]
                    held.append(part)
                    size += len(part)
                    a += len(part)
                    if (first + size) % length == 0:
                        yield first // length, first % length, b"".join(held)
                        first, size, held = first + size, 0, []
    if size:
        yield first // length, first % length, b"".join(held)


def materialise(spark: SparkSession, docs: DataFrame, folder: str, text_col: str = "text", *, key: int = 1, length: int = LENGTH, in_shard: int = IN_SHARD,
                ids_col: str | None = None, width: int = 1, end: int = END, pad: int = PAD) -> DataFrame:
    """Writes all texts (or the lists of ids of ``ids_col``) as shards in training order; returns (shard, path, first_slot, records, bytes, sha256) of each.

    The corpus is one run of ids of ``width`` bytes (texts in scan order, each ended by ``end``), cut in sequences of ``length``. Where a
    partition's ids start follows from the partitions' sums, so no text is shuffled to number it; then each sequence
    goes once, to the shard of its slot. ``docs`` must give the same partitions on every read, as a scan of stored
    files does; a partition that changes stops the job instead of writing wrong places. Pieces travel compressed. Only the last sequence is padded,
    with ``pad``. Texts are byte-level ids; for lists, ``end`` and ``pad`` should be no ids of theirs. Ids that do not fit ``width`` bytes stop the job.

    Null and empty texts and lists are an end alone; an empty table gives no shard. Repeated rows are repeated. Shards appear when
    complete and have names that a repeated task uses again. Extra columns are not read.
    """
    if width not in (1, 2, 4) or (ids_col is None and width != 1) or not all(0 <= x < 1 << 8 * width for x in (end, pad)):
        raise ValueError(f"width {width}, end {end}, pad {pad}")
    texts = docs.select(F.col(text_col).cast("string").alias("text") if ids_col is None else F.col(ids_col).alias("text"))
    size_of = F.octet_length("text") if ids_col is None else F.when(F.col("text").isNotNull(), F.size("text"))
    sums = {r.p: r.n for r in texts.groupBy(F.spark_partition_id().alias("p")).agg(F.sum(F.coalesce(size_of, F.lit(0)) + F.lit(1)).alias("n")).collect()}  # a row for each partition
    bases, total = {}, 0
    for p in sorted(sums):
        bases[p] = total
        total += sums[p]
    count = -(-total // length)
    shards = -(-count // in_shard)
    end_bytes, pad_bytes = end.to_bytes(width, "little"), pad.to_bytes(width, "little")
    if not count:
        return spark.createDataFrame([], "shard int, path string, first_slot long, records long, bytes long, sha256 string")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, done = TaskContext.get().partitionId(), 0
        rows: list[tuple[int, int, bytes]] = []
        squeeze = zstandard.ZstdCompressor(level=1).compress

        def batch() -> pa.RecordBatch:
            seq, at, data = zip(*rows)
            slot = permute(np.array(seq), count, key)
            return pa.RecordBatch.from_arrays([pa.array(slot // in_shard, pa.int32()), pa.array(slot), pa.array(seq, pa.int64()), pa.array(at, pa.int32()), pa.array(data, pa.binary())], names=["shard", "slot", "seq", "at", "ids"])

        for r in _packed(batches, bases.get(p, 0) * width, length * width, end_bytes, width):
            rows.append((*r[:2], squeeze(r[2])))
            done += len(r[2]) // width
            if len(rows) >= 1024:
                yield batch()
                rows.clear()
        if done != sums.get(p, 0):
            raise ValueError(f"partition {p} had {sums.get(p, 0)} ids and now has {done}: the input isn't the same on every read")
        if rows:
            yield batch()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, shard, slot, seq, held, size, made, digest, n = None, None, None, None, [], 0, [], None, 0
        whole = zstandard.ZstdDecompressor().decompress

        def record() -> None:
            nonlocal n
            data = struct.pack(HEADER, seq, size // width) + b"".join(held) + pad_bytes * (length - size // width)
            out.write(data)
            digest.update(data)
            n += 1

        def close() -> None:
            record()
            out.commit()
            made.append((shard, out.path, shard * in_shard, n, out.size, digest.hexdigest()))

        for b in batches:
            for s, sl, q, data in zip(*(b.column(i).to_pylist() for i in (0, 1, 2, 4))):
                if sl != slot:
                    if out and s != shard:
                        close()
                        out = None
                    elif out:
                        record()
                    if out is None:
                        out, shard, digest, n = AtomicFile(folder, f"shard-{s:06d}.ids"), s, hashlib.sha256(), 0
                    slot, seq, held, size = sl, q, [], 0
                held.append(whole(data))
                size += len(held[-1])
        if out:
            close()
        cols = list(zip(*made)) if made else [[]] * 6
        kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["shard", "path", "first_slot", "records", "bytes", "sha256"])

    rows = texts.mapInArrow(pack, "shard int, slot long, seq long, at int, ids binary")
    rows = rows.repartitionById(shards, F.col("shard")) if shards > 1 else rows.repartition(1)  # not coalesce: pack must run in the partitions that were summed
    return rows.sortWithinPartitions("slot", "at").mapInArrow(write, "shard int, path string, first_slot long, records long, bytes long, sha256 string")


def read_shard(folder: str, path: str, start: int = 0, stop: int | None = None, length: int = LENGTH, width: int = 1) -> Iterator[tuple[int, bytes]]:
    """(sequence number, ids without padding, ``width`` bytes each) of a shard's records from the start-th on: one seek, then in order."""
    store, _ = open_store(folder)
    stride = HEADER_BYTES + length * width
    with store.open_input_file(path) as f:
        f.seek(start * stride)
        at = start
        while (stop is None or at < stop) and (data := f.read(stride)):
            seq, n = struct.unpack_from(HEADER, data)
            yield seq, data[HEADER_BYTES: HEADER_BYTES + n * width]
            at += 1


def read_back(spark: SparkSession, shards: DataFrame, folder: str, *, length: int = LENGTH, width: int = 1, end: int = END) -> DataFrame:
    """(slot, shard, byte_offset, seq, n_tokens, n_ends, ids_sha256) of every record, from the files."""
    names = ["slot", "shard", "byte_offset", "seq", "n_tokens", "n_ends", "ids_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, path, first in zip(*(b.column(i).to_pylist() for i in range(3))):
                rows = [(first + i, shard, i * (HEADER_BYTES + length * width), seq, len(ids) // width, int((np.frombuffer(ids, f"<u{width}") == end).sum()), hashlib.sha256(ids).hexdigest())
                        for i, (seq, ids) in enumerate(read_shard(folder, path, length=length, width=width))]
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return shards.select("shard", "path", "first_slot").mapInArrow(run, "slot long, shard int, byte_offset long, seq long, n_tokens long, n_ends long, ids_sha256 string")


def training_shards(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """Materialises ``docs`` in the shared folder and returns what the shards hold, a row for each sequence."""
    s = Scratch(spark, "shards")
    folder = f"{s.path}/files"
    made = s.save(materialise(spark, docs, folder, **options), "index")
    n = made.count()
    return read_back(spark, made.repartition(n, "shard") if n > 1 else made, folder, **{k: v for k, v in options.items() if k in ("length", "width", "end")})


def tokenised_shards(spark: SparkSession, docs: DataFrame, path: str, text_col: str = "text", **options) -> DataFrame:
    """training_shards on the ids of a byte-level tokenizer file: of 2 bytes where the vocabulary allows, else of 4.

    END and PAD are the first two ids beyond the vocabulary, so no text holds them. The ids are stored once, for both reads, and dropped when the shards are there.
    """
    s = Scratch(spark, "ids")
    size = bpe.load(path).n_vocab
    at = f"{s.path}/ids"
    found = bpe.encode_ids(docs, path, text_col)
    found.write.option("compression", "zstd").parquet(at)
    out = training_shards(spark, spark.read.schema(found.schema).parquet(at), **{"ids_col": "ids", "width": 2 if size + 2 <= 1 << 16 else 4, "end": size, "pad": size + 1} | options)
    s.drop("ids")
    return out
