"""What the operators of this subpackage share: shared scratch tables, word hashing and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# --------------------------------------------------------------------------- scratch tables

def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a temporary one only where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="orefold-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


class Scratch:
    """Parquet tables in the shared folder. Writing one cuts the lineage, and lost executors can't take it with them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/orefold/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        at = f"{self.path}/{name}"
        df.write.mode("overwrite").parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


# --------------------------------------------------------------------------- word hashes

SPACES = b" \t\n\x0b\x0c\r"
BLOCK = 1 << 20  # bytes hashed at once

_MULT = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x100000001B3
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACES)] = True
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i below n."""
    if len(_POWERS.get("up", ())) < n:
        with np.errstate(over="ignore"):
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                p = np.full(n, base, dtype=np.uint64)
                p[0] = 1
                _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit of x."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(data: np.ndarray, cuts: np.ndarray, space: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words of data; a word ends before white space and before each cut."""
    n = len(data)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    word = ~space[data]
    cut = np.zeros(n + 1, dtype=bool)
    cut[cuts] = True
    cut[0] = cut[n] = True
    before = np.r_[False, word[:-1]]
    after = np.r_[word[1:], False]
    starts = np.flatnonzero(word & (~before | cut[:n]))
    ends = np.flatnonzero(word & (~after | cut[1:])) + 1
    up, down = _powers(max(n, BLOCK))
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        h = (sums[ends] - sums[starts]) * down[starts]
        h = mix(h + (ends - starts).astype(np.uint64) * _MULT)
    return h, starts, ends


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a column's texts and where each starts (and the last ends); nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset: column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)), at


def word_hashes(column: pa.Array, space: np.ndarray = _IS_SPACE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Word hashes of whole texts, a block of about BLOCK bytes at a time.

    Words are runs of anything but ASCII white space, A-Z lower-cased. Yields (first row, hashes, bounds): the words of
    row first + i are hashes[bounds[i]:bounds[i + 1]]. A null text has no words. A text longer than a block is hashed
    in parts cut at white space, so memory holds one text's hashes, not its expansion.
    """
    raw, at = text_bytes(column)
    row, n = 0, len(column)
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + BLOCK, side="right")) - 1)
        if end > row + 1 or at[end] - at[row] <= BLOCK:
            bounds = at[row: end + 1] - at[row]
            h, starts, _ = words_of(raw[at[row]: at[end]], bounds, space)
            yield row, h, np.searchsorted(starts, bounds)
        else:
            parts, a, last = [], int(at[row]), int(at[end])
            while a < last:
                b = min(a + BLOCK, last)
                while b < last and not space[raw[b]]:  # never inside a word
                    b += 1
                parts.append(words_of(raw[a:b], np.empty(0, np.int64), space)[0])
                a = b
            h = np.concatenate(parts)
            yield row, h, np.array([0, len(h)])
        row = end


def shingles(h: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words; a shorter text is one run, a text without words none."""
    if len(h) == 0:
        return h
    k = min(width, len(h))
    return np.unique(run_hashes(h, k))


def run_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of k words, in order."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        s = np.full(n, k, dtype=np.uint64)
        for i in range(k):
            s = s * _MULT + h[i: i + n]
            s ^= s >> np.uint64(29)
    return mix(s)


def text_batches(batch: pa.RecordBatch, column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batch that hold about ``limit`` bytes of text each (one row at least)."""
    col = batch.column(batch.schema.get_field_index(column))
    sizes = np.array([0 if v is None else v for v in pa.compute.binary_length(col).to_pylist()], dtype=np.int64)
    total, start = 0, 0
    for i, s in enumerate(sizes):
        if total and total + s > limit:
            yield batch.slice(start, i - start)
            total, start = 0, i
        total += s
    if start < len(sizes):
        yield batch.slice(start)


# --------------------------------------------------------------------------- connected components

#: Edges (16 bytes each) that one task may join by itself.
FEW_EDGES = 200_000


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids on the edges (a, b), and the smallest id that each reaches."""
    ids, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a):]
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while not np.array_equal(new[new], new):
            new = new[new]
        if np.array_equal(new, root):
            return ids, ids[root]
        root = new


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches]
    if parts:
        ids, low = roots(*(np.concatenate(x) for x in zip(*parts)))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(low, pa.int64())], names=["id", "component"])


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(id, component): the smallest id that each end of an edge (a, b) reaches.

    Up to FEW_EDGES edges, which are counted first, are joined by one task. More are joined by all tasks, which alternate large-star and
    small-star steps (a node's larger neighbours, then its smaller ones, move to the smallest neighbour) until the edges stop changing; every step is two joins on thin rows, so AQE can split a hot node.
    """
    cur = scratch.save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0")
    size = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    was, step = size(cur), 0
    if was[0] <= FEW_EDGES:
        return cur.coalesce(1).mapInArrow(_joined, "id long, component long")
    while was[0]:
        both = cur.union(cur.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(low.select("a", "m")).distinct()
        step += 1
        cur = scratch.save(small, f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}")
        now = size(cur)
        if now == was:
            break
        was = now
    child = cur.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return child.union(child.select("component", "component").distinct())
