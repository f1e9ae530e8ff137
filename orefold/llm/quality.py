"""Quality classifier on random-indexing word vectors (operator 6)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orefold.llm.common import BLOCK, Scratch, mix, text_bytes, words_of

#: Vocabulary slots (words share a slot by hash), dimensions, non-zero components of an index vector, context width.
SLOTS, DIM, NONZERO, REACH = 1 << 15, 64, 6, 2
#: Labelled rows the model is fitted on, at most: the first by a hash of their ids.
SAMPLE = 6000
HIDDEN, EPOCHS, RATE, DECAY, SEED = 32, 400, 0.01, 1e-4, 11
THRESHOLD = 0.7

_CLASS = np.full(256, 3, dtype=np.uint8)  # punctuation
_CLASS[list(b" \t\n\x0b\x0c\r")] = 0
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_CLASS[48:58] = 2
_UPPER = np.zeros(256, dtype=np.int64)
_UPPER[65:91] = 1
PART_SLOTS = 1 << 11  # slots whose sums travel as one row
LANES = 65535 // (4 * REACH)
_PART = 1 << 18  # bytes of a long text that are turned into slots at once


def index_vectors() -> np.ndarray:
    """A sparse ternary vector for each slot: NONZERO components are 1 or -1, at places drawn from a fixed seed."""
    rng = np.random.default_rng(SEED)
    out = np.zeros((SLOTS, DIM), dtype=np.int32)
    at = rng.random((SLOTS, DIM)).argpartition(NONZERO, axis=1)[:, :NONZERO]
    np.put_along_axis(out, at, rng.integers(0, 2, at.shape, dtype=np.int32) * 2 - 1, axis=1)
    return out


def _slots(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vocabulary slots of texts, and where each text's begin.

    A word is a run of letters, digits or punctuation, and is followed by a word for its shape: class, length (to 12)
    and case (none, first, some or all letters A-Z). Lower case is what is hashed.
    """
    kind = _CLASS[data]
    cuts = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    h, starts, ends = words_of(data, np.concatenate([cuts, bounds]))
    ups = np.concatenate([[0], np.cumsum(_UPPER[data])])
    n, up = ends - starts, ups[ends] - ups[starts]
    case = np.where(up == 0, 0, np.where(up == n, 3, np.where((up == 1) & (_UPPER[data[starts]] == 1), 1, 2))) if len(starts) else up
    shape = (kind[starts].astype(np.int64) * 13 + np.minimum(n, 12)) * 4 + case
    out = np.empty(2 * len(h), dtype=np.int64)
    out[0::2] = (h % np.uint64(SLOTS)).astype(np.int64)
    out[1::2] = (mix(shape.astype(np.uint64) + np.uint64(7)) % np.uint64(SLOTS)).astype(np.int64)
    return out, 2 * np.searchsorted(starts, bounds)


def _texts(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, slots, bounds) of blocks of whole texts; one long text alone is cut in parts at class changes."""
    raw, at = text_bytes(column)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(at, at[row] + BLOCK, side="right")) - 1)
        if at[end] - at[row] <= BLOCK:
            yield row, *_slots(raw[at[row]: at[end]], at[row: end + 1] - at[row])
        else:
            parts, a, last = [], int(at[row]), int(at[end])
            while a < last:
                b = min(a + _PART, last)
                while b < last and _CLASS[raw[b]] == _CLASS[raw[b - 1]]:
                    b += 1
                parts.append(_slots(raw[a:b], np.array([0, b - a]))[0])
                a = b
            s = np.concatenate(parts)
            yield row, s, np.array([0, len(s)])
        row = end


def contexts(blocks: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """For each slot of the blocks of texts (slots, bounds): how often it occurs, and the sum of its neighbours' index vectors."""
    # Four components (plus 1, so that none is below 0) share a word of 64 bits: sums of LANES rows of 2 * REACH neighbours fit 16 bits each.
    index = (np.concatenate([index_vectors(), np.zeros((1, DIM), np.int32)]) + 1).astype("<u2").view("<u8")  # the last one stands between texts
    total, seen = np.zeros((SLOTS + 1, DIM), dtype=np.int64), np.zeros(SLOTS, dtype=np.int64)
    for slots, bounds in blocks:
        seen += np.bincount(slots, minlength=SLOTS)
        n = len(bounds) - 1
        padded = np.full(len(slots) + REACH * (n + 1), SLOTS, dtype=np.int32)
        padded[np.arange(len(slots)) + REACH * (np.repeat(np.arange(n), np.diff(bounds)) + 1)] = slots
        for a in range(0, len(padded) - 2 * REACH, 1 << 16):
            part = padded[a: a + (1 << 16) + 2 * REACH]
            vectors, m = index.take(part, axis=0), len(part) - 2 * REACH
            around = sum(vectors[d: d + m] for d in range(2 * REACH + 1) if d != REACH)
            order = np.argsort(part[REACH: REACH + m].astype(np.uint16), kind="stable")
            s = part[REACH: REACH + m][order]
            cuts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]] | (np.arange(m) % LANES == 0))
            sums = np.add.reduceat(around.take(order, axis=0), cuts, axis=0).view("<u2").astype(np.int64) - 2 * REACH * np.diff(np.r_[cuts, m])[:, None]
            s = s[cuts]
            first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
            total[s[first]] += np.add.reduceat(sums, first, axis=0) if len(first) < len(s) else sums
    return seen, total[:SLOTS]


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The contexts of a task's texts, PART_SLOTS slots a row."""
    seen, total = contexts((slots, bounds) for batch in batches for _, slots, bounds in _texts(batch.column(0)))
    task = TaskContext.get().partitionId()
    for k in range(0, SLOTS, PART_SLOTS):
        part = slice(k, k + PART_SLOTS)
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([task], pa.int32()), *_packed(seen[part], total[part])], names=["first", "task", "seen", "sums"])


def _packed(*sums: np.ndarray) -> list[pa.Array]:
    return [pa.array([zstandard.compress(np.ascontiguousarray(x).tobytes(), 1)], pa.binary()) for x in sums]


def _added(parts: pa.Table, name: str) -> np.ndarray:
    total = 0
    for v in parts.column(name):
        total = total + np.frombuffer(zstandard.decompress(v.as_py()), dtype=np.int64)
    return total


def _some(parts: pa.Table) -> pa.Table:
    """The sums of several tasks over PART_SLOTS slots as one row."""
    return pa.table([parts.column("first")[:1], *_packed(_added(parts, "seen"), _added(parts, "sums"))], names=["first", "seen", "sums"])


def _vectors(parts: pa.Table) -> pa.Table:
    """Unit word vectors of PART_SLOTS slots, from all sums; a word counts as its own neighbour, too."""
    k = parts.column("first")[0].as_py()
    words = _added(parts, "sums").reshape(-1, DIM) + index_vectors()[k: k + PART_SLOTS] * _added(parts, "seen")[:, None]
    length = np.sqrt((words.astype(np.float64) ** 2).sum(1, keepdims=True))
    return pa.table({"first": pa.array([k], pa.int32()), "words": pa.array([(words / np.where(length > 0, length, 1)).astype(np.float32).tobytes()], pa.binary())})


def word_vectors(texts: DataFrame) -> np.ndarray:
    """Random-indexing vectors of all slots, from the contexts in all ``texts`` (column text).

    At most twice as many tasks as the cluster has cores sum their texts' contexts; the sums are added in two rounds, as many
    at once as the root of their number, and SLOTS * DIM floats come to the driver. Sums are of integers, so any order gives the same.
    """
    tasks = 2 * texts.sparkSession.sparkContext.defaultParallelism
    sums = texts.select(F.col("text").cast("string").alias("text")).coalesce(tasks).mapInArrow(_contexts, "first int, task int, seen binary, sums binary")
    sums = sums.groupBy("first", (F.col("task") % max(1, int(tasks ** 0.5))).alias("some")).applyInArrow(_some, "first int, seen binary, sums binary")
    parts = sums.groupBy("first").applyInArrow(_vectors, "first int, words binary").orderBy("first").toArrow()
    found = {k: np.frombuffer(v, dtype=np.float32) for k, v in zip(parts.column("first").to_pylist(), parts.column("words").to_pylist())}
    return np.concatenate([found.get(k, np.zeros(PART_SLOTS * DIM, np.float32)) for k in range(0, SLOTS, PART_SLOTS)]).reshape(SLOTS, DIM)


def features(words: np.ndarray, slots: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Mean word vector of each text, with its share of unseen words, log length and share of distinct word pairs."""
    n = np.diff(bounds)
    out = np.zeros((len(n), DIM + 3), dtype=np.float64)
    full = np.flatnonzero(n)
    if len(full):
        unseen = ~words.any(1)
        for i in full:  # a text's words may be many: they are added up through counts of slots
            at, count = np.unique(slots[bounds[i]: bounds[i + 1]], return_counts=True)
            out[i, :DIM] = count @ words[at] / n[i]
            out[i, DIM] = count[unseen[at]].sum() / n[i]
            own = slots[bounds[i]: bounds[i + 1]: 2]
            out[i, DIM + 2] = len(np.unique(own[:-1] * SLOTS + own[1:])) / max(1, len(own) - 1)
        out[:, DIM + 1] = np.log1p(n) / 10
    return out


@dataclass
class Model:
    """Word vectors, input scaling, two layers and a temperature."""

    words: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    layers: tuple[np.ndarray, np.ndarray, np.ndarray, float]
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((x - self.mean) / self.scale @ w1 + b1) @ w2 + b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -50, 50)))


def train(words: np.ndarray, x: np.ndarray, y: np.ndarray) -> Model:
    """Two layers by Adam on four fifths of the rows, then the temperature of least log loss on the rest."""
    rng = np.random.default_rng(SEED)
    part = rng.random(len(y)) < 0.8 if len(y) >= 20 else np.ones(len(y), dtype=bool)
    fit, rest = (x[part], y[part]), (x[~part], y[~part]) if len(y) >= 20 else (x, y)
    mean, scale = fit[0].mean(0), fit[0].std(0) + 1e-6
    a = (fit[0] - mean) / scale
    p = [rng.normal(0, a.shape[1] ** -0.5, (a.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN ** -0.5, HIDDEN), np.zeros(())]
    m, v = [np.zeros_like(w) for w in p], [np.zeros_like(w) for w in p]
    for t in range(1, EPOCHS + 1):
        hidden = np.tanh(a @ p[0] + p[1])
        err = (1 / (1 + np.exp(-np.clip(hidden @ p[2] + p[3], -50, 50))) - fit[1]) / len(a)
        back = np.outer(err, p[2]) * (1 - hidden ** 2)
        for i, g in enumerate((a.T @ back + DECAY * p[0], back.sum(0), hidden.T @ err + DECAY * p[2], err.sum())):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            p[i] = p[i] - RATE * (m[i] / (1 - 0.9 ** t)) / (np.sqrt(v[i] / (1 - 0.999 ** t)) + 1e-8)
    model = Model(words, mean, scale, (p[0], p[1], p[2], float(p[3])), 1.0)
    z, grid = model.logits(rest[0]), np.geomspace(0.25, 8, 61)
    model.temperature = float(min(grid, key=lambda t: np.logaddexp(0, np.where(rest[1] > 0, -z, z) / t).mean())) if len(z) else 1.0
    return model


def held_out(id_col: str) -> Column:
    """Whether a row is kept from training: crc32 of the id as text, modulo 4, is 2."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 4 == 2


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE) -> Model | None:
    """The model of at most ``sample`` labelled rows outside the held-out fold; None if labels hold one class or none.

    Word vectors come from the contexts in all documents, which need no labels; the network is fitted on the sample, the
    first rows by a hash of their ids. Null texts count as empty; labels other than 0 and 1, null ids and
    labels of absent documents are not used.
    """
    s = Scratch(spark, "quality")
    known = labels.where("doc_id is not null and quality in (0, 1)").where(~held_out("doc_id")).select("doc_id", F.col("quality").cast("int").alias("y"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample)  # at most `sample` rows of two numbers are broadcast
    rows = s.save(docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(known), "doc_id"), "sample")
    got = rows.groupBy("y").count().count()
    if got < 2:
        return None
    words = word_vectors(docs)
    sent = spark.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, slots, bounds in _texts(batch.column(2)):
                x = features(sent.value, slots, bounds)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(first, len(x)) for i in (0, 1)), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    t = rows.select("doc_id", "y", "text").mapInArrow(run, "doc_id long, y int, x array<double>").orderBy("doc_id", "y", "x").toArrow()
    x = t.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, DIM + 3)
    return train(words, x, t.column("y").to_numpy().astype(float))


def score(spark: SparkSession, docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row, from its whole text alone; without a model every score is 0.5.

    Null and empty texts get the score of a text without words; repeated rows equal scores. Extra columns are not read.
    """
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, slots, bounds in _texts(batch.column(2)):
                m = sent.value
                got = m.scores(features(m.words, slots, bounds)) if m else np.full(len(bounds) - 1, 0.5)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(first, len(got)) for i in (0, 1)), pa.array(got)], names=["doc_id", "held_out", "score"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    out = src.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def accepted(spark: SparkSession, docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs`` with a score of THRESHOLD or more, all columns kept; nothing is shuffled."""
    sent = spark.sparkContext.broadcast(model)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            for first, slots, bounds in _texts(batch.column(names.index("text"))):
                m = sent.value
                keep[first: first + len(bounds) - 1] = m.scores(features(m.words, slots, bounds)) >= THRESHOLD if m else True
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
