"""Vector code compression: product codes from integer codebooks (operator 11)."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orefold.llm.common import Scratch

#: Integers (8 bytes each) of vectors that a task holds at once.
AT_ONCE = 1 << 21

MISFIT = "squared distances would not fit 64 bits"


def _matrices(batch: pa.RecordBatch, at: int, scale: int, width: int, most: int, at_once: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The usable rows of a batch, some at a time, with their integers (row, place); short vectors are filled up with zeros."""
    step = max(1, at_once // max(1, width))
    for start in range(0, batch.num_rows, step):
        rows = batch.slice(start, step)
        lists = rows.column(at)
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten()
        values = pc.fill_null(flat.cast(pa.float64()), math.nan).to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        good = lists.is_valid().to_numpy(zero_copy_only=False).copy()
        good[owner[~np.isfinite(values)]] = False
        if not good.any():
            continue
        place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        use = good[owner]
        scaled = np.floor(values[use] * scale)
        if len(scaled) and np.abs(scaled).max() > most:
            raise ValueError(f"a component times {scale} is beyond {most}: {MISFIT}")
        x = np.zeros((int(good.sum()), width), np.int64)
        x[(np.cumsum(good) - 1)[owner[use]], place[use]] = scaled.astype(np.int64)
        yield rows.filter(pa.array(good)), x


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first entry of ``book`` at the least squared distance from each row of ``x``, and that distance, in exact integers.

    |x|^2 - 2 x.c + |c|^2: intermediate sums may wrap around modulo 2^64, the distances themselves fit.
    """
    with np.errstate(over="ignore"):
        d = (x * x).sum(1)[:, None] - 2 * (x @ book.T) + (book * book).sum(1)
    at = d.argmin(1)
    return at, d[np.arange(len(x)), at]


class Codebooks:
    """Integer codebooks, one for each part of a vector: ``entries`` is (part, entry, place)."""

    def __init__(self, entries: np.ndarray, scale: int):
        self.entries, self.scale = entries, scale
        self.parts, self.size, self.part_width = entries.shape
        self.width = self.parts * self.part_width
        self.most, self.at_once = math.isqrt((1 << 62) // max(1, self.part_width)) // 2, AT_ONCE

    def matrices(self, batch: pa.RecordBatch, at: int):
        for rows, x in _matrices(batch, at, self.scale, self.width, self.most, self.at_once):
            yield rows, [x[:, p * self.part_width: (p + 1) * self.part_width] for p in range(self.parts)]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def sums(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's sums and counts for each entry that is some part's nearest."""
        total, count = np.zeros_like(self.entries), np.zeros(self.entries.shape[:2], np.int64)
        for batch in batches:
            for _, parts in self.matrices(batch, 0):
                for p, x in enumerate(parts):
                    at, _ = nearest(x, self.entries[p])
                    chosen = (at[:, None] == np.arange(self.size)).astype(np.int64)
                    total[p] += chosen.T @ x
                    count[p] += chosen.sum(0)
        part, entry = np.nonzero(count)
        if len(part):
            each = lambda a: pa.array(np.repeat(a, self.part_width).astype(np.int32))
            place = pa.array(np.tile(np.arange(self.part_width, dtype=np.int32), len(part)))
            yield pa.RecordBatch.from_arrays([each(part), each(entry), place, pa.array(total[part, entry].ravel()), pa.array(np.repeat(count[part, entry], self.part_width))], names=["part", "entry", "place", "total", "n"])

    def codes(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, label, code, error) of each usable row of (vector, id, label)."""
        for batch in batches:
            for rows, parts in self.matrices(batch, 0):
                found = [nearest(x, self.entries[p]) for p, x in enumerate(parts)]
                digits = np.stack([at for at, _ in found], 1).astype(np.uint8)
                error = sum(d for _, d in found)
                yield pa.RecordBatch.from_arrays([rows.column(1), rows.column(2), pa.array([r.tobytes().hex() for r in digits], pa.string()), pa.array(error, pa.int64())], names=["id", "label", "code", "error"])

    def after_round(self, vectors: DataFrame) -> Codebooks:
        """Each entry replaced by the floor of the mean of its parts; entries that no part is nearest to stay."""
        sums = vectors.select("vector").mapInArrow(self.sums, "part int, entry int, place int, total long, n long")
        merged = sums.groupBy("part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
        entries = self.entries.copy()
        for r in merged.collect():  # as many rows as the codebooks have integers
            entries[r.part, r.entry, r.place] = int(r.total) // r.n
        return Codebooks(entries, self.scale)


def _usable():
    """True for vectors without null or non-finite components."""
    v = F.col("vector")
    return v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def fit(vectors: DataFrame, parts: int = 8, size: int = 16, rounds: int = 6, scale: int = 4096) -> Codebooks | None:
    """Codebooks of ``vectors`` (vector, id, ...) after ``rounds`` rounds; None without a usable vector.

    The first entries are the parts of the ``size`` smallest ids. Every round reads all vectors once; a task sends one
    row for each integer of the codebooks, whatever it read.
    """
    usable = vectors.where(_usable())
    longest = usable.agg(F.max(F.size("vector"))).first()[0]
    if longest is None:
        return None
    width = -(-longest // parts)
    first = usable.orderBy(F.col("id").asc_nulls_last(), "vector").limit(size).select("vector").collect()
    start = np.zeros((len(first), parts * width), np.int64)
    for row, r in zip(start, first):
        if any(abs(x) * scale >= 1 << 32 for x in r.vector):
            raise ValueError(f"a component times {scale} is beyond 2^32: {MISFIT}")
        row[: len(r.vector)] = [math.floor(scale * x) for x in r.vector]
    books = Codebooks(np.ascontiguousarray(start.reshape(len(first), parts, width).transpose(1, 0, 2)), scale)
    for _ in range(rounds):
        books = books.after_round(vectors)
    return books


def compress(spark: SparkSession, embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", *, parts: int = 8, size: int = 16, rounds: int = 6, scale: int = 4096) -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256): each usable vector's code under codebooks fitted on all of them.

    Components become floor(scale * x), vectors ``parts`` equal parts, and a code two hexadecimal digits for each part.
    Codebooks are a few thousand integers and travel with the tasks; sums of a round are merged by a grouped shuffle.

    Rows whose vector is null or holds null, NaN or infinite components are dropped. Vectors shorter than the longest,
    or not divisible by ``parts``, count as followed by zeros; an empty vector is all zeros. Repeated ids are rows of
    their own, and among the first entries they stand in order of their vectors; null ids come last. Ties go to the
    lower entry. Null labels are one label. An empty table gives no rows. Components whose distances would not fit 64
    bits (about 2^28 / scale times 8 in parts of 8) raise an error and no wrong code. Other columns are not read.
    """
    vectors = embeddings.select(F.col(vector_col).alias("vector"), F.col(id_col).alias("id"), F.col(label_col).alias("label"))
    kinds = {f.name: f.dataType for f in vectors.schema}
    books = fit(vectors, parts, size, rounds, scale)
    schema = T.StructType([T.StructField("id", kinds["id"]), T.StructField("label", kinds["label"]), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    if books is None:
        coded, digest = spark.createDataFrame([], schema), hashlib.sha256(b"").hexdigest()
    else:
        coded, digest = Scratch(spark, "vector-codes").save(vectors.mapInArrow(books.codes, schema), "coded"), books.sha256()
    totals = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return coded.join(totals, F.col("label").eqNullSafe(F.col("of"))).select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def oracle(parts: int = 8, size: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """The same in DuckDB SQL: a pair of tables a round."""
    nearest_sql = "arg_min(c.k, CAST(list_sum(list_transform(list_zip(x.s, c.s), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) * {size} + c.k) AS k".format(size=size)
    steps = [f"""c0 AS MATERIALIZED (SELECT p, n - 1 AS k, s FROM x WHERE n <= {size})"""]
    for i in range(rounds):
        steps.append(f"a{i} AS MATERIALIZED (SELECT x.n, x.p, {nearest_sql} FROM x JOIN c{i} c ON x.p = c.p GROUP BY x.n, x.p)")
        steps.append(f"""m{i} AS MATERIALIZED (SELECT p, k, list(v ORDER BY place) AS s FROM (SELECT p, k, place, CAST((sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS v
  FROM (SELECT x.p, a.k, unnest(x.s) AS v, unnest(range(len(x.s))) AS place FROM x JOIN a{i} a ON x.n = a.n AND x.p = a.p) GROUP BY p, k, place) GROUP BY p, k)""")
        steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c.p, c.k, coalesce(m.s, c.s) AS s FROM c{i} c LEFT JOIN m{i} m ON c.p = m.p AND c.k = m.k)")
    return f"""
WITH v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {scale}) AS BIGINT)) AS e, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS n FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
w AS (SELECT (max(len(e)) + {parts - 1}) // {parts} AS w FROM v),
x AS MATERIALIZED (SELECT n, p, list_resize(e, {parts} * w, 0)[p * w + 1:(p + 1) * w] AS s FROM v, w, range({parts}) AS r(p)),
{", ".join(steps)},
f AS MATERIALIZED (SELECT x.n, x.p, {nearest_sql}, min(CAST(list_sum(list_transform(list_zip(x.s, c.s), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)) AS d FROM x JOIN c{rounds} c ON x.p = c.p GROUP BY x.n, x.p),
g AS (SELECT n, string_agg(format('{{:02x}}', k), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM f GROUP BY n),
h AS (SELECT sha256(string_agg(array_to_string(s, ','), ',' ORDER BY p, k)) AS sha FROM c{rounds})
SELECT v.vec_id, g.code, g.error, CAST(sum(g.error) OVER (PARTITION BY v.label) AS BIGINT) AS label_error, h.sha AS codebooks_sha256 FROM v JOIN g ON v.n = g.n, h"""
