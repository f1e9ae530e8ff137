"""Near-duplicate vectors by a pivot-permutation index (operator 7)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orefold.llm.common import Scratch, components, roots

#: Vectors of the fitting sample (at most, chosen by hash), pivots (at most), bytes of all pivots, pivots of a vector, and the largest block of a list.
SAMPLE, PIVOTS, PIVOT_BYTES, NEAREST, BLOCK = 1 << 16, 1 << 14, 32 << 20, 8, 1024
#: Lengths of vectors that get pivots; those of any other length are all in one list.
WIDTHS = 8
#: A pair is a link when it shares this many of its NEAREST pivots: one, since lists compare all their pairs in any case.
SHARED = 1


def _unit(vectors: np.ndarray) -> np.ndarray:
    v = np.asarray(vectors, dtype=np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)  # so that squares of huge or tiny components stay finite
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def fit_pivots(vectors: DataFrame, count: int = 0) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each of the WIDTHS commonest lengths of vectors (column v): the sample's mean direction, and unit reference points.

    Reference points are the first distinct directions, from the mean, of a sample in the order of a hash: ``count`` of
    them, or four times the root of the number of vectors, at least 32 and at most PIVOTS or what PIVOT_BYTES hold. A
    hash threshold keeps the sample near four times that number before the driver sees it.
    """
    out = {}
    for width, n in vectors.groupBy(F.size("v").alias("width")).count().orderBy(F.col("count").desc(), "width").limit(WIDTHS).collect():
        most = max(32, min(PIVOTS, PIVOT_BYTES // (8 * width)))
        want = min(most, count or max(32, int(4 * n ** 0.5)))
        sample = min(SAMPLE, 4 * want)
        h = F.shiftrightunsigned(F.xxhash64("v"), 1)
        got = vectors.where(F.size("v") == width).select("v", h.alias("h")).where(F.col("h") <= F.lit(min(2**63 - 1, int(2.0 * sample / n * 2**63)))).orderBy("h", "v").limit(sample).toPandas()
        points = _unit(np.stack(got["v"].to_numpy()))
        middle = points.mean(0)
        points = points - middle
        length = np.sqrt((points * points).sum(1, keepdims=True))
        points = points / np.where(length > 1e-12, length, 1)
        chosen = np.zeros((0, width))
        for k in range(0, len(points), 512):  # each less than 0.98 to those before
            some = points[k: k + 512]
            far = ~(some @ chosen.T > 0.98).any(1)
            far &= ~(np.tril(some @ some.T, -1) > 0.98).any(1)
            chosen = np.concatenate([chosen, some[far]])[:want]
            if len(chosen) == want:
                break
        out[width] = middle, chosen
    return out


def _linked(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links between the vectors of one list (or of two blocks of it) whose smallest shared pivot is this list's."""
    here, x, y = pdf["pivot"].iloc[0], pdf["bx"].iloc[0], pdf["by"].iloc[0]
    ids, mult = pdf["vec"].to_numpy(), pdf["mult"].to_numpy()
    piv = np.stack(pdf["pivots"].to_numpy())
    unit = _unit(np.stack([np.frombuffer(b, dtype="<f8") for b in pdf["packed"]]))
    side = pdf["block"].to_numpy()
    left = np.flatnonzero(side == x)
    right = np.flatnonzero(side == y)
    n_links = np.zeros(len(ids), dtype=np.int64)
    near = unit[left] @ unit[right].T >= threshold - 1e-9
    i, j = np.nonzero(near)
    i, j = left[i], right[j]
    if x == y:
        i, j = i[i < j], j[i < j]
    links = []
    for k in range(0, len(i), 65536):
        a, b = i[k: k + 65536], j[k: k + 65536]
        exact = np.einsum("ij,ij->i", unit[a], unit[b]) >= threshold
        a, b = a[exact], b[exact]
        same = (piv[a][:, :, None] == piv[b][:, None, :]).any(2)
        first = np.where(same, piv[a], np.iinfo(np.int32).max).min(1)
        ok = (same.sum(1) >= min(SHARED, piv.shape[1])) & (first == here)
        a, b = a[ok], b[ok]
        np.add.at(n_links, a, mult[b])
        np.add.at(n_links, b, mult[a])
        links.append((a, b))
    to = ids.copy()
    if links:
        node, low = roots(ids[np.concatenate([a for a, _ in links])], ids[np.concatenate([b for _, b in links])])
        at = np.minimum(np.searchsorted(node, ids), max(0, len(node) - 1))
        to = np.where(node[at] == ids, low[at], ids) if len(node) else ids  # one edge for each vector tells this list's components
    keep = n_links > 0
    return pd.DataFrame({"vec": ids[keep], "links": n_links[keep], "to": to[keep]})


def near_vectors(spark: SparkSession, vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", group_col: str = "label", *, threshold: float = 0.98, pivots: int = 0) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row: links of cosine >= threshold within a group, in double precision.

    Equal vectors of a group form one class first. Each class is described by its NEAREST reference points in order, seen
    from the sample's mean, and enters their inverted lists; long lists are split in blocks and pairs of blocks. A pair that shares a
    pivot (SHARED) is verified in the list of its smallest shared pivot, so no link counts twice, and lists return sums
    and one edge for each vector instead of pairs. With 4 * sqrt(n) pivots a list has about 2 * sqrt(n) vectors, so work grows
    with n ** 1.5, until PIVOTS are reached (n of 16 million); from there lists grow in proportion. Vectors
    meet those of their own length; lengths beyond the WIDTHS commonest have one list each, which is exact.

    Vectors that are null, empty or zero, or hold null or non-finite components, and rows of a null group, have no links
    (component_id is their own id). Rows without id have a null component and are kept. Repeated ids are one node. Extra columns are not read.
    """
    s = Scratch(spark, "pivots")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), F.col(group_col).alias("g"))
    sound = F.col("id").isNotNull() & F.col("g").isNotNull() & F.col("v").isNotNull() & F.expr("size(v) > 0 and exists(v, x -> x <> 0) and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    rows = s.save(rows.withColumn("v", F.when(sound, F.transform("v", lambda x: x + F.lit(0.0)))), "rows")
    classes = s.save(rows.where("v is not null").groupBy("g", "v").agg(F.min("id").alias("vec"), F.countDistinct("id").alias("mult")), "classes")
    n = classes.count()
    sent = spark.sparkContext.broadcast(fit_pivots(classes.select("v"), pivots))  # WIDTHS * PIVOT_BYTES at most
    schema = T.StructType([f for f in classes.schema if f.name != "v"] + [T.StructField("width", T.IntegerType()), T.StructField("packed", T.BinaryType()), T.StructField("pivots", T.ArrayType(T.IntegerType()))])

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for width, part in pdf.groupby(pdf["v"].map(len)):
                near = [[0]] * len(part)  # one list for all of a rare length
                if width in sent.value:
                    middle, points = sent.value[width]
                    k = min(NEAREST, len(points))
                    scores = (_unit(np.stack(part["v"].to_numpy())) - middle) @ points.T
                    top = np.argpartition(-scores, k - 1, axis=1)[:, :k]
                    near = list(np.take_along_axis(top, np.argsort(-np.take_along_axis(scores, top, 1), axis=1, kind="stable"), 1).astype(np.int32))
                yield part.drop(columns="v").assign(width=int(width), packed=[np.asarray(x, "<f8").tobytes() for x in part["v"]], pivots=near)

    if not n:
        links = spark.createDataFrame([], "vec long, links long, to long")
    else:
        described = s.save(classes.select("g", "vec", "mult", "v").mapInPandas(describe, schema), "described")
        lists = described.withColumn("pivot", F.explode("pivots"))
        keys = ["g", "width", "pivot"]
        blocks = lists.groupBy(*keys).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        dealt = lists.join(blocks, keys).withColumn("block", F.pmod(F.xxhash64("vec"), F.col("blocks")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("bx", F.least("block", "other")).withColumn("by", F.greatest("block", "other"))
        found = dealt.groupBy(*keys, "bx", "by").applyInPandas(lambda pdf: _linked(pdf, threshold), "vec long, links long, to long")
        links = s.save(found, "found")
    counts = links.groupBy("vec").agg(F.sum("links").alias("links"))
    labels = components(links.select(F.col("vec").alias("a"), F.col("to").alias("b")), s)
    by_class = (classes.withColumn("own", F.xxhash64("v")).join(counts, "vec", "left").join(labels.withColumnRenamed("id", "vec"), "vec", "left")
                .select("g", "v", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "vec").alias("c")))
    out = rows.join(by_class, ["g", "v"], "left").select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
