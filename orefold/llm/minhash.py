"""Near-duplicate documents by MinHash with tensored banding (operator 3)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from orefold.llm.common import Scratch, components, roots, run_hashes, shingles, word_hashes

#: The two collections hold COLLECTION half keys of HALF minhashes each. A pair of similarity s shares a table with
#: probability (1 - (1 - s^HALF)^COLLECTION)^2: 0.9995 at 0.8, 0.0002 at 0.17. The COLLECTION^2 = 256 tables of
#: 2 * HALF = 8 rows cost 2 * COLLECTION * HALF = 128 minhashes instead of 2048.
COLLECTION, HALF = 16, 4
SEED = 20_261
#: Parts into which what shares one text, key or set is dealt before it meets.
SALTS = 64
#: Shingles (and 200 a text) of a block of candidate texts that are compared in one task.
BLOCK = 1 << 16


def _functions(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 1 << 64, count, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 64, count, dtype=np.uint64)


def _half_keys(h: np.ndarray, bounds: np.ndarray, width: int) -> np.ndarray:
    """Half keys of the texts of a block, one row of 2 * COLLECTION for each text."""
    n = len(bounds) - 1
    out = np.zeros((n, 2 * COLLECTION), dtype=np.uint64)
    runs, starts, rows = [], [], []
    at = 0
    for i in range(n):
        words = h[bounds[i]: bounds[i + 1]]
        if len(words):
            r = run_hashes(words, min(width, len(words)))
            runs.append(r)
            starts.append(at)
            rows.append(i)
            at += len(r)
    if not rows:
        return out
    x, a, b = np.concatenate(runs), *_functions(2 * COLLECTION * HALF)
    with np.errstate(over="ignore"):
        for j in range(2 * COLLECTION):
            key = np.full(len(rows), j, dtype=np.uint64)
            for k in range(j * HALF, (j + 1) * HALF):
                low = np.minimum.reduceat(x * a[k] + b[k], starts)
                key = (key ^ (low >> np.uint64(17))) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(32)
            out[rows, j] = key
    return out


def sketches(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, n_shingles, set_id, a, b): set size, a 128-bit digest of the set (null: no words), two lists of half keys."""
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("set_id", T.BinaryType()),
                           T.StructField("a", T.ArrayType(T.LongType())), T.StructField("b", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for first, h, bounds in word_hashes(batch.column(1)):
                sizes, digests = [], []
                for i in range(len(bounds) - 1):
                    s = shingles(h[bounds[i]: bounds[i + 1]], width)
                    sizes.append(len(s))
                    digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                keys = _half_keys(h, bounds, width).view(np.int64)
                lists = [pa.ListArray.from_arrays(np.arange(0, len(sizes) * COLLECTION + 1, COLLECTION, dtype=np.int32), np.ascontiguousarray(part).ravel())
                         for part in (keys[:, :COLLECTION], keys[:, COLLECTION:])]
                yield pa.RecordBatch.from_arrays([ids.slice(first, len(sizes)), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), *lists], names=schema.names)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def _verified(pairs: DataFrame, texts: DataFrame, width: int, threshold: int) -> DataFrame:
    """Pairs (a, b) whose full shingle sets have 100 * intersection >= threshold * union.

    The pairs of one a are dealt to SALTS parts; each part gets the text of a once, before those of its partners.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, left = None, np.empty(0, np.uint64)
        for batch in batches:
            a, b, kept = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for first, h, bounds in word_hashes(batch.column(2)):
                for i in range(len(bounds) - 1):
                    mine = shingles(h[bounds[i]: bounds[i + 1]], width)
                    if b[first + i] is None:
                        key, left = a[first + i], mine
                        continue
                    if a[first + i] != key:
                        raise ValueError(f"pairs of {a[first + i]} without its text")
                    both = len(np.intersect1d(left, mine, assume_unique=True))
                    if both and 100 * both >= threshold * (len(left) + len(mine) - both):
                        kept.append(first + i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in kept], pa.int64()), pa.array([b[i] for i in kept], pa.int64())], names=["a", "b"])

    dealt = pairs.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    right = dealt.join(texts.select(F.col("id").alias("b"), "text"), "b").select("a", "b", "text", "part")
    left = dealt.select("a", "part").distinct().join(texts.select(F.col("id").alias("a"), "text"), "a").select("a", F.lit(None).cast("long").alias("b"), "text", "part")
    return right.unionAll(left).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first()).select("a", "b", "text").mapInArrow(run, "a long, b long")


def _sets(texts: DataFrame, width: int) -> DataFrame:
    """(rep, set): the shingle set of each text, as sorted 64-bit numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, h, bounds in word_hashes(batch.column(1)):
                sets = [shingles(h[bounds[i]: bounds[i + 1]], width).tobytes() for i in range(len(bounds) - 1)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(sets)), pa.array(sets, pa.binary())], names=["rep", "set"])

    return texts.select("id", "text").mapInArrow(run, "rep long, set binary")


def _linked(pdf: pd.DataFrame, threshold: int) -> pd.DataFrame:
    """Links between two blocks of a group (or in one): the least edges that join what is linked, other than by label."""
    x, y = int(pdf["x"].iloc[0]), int(pdf["y"].iloc[0])
    block, label, ids = pdf["block"].to_numpy(), pdf["label"].to_numpy(), pdf["rep"].to_numpy()
    left, right = np.flatnonzero(block == x), np.flatnonzero(block == y)
    sets = [np.frombuffer(v, dtype=np.uint64) for v in pdf["set"]]
    sizes = np.array([len(v) for v in sets])
    row = np.repeat(np.arange(len(sets)), sizes)
    values, col, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    use = np.flatnonzero(count > 1)  # only shared shingles can meet
    new = np.full(len(values), -1, dtype=np.int64)
    new[use] = np.arange(len(use))
    col = new[col]
    row, col = row[col >= 0], col[col >= 0]
    both = np.zeros((len(left), len(right)), dtype=np.float32)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    for a in range(0, len(use), 4096):
        lo, hi = np.searchsorted(col, [a, a + 4096])
        m = np.zeros((len(sets), min(4096, len(use) - a)), dtype=np.float32)
        m[row[lo:hi], col[lo:hi] - a] = 1
        both += m[left] @ m[right].T
    union = sizes[left][:, None] + sizes[right][None, :] - both
    i, j = np.nonzero((100 * both >= threshold * union) & (label[left][:, None] != label[right][None, :]))
    a, b = ids[left[i]], ids[right[j]]
    node, root = roots(a, b) if len(a) else (a, b)
    near = node != root
    return pd.DataFrame({"a": node[near], "b": root[near]})


def _by_key(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``keys`` (one row a key), as an inner join; each key meets its rows in SALTS parts, so a hot key is no hot task."""
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int"))
    met = dealt.groupBy("key", "part").agg(F.lit(1).alias("one")).join(keys, "key").drop("one")
    return dealt.join(met, ["key", "part"]).drop("part")


def near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = 4, threshold: int = 80) -> DataFrame:
    """Groups of documents whose shingle sets are linked: (doc_id, n_shingles, component_id, kept), a row for each input row.

    Equal sets form one class before any search, so copies cost one row each. The half keys of the classes are counted
    first; only classes that share a half key of both collections get table keys, which pair their shared half keys.
    In each table every class meets the class of the smallest id, and the pairs are confirmed on full sets. Tables that
    still hold classes of several components go on: their classes form candidate groups, which are dealt to blocks of
    bounded size in order of set size, and the pairs of blocks that may hold links compare all their sets and return a spanning
    forest. So each pair of classes that share a table is linked, in one component, or refused; nothing is capped, and
    no group meets in one task. Shingles are compared as 64-bit hashes of their words.

    Null and empty texts have no set (n_shingles 0) and no links. A row without id has a null component and is kept.
    Ids should be unique; repeated rows with one id are one node, and each gets its row. Extra columns are not read.
    """
    s = Scratch(spark, "minhash")
    rows = s.save(sketches(docs, id_col, text_col, width), "sketches")
    has = rows.where("set_id is not null and id is not null")
    classes = s.save(has.groupBy("set_id").agg(F.min("id").alias("rep"), F.count("*").alias("members"), F.min_by(F.struct("n_shingles", "a", "b"), "id").alias("r")), "classes")
    nodes = classes.select("rep", "r.*")

    def shared(side: str) -> DataFrame:
        keys = nodes.select("rep", F.explode(side).alias("key"))
        often = keys.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
        return keys.join(often, "key").groupBy("rep").agg(F.collect_set("key").alias(side))

    tables = shared("a").join(shared("b"), "rep").select("rep", F.explode("a").alias("ka"), "b").select("rep", "ka", F.explode("b").alias("kb")).select("rep", F.xxhash64("ka", "kb").alias("key"))
    tables = s.save(tables, "tables")
    shared_keys = tables.groupBy("key").agg(F.min("rep").alias("low"), F.count("*").alias("c")).where("c > 1").select("key", "low")
    first = s.save(_by_key(tables, shared_keys), "first")
    sizes = nodes.select("rep", F.col("n_shingles").alias("n"))
    some = first.select(F.col("rep").alias("id")).distinct()
    texts = s.save(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(some, "id", "left_semi").dropDuplicates(["id"]), "texts")
    pairs = first.where("rep <> low").select(F.col("low").alias("a"), F.col("rep").alias("b")).distinct()
    pairs = pairs.join(sizes.withColumnsRenamed({"rep": "a", "n": "na"}), "a").join(sizes.withColumnsRenamed({"rep": "b", "n": "nb"}), "b").where(f"100 * least(na, nb) >= {threshold} * greatest(na, nb)").select("a", "b")
    edges = s.save(_verified(pairs, texts, width, threshold), "edges")
    labels = s.save(components(edges, s, "stars"), "labels")

    named = first.join(labels, first.rep == labels.id, "left").select("key", "rep", "low", F.coalesce("component", "rep").alias("label"))
    open_keys = named.groupBy("key").agg(F.min("label").alias("p"), F.max("label").alias("q")).where("p <> q").select("key")
    unsettled = s.save(_by_key(named, open_keys).groupBy("rep", "low").agg(F.first("label").alias("label")), "unsettled")
    groups = components(unsettled.select(F.col("rep").alias("a"), F.col("low").alias("b")), s, "groups").select(F.col("id").alias("rep"), F.col("component").alias("g"))
    members = unsettled.select("rep", "label").distinct().join(groups, "rep").join(sizes, "rep")
    # Places in a group, in order of set size: sums of (group, size, part) first, then places in these.
    members = s.save(members.withColumn("part", F.pmod(F.xxhash64("rep"), F.lit(SALTS))).withColumn("w", F.col("n") + 200), "members")
    parts = members.groupBy("g", "n", "part").agg(F.sum("w").alias("w"))
    upto = F.coalesce(F.sum("w").over(Window.partitionBy("g").orderBy("n", "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.sum("w").over(Window.partitionBy("g", "n", "part").orderBy("rep"))
    placed = members.join(parts.select("g", "n", "part", upto.alias("before")), ["g", "n", "part"]).select("rep", "label", "g", "n", F.floor((F.col("before") + inside) / BLOCK).alias("block"))
    members = s.save(placed, "placed")
    blocks = members.groupBy("g", "block").agg(F.min("n").alias("n0"), F.max("n").alias("n1"), F.min("label").alias("l0"), F.max("label").alias("l1"))
    other = blocks.toDF("g", "y", "m0", "m1", "k0", "k1")
    meet = blocks.withColumnRenamed("block", "x").join(other, "g").where(f"x <= y and 100 * n1 >= {threshold} * m0 and not (l0 = l1 and k0 = k1 and l0 = k0)").select("g", "x", "y")
    meet = s.save(meet, "meet")
    dealt = meet.select("g", "x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("block"))
    full = members.join(_sets(texts.join(members.select(F.col("rep").alias("id")).distinct(), "id", "left_semi"), width), "rep")
    met = full.join(dealt, ["g", "block"]).select("g", "x", "y", "block", "rep", "label", "set")
    late = s.save(met.groupBy("g", "x", "y").applyInPandas(lambda pdf: _linked(pdf, threshold), "a long, b long"), "late")
    labels = s.save(components(late.union(labels.select("id", "component")), s, "all"), "components")
    s.drop("tables", "first", "texts", "unsettled", "members", "meet")

    # Copies of one text may be a third of all rows: their set meets its class once for each part of them.
    named = classes.where("members > 1").join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("set_id", F.coalesce("component", "rep").alias("c"))
    part = F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("part")
    thin = rows.select("id", "n_shingles", "set_id", part)
    copies = thin.where("set_id is not null and id is not null").groupBy("set_id", "part").agg(F.lit(1).alias("one")).join(named, "set_id").select("set_id", "part", "c")
    out = (thin.join(copies, ["set_id", "part"], "left").join(labels, "id", "left")
           .select(F.col("id").alias("doc_id"), "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("c", "component", "id")).alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """The documents with one row of each group of near duplicates. Rows without id stay; repeated rows give one row, and rows of a kept id with other texts stay."""
    kept = near_duplicates(spark, docs, **options).where("kept and doc_id is not null").select("doc_id").distinct()
    text = options.get("text_col", "text")
    return docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", text]).select(docs.columns).unionByName(docs.where("doc_id is null"))
