"""Mixing sources to target weights along a time-varying curriculum (operator 4)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orefold.llm.common import Scratch

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Hexadecimal digits of the order's MD5 that name a bucket: prefix sums are taken within buckets, then over them.
DIGITS = 3


def word_count(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """(source, source_size, target): the water filling of ``share`` of all sizes over the sources of ``sizes``.

    Sources in order of code points, null last, take ``weights`` in turn. A target stops at ``most`` times its source's
    size and the excess goes to the others by weight. With sources in order of size / weight, those below a level are
    full; the level is where the targets add up to the share. One row for each source enters the windows, no document.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    t = sizes.withColumn("i", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    t = t.withColumn("w", cycle[(F.col("i") % len(weights)).cast("int")]).withColumn("cap", F.col("source_size") * float(most))
    order = Window.orderBy(F.col("cap") / F.col("w"), "i")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    t = t.withColumn("level", (F.lit(float(share)) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest))
    # a source is full if the level its predecessors leave reaches its cap; the first that isn't sets the level of all the others
    t = t.withColumn("open", F.col("cap") / F.col("w") > F.col("level")).withColumn("level", F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("w"), "i", "level"))).over(every)["level"])
    return t.select("source", "source_size", F.coalesce(F.least("cap", F.col("w") * F.col("level")), F.col("cap")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = "mix", carry: Sequence[str] = ()) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, key, start, and ``carry`` as _carry_<name>): what the mix takes of each row of ``docs``.

    A source's rows stand in the order of an MD5 of seed and id; passes go round it until its target is filled, so a row
    is taken whole in each full pass and the last row of the last pass in part. ``start`` is the row's place in a pass,
    in words. A hot source is no hot key: rows are summed by (source, bucket of the MD5), then the buckets' sums.

    Null and empty texts have size 0 and are taken 0 times; a null source is a source. Rows with one id and source are
    ordered by size, then, where texts are carried, by a hash of these. An all-empty source has target 0. Extra columns are not read.
    """
    thin = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"), *[F.col(c).alias(f"_carry_{c}") for c in carry])
    thin = thin.withColumn("key", F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))))
    thin = thin.withColumn("ties", F.xxhash64(f"_carry_{text_col}") if text_col in carry else F.lit(0).cast("long"))
    thin = thin.withColumn("bucket", F.substring("key", 1, DIGITS)).withColumn("source", F.struct(F.col("source").alias("s")))
    sums = thin.groupBy("source", "bucket").agg(F.sum("size").alias("b"))
    sources = sums.groupBy("source").agg(F.sum("b").alias("source_size")).select(F.col("source.s").alias("source"), "source_size")
    goals = targets(sources, weights, share, most).select(F.struct(F.col("source").alias("s")).alias("source"), "source_size", "target")
    starts = sums.select("source", "bucket", F.coalesce(F.sum("b").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("at")).join(goals, "source")
    w = Window.partitionBy("source", "bucket").orderBy("key", "size", "ties").rowsBetween(Window.unboundedPreceding, -1)
    placed = thin.withColumn("within", F.coalesce(F.sum("size").over(w), F.lit(0))).join(starts, ["source", "bucket"])
    words = F.round("target").cast("long")
    start = F.col("at") + F.col("within")
    passes = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0).cast("long")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), words - passes * F.col("source_size") - start))
    return placed.select("doc_id", "size", "source_size", "target", (passes * F.col("size") + part).alias("taken"), "key", start.alias("start"), F.col("source.s").alias("source"), *[f"_carry_{c}" for c in carry])


def position(start, target, slope: float = 0.0):
    """The training time in [0, 1] at which a source's demand reaches ``start`` words of its target.

    The source's weight runs linearly from 1 - slope to 1 + slope over the training, so its demand up to t is
    target * ((1 - slope) * t + slope * t * t); the position inverts it.
    """
    x = F.least(F.lit(1.0), start / target)
    if not slope:
        return x
    return F.abs((F.sqrt(F.lit((1 - slope) ** 2) + F.lit(4 * slope) * x) - F.lit(1 - slope)) / F.lit(2 * slope))


def _passes(m: DataFrame, slopes: Sequence[float]) -> DataFrame:
    """A row for each pass that takes words of a row of the mix: epoch, words, position added."""
    names = m.select(F.struct(F.col("source").alias("s")).alias("_s")).distinct().withColumn("_i", (F.row_number().over(Window.orderBy(F.col("_s.s").asc_nulls_last())) - 1) % len(slopes))
    m = m.where("taken > 0").withColumn("_s", F.struct(F.col("source").alias("s"))).join(names, "_s")
    last = F.ceil(F.col("target") / F.col("source_size")).cast("int") - 1
    m = m.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.greatest(last, F.lit(0)))))
    at = F.col("start") + F.col("epoch") * F.col("source_size")
    words = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.round("target").cast("long") - at))
    when = F.coalesce(*[F.when(F.col("_i") == k, position(at, F.col("target"), s)) for k, s in enumerate(slopes)])
    return m.withColumn("words", words).withColumn("position", when).where("words > 0").drop("_s", "_i")


#: How sources' weights run over the training, in turn by code point: late, early, even.
SLOPES = (0.5, -0.5, 0.0)


def training_order(docs: DataFrame, *args, slopes: Sequence[float] = SLOPES, **options) -> DataFrame:
    """The mix as rows (doc_id, epoch, words, position), range-sorted by position: what is read when.

    A row of ``docs`` that is taken in several passes appears once for each, with the words that pass takes. See mix().
    """
    out = _passes(mix(docs, *args, **options), slopes).select("doc_id", "epoch", "words", "position", "key")
    return out.repartitionByRange("position", "key").sortWithinPartitions("position", "key").drop("key")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, slopes: Sequence[float] = SLOPES, **options) -> DataFrame:
    """The documents that the mix takes, with the columns of ``docs``: a row for each pass, its text cut after the words it takes, range-sorted by training position.

    Rows that the mix leaves out go. The texts travel with their rows through the mix's shuffle and that of the order, so a table
    written from the result holds them in the order in which they are read. n_chars, where there is such a column, follows the text.
    """
    m = _passes(mix(docs, id_col, text_col, source_col, carry=docs.columns, **options), slopes)
    text = F.col(f"_carry_{text_col}")
    cut = F.when(F.col("words") < F.col("size"), F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)), F.lit(1), F.col("words").cast("int")), "")).otherwise(text)
    m = m.withColumn("_cut", cut).drop(f"_carry_{text_col}").repartitionByRange("position", "key", "epoch").sortWithinPartitions("position", "key", "epoch")
    return m.select(*[F.col("_cut").alias(c) if c == text_col else F.length("_cut").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"_carry_{c}").alias(c) for c in docs.columns])


def mix_report(spark, docs: DataFrame, *, slopes: Sequence[float] = SLOPES) -> DataFrame:
    """The mix with each row's first training position (null where nothing is taken), range-sorted by it."""
    m = Scratch(spark, "mix").save(mix(docs), "mix")
    names = m.groupBy("source").agg(F.lit(1).alias("one")).select(F.struct(F.col("source").alias("s")).alias("_s")).withColumn("_i", (F.row_number().over(Window.orderBy(F.col("_s.s").asc_nulls_last())) - 1) % len(slopes))
    m = m.withColumn("_s", F.struct(F.col("source").alias("s"))).join(names, "_s")
    when = F.coalesce(*[F.when((F.col("taken") > 0) & (F.col("_i") == k), position(F.col("start"), F.col("target"), s)) for k, s in enumerate(slopes)])
    out = m.select("doc_id", "source", "size", "source_size", "target", "taken", when.alias("first_position"), "key")
    return out.repartitionByRange("first_position", "key").sortWithinPartitions("first_position", "key").drop("key")
