"""Grouped analyses of dependency, symbol, effect and state facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orefold.functions import paths, text


def fan_out(edges: DataFrame, least: int = 5) -> DataFrame:
    """E1"""
    return edges.groupBy(F.col("from").alias("file")).agg(F.countDistinct("to").alias("fan_out")).where(F.col("fan_out") >= least)


def fan_in(edges: DataFrame, least: int = 4) -> DataFrame:
    """E2"""
    return edges.groupBy(F.col("to").alias("file")).agg(F.countDistinct("from").alias("fan_in")).where(F.col("fan_in") >= least)


def degrees(edges: DataFrame) -> DataFrame:
    """(file, fan_in, fan_out) by one pass over both ends of the distinct edges."""
    e = edges.select("from", "to").distinct()
    ends = e.select(F.col("to").alias("file"), F.lit(1).alias("i"), F.lit(0).alias("o")).union(e.select("from", F.lit(0), F.lit(1)))
    return ends.groupBy("file").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))


def watersheds(edges: DataFrame, effects: DataFrame, least: int = 6) -> DataFrame:
    """3 * fan-in + fan-out + 2 * effects."""
    n = effects.groupBy("file").agg(F.count("*").alias("effects"))
    d = degrees(edges).join(n, "file", "left").withColumn("effects", F.coalesce("effects", F.lit(0)))
    return d.withColumn("score", 3 * F.col("fan_in") + F.col("fan_out") + 2 * F.col("effects")).where(F.col("score") >= least)


def integration(edges: DataFrame, effects: DataFrame, states: DataFrame, exports: DataFrame, least: int = 5) -> DataFrame:
    """E5: 3 * fan-in + 2 * fan-out + 2 * effects + states + exports."""
    e = edges.select("from", "to").distinct()
    weighed = (e.select(F.col("to").alias("file"), F.lit(3).alias("w")).unionAll(e.select("from", F.lit(2))).unionAll(effects.select("file", F.lit(2)))
               .unionAll(states.select("file", F.lit(1))).unionAll(exports.select("file", F.lit(1))))
    return weighed.groupBy("file").agg(F.sum("w").alias("score")).where(F.col("score") >= least)


def families(symbols: DataFrame) -> DataFrame:
    """Symbols by family token: distributed if several are exported from several files."""
    g = symbols.groupBy(text.family(F.col("name")).alias("family")).agg(F.count("*").alias("members"), F.countDistinct("file").alias("files"), F.sum(F.col("exported").cast("int")).alias("exported"))
    kind = F.when((F.col("exported") > 1) & (F.col("files") > 1), "distributed").otherwise("family")
    return g.where("members > 1").withColumn("kind", kind)


def directory_rollup(files: DataFrame, counters: list[str]) -> DataFrame:
    """Each counter summed to every directory above a file, by its prefixes."""
    up = files.withColumn("directory", F.explode(paths.prefixes(F.col("path"), None)))
    return up.groupBy("directory").agg(F.count("*").alias("files"), *[F.sum(c).alias(c) for c in counters])


def region_stats(files: DataFrame, edges: DataFrame) -> DataFrame:
    """Candidate regions (directories to depth 3) with their files, and edges that cross their boundary."""
    regions = files.withColumn("region", F.explode(paths.prefixes(F.col("path")))).groupBy("region").agg(F.count("*").alias("files"))
    a, b = paths.prefixes(F.col("from")), paths.prefixes(F.col("to"))
    crossing = edges.select(F.explode(F.concat(F.array_except(a, b), F.array_except(b, a))).alias("region")).groupBy("region").agg(F.count("*").alias("boundary"))
    return regions.join(crossing, "region", "left").withColumn("boundary", F.coalesce("boundary", F.lit(0)))
