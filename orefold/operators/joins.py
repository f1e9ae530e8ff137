"""Join shapes that fact queries share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_match(probe: DataFrame, key: str, wanted: Column, build: DataFrame, build_key: str) -> DataFrame:
    """Each probe row (unique ``key``) with the first of its ``wanted`` keys that ``build`` has, as ``match`` (null: none).

    Candidates become rows for one equi-join; the least place wins in a partial aggregate.
    """
    tries = probe.select(key, F.posexplode(wanted).alias("_pos", "_want"))
    hits = tries.join(build.select(F.col(build_key).alias("_want")).distinct(), "_want").groupBy(key).agg(F.min_by("_want", "_pos").alias("match"))
    return probe.join(hits, key, "left")


def asof(probe: DataFrame, facts: DataFrame, on: Sequence[str], at: str, since: str, ties: Sequence[str], value: Sequence[str]) -> DataFrame:
    """Each probe row with the last fact of its ``on`` keys whose ``since`` is not after ``at``; ``ties`` ascending.

    Both tables are sorted once by key and place and the last fact is carried forward, so no pair but the right one is made.
    """
    names = [*since.split(), *value]
    p = probe.select("*", F.lit(None).cast(f"struct<{','.join(f'{n}:{facts.schema[n].dataType.simpleString()}' for n in names)}>").alias("_fact"), F.lit(1).alias("_probe"), F.col(at).alias("_at"), *[F.lit(None).cast(facts.schema[t].dataType).alias(f"_t{i}") for i, t in enumerate(ties)])
    f = facts.select(*[F.col(c) if c in on else F.lit(None).cast(probe.schema[c].dataType).alias(c) for c in probe.columns], F.struct(*names).alias("_fact"), F.lit(0).alias("_probe"), F.col(since).alias("_at"), *[F.col(t).alias(f"_t{i}") for i, t in enumerate(ties)])
    w = Window.partitionBy(*on).orderBy("_at", "_probe", *[F.col(f"_t{i}").desc() for i in range(len(ties))]).rowsBetween(Window.unboundedPreceding, 0)
    out = p.unionByName(f).withColumn("_last", F.last("_fact", ignorenulls=True).over(w)).where("_probe = 1")
    return out.select(*probe.columns, *[F.col(f"_last.{n}").alias(n if n not in probe.columns else f"fact_{n}") for n in names])


def last_wins(rows: DataFrame, key: Sequence[str], seq: str) -> DataFrame:
    """H6: one row for each key, the one of the greatest ``seq``."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), seq).alias("_r")).select(*key, "_r.*")


def diff(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose value differs, with the kind of change."""
    b, a = before.select(key, F.col(value).alias("before")), after.select(key, F.col(value).alias("after"))
    kind = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("changed")
    return b.join(a, key, "full_outer").where(~F.col("before").eqNullSafe(F.col("after"))).withColumn("change", kind)


def xor(left: DataFrame, right: DataFrame) -> DataFrame:
    """H5: rows of exactly one side."""
    return left.subtract(right).union(right.subtract(left))
