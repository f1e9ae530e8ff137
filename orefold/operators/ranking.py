"""Rankings and windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top_k(rows: DataFrame, group: Sequence[str], order: Sequence[Column | str], k: int) -> DataFrame:
    """The first k rows of each group (rank from 1); Spark keeps k a task before it shuffles."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k)


def owner_margin(scores: DataFrame, group: str, score: str, tie: str, least: int = 4, margin: int = 2) -> DataFrame:
    """the best row of a group if it scores enough and leads the next by enough."""
    w = Window.partitionBy(group).orderBy(F.col(score).desc(), tie)
    r = scores.select("*", F.lead(score).over(w).alias("runner_up"), F.row_number().over(w).alias("_r")).where("_r = 1").drop("_r")
    return r.withColumn("owned", (F.col(score) >= least) & (F.col(score) - F.coalesce("runner_up", F.lit(0)) >= margin))


def spans(rows: DataFrame, group: str, order: Sequence[str], line: str, end: Column) -> DataFrame:
    """where each row's block ends: before the next one of its group, or at the group's end."""
    w = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("line_end", F.coalesce(F.lead(line).over(w) - 1, end))


def stages(rows: DataFrame, phase: str, order: Sequence[str], most: int) -> DataFrame:
    """batches of at most ``most`` rows within a phase."""
    return rows.withColumn("stage", F.floor((F.row_number().over(Window.partitionBy(phase).orderBy(*order)) - 1) / most).cast("int"))
