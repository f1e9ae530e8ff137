"""Run states over an event log (L7-L9), in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orefold.plans import policy

def sequence(events: DataFrame, run: str, order: list[str]) -> DataFrame:
    """Each event's number in its run."""
    return events.withColumn("sequence", F.row_number().over(Window.partitionBy(run).orderBy(*order)))


def violations(events: DataFrame, run: str, state: str, order: list[str], allowed: dict[str, tuple[str, ...]]) -> DataFrame:
    """Steps of a run to a state that may not follow the one before."""
    steps = events.withColumn("before", F.lag(state).over(Window.partitionBy(run).orderBy(*order)))
    ok = F.lit(False)
    for a, follow in allowed.items():
        ok = ok | ((F.col("before") == a) & F.col(state).isin(*follow))
    return steps.where(F.col("before").isNotNull() & ~ok)


def summary(numbered: DataFrame, run: str, state: str, number: str) -> DataFrame:
    """Each run's number of events, its last state, whether it is terminal, and how often it succeeded and failed."""
    last = F.max_by(state, number)
    ends = [s for s, f in policy.FOLLOWING.items() if not f]
    g = numbered.groupBy(run).agg(F.count("*").alias("events"), last.alias("state"), F.count_if(F.col(state) == "SUCCEEDED").alias("successes"), F.count_if(F.col(state).isin("FAILED", "BLOCKED_IDENTICAL_FAILURE")).alias("failures"))
    return g.withColumn("terminal", F.col("state").isin(*ends))


def windowed_counts(events: DataFrame, at: str, state: str, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Counts of states in time windows; on a stream, windows close once events are ``late`` behind the newest."""
    if events.isStreaming:
        events = events.withWatermark(at, late)
    return events.groupBy(F.window(at, width).alias("w"), state).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), state, "n")
