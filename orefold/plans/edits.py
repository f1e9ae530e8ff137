"""Edits of eight kinds on a snapshot of files: guards, staging in order, limits."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orefold.functions import paths
from orefold.operators import graph

#: Columns of edits: what isn't of a kind's own is null. ``content`` is new text, ``search`` what is found (or the anchor).
COLUMNS = "seq long, type string, path string, to string, search string, content string, times int, sha string"
KINDS = ("create_file", "replace_file", "replace_exact", "insert_before_exact", "insert_after_exact", "delete_exact", "remove_file", "move_file")
FINDING = ("replace_exact", "insert_before_exact", "insert_after_exact", "delete_exact")


def normalized(edits: DataFrame) -> DataFrame:
    """K1: edits with normalized paths and ``times`` of 1 where it is null."""
    return edits.withColumns({"path": paths.patch_path(F.col("path")), "to": paths.patch_path(F.col("to")), "times": F.coalesce("times", F.lit(1))})


def guards(edits: DataFrame, files: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """K1, K3: (seq, code) of what is wrong with normalized edits before any is applied.

    ``files`` (path, text), ``allowed`` (path): none if null. Paths meet files and allowed paths in equi-joins.
    """
    move, t = F.col("type") == "move_file", F.col("type")
    text = files.select(F.col("path"), F.sha2("text", 256).alias("have"))
    e = edits.join(text, "path", "left").join(files.select(F.col("path").alias("to"), F.lit(True).alias("taken")), "to", "left")
    inside = F.lit(True)
    if allowed is not None:
        for c in ("path", "to"):
            e = e.join(allowed.select(F.col("path").alias(c), F.lit(True).alias(f"{c}_ok")).distinct(), c, "left")
        inside = F.coalesce("path_ok", F.lit(False)) & (~move | F.coalesce("to_ok", F.lit(False)))
    shield = paths.protected(F.col("path")) | (move & paths.protected(F.col("to")))
    codes = F.array_compact(F.array(
        F.when(~t.isin(*KINDS), "UNKNOWN_KIND"), F.when((F.col("path") == "") | (move & ((F.col("to") == "") | (F.col("to") == F.col("path")))), "INVALID_PATH"),
        F.when(t.isin(*FINDING) & (F.coalesce("search", F.lit("")) == ""), "EMPTY_SEARCH"), F.when(F.col("times") < 1, "INVALID_TIMES"), F.when(~inside, "OUTSIDE_ALLOWED_PATHS"), F.when(shield, "PROTECTED_PATH"),
        F.when((t == "create_file") & F.col("have").isNotNull(), "TARGET_EXISTS"), F.when((t != "create_file") & F.col("have").isNull(), "TARGET_MISSING"),
        F.when((t != "create_file") & (F.col("sha") != F.col("have")), "STALE_CONTENT"), F.when(move & F.col("taken"), "DESTINATION_EXISTS")))
    return e.select("seq", F.explode(codes).alias("code"))


def _apply(rows: list) -> list[tuple]:
    """The edits of one group of paths, in order, over its files (rows without type); the first that can't be applied ends the group."""
    base = {r.path: r.text for r in rows if r.type is None and r.text is not None}
    now, error = dict(base), None
    for e in sorted((r for r in rows if r.type is not None), key=lambda r: r.seq):
        text = now.get(e.path)
        if e.type == "create_file":
            now[e.path] = e.content
        elif text is None:
            error = f"{e.seq}: missing"
        elif e.type == "move_file":
            if e.to in now:
                error = f"{e.seq}: destination exists"
            else:
                now[e.to] = now.pop(e.path)
        elif e.type == "remove_file":
            del now[e.path]
        elif e.type == "replace_file":
            now[e.path] = e.content
        elif text.count(e.search) != e.times:
            error = f"{e.seq}: found {text.count(e.search)} times"
        else:
            put = {"replace_exact": e.content, "insert_before_exact": f"{e.content}{e.search}", "insert_after_exact": f"{e.search}{e.content}", "delete_exact": ""}[e.type]
            now[e.path] = text.replace(e.search, put)
        if error:
            break
    return [(p, base.get(p), now.get(p), error) for p in sorted(base.keys() | now.keys())]


def _applied(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What each group's edits make of its files; rows come in order of groups, and a task holds one at a time."""
    every = (r for f in frames for r in f.itertuples(index=False, name="Row"))
    done: list[tuple] = []
    for _, group in groupby(every, key=lambda r: r.g):
        done += _apply(list(group))
        if len(done) > 1000:
            yield pd.DataFrame(done, columns=["path", "before", "after", "error"], dtype=object)
            done = []
    yield pd.DataFrame(done, columns=["path", "before", "after", "error"], dtype=object)


def stage(files: DataFrame, edits: DataFrame) -> DataFrame:
    """(path, before, after, kind, error) of the files that normalized edits change, and of groups in which an edit fails.

    Edits of one path keep their order; moves couple two paths. So paths are grouped by the moves between them, and each
    group's edits are applied in one task, over its own files alone; a task takes its groups from one sorted stream. Nothing of a failed group counts.
    """
    couples = edits.where("type = 'move_file'").select(F.col("path").alias("from"), "to")
    group = graph.components(couples).withColumnsRenamed({"node": "path", "component": "g"})
    touched = edits.select("path").union(edits.where("type = 'move_file'").select("to")).distinct().join(group, "path", "left").select("path", F.coalesce("g", "path").alias("g"))
    ops = edits.join(touched, "path").select("g", "seq", F.coalesce("type", F.lit("")).alias("type"), "path", "to", "search", "content", "times", F.lit(None).cast("string").alias("text"))
    own = files.select("path", "text").join(touched, "path").select("g", F.lit(0).cast("long").alias("seq"), *[F.lit(None).cast("string").alias(c) if c != "path" else F.col("path") for c in ("type", "path", "to", "search", "content")], F.lit(0).alias("times"), "text")
    done = ops.unionByName(own).repartition("g").sortWithinPartitions("g").mapInPandas(_applied, "path string, before string, after string, error string")
    kind = F.when(F.col("before").isNull(), "create").when(F.col("after").isNull(), "delete").otherwise("modify")
    return done.where(~F.col("before").eqNullSafe(F.col("after")) | F.col("error").isNotNull()).withColumn("kind", kind)


def limits(changes: DataFrame, most_files: int, most_added: int, most_bytes: int) -> DataFrame:
    """(files, added, largest, code): one row; code is null where changes are some and within the limits."""
    grown = F.greatest(F.lit(0), F.coalesce(F.octet_length("after"), F.lit(0)) - F.coalesce(F.octet_length("before"), F.lit(0)))
    g = changes.agg(F.count("*").alias("files"), F.coalesce(F.sum(grown), F.lit(0)).alias("added"), F.coalesce(F.max(F.octet_length("after")), F.lit(0)).alias("largest"))
    code = F.when(F.col("files") == 0, "NO_CHANGES").when(F.col("files") > most_files, "TOO_MANY_FILES").when(F.col("added") > most_added, "TOO_MANY_BYTES").when(F.col("largest") > most_bytes, "FILE_TOO_LARGE")
    return g.withColumn("code", code)


def prepare(files: DataFrame, edits: DataFrame, allowed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """K7: (guard findings, staged changes) of raw edits; changes are to be used only where there are no findings."""
    e = normalized(edits)
    return guards(e, files, allowed), stage(files, e)
