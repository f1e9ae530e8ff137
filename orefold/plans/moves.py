"""Plans of path moves: the imports that moves change, the edits that follow, and what stands against them."""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orefold.functions import paths, text
from orefold.operators import linking
from orefold.operators.graph import Rounds


class MovePlan(NamedTuple):
    """``rewrites`` (path, old, new, occurrences), ``moved`` (path, new_path), ``gaps`` (gap) and ``edits`` (place, type, path, to, search, content, times)."""

    rewrites: DataFrame
    moved: DataFrame
    gaps: DataFrame
    edits: DataFrame

    def affected(self) -> DataFrame:
        """(path): existing files that are moved or rewritten."""
        return self.moved.select("path").union(self.rewrites.select("path")).distinct()

    def new_paths(self) -> DataFrame:
        """(path): where moved files will be."""
        return self.moved.select(F.col("new_path").alias("path")).distinct()


def plan(m: Mapping[str, DataFrame], moves: DataFrame) -> MovePlan:
    """The plan of moves (pos, source, target) of files and directories in a model (files: path, text; dependencies: from, to, specifier).

    A file goes by the first move that names it or a directory above it; moves see the files as they are, so chains and swaps are one step each. An
    import by a relative specifier is rewritten if either end moves and the specifier changes, in the quotes that the text has. Gaps: no moves, a
    move without an end or to itself, without a source, onto a file that it doesn't move itself, two files with one destination, an importer without text, a
    specifier that the text doesn't quote.

    Files meet moves by their own prefixes in an equi-join, and only moved ends are resolved again, so a plan reads texts of the
    importers it touches alone. Null ends are empty ones; repeated dependencies give one rewrite. An empty model has gaps alone.
    """
    store = Rounds(moves.sparkSession)
    clean = lambda c: F.coalesce(paths.normalize(F.regexp_replace(F.coalesce(c, F.lit("")), "^[/\\\\]+", "")), F.lit(""))
    mv = store.save(moves.select("pos", clean(F.col("source")).alias("source"), clean(F.col("target")).alias("target")))
    files = m["files"].select("path").distinct()
    keys = F.array_append(paths.prefixes(F.col("path"), None), F.col("path"))
    hit = files.select("path", F.explode(keys).alias("source")).join(mv, "source").select("pos", "source", "target", "path", F.concat("target", F.substr("path", F.length("source") + 1)).alias("to"))
    hit = store.save(hit)
    moved = store.save(linking.remap(files, mv).where("new_path is not null and new_path <> path"))
    own = hit.select("pos", F.col("path").alias("to"), F.lit(True).alias("own")).distinct()
    exists = hit.join(files.withColumnRenamed("path", "to"), "to", "left_semi").join(own, ["pos", "to"], "left").where("own is null")
    say = lambda rows, *parts: rows.select(F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]).alias("gap"))
    c = F.col
    gaps = say(mv.where("source = '' or target = '' or source = target"), "invalid move ", c("source"), " -> ", c("target"))
    gaps = gaps.unionByName(say(mv.join(hit.select("pos").distinct(), "pos", "left_anti"), "move source does not exist: ", c("source")))
    gaps = gaps.unionByName(say(exists, "move destination already exists: ", c("to")))
    gaps = gaps.unionByName(say(moved.groupBy("new_path").count().where("count > 1"), "multiple sources map to destination: ", c("new_path")))
    if mv.isEmpty():
        gaps = gaps.unionByName(moves.sparkSession.createDataFrame([("move plan requires at least one move",)], "gap string"))
    at = lambda end: moved.select(c("path").alias(end), c("new_path").alias(f"{end}_new"))
    e = m["dependencies"].select("from", "to", "specifier").where(c("specifier").startswith(".")).distinct()
    e = e.join(at("from"), "from", "left").join(at("to"), "to", "left").where("from_new is not null or to_new is not null")
    e = e.withColumn("next", paths.relative(F.coalesce("from_new", "from"), F.coalesce("to_new", "to"), c("specifier"))).where("next <> specifier")
    e = e.join(m["files"].select(c("path").alias("from"), "text").dropDuplicates(["from"]), "from", "left")
    e = e.withColumn("old", text.needle(c("text"), c("specifier"))).withColumn("times", F.when(c("old").isNotNull(), text.occurrences(c("text"), c("old")))).drop("text")
    e = store.save(e)
    known = m["files"].where("text <> ''").select(c("path").alias("from")).distinct()
    blank = e.join(known, "from", "left_anti")
    gaps = gaps.unionByName(say(blank, "importer has no text for rewrite: ", c("from")))
    gaps = gaps.unionByName(say(e.where("old is null").join(known, "from", "left_semi"), "cannot locate quoted import specifier ", c("specifier"), " in ", c("from")))
    quote = F.substring("old", 1, 1)
    rewrites = store.save(e.where("old is not null").select(c("from").alias("path"), "old", F.concat(quote, "next", quote).alias("new"), c("times").cast("int").alias("occurrences")).distinct())
    place = lambda kind, *order: F.struct(F.lit(kind).alias("kind"), *order).alias("place")
    none = lambda n, t="string": F.lit(None).cast(t).alias(n)
    first = rewrites.select(place(0, c("path").alias("a"), c("old").alias("b"), F.lit(0).cast("long").alias("n")), F.lit("replace_exact").alias("type"), "path", none("to"), c("old").alias("search"), c("new").alias("content"), c("occurrences").alias("times"))
    then = mv.select(place(1, F.lit("").alias("a"), F.lit("").alias("b"), c("pos").cast("long").alias("n")), F.lit("move_file").alias("type"), c("source").alias("path"), c("target").alias("to"), none("search"), none("content"), none("times", "int"))
    return MovePlan(rewrites, moved, store.save(gaps.distinct()), store.save(first.unionByName(then)))
