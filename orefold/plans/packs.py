"""Context packs: the source slices that a certified corridor grants, within budgets, and tokens for what follows."""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orefold.functions.chunks import chunks
from orefold.operators import ranking
from orefold.operators.graph import Rounds

# Fixed values (I7): segments of a pack, symbols of a segment, and why a file has no segment.
SEGMENTS, SYMBOLS = 24, 6
NO_FACTS = "certified file has no text-backed Repository Model facts"
NO_ANCHOR = "certified file has no objective-local symbol anchor; exhaustive file source remains hidden"


class Pack(NamedTuple):
    """``segments`` (objective, place, id, path, sha256, content, evidence, symbols), ``continuations`` (objective, id, segment, path, symbol, kind, chunk, chunks,
    line_start, line_end, source, continued, next), ``omissions`` (objective, path, reason), ``later`` (objective, after, files): where the next call goes on."""

    segments: DataFrame
    continuations: DataFrame
    omissions: DataFrame
    later: DataFrame


def token(segment, symbol, chunk):
    """The continuation id of a symbol's chunk."""
    return F.concat(F.lit("ctx-"), F.substring(F.sha2(F.concat_ws("\n", segment, symbol, chunk.cast("string")), 256), 1, 20))


def pack(files: DataFrame, m: Mapping[str, DataFrame], *, after: DataFrame | None = None, most_segments: int = SEGMENTS, most_symbols: int = SYMBOLS) -> Pack:
    """I7 for any number of objectives at once.

    ``files`` (objective, place, path, reasons, names): a corridor's files in order, with the names of the symbols that its objective is about; ``m``: files
    and symbols. A segment holds the first ``most_symbols`` of these in order of line, each from its line to the one before the file's
    next symbol, cut into chunks of 4000 characters and 120 lines: the first chunk stands in the segment, the others are
    continuations whose tokens form a chain. F22: a pack takes the next ``most_segments`` files; ``later`` says after which place a further call (``after``: objective, after)
    begins, so calls and continuations together are the pack without budgets.

    Files without a text, and those without any of the symbols, are omissions with their reason. Symbols of one name in a file are slices of their own that share
    tokens, as tokens are made of names; a path at two places is a segment at each. Null names ask for nothing, repeated ones once; empty tables give empty packs. Other columns are not read.
    """
    store = Rounds(files.sparkSession)
    empty = F.array().cast("array<string>")
    f = files.select("objective", "place", "path", F.coalesce("reasons", empty).alias("reasons"), F.array_distinct(F.array_compact(F.coalesce("names", empty))).alias("names"))
    if after is not None:
        f = f.join(after.select("objective", "after"), "objective", "left").where("after is null or place > after").drop("after")
    ranked = f.withColumn("_n", F.row_number().over(Window.partitionBy("objective").orderBy("place", "path")))
    most = max(1, most_segments)
    chosen = store.save(ranked.where(F.col("_n") <= most))
    texts = m["files"].select("path", "text").where("text is not null").join(chosen.select("path").distinct(), "path", "left_semi").dropDuplicates(["path"])
    texts = store.save(texts)
    by_line = Window.partitionBy("path").orderBy("line", "name")
    own = m["symbols"].select(F.col("file").alias("path"), "name", "kind", "line").join(texts.select("path"), "path", "left_semi")
    own = own.select("*", F.lead("line").over(by_line).alias("next_line"), F.row_number().over(by_line).alias("at"))
    asked = chosen.select("objective", "place", "path", F.explode("names").alias("name"))
    picked = store.save(ranking.top_k(own.join(asked, ["path", "name"]), ["objective", "place", "path"], ["at"], most_symbols))
    # each slice is cut once, however many objectives ask for it
    lines, first = F.split("text", "\n"), F.greatest(F.lit(1), F.col("line"))
    last = F.greatest(first, F.least(F.size("_lines"), F.coalesce("next_line", F.size("_lines") + 1) - 1))
    cut = picked.select("path", "at", "line", "next_line").distinct().join(texts, "path").withColumn("_lines", lines)
    cut = store.save(cut.select("path", "at", first.alias("first"), chunks(F.array_join(F.slice("_lines", first, last - first + 1), "\n")).alias("chunks")))
    rows = picked.select("objective", "place", "path", "name", "kind", "at", "rank").join(cut, ["path", "at"]).withColumn("segment", F.concat(F.lit("file:"), "path"))
    one = F.struct("rank", "name", "kind", (F.col("chunks")[0]["line_start"] + F.col("first") - 1).alias("line_start"), (F.col("chunks")[0]["line_end"] + F.col("first") - 1).alias("line_end"), F.col("chunks")[0]["source"].alias("source"), (F.size("chunks") > 1).alias("truncated"),
                   F.when(F.size("chunks") > 1, token(F.col("segment"), F.col("name"), F.lit(2))).alias("continuation"))
    slices = rows.groupBy("objective", "place", "path").agg(F.array_sort(F.collect_list(one)).alias("symbols"))  # ``most_symbols`` at most
    shown = lambda s: F.concat(F.lit("/* "), s["name"], F.lit(" ("), s["kind"], F.lit(") lines "), s["line_start"], F.lit("-"), s["line_end"], F.when(s["truncated"], ", truncated; continuation available").otherwise(""), F.lit(" */\n"), s["source"])
    segments = chosen.join(slices, ["objective", "place", "path"]).join(texts, "path").select("objective", "place", F.concat(F.lit("file:"), "path").alias("id"), "path", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.array_join(F.transform("symbols", shown), "\n\n").alias("content"), F.col("reasons").alias("evidence"), "symbols")
    rest = rows.select("objective", "segment", "path", "name", "kind", "first", F.size("chunks").alias("of"), F.posexplode("chunks").alias("i", "c")).where("i > 0")
    following = F.when(F.col("i") + 1 < F.col("of"), token(F.col("segment"), F.col("name"), F.col("i") + 2))
    rest = rest.select("objective", token(F.col("segment"), F.col("name"), F.col("i") + 1).alias("id"), "segment", "path", F.col("name").alias("symbol"), "kind", (F.col("i") + 1).alias("chunk"), F.col("of").alias("chunks"), (F.col("c.line_start") + F.col("first") - 1).alias("line_start"), (F.col("c.line_end") + F.col("first") - 1).alias("line_end"), F.col("c.source").alias("source"), F.col("c.continued").alias("continued"), following.alias("next"))
    known = texts.select("path", F.lit(True).alias("known"))
    omitted = chosen.join(known, "path", "left").join(slices.select("objective", "place", "path"), ["objective", "place", "path"], "left_anti").select("objective", "path", F.when(F.col("known"), NO_ANCHOR).otherwise(NO_FACTS).alias("reason"))
    later = ranked.groupBy("objective").agg(F.max(F.when(F.col("_n") <= most, F.col("place"))).alias("after"), F.count_if(F.col("_n") > most).alias("files")).where("files > 0")
    return Pack(store.save(segments), store.save(rest), store.save(omitted), store.save(later))


def resume(continuations: DataFrame, tokens: DataFrame) -> DataFrame:
    """The chunks that tokens (objective, id) ask for; each names the token that follows it. Unknown tokens give no rows."""
    return continuations.join(tokens.select("objective", "id").distinct(), ["objective", "id"], "left_semi")


def grants(p: Pack) -> DataFrame:
    """(objective, path): the files whose source a pack shows."""
    return p.segments.select("objective", "path").distinct()


def consumers(p: Pack, dependencies: DataFrame) -> DataFrame:
    """(objective, path, consumer): the files that depend on a segment's; rows, as a file may have any number."""
    return grants(p).join(dependencies.select(F.col("to").alias("path"), F.col("from").alias("consumer")).distinct(), "path").select("objective", "path", "consumer")


def contract_evidence(p: Pack, asked: DataFrame, contracts: DataFrame, endpoints: DataFrame) -> DataFrame:
    """(objective, path, id, name, kind, role, reconciliation, verification): a segment's contracts among those that its corridor row names (``asked``: objective, path, id).

    A file that is provider and consumer is the provider.
    """
    role = F.when(F.bool_or(F.col("role") == "provider"), "provider").otherwise("consumer")
    e = endpoints.groupBy("id", "path").agg(role.alias("role"))
    return grants(p).join(asked.distinct(), ["objective", "path"]).join(e, ["id", "path"]).join(contracts.select("id", "name", "kind", "reconciliation", "verification"), "id").select("objective", "path", "id", "name", "kind", "role", "reconciliation", "verification")


def runtime_evidence(p: Pack, asked: DataFrame, regions: DataFrame, members: DataFrame, nodes: DataFrame) -> DataFrame:
    """(objective, path, region, roles, effect_kinds, reconciliation, verification_target): a segment's runtime regions among those that its corridor row names (``asked``: objective, path, region).

    ``regions`` (region, reconciliation, terminal_effects, observation_points), ``members`` (region, node), ``nodes`` (id, file, kind, effect_kind). Kinds are fixed
    lists, so the sets are small however many nodes a file has.
    """
    own = members.join(nodes.select(F.col("id").alias("node"), F.col("file").alias("path"), "kind", "effect_kind"), "node")
    kinds = own.groupBy("region", "path").agg(F.array_sort(F.collect_set("kind")).alias("roles"), F.array_sort(F.collect_set(F.when(F.col("effect_kind") != "symbol-operation", F.col("effect_kind")))).alias("effect_kinds"))
    target = ((F.col("terminal_effects") > 0) | (F.col("observation_points") > 0)).alias("verification_target")
    return grants(p).join(asked.distinct(), ["objective", "path"]).join(kinds, ["region", "path"]).join(regions.select("region", "reconciliation", target), "region").select("objective", "path", "region", "roles", "effect_kinds", "reconciliation", "verification_target")
