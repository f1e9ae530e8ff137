"""Bounded projections for any number of objectives: the first rows of each, with their first children and what is left out.

Ranks are windows cut to k rows, of which Spark keeps k a group in each task before the shuffle; counts of what
is left out are aggregates of their own, summed in tasks first. So a hot group sends k rows and a count from a task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orefold.functions import text
from orefold.operators import ranking, substrings
from orefold.operators.graph import Rounds

# Fixed values (F14-F17): how many rows and children a projection shows.
NATIVE, CONTRACTS, CONSUMERS, EVIDENCE, FAILURES, REGIONS, MEMBERS, GRANTS = 8, 12, 8, 6, 4, 8, 12, 8


def first_children(parents: DataFrame, children: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int, fields: Sequence[str], name: str) -> DataFrame:
    """``parents`` with the first k children of each as an array ``name``, their number ``<name>_count`` and whether some are left out, ``<name>_truncated``.

    Parents without children have an empty array. Children of other parents are not ranked.
    """
    mine = children.join(parents.select(*keys).distinct(), list(keys), "left_semi")
    count = mine.groupBy(*keys).agg(F.count("*").alias(f"{name}_count"))
    shown = ranking.top_k(mine, keys, order, k).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", *fields))).alias(name))  # k at most
    out = parents.join(count, list(keys), "left").join(shown, list(keys), "left").fillna(0, [f"{name}_count"])
    bare = F.transform(name, lambda x: x.dropFields("rank"))
    empty = F.filter(F.array(F.struct(*[F.lit(None).cast(children.schema[f].dataType).alias(f) for f in fields])), lambda _: F.lit(False))
    return out.withColumn(name, F.coalesce(bare, empty)).withColumn(f"{name}_truncated", F.col(f"{name}_count") > k)


def _hits(haystacks: DataFrame, terms: DataFrame, objectives: DataFrame, ids: Sequence[str]) -> DataFrame:
    """(objective, ids, hits): how many terms of an objective each text holds; ``objectives`` (objective, term)."""
    return substrings.containing(haystacks, terms, ids).join(objectives, "term").groupBy("objective", *ids).agg(F.count("*").alias("hits"))


def best(rows: DataFrame, ids: Sequence[str], base: Column, haystacks: DataFrame, objectives: DataFrame, each: int, extra: DataFrame | None, k: int, order: str, positive: bool = False) -> DataFrame:
    """(objective, ids, score, rank): the k rows of each objective of the highest score, equal ones by ``order``.

    A score is ``base``, ``each`` for each of the objective's terms in a row's text, and the points of ``extra`` (objective, ids, points). Rows that nothing
    of an objective touches score their base: their k best, by themselves, are enough. ``objectives`` (objective, term; a null term for an objective without any).
    With ``positive``, rows of score 0 are left out.
    """
    store = Rounds(rows.sparkSession)
    plain = store.save(rows.select(*ids, order, base.cast("int").alias("base")) if order not in ids else rows.select(*ids, base.cast("int").alias("base")))
    terms = objectives.where("term <> ''").distinct()
    gains = _hits(haystacks, terms, terms, ids).select("objective", *ids, (F.col("hits") * each).alias("points"))
    if extra is not None:
        gains = gains.unionByName(extra.select("objective", *ids, F.col("points").cast("long").alias("points")))
    touched = store.save(gains.groupBy("objective", *ids).agg(F.sum("points").alias("points")).join(plain, list(ids)).withColumn("score", (F.col("base") + F.col("points")).cast("int")).drop("points", "base"))
    spare = [r.asDict() for r in plain.orderBy(F.col("base").desc(), order).limit(k).collect()]
    all_ = touched
    if spare:
        kind = plain.schema
        options = F.explode(F.array(*[F.struct(*[F.lit(r[f.name]).cast(f.dataType).alias(f.name) for f in kind]) for r in spare])).alias("s")
        rest = objectives.select("objective").distinct().select("objective", options).select("objective", "s.*").withColumnRenamed("base", "score")
        all_ = touched.unionByName(rest.join(touched.select("objective", *ids), ["objective", *ids], "left_anti").select(touched.columns))
    if positive:
        all_ = all_.where("score > 0")
    return ranking.top_k(all_, ["objective"], [F.col("score").desc(), order], k).select("objective", *ids, "score", "rank")


def contract_map(objectives: DataFrame, corridor: DataFrame, contracts: DataFrame, consumers: DataFrame, evidence: DataFrame, failures: DataFrame, sides: DataFrame | None = None) -> DataFrame:
    """(objective, rank, id, score, name, kind, ..., consumers, evidence, failures with counts): the 12 contracts that matter most to each objective.

    ``objectives`` (objective, term), ``corridor`` (objective, path), ``contracts`` (pos, id, kind, name, file, symbol, verification, reconciliation, refs), with children
    ``consumers`` (id, n, file, symbol), ``evidence`` (id, n, kind, file, line, summary), ``failures`` (id, n, kind, summary). Conflicts come first, then contracts without a provider,
    then those whose ends lie in the corridor; a term in any of a contract's texts counts 10 (the text of its own fields, of a consumer, of a piece of evidence). Of equal ones the first by ``pos`` counts.

    Where many contracts share their consumers, ``sides`` (id, class) names the class of each contract, once, and ``consumers`` are those of classes
    (class, n, file, symbol): they are scored and counted once a class and not listed for each contract.

    Null names, files and summaries hold no term; contracts without children have empty lists. No objectives give no rows.
    """
    if sides is None:
        sides, consumers = contracts.select("id", F.col("id").alias("class")), consumers.withColumnRenamed("id", "class")
    terms = objectives.where("term <> ''").distinct()
    own = contracts.select("id", F.lower(F.concat_ws(" ", "name", "kind", "file", "symbol", "refs")).alias("text")).unionByName(evidence.select("id", F.lower("summary").alias("text")))
    used = consumers.select("class", F.lower(F.concat_ws(" ", "file", "symbol")).alias("text"))
    held = substrings.containing(own, terms, ["id"]).unionByName(substrings.containing(used, terms, ["class"]).join(sides, "class").select("id", "term")).distinct()
    points = held.join(terms, "term").groupBy("objective", "id").agg((10 * F.count("*")).alias("points"))
    sole = F.col("file").isNull() & (F.col("reconciliation") != "native-supplemented")
    base = F.lit(1) + F.when(F.col("reconciliation") == "native-conflict", 1000).when(sole, 200).otherwise(0) + F.when(F.col("verification") == "native-authoritative", 20).otherwise(0)
    at = corridor.select("objective", F.col("path").alias("file")).distinct()
    near = consumers.groupBy("class", "file").agg((100 * F.count("*")).alias("points")).join(at, "file").groupBy("objective", "class").agg(F.sum("points").alias("points"))
    ends = contracts.join(at, "file").select("objective", "id", F.lit(300).cast("long").alias("points")).unionByName(near.join(sides, "class").select("objective", "id", "points"))
    top = best(contracts, ["id"], base, own.limit(0), objectives, 0, points.unionByName(ends), CONTRACTS, "pos")
    out = top.join(contracts.select("id", "kind", text.bounded(F.col("name"), 240, False).alias("name"), "file", "symbol", "verification", "reconciliation"), "id")
    out = first_children(out.join(sides, "id", "left"), consumers, ["class"], ["n"], CONSUMERS, ("file", "symbol"), "consumers").drop("class")
    for rows, k, fields, name in ((evidence, EVIDENCE, ("kind", "file", "line", "summary"), "evidence"), (failures, FAILURES, ("kind", "summary"), "failures")):
        out = first_children(out, rows.withColumn("summary", text.bounded(F.col("summary"), 240, False)), ["id"], ["n"], k, fields, name)
    return out


def contract_counts(contracts: DataFrame) -> DataFrame:
    """one row: contracts, those without a provider and conflicts, with how many of each a projection returns."""
    sole = F.col("file").isNull() & (F.col("reconciliation") != "native-supplemented")
    c = contracts.agg(F.count("*").alias("contracts"), F.count_if(sole).alias("unresolved"), F.count_if(F.col("reconciliation") == "native-conflict").alias("conflicts"))
    least = lambda n, k: F.least(F.col(n), F.lit(k))
    return c.select("*", least("contracts", CONTRACTS).alias("returned"), least("unresolved", 8).alias("returned_unresolved"), least("conflicts", 8).alias("returned_conflicts"))


def runtime_regions(objectives: DataFrame, corridor: DataFrame, regions: DataFrame, files: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """F16: (objective, rank, region, score, nodes, edges with counts): the 8 runtime regions that matter most to each objective, two levels deep.

    ``regions`` (pos, region, reconciliation, said: effect kinds and contracts), ``files`` (region, file), ``nodes`` (region, id, file, symbol, effect_kind, detail, line), ``edges`` (region, id, kind, from, to).
    A file in the corridor counts 40, a term 3, a conflict 30, an unresolved region 10. A region's nodes are those in the corridor first, then by file and line.
    """
    told = nodes.select("region", F.concat_ws(" ", "file", "symbol", "effect_kind", "detail").alias("t")).distinct().unionByName(files.select("region", F.col("file").alias("t"))).unionByName(regions.select("region", F.col("said").alias("t")))
    # texts stay rows of their own, so a large region is no large text; a term counts once a region
    texts = told.where("t <> ''").select("region", F.xxhash64("t").alias("n"), F.lower("t").alias("text"))
    terms = objectives.where("term <> ''").distinct()
    hits = substrings.containing(texts, terms, ["region", "n"]).select("region", "term").distinct().join(terms, "term").groupBy("objective", "region").agg((3 * F.count("*")).alias("points"))
    at = corridor.select("objective", F.col("path").alias("file")).distinct()
    near = files.distinct().join(at, "file").groupBy("objective", "region").agg((40 * F.count("*")).alias("points"))
    base = F.when(F.col("reconciliation") == "native-conflict", 30).when(F.col("reconciliation") == "unresolved", 10).otherwise(0)
    blank = texts.select("region", "text").limit(0)
    top = best(regions, ["region"], base, blank, objectives, 0, hits.unionByName(near), REGIONS, "pos")
    own = top.select("objective", "region").join(nodes, "region").join(at.withColumn("in", F.lit(1)), ["objective", "file"], "left").withColumn("in", F.coalesce("in", F.lit(0)))
    links = top.select("objective", "region").join(edges.withColumnsRenamed({"from": "source", "to": "target"}), "region")
    out = first_children(top, own, ["objective", "region"], [F.col("in").desc(), "file", "line", "id"], MEMBERS, ("id", "file", "symbol", "line"), "nodes")
    return first_children(out, links, ["objective", "region"], ["id"], MEMBERS, ("id", "kind", "source", "target"), "edges")


def grants(segments: DataFrame, terms: DataFrame) -> DataFrame:
    """(objective, place, path, score, rank, why, gain): the 8 segments of each objective's pack that promise most, with the first reason that holds.

    ``segments`` (objective, place, path, names, evidence: arrays; contracts, runtime, consumers: counts), ``terms`` (objective, term). Null arrays and counts are empty.
    """
    empty, n = F.array().cast("array<string>"), lambda c: F.coalesce(F.col(c), F.lit(0))
    s = segments.withColumns({"names": F.coalesce("names", empty), "evidence": F.coalesce("evidence", empty)})
    words = terms.where("term <> ''").groupBy("objective").agg(F.collect_set("term").alias("terms"))  # as long as the objective
    hay = F.lower(F.concat_ws(" ", "path", F.array_join("names", " "), F.array_join("evidence", " ")))
    s = s.join(words, "objective", "left").withColumn("_hay", hay)
    lexical = 8 * F.size(F.filter(F.coalesce("terms", empty), lambda t: F.contains(F.col("_hay"), t)))
    score = lexical + F.least(F.lit(24), 4 * F.size("evidence")) + F.least(F.lit(28), 7 * n("runtime") + 6 * n("contracts")) + F.least(F.lit(12), 2 * n("consumers"))
    why = (F.when(n("runtime") > 0, "runtime/effect evidence intersects the active objective").when(n("contracts") > 0, "contract provider/consumer evidence intersects the active objective")
           .when(F.size("evidence") > 0, "direct certified repository evidence is available").when(n("consumers") > 0, "dependency consumers make this a plausible propagation surface").otherwise("corridor-certified source is available for bounded inspection"))
    top = ranking.top_k(s.withColumn("score", score.cast("int")).withColumn("why", why), ["objective"], [F.col("score").desc(), "place"], GRANTS)
    return top.select("objective", "place", "path", "score", "rank", "why", F.when(F.col("score") >= 50, "high").when(F.col("score") >= 24, "medium").otherwise("low").alias("gain"))


def native_contracts(objectives: DataFrame, corridor: DataFrame, entries: DataFrame) -> DataFrame:
    """(objective, record, pos, score, rank): the 8 entries of each native record that an objective touches.

    ``entries`` (record, pos, said: all texts of an entry). A term counts 2, a path of the corridor 20; entries of score 0 are left out.
    """
    hay = entries.select("record", "pos", F.lower("said").alias("text"))
    terms, at = objectives.where("term <> ''").distinct(), corridor.select("objective", F.lower("path").alias("term")).where("term <> ''").distinct()
    weighed = terms.withColumn("w", F.lit(2)).unionByName(at.withColumn("w", F.lit(20)))
    points = substrings.containing(hay, weighed, ["record", "pos"]).join(weighed, "term").groupBy("objective", "record", "pos").agg(F.sum("w").cast("int").alias("score"))
    return ranking.top_k(points, ["objective", "record"], [F.col("score").desc(), "pos"], NATIVE).select("objective", "record", "pos", "score", "rank")
