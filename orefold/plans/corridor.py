"""Which files an objective is about: relevance, owners of clauses, the corridor between them, its stages."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orefold.functions import text
from orefold.operators import graph, ranking, substrings

#: Weights of what may hold a term (I1): a file's path, symbols, effects, states, references, and its whole text.
WEIGHTS = {"path": 6, "symbols": 5, "effects": 4, "states": 4, "references": 2, "text": 1}


def clauses_of(spark: SparkSession, objective: str, stop: Sequence[str] = text.PLAN_STOP) -> list[tuple[str, str, list[str]]]:
    """(id, clause, terms) of an objective; what comes to the driver is as long as the objective."""
    c = F.posexplode(text.clauses(F.lit(objective))).alias("n", "c")
    rows = spark.range(1).select(c).select("n", "c", text.terms(F.col("c"), stop).alias("t")).orderBy("n").collect()
    return [(f"clause-{r.n + 1}", r.c, list(r.t)) for r in rows]


def haystacks(m: Mapping[str, DataFrame]) -> DataFrame:
    """(path, h_<field>..., incoming, outgoing): the normalized texts of each file's fields, and its degrees."""
    joined = lambda rows, *cols: rows.groupBy(F.col("file").alias("path")).agg(F.concat_ws(" ", F.collect_list(F.concat_ws(" ", *cols))).alias("h"))
    own = {"symbols": joined(m["symbols"], "name"), "effects": joined(m["effects"], "kind", "detail", "symbol"), "states": joined(m["states"], "namespace", "key", "operation"), "references": joined(m["references"], "specifier")}
    out = m["files"].where("text is not null").select("path", text.normalize(F.col("path")).alias("h_path"), text.normalize(F.col("text")).alias("h_text"))
    for name, rows in own.items():
        out = out.join(rows.select("path", text.normalize(F.col("h")).alias(f"h_{name}")), "path", "left")
    e = m["dependencies"]
    for name, end in (("incoming", "to"), ("outgoing", "from")):
        out = out.join(e.groupBy(F.col(end).alias("path")).agg(F.count("*").alias(name)), "path", "left")
    return out.fillna("").fillna(0, ["incoming", "outgoing"])


def hits(column: Column, terms: Sequence[str], weight: int | Column) -> Column:
    """The weight for each term that a text holds, and 1 more for terms of seven letters or more."""
    return sum((F.when(F.contains(column, F.lit(t)), F.lit(weight) + int(len(t) >= 7)).otherwise(0) for t in terms), F.lit(0))


def boost(rows: DataFrame, terms: Sequence[str], most: int | None = None) -> DataFrame:
    """(path, boost): the weights of evidence rows (path, said, weight) for each term that they hold, up to ``most``."""
    found = sum((F.when(F.contains(text.normalize(F.col("said")), F.lit(t)), F.col("weight")).otherwise(0) for t in terms), F.lit(0))
    g = rows.groupBy("path").agg(F.sum(found).alias("boost"))
    return g.withColumn("boost", F.least(F.lit(most), "boost")) if most is not None else g


def runtime_evidence(nodes: DataFrame) -> DataFrame:
    """I4: evidence rows of runtime nodes: 3 for entry points, sinks and boundaries, else 1; at most 12 a file count."""
    return nodes.select(F.col("file").alias("path"), F.concat_ws(" ", "effect_kind", "symbol", "detail").alias("said"), F.when(F.col("kind").isin("entry-point", "effect-sink", "integration-boundary"), 3).otherwise(1).alias("weight"))


def contract_evidence(contracts: DataFrame, endpoints: DataFrame, terms: Sequence[str]) -> DataFrame:
    """(path, boost): 5 (8 where verified by a native entry) for the provider's file of each contract (id, said, verification) that holds a term, 4 for consumers' files; ``endpoints`` (id, path, role)."""
    about = contracts.where(hits(text.normalize(F.col("said")), terms, 1) > 0).select("id", "verification")
    e = endpoints.select("id", "path", (F.col("role") == "provider").alias("p")).distinct().join(about, "id")
    return e.groupBy("path").agg(F.sum(F.when(~F.col("p"), 4).when(F.col("verification") == "native-authoritative", 8).otherwise(5)).alias("boost"))


def scores(stacks: DataFrame, terms: Sequence[str], always: Sequence[DataFrame] = (), where_found: Sequence[DataFrame] = ()) -> DataFrame:
    """(path, score): weighted hits of all fields, up to 4 and 3 for degrees, boosts (path, boost); ``where_found`` ones only with a hit."""
    s = stacks.select("path", sum((hits(F.col(f"h_{n}"), terms, w) for n, w in WEIGHTS.items()), F.lit(0)).alias("hits"), (F.least(F.lit(4), "incoming") + F.least(F.lit(3), "outgoing")).alias("degrees"))
    total = F.col("hits") + F.col("degrees")
    for i, b in enumerate([*always, *where_found]):
        s = s.join(b.select("path", F.col("boost").alias(f"b{i}")), "path", "left")
        gained = F.coalesce(f"b{i}", F.lit(0))
        total = total + (gained if i < len(always) else F.when(F.col("hits") > 0, gained).otherwise(0))
    return s.select("path", total.cast("int").alias("score"))


def terms_of(texts: DataFrame, stop: Sequence[str] = text.PLAN_STOP) -> DataFrame:
    """(clause, term) of rows (clause, said)."""
    return texts.select("clause", F.explode(text.terms(F.col("said"), stop)).alias("term"))


class Evidence(NamedTuple):
    """What else speaks for files (I2-I5): a certified trace, contracts, runtime nodes, a certified slice; None where there is none.

    ``hops`` (place, file, symbol), ``blocker`` and ``terminal`` (file, said), ``contracts`` (id, name, said, verification, reconciliation) with ``endpoints`` (id,
    path, role), ``runtime`` (file, effect_kind, symbol, detail, kind), ``flow`` (file, symbol, kind, end: whether a source or sink).
    """

    hops: DataFrame | None = None
    blocker: DataFrame | None = None
    terminal: DataFrame | None = None
    contracts: DataFrame | None = None
    endpoints: DataFrame | None = None
    runtime: DataFrame | None = None
    flow: DataFrame | None = None


def _gains(rows: DataFrame, clauses: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(clause, path, gain): the weights of evidence rows (path, said, weight) for each of the clause's terms that they hold."""
    rows = keep(rows.select("path", text.normalize(F.col("said")).alias("text"), "weight").withColumn("id", F.xxhash64("path", "text", "weight")).groupBy("id", "path", "text", "weight").agg(F.count("*").alias("n")))
    found = substrings.containing(rows, clauses, ["id"]).join(clauses, "term")
    return found.join(rows.select("id", "path", F.col("weight") * F.col("n")).toDF("id", "path", "w"), "id").groupBy("clause", "path").agg(F.sum("w").alias("gain"))


def clause_scores(stacks: DataFrame, clauses: DataFrame, evidence: Evidence = Evidence(), keep: Callable[[DataFrame], DataFrame] = lambda t: t, spare: int = 4) -> DataFrame:
    """I1-I5 for many clauses (clause, term) in one plan: (clause, path, score) of the files that something speaks for, and of the ``spare`` ones of the highest degrees.

    A file that nothing speaks for scores its degrees alone, so no other one can be among a clause's ``spare`` best. Terms and texts
    meet through an index of their grams, not file by file. I3: a slice's files gain 3 if a source or sink lies in them, else 1, and 4 for each term, at
    most 12. I4: at most 12. Both count only with a hit in the file's own texts.
    """
    c = keep(clauses.where("clause is not null and term <> ''").select("clause", "term").distinct())
    fields = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.lit(w).alias("weight"), F.col(f"h_{n}").alias("text")) for n, w in WEIGHTS.items()])).alias("f")
    texts = keep(stacks.select("path", fields).select("path", "f.*").where("text <> ''"))
    found = substrings.containing(texts, c, ["path", "field"]).join(c, "term")
    weight = F.create_map(*[F.lit(x) for pair in WEIGHTS.items() for x in pair])[F.col("field")]
    out = found.groupBy("clause", "path").agg(F.sum(weight + (F.length("term") >= 7).cast("int")).alias("hits")).select("clause", "path", "hits", F.lit(0).alias("always"), F.lit(0).alias("runtime"), F.lit(0).alias("flow"))
    gained = []
    if evidence.hops is not None:
        hops = evidence.hops.groupBy("file").agg(F.concat_ws(" ", F.collect_list("symbol")).alias("said"))
        rows = hops.select(F.col("file").alias("path"), "said", F.lit(6).alias("weight")).unionByName(hops.select(F.col("file").alias("path"), F.col("file").alias("said"), F.lit(3).alias("weight")))
        on_path = hops.select(F.col("file").alias("path"))
        for end in (evidence.blocker, evidence.terminal):
            if end is not None:
                rows = rows.unionByName(end.select(F.col("file").alias("path"), "said", F.lit(4).alias("weight")).join(on_path, "path", "left_semi"))
        gained.append(("always", rows, None))
    if evidence.runtime is not None:
        gained.append(("runtime", runtime_evidence(evidence.runtime), 12))
    if evidence.flow is not None:
        flow = evidence.flow.groupBy("file").agg(F.concat_ws(" ", F.collect_list(F.concat_ws(" ", "symbol", "kind"))).alias("said"), F.max(F.when(F.col("end"), 3).otherwise(1)).alias("base"))
        gained.append(("flow", flow.select(F.col("file").alias("path"), F.concat_ws(" ", "file", "said").alias("said"), F.lit(4).alias("weight")), 12))
    for name, rows, most in gained:
        g = _gains(rows, c, keep).withColumn("gain", F.least(F.lit(most), "gain") if most else F.col("gain"))
        out = out.unionByName(g.select("clause", "path", F.lit(0).alias("hits"), *[(F.col("gain") if n == name else F.lit(0)).alias(n) for n in ("always", "runtime", "flow")]))
    if evidence.contracts is not None:
        said = keep(evidence.contracts.select("id", "verification", text.normalize(F.col("said")).alias("text")))
        about = substrings.containing(said, c, ["id"]).join(c, "term").select("clause", "id").distinct().join(said.select("id", "verification"), "id")
        e = evidence.endpoints.select("id", "path", (F.col("role") == "provider").alias("p")).distinct().join(about, "id")
        worth = F.when(~F.col("p"), 4).when(F.col("verification") == "native-authoritative", 8).otherwise(5)
        out = out.unionByName(e.groupBy("clause", "path").agg(F.sum(worth).alias("always")).select("clause", "path", F.lit(0).alias("hits"), "always", F.lit(0).alias("runtime"), F.lit(0).alias("flow")))
    degrees = stacks.select("path", (F.least(F.lit(4), "incoming") + F.least(F.lit(3), "outgoing")).alias("degrees"))
    s = out.groupBy("clause", "path").agg(*[F.sum(n).alias(n) for n in ("hits", "always", "runtime", "flow")]).join(degrees, "path")
    if evidence.flow is not None:
        s = s.join(flow.select(F.col("file").alias("path"), "base"), "path", "left").withColumn("flow", F.when(F.col("base").isNotNull(), F.least(F.lit(12), F.col("flow") + F.col("base"))).otherwise(0))
    scored = keep(s.select("clause", "path", (F.col("hits") + F.col("degrees") + F.col("always") + F.when(F.col("hits") > 0, F.col("runtime") + F.col("flow")).otherwise(0)).cast("int").alias("score")))
    best = degrees.orderBy(F.col("degrees").desc(), "path").limit(spare).collect()
    if not best:
        return scored
    spared = F.explode(F.array(*[F.struct(F.lit(b.path).alias("path"), F.lit(b.degrees).cast("int").alias("score")) for b in best])).alias("b")
    return scored.unionByName(c.select("clause").distinct().select("clause", spared).select("clause", "b.*").join(scored, ["clause", "path"], "left_anti"))


def owners(scored: DataFrame, least: int = 4, margin: int = 2) -> DataFrame:
    """(clause, path, score, runner_up, owned, candidates): the best file of each clause, whether it owns it, and the four best; ``scored`` (clause, path, score)."""
    top = ranking.top_k(scored.where("score > 0"), ["clause"], [F.col("score").desc(), "path"], 4)
    at = lambda r, c: F.max(F.when(F.col("rank") == r, F.col(c)))
    g = top.groupBy("clause").agg(at(1, "path").alias("path"), at(1, "score").alias("score"), at(2, "score").alias("runner_up"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "path"))), lambda x: x["path"]).alias("candidates"))
    return g.withColumn("owned", (F.col("score") >= least) & (F.col("runner_up").isNull() | (F.col("score") >= F.col("runner_up") + margin)))


def anchors(symbols: DataFrame, terms: Sequence[str], k: int = 8) -> DataFrame:
    """the k best symbols of each file: 4 for each term in the name, 1 for an exported one; others have none."""
    s = symbols.withColumn("score", (sum((F.when(F.contains(text.normalize(F.col("name")), F.lit(t)), 4).otherwise(0) for t in terms), F.lit(0)) + F.col("exported").cast("int")).cast("int"))
    return ranking.top_k(s.where("score > 0"), ["file"], [F.col("score").desc(), "line", "name"], k)


def traced(hops: DataFrame, start: Column, end: Column) -> DataFrame:
    """The files of a certified trace (place, file) between the first places of two files, each once, in order."""
    first = hops.groupBy("file").agg(F.min("place").alias("p"))
    ends = first.agg(F.min(F.when(F.col("file") == start, F.col("p"))).alias("a"), F.min(F.when(F.col("file") == end, F.col("p"))).alias("b"))
    low, high = F.least("a", "b"), F.greatest("a", "b")
    return hops.join(ends, F.lit(True)).where(F.col("a").isNotNull() & F.col("b").isNotNull() & F.col("place").between(low, high)).groupBy("file").agg(F.min("place").alias("place"))


class Plan(NamedTuple):
    """A corridor's clauses, files, summary (one row) and gaps."""

    clauses: DataFrame
    files: DataFrame
    summary: DataFrame
    gaps: DataFrame


BLOCKS = "Contract Map native conflict blocks "


def plan(spark: SparkSession, objective: str, m: Mapping[str, DataFrame], *, stop: Sequence[str] = text.PLAN_STOP, most_files: int = 16, evidence: Evidence | None = None) -> Plan:
    """(clauses, files, summary, gaps) of an objective's corridor.

    Each clause is owned by the file that leads in its score; the files between the first owner and the others, along a
    certified trace that holds both, else on the shortest way, belong to the corridor, which keeps the ``most_files`` best, scored by all terms of the objective. A
    clause without an owner is a gap, and so is a native conflict among relevant contracts that touch the corridor. E32: a corridor
    without gaps is certified, and sure if all its files have half of the score that counts. ``evidence`` defaults to the model's runtime nodes.

    An empty objective has no clauses, no files and a gap. A model without files gives clauses without owners.
    """
    r = graph.Rounds(spark)
    evidence = Evidence(runtime=m["runtime_nodes"]) if evidence is None else evidence
    parts = clauses_of(spark, objective, stop)
    stacks = r.save(haystacks(m))
    every = [r_[0] for r_ in spark.range(1).select(F.explode(text.terms(F.lit(objective), stop))).collect()]  # as long as the objective
    terms = spark.createDataFrame([(n, t) for n, _, ts in parts for t in ts] + [("", t) for t in every], "clause string, term string")
    by_clause = r.save(clause_scores(stacks, terms, evidence, r.save))
    found = r.save(owners(by_clause.where("clause <> ''")))
    known = spark.createDataFrame([(n, c, ts) for n, c, ts in parts], "clause string, said string, terms array<string>")
    clauses = known.join(found, "clause", "left").withColumn("owner", F.when(F.col("owned"), F.col("path")))
    clauses = r.save(clauses.select("clause", "said", "terms", "owner", F.coalesce("score", F.lit(0)).alias("score"), F.coalesce("owned", F.lit(False)).alias("complete"), F.coalesce("candidates", F.array().cast("array<string>")).alias("candidates")))
    anchor = clauses.where("owner is not null").orderBy(F.length("clause"), "clause").select("owner").first()
    ways = clauses.where("owner is not null").select(F.col("owner").alias("path"), F.col("owner").alias("node"), F.lit(True).alias("own"))
    if anchor is not None:
        mine = r.save(ways.select("node").distinct())
        short = graph.shortest_paths(m["dependencies"], anchor.owner, mine).join(mine, "node").select(F.explode("path").alias("path"), "node")
        if evidence.hops is not None:
            first = r.save(evidence.hops.groupBy("file").agg(F.min("place").alias("p")))
            since = first.where(F.col("file") == anchor.owner).select("p").first()
            ends = first.join(mine.withColumnRenamed("node", "file"), "file").select(F.col("file").alias("node"), F.col("p").alias("b"), F.lit(since.p if since else None).cast("int").alias("a"))
            traced_ = evidence.hops.select("file", "place").join(F.broadcast(ends), F.col("place").between(F.least("a", "b"), F.greatest("a", "b"))).where(F.col("node") != anchor.owner).select(F.col("file").alias("path"), "node").distinct()
            short = short.join(traced_.select("node").distinct(), "node", "left_anti").unionByName(traced_)
        ways = ways.unionByName(short.select("path", "node", (F.col("path") == F.col("node")).alias("own"))).groupBy("path", "node").agg(F.bool_or("own").alias("own"))
    ways = r.save(ways)
    held = clauses.where("owner is not null").select("clause", F.col("owner").alias("node")).join(ways, "node")
    role = F.concat("clause", F.when(F.col("own"), ": owner").otherwise(": dependency path"))
    reasons = held.groupBy("path").agg(F.array_sort(F.collect_set(F.struct(F.length("clause").alias("n"), F.lit(0).alias("k"), role.alias("said")))).alias("why"))
    mine = ways.select("path").distinct()
    whole = by_clause.where("clause = ''").select("path", "score")
    degrees = stacks.select("path", (F.least(F.lit(4), "incoming") + F.least(F.lit(3), "outgoing")).alias("degrees"))
    scored = mine.join(degrees, "path").join(whole, "path", "left").select("path", F.coalesce("score", "degrees").cast("int").alias("score"))
    files = scored.orderBy(F.col("score").desc(), "path").limit(max(1, min(32, most_files))).withColumn("confidence", text.confidence(F.col("score")))
    files = files.join(reasons, "path", "left")
    contracts = spark.createDataFrame([], "path string, id string, name string, reconciliation string, failures string")
    if evidence.contracts is not None and every:
        c = evidence.contracts.withColumn("failures", F.col("failures") if "failures" in evidence.contracts.columns else F.lit(""))
        about = substrings.containing(c.select("id", text.normalize(F.col("said")).alias("text")), terms.where("clause = ''"), ["id"]).select("id").distinct()
        contracts = r.save(c.join(about, "id", "left_semi").join(evidence.endpoints.select("id", "path").distinct(), "id").select("path", "id", "name", "reconciliation", "failures"))
    by_file = contracts.groupBy("path").agg(F.array_sort(F.collect_set("id")).alias("contract_ids"), F.array_sort(F.collect_set(F.concat(F.lit("Contract Map "), "reconciliation", F.lit(": "), "name"))).alias("told"))
    marks = [(evidence.hops, "certified Trace lineage"), (evidence.flow, "certified Dataflow Slice lineage")]
    files = files.join(by_file, "path", "left")
    said = F.transform("why", lambda w: w["said"])
    for rows, mark in marks:
        if rows is not None:
            files = files.join(rows.select(F.col("file").alias("path"), F.array(F.lit(mark)).alias("mark")).distinct(), "path", "left")
            said = F.concat(said, F.coalesce("mark", F.array().cast("array<string>")))
            files = files.withColumn("why", F.transform(said, lambda x: F.struct(F.lit(0).alias("n"), F.lit(0).alias("k"), x.alias("said")))).drop("mark")
            said = F.transform("why", lambda w: w["said"])
    empty = F.array().cast("array<string>")
    files = r.save(files.select("path", "score", "confidence", F.concat(F.coalesce(said, empty), F.coalesce("told", empty)).alias("reasons"), F.coalesce("contract_ids", empty).alias("contract_ids")))
    gaps = clauses.where("not complete").select(F.concat("clause", F.when(F.size("candidates") > 0, ": owner evidence remained ambiguous").otherwise(": no repository evidence matched the clause")).alias("gap"))
    conflicts = contracts.where("reconciliation = 'native-conflict'").join(files.select("path"), "path", "left_semi").select("id", "name", "failures").distinct()
    gaps = gaps.unionByName(conflicts.select(F.concat(F.lit(BLOCKS), "name", F.lit(": "), "failures").alias("gap")))
    n = clauses.agg(F.count("*").alias("clauses"), F.count_if("complete").alias("covered")).first()
    f = files.agg(F.count("*").alias("n"), F.bool_and(F.col("confidence") >= 0.5).alias("sure")).first()
    touched = contracts.join(files.select("path"), "path", "left_semi").agg(F.count_distinct("id")).first()[0] if evidence.contracts is not None else 0
    more = [g for g, missing in (("objective contains no behavioral clause", n.clauses == 0), ("no repository-model path could be certified", f.n == 0)) if missing]
    gaps = r.save(gaps.unionByName(spark.createDataFrame([(g,) for g in more], "gap string")))
    certified = n.clauses > 0 and n.clauses == n.covered and f.n > 0 and gaps.isEmpty()
    summary = spark.createDataFrame([(n.clauses, n.covered, f.n, touched, certified, "incomplete" if not certified else "high" if f.sure else "medium")], "clause_count long, covered_count long, file_count long, contract_count long, certified boolean, confidence string")
    return Plan(clauses, files, summary, gaps)


def stages(files: DataFrame, dependencies: DataFrame, most_files: int = 1) -> DataFrame:
    """(path, phase, batch, cyclic) of a corridor's files: providers come in earlier phases, files of one cycle in one phase."""
    r = graph.Rounds(dependencies.sparkSession)
    ends = lambda end: files.select(F.col("path").alias(end)).hint("merge")
    inner = r.save(dependencies.select("from", "to").where("from <> to").distinct().join(ends("from"), "from", "left_semi").join(ends("to"), "to", "left_semi").select("from", "to"))
    found = r.save(graph.strong_components(inner))
    level = graph.levels(inner, named=found).withColumnRenamed("node", "path").hint("merge")
    cyclic = found.select(F.col("node").alias("path"), F.lit(True).alias("cyclic")).hint("merge")
    rows = files.select("path").join(level, "path", "left").join(cyclic, "path", "left").select("path", (F.coalesce("level", F.lit(0)) + 1).alias("phase"), F.coalesce("cyclic", F.lit(False)).alias("cyclic"))
    return ranking.stages(rows, "phase", ["path"], most_files).withColumnRenamed("stage", "batch")
