"""The analyzers of a repository's facts and their findings (E1-E9, E17-E19, I11, N1), and what a change reaches (I8)."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orefold.operators import graph, rollups
from orefold.plans import contracts, impact

# Fixed values (E7, E8): effects that mutate, and effects that are signals of a running program.
MUTATIONS = ("foundry-document", "embedded-documents", "settings", "canvas-token")
SIGNALS = ("hooks", "chat-output", "notifications", "application-lifecycle", "native-execution")


def _found(rows: DataFrame, code: str | Column, severity: str | Column, subject: Column, count: Column) -> DataFrame:
    col = lambda v: F.lit(v) if isinstance(v, str) else v
    return rows.select(col(code).alias("code"), col(severity).alias("severity"), subject.cast("string").alias("subject"), count.cast("long").alias("count"))


def dependency_graph(m: Mapping[str, DataFrame]) -> DataFrame:
    """Files of high fan-out (5 edges) and fan-in (4 edges), cycles, unresolved references within the repository."""
    e = m["dependencies"]
    out, into = e.groupBy(F.col("from").alias("f")).agg(F.count("*").alias("n")).where("n >= 5"), e.groupBy(F.col("to").alias("f")).agg(F.count("*").alias("n")).where("n >= 4")
    cycles = graph.strong_components(e).groupBy("component").agg(F.count("*").alias("n"), F.min("node").alias("f"))
    lost = m["unresolved"].where("not external")
    return (_found(out, "HIGH_FAN_OUT", "warning", F.col("f"), F.col("n")).unionAll(_found(into, "HIGH_FAN_IN", "info", F.col("f"), F.col("n")))
            .unionAll(_found(cycles, "DEPENDENCY_CYCLE", "warning", F.col("f"), F.col("n"))).unionAll(_found(lost, "UNRESOLVED_LOCAL_DEPENDENCY", "warning", F.concat_ws(":", "file", "specifier"), F.col("line"))))


def dependency_summary(m: Mapping[str, DataFrame]) -> DataFrame:
    """One row: files, edges, unresolved references within the repository and outside, cycles."""
    one = F.lit(True)
    lost = m["unresolved"].agg(F.count_if(~F.col("external")).alias("unresolved_local"), F.count_if("external").alias("external"))
    cycles = graph.strong_components(m["dependencies"]).agg(F.countDistinct("component").alias("cycles"))
    return m["files"].agg(F.count("*").alias("files")).join(m["dependencies"].agg(F.count("*").alias("edges")), one).join(lost, one).join(cycles, one)


def watersheds(m: Mapping[str, DataFrame]) -> DataFrame:
    """E4"""
    return _found(rollups.watersheds(m["dependencies"], m["effects"]), "DEPENDENCY_WATERSHED", "info", F.col("file"), F.col("score"))


def integration_surfaces(m: Mapping[str, DataFrame]) -> DataFrame:
    """E5"""
    return _found(rollups.integration(m["dependencies"], m["effects"], m["states"], m["symbols"].where("exported")), "INTEGRATION_SURFACE", "info", F.col("file"), F.col("score"))


def symbol_families(m: Mapping[str, DataFrame]) -> DataFrame:
    """E6"""
    spread = F.col("kind") == "distributed"
    return _found(rollups.families(m["symbols"]), F.when(spread, "DISTRIBUTED_SYMBOL_FAMILY").otherwise("SYMBOL_FAMILY"), F.when(spread, "warning").otherwise("info"), F.col("family"), F.col("members"))


def effect_atlas(m: Mapping[str, DataFrame]) -> DataFrame:
    """Each kind of effect, and again where it mutates in more than three files."""
    g = m["effects"].groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("file").alias("files"))
    return _found(g, "EFFECT_FAMILY", "info", F.col("kind"), F.col("n")).unionAll(_found(g.where(F.col("kind").isin(*MUTATIONS) & (F.col("files") > 3)), "DISTRIBUTED_MUTATION_EFFECT", "warning", F.col("kind"), F.col("n")))


def runtime_signals(m: Mapping[str, DataFrame]) -> DataFrame:
    """E8"""
    return _found(m["effects"].where(F.col("kind").isin(*SIGNALS)), "RUNTIME_SIGNAL", "info", F.concat_ws(":", "kind", "file"), F.col("line"))


def state_namespaces(m: Mapping[str, DataFrame]) -> DataFrame:
    """Each (kind, namespace, key): unresolved ones, ones that several files write, others."""
    write = F.col("access") == "write"
    g = m["states"].groupBy(F.concat_ws("|", "kind", "namespace", "key").alias("id")).agg(F.bool_or(~F.col("namespace_resolved") | ~F.col("key_resolved")).alias("open"), F.countDistinct(F.when(write, F.col("file"))).alias("writers"), F.count("*").alias("n"))
    many = F.col("writers") > 1
    return _found(g.where("open"), "UNRESOLVED_STATE_NAMESPACE", "warning", F.col("id"), F.col("n")).unionAll(_found(g, F.when(many, "MULTI_WRITER_STATE_SURFACE").otherwise("STATE_SURFACE"), F.when(many, "warning").otherwise("info"), F.col("id"), F.col("n")))


def contract_map(m: Mapping[str, DataFrame]) -> DataFrame:
    """E16, of the contracts of states and of any table "contracts" that the model holds."""
    c = m["contracts"] if "contracts" in m else contracts.state_contracts(m["states"])
    return contracts.findings(c).withColumn("count", F.lit(1).cast("long"))


def regions(nodes: DataFrame, edges: DataFrame, pairs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(regions, files): connected parts of the runtime graph with their kinds, counts and files.

    All nodes of a file belong together, so files are joined, not nodes; ``pairs`` (from, to) are files that contracts join. A
    region is named by its least file and is as sure as its strongest node.
    """
    at = nodes.select("id", "file").distinct()
    far = edges.join(at.toDF("from", "a"), "from").join(at.toDF("to", "b"), "to").where("a <> b").select(F.col("a").alias("from"), F.col("b").alias("to"))
    if pairs is not None:
        known = at.select("file").distinct()
        far = far.unionByName(pairs.select("from", "to").join(known.withColumnRenamed("file", "from"), "from", "left_semi").join(known.withColumnRenamed("file", "to"), "to", "left_semi").select("from", "to"))
    of = graph.components(far).withColumnsRenamed({"node": "file", "component": "r"})
    files = at.select("file").distinct().join(of, "file", "left").select("file", F.coalesce("r", "file").alias("region"))
    n = lambda *kinds: F.count_if(F.col("kind").isin(*kinds))
    g = nodes.join(files, "file").groupBy("region").agg(F.countDistinct("file").alias("files"), F.count("*").alias("nodes"), n("entry-point").alias("entry_points"), n("effect-sink", "integration-boundary").alias("terminal_effects"), n("observation-point").alias("observation_points"),
                                                        F.array_sort(F.collect_set(F.when(F.col("effect_kind") != "symbol-operation", F.col("effect_kind")))).alias("effect_kinds"), F.max((F.col("confidence") != "unresolved").cast("int")).alias("sure"))
    return g.withColumn("reconciliation", F.when(F.col("sure") == 1, "repository-confirmed").otherwise("unresolved")).drop("sure"), files


def runtime_coverage(nodes: DataFrame, effects: DataFrame, states: DataFrame) -> DataFrame:
    """One row: candidate sites (effects and states), classified and unresolved nodes, the share classified in percent."""
    n = nodes.agg(F.count_if(~F.col("kind").isin("unresolved-runtime-site", "runtime-operation")).alias("classified_sites"), F.count_if(F.col("kind") == "unresolved-runtime-site").alias("unresolved_sites"))
    c = effects.select("file").unionAll(states.select("file")).agg(F.count("*").alias("candidate_sites")).join(n, F.lit(True))
    return c.withColumn("coverage_percent", F.when(F.col("candidate_sites") == 0, 100).otherwise(F.floor(100 * F.col("classified_sites") / F.col("candidate_sites") + 0.5)).cast("int"))


def runtime_atlas(m: Mapping[str, DataFrame]) -> DataFrame:
    """Each region of the runtime graph; unresolved ones are warnings."""
    r, _ = regions(m["runtime_nodes"], m["runtime_edges"])
    lost = F.col("reconciliation") == "unresolved"
    return _found(r, F.when(lost, "UNRESOLVED_RUNTIME_REGION").otherwise("EFFECT_RUNTIME_REGION"), F.when(lost, "warning").otherwise("info"), F.col("region"), F.col("files"))


ANALYZERS: dict[str, Callable[[Mapping[str, DataFrame]], DataFrame]] = {
    "dependency-graph": dependency_graph, "dependency-watershed": watersheds, "integration-surface-atlas": integration_surfaces, "symbol-families": symbol_families, "effect-atlas": effect_atlas,
    "runtime-signal-map": runtime_signals, "state-namespaces": state_namespaces, "contract-map": contract_map, "effect-runtime-atlas": runtime_atlas}


def diagnose(m: Mapping[str, DataFrame], more: Mapping[str, Callable] | None = None) -> DataFrame:
    """(analyzer, code, severity, subject, count) of all analyzers; those of ``more`` add to them or take the place of their namesakes."""
    out = None
    for name, analyze in {**ANALYZERS, **(more or {})}.items():
        rows = analyze(m).select(F.lit(name).alias("analyzer"), "code", "severity", "subject", "count")
        out = rows if out is None else out.unionAll(rows)
    return out


def propagation_report(edges: DataFrame, changed: DataFrame, files: DataFrame, deltas: DataFrame, corridor: DataFrame, conflicts: DataFrame) -> DataFrame:
    """I8: (kind, value) of what a change reaches, and its gaps; without a gap row it is certified.

    ``changed`` (file), ``deltas`` (path, name, change) as from export_delta, ``corridor`` (file), ``conflicts`` (id): contracts in native
    conflict that the change touches. Removed exports and changed kinds break; consumers outside the corridor are then a gap.
    """
    say = lambda kind, rows, value: rows.select(F.lit(kind).alias("kind"), value.cast("string").alias("value"))
    reached = impact.propagation(edges, changed)
    outside = reached.join(corridor.select("file").distinct(), "file", "left_anti")
    breaking = deltas.where("change <> 'added'").select(F.lit(1).alias("b")).limit(1)
    gap = outside.limit(1).join(breaking, F.lit(True)).select(F.lit("Breaking exported-contract changes reach consumers outside the certified corridor.").alias("g"))
    absent = changed.join(files.select(F.col("path").alias("file")), "file", "left_anti")
    return (say("immediate", reached.where("hops = 1"), F.col("file")).unionAll(say("transitive", reached, F.col("file"))).unionAll(say("outside", outside, F.col("file"))).unionAll(say("delta", deltas, F.concat_ws(":", "path", "name", "change")))
            .unionAll(say("gap", gap, F.col("g"))).unionAll(say("gap", conflicts, F.concat(F.lit("native conflict "), F.col("id")))).unionAll(say("gap", absent, F.concat(F.lit("absent "), F.col("file")))))
