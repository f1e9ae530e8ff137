"""Runtime probes for the clauses of corridors, and native contracts that name a region's paths."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orefold.functions import text
from orefold.operators import ranking, substrings
from orefold.operators.graph import Rounds

#: Fixed values (I9, I14): probes of a clause, symbols of a file that become probes, hints of a region.
PROBES, SYMBOLS, HINTS = 8, 3, 6
UNCERTAIN, UNSEEN = "clause is not corridor-certified", "no safe static observer candidate"


def _said(**values: Column) -> Column:
    """Evidence: the values by name, as text; null ones have no entry."""
    return F.map_filter(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("string"))]), lambda _, v: v.isNotNull())


def _slugged(prefix: str | Column, *parts: Column) -> Column:
    return F.concat(F.lit(prefix) if isinstance(prefix, str) else prefix, F.lit("-"), text.slug(F.concat_ws("-", *[p.cast("string") for p in parts])))


def _first(rows: DataFrame, group: str) -> DataFrame:
    """The rows of a group's first PROBES ids, the last of each id (by file, kind of fact, line and what it says). Tasks keep these ids alone before they shuffle."""
    some = rows.withColumn("_n", F.dense_rank().over(Window.partitionBy(group).orderBy("id"))).where(F.col("_n") <= PROBES)
    order = [F.col(k).desc() for k in ("path", "g", "line", "node", "effect", "namespace", "key", "what", "symbol")]
    return some.withColumn("_n", F.row_number().over(Window.partitionBy(group, "id").orderBy(*order))).where("_n = 1").drop("_n")


def _told(rows: DataFrame) -> DataFrame:
    """Probes with their label and evidence, made of the facts that they come from: effects, states, symbols, nodes (``g`` 0 to 3), or none."""
    c, where = F.col, F.concat(F.lit(" at "), "path", F.lit(":"), "line")
    label = (F.when(c("g") == 0, F.concat("what", where)).when(c("g") == 1, F.concat("what", F.lit(" "), "namespace", F.lit("."), "key")).when(c("g") == 2, F.concat_ws(" ", "role", "symbol"))
             .when(c("g") == 3, F.concat("role", F.lit(": "), "what", where)).otherwise(c("what")))
    evidence = _said(runtimeNodeId=c("node"), runtimeRegionIds=c("regions"), effectKind=c("effect"), role=F.when(c("g") == 3, c("role")), reconciliation=c("state"), namespace=c("namespace"), key=c("key"), operation=c("operation"),
                     symbol=c("symbol"), line=c("line"), exported=c("exported"), reason=c("reason"))
    return rows.withColumns({"label": label, "evidence": evidence})


def probes(clauses: DataFrame, m: Mapping[str, DataFrame], regions: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(probes, objectives) for all clauses in one plan.

    ``clauses``: (clause, said, owner, path: array of files, complete, terms: array). The probes of a complete clause are the effects and
    states of its files, the first three symbols of each file whose name holds one of the clause's terms, and the runtime nodes that are
    neither operations nor unresolved; of probes with one id the last counts, and the first eight ids stay. ``regions`` (region, node) name the regions of
    runtime nodes. A clause without any has one manual probe.

    probes: (id, clause, kind, path, label, evidence), each id once: that of the last clause. objectives: (clause, said, probe_ids, status).
    Symbols and terms meet through an index of grams, so a thousand clauses are one plan, not a thousand columns. Files without facts give no
    probes. Null terms and paths are left out; repeated clause ids count once. No clauses give no rows.

    Rows are the bare facts until the end: labels and evidence, which are far wider, are made only of the probes that stay.
    """
    store = Rounds(clauses.sparkSession)
    asked = store.save(clauses.select("clause", "said", "owner", "path", F.coalesce("complete", F.lit(False)).alias("complete"), "terms").dropDuplicates(["clause"]))
    nothing = F.array().cast("array<string>")
    files = F.array_compact(F.array_append(F.coalesce("path", nothing), F.col("owner")))
    at = store.save(asked.where("complete").select("clause", F.explode(F.array_distinct(files)).alias("path")).where("path <> ''"))
    c = F.col
    e = m["effects"].select(c("file").alias("path"), c("kind").alias("effect"), c("detail").alias("what"), "line", "symbol")
    hook = F.when(c("effect") == "hooks", "hook").otherwise("effect")
    facts = e.select("path", F.lit(0).alias("g"), hook.alias("kind"), _slugged(hook, c("path"), c("effect"), c("line")).alias("id"), "line", "effect", "what", "symbol")
    s = m["states"].select(c("file").alias("path"), "namespace", "key", c("access").alias("what"), "operation", "line")
    s = s.select("path", F.lit(1).alias("g"), F.lit("state").alias("kind"), _slugged("state", c("path"), c("namespace"), c("key"), c("line")).alias("id"), "line", "namespace", "key", "what", "operation")
    facts = facts.unionByName(s, allowMissingColumns=True)
    terms = store.save(asked.where("complete").select("clause", F.explode("terms").alias("term")).where("term <> ''").distinct())
    names = store.save(m["symbols"].select("file", "name", "kind", "line", "exported", F.lower("name").alias("low")).withColumnRenamed("file", "path"))
    named = substrings.containing(names.select("low").distinct(), terms, ["low"], "low").join(terms, "term").select("clause", "low").distinct()
    y = names.join(at, "path").join(named, ["clause", "low"])
    y = ranking.top_k(y, ["clause", "path"], ["line", "name"], SYMBOLS)
    y = y.select("clause", "path", F.lit(2).alias("g"), F.lit("symbol").alias("kind"), _slugged("symbol", c("path"), c("name")).alias("id"), "line", c("kind").alias("role"), c("name").alias("symbol"), "exported")
    nodes = m["runtime_nodes"].where("effect_kind <> 'symbol-operation'")
    state = c("reconciliation") if "reconciliation" in nodes.columns else F.when(c("confidence") == "unresolved", "unresolved").otherwise("repository-confirmed")
    nodes = nodes.withColumn("state", state).where("state <> 'unresolved'").select("file", "id", c("kind").alias("sort"), "effect_kind", "detail", c("line_start").alias("line"), "state")
    inside = (regions.groupBy(c("node").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("region")), ",").alias("regions")) if regions is not None else nodes.select("id", F.lit(None).cast("string").alias("regions")).limit(0))
    n = nodes.join(inside, "id", "left").withColumnRenamed("id", "node")
    kind = F.when((c("sort") == "entry-point") & (c("effect_kind") == "hooks"), "hook").otherwise("effect")
    n = n.select(c("file").alias("path"), F.lit(3).alias("g"), kind.alias("kind"), _slugged("effect", c("node")).alias("id"), "line", "node", "regions", c("effect_kind").alias("effect"), c("sort").alias("role"), "state", c("detail").alias("what"))
    # ids of a file's facts are the same for all clauses, so a file gives each clause no more than the clause keeps
    facts = _first(facts.unionByName(n, allowMissingColumns=True), "path").join(at, "path")
    chosen = store.save(_first(facts.unionByName(y, allowMissingColumns=True), "clause"))
    found = chosen.groupBy("clause").agg(F.array_sort(F.collect_list("id")).alias("probe_ids"))  # eight at most
    goals = asked.join(found, "clause", "left")
    manual = F.concat(F.lit("manual-"), "clause")
    by_hand = goals.where("probe_ids is null").select("clause", manual.alias("id"), F.lit("manual").alias("kind"), c("owner").alias("path"), F.lit(4).alias("g"), F.concat(F.lit("Manual observation required: "), "said").alias("what"), F.when(c("complete"), UNSEEN).otherwise(UNCERTAIN).alias("reason"))
    every = chosen.unionByName(by_hand, allowMissingColumns=True)
    last = F.row_number().over(Window.partitionBy("id").orderBy(F.length("clause").desc(), c("clause").desc()))
    unique = _told(every.withColumn("_n", last).where("_n = 1")).select("id", "clause", "kind", "path", "label", "evidence")
    objectives = goals.select("clause", "said", F.coalesce("probe_ids", F.array(manual)).alias("probe_ids"), F.when(c("probe_ids").isNull(), "manual").otherwise("instrumented").alias("status"))
    kept = store.save(objectives)
    return store.finish_all(unique, kept)[0], kept


def native_hints(regions: DataFrame, paths: DataFrame, records: DataFrame) -> DataFrame:
    """(region, rank, hint): the first six native records, in order, whose serialized data name one of a region's paths; a repository's are the first of all.

    ``regions`` (region, kind), ``paths`` (region, path), ``records`` (pos, id, source, serialized). All regions are asked at once through
    an index of grams. Regions without paths have no hints unless they are the repository; null paths and data hold nothing.
    """
    found = substrings.containing(records, paths.where("path <> ''"), ["pos"], "serialized", "path").withColumnRenamed("term", "path")
    plain = paths.join(regions.where("kind <> 'repository'").select("region"), "region", "left_semi").select("region", "path").distinct()
    hits = found.join(plain, "path").select("region", "pos").distinct()
    first = [r.pos for r in records.select("pos").orderBy("pos").limit(HINTS).collect()]
    if first:
        hits = hits.unionByName(regions.where("kind = 'repository'").select("region", F.explode(F.array(*[F.lit(p) for p in first])).alias("pos")))
    top = ranking.top_k(hits, ["region"], ["pos"], HINTS)
    return top.join(records.select("pos", F.concat("id", F.lit(" ("), "source", F.lit(")")).alias("hint")), "pos").select("region", "rank", "hint")
