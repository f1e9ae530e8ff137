"""Guarded edits and the predicates over runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orefold.functions import paths, text
from orefold.operators.ranking import top_k

# Fixed values (L10): words in a stage's name and the class of its failure, the first match counts.
FAILURES = (
    ("promotion_failure", ("promot", "publish", "commit")),
    ("validation_failure", ("validat", "validate", "test", "audit", "diff")),
    ("propagation_failure", ("propagat",)),
    ("planning_failure", ("corridor", "context", "plan")),
    ("mutation_failure", ("mutat", "patch")),
)
OTHER_FAILURE = "native_execution_failure"


def edit_violations(edits: DataFrame, files: DataFrame, granted: DataFrame) -> DataFrame:
    """K2, K3, L3: (path, code): edits of paths outside the granted prefixes, of missing files, or of other contents than expected.

    ``edits`` (path, expected_sha), ``files`` (path, sha), ``granted`` (prefix). Grants meet a path's own prefixes in an
    equi-join, so many grants are no loop over all paths.
    """
    keys = F.array_append(paths.prefixes(F.col("path"), None), F.col("path"))
    e = edits.select("path", "expected_sha").distinct()
    ok = e.select("path", F.explode(keys).alias("prefix")).join(granted.distinct(), "prefix", "left_semi").select("path").distinct().withColumn("ok", F.lit(True))
    j = e.join(ok, "path", "left").join(files.select("path", "sha"), "path", "left")
    codes = F.array_compact(F.array(
        F.when(F.col("ok").isNull(), "OUT_OF_SCOPE"), F.when(F.col("sha").isNull(), "MISSING_FILE"),
        F.when(F.col("sha") != F.col("expected_sha"), "STALE_CONTENT")))
    return j.select("path", F.explode(codes).alias("code"))


def apply_edits(files: DataFrame, edits: DataFrame) -> DataFrame:
    """K4, K5: (path, before, after, applied): each file's replacements (path, seq, find, put, times) in order.

    What is found must occur exactly ``times`` in the text as it then is, else the edit is left out and not counted in
    ``applied``. Insertions and deletions are replacements too. A file's edits fold over its text inside one expression.
    """
    e = edits.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("seq", "find", "put", "times"))).alias("edits"))

    def step(state, edit):
        rest = F.replace(state["text"], edit["find"], F.lit(""))
        once = (F.length(edit["find"]) > 0) & (F.length(state["text"]) - F.length(rest) == F.length(edit["find"]) * edit["times"])
        return F.struct(F.when(once, F.replace(state["text"], edit["find"], edit["put"])).otherwise(state["text"]).alias("text"), (state["n"] + once.cast("int")).alias("n"))

    s = F.aggregate("edits", F.struct(F.col("text"), F.lit(0).alias("n")), step)
    return files.select("path", "text").join(e, "path").withColumn("_s", s).select("path", F.col("text").alias("before"), F.col("_s.text").alias("after"), F.col("_s.n").alias("applied"))


def added_bytes(changes: DataFrame, per_file: int, total: int) -> DataFrame:
    """One row: bytes that changes (before, after) add, the most in a file, and whether both are within limits."""
    size = F.greatest(F.lit(0), F.coalesce(F.octet_length("after"), F.lit(0)) - F.coalesce(F.octet_length("before"), F.lit(0)))
    g = changes.agg(F.coalesce(F.sum(size), F.lit(0)).alias("added"), F.coalesce(F.max(F.octet_length("after")), F.lit(0)).alias("largest"))
    return g.withColumn("within", (F.col("added") <= total) & (F.col("largest") <= per_file))


def structural_findings(changes: DataFrame, most: int) -> DataFrame:
    """(path, code, severity) of changes (path, before, after): each path's rows meet once to find repeated ones.

    A path is invalid if it is empty, absolute, has a back slash, NUL or a part "..". JSON is checked in files that end so.
    """
    path, after = F.col("path"), F.col("after")
    bad = path.isNull() | (path == "") | path.rlike(r"^/|^[A-Za-z]:|\\|(^|/)\.\.(/|$)") | (F.instr(path, "\0") > 0)
    json = F.lower(path).endswith(".json") & after.isNotNull() & ~text.is_json(after)
    rows = changes.withColumn("_n", F.row_number().over(Window.partitionBy("path").orderBy("before", "after")))
    code = lambda when, name, severity: F.when(when, F.struct(F.lit(name).alias("code"), F.lit(severity).alias("severity")))
    found = F.array_compact(F.array(
        code(bad, "INVALID_PATH", "error"), code(F.col("_n") > 1, "DUPLICATE_CHANGE", "error"), code(F.col("before").eqNullSafe(after), "NOOP_CHANGE", "warning"),
        code(F.octet_length(after) > most, "FILE_TOO_LARGE", "error"), code(F.instr(after, "\0") > 0, "NULL_BYTE", "error"),
        code(after.rlike(r"(?m)^(<<<<<<<|=======|>>>>>>>) "), "CONFLICT_MARKER", "error"), code(json, "INVALID_JSON", "error")))
    return rows.select("path", F.explode(found).alias("f")).select("path", "f.*")


def passed(findings: DataFrame, by: Sequence[str]) -> DataFrame:
    """Each group's errors and warnings; it passes without errors."""
    g = findings.groupBy(*by).agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    return g.withColumn("passed", F.col("errors") == 0)


def ranked_findings(findings: DataFrame, corridor: DataFrame, k: int = 10) -> DataFrame:
    """Each analyzer's k first findings (analyzer, path, severity, idx): 100 for a path in the corridor, 30, 20, 10 by severity."""
    hit = corridor.select("path").distinct().withColumn("hit", F.lit(100))
    weight = F.when(F.col("severity") == "error", 30).when(F.col("severity") == "warning", 20).otherwise(10)
    s = findings.join(hit, "path", "left").withColumn("score", F.coalesce("hit", F.lit(0)) + weight).drop("hit")
    return top_k(s, ["analyzer"], [F.col("score").desc(), "idx"], k)


def failure_class(stage: Column) -> Column:
    """The class of a stage's failure by the words in its name."""
    out = F.lit(OTHER_FAILURE)
    for name, words in reversed(FAILURES):
        out = F.when(F.lower(stage).rlike("|".join(words)), name).otherwise(out)
    return out


def admitted(requests: DataFrame, known: DataFrame, fingerprint: str, seq: str) -> DataFrame:
    """The first request of each fingerprint that no known run has."""
    rest = [c for c in requests.columns if c != fingerprint]
    first = requests.groupBy(fingerprint).agg(F.min_by(F.struct(*rest), seq).alias("_r")).select(fingerprint, "_r.*")
    return first.join(known.select(fingerprint).distinct(), fingerprint, "left_anti").select(requests.columns)
