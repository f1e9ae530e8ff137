"""Scopes, access to sources, requests and run states as expressions and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orefold.functions import paths, text

# Fixed values (L4): surfaces of the tool chain, and those that read sources directly.
SURFACES = tuple("""symbol-families dependency-graph dependency-watershed integration-surface-atlas effect-runtime-atlas runtime-signal-map effect-atlas state-namespace-atlas
native-contract-catalog contract-map dataflow-slice patch-corridor corridor-context patch-staging change-propagation runtime-probes domain-decomposer path-mover filepatcher
canonical-validation causal-trace trace-corridor trace-context""".split())
DIRECT_SURFACES = ("github-search", "generic-repository-search", "direct-source-read", "ad-hoc-file-read", "guessed-file-read")
# Fixed values (B76): keys that a request's fingerprint leaves out.
VOLATILE = tuple("id description telemetry execution_metadata runtime_metadata request_id request_fingerprint request_envelope toolchain_artifacts result native_run last_applied_at last_applied_by".split())
# Fixed values (L7): the states of a run and those that may follow each; a state that nothing follows is terminal.
FOLLOWING = {
    "IDLE": ("READY", "SCOPE_VIOLATION", "CONFLICT", "CAPABILITY_GAP"),
    "READY": ("EXECUTING", "VALIDATING", "PROMOTING", "SUCCEEDED", "FAILED", "CONFLICT", "CAPABILITY_GAP", "BLOCKED_IDENTICAL_FAILURE", "SUPERSEDED"),
    "EXECUTING": ("VALIDATING", "PROMOTING", "SUCCEEDED", "FAILED", "CAPABILITY_GAP", "CONFLICT"),
    "VALIDATING": ("PROMOTING", "SUCCEEDED", "FAILED", "CAPABILITY_GAP", "CONFLICT"),
    "PROMOTING": ("SUCCEEDED", "FAILED", "CAPABILITY_GAP", "CONFLICT"),
    "SUCCEEDED": (), "FAILED": (), "BLOCKED_IDENTICAL_FAILURE": (), "CAPABILITY_GAP": (), "CONFLICT": (), "SCOPE_VIOLATION": (), "SUPERSEDED": (),
}
# Fixed values (L8): how far sources may be read in a state, and what else is allowed.
READ_MODES = {"IDLE": "toolchain_projection_only", **dict.fromkeys(("READY", "EXECUTING", "VALIDATING", "PROMOTING"), "curated_context_only"), **dict.fromkeys(("FAILED", "BLOCKED_IDENTICAL_FAILURE"), "failure_evidence_only")}
OTHER_READ_MODE = "closed_or_bounded"
ACTIONS = {"IDLE": ("plan",), "READY": ("context", "execute", "result"), "FAILED": ("result", "modify_request"), "BLOCKED_IDENTICAL_FAILURE": ("modify_request",), "CAPABILITY_GAP": ("result", "request_explicit_user_authorization"), "SCOPE_VIOLATION": ("result", "narrow_or_reauthorize"), "CONFLICT": ("result", "modify_request")}
OTHER_ACTIONS = ("result",)


def canonical_json(json: Column) -> Column:
    """A JSON text with the keys of every object in order; null where it is none."""
    return F.to_json(F.try_parse_json(json))


# Fixed values (B51): levels, items of an array, keys of an object and characters of a text that a compacted value shows.
DEPTH, ITEMS, KEYS, CHARS = 3, 8, 10, 240


def _quoted(value: Column) -> Column:
    """A text as JSON."""
    inside = F.to_json(F.array(value))
    return F.substr(inside, F.lit(2), F.length(inside) - 2)


def compact(value: Column, depth: int = 0) -> Column:
    """A variant as JSON text of bounded depth and width: long texts end in an ellipsis, later items and keys go, deeper values are named.

    Levels are expressions inside each other, so no value is taken apart outside the JVM; keys are in code-point order.
    """
    kind = F.schema_of_variant(value)
    items, fields = F.try_variant_get(value, "$", "array<variant>"), F.try_variant_get(value, "$", "map<string,variant>")
    if depth >= DEPTH:
        array, record = F.concat(F.lit('"['), F.size(items), F.lit(' items]"')), F.lit('"[object]"')
    else:
        keys = F.slice(F.array_sort(F.map_keys(fields)), 1, KEYS)
        array = F.concat(F.lit("["), F.array_join(F.transform(F.slice(items, 1, ITEMS), lambda x: compact(x, depth + 1)), ","), F.lit("]"))
        record = F.concat(F.lit("{"), F.array_join(F.transform(keys, lambda k: F.concat(_quoted(k), F.lit(":"), compact(F.element_at(fields, k), depth + 1))), ","), F.lit("}"))
    said = _quoted(text.bounded(F.try_variant_get(value, "$", "string"), CHARS, False))
    return F.when(kind.startswith("ARRAY"), array).when(kind.startswith("OBJECT"), record).when(kind == "STRING", said).otherwise(F.coalesce(F.to_json(value), F.lit("null")))


def compact_json(json: Column) -> Column:
    """B51 of a JSON text; null where it is none."""
    return F.when(F.try_parse_json(json).isNotNull(), compact(F.try_parse_json(json)))


def request_fingerprint(json: Column) -> Column:
    """The SHA-256 of a request without its VOLATILE keys, in canonical form."""
    kept = F.map_filter(F.try_variant_get(F.try_parse_json(json), "$", "map<string,variant>"), lambda k, v: ~k.isin(*VOLATILE))
    return F.sha2(F.to_json(kept), 256)


def request_id(name: Column, fingerprint: Column) -> Column:
    """A request's label and the first 12 digits of its fingerprint."""
    label = F.substring(F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(name, F.lit("request"))), "[^A-Za-z0-9._-]+", "-"), "^-+|-+$", ""), 1, 72)
    return F.concat(F.when(label == "", "request").otherwise(label), F.lit("-"), F.substring(fingerprint, 1, 12))


def mentions(json: Column, corridor: Column) -> Column:
    """Whether a JSON text holds one of an array of paths."""
    return F.exists(corridor, lambda p: F.contains(json, p))


def json_kind(json: Column) -> Column:
    """Object, array, string, other or (no JSON) null."""
    kind = F.schema_of_variant(F.try_parse_json(json))
    return F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind == "STRING", "string").when(kind.isNotNull(), "other")


def declared_paths(request: Column) -> Column:
    """L1: the paths that a request's JSON declares, in order, each once: of operations, edits, moves, candidates and the policy."""
    v = F.try_parse_json(request)
    some = lambda at, *keys: [F.coalesce(F.flatten(F.transform(F.try_variant_get(v, at, "array<variant>"), lambda o: F.array(*[F.try_variant_get(o, f"$.{k}", "string") for k in keys]))), F.array().cast("array<string>"))]
    nested = lambda at, key, inner=None: [F.coalesce(F.flatten(F.transform(F.try_variant_get(v, at, "array<variant>"), lambda o: F.coalesce(F.try_variant_get(o, f"$.{key}", "array<string>") if inner is None else F.transform(F.try_variant_get(o, f"$.{key}", "array<variant>"), lambda u: F.try_variant_get(u, f"$.{inner}", "string")), F.array().cast("array<string>")))), F.array().cast("array<string>"))]
    found = F.concat(*some("$.operations", "path", "from", "to"), *nested("$.operations", "roots"), *some("$.authoring_intent.edits", "path", "from", "to"), *some("$.moves", "from", "to"),
                     *some("$.candidates", "source"), *nested("$.candidates", "units", "target"), F.coalesce(F.try_variant_get(v, "$.policy.allowed_paths", "array<string>"), F.array().cast("array<string>")))
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.array_compact(found), paths.scope_path), lambda p: p != "")))


def authorized(path: Column, allowed: Column) -> Column:
    """L3: whether a path is one of ``allowed`` or below one."""
    return F.exists(allowed, lambda a: (path == a) | path.startswith(F.concat(F.regexp_replace(a, "/$", ""), F.lit("/"))))


def scope_violations(objective: Column, deliverables: Column, allowed: Column, declared: Column, construction: Column, capabilities: Column) -> Column:
    """L2: the codes of what is wrong with a scope (an array; empty: it locks). A null objective and deliverables: there is no scope."""
    none = objective.isNull() & deliverables.isNull()
    codes = F.array_compact(F.array(
        F.when(F.trim(F.coalesce(objective, F.lit(""))) == "", "USER_OBJECTIVE_REQUIRED"), F.when(F.coalesce(F.size(deliverables), F.lit(0)) <= 0, "AUTHORIZED_DELIVERABLE_REQUIRED"),
        F.when((F.size(allowed) == 0) & (F.size(declared) > 0), "AUTHORIZED_PATHS_REQUIRED"), F.when(F.exists(declared, lambda p: ~authorized(p, allowed)), "PATH_SCOPE_EXPANSION"),
        F.when(construction & (F.size(capabilities) == 0), "CAPABILITY_AUTHORIZATION_REQUIRED")))
    return F.when(none, F.array(F.lit("SCOPE_LOCK_REQUIRED"))).otherwise(codes)


def _inside(path: Column, allowed: Column) -> Column:
    return (F.size(allowed) == 0) | authorized(path, allowed)


def access(locked: Column, surface: Column, path: Column, gap: Column, allowed: Column, granted: Column) -> Column:
    """L4: (outcome, reason) of a request to read by a surface: ALLOW, ABSTRACTION_GAP or ABSTRACTION_VIOLATION.

    ``granted`` are the paths of a grant with issuer and evidence (empty: none).
    """
    s, p = F.lower(F.trim(F.coalesce(surface, F.lit("")))), paths.policy_path(F.coalesce(path, F.lit("")))
    say = lambda outcome, reason: F.struct(F.lit(outcome).alias("outcome"), (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"))
    bad = "ABSTRACTION_VIOLATION"
    return (F.when(~locked, say("ABSTRACTION_GAP", "scope-lock-required-before-abstraction-lock")).when(s == "", say("ABSTRACTION_GAP", "repository-surface-not-declared"))
            .when(gap.isNotNull() & (gap != ""), say("ABSTRACTION_GAP", gap)).when(s.isin(*SURFACES), say("ALLOW", "established-toolchain-abstraction"))
            .when(~s.isin(*DIRECT_SURFACES), say(bad, "surface-not-authorized-by-abstraction-lock")).when(p.isNull(), say(bad, "generic-or-guessed-source-exploration-denied"))
            .when(~_inside(p, allowed), say(bad, "requested-source-outside-scope-lock")).when(~F.array_contains(granted, p), say(bad, "lower-level-source-access-requires-higher-level-grant"))
            .otherwise(say("ALLOW", "bounded-source-access-grant")))


def grant(wanted: Column, issuer: Column, evidence: Column, allowed: Column) -> Column:
    """The outcome of asking for a grant of paths."""
    clean = F.array_distinct(F.array_compact(F.transform(wanted, paths.policy_path)))
    lacks = (F.trim(F.coalesce(issuer, F.lit(""))) == "") | (F.trim(F.coalesce(evidence, F.lit(""))) == "") | (F.size(clean) == 0)
    return F.when(lacks, "ABSTRACTION_GAP").when(F.exists(clean, lambda p: ~_inside(p, allowed)), "ABSTRACTION_VIOLATION").otherwise("ALLOW")


def grant_holds(bound: Column, current: Column, expires_ms: Column, now_ms: Column) -> Column:
    """The outcome of using a grant bound to a snapshot ("repository@commit"); a null expiry never comes."""
    return F.when(bound != current, "ABSTRACTION_VIOLATION").when(expires_ms <= now_ms, "ABSTRACTION_GAP").otherwise("ALLOW")


def run_states(spark: SparkSession) -> DataFrame:
    """(state, terminal, following, read_mode, actions) of each of the twelve states."""
    rows = [(s, not f, list(f), READ_MODES.get(s, OTHER_READ_MODE), list(ACTIONS.get(s, OTHER_ACTIONS))) for s, f in FOLLOWING.items()]
    return spark.createDataFrame(rows, "state string, terminal boolean, following array<string>, read_mode string, actions array<string>")


def contract_findings(contracts: DataFrame, impacted: DataFrame) -> DataFrame:
    """K9: (path, code, severity) for each impacted contract: ``contracts`` (id, file, reconciliation), ``impacted`` (id)."""
    bad = F.col("reconciliation") == "native-conflict"
    return contracts.join(impacted.select("id").distinct(), "id", "left_semi").select(F.col("file").alias("path"), F.when(bad, "NATIVE_CONTRACT_CONFLICT").otherwise("CONTRACT_IMPACT_VERIFIED").alias("code"), F.when(bad, "error").otherwise("info").alias("severity"))


def region_findings(regions: DataFrame, impacted: DataFrame) -> DataFrame:
    """(path, code, severity) for each impacted region: ``regions`` (id, files, reconciliation), ``impacted`` (id)."""
    r = F.col("reconciliation")
    code = F.when(r == "native-conflict", "RUNTIME_NATIVE_CONFLICT").when(r == "unresolved", "UNRESOLVED_RUNTIME_PATH").otherwise("RUNTIME_IMPACT_VERIFIED")
    return regions.join(impacted.select("id").distinct(), "id", "left_semi").select(F.get("files", F.lit(0)).alias("path"), code.alias("code"), F.when(r.isin("native-conflict", "unresolved"), "error").otherwise("info").alias("severity"))


def command_findings(commands: DataFrame, executables: tuple[str, ...], most_ms: int, default_ms: int) -> DataFrame:
    """(id, code) of what is wrong with commands (id, executable, cwd, timeout_ms): the rest can be planned. Repeated ids meet once."""
    line = F.col("executable").rlike(r"[\r\n]") | (F.instr("executable", "\0") > 0)
    ms = F.coalesce("timeout_ms", F.lit(default_ms))
    many = commands.groupBy(F.trim("id").alias("id")).agg(F.count("*").alias("n"))
    codes = F.array_compact(F.array(F.when(F.col("id") == "", "ID_REQUIRED"), F.when(F.col("n") > 1, "DUPLICATE_ID"), F.when(line, "UNSAFE_TOKEN"), F.when(~F.trim("executable").isin(*executables), "EXECUTABLE_NOT_ALLOWED"),
                                    F.when((ms < 1) | (ms > most_ms), "INVALID_TIMEOUT"), F.when(paths.directory_or_root(F.col("cwd")).isNull(), "INVALID_CWD")))
    return commands.withColumn("id", F.trim("id")).join(many, "id").select("id", F.explode(codes).alias("code")).distinct()


def command_results(results: DataFrame, gates: DataFrame) -> DataFrame:
    """(id, code, severity) of failed commands (id, required, exit_code, timed_out); none where a gate's findings (severity) hold an error."""
    closed = gates.where("severity = 'error'").select(F.lit(1).alias("closed")).limit(1)
    ok = ~F.col("timed_out") & F.col("exit_code").eqNullSafe(F.lit(0))
    failed = results.where(~ok).select("id", F.when(F.col("timed_out"), "COMMAND_TIMEOUT").otherwise("COMMAND_FAILED").alias("code"), F.when(F.col("required"), "error").otherwise("warning").alias("severity"))
    return failed.join(closed, F.lit(True), "left_anti")


def transaction_state(failed: Column, committed: Column, receipt_matches: Column) -> Column:
    """K6: the state of a mutation: a failed validation aborts it, a receipt that differs is an error and leaves it validated."""
    return F.when(failed, "ABORTED").when(committed & receipt_matches, "COMMITTED").when(committed, "VALIDATED").otherwise("STAGED")


def run_id(repository: Column, identity: Column) -> Column:
    """A run's name."""
    return F.concat(F.lit("run-"), text.sha(F.concat_ws(":", repository, identity), 20))
