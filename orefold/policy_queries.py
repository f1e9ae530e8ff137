"""Queries of scopes, accesses, requests, run states and validation; part of the registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from orefold.case_queries import cases
from orefold.plans import edits, policy
from orefold.registry import query
from orefold.sources import testdata as T
from orefold.streaming import runs

C = F.col
_list = lambda c: F.filter(F.split(C(c), ","), lambda x: x != "")

cases("scope_violations_l2", ["goal", "out", "allowed", "declared", "build"], "codes locked", lambda: [F.array_join(x := policy.scope_violations(C("goal"), _list("out"), _list("allowed"), _list("declared"), C("build"), F.array().cast("array<string>")), ","), F.size(x) == 0], [
    ("do #", "x", "src,lib/", "src/a#,lib/b", False, "", True), (" ", "x", "src", "src", False, "USER_OBJECTIVE_REQUIRED", False), ("g", "", "", "a#", False, "AUTHORIZED_DELIVERABLE_REQUIRED,AUTHORIZED_PATHS_REQUIRED,PATH_SCOPE_EXPANSION", False),
    ("g", "x", "src", "srcx/a", False, "PATH_SCOPE_EXPANSION", False), ("g", "x", "src", "", True, "CAPABILITY_AUTHORIZATION_REQUIRED", False), (None, None, "src", "", False, "SCOPE_LOCK_REQUIRED", False)])
cases("access_l4", ["locked", "surface", "path", "gap", "granted"], "outcome reason", lambda: [(a := policy.access(C("locked"), C("surface"), C("path"), C("gap"), F.array(F.lit("src")), _list("granted")))["outcome"], a["reason"]], [
    (False, "contract-map", "", "", "", "ABSTRACTION_GAP", "scope-lock-required-before-abstraction-lock"), (True, " ", "", "", "", "ABSTRACTION_GAP", "repository-surface-not-declared"), (True, "x", "", "why-#", "", "ABSTRACTION_GAP", "why-#"),
    (True, "Contract-Map", "", "", "", "ALLOW", "established-toolchain-abstraction"), (True, "grep", "", "", "", "ABSTRACTION_VIOLATION", "surface-not-authorized-by-abstraction-lock"), (True, "direct-source-read", "../x", "", "", "ABSTRACTION_VIOLATION", "generic-or-guessed-source-exploration-denied"),
    (True, "direct-source-read", "lib/#", "", "", "ABSTRACTION_VIOLATION", "requested-source-outside-scope-lock"), (True, "direct-source-read", "src/#", "", "src/b", "ABSTRACTION_VIOLATION", "lower-level-source-access-requires-higher-level-grant"), (True, "direct-source-read", "./src/#", "", "src/#", "ALLOW", "bounded-source-access-grant")])
cases("grants_l5", ["wanted", "issuer", "bound", "expires"], "asked used", lambda: [policy.grant(_list("wanted"), C("issuer"), F.lit("e"), F.array(F.lit("src"))), policy.grant_holds(C("bound"), F.lit("r@1"), C("expires"), F.lit(100))], [
    ("src/a#", "me", "r@1", 200, "ALLOW", "ALLOW"), ("src/a#,lib/b", "me", "r@1", 100, "ABSTRACTION_VIOLATION", "ABSTRACTION_GAP"), ("", "me", "r@2", 200, "ABSTRACTION_GAP", "ABSTRACTION_VIOLATION"), ("src/a", " ", "r@1", None, "ABSTRACTION_GAP", "ALLOW")])
cases("declared_paths_l1", ["json"], "paths", lambda: [F.array_join(policy.declared_paths(C("json")), ",")], [
    ('{"operations": [{"path": "./a#", "roots": ["r//x"]}, {"from": "b", "to": "c"}], "moves": [{"from": "b", "to": "d"}]}', "a#,b,c,d,r/x"), ('{"candidates": [{"source": "s", "units": [{"target": "t#"}]}], "policy": {"allowed_paths": ["p"]}, "authoring_intent": {"edits": [{"path": "e"}]}}', "e,p,s,t#"), ("{}", ""), ("not json", "")])
cases("json_b50", ["json"], "canonical kind hit", lambda: [policy.canonical_json(C("json")), policy.json_kind(C("json")), policy.mentions(C("json"), F.array(F.lit("src/a"), F.lit("lib")))], [
    ('{"b": 1, "a": {"d": [2, {"z": 1, "y": 2}], "c": "src/a#"}}', '{"a":{"c":"src/a#","d":[2,{"y":2,"z":1}]},"b":1}', "object", True), ("[3, \"x#\"]", '[3,"x#"]', "array", False), ('"s#"', '"s#"', "string", False), ("nope", None, None, False)])


@query("request_identity_b76", """SELECT p_partkey AS k, 'do-it-' || left(f, 12) AS id, f AS fingerprint, true AS same FROM (SELECT p_partkey, sha256('{"goal":"' || p_name || '","size":' || p_size || '}') AS f FROM part)""")
def _(s, d):
    json = lambda extra: F.concat(F.lit('{"size": '), C("p_size").cast("string"), F.lit(', "goal": "'), C("p_name"), F.lit('"' + extra + "}"))
    p = T.table(s, d, "part").select(C("p_partkey").alias("k"), policy.request_fingerprint(json(', "id": "do it!", "telemetry": {"x": 1}')).alias("fingerprint"), policy.request_fingerprint(json("")).alias("bare"))
    return p.select("k", policy.request_id(F.lit("do it!"), C("fingerprint")).alias("id"), "fingerprint", (C("fingerprint") == C("bare")).alias("same"))


_STATES = list(policy.FOLLOWING)
_ALLOWED = ", ".join(f"('{a}', '{b}')" for a, f in policy.FOLLOWING.items() for b in f)
RUN = f"""run AS (SELECT event_id, user_id, ts, [{', '.join(repr(x) for x in _STATES)}][1 + event_id % 12] AS state FROM events),
step AS (SELECT *, lag(state) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM run), ok(a, b) AS (VALUES {_ALLOWED})"""


def _runs(s, d):
    return T.table(s, d, "events").select("event_id", "user_id", "ts", F.get(F.array(*[F.lit(x) for x in _STATES]), (C("event_id") % 12).cast("int")).alias("state"))


@query("transitions_l7", f"WITH {RUN} SELECT event_id, user_id, before, state FROM step WHERE before IS NOT NULL AND (before, state) NOT IN (SELECT (a, b) FROM ok)")
def _(s, d):
    return runs.violations(_runs(s, d), "user_id", "state", ["ts", "event_id"], policy.FOLLOWING).select("event_id", "user_id", "before", "state")


@query("run_summary_l9", f"""WITH {RUN}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence FROM run)
SELECT user_id, count(*) AS events, max_by(state, sequence) AS state, max_by(state, sequence) IN ('SUCCEEDED', 'FAILED', 'BLOCKED_IDENTICAL_FAILURE', 'CAPABILITY_GAP', 'CONFLICT', 'SCOPE_VIOLATION', 'SUPERSEDED') AS terminal, count(*) FILTER (state = 'SUCCEEDED') AS successes, count(*) FILTER (state IN ('FAILED', 'BLOCKED_IDENTICAL_FAILURE')) AS failures FROM n GROUP BY user_id""")
def _(s, d):
    return runs.summary(runs.sequence(_runs(s, d), "user_id", ["ts", "event_id"]), "user_id", "state", "sequence")


@query("capabilities_l8", """SELECT user_id, state, CASE WHEN state = 'IDLE' THEN 'toolchain_projection_only' WHEN state IN ('READY', 'EXECUTING', 'VALIDATING', 'PROMOTING') THEN 'curated_context_only' WHEN state IN ('FAILED', 'BLOCKED_IDENTICAL_FAILURE') THEN 'failure_evidence_only' ELSE 'closed_or_bounded' END AS read_mode,
  CASE state WHEN 'IDLE' THEN 1 WHEN 'READY' THEN 3 WHEN 'FAILED' THEN 2 WHEN 'CAPABILITY_GAP' THEN 2 WHEN 'SCOPE_VIOLATION' THEN 2 WHEN 'CONFLICT' THEN 2 ELSE 1 END AS actions FROM (WITH """ + RUN + " SELECT user_id, max_by(state, (ts, event_id)) AS state FROM run GROUP BY 1)")
def _(s, d):
    last = _runs(s, d).groupBy("user_id").agg(F.max_by("state", F.struct("ts", "event_id")).alias("state"))
    return last.join(F.broadcast(policy.run_states(s)), "state").select("user_id", "state", "read_mode", F.size("actions").alias("actions"))


_LABEL = lambda c: F.when(C(c) % 3 == 0, "native-conflict").when(C(c) % 3 == 1, "unresolved").otherwise("cross-map-confirmed")


@query("impact_findings_k9", """WITH i AS (SELECT DISTINCT l_suppkey AS id FROM lineitem WHERE l_quantity > 45), c AS (SELECT s_suppkey AS id, 'f' || s_nationkey AS file, CASE s_suppkey % 3 WHEN 0 THEN 'native-conflict' WHEN 1 THEN 'unresolved' ELSE 'cross-map-confirmed' END AS r FROM supplier WHERE s_suppkey IN (SELECT id FROM i))
SELECT file AS path, CASE r WHEN 'native-conflict' THEN 'NATIVE_CONTRACT_CONFLICT' ELSE 'CONTRACT_IMPACT_VERIFIED' END AS code, CASE r WHEN 'native-conflict' THEN 'error' ELSE 'info' END AS severity FROM c
UNION ALL SELECT file, CASE r WHEN 'native-conflict' THEN 'RUNTIME_NATIVE_CONFLICT' WHEN 'unresolved' THEN 'UNRESOLVED_RUNTIME_PATH' ELSE 'RUNTIME_IMPACT_VERIFIED' END, CASE WHEN r = 'cross-map-confirmed' THEN 'info' ELSE 'error' END FROM c""")
def _(s, d):
    sup = T.table(s, d, "supplier").select(C("s_suppkey").alias("id"), F.concat(F.lit("f"), C("s_nationkey").cast("string")).alias("file"), _LABEL("s_suppkey").alias("reconciliation"))
    hit = T.table(s, d, "lineitem").where("l_quantity > 45").select(C("l_suppkey").alias("id"))
    return policy.contract_findings(sup, hit).unionAll(policy.region_findings(sup.withColumn("files", F.array("file")), hit))


@query("command_plan_k12", """WITH c AS (SELECT CASE WHEN s_suppkey % 7 = 0 THEN 'twice' ELSE 'c' || s_suppkey END AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'rm' ELSE ' npm ' END AS executable, CASE WHEN s_suppkey % 5 = 0 THEN '../x' ELSE 'src' END AS cwd, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey * 100 END AS timeout_ms FROM supplier)
SELECT DISTINCT id, code FROM (SELECT id, unnest([CASE WHEN count(*) OVER (PARTITION BY id) > 1 THEN 'DUPLICATE_ID' END, CASE WHEN executable = 'rm' THEN 'EXECUTABLE_NOT_ALLOWED' END, CASE WHEN timeout_ms > 5000 OR timeout_ms < 1 THEN 'INVALID_TIMEOUT' END, CASE WHEN cwd = '../x' THEN 'INVALID_CWD' END]) AS code FROM c) WHERE code IS NOT NULL""")
def _(s, d):
    k = C("s_suppkey")
    c = T.table(s, d, "supplier").select(F.when(k % 7 == 0, "twice").otherwise(F.concat(F.lit("c"), k.cast("string"))).alias("id"), F.when(k % 3 == 0, "rm").otherwise(" npm ").alias("executable"), F.when(k % 5 == 0, "../x").otherwise("src").alias("cwd"), F.when(k % 2 == 0, k * 100).alias("timeout_ms"))
    return policy.command_findings(c, ("npm", "node"), 5000, 1000)


@query("command_results_k14", """SELECT s_suppkey AS id, CASE WHEN s_suppkey % 5 = 0 THEN 'COMMAND_TIMEOUT' ELSE 'COMMAND_FAILED' END AS code, CASE WHEN s_nationkey < 9 THEN 'error' ELSE 'warning' END AS severity FROM supplier WHERE s_suppkey % 5 = 0 OR s_suppkey % 3 <> 0""")
def _(s, d):
    k = C("s_suppkey")
    c = T.table(s, d, "supplier").select(k.alias("id"), (C("s_nationkey") < 9).alias("required"), F.when(k % 11 != 0, k % 3).otherwise(F.when(k % 3 == 0, 0)).alias("exit_code"), (k % 5 == 0).alias("timed_out"))
    return policy.command_results(c, s.createDataFrame([("info",), ("warning",)], "severity string"))


@query("transaction_k6", "SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'F' THEN 'ABORTED' WHEN o_custkey % 3 = 0 THEN 'STAGED' WHEN o_custkey % 3 = 1 THEN 'COMMITTED' ELSE 'VALIDATED' END AS state FROM orders")
def _(s, d):
    # finished orders failed; of the others a third has no receipt, a third the right one
    o = T.table(s, d, "orders")
    return o.select(F.col("o_orderkey").alias("k"), policy.transaction_state(F.col("o_orderstatus") == "F", F.col("o_custkey") % 3 != 0, F.col("o_custkey") % 3 == 1).alias("state"))


# --------------------------------------------------------------------------- edits

EDITS = """doc AS (SELECT 'd/' || doc_id || '.md' AS path, doc_id AS i, coalesce(text, '') AS text, doc_id % 8 AS m, (len(coalesce(text, '')) - len(replace(coalesce(text, ''), ' th', ''))) // 3 AS n FROM documents)"""


def _edits(s, d):
    i, path = C("doc_id"), F.concat(F.lit("d/"), C("doc_id").cast("string"), F.lit(".md"))
    files = T.table(s, d, "documents").select(path.alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    m = i % 8
    kind = F.get(F.array(*[F.lit(k) for k in ("create_file", "replace_file", "replace_exact", "insert_before_exact", "insert_after_exact", "delete_exact", "remove_file", "move_file")]), m.cast("int"))
    to = F.when(m == 0, F.concat(F.lit("./n/"), i.cast("string"))).otherwise(F.concat(F.lit("./"), path))
    e = T.table(s, d, "documents").select(i.alias("seq"), kind.alias("type"), to.alias("path"), F.when(m == 7, F.concat(F.lit("m/"), i.cast("string"))).alias("to"), F.lit(" th").alias("search"), F.lit("+").alias("content"), F.lit(1).alias("times"), F.when(i % 16 == 1, "stale").alias("sha"))
    return files, e


@query("edits_k4", f"""WITH {EDITS} SELECT path, md5(before) AS before, md5(after) AS after, kind, error FROM (
  SELECT 'n/' || i AS path, NULL AS before, '+' AS after, 'create' AS kind, NULL AS error FROM doc WHERE m = 0
  UNION ALL SELECT path, text, CASE WHEN m = 1 THEN '+' WHEN n <> 1 THEN text WHEN m = 2 THEN replace(text, ' th', '+') WHEN m = 3 THEN replace(text, ' th', '+ th') WHEN m = 4 THEN replace(text, ' th', ' th+') ELSE replace(text, ' th', '') END, 'modify', CASE WHEN m > 1 AND n <> 1 THEN i || ': found ' || n || ' times' END FROM doc WHERE m BETWEEN 1 AND 5
  UNION ALL SELECT path, text, NULL, 'delete', NULL FROM doc WHERE m >= 6 UNION ALL SELECT 'm/' || i, NULL, text, 'create', NULL FROM doc WHERE m = 7) WHERE before IS DISTINCT FROM after OR error IS NOT NULL""")
def _(s, d):
    files, e = _edits(s, d)
    return edits.stage(files, edits.normalized(e)).select("path", F.md5("before").alias("before"), F.md5("after").alias("after"), "kind", "error")


@query("edit_guards_k1", f"""WITH {EDITS} SELECT i AS seq, unnest(list_filter([CASE WHEN i % 16 = 1 AND m > 0 THEN 'STALE_CONTENT' END, CASE WHEN m = 7 THEN 'OUTSIDE_ALLOWED_PATHS' END], lambda x: x IS NOT NULL)) AS code FROM doc""")
def _(s, d):
    files, e = _edits(s, d)
    e = edits.normalized(e)
    return edits.guards(e, files, e.select("path"))


@query("edit_limits_k5", f"""WITH {EDITS}, c AS (SELECT text AS before, text || 'ab' AS after FROM doc) SELECT count(*) AS files, coalesce(sum(strlen(after) - strlen(before)), 0)::BIGINT AS added, coalesce(max(strlen(after)), 0)::INT AS largest, CASE WHEN count(*) = 0 THEN 'NO_CHANGES' WHEN sum(strlen(after) - strlen(before)) > 10 THEN 'TOO_MANY_BYTES' END AS code FROM c""")
def _(s, d):
    t = F.coalesce("text", F.lit(""))
    return edits.limits(T.table(s, d, "documents").select(t.alias("before"), F.concat(t, F.lit("ab")).alias("after")), 1_000_000, 10, 1 << 30)
