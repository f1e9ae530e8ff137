"""Queries of expressions over cases that each part of the part table repeats with its own number; part of the registry.

"#" in a case stands for the part's number. The SQL states the results, case by case, as the definitions give them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from orefold.functions import paths, text
from orefold.registry import query
from orefold.sources import testdata as T


def _sql(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return str(v)


def cases(name: str, inputs: Sequence[str], results: str, expressions: Callable[[], Sequence[Column]], rows: Sequence[tuple]) -> None:
    """A query ``name`` of ``results`` (column names, and expressions over the inputs) for rows of inputs and expected results."""
    names = [*inputs, *results.split()]
    number = "CAST(p_partkey AS VARCHAR)"
    shown = [f"replace(v.{n}, '#', {number}) AS {n}" if any(isinstance(r[i], str) for r in rows) else f"v.{n} AS {n}" for i, n in enumerate(names)]
    values = ", ".join("(" + ", ".join(_sql(x) for x in r) + ")" for r in rows)

    @query(name, f"SELECT p_partkey AS k, {', '.join(shown)} FROM part, (VALUES {values}) v({', '.join(names)})")
    def _(s, d):
        given = F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(inputs, r)]) for r in rows])
        part = T.table(s, d, "part").select(F.col("p_partkey").alias("k"), F.explode(given).alias("v")).select("k", "v.*")
        some = part.select("k", *[F.replace(c, F.lit("#"), F.col("k").cast("string")).alias(c) if part.schema[c].dataType.simpleString() == "string" else F.col(c) for c in inputs])
        return some.select("k", *inputs, *[e.alias(n) for n, e in zip(results.split(), expressions())])


C = F.col
cases("path_variants_b2", ["p"], "patch scoped policy safe dir", lambda: [paths.patch_path(C("p")), paths.scope_path(C("p")), paths.policy_path(C("p")), paths.safe(C("p")), paths.directory_or_root(C("p"))], [
    ("./a/#//b", "a/#/b", "a/#/b", "a/#/b", True, "a/#/b"), ("/a#", "", "/a#", None, False, None), ("a#/../..", "", "a#/../..", None, False, None), ("a\\b#", "a/b#", "a/b#", "a/b#", True, "a/b#"), (" x# ", "x#", "x#", "x#", True, "x#"), ("C:/x#", "C:/x#", "C:/x#", "C:/x#", False, None), (".", "", ".", None, True, ".")])
cases("path_parts_b6", ["p", "q"], "dir joined inside", lambda: [paths.dirname(C("p")), paths.join(C("p"), C("q")), paths.inside(C("p"), C("q"))], [
    ("a/b#", "a/b#/c", "a", "a/b#/a/b#/c", True), ("a#", "a#b/c", "", "a#/a#b/c", False), ("x/y/z#", "../w", "x/y", "x/y/w", False), ("a/b#", "a/b#", "a", "a/b#/a/b#", True), ("", "q#", "", "q#", False)])
cases("compatible_b8", ["source", "spec"], "first second n", lambda: [F.get(paths.compatible(C("source"), C("spec")), F.lit(0)), F.get(paths.compatible(C("source"), C("spec")), F.lit(1)), F.size(paths.compatible(C("source"), C("spec")))], [
    ("src/a.ts", "./b#.js", "src/b#.js", "src/b#.ts", 9), ("src/a.ts", "../lib/c#", "lib/c#", "lib/c#.ts", 9), ("a.ts", "lodash#", None, None, 0), ("a.ts", "../#", None, None, 0)])
cases("relative_b12", ["importer", "target", "original"], "spec", lambda: [paths.relative(C("importer"), C("target"), C("original"))], [
    ("src/a.js", "src/b#.js", "./x", "./b#"), ("src/a.js", "src/b#.js", "./x.js", "./b#.js"), ("src/x/a.js", "lib/c#.ts", "../q", "../../lib/c#"), ("src/a.js", "src/d#/index.js", "./d", "./d#"), ("a.js", "src/b#.js", "./b.js", "./src/b#.js"), ("x/y/z.js", "x/w#.js", "../v", "../w#")])
cases("path_classes_b14", ["p"], "priority document role guarded target", lambda: [paths.priority(C("p")), paths.document(C("p")), paths.role(C("p")), paths.protected(C("p")), paths.extract_target(C("p"), F.lit("unit"))], [
    ("src/package.json", 0, False, "implementation", False, "src/package-unit.json"), ("a#/Main.ts", 1, False, "implementation", False, "a#/Main-unit.ts"), ("a/event-handler#.js", 2, False, "implementation", False, "a/event-handler#-unit.js"), ("t/x#.test.js", 5, False, "implementation", False, "t/x#.test-unit.js"),
    ("docs/a#.txt", 3, True, "implementation", False, "docs/a#-unit.txt"), ("x#/README.md", 3, True, "implementation", False, "x#/README-unit.md"), ("lib/runtime-orchestrator.ts", 2, False, "composition_root", False, "lib/runtime-orchestrator-unit.ts"), ("b/my-registry-core.js", 2, False, "registry", False, "b/my-registry-core-unit.js"),
    ("c#/x-feature-package.js", 3, False, "feature_package", False, "c#/x-feature-package-unit.js"), (".git/x#", 3, False, "implementation", True, ".git/x#-unit"), (".env.local", 3, False, "implementation", True, ".env-unit.local"), ("d/a#-tracker.js", 3, False, "implementation", False, "d/a#-unit.js")])
_WEB = paths.SourceProfile.of(roots=["src", "mods"], ignored_files=[" Secret.JS ", ""])
cases("source_profile_a12", ["p", "size"], "kind source hydrated", lambda: [_WEB.kind(C("p")), _WEB.is_source(C("p")), _WEB.hydrated(C("p"), C("size"), 1000)], [
    ("src/a#.ts", 10, "source", True, True), ("src/a#.ts", 1001, "source", True, False), ("lib/a#.ts", 10, "asset", False, False), ("src/node_modules/a#.js", 10, "asset", False, False), ("mods/#/Module.json", 10, "manifest", True, True), ("src/secret.js", 10, "asset", False, False), ("src/a#.png", 10, "asset", False, False), ("docs/a#.md", 10, "asset", False, True)])
cases("refs_a24", ["ref", "repo"], "branch slug allowed", lambda: [paths.branch(C("ref")), paths.repository_slug(C("repo"), "me/"), paths.allowed_repository(C("repo"), ["me/x", "you/y"])], [
    ("refs/heads/f#", "https://github.com/me/x#.git", "f#", "me/x#", False), ("heads/m", "x#", "m", "me/x#", False), ("HEAD", "me/x", None, "me/x", True), ("tags/v#", "a/b/c", None, None, False), ("refs/tags/v", "/you/y/", None, "you/y", False), ("main", "you/y", "main", "you/y", True)])
cases("globs_b18", ["p"], "flat deep one", lambda: [C("p").rlike(paths.glob("src/*.ts")), C("p").rlike(paths.glob("src/**")), C("p").rlike(paths.glob("src/?.ts"))], [
    ("src/a.ts", True, True, True), ("src/a#.ts", True, True, False), ("src/x/a#.ts", False, True, False), ("lib/a.ts", False, False, False), ("src/axts", False, True, False)])
cases("guards_b33", ["t"], "kind condition fields", lambda: [text.guard(C("t"))["kind"], text.guard(C("t"))["condition"], F.array_join(text.suspects(C("t")), ",")], [
    ("if (!event#)\n  return;", "early-return", "if (!event#) return", ""), ("if (seen) return x", "dedupe", "if (seen) return", ""), ("if (a.includes) return 1", "suppression", "if (a.includes) return", ""), ("use(msg.id, targetId)", None, None, "message.id,targetId"), ("if (x) y()", None, None, "")])
cases("blocks_b32", ["t", "line", "after"], "block needle", lambda: [text.block(C("t"), C("line"), C("after")), text.needle(C("t"), F.lit("./q"))], [
    ("a#\nb\nc", 1, 3, "a#\nb", None), ("a\nb#\nc \"./q\"", 2, None, "b#\nc \"./q\"", '"./q"'), ("x './q'\ny", 1, 2, "x './q'", "'./q'"), ("a", 1, 1, "", None)])
cases("exports_b45", ["t"], "names", lambda: [F.array_join(F.transform(text.exports(C("t")), lambda x: F.concat(x["kind"], F.lit(":"), x["name"])), ",")], [
    ("export default async function f#() {}\nexport class A {}\nexport let b = 1", "function:f#,class:A,variable:b"), ("export const T = 1; export type T = X", "type:T"), ("export interface I# {}", "interface:I#"), ("function g() {}", "")])


@query("identities_b71", """SELECT p_partkey AS k, 'contract:state:' || left(sha256('state:' || p_name), 16) AS contract, 'semantic:' || regexp_replace(p_brand, '[^a-zA-Z0-9/_-]+', '-', 'g') || ':' || left(sha256('me/r:' || p_brand), 10) AS region,
  'evidence:' || left(sha256(p_name || ':symbol:' || p_type), 14) AS evidence, 'ctx-' || left(sha256(p_name || chr(10) || p_type || chr(10) || p_size), 20) AS continuation, sha256(p_name) AS file FROM part""")
def _(s, d):
    return T.table(s, d, "part").select(C("p_partkey").alias("k"), text.contract_id(F.lit("state"), C("p_name")).alias("contract"), text.region_id(F.lit("me/r"), C("p_brand")).alias("region"),
                                        text.evidence_id(C("p_name"), F.lit("symbol"), C("p_type")).alias("evidence"), text.continuation_id(C("p_name"), C("p_type"), C("p_size")).alias("continuation"), text.sha(C("p_name")).alias("file"))


@query("compact_values_b62", "SELECT p_partkey AS k, p_name || CASE WHEN p_size > 25 THEN '?' ELSE '' END || CASE WHEN p_size % 2 = 0 THEN ':' || p_type ELSE '' END AS shown FROM part")
def _(s, d):
    v = F.array(F.struct(C("p_name").alias("name"), (C("p_size") > 25).alias("optional"), F.when(C("p_size") % 2 == 0, C("p_type")).alias("type")))
    return T.table(s, d, "part").select(C("p_partkey").alias("k"), text.compact_values(v)[0].alias("shown"))
