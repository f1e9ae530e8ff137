"""Queries of facts found in programs, styles, templates and manifests; part of the registry. Their SQL states what the texts were made of."""

from __future__ import annotations

from pyspark.sql import functions as F

from orefold.functions import source
from orefold.operators import facts
from orefold.registry import query
from orefold.sources import testdata as T

# The files of orefold.sources.testdata.programs and what is in them.
PROGRAM = """pt AS (SELECT p_partkey AS k, p_size AS z FROM part), prog AS (SELECT 'src/m' || k % 40 || '/p' || k || '.js' AS file, k, z FROM pt)"""
REFS = f"""{PROGRAM}, refs AS (
  SELECT file, 'import' AS kind, '../m' || (k + 1) % 40 || '/p' || (k + 1) || '.js' AS specifier, 1 AS line FROM prog
  UNION ALL SELECT file, 'side-effect-import', './side' || z || '.css', 3 FROM prog WHERE z % 2 = 0 UNION ALL SELECT file, 'export-from', 'lodash', 3 FROM prog WHERE z % 2 = 1
  UNION ALL SELECT file, 'dynamic-import', './p' || k || '.js', 7 FROM prog
  UNION ALL SELECT 'src/m' || k % 40 || '/s' || k || '.css', 'style-import', unnest(['a' || z || '.css', 'b', 'c']), unnest([1, 1, 2]) FROM pt WHERE k % 10 = 0
  UNION ALL SELECT 'pages/' || k || '.html', 'template-reference', unnest(['x' || z || '.png', 'y.html']), unnest([1, 2]) FROM pt WHERE k % 10 = 1
  UNION ALL SELECT 'mods/' || k || '/module.json', 'manifest-reference', unnest(['a' || k || '.js', 's.css']), 1 FROM pt WHERE k % 10 = 2)"""
LINKED = f"""{REFS}, linked AS (SELECT refs.*, CASE WHEN kind = 'import' AND n.k IS NOT NULL THEN n.file WHEN kind = 'dynamic-import' THEN refs.file END AS "to"
  FROM refs LEFT JOIN prog n ON refs.kind = 'import' AND refs.specifier = '../m' || n.k % 40 || '/p' || n.k || '.js')"""
SYMS = f"""{PROGRAM}, syms AS (SELECT file, unnest(['KEY', 'f' || k, 'C' || z, 'v']) AS name, unnest(['variable', 'function', 'class', 'variable']) AS kind, unnest([false, true, false, false]) AS exported, unnest([4, 6, 11, 12]) AS line FROM prog)"""
EFFS = f"""{PROGRAM}, effs AS (SELECT file, k, unnest(['network-request', 'hooks', 'settings', 'foundry-document', 'network-request']) AS kind, unnest(['Network request', 'Foundry hook registration', 'Settings mutation or registration', 'Foundry document mutation', 'Network request']) AS detail,
  unnest([2, 7, 8, 9, 12]) AS line, unnest(['<module>', 'f' || k, 'f' || k, 'f' || k, 'v']) AS symbol, unnest(['integration-boundary', 'entry-point', 'effect-sink', 'effect-sink', 'integration-boundary']) AS node_kind,
  unnest(['crosses-integration-boundary', 'registers', 'writes-state', 'mutates-document', 'crosses-integration-boundary']) AS edge_kind, unnest([2, 6, 6, 6, 12]) AS symbol_line FROM prog)"""
STAT = f"""{PROGRAM}, stat AS (SELECT file, unnest(['foundry-setting', 'web-storage', 'public-global', 'flag-path', 'foundry-flag']) AS kind, unnest(['ns', 'localStorage', 'globalThis', 'mod' || z % 3, 'ns']) AS namespace, unnest(['k' || z % 5, '"s" + a', 'app', 'path', 'q']) AS key,
  unnest(['set', 'getItem', 'assign', 'path-reference', 'unsetFlag']) AS operation, unnest(['write', 'read', 'write', 'unknown', 'delete']) AS access, true AS namespace_resolved, unnest([true, false, true, true, true]) AS key_resolved, unnest([8, 12, 13, 13, 13]) AS line FROM prog)"""


@query("blank_comments_b20", f"""WITH {PROGRAM} SELECT file, 4 + (z % 2) AS quotes, false AS hidden FROM prog""")
def _(s, d):
    code = source.blank_comments(F.col("text"))
    f = T.programs(s, d).where("path like '%.js'").select(F.col("path").alias("file"), F.split(code, "\n").alias("lines"), F.length(code) == F.length("text"), code.alias("code"))
    # line 1 and line 3 hold two double quotes each; a comment on line 3 of odd sizes held two more
    quotes = F.size(F.split(F.concat(F.col("lines")[0], F.col("lines")[2]), '"')) - 1
    return f.select("file", (quotes + (F.col("lines")[2].contains("lodash")).cast("int")).cast("int").alias("quotes"), F.contains("code", F.lit("hidden")).alias("hidden"))


@query("references_c1", f"WITH {REFS} SELECT file, kind, specifier, line FROM refs")
def _(s, d):
    return facts.dependencies(T.programs(s, d))


@query("symbols_c5", f"WITH {SYMS} SELECT file, name, kind, exported, line FROM syms")
def _(s, d):
    return facts.symbols(T.programs(s, d))


@query("symbols_compat_c5", f"WITH {SYMS} SELECT file, name, kind, exported, CASE line WHEN 6 THEN 4 ELSE line - 1 END AS line FROM syms")
def _(s, d):
    return facts.symbols(T.programs(s, d), compat_lines=True)


@query("effects_c7", f"WITH {EFFS} SELECT * EXCLUDE (k) FROM effs")
def _(s, d):
    return facts.effects(T.programs(s, d))


@query("runtime_nodes_c8", f"""WITH {EFFS}, n AS (
  SELECT 'runtime-node-' || left(sha256(concat_ws(chr(0), file, node_kind, kind, line, symbol, detail)), 20) AS id, node_kind AS kind, kind AS effect_kind, symbol, line AS line_start, line AS line_end, CASE symbol WHEN '<module>' THEN 'pattern-detected' ELSE 'lexically-associated' END AS confidence FROM effs
  UNION ALL SELECT 'runtime-operation-' || left(sha256(file || chr(0) || symbol), 20), 'runtime-operation', 'symbol-operation', symbol, max(symbol_line), max(line), 'lexically-associated' FROM effs WHERE symbol <> '<module>' GROUP BY file, symbol
  UNION ALL SELECT 'runtime-unresolved-' || left(sha256(concat_ws(chr(0), file, kind, line)), 20), 'unresolved-runtime-site', kind, symbol, line, line, 'unresolved' FROM effs WHERE symbol = '<module>') SELECT * FROM n""")
def _(s, d):
    return facts.runtime_graph(facts.effects(T.programs(s, d)))[0].drop("detail", "file")


@query("runtime_edges_c8", f"""WITH {EFFS}, e AS (SELECT *, CASE symbol WHEN '<module>' THEN 'runtime-unresolved-' || left(sha256(concat_ws(chr(0), file, kind, line)), 20) ELSE 'runtime-operation-' || left(sha256(file || chr(0) || symbol), 20) END AS op,
  'runtime-node-' || left(sha256(concat_ws(chr(0), file, node_kind, kind, line, symbol, detail)), 20) AS node, CASE symbol WHEN '<module>' THEN 'unresolved-runtime-link' ELSE edge_kind END AS ek FROM effs)
SELECT 'runtime-edge-' || left(sha256(concat_ws(chr(0), op, ek, node)), 20) AS id, ek AS kind, op AS "from", node AS "to", file, line, CASE symbol WHEN '<module>' THEN 'unresolved' ELSE 'lexically-associated' END AS confidence FROM e""")
def _(s, d):
    return facts.runtime_graph(facts.effects(T.programs(s, d)))[1]


@query("states_c9", f"WITH {STAT} SELECT * FROM stat")
def _(s, d):
    return facts.states(T.programs(s, d))


@query("linked_references_d1", f"""WITH {LINKED} SELECT file, kind, specifier, line, "to", "to" IS NULL AND NOT starts_with(specifier, '.') AS "external" FROM linked""")
def _(s, d):
    files = T.programs(s, d)
    return facts.resolve(facts.dependencies(files), files)


@query("absolute_references_d2", """WITH f AS (SELECT 'lib/' || s_suppkey || '.js' AS path FROM supplier WHERE s_suppkey % 2 = 0), r AS (SELECT '/lib/./' || s_suppkey || '.js' AS specifier FROM supplier)
SELECT specifier, path AS "to", path IS NULL AS "external" FROM r LEFT JOIN f ON path = replace(substr(specifier, 2), './', '')""")
def _(s, d):
    n = F.col("s_suppkey").cast("string")
    sup = T.table(s, d, "supplier")
    refs = sup.select(F.lit("a.js").alias("file"), F.concat(F.lit("/lib/./"), n, F.lit(".js")).alias("specifier"))
    return facts.resolve(refs, sup.where("s_suppkey % 2 = 0").select(F.concat(F.lit("lib/"), n, F.lit(".js")).alias("path"))).drop("file")
