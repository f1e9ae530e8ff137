"""Queries of linked facts, guarded edits and findings; part of the registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from orefold.operators import linking, ranking
from orefold.plans import validation
from orefold.registry import CHANGED, DEP, FIL, STA, SYM, _changed, query
from orefold.sources import testdata as T

# Calls, declarations and imports: customers' segments are declared in their nation; suppliers call a segment there.
CALLS = """decl AS (SELECT c_nationkey AS file, c_mktsegment AS name, c_acctbal > 5000 AS exported, c_custkey AS line FROM customer WHERE c_nationkey % 3 <> 0 OR c_mktsegment <> 'BUILDING'),
call AS (SELECT s_suppkey AS call_id, s_nationkey AS file, CASE s_suppkey % 4 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'lib' WHEN 2 THEN 'next' ELSE 'none' END AS root FROM supplier),
imp AS (SELECT n_nationkey AS file, 'next' AS root, (n_nationkey + 1) % 25 AS target, 'MACHINERY' AS imported FROM nation WHERE n_regionkey <> 2 UNION ALL SELECT n_nationkey, 'lib', NULL, 'x' FROM nation),
own AS (SELECT file, name, min(line) AS line FROM decl GROUP BY ALL), far AS (SELECT file, name, min(line) AS line FROM decl WHERE exported GROUP BY ALL),
res AS (SELECT call_id, call.file, coalesce(own.file, far.file) AS provider, coalesce(own.line, far.line) AS line,
  CASE WHEN own.line IS NOT NULL THEN 'local' WHEN far.line IS NOT NULL THEN 'import' WHEN imp.root IS NOT NULL AND imp.target IS NULL THEN 'external' ELSE 'unresolved' END AS how
  FROM call LEFT JOIN own ON own.file = call.file AND own.name = call.root LEFT JOIN imp ON imp.file = call.file AND imp.root = call.root LEFT JOIN far ON far.file = imp.target AND far.name = imp.imported)"""


def _calls(s, d):
    c = T.table(s, d, "customer").where("c_nationkey % 3 <> 0 or c_mktsegment <> 'BUILDING'")
    decl = c.select(F.col("c_nationkey").alias("file"), F.col("c_mktsegment").alias("name"), (F.col("c_acctbal") > 5000).alias("exported"), F.col("c_custkey").alias("line"))
    m = F.col("s_suppkey") % 4
    call = T.table(s, d, "supplier").select(F.col("s_suppkey").alias("call_id"), F.col("s_nationkey").alias("file"), F.when(m == 0, "BUILDING").when(m == 1, "lib").when(m == 2, "next").otherwise("none").alias("root"))
    n = T.table(s, d, "nation")
    imp = n.where("n_regionkey <> 2").select(F.col("n_nationkey").alias("file"), F.lit("next").alias("root"), ((F.col("n_nationkey") + 1) % 25).alias("target"), F.lit("MACHINERY").alias("imported"))
    imp = imp.unionAll(n.select("n_nationkey", F.lit("lib"), F.lit(None).cast(imp.schema["target"].dataType), F.lit("x")))
    return call, linking.resolve_calls(call, decl, imp)


@query("resolve_calls_d4", f"WITH {CALLS} SELECT call_id, provider, line, how FROM res")
def _(s, d):
    return _calls(s, d)[1]


@query("either_join_d10", "SELECT DISTINCT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey AND (c_custkey % 50 = s_suppkey % 50 OR floor(c_acctbal / 500) = floor(s_acctbal / 500))")
def _(s, d):
    side = lambda t, p, k: T.table(s, d, t).select(k, F.col(f"{p}_nationkey").alias("file"), (F.col(k) % 50).alias("symbol"), F.floor(F.col(f"{p}_acctbal") / 500).alias("line"))
    return linking.either(side("customer", "c", "c_custkey"), side("supplier", "s", "s_suppkey"), ["file"], ["symbol", "line"], ["c_custkey", "s_suppkey"])


@query("first_by_order_d12", "SELECT o_orderkey, (SELECT min_by(l_partkey, (l_shipdate, l_linenumber, l_partkey)) FROM lineitem WHERE l_orderkey = o_orderkey) AS l_partkey FROM orders")
def _(s, d):
    first = linking.first_of(T.table(s, d, "lineitem"), ["l_orderkey"], ["l_shipdate", "l_linenumber", "l_partkey"], ["l_partkey"])
    return T.table(s, d, "orders").join(first, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "l_partkey")


@query("definition_d13", """WITH e AS (SELECT *, json_extract_string(props, '$.k') AS k FROM events)
SELECT p.event_id, (SELECT max_by(f.event_id, (coalesce(f.k = p.k, false), f.ts, f.event_id)) FROM e f WHERE f.user_id = p.user_id AND f.event_type IN ('view', 'click') AND f.ts <= p.ts) AS definition
FROM e p WHERE p.event_type = 'purchase'""")
def _(s, d):
    e = T.table(s, d, "events").withColumn("k", F.get_json_object("props", "$.k"))
    defs = e.where("event_type in ('view', 'click')").select("user_id", "k", F.col("ts").alias("since"), F.col("event_id").alias("id"))
    return linking.definition_of(e.where("event_type = 'purchase'").select("event_id", "user_id", "k", "ts"), defs, ["user_id"], "k", "ts", "since", "id").select("event_id", "definition")


@query("crossings_d17", "SELECT DISTINCT o_custkey AS consumer, l_suppkey AS provider FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_custkey <> l_suppkey")
def _(s, d):
    return linking.crossings(T.table(s, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_suppkey").alias("provider")), T.table(s, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("consumer")), "k")


@query("reaching_d18", f"WITH {DEP}, c AS ({CHANGED}) SELECT DISTINCT f AS \"from\", t AS \"to\", 'reaches-effect' AS kind FROM dep WHERE t IN (SELECT file FROM c)")
def _(s, d):
    return linking.reaching(T.dependencies(s, d), _changed(s, d).withColumnRenamed("file", "node"))


@query("symbol_edges_d19", "SELECT DISTINCT s_nationkey AS \"from\", s_suppkey AS caller, n_regionkey AS \"to\", n_name AS callee FROM supplier JOIN nation a ON s_nationkey = a.n_nationkey JOIN (SELECT n_regionkey AS r, n_name AS n FROM nation) b ON b.r = a.n_regionkey"
       .replace("n_name AS callee", "b.n AS callee"))
def _(s, d):
    n, sup = T.table(s, d, "nation"), T.table(s, d, "supplier")
    # Numbers of nations and regions name files of two kinds; regions are moved away by a constant while they meet.
    far = F.col("n_regionkey") + 1000
    sym = sup.select(F.col("s_nationkey").cast("long").alias("file"), F.col("s_suppkey").cast("string").alias("name")).unionAll(n.select(far.cast("long"), "n_name"))
    e = linking.symbol_edges(n.select(F.col("n_nationkey").cast("long").alias("from"), far.cast("long").alias("to")), sym)
    return e.select("from", F.col("caller").cast("long").alias("caller"), (F.col("to") - 1000).alias("to"), "callee")


@query("text_calls_d21", r"""WITH c AS (SELECT page_id AS path, unnest(regexp_extract_all(html, '([A-Za-z_][A-Za-z0-9_]*)\s*\(', 1)) AS name FROM pages), g AS (SELECT path, name, count(*) AS n FROM c GROUP BY ALL)
SELECT path, name, n FROM g WHERE name IN (SELECT name FROM c GROUP BY name HAVING count(DISTINCT path) > 1)""")
def _(s, d):
    files = T.table(s, d, "pages").select(F.col("page_id").alias("path"), F.col("html").alias("text"))
    names = files.select("path", F.explode(linking.called_names(F.col("text"))).alias("name")).groupBy("name").agg(F.countDistinct("path").alias("p")).where("p > 1")
    return linking.text_calls(files, names)


@query("trace_edges_d22", f"""WITH {DEP}, n AS (SELECT 'nation/' || n_nationkey AS node FROM nation UNION ALL SELECT 'supplier/' || s_suppkey FROM supplier WHERE s_acctbal > 0 UNION ALL SELECT 'order/' || o_orderkey FROM orders WHERE o_orderstatus = 'F')
SELECT DISTINCT f AS "from", t AS "to", CASE kind WHEN 'import' THEN 'calls' WHEN 'reexport' THEN 'dependency' END AS kind FROM dep WHERE kind IN ('import', 'reexport') AND f IN (SELECT node FROM n) AND t IN (SELECT node FROM n)""")
def _(s, d):
    node = lambda t, kind, key, where="true": T.table(s, d, t).where(where).select(F.concat(F.lit(kind + "/"), F.col(key).cast("string")).alias("node"))
    nodes = node("nation", "nation", "n_nationkey").unionAll(node("supplier", "supplier", "s_suppkey", "s_acctbal > 0")).unionAll(node("orders", "order", "o_orderkey", "o_orderstatus = 'F'"))
    return linking.trace_edges(T.dependencies(s, d), nodes, {"import": "calls", "reexport": "dependency"})


@query("native_match_d23", """WITH r AS (SELECT item_id AS id, item_id % 7 AS symbol, item_id % 3 AS path, list_distinct(string_split(lower(text), ' ')) AS terms FROM benchmark),
m AS (SELECT a.id, b.id AS native_id, (CASE WHEN a.symbol = b.symbol THEN 100 ELSE 0 END + CASE WHEN a.path = b.path THEN 40 ELSE 0 END + least(30, 5 * len(list_intersect(a.terms, b.terms))))::INT AS score,
  a.symbol = b.symbol OR (a.path = b.path AND len(list_intersect(a.terms, b.terms)) > 0) AS ok FROM r a JOIN r b ON a.id % 2 = 0 AND b.id % 2 = 1)
SELECT id, native_id, score FROM m WHERE ok QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, native_id) = 1""")
def _(s, d):
    r = T.table(s, d, "benchmark").select(F.col("item_id").alias("id"), (F.col("item_id") % 7).alias("symbol"), (F.col("item_id") % 3).alias("path"), F.array_distinct(F.split(F.lower("text"), " ")).alias("terms"))
    return linking.best_native(r.where("id % 2 = 0"), r.where("id % 2 = 1"))


@query("deepest_region_d30", f"""WITH {FIL}, g AS (SELECT DISTINCT source AS region FROM documents UNION SELECT DISTINCT source || '/' || lang FROM documents WHERE lang IN ('en', 'de'))
SELECT path, max_by(region, len(region)) AS region FROM fil JOIN g ON starts_with(path, region || '/') GROUP BY path""")
def _(s, d):
    docs = T.table(s, d, "documents")
    regions = docs.select(F.col("source").alias("region")).distinct().union(docs.where("lang in ('en', 'de')").select(F.concat_ws("/", "source", "lang")).distinct())
    return linking.deepest_region(T.files(s, d), regions)


@query("region_links_e25", f"""WITH {DEP}, g AS (SELECT split_part(f, '/', 1) AS region, split_part(t, '/', 1) AS other, count(*) AS edges, count(DISTINCT f) AS files FROM dep GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY region ORDER BY edges DESC, other) AS rank FROM g WHERE region <> other QUALIFY rank <= 8""")
def _(s, d):
    e = T.dependencies(s, d)
    nodes = e.select(F.col("from").alias("path")).union(e.select("to")).distinct()
    return linking.region_links(e, nodes.withColumn("region", F.split_part("path", F.lit("/"), F.lit(1))))


@query("remap_b11", f"""WITH {FIL}, m AS (SELECT * FROM (VALUES (0, 'src1/en', 'moved/english'), (1, 'src1', 'moved/rest'), (2, 'src2/de', 'de')) v(pos, source, target)),
h AS (SELECT path, min_by(target || substr(path, len(source) + 1), pos) AS new_path FROM fil JOIN m ON path = source OR starts_with(path, source || '/') GROUP BY path)
SELECT path, new_path FROM fil LEFT JOIN h USING (path)""")
def _(s, d):
    moves = s.createDataFrame([(0, "src1/en", "moved/english"), (1, "src1", "moved/rest"), (2, "src2/de", "de")], "pos int, source string, target string")
    return linking.remap(T.files(s, d), moves)


@query("export_delta_d36", f"""WITH {SYM}, b AS (SELECT DISTINCT file AS path, line AS name, kind AS old FROM sym WHERE exported), a AS (SELECT DISTINCT file AS path, line AS name, CASE WHEN line % 5 = 0 THEN 'class' ELSE kind END AS new FROM sym WHERE line % 7 <> 0)
SELECT coalesce(b.path, a.path) AS path, coalesce(b.name, a.name) AS name, old, new, CASE WHEN old IS NULL THEN 'added' WHEN new IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM b FULL OUTER JOIN a ON b.path = a.path AND b.name = a.name WHERE old IS DISTINCT FROM new""")
def _(s, d):
    sym = T.symbols(s, d).select(F.col("file").alias("path"), F.col("line").alias("name"), "kind", "exported")
    after = sym.where("name % 7 <> 0").select("path", "name", F.when(F.col("name") % 5 == 0, "class").otherwise(F.col("kind")).alias("kind"))
    return linking.export_delta(sym.where("exported"), after)


@query("breadth_f11", """SELECT region, depth, size, score FROM (SELECT 'n' || c_nationkey AS region, 1 AS depth, count(*) AS size, 0::BIGINT AS score FROM customer GROUP BY 1 UNION ALL SELECT 'n' || c_nationkey || '/' || c_mktsegment, 2, count(*), count(*) * 2 FROM customer GROUP BY 1)
ORDER BY (depth = 1)::INT DESC, CASE WHEN depth = 1 THEN size ELSE score END DESC, region LIMIT 40""")
def _(s, d):
    n = F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))
    c = T.table(s, d, "customer")
    one = c.groupBy(n.alias("region")).agg(F.count("*").alias("size")).select("region", F.lit(1).alias("depth"), "size", F.lit(0).cast("long").alias("score"))
    two = c.groupBy(F.concat_ws("/", n, "c_mktsegment").alias("region")).agg(F.count("*").alias("size")).select("region", F.lit(2).alias("depth"), "size", (F.col("size") * 2).alias("score"))
    return linking.breadth_first(one.unionAll(two), 40)


# --------------------------------------------------------------------------- edits, findings, runs (K, L)

EDITED = "ed AS (SELECT path, CASE WHEN size % 5 = 0 THEN NULL ELSE size % 11 END AS want, size % 13 AS have FROM fil)"


@query("edit_violations_k3", f"""WITH {FIL}, {EDITED}, v AS (SELECT DISTINCT path, want, have, starts_with(path, 'src1/') OR starts_with(path, 'src2/en/') AS ok FROM ed)
SELECT path, code FROM (SELECT path, unnest([CASE WHEN NOT ok THEN 'OUT_OF_SCOPE' END, CASE WHEN have = 3 THEN 'MISSING_FILE' END, CASE WHEN have <> 3 AND have <> want THEN 'STALE_CONTENT' END]) AS code FROM v) WHERE code IS NOT NULL""")
def _(s, d):
    f = T.files(s, d)
    edits = f.select("path", F.when(F.col("size") % 5 != 0, F.col("size") % 11).alias("expected_sha"))
    granted = s.createDataFrame([("src1",), ("src2/en",)], "prefix string")
    return validation.edit_violations(edits, f.where("size % 13 <> 3").select("path", (F.col("size") % 13).alias("sha")), granted)


@query("added_bytes_e30", "SELECT coalesce(sum(greatest(0, strlen(replace(text, ' the ', ' a longer ')) - strlen(text))), 0)::BIGINT AS added, max(strlen(replace(text, ' the ', ' a longer ')))::INT AS largest, coalesce(sum(greatest(0, strlen(replace(text, ' the ', ' a longer ')) - strlen(text))), 0) <= 100000 AND max(strlen(replace(text, ' the ', ' a longer '))) <= 50000000 AS within FROM documents")
def _(s, d):
    docs = T.table(s, d, "documents").select(F.col("text").alias("before"), F.replace("text", F.lit(" the "), F.lit(" a longer ")).alias("after"))
    return validation.added_bytes(docs, 50_000_000, 100_000)


FOUND = r"""ch AS (SELECT CASE WHEN doc_id % 9 = 0 THEN '../' ELSE '' END || source || '/' || doc_id % 50 || CASE WHEN doc_id % 4 = 0 THEN '.json' ELSE '.md' END AS path, doc_id, text AS before, CASE WHEN doc_id % 3 = 0 THEN text WHEN doc_id % 3 = 1 THEN '{"a": ' || doc_id || '}' ELSE '<<<<<<< ours' END AS after FROM documents),
x AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY before NULLS FIRST, after NULLS FIRST) AS n FROM ch),
fi AS (SELECT path, unnest([CASE WHEN doc_id % 9 = 0 THEN 'INVALID_PATH' END, CASE WHEN n > 1 THEN 'DUPLICATE_CHANGE' END, CASE WHEN before IS NOT DISTINCT FROM after THEN 'NOOP_CHANGE' END, CASE WHEN strlen(after) > 5000 THEN 'FILE_TOO_LARGE' END,
  CASE WHEN regexp_matches(after, '(?m)^(<<<<<<<|=======|>>>>>>>) ') THEN 'CONFLICT_MARKER' END, CASE WHEN doc_id % 4 = 0 AND after IS NOT NULL AND NOT json_valid(after) THEN 'INVALID_JSON' END]) AS code FROM x)"""


def _findings(s, d):
    i = F.col("doc_id")
    path = F.concat(F.when(i % 9 == 0, "../").otherwise(""), "source", F.lit("/"), (i % 50).cast("string"), F.when(i % 4 == 0, ".json").otherwise(".md"))
    after = F.when(i % 3 == 0, F.col("text")).when(i % 3 == 1, F.concat(F.lit('{"a": '), i.cast("string"), F.lit("}"))).otherwise("<<<<<<< ours")
    return validation.structural_findings(T.table(s, d, "documents").select(path.alias("path"), F.col("text").alias("before"), after.alias("after")), 5000)


@query("structural_k8", f"WITH {FOUND} SELECT path, code, CASE WHEN code = 'NOOP_CHANGE' THEN 'warning' ELSE 'error' END AS severity FROM fi WHERE code IS NOT NULL")
def _(s, d):
    return _findings(s, d)


@query("passed_e31", f"WITH {FOUND} SELECT path, count(*) FILTER (code <> 'NOOP_CHANGE') AS errors, count(*) FILTER (code = 'NOOP_CHANGE') AS warnings, count(*) FILTER (code <> 'NOOP_CHANGE') = 0 AS passed FROM fi WHERE code IS NOT NULL GROUP BY path")
def _(s, d):
    return validation.passed(_findings(s, d), ["path"])


@query("ranked_findings_f13", """WITH f AS (SELECT event_type AS analyzer, user_id AS path, CASE event_id % 3 WHEN 0 THEN 'error' WHEN 1 THEN 'warning' ELSE 'info' END AS severity, event_id AS idx FROM events),
s AS (SELECT *, CASE WHEN path IN (SELECT user_id FROM events WHERE event_type = 'signup') THEN 100 ELSE 0 END + CASE severity WHEN 'error' THEN 30 WHEN 'warning' THEN 20 ELSE 10 END AS score FROM f)
SELECT *, row_number() OVER (PARTITION BY analyzer ORDER BY score DESC, idx) AS rank FROM s QUALIFY rank <= 10""")
def _(s, d):
    e, m = T.table(s, d, "events"), F.col("event_id") % 3
    f = e.select(F.col("event_type").alias("analyzer"), F.col("user_id").alias("path"), F.when(m == 0, "error").when(m == 1, "warning").otherwise("info").alias("severity"), F.col("event_id").alias("idx"))
    return validation.ranked_findings(f, e.where("event_type = 'signup'").select(F.col("user_id").alias("path")))


@query("failure_class_l10", """SELECT page_id, CASE WHEN regexp_matches(lower(url), 'promot|publish|commit') THEN 'promotion_failure' WHEN regexp_matches(lower(url), 'validat|validate|test|audit|diff') THEN 'validation_failure' WHEN contains(lower(url), 'propagat') THEN 'propagation_failure'
  WHEN regexp_matches(lower(url), 'corridor|context|plan') THEN 'planning_failure' WHEN regexp_matches(lower(url), 'mutat|patch') THEN 'mutation_failure' ELSE 'native_execution_failure' END AS failure FROM pages""")
def _(s, d):
    return T.table(s, d, "pages").select("page_id", validation.failure_class(F.col("url")).alias("failure"))


@query("admitted_l11", """WITH e AS (SELECT event_id, event_type, sha256(user_id || ':' || props) AS fingerprint FROM events WHERE props IS NOT NULL)
SELECT event_id, fingerprint FROM e WHERE fingerprint NOT IN (SELECT fingerprint FROM e WHERE event_type = 'error') AND event_type <> 'error' QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY event_id) = 1""")
def _(s, d):
    e = T.table(s, d, "events").where("props is not null").select("event_id", "event_type", F.sha2(F.concat_ws(":", F.col("user_id").cast("string"), "props"), 256).alias("fingerprint"))
    return validation.admitted(e.where("event_type <> 'error'").select("event_id", "fingerprint"), e.where("event_type = 'error'"), "fingerprint", "event_id")


@query("tiered_seed_f8", f"""WITH {STA}, t AS (SELECT file, CASE access WHEN 'write' THEN 0 WHEN 'read' THEN 1 ELSE 2 END AS tier, count(*) AS score FROM sta GROUP BY ALL) SELECT file, tier, score FROM t QUALIFY row_number() OVER (PARTITION BY file ORDER BY tier, score DESC) = 1""")
def _(s, d):
    a = F.col("access")
    t = T.states(s, d).groupBy("file", F.when(a == "write", 0).when(a == "read", 1).otherwise(2).alias("tier")).agg(F.count("*").alias("score"))
    return ranking.top_k(t, ["file"], ["tier", F.col("score").desc()], 1).select("file", "tier", "score")
