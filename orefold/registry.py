"""Queries by name over the driver's tables, and the DuckDB SQL of each that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orefold.functions import paths, source, text
from orefold.operators import facts, graph, joins, ranking, rollups
from orefold.plans import impact
from orefold.sources import testdata as T
from orefold.streaming import runs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# The fact tables of orefold.sources.testdata, in SQL.
DEP = """dep AS (
  SELECT 'order/' || l_orderkey AS f, 'part/' || l_partkey AS t, 'import' AS kind FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)
  UNION ALL SELECT 'order/' || l_orderkey, 'supplier/' || l_suppkey, 'import' FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem)
  UNION ALL SELECT 'order/' || o_orderkey, 'customer/' || o_custkey, 'require' FROM orders
  UNION ALL SELECT 'customer/' || c_custkey, 'nation/' || c_nationkey, 'reexport' FROM customer
  UNION ALL SELECT 'supplier/' || s_suppkey, 'nation/' || s_nationkey, 'reexport' FROM supplier
  UNION ALL SELECT 'nation/' || n_nationkey, 'region/' || n_regionkey, 'manifest' FROM nation)"""
CYC = """cyc AS (SELECT DISTINCT f, t FROM (
  SELECT strftime(ts, '%d') || '/' || event_type AS f, lead(strftime(ts, '%d') || '/' || event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t FROM events) WHERE t IS NOT NULL)"""
STA = """sta AS (SELECT strftime(ts, '%d') AS namespace, json_extract_string(props, '$.k') AS key, 'user/' || user_id AS file,
  CASE event_type WHEN 'view' THEN 'read' WHEN 'purchase' THEN 'write' WHEN 'signup' THEN 'write' WHEN 'error' THEN 'delete' ELSE 'unknown' END AS access, event_id AS line FROM events)"""
FIL = "fil AS (SELECT source || '/' || lang || '/doc-' || doc_id || '.md' AS path, n_chars AS size, text FROM documents)"
SYM = "sym AS (SELECT p_name AS name, p_brand AS file, p_type AS kind, p_size > 25 AS exported, p_partkey AS line FROM part)"
FAMILY = r"regexp_replace(lower(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\1-\2', 'g'), '[_\s]+', '-', 'g')), '-(feature|service|adapter|controller|manager)$', '')"


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f
    return add


# --------------------------------------------------------------------------- rollups (E)

@query("fan_out_e1", f"WITH {DEP} SELECT f AS file, count(DISTINCT t) AS fan_out FROM dep GROUP BY f HAVING count(DISTINCT t) >= 5")
def _(s, d):
    return rollups.fan_out(T.dependencies(s, d))


@query("fan_in_e2", f"WITH {DEP} SELECT t AS file, count(DISTINCT f) AS fan_in FROM dep GROUP BY t HAVING count(DISTINCT f) >= 4")
def _(s, d):
    return rollups.fan_in(T.dependencies(s, d))


@query("watershed_e4", f"""WITH {DEP}, e AS (SELECT DISTINCT f, t FROM dep), d AS (
  SELECT file, sum(i)::BIGINT AS fan_in, sum(o)::BIGINT AS fan_out FROM (SELECT t AS file, 1 AS i, 0 AS o FROM e UNION ALL SELECT f, 0, 1 FROM e) GROUP BY file),
n AS (SELECT 'order/' || l_orderkey AS file, count(*) AS effects FROM lineitem GROUP BY 1)
SELECT file, fan_in, fan_out, coalesce(effects, 0) AS effects, 3 * fan_in + fan_out + 2 * coalesce(effects, 0) AS score FROM d LEFT JOIN n USING (file)
WHERE 3 * fan_in + fan_out + 2 * coalesce(effects, 0) >= 6""")
def _(s, d):
    return rollups.watersheds(T.dependencies(s, d), T.effects(s, d))


@query("integration_e5", f"""WITH {DEP}, {STA}, {SYM}, e AS (SELECT DISTINCT f, t FROM dep)
SELECT file, sum(w)::BIGINT AS score FROM (SELECT t AS file, 3 AS w FROM e UNION ALL SELECT f, 2 FROM e UNION ALL SELECT 'order/' || l_orderkey, 2 FROM lineitem
  UNION ALL SELECT file, 1 FROM sta UNION ALL SELECT file, 1 FROM sym WHERE exported) GROUP BY file HAVING sum(w) >= 5""")
def _(s, d):
    return rollups.integration(T.dependencies(s, d), T.effects(s, d), T.states(s, d), T.symbols(s, d).where("exported"))


@query("families_e6", f"""WITH {SYM} SELECT {FAMILY} AS family, count(*) AS members, count(DISTINCT file) AS files, sum(exported::INT)::BIGINT AS exported,
  CASE WHEN sum(exported::INT) > 1 AND count(DISTINCT file) > 1 THEN 'distributed' ELSE 'family' END AS kind FROM sym GROUP BY 1 HAVING count(*) > 1""")
def _(s, d):
    return rollups.families(T.symbols(s, d))


@query("atlas_rollup_e21", f"""WITH {FIL}, up AS (SELECT size, unnest(list_transform(range(1, len(string_split(path, '/'))), lambda i: array_to_string(string_split(path, '/')[1:i], '/'))) AS directory FROM fil)
SELECT directory, count(*) AS files, sum(size)::BIGINT AS size FROM up GROUP BY directory""")
def _(s, d):
    return rollups.directory_rollup(T.files(s, d), ["size"])


@query("ledger_e23", f"WITH {FIL} SELECT regexp_extract(lower(path), '[^/](\\.[^./]+)$', 1) AS extension, count(*) AS files, sum(size)::BIGINT AS size, count(text) AS with_text FROM fil GROUP BY 1")
def _(s, d):
    return T.files(s, d).groupBy(paths.extension(F.col("path")).alias("extension")).agg(F.count("*").alias("files"), F.sum("size").alias("size"), F.count("text").alias("with_text"))


@query("region_stats_e24", f"""WITH {FIL}, p AS (SELECT path, list_transform(range(1, least(3, len(string_split(path, '/')) - 1) + 1), lambda i: array_to_string(string_split(path, '/')[1:i], '/')) AS dirs FROM fil),
link AS (SELECT a.dirs AS x, b.dirs AS y FROM p a JOIN documents d ON a.path = d.source || '/' || d.lang || '/doc-' || d.doc_id || '.md' JOIN documents e ON e.doc_id = d.doc_id + 1 JOIN p b ON b.path = e.source || '/' || e.lang || '/doc-' || e.doc_id || '.md'),
r AS (SELECT unnest(dirs) AS region FROM p), c AS (SELECT unnest(list_concat(list_filter(x, lambda v: NOT list_contains(y, v)), list_filter(y, lambda v: NOT list_contains(x, v)))) AS region FROM link)
SELECT region, count(*) AS files, coalesce(max(n), 0) AS boundary FROM r LEFT JOIN (SELECT region, count(*) AS n FROM c GROUP BY 1) USING (region) GROUP BY region""")
def _(s, d):
    f = T.files(s, d)
    n = F.regexp_extract("path", r"doc-(-?\d+)\.md$", 1).cast("long")
    a, b = f.select(F.col("path").alias("from"), (n + 1).alias("n")), f.select(F.col("path").alias("to"), n.alias("n"))
    return rollups.region_stats(f, a.join(b, "n").select("from", "to"))


@query("first_seen_e26", f"""WITH {STA}, f AS (SELECT namespace, file, min(line) AS line FROM sta GROUP BY ALL)
SELECT namespace, file, line, row_number() OVER (PARTITION BY namespace ORDER BY line) AS rank FROM f QUALIFY rank <= 12""")
def _(s, d):
    return ranking.top_k(T.states(s, d).groupBy("namespace", "file").agg(F.min("line").alias("line")), ["namespace"], ["line"], 12)


@query("strongest_b54", """SELECT l_orderkey, CASE max(CASE l_returnflag WHEN 'A' THEN 5 WHEN 'N' THEN 3 ELSE 1 END) WHEN 5 THEN 'native-confirmed' WHEN 3 THEN 'cross-map-confirmed' ELSE 'unresolved' END AS reconciliation FROM lineitem GROUP BY 1""")
def _(s, d):
    label = F.when(F.col("l_returnflag") == "A", "native-confirmed").when(F.col("l_returnflag") == "N", "cross-map-confirmed").otherwise("unresolved")
    return T.table(s, d, "lineitem").groupBy("l_orderkey").agg(text.strongest(label).alias("reconciliation"))


@query("coverage_b58", "SELECT l_shipdate::DATE AS day, CAST(floor(100 * count(*) FILTER (l_linestatus = 'F') / count(*) + 0.5) AS INT) AS percent FROM lineitem GROUP BY 1")
def _(s, d):
    return T.table(s, d, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("day")).agg(text.percent(F.count_if(F.col("l_linestatus") == "F"), F.count("*")).alias("percent"))


# --------------------------------------------------------------------------- scalars (B)

@query("path_normalize_b1", r"""WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS url FROM pages)
SELECT page_id, array_to_string(list_filter(string_split(replace(trim(url), '\', '/'), '/'), lambda x: x NOT IN ('', '.')), '/') AS path FROM p""")
def _(s, d):
    return T.table(s, d, "pages").select("page_id", paths.normalize(F.regexp_replace("url", "^[a-z]+://", "")).alias("path"))


@query("extension_b5", r"SELECT page_id, lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '[^/](\.[^./]+)$', 1)) AS extension FROM pages")
def _(s, d):
    return T.table(s, d, "pages").select("page_id", paths.extension(F.regexp_replace("url", "[?#].*$", "")).alias("extension"))


@query("prefixes_b9", f"WITH {FIL} SELECT path, unnest(list_transform(range(1, least(3, len(string_split(path, '/')) - 1) + 1), lambda i: array_to_string(string_split(path, '/')[1:i], '/'))) AS prefix FROM fil")
def _(s, d):
    return T.files(s, d).select("path", F.explode(paths.prefixes(F.col("path"))).alias("prefix"))


@query("line_number_b21", "SELECT doc_id, 1 + len(left(text, 500)) - len(replace(left(text, 500), chr(10), '')) AS line FROM documents")
def _(s, d):
    return T.table(s, d, "documents").select("doc_id", text.line_number(F.col("text"), F.lit(500)).alias("line"))


@query("terms_b23", r"""SELECT item_id, w.term FROM benchmark, LATERAL (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(
  lower(regexp_replace(regexp_replace(text, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[_.\\/:-]+', ' ', 'g')), '[^a-z0-9$]+'), lambda x: len(x) >= 3 AND x NOT IN ('the', 'and'))) AS term) w""")
def _(s, d):
    return T.table(s, d, "benchmark").select("item_id", F.explode(text.terms(F.col("text"), ("the", "and"))).alias("term"))


AND = "(the )?(add|allow|apply|bind|call|clear|create|display|emit|execute|persist|prevent|prompt|record|render|reset|return|roll|route|run|select|show|spend|update|use|validate)"


@query("clauses_b25", rf"""WITH t AS (SELECT conv_id, turn, trim(regexp_replace(text || ' e.g. foo. Bar; then x and update y, and z', '\s+', ' ', 'g')) AS text FROM conversations),
a AS (SELECT conv_id, turn, unnest(string_split(regexp_replace(regexp_replace(regexp_replace(text, '\s*;\s*|\s*,\s*', chr(1), 'g'), '\s*\.\s+([A-Z0-9])', chr(1) || '\1', 'g'), '(?i)\s+(then|while|but|so that)\s+', chr(1), 'g'), chr(1))) AS p FROM t),
b AS (SELECT conv_id, turn, unnest(string_split(regexp_replace(p, '(?i)\s+and\s+{AND}\b', chr(1) || '\1\2', 'g'), chr(1))) AS p FROM a)
SELECT conv_id, turn, clause, count(*) AS n FROM (SELECT conv_id, turn, regexp_replace(trim(p), '(?i)^and\s+', '') AS clause FROM b) WHERE clause <> '' GROUP BY ALL""")
def _(s, d):
    text_ = F.concat("text", F.lit(" e.g. foo. Bar; then x and update y, and z"))
    return T.table(s, d, "conversations").select("conv_id", "turn", F.explode(text.clauses(text_)).alias("clause")).groupBy("conv_id", "turn", "clause").agg(F.count("*").alias("n"))


@query("family_token_b26", f"SELECT DISTINCT name, {FAMILY} AS family FROM (SELECT p_name AS name FROM part)")
def _(s, d):
    return T.symbols(s, d).select("name", text.family(F.col("name")).alias("family")).distinct()


@query("slug_b29", "SELECT doc_id, CASE WHEN s = '' THEN 'probe' ELSE s END AS slug FROM (SELECT doc_id, left(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 64) AS s FROM documents)")
def _(s, d):
    return T.table(s, d, "documents").select("doc_id", text.slug(F.col("text")).alias("slug"))


@query("occurrences_b35", "SELECT doc_id, (len(text) - len(replace(text, 'th', ''))) // 2 AS n FROM documents")
def _(s, d):
    return T.table(s, d, "documents").select("doc_id", text.occurrences(F.col("text"), F.lit("th")).alias("n"))


@query("stable_id_b70", f"WITH {SYM} SELECT line, 'symbol-' || left(sha256(file || chr(0) || name || chr(0) || line), 20) AS id FROM sym")
def _(s, d):
    return T.symbols(s, d).select("line", text.stable_id("symbol", F.col("file"), F.col("name"), F.col("line").cast("string")).alias("id"))


@query("pressure_b60", "SELECT doc_id, CASE WHEN n <= 500 THEN 'minimal' WHEN n <= 800 THEN 'moderate' WHEN n <= 1200 THEN 'high' ELSE 'very-high' END AS pressure FROM (SELECT doc_id, len(string_split(text, ' ')) AS n FROM documents)")
def _(s, d):
    return T.table(s, d, "documents").select("doc_id", text.pressure(F.size(F.split("text", " "))).alias("pressure"))


# --------------------------------------------------------------------------- extraction and joins (C, D, H)

@query("template_refs_c3", r"""WITH r AS (SELECT page_id, unnest(regexp_extract_all(html, '(?i)(?:src|href)\s*=\s*["'']([^"'']+)["'']', 1)) AS specifier FROM pages) SELECT page_id, specifier, count(*) AS n FROM r GROUP BY ALL""")
def _(s, d):
    files = T.table(s, d, "pages").select("page_id", F.explode(source.matches(F.col("html"), *facts.TEMPLATE_REFERENCE)).alias("m"))
    return files.groupBy("page_id", F.col("m.a").alias("specifier")).agg(F.count("*").alias("n"))


@query("resolve_import_d1", r"""WITH f AS (SELECT DISTINCT replace(p_brand, '#', '') || '.' || suffix AS path FROM part, (VALUES ('js'), ('ts'), ('json')) v(suffix) WHERE (p_size % 3 = 0 AND suffix = 'js') OR (p_size % 3 = 1 AND suffix = 'ts') OR (p_size % 3 = 2 AND suffix = 'json')),
c AS (SELECT p_partkey, replace(p_brand, '#', '') || e.ending AS want, e.pos FROM part, (VALUES ('.js', 0), ('.ts', 4), ('.json', 8)) e(ending, pos))
SELECT p_partkey, arg_min(want, pos) AS match FROM c JOIN f ON c.want = f.path GROUP BY 1""")
def _(s, d):
    part = T.table(s, d, "part").withColumn("p_brand", F.replace("p_brand", F.lit("#"), F.lit("")))
    ending = F.when(F.col("p_size") % 3 == 0, ".js").when(F.col("p_size") % 3 == 1, ".ts").otherwise(".json")
    files = part.select(F.concat("p_brand", ending).alias("path")).distinct()
    probe = part.select("p_partkey", "p_brand")
    return joins.first_match(probe, "p_partkey", paths.candidates(F.lit("main.js"), F.concat(F.lit("./"), "p_brand")), files, "path").select("p_partkey", "match")


@query("unique_provider_d6", """WITH s AS (SELECT l_partkey, min(l_suppkey) AS lo, max(l_suppkey) AS hi, count(*) AS calls FROM lineitem GROUP BY 1)
SELECT p_partkey, CASE WHEN lo = hi THEN lo END AS provider, coalesce(calls, 0) AS calls, coalesce(lo <> hi, false) AS ambiguous FROM part LEFT JOIN s ON p_partkey = l_partkey""")
def _(s, d):
    calls = T.table(s, d, "lineitem").groupBy("l_partkey").agg(F.min("l_suppkey").alias("lo"), F.max("l_suppkey").alias("hi"), F.count("*").alias("calls"))
    j = T.table(s, d, "part").join(calls, F.col("p_partkey") == F.col("l_partkey"), "left")
    return j.select("p_partkey", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("provider"), F.coalesce("calls", F.lit(0)).alias("calls"), F.coalesce(F.col("lo") != F.col("hi"), F.lit(False)).alias("ambiguous"))


@query("asof_owner_d8", """SELECT p.event_id, (SELECT max_by(f.event_id, (f.ts, -f.event_id)) FROM events f WHERE f.user_id = p.user_id AND f.event_type = 'view' AND f.ts <= p.ts) AS owner
FROM events p WHERE p.event_type = 'purchase'""")
def _(s, d):
    e = T.table(s, d, "events")
    probe = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    facts = e.where("event_type = 'view'").select("user_id", F.col("ts").alias("since"), F.col("event_id").alias("owner"))
    return joins.asof(probe, facts, ["user_id"], "ts", "since", ["owner"], ["owner"]).select("event_id", "owner")


@query("positional_bind_d14", """WITH p AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS i FROM lineitem),
a AS (SELECT l_orderkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_linenumber) - 1 AS i FROM lineitem)
SELECT l_orderkey, i, l_partkey, l_suppkey FROM p JOIN a USING (l_orderkey, i)""")
def _(s, d):
    from pyspark.sql.window import Window
    line = T.table(s, d, "lineitem")
    at = lambda *o: (F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*o)) - 1).cast("long").alias("i")
    p = line.select("l_orderkey", "l_partkey", at("l_linenumber", "l_partkey"))
    return p.join(line.select("l_orderkey", "l_suppkey", at("l_extendedprice", "l_linenumber")), ["l_orderkey", "i"])


@query("state_propagation_d16", f"""WITH {STA}, w AS (SELECT namespace, key, file AS writer, count(*) AS a FROM sta WHERE access IN ('write', 'delete') GROUP BY ALL), r AS (SELECT namespace, key, file AS reader, count(*) AS b FROM sta WHERE access = 'read' GROUP BY ALL)
SELECT namespace, key, writer, reader, a * b AS links FROM w JOIN r USING (namespace, key) WHERE writer <> reader""")
def _(s, d):
    return impact.state_links(T.states(s, d))


@query("supplement_anti_d24", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_totalprice > 200000)")
def _(s, d):
    orders = T.table(s, d, "orders").where("o_orderstatus = 'F' and o_totalprice > 200000")
    return T.table(s, d, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


CHANGED = "SELECT 'nation/' || n_nationkey AS file FROM nation WHERE n_name < 'C' UNION ALL SELECT 'supplier/' || s_suppkey FROM supplier WHERE s_acctbal < 0"


def _changed(s, d):
    n = T.table(s, d, "nation").where("n_name < 'C'").select(F.concat(F.lit("nation/"), F.col("n_nationkey").cast("string")).alias("file"))
    return n.unionAll(T.table(s, d, "supplier").where("s_acctbal < 0").select(F.concat(F.lit("supplier/"), F.col("s_suppkey").cast("string"))))


@query("immediate_consumers_d27", f"WITH {DEP}, c AS ({CHANGED}) SELECT DISTINCT f AS file FROM dep WHERE t IN (SELECT file FROM c) AND f NOT IN (SELECT file FROM c)")
def _(s, d):
    return impact.immediate_consumers(T.dependencies(s, d), _changed(s, d))


@query("full_outer_diff_d35", """WITH b AS (SELECT doc_id, md5(text) AS v FROM documents WHERE lang <> 'de'), a AS (SELECT doc_id, md5(CASE WHEN source = 'src1' THEN text || '!' ELSE text END) AS v FROM documents WHERE lang <> 'es')
SELECT coalesce(b.doc_id, a.doc_id) AS doc_id, b.v AS before, a.v AS after, CASE WHEN b.v IS NULL THEN 'added' WHEN a.v IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM b FULL OUTER JOIN a ON b.doc_id = a.doc_id WHERE b.v IS DISTINCT FROM a.v""")
def _(s, d):
    docs = T.table(s, d, "documents")
    after = F.when(F.col("source") == "src1", F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return joins.diff(docs.where("lang <> 'de'").select("doc_id", F.md5("text").alias("v")), docs.where("lang <> 'es'").select("doc_id", F.md5(after).alias("v")), "doc_id", "v")


@query("merge_h6", "SELECT user_id, event_type, max_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL")
def _(s, d):
    e = T.table(s, d, "events").select("user_id", "event_type", F.struct("ts", "event_id").alias("seq"), "event_id")
    return joins.last_wins(e, ["user_id", "event_type"], "seq").select("user_id", "event_type", "event_id")


@query("except_h3", "SELECT l_partkey AS key FROM lineitem WHERE l_quantity < 10 EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 40")
def _(s, d):
    line = T.table(s, d, "lineitem")
    return line.where("l_quantity < 10").select(F.col("l_partkey").alias("key")).subtract(line.where("l_quantity > 40").select("l_partkey"))


@query("intersect_h4", "SELECT l_suppkey AS key FROM lineitem WHERE l_quantity > 49 INTERSECT SELECT l_suppkey FROM lineitem WHERE l_discount = 0")
def _(s, d):
    line = T.table(s, d, "lineitem")
    return line.where("l_quantity > 49").select(F.col("l_suppkey").alias("key")).intersect(line.where("l_discount = 0").select("l_suppkey"))


@query("xor_h5", "(SELECT o_custkey AS key FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') UNION ALL (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def _(s, d):
    o = T.table(s, d, "orders").select(F.col("o_custkey").alias("key"), "o_orderstatus")
    return joins.xor(o.where("o_orderstatus = 'F'").select("key"), o.where("o_orderstatus = 'O'").select("key"))


# --------------------------------------------------------------------------- rankings (F)

@query("owner_margin_f4", """WITH c AS (SELECT o_custkey, c_mktsegment AS segment, count(*) AS score FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
r AS (SELECT segment, o_custkey, score, lead(score) OVER w AS runner_up, row_number() OVER w AS i FROM c WINDOW w AS (PARTITION BY segment ORDER BY score DESC, o_custkey))
SELECT segment, o_custkey, score, runner_up, score >= 4 AND score - coalesce(runner_up, 0) >= 2 AS owned FROM r WHERE i = 1""")
def _(s, d):
    j = T.table(s, d, "orders").join(T.table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return ranking.owner_margin(j.groupBy("o_custkey", F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("score")), "segment", "score", "o_custkey")


@query("topk_per_group_f13", "SELECT c_nationkey, c_custkey, c_acctbal, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer QUALIFY rank <= 10")
def _(s, d):
    return ranking.top_k(T.table(s, d, "customer").select("c_nationkey", "c_custkey", "c_acctbal"), ["c_nationkey"], [F.col("c_acctbal").desc(), "c_custkey"], 10)


@query("lead_span_f3", f"WITH {SYM} SELECT file, line, coalesce(lead(line) OVER (PARTITION BY file ORDER BY line, name) - 1, 1000000) AS line_end FROM sym")
def _(s, d):
    return ranking.spans(T.symbols(s, d).select("file", "line", "name"), "file", ["line", "name"], "line", F.lit(1_000_000)).drop("name")


@query("stage_batch_f21", "SELECT n_regionkey, c_custkey, CAST((row_number() OVER (PARTITION BY n_regionkey ORDER BY c_custkey) - 1) // 16 AS INT) AS stage FROM customer JOIN nation ON c_nationkey = n_nationkey")
def _(s, d):
    j = T.table(s, d, "customer").join(T.table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("n_regionkey", "c_custkey")
    return ranking.stages(j, "n_regionkey", ["c_custkey"], 16)


# --------------------------------------------------------------------------- graphs (G)

@query("topo_g3", f"WITH RECURSIVE {DEP}, e AS (SELECT DISTINCT f, t FROM dep), l AS (SELECT f AS node, 0 AS level FROM e UNION SELECT t, 0 FROM e UNION SELECT e.f, l.level + 1 FROM l JOIN e ON e.t = l.node) SELECT node, max(level) AS level FROM l GROUP BY node")
def _(s, d):
    return graph.levels(T.dependencies(s, d))


CLOSED = f"{CYC}, r AS (SELECT f AS a, t AS b FROM cyc UNION SELECT r.a, cyc.t FROM r JOIN cyc ON r.b = cyc.f)"


@query("scc_g1", f"WITH RECURSIVE {CLOSED}, m AS (SELECT x.a, x.b FROM r x JOIN r y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b) SELECT a AS node, greatest(a, max(b)) AS component FROM m GROUP BY a")
def _(s, d):
    return graph.strong_components(T.transitions(s, d))


@query("components_g4", "SELECT 'o' || o_orderkey AS node, min('c' || o_custkey) AS component FROM orders GROUP BY 1 UNION ALL SELECT DISTINCT 'c' || o_custkey, 'c' || o_custkey FROM orders")
def _(s, d):
    e = T.table(s, d, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("from"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("to"))
    return graph.components(e)


@query("shortest_path_g5", f"WITH RECURSIVE {CYC}, u AS (SELECT f, t FROM cyc UNION SELECT t, f FROM cyc), p AS (SELECT '01/view' AS node, 0 AS hops UNION SELECT u.t, p.hops + 1 FROM p JOIN u ON u.f = p.node WHERE p.hops < 40) SELECT node, min(hops) AS hops FROM p GROUP BY node")
def _(s, d):
    return graph.shortest_paths(T.transitions(s, d), "01/view").select("node", (F.size("path") - 1).alias("hops"))


@query("transitive_g7", f"WITH RECURSIVE {DEP}, c AS ({CHANGED}), r AS (SELECT file AS node FROM c UNION SELECT dep.f FROM r JOIN dep ON dep.t = r.node) SELECT DISTINCT node AS file FROM r WHERE node NOT IN (SELECT file FROM c)")
def _(s, d):
    return impact.propagation(T.dependencies(s, d), _changed(s, d)).select("file")


@query("slice_forward_g10", f"WITH RECURSIVE {CYC}, r AS (SELECT '01/view' AS node, 0 AS hops UNION SELECT cyc.t, r.hops + 1 FROM r JOIN cyc ON cyc.f = r.node WHERE r.hops < 3) SELECT node, min(hops) AS hops FROM r GROUP BY node")
def _(s, d):
    return graph.reach(T.transitions(s, d), s.createDataFrame([("01/view",)], "node string"), 3)


@query("slice_backward_g10", f"WITH RECURSIVE {CYC}, r AS (SELECT '20/purchase' AS node, 0 AS hops UNION SELECT cyc.f, r.hops + 1 FROM r JOIN cyc ON cyc.t = r.node WHERE r.hops < 3) SELECT node, min(hops) AS hops FROM r GROUP BY node")
def _(s, d):
    back = T.transitions(s, d).toDF("to", "from")
    return graph.reach(back, s.createDataFrame([("20/purchase",)], "node string"), 3)


# --------------------------------------------------------------------------- plans, runs (I, L)

@query("file_score_i1", f"WITH {FIL} SELECT path, (CASE WHEN contains(lower(path), 'src1') THEN 6 ELSE 0 END + CASE WHEN contains(lower(path), 'license') THEN 7 ELSE 0 END + CASE WHEN contains(lower(text), 'src1') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'license') THEN 2 ELSE 0 END)::INT AS score FROM fil")
def _(s, d):
    return impact.relevance(T.files(s, d), ["src1", "license"], {"path": 6, "text": 1}).select("path", F.col("score").cast("int").alias("score"))


@query("event_seq_l9", "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence FROM events")
def _(s, d):
    return runs.sequence(T.table(s, d, "events").select("event_id", "user_id", "ts"), "user_id", ["ts", "event_id"]).drop("ts")


@query("windowed_counts_l9", "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def _(s, d):
    return runs.windowed_counts(T.table(s, d, "events"), "ts", "event_type")


from orefold import archive_queries, atlas_queries, case_queries, column_queries, contract_queries, dataflow_queries, diagnostic_queries, linkage_queries, planning_queries, policy_queries, source_queries  # noqa: E402, F401  - add their queries to QUERIES and ORACLES
