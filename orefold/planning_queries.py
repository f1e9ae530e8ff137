"""Queries of plans over many clauses: substrings, file scores, owners, probes, native hints; part of the registry."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orefold.functions import text
from orefold.operators import facts, substrings
from orefold.operators.graph import Rounds
from orefold.plans import claims, corridor, moves, packs, probes, projections
from orefold.registry import query
from orefold.source_queries import EFFS, LINKED, PROGRAM, STAT
from orefold.sources import testdata as T
from orefold.sources.store import Store
from orefold.streaming import sessions

C = F.col
# Items of the benchmark as clauses, their words of five letters or more as terms.
WORDS = "w AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(text, '[A-Za-z]{5,}')) AS term FROM benchmark)"


def _words(s, d):
    return T.table(s, d, "benchmark").select("item_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{5,}"), F.lit(0))).alias("term")).distinct()


@query("containing_q12", f"WITH {WORDS}, t AS (SELECT DISTINCT term FROM w) SELECT doc_id, count(*) AS n, min(term) AS first, max(term) AS last FROM documents JOIN t ON contains(text, term) GROUP BY doc_id")
def _(s, d):
    held = substrings.containing(T.table(s, d, "documents"), _words(s, d), ["doc_id"])
    return held.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("term").alias("first"), F.max("term").alias("last"))


@query("native_hints_i14", f"""WITH {WORDS}, f AS (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 6), h AS (SELECT DISTINCT item_id, doc_id FROM w JOIN documents ON contains(text, term) WHERE item_id % 50 <> 0 UNION ALL SELECT item_id, doc_id FROM benchmark, f WHERE item_id % 50 = 0)
SELECT h.item_id::VARCHAR AS region, row_number() OVER (PARTITION BY item_id ORDER BY doc_id) AS rank, 'native-' || doc_id || ' (' || source || ')' AS hint FROM h JOIN documents USING (doc_id) QUALIFY rank <= 6""")
def _(s, d):
    region = C("item_id").cast("string").alias("region")
    regions = T.table(s, d, "benchmark").select(region, F.when(C("item_id") % 50 == 0, "repository").otherwise("directory").alias("kind"))
    records = T.table(s, d, "documents").select(C("doc_id").alias("pos"), F.concat(F.lit("native-"), C("doc_id").cast("string")).alias("id"), "source", C("text").alias("serialized"))
    return probes.native_hints(regions, _words(s, d).select(region, C("term").alias("path")), records)


def _model(s, d):
    return facts.model(T.programs(s, d), keep=Rounds(s).save)


# Each supplier asks for the function of its number: a term "f<n>" lies in names, effects and texts of all programs whose number begins so.
ASKED = f"""{LINKED}, d AS (SELECT file AS f, "to" AS t FROM linked WHERE "to" IS NOT NULL), i AS (SELECT t AS path, count(*) AS n FROM d GROUP BY 1), o AS (SELECT f AS path, count(*) AS n FROM d GROUP BY 1),
g AS (SELECT file AS path, k, least(4, coalesce(i.n, 0)) + least(3, coalesce(o.n, 0)) AS degrees FROM prog LEFT JOIN i ON i.path = file LEFT JOIN o ON o.path = file),
c AS (SELECT 'clause-' || s_suppkey AS clause, s_suppkey AS j FROM supplier), sc AS (SELECT clause, path, degrees + 10 AS score FROM c JOIN g ON starts_with(k::VARCHAR, j::VARCHAR)),
b AS (SELECT path, degrees FROM g ORDER BY degrees DESC, path LIMIT 4), every AS (SELECT * FROM sc UNION ALL SELECT clause, path, degrees FROM c, b WHERE NOT EXISTS (SELECT 1 FROM sc WHERE sc.clause = c.clause AND sc.path = b.path))"""


def _asked(s, d):
    key = C("s_suppkey").cast("string")
    return T.table(s, d, "supplier").select(F.concat(F.lit("clause-"), key).alias("clause"), F.concat(F.lit("f"), key).alias("term"))


@query("clause_owners_i1", f"""WITH {ASKED}, r AS (SELECT *, row_number() OVER (PARTITION BY clause ORDER BY score DESC, path) AS rank FROM every)
SELECT clause, max(path) FILTER (rank = 1) AS path, max(score) FILTER (rank = 1)::INT AS score, max(score) FILTER (rank = 2)::INT AS runner_up, string_agg(path, ',' ORDER BY rank) FILTER (rank <= 4) AS candidates,
  max(score) FILTER (rank = 1) >= 4 AND max(score) FILTER (rank = 1) >= coalesce(max(score) FILTER (rank = 2), -9) + 2 AS owned FROM r WHERE score > 0 GROUP BY clause""")
def _(s, d):
    keep = Rounds(s).save
    # no style or template has a term in it; programs alone are asked, as their degrees are the greatest
    stacks = keep(corridor.haystacks(_model(s, d)).where("path like '%.js'"))
    return corridor.owners(corridor.clause_scores(stacks, _asked(s, d), keep=keep)).withColumn("candidates", F.array_join("candidates", ","))


SLUG = "coalesce(nullif(left(regexp_replace(regexp_replace(lower({}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 64), ''), 'probe')"
PROBED = f"""{EFFS}, {STAT.replace(PROGRAM + ', ', '')}, wy AS (SELECT 'clause-' || a.k AS clause, unnest([a.file, b.file]) AS path, a.k AS j FROM prog a JOIN prog b ON b.k = a.k + 1),
op AS (SELECT file AS path, kind, line, symbol, detail, node_kind, 'runtime-node-' || left(sha256(file || chr(0) || node_kind || chr(0) || kind || chr(0) || line || chr(0) || symbol || chr(0) || detail), 20) AS node FROM effs),
rows AS (SELECT file AS path, CASE kind WHEN 'hooks' THEN 'hook' ELSE 'effect' END AS kind, CASE kind WHEN 'hooks' THEN 'hook' ELSE 'effect' END || '-' || {SLUG.format("file || '-' || kind || '-' || line")} AS id, detail || ' at ' || file || ':' || line AS label FROM effs
  UNION ALL SELECT file, 'state', 'state-' || {SLUG.format("file || '-' || namespace || '-' || key || '-' || line")}, access || ' ' || namespace || '.' || key FROM stat
  UNION ALL SELECT path, CASE WHEN node_kind = 'entry-point' AND kind = 'hooks' THEN 'hook' ELSE 'effect' END, 'effect-' || node, node_kind || ': ' || detail || ' at ' || path || ':' || line FROM op),
sy AS (SELECT clause, path, 'symbol' AS kind, 'symbol-' || {SLUG.format("path || '-f' || k")} AS id, 'function f' || k AS label FROM wy JOIN prog ON file = path WHERE starts_with(k::VARCHAR, j::VARCHAR)),
pr AS (SELECT clause, path, kind, id, label FROM wy JOIN rows USING (path) UNION ALL SELECT * FROM sy), top AS (SELECT *, row_number() OVER (PARTITION BY clause ORDER BY id) AS rank FROM pr QUALIFY rank <= 8),
hand AS (SELECT 'clause-' || k AS clause, file AS path, 'manual' AS kind, 'manual-clause-' || k AS id, 'Manual observation required: see f' || k AS label FROM prog WHERE k = (SELECT max(k) FROM pt))"""


def _probed(s, d):
    """Each program but the last is the owner of a clause that leads to the next; the last clause is not complete."""
    p = T.programs(s, d).where("path like '%.js'").select("k", C("path").alias("owner"))
    n = p.select((C("k") - 1).alias("k"), C("owner").alias("next"))
    k = C("k").cast("string")
    clauses = p.join(n, "k", "left").select(F.concat(F.lit("clause-"), k).alias("clause"), F.concat(F.lit("see f"), k).alias("said"), "owner", F.array_compact(F.array("owner", "next")).alias("path"), C("next").isNotNull().alias("complete"), F.array(F.concat(F.lit("f"), k)).alias("terms"))
    return probes.probes(clauses, _model(s, d))


@query("runtime_probes_i9", f"""WITH {PROBED}, a AS (SELECT clause, path, kind, id, label FROM top UNION ALL SELECT clause, path, kind, id, label FROM hand)
SELECT id, path, kind, label, clause FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY length(clause) DESC, clause DESC) AS n FROM a) WHERE n = 1""")
def _(s, d):
    return _probed(s, d)[0].select("id", "path", "kind", "label", "clause")


@query("probe_objectives_i9", f"""WITH {PROBED} SELECT clause, 'see f' || j AS said, ids, 'instrumented' AS status FROM (SELECT clause, string_agg(id, ',' ORDER BY id) AS ids FROM top GROUP BY clause) JOIN (SELECT DISTINCT clause, j FROM wy) USING (clause)
UNION ALL SELECT clause, substr(label, 30), id, 'manual' FROM hand""")
def _(s, d):
    return _probed(s, d)[1].select("clause", "said", F.array_join("probe_ids", ",").alias("ids"), "status")


# --------------------------------------------------------------------------- context packs

def _sources(s, d):
    """The programs and their symbols, which is all that packs read of a model."""
    files = T.programs(s, d)
    return {"files": files, "symbols": Rounds(s).save(facts.symbols(files))}


# Each supplier's pack: the programs of its number and the next two, a file that isn't there, and a style; functions and variables are asked for.
PACKED = f"""{PROGRAM}, o AS (SELECT 'o' || s_suppkey AS objective, s_suppkey AS j FROM supplier), f AS (SELECT objective, j, n AS place, file AS path, k, z FROM o, range(3) r(n), prog WHERE k = j + n),
body AS (SELECT *, 'export async function f' || k || '(a, b) {{' || chr(10) || '  Hooks.on("ready", a); const t = await import("./p' || k || '.js");' || chr(10) || '  if (a == null) return; game.settings.set("ns", KEY, 1);' || chr(10) || '  token.update({{x: 1}}); return g(a);' || chr(10) || '}}' AS fn,
  'var v = localStorage.getItem("s" + a); fetch("/x");' || chr(10) || 'globalThis.app = 1; x = data.flags.mod' || z % 3 || '.path; item.unsetFlag("ns", "q"); // done' AS v FROM f)"""


def _corridors(s, d):
    """(objective, place, path, reasons, names) of the suppliers' corridors."""
    sup, p = T.table(s, d, "supplier").select(C("s_suppkey").alias("j")), T.programs(s, d).where("path like '%.js'").select("k", "path")
    objective = F.concat(F.lit("o"), C("j").cast("string")).alias("objective")
    named = sup.select("j", F.explode(F.array(*[F.lit(n) for n in range(3)])).alias("place")).withColumn("k", C("j") + C("place")).join(p, "k")
    names = F.array(F.concat(F.lit("f"), C("k").cast("string")), F.lit("v"), F.lit("v"))
    files = named.select(objective, "place", "path", F.array(F.lit("because")).alias("reasons"), names.alias("names"))
    gone = sup.select(objective, F.lit(3).alias("place"), F.lit("src/gone.js").alias("path"), F.array(F.lit("because")).alias("reasons"), F.array(F.lit("v")).alias("names"))
    page = sup.select(objective, F.lit(5).alias("place"), F.lit("pages/1.html").alias("path"), F.array().cast("array<string>").alias("reasons"), F.array(F.lit("v")).alias("names"))
    return files.unionAll(gone).unionAll(page)


@query("context_segments_i7", f"""WITH {PACKED} SELECT objective, path, place, 'because' AS evidence, '/* f' || k || ' (function) lines 6-10 */' || chr(10) || fn || chr(10) || chr(10) || '/* v (variable) lines 12-13 */' || chr(10) || v AS content, 2 AS symbols FROM body""")
def _(s, d):
    p = packs.pack(_corridors(s, d), _sources(s, d))
    return p.segments.select("objective", "path", C("place").cast("long").alias("place"), F.array_join("evidence", ",").alias("evidence"), "content", F.size("symbols").alias("symbols"))


@query("context_omissions_i7", """SELECT 'o' || s_suppkey AS objective, path, reason FROM supplier, (VALUES ('src/gone.js', 'certified file has no text-backed Repository Model facts'), ('pages/1.html', 'certified file has no objective-local symbol anchor; exhaustive file source remains hidden')) t(path, reason)
WHERE path = 'src/gone.js' OR EXISTS (SELECT 1 FROM part WHERE p_partkey = 1)""")
def _(s, d):
    return packs.pack(_corridors(s, d), _sources(s, d)).omissions


@query("context_resumed_i7", "SELECT 'doc-' || doc_id AS objective, sha256(text) AS sha, length(text) > 4000 OR (len(string_split(text, chr(10))) > 120 AND length(array_to_string(string_split(text, chr(10))[1:120], chr(10))) + 1 < length(text)) AS truncated FROM documents WHERE text IS NOT NULL")
def _(s, d):
    # a document is one symbol: what its segment shows, and the chunks that its tokens lead to, are the whole text again
    docs = T.table(s, d, "documents").where("text is not null").select(F.concat(F.lit("doc-"), C("doc_id").cast("string")).alias("path"), "text")
    symbols = docs.select(C("path").alias("file"), F.lit("all").alias("name"), F.lit("text").alias("kind"), F.lit(1).alias("line"))
    files = docs.select(C("path").alias("objective"), F.lit(1).alias("place"), "path", F.array().cast("array<string>").alias("reasons"), F.array(F.lit("all")).alias("names"))
    p = packs.pack(files, {"files": docs, "symbols": symbols})
    first = p.segments.select("objective", C("symbols")[0].alias("s"))
    chunks = first.select("objective", F.lit(1).alias("chunk"), "s.source").unionByName(p.continuations.select("objective", "chunk", "source"))
    whole = chunks.groupBy("objective").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "source"))), lambda c: c["source"]), "").alias("text"))
    return whole.join(first, "objective").select("objective", F.sha2(C("text").cast("binary"), 256).alias("sha"), C("s.truncated").alias("truncated"))


# --------------------------------------------------------------------------- claims and sessions

# Line items are claims on their supplier's region: the order is one of two references, evidence if it is the supplier's own and even.
CLAIMED = """e AS (SELECT DISTINCT l_suppkey AS s, 'o' || l_orderkey AS id, 'k' || l_orderkey % 3 AS kind FROM lineitem WHERE l_orderkey % 2 = 0),
c AS (SELECT l_suppkey AS s, CASE l_linenumber WHEN 1 THEN 'purpose' WHEN 2 THEN 'responsibility' WHEN 3 THEN 'does-not-own' WHEN 4 THEN 'responsibility' WHEN 5 THEN 'key-flow' ELSE 'other' END AS kind, l_orderkey * 10 + l_linenumber AS pos, l_orderkey AS o, l_partkey % 11 = 0 AS blank FROM lineitem),
j AS (SELECT c.*, (SELECT count(DISTINCT e.id) FROM e WHERE e.s = c.s AND e.id IN ('o' || c.o, 'o' || (c.o + 1))) AS refs, (SELECT count(DISTINCT e.kind) FROM e WHERE e.s = c.s AND e.id IN ('o' || c.o, 'o' || (c.o + 1))) AS kinds FROM c),
r AS (SELECT *, CASE WHEN blank THEN 'no text' WHEN refs = 0 THEN 'no evidence of the region' END AS why FROM j),
n AS (SELECT *, sum((why IS NULL)::INT) OVER (PARTITION BY s, kind ORDER BY pos, blank DESC ROWS UNBOUNDED PRECEDING) AS n, CASE kind WHEN 'purpose' THEN 1 WHEN 'responsibility' THEN 5 WHEN 'does-not-own' THEN 4 WHEN 'key-flow' THEN 5 ELSE 0 END AS most FROM r),
v AS (SELECT 's' || s AS region, kind, pos, coalesce(why, CASE WHEN n > most THEN 'the region takes no more' END) AS reason, CAST(round(CAST(CAST(least(CASE WHEN kind = 'does-not-own' THEN 0.78 ELSE 0.95 END::DOUBLE, CASE WHEN kind = 'does-not-own' THEN 0.52 ELSE 0.58 END::DOUBLE + kinds * 0.07::DOUBLE + least(refs, 4) * 0.035::DOUBLE) AS VARCHAR) AS DECIMAL(18, 17)), 2) AS DOUBLE) AS score FROM n)"""


def _claims(s, d):
    line = T.table(s, d, "lineitem")
    key, order = F.concat(F.lit("s"), C("l_suppkey").cast("string")), F.concat(F.lit("o"), C("l_orderkey").cast("string"))
    evidence = line.where("l_orderkey % 2 = 0").select(key.alias("region"), order.alias("id"), F.concat(F.lit("k"), (C("l_orderkey") % 3).cast("string")).alias("kind"))
    kinds = F.create_map(*[F.lit(x) for x in (1, "purpose", 2, "responsibility", 3, "does-not-own", 4, "responsibility", 5, "key-flow")])
    refs = F.array(F.concat(F.lit(" "), order), F.concat(F.lit("o"), (C("l_orderkey") + 1).cast("string")), order, F.lit(None))
    said = F.when(C("l_partkey") % 11 == 0, " \n ").otherwise(F.concat(F.lit("claim  of\n"), order))
    rows = line.select(key.alias("region"), F.coalesce(kinds[C("l_linenumber").cast("int")], F.lit("other")).alias("kind"), (C("l_orderkey") * 10 + C("l_linenumber")).cast("long").alias("pos"), said.alias("text"), refs.alias("refs"))
    return rows, evidence


@query("claims_i17", f"WITH {CLAIMED} SELECT region, kind, pos::BIGINT AS pos, reason IS NULL AS accepted, reason, CASE WHEN reason IS NULL THEN score END AS confidence FROM v")
def _(s, d):
    return claims.validate(*_claims(s, d)).select("region", "kind", "pos", "accepted", "reason", "confidence")


@query("claimed_regions_i17", f"""WITH {CLAIMED}, g AS (SELECT region, count(*) FILTER (reason IS NULL) AS accepted, count(*) FILTER (reason IS NOT NULL) AS rejected, count(*) FILTER (reason IS NULL AND kind = 'purpose') AS p, count(*) FILTER (reason IS NULL AND kind = 'responsibility') AS q FROM v GROUP BY 1)
SELECT 's' || s_suppkey AS id, s_name AS name, coalesce(accepted, 0) AS accepted, coalesce(rejected, 0) AS rejected, CASE WHEN coalesce(accepted, 0) = 0 THEN 'deterministic' WHEN p > 0 AND q > 0 THEN 'synthesized' ELSE 'partial' END AS status FROM supplier LEFT JOIN g ON region = 's' || s_suppkey""")
def _(s, d):
    packets = T.table(s, d, "supplier").select(F.concat(F.lit("s"), C("s_suppkey").cast("string")).alias("id"), C("s_name").alias("name_hint"))
    names = packets.select(C("id").alias("region"), F.lit(" ").alias("name"))
    return claims.regions(packets, names, claims.validate(*_claims(s, d))).select("id", "name", "accepted", "rejected", "status")


# A customer's orders are a session of three regions: the first begins it, the next ones submit the chunk of their number; an order after the third submission is refused.
@query("sessions_i18", """WITH o AS (SELECT 'c' || o_custkey AS session, o_orderkey AS n, o_orderkey % 7 = 0 AS wrong, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders),
w AS (SELECT *, min(i) FILTER (i > 0 AND (wrong OR i > 3)) OVER (PARTITION BY session) AS bad FROM o)
SELECT session, n::BIGINT AS n, CASE WHEN i = 0 THEN 'issued' WHEN i >= 1 AND i < coalesce(bad, 99) THEN CASE i WHEN 3 THEN 'complete' ELSE 'issued' END ELSE 'refused' END AS result,
  CASE WHEN i = 0 OR i < coalesce(bad, 99) THEN '' WHEN i = bad AND i <= 3 THEN 'not exactly one interpretation for every region of the chunk' WHEN bad = 4 THEN 'unknown or expired session' ELSE 'not the current chunk' END AS detail FROM w""")
def _(s, d):
    e = T.table(s, d, "orders").select(F.concat(F.lit("c"), C("o_custkey").cast("string")).alias("session"), C("o_orderkey").cast("long").alias("n"))
    e = e.withColumn("i", F.row_number().over(Window.partitionBy("session").orderBy("n")) - 1)
    regions = F.array(F.lit("r0"), F.lit("r1"), F.lit("r2"))
    now = F.get(regions, C("i") - 1)
    chunk = F.concat(F.lit("semantic-chunk-"), C("i").cast("string"), F.lit("-"), F.substring(F.sha2(F.concat_ws(":", "session", (C("i") - 1).cast("string"), now), 256), 1, 10))
    sent = F.when(C("i") == 0, regions).when(C("n") % 7 == 0, F.array(F.lit("other"))).otherwise(F.array(now))
    rows = e.select("session", F.timestamp_seconds(C("i")).alias("at"), "n", F.when(C("i") == 0, "begin").otherwise("submit").alias("kind"), chunk.alias("chunk"), sent.alias("regions"))
    return sessions.answers(rows).select("session", "n", "result", "detail")


# --------------------------------------------------------------------------- projections and snapshots

# Customers' market segments are objectives; suppliers are contracts, their nations' customers the consumers, their parts the evidence.
MAPPED = """o AS (SELECT DISTINCT c_mktsegment AS objective FROM customer), tm AS (SELECT objective, unnest(['supplier#00000000', 'nation-1', lower(objective)]) AS term FROM o),
co AS (SELECT DISTINCT c_mktsegment AS objective, 'n' || c_nationkey AS path FROM customer WHERE c_custkey % 50 = 0),
ct AS (SELECT s_suppkey AS pos, 'k' || s_suppkey AS id, s_name AS name, CASE WHEN s_suppkey % 9 <> 0 THEN 'n' || s_nationkey END AS file, CASE WHEN s_suppkey % 17 = 0 THEN 'native-conflict' ELSE 'repository-only' END AS rec, CASE WHEN s_suppkey % 4 = 0 THEN 'native-authoritative' ELSE 'resolved' END AS ver, s_nationkey FROM supplier),
cs AS (SELECT ct.id, c_custkey AS n, 'n' || c_nationkey AS file, 'c' || c_custkey AS symbol FROM ct JOIN customer ON c_nationkey = (s_nationkey + 1) % 25), ev AS (SELECT DISTINCT 'k' || l_suppkey AS id, l_partkey AS n, 'nation-' || l_partkey AS summary FROM lineitem),
hs AS (SELECT ct.id, lower(concat_ws(' ', name, 'supplier', ct.file, name, string_agg(DISTINCT cs.file || ' ' || cs.symbol, ' '), (SELECT string_agg(summary, ' ') FROM ev WHERE ev.id = ct.id))) AS t FROM ct LEFT JOIN cs ON cs.id = ct.id GROUP BY ct.id, name, ct.file),
sc AS (SELECT o.objective, ct.id, pos, 1 + CASE WHEN rec = 'native-conflict' THEN 1000 WHEN file IS NULL THEN 200 ELSE 0 END + CASE WHEN ver = 'native-authoritative' THEN 20 ELSE 0 END + CASE WHEN EXISTS (SELECT 1 FROM co WHERE co.objective = o.objective AND co.path = ct.file) THEN 300 ELSE 0 END
  + 100 * (SELECT count(*) FROM cs JOIN co ON co.path = cs.file WHERE cs.id = ct.id AND co.objective = o.objective) + 10 * (SELECT count(*) FROM tm JOIN hs ON hs.id = ct.id AND contains(hs.t, tm.term) WHERE tm.objective = o.objective) AS score FROM o, ct)"""


def _mapped(s, d):
    key = lambda p, c: F.concat(F.lit(p), C(c).cast("string"))
    cust, sup = T.table(s, d, "customer"), T.table(s, d, "supplier")
    terms = cust.select(C("c_mktsegment").alias("objective")).distinct().select("objective", F.explode(F.array(F.lit("supplier#00000000"), F.lit("nation-1"), F.lower("objective"))).alias("term"))
    corridor_ = cust.where("c_custkey % 50 = 0").select(C("c_mktsegment").alias("objective"), key("n", "c_nationkey").alias("path")).distinct()
    ct = sup.select(C("s_suppkey").alias("pos"), key("k", "s_suppkey").alias("id"), F.lit("supplier").alias("kind"), C("s_name").alias("name"), F.when(C("s_suppkey") % 9 != 0, key("n", "s_nationkey")).alias("file"), C("s_name").alias("symbol"),
                    F.when(C("s_suppkey") % 4 == 0, "native-authoritative").otherwise("resolved").alias("verification"), F.when(C("s_suppkey") % 17 == 0, "native-conflict").otherwise("repository-only").alias("reconciliation"), F.array().cast("array<string>").alias("refs"), "s_nationkey")
    # a nation's suppliers share their consumers: the customers of the next nation
    cs = cust.select(((C("c_nationkey") + 24) % 25).cast("int").alias("class"), C("c_custkey").alias("n"), key("n", "c_nationkey").alias("file"), key("c", "c_custkey").alias("symbol"))
    ev = T.table(s, d, "lineitem").select(key("k", "l_suppkey").alias("id"), C("l_partkey").alias("n"), F.lit("part").alias("kind"), F.lit("f").alias("file"), C("l_partkey").alias("line"), key("nation-", "l_partkey").alias("summary")).distinct()
    return terms, corridor_, ct, cs, ev


@query("contract_projection_f15", f"""WITH {MAPPED}, r AS (SELECT *, row_number() OVER (PARTITION BY objective ORDER BY score DESC, pos) AS rank FROM sc QUALIFY rank <= 12), nc AS (SELECT id, count(*) AS n, string_agg(symbol, ',' ORDER BY n) FILTER (i <= 8) AS first FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n) AS i FROM cs) GROUP BY id),
ne AS (SELECT id, count(*) AS n, string_agg(summary, ',' ORDER BY n) FILTER (i <= 6) AS first FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n) AS i FROM ev) GROUP BY id)
SELECT objective, rank, r.id, score::INT AS score, coalesce(nc.first, '') AS consumers, coalesce(nc.n, 0) AS consumers_count, coalesce(nc.n, 0) > 8 AS consumers_truncated, coalesce(ne.first, '') AS evidence, coalesce(ne.n, 0) AS evidence_count FROM r LEFT JOIN nc ON nc.id = r.id LEFT JOIN ne ON ne.id = r.id""")
def _(s, d):
    terms, at, ct, cs, ev = _mapped(s, d)
    sides = ct.select("id", C("s_nationkey").cast("int").alias("class"))
    p = projections.contract_map(terms, at, ct, cs, ev, ev.select("id", "n", "kind", "summary").limit(0), sides)
    return p.select("objective", "rank", "id", "score", F.array_join(F.transform("consumers", lambda c: c["symbol"]), ",").alias("consumers"), "consumers_count", "consumers_truncated", F.array_join(F.transform("evidence", lambda e: e["summary"]), ",").alias("evidence"), "evidence_count")


@query("runtime_projection_f16", """WITH o AS (SELECT DISTINCT c_mktsegment AS objective FROM customer), tm AS (SELECT objective, unnest(['o1', 'item-r']) AS term FROM o), co AS (SELECT DISTINCT c_mktsegment AS objective, 'o' || o_orderkey AS path FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderkey % 10 = 0),
nd AS (SELECT 'r' || l_suppkey AS region, 'l' || l_orderkey || '-' || l_linenumber || '-' || l_partkey AS id, 'o' || l_orderkey AS file, 'item-' || lower(l_returnflag) AS kind, l_linenumber AS line FROM lineitem), f AS (SELECT DISTINCT region, file FROM nd),
sc AS (SELECT o.objective, 'r' || s_suppkey AS region, s_suppkey AS pos, CASE s_suppkey % 10 WHEN 0 THEN 30 WHEN 1 THEN 10 ELSE 0 END + 40 * (SELECT count(*) FROM f JOIN co ON co.path = f.file WHERE f.region = 'r' || s_suppkey AND co.objective = o.objective)
  + 3 * (SELECT count(DISTINCT term) FROM tm, nd WHERE nd.region = 'r' || s_suppkey AND tm.objective = o.objective AND (contains(nd.file, term) OR contains(nd.kind, term))) AS score FROM o, supplier),
r AS (SELECT *, row_number() OVER (PARTITION BY objective ORDER BY score DESC, pos) AS rank FROM sc QUALIFY rank <= 8),
n AS (SELECT r.objective, r.region, id, row_number() OVER (PARTITION BY r.objective, r.region ORDER BY (co.path IS NOT NULL) DESC, file, line, id) AS i FROM r JOIN nd ON nd.region = r.region LEFT JOIN co ON co.objective = r.objective AND co.path = nd.file)
SELECT r.objective, rank, r.region, score::INT AS score, coalesce((SELECT string_agg(id, ',' ORDER BY i) FROM n WHERE n.objective = r.objective AND n.region = r.region AND i <= 12), '') AS nodes, (SELECT count(*) FROM n WHERE n.objective = r.objective AND n.region = r.region) AS nodes_count, 0::BIGINT AS edges_count FROM r""")
def _(s, d):
    key = lambda p, c: F.concat(F.lit(p), C(c).cast("string"))
    cust, line = T.table(s, d, "customer"), T.table(s, d, "lineitem")
    terms = cust.select(C("c_mktsegment").alias("objective")).distinct().select("objective", F.explode(F.array(F.lit("o1"), F.lit("item-r"))).alias("term"))
    at = cust.join(T.table(s, d, "orders").where("o_orderkey % 10 = 0"), C("o_custkey") == C("c_custkey")).select(C("c_mktsegment").alias("objective"), key("o", "o_orderkey").alias("path")).distinct()
    nodes = line.select(key("r", "l_suppkey").alias("region"), F.concat(F.lit("l"), F.concat_ws("-", *[C(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey")])).alias("id"), key("o", "l_orderkey").alias("file"), F.lit("").alias("symbol"), F.concat(F.lit("item-"), F.lower("l_returnflag")).alias("effect_kind"), F.lit("").alias("detail"), C("l_linenumber").alias("line"))
    regions = T.table(s, d, "supplier").select(C("s_suppkey").alias("pos"), key("r", "s_suppkey").alias("region"), F.when(C("s_suppkey") % 10 == 0, "native-conflict").when(C("s_suppkey") % 10 == 1, "unresolved").otherwise("repository-confirmed").alias("reconciliation"), F.lit("").alias("said"))
    edges = s.createDataFrame([], "region string, id string, kind string, from string, to string")
    p = projections.runtime_regions(terms, at, regions, nodes.select("region", "file").distinct(), nodes, edges)
    return p.select("objective", "rank", "region", "score", F.array_join(F.transform("nodes", lambda x: x["id"]), ",").alias("nodes"), "nodes_count", "edges_count")


@query("context_grants_f17", """WITH g AS (SELECT 'c' || o_custkey AS objective, o_orderkey AS place, 'o' || o_orderkey AS path, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n, o_orderkey % 3 AS e, o_orderkey % 4 AS k, o_orderkey % 5 AS r FROM orders),
s AS (SELECT *, (8 * (contains(path, '7'))::INT + 8 * (e > 0)::INT + 4 * e + least(28, 7 * r + 6 * k) + least(12, 2 * n))::INT AS score FROM g)
SELECT objective, place::BIGINT AS place, path, score, row_number() OVER (PARTITION BY objective ORDER BY score DESC, place) AS rank, CASE WHEN r > 0 THEN 'runtime/effect evidence intersects the active objective' WHEN k > 0 THEN 'contract provider/consumer evidence intersects the active objective' WHEN e > 0 THEN 'direct certified repository evidence is available'
  WHEN n > 0 THEN 'dependency consumers make this a plausible propagation surface' ELSE 'corridor-certified source is available for bounded inspection' END AS why, CASE WHEN score >= 50 THEN 'high' WHEN score >= 24 THEN 'medium' ELSE 'low' END AS gain FROM s QUALIFY rank <= 8""")
def _(s, d):
    n = T.table(s, d, "lineitem").groupBy(C("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("consumers"))
    key = lambda p, c: F.concat(F.lit(p), C(c).cast("string"))
    k = C("o_orderkey")
    rows = T.table(s, d, "orders").join(n, "o_orderkey", "left").select(key("c", "o_custkey").alias("objective"), k.cast("long").alias("place"), key("o", "o_orderkey").alias("path"), F.array().cast("array<string>").alias("names"), F.array_repeat(F.lit("because"), (k % 3).cast("int")).alias("evidence"), (k % 4).alias("contracts"), (k % 5).alias("runtime"), "consumers")
    terms = rows.select("objective").distinct().select("objective", F.explode(F.array(F.lit("7"), F.lit("cause"))).alias("term"))
    return projections.grants(rows, terms)


@query("native_projection_f14", """WITH tm AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{6,}'))) AS term FROM benchmark), h AS (SELECT item_id, source AS record, doc_id AS pos, 2 * count(*) AS score FROM tm JOIN documents ON contains(lower(text), term) WHERE source IS NOT NULL GROUP BY ALL)
SELECT item_id AS objective, record, pos, score::INT AS score, row_number() OVER (PARTITION BY item_id, record ORDER BY score DESC, pos) AS rank FROM h QUALIFY rank <= 8""")
def _(s, d):
    terms = T.table(s, d, "benchmark").select(C("item_id").alias("objective"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), F.lit(0)))).alias("term"))
    entries = T.table(s, d, "documents").select(C("source").alias("record"), C("doc_id").alias("pos"), C("text").alias("said"))
    return projections.native_contracts(terms, terms.select("objective", F.lit("").alias("path")), entries)


@query("snapshot_commit_a21", """SELECT 'd/' || doc_id || '.md' AS path, sha256(CASE WHEN doc_id % 2 = 0 THEN coalesce(text, '') || '!' ELSE coalesce(text, '') END) AS sha FROM documents WHERE doc_id % 5 <> 4""")
def _(s, d):
    # all documents are committed; a second commit changes those of even number and removes those whose number ends in 4 or 9
    files = T.table(s, d, "documents").select(F.concat(F.lit("./d/"), C("doc_id").cast("string"), F.lit(".md")).alias("path"), "text", "doc_id")
    store = Store(s, f"{Rounds(s).root}-store")
    base, _ = store.commit("main", 0, files)
    even, gone = C("doc_id") % 2 == 0, C("doc_id") % 5 == 4
    store.change("main", base, files.where(even | gone).select("path", F.when(~gone, F.concat(F.coalesce("text", F.lit("")), F.lit("!"))).alias("text"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("before")))
    return store.files(store.head("main")[1]).select("path", "sha")


# --------------------------------------------------------------------------- path moves

MOVES = "lib/x0"


@query("path_moves_i20", f"""WITH {PROGRAM}, n AS (SELECT a.file, a.k, b.k AS to FROM prog a JOIN prog b ON b.k = a.k + 1),
r AS (SELECT file, '"../m0/p' || n.to || '.js"' AS old, '"../../lib/x0/p' || n.to || '.js"' AS new FROM n WHERE k % 40 = 39 UNION ALL SELECT file, '"../m1/p' || n.to || '.js"', '"../../src/m1/p' || n.to || '.js"' FROM n WHERE k % 40 = 0)
SELECT 'rewrite' AS row, file AS path, old, new, 1 AS occurrences FROM r UNION ALL SELECT 'moved', file, NULL, 'lib/x0/p' || k || '.js', NULL FROM prog WHERE k % 40 = 0 UNION ALL SELECT 'moved', 'src/m0/s' || k || '.css', NULL, 'lib/x0/s' || k || '.css', NULL FROM pt WHERE k % 40 = 0
UNION ALL SELECT 'gap', 'move source does not exist: src/none', NULL, NULL, NULL UNION ALL SELECT 'gap', 'move destination already exists: pages/11.html', NULL, NULL, NULL FROM pt WHERE k = 11 UNION ALL SELECT 'moved', 'pages/1.html', NULL, 'pages/11.html', NULL FROM pt WHERE k = 1""")
def _(s, d):
    # a directory goes elsewhere, a page onto another one, and something that isn't there
    moved = s.createDataFrame([(0, "./src/m0", MOVES), (1, "pages/1.html", "/pages/11.html"), (2, "src/none", "x")], "pos int, source string, target string")
    files = T.programs(s, d)
    refs = Rounds(s).save(facts.resolve(facts.dependencies(files), files).where("to is not null").withColumnRenamed("file", "from"))
    p = moves.plan({"files": files, "dependencies": refs}, moved)
    none = lambda n, t="string": F.lit(None).cast(t).alias(n)
    out = p.rewrites.select(F.lit("rewrite").alias("row"), "path", "old", "new", "occurrences").unionByName(p.moved.select(F.lit("moved").alias("row"), "path", none("old"), C("new_path").alias("new"), none("occurrences", "int")))
    return out.unionByName(p.gaps.select(F.lit("gap").alias("row"), C("gap").alias("path"), none("old"), none("new"), none("occurrences", "int")))
