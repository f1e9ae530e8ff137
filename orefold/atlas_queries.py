"""Queries of path trees, snapshots, sessions and stored runs; part of the registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from orefold.functions import chunks
from orefold.plans import atlas
from orefold.registry import FIL, query
from orefold.sources import testdata as T

C = F.col

# Documents below two directories that hold nothing else, and orders below their customer's segment.
TREE = f"""{FIL}, f AS (SELECT 'docs/all/' || path AS path, 'source' AS kind, size > 500 AS modeled FROM fil
  UNION ALL SELECT lower(c_mktsegment) || '/c' || c_custkey || '.json', 'manifest', false FROM customer
  UNION ALL SELECT 'readme.bin', 'asset', false),
p AS (SELECT path, kind, modeled, string_split(path, '/') AS parts FROM f),
d AS (SELECT array_to_string(parts[1:i], '/') AS path, count(*) AS files, sum(modeled::INT)::BIGINT AS modeled FROM p, range(1, 20) r(i) WHERE i < len(parts) GROUP BY 1),
kid AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS up, count(*) AS n, sum(d) AS d FROM (SELECT path, 1 AS d FROM d UNION ALL SELECT path, 0 FROM f) GROUP BY 1),
node AS (SELECT path, 'directory' AS node, files, modeled FROM d WHERE path NOT IN (SELECT up FROM kid WHERE n = 1 AND d = 1)
  UNION ALL SELECT path, kind, 1, modeled::BIGINT FROM f),
up AS (SELECT n.path, a.path AS above FROM node n JOIN node a ON a.node = 'directory' AND starts_with(n.path, a.path || '/')),
tot AS (SELECT path, 1 + (SELECT count(*) FROM up WHERE above = node.path) AS total FROM node WHERE node = 'directory'),
key AS (SELECT path, list('0' || above ORDER BY length(above)) AS keys FROM up GROUP BY path),
bfs AS (SELECT row_number() OVER (ORDER BY coalesce(len(keys), 0), list_append(coalesce(keys, []), CASE node WHEN 'directory' THEN '0' WHEN 'manifest' THEN '1' WHEN 'source' THEN '2' WHEN 'unknown' THEN '3' ELSE '4' END || path)) AS place,
  path, node FROM node LEFT JOIN key USING (path) QUALIFY place <= 240)"""


def _files(s, d):
    docs = T.files(s, d).select(F.concat(F.lit("docs/all/"), "path").alias("path"), F.lit("source").alias("kind"), (C("size") > 500).alias("modeled"))
    customers = T.table(s, d, "customer").select(F.concat(F.lower("c_mktsegment"), F.lit("/c"), C("c_custkey").cast("string"), F.lit(".json")), F.lit("manifest"), F.lit(False))
    return docs.unionAll(customers).unionAll(s.range(1).select(F.lit("readme.bin"), F.lit("asset"), F.lit(False)))


@query("atlas_nodes_g14", f"WITH {TREE} SELECT path, files, modeled, total FROM node JOIN tot USING (path)")
def _(s, d):
    tree = atlas.nodes(_files(s, d))
    return tree.where("node = 'directory'").select(C("path"), "files", "modeled").join(atlas.node_counts(tree).withColumnRenamed("directory", "path"), "path")


@query("atlas_first_g15", f"WITH {TREE} SELECT place, path, node FROM bfs")
def _(s, d):
    return atlas.breadth_first(atlas.nodes(_files(s, d)))


@query("atlas_projection_g16", f"""WITH {TREE} SELECT node.path AS directory, files, modeled, total, total - (SELECT count(*) FROM bfs b WHERE b.path = node.path OR starts_with(b.path, node.path || '/')) AS omitted
FROM node JOIN tot USING (path) WHERE path IN (SELECT path FROM bfs)""")
def _(s, d):
    return atlas.projection(atlas.nodes(_files(s, d)))


@query("path_collisions_g13", f"""WITH {FIL}, f AS (SELECT path FROM fil UNION ALL SELECT source || '/' || lang FROM documents WHERE n_chars > 3000 UNION ALL SELECT path FROM fil WHERE size < 200), n AS (SELECT path, count(*) AS n FROM f GROUP BY path)
SELECT path, 'duplicate' AS problem FROM n WHERE n > 1 UNION ALL SELECT path, 'collision' FROM n WHERE EXISTS (SELECT 1 FROM documents WHERE source || '/' || lang = n.path OR source = n.path)""")
def _(s, d):
    f = T.files(s, d)
    above = f.where("size > 3000").select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("path"))
    return atlas.collisions(f.select("path").unionAll(above).unionAll(f.where("size < 200").select("path")))


@query("path_problems_a10", """SELECT CASE WHEN p_size < 10 THEN '../' || p_partkey WHEN p_size < 40 THEN 'a/' || p_partkey || '/c' ELSE '/' END AS path, CASE WHEN p_size < 10 OR p_size >= 40 THEN 'invalid' ELSE 'duplicate' END AS problem
FROM part WHERE p_size < 10 OR p_size >= 30""")
def _(s, d):
    part = T.table(s, d, "part").select(C("p_partkey").cast("string").alias("k"), C("p_size").alias("z"))
    t = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])
    one = part.select(F.when(C("z") < 10, t("../", C("k"))).when(C("z") < 40, t("./a//", C("k"), "/b/../c")).otherwise("/").alias("path"))
    return atlas.path_problems(one.unionAll(part.where("z >= 30 and z < 40").select(t("a\\", C("k"), "/c"))))


@query("hydrated_a8", f"WITH {FIL} SELECT path, size, CASE WHEN size <= 2000 AND size > 100 THEN length(text) END AS chars FROM fil")
def _(s, d):
    f = T.files(s, d)
    return atlas.hydrate(f.select("path", "size"), f.where("size > 100"), 2000).select("path", "size", F.length("text").alias("chars"))


@query("run_store_a20", "SELECT user_id AS repository, event_type AS fingerprint, event_id AS run FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def _(s, d):
    e = T.table(s, d, "events").select(C("user_id").alias("repository"), C("event_type").alias("fingerprint"), C("event_id").alias("run"), "ts")
    return atlas.newest(e, ["repository", "fingerprint"], ["ts", "run"]).drop("ts")


@query("cache_lru_f23", "SELECT user_id AS key, max(ts) AS ts FROM events GROUP BY 1 ORDER BY max(struct_pack(ts := ts, e := event_id)) DESC LIMIT 32")
def _(s, d):
    e = T.table(s, d, "events").select(C("user_id").alias("key"), "ts", "event_id")
    return atlas.newest(e, ["key"], ["ts", "event_id"], 32).drop("event_id")


@query("submissions_h7", """WITH e AS (SELECT l_orderkey AS session, l_partkey AS id FROM lineitem WHERE l_linenumber <= 3), s AS (SELECT l_orderkey AS session, l_partkey AS id FROM lineitem WHERE l_linenumber <= CASE WHEN l_returnflag = 'N' THEN 3 ELSE 4 END)
SELECT session, CASE WHEN EXISTS (SELECT 1 FROM lineitem x WHERE x.l_orderkey = session AND x.l_linenumber = 4 AND x.l_returnflag <> 'N') THEN 'mismatch'
  WHEN (SELECT count(*) > count(DISTINCT id) FROM s WHERE s.session = o.session) THEN 'duplicate' ELSE 'complete' END AS outcome FROM (SELECT session FROM e UNION SELECT session FROM s) o""")
def _(s, d):
    line = T.table(s, d, "lineitem").select(C("l_orderkey").alias("session"), C("l_partkey").alias("id"), "l_linenumber", "l_returnflag")
    return atlas.submissions(line.where("l_linenumber <= 3"), line.where("l_linenumber <= if(l_returnflag = 'N', 3, 4)"))


@query("pending_i15", "SELECT doc_id AS id, md5(coalesce(text, '')) AS fingerprint FROM documents WHERE lang <> 'en' OR md5(coalesce(text, '')) < '8'")
def _(s, d):
    p = T.table(s, d, "documents").select(C("doc_id").alias("id"), F.md5(F.coalesce("text", F.lit(""))).alias("fingerprint"), "lang")
    old = p.select("id", F.when((C("lang") == "en") & (C("fingerprint") >= "8"), C("fingerprint")).otherwise("stale").alias("fingerprint"))
    return atlas.pending(p.drop("lang"), old)


@query("claim_confidence_e28", "SELECT c_custkey AS region, coalesce(floor(25.0 * sum(o_orderkey % 4) / count(o_orderkey) + 0.5) / 100, 0.35)::DOUBLE AS confidence FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def _(s, d):
    claims = T.table(s, d, "orders").select(C("o_custkey").alias("region"), ((C("o_orderkey") % 4) / 4).alias("confidence"))
    return atlas.confidence(claims, T.table(s, d, "customer").select(C("c_custkey").alias("region")))


@query("handoff_d33", """SELECT o_orderkey AS run_id, CASE WHEN o_orderpriority = '1-URGENT' THEN 'run' WHEN o_orderpriority = '2-HIGH' THEN 'repository' WHEN o_orderstatus = 'P' THEN 'commit' WHEN o_custkey % 5 = 0 THEN 'profile'
  WHEN o_orderstatus = 'O' AND o_custkey % 3 = 0 THEN 'status' WHEN o_custkey % 7 = 0 THEN 'certificate' WHEN o_custkey % 2 = 0 THEN 'artifact' END AS reason FROM orders""")
def _(s, d):
    o = T.table(s, d, "orders")
    k, cust, status = C("o_orderkey").alias("run_id"), C("o_custkey"), C("o_orderstatus")
    asked = o.select(k, cust.alias("repository"), status.alias("commit"), F.lit("p").alias("profile"), F.when(cust % 2 == 0, "c9").otherwise("").alias("artifact"))
    runs = o.where("o_orderpriority <> '1-URGENT'").select(
        k, F.when(C("o_orderpriority") == "2-HIGH", -1 - cust).otherwise(cust).alias("repository"), F.when(status == "P", None).otherwise(status).alias("commit"), F.when(cust % 5 == 0, "q").otherwise("p").alias("profile"),
        F.when(status == "F", "CERTIFIED").when(cust % 3 == 0, "BLOCKED").otherwise("PARTIAL").alias("status"), F.when(cust % 7 != 0, "c1").alias("certificate"))
    return atlas.handoff(asked, runs).select("run_id", "reason")


@query("frontier_j3", "SELECT doc_id, array_to_string(list_concat(list_reverse(list_reverse(string_split(coalesce(text, ''), ' '))[1:3]), string_split(source || ' ' || lang || ' a b', ' ')[1:3]), '|') AS active FROM documents")
def _(s, d):
    split = lambda *c: F.split(F.concat_ws(" ", *c), " ")
    active = atlas.frontier(F.split(F.coalesce("text", F.lit("")), " "), split("source", "lang", F.lit("a b")))
    return T.table(s, d, "documents").select("doc_id", F.array_join(active, "|").alias("active"))


@query("source_chunks_b37", """WITH RECURSIVE t AS (SELECT doc_id, text || chr(10) || replace(text, ' ', chr(10)) AS text FROM documents WHERE text IS NOT NULL), c AS (
  SELECT doc_id, text AS rest, 0 AS seq, 1::BIGINT AS line_start, false AS continued, NULL::VARCHAR AS piece, 0::BIGINT AS breaks FROM t
  UNION ALL SELECT doc_id, substr(rest, length(x) + 1), seq + 1, line_start + breaks, seq > 0 AND right(piece, 1) <> chr(10), x, length(x) - length(replace(x, chr(10), '')) FROM (
    SELECT *, CASE WHEN len(string_split(left(rest, 4000), chr(10))) > 120 THEN array_to_string(string_split(left(rest, 4000), chr(10))[1:120], chr(10)) || chr(10) ELSE left(rest, 4000) END AS x FROM c WHERE rest <> ''))
SELECT doc_id, seq, length(piece) AS chars, line_start, greatest(line_start, line_start + breaks - (right(piece, 1) = chr(10))::INT) AS line_end, continued FROM c WHERE seq > 0""")
def _(s, d):
    t = C("text")
    docs = T.table(s, d, "documents").where("text is not null").select("doc_id", F.concat(t, F.lit("\n"), F.replace(t, F.lit(" "), F.lit("\n"))).alias("text"))
    return docs.select("doc_id", F.posexplode(chunks.chunks(C("text")))).select("doc_id", (C("pos") + 1).alias("seq"), F.length("col.source").alias("chars"), "col.line_start", "col.line_end", "col.continued")


@query("best_packet_f10", """SELECT doc_id AS id, CASE WHEN lang = 'en' THEN 1 ELSE 2 END + CASE WHEN contains(lower(source), 'src1') THEN 8 ELSE 0 END + CASE WHEN contains(lower(lang), 'e') THEN 6 ELSE 0 END
  + CASE WHEN contains(lower(text), 'src1') THEN 3 ELSE 0 END + CASE WHEN contains(lower(text), 'e') THEN 3 ELSE 0 END + CASE WHEN contains(lower(source), 'e') THEN 8 ELSE 0 END + CASE WHEN contains(lower(lang), 'src1') THEN 6 ELSE 0 END AS score
FROM documents ORDER BY score DESC, lang = 'en', doc_id LIMIT 1""")
def _(s, d):
    p = T.table(s, d, "documents").select(C("doc_id").alias("id"), F.when(C("lang") == "en", "repository").otherwise("directory").alias("kind"), C("source").alias("names"), C("lang").alias("symbols"), C("text").alias("evidence"))
    return atlas.best_packet(p, ["src1", "e"])


_STATUS = "CASE WHEN {0} < 30 THEN 'synthesized' WHEN {0} < 60 THEN 'partial' ELSE 'deterministic' END"


@query("coverage_e27", f"""WITH r AS (SELECT c_custkey AS id, {_STATUS.format('c_custkey')} AS status FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT DISTINCT o_custkey, {_STATUS.format('o_custkey - 20')} FROM orders)
SELECT *, CASE WHEN unmapped = 0 THEN 'COMPLETE' WHEN wanted > 0 AND found = wanted THEN 'OBJECTIVE_SUFFICIENT' ELSE 'PARTIAL' END AS status FROM (SELECT count(*) AS regions, count(*) FILTER (status = 'synthesized') AS synthesized, count(*) FILTER (status = 'partial') AS partial, count(*) FILTER (status = 'deterministic') AS deterministic,
  (SELECT count(*) FROM part WHERE p_partkey NOT IN (SELECT id FROM r)) AS unmapped, (SELECT count(*) FROM supplier) AS wanted, (SELECT count(*) FROM supplier WHERE s_suppkey IN (SELECT id FROM r)) AS found FROM r)""")
def _(s, d):
    old = T.table(s, d, "customer").select(C("c_custkey").alias("id"), F.expr(_STATUS.format("c_custkey")).alias("status"))
    new = T.table(s, d, "orders").select(C("o_custkey").alias("id"), F.expr(_STATUS.format("o_custkey - 20")).alias("status")).distinct()
    return atlas.coverage(atlas.merge_regions(old, new), T.table(s, d, "part").select(C("p_partkey").alias("id")), T.table(s, d, "supplier").select(C("s_suppkey").alias("id")))


@query("probes_f18", """WITH p AS (SELECT user_id AS clause, event_type || '-' || strftime(ts, '%d') AS id, max(event_id) AS sequence FROM events GROUP BY 1, 2)
SELECT clause, id, sequence, row_number() OVER (PARTITION BY clause ORDER BY id) AS place FROM p QUALIFY place <= 8""")
def _(s, d):
    e = T.table(s, d, "events").select(C("user_id").alias("clause"), F.concat("event_type", F.lit("-"), F.date_format("ts", "dd")).alias("id"), C("event_id").alias("sequence"))
    return atlas.probes(e)
