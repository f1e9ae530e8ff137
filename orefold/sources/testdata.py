"""The driver's tables as fact tables: keys are files, foreign keys dependencies, events state accesses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _node(kind: str, key: str):
    return F.concat(F.lit(kind + "/"), F.col(key).cast("string"))


def dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(from, to, kind): orders depend on parts, suppliers and customers, these on nations, nations on regions."""
    t = lambda n: table(spark, sf_dir, n)
    line = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey").distinct()
    kinds = [
        (line.select("l_orderkey", "l_partkey").distinct(), "order", "l_orderkey", "part", "l_partkey", "import"),
        (line.select("l_orderkey", "l_suppkey").distinct(), "order", "l_orderkey", "supplier", "l_suppkey", "import"),
        (t("orders"), "order", "o_orderkey", "customer", "o_custkey", "require"),
        (t("customer"), "customer", "c_custkey", "nation", "c_nationkey", "reexport"),
        (t("supplier"), "supplier", "s_suppkey", "nation", "s_nationkey", "reexport"),
        (t("nation"), "nation", "n_nationkey", "region", "n_regionkey", "manifest")]
    out = None
    for df, a, ka, b, kb, kind in kinds:
        e = df.select(_node(a, ka).alias("from"), _node(b, kb).alias("to"), F.lit(kind).alias("kind"))
        out = e if out is None else out.unionAll(e)
    return out


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(from, to): what type of event follows which for a user, each with its day: a graph with cycles inside days."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    node = F.concat(F.date_format("ts", "dd"), F.lit("/"), "event_type")
    e = table(spark, sf_dir, "events").select(node.alias("from"), F.lead(node).over(w).alias("to"))
    return e.where("to is not null").distinct()


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(namespace, key, file, access, line): events as accesses of a day's state by users."""
    access = F.create_map(*[F.lit(x) for x in ("view", "read", "purchase", "write", "signup", "write", "error", "delete", "click", "unknown")])
    return table(spark, sf_dir, "events").select(F.date_format("ts", "dd").alias("namespace"), F.get_json_object("props", "$.k").alias("key"), _node("user", "user_id").alias("file"), F.coalesce(access[F.col("event_type")], F.lit("unknown")).alias("access"), F.col("event_id").alias("line"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, size, text): documents as files below their source and language."""
    return table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "lang", F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".md"))).alias("path"), F.col("n_chars").alias("size"), "text")


def effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, kind): line items as effects of their order, by return flag and line status."""
    return table(spark, sf_dir, "lineitem").select(_node("order", "l_orderkey").alias("file"), F.concat("l_returnflag", F.lit("-"), "l_linestatus").alias("kind"))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, file, kind, exported, line): parts as symbols of their brand's file."""
    return table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("file"), F.col("p_type").alias("kind"), (F.col("p_size") > 25).alias("exported"), F.col("p_partkey").alias("line"))


def _program(k, z):
    """The text of the program of part k of size z; the queries' SQL states the facts that it holds."""
    t = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v.cast("string") for v in x])
    return F.concat_ws("\n",
        t('import { a } from "../m', (k + 1) % 40, "/p", k + 1, '.js";'),
        F.lit("// import b from './hidden.js'; fetch('y')"),
        F.when(z % 2 == 0, t('import "./side', z, '.css";')).otherwise('/* export * from "x" */ export { q } from "lodash";'),
        t('const KEY = "k', z % 5, '";'), F.lit(""),
        t("export async function f", k, "(a, b) {"),
        t('  Hooks.on("ready", a); const t = await import("./p', k, '.js");'),
        F.lit('  if (a == null) return; game.settings.set("ns", KEY, 1);'),
        F.lit("  token.update({x: 1}); return g(a);"), F.lit("}"),
        t("class C", z, " extends B {}"),
        F.lit('var v = localStorage.getItem("s" + a); fetch("/x");'),
        t("globalThis.app = 1; x = data.flags.mod", z % 3, '.path; item.unsetFlag("ns", "q"); // done'))


def programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text, k, z): a program for each part, and styles, templates and manifests for some."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("z"))
    # two numbers become a text of a thousand bytes: few blocks of the table are work for all tasks
    part = part.repartition(4 * spark.sparkContext.defaultParallelism, "k")
    k, z = F.col("k"), F.col("z")
    t = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v.cast("string") for v in x])
    kinds = [
        ("true", t("src/m", k % 40, "/p", k, ".js"), _program(k, z)),
        ("k % 10 = 0", t("src/m", k % 40, "/s", k, ".css"), t('@import url("a', z, """.css"); @use 'b';\n@FORWARD "c";""")),
        ("k % 10 = 1", t("pages/", k, ".html"), t("<IMG SRC = 'x", z, """.png'>\n<a href="y.html">y</a>""")),
        ("k % 10 = 2", t("mods/", k, "/module.json"), t('{"scripts": ["a', k, '.js", 3], "styles": ["s.css"], "esmodules": "no"}')),
        ("k % 10 = 3", t("mods/", k, "/system.json"), t('{"scripts": ["a', k, '.js"'))]
    out = None
    for where, path, text in kinds:
        f = part.where(where).select(path.alias("path"), text.alias("text"), "k", "z")
        out = f if out is None else out.unionAll(f)
    return out
