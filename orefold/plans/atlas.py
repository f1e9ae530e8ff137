"""Path trees of snapshots, their bounded projection, and the checks around stored sessions and runs (A, G13-G16, H7, I15)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orefold.functions import paths

C = F.col


def _directories(path: Column) -> Column:
    return F.explode(paths.prefixes(path, None)).alias("directory")


def collisions(files: DataFrame) -> DataFrame:
    """(path, problem): paths given twice, and files that are also directories of others; none if the tree can be built."""
    n = files.groupBy("path").agg(F.count("*").alias("n"))
    twice = n.where("n > 1").select("path", F.lit("duplicate").alias("problem"))
    above = files.select(_directories(C("path"))).distinct().withColumnRenamed("directory", "path")
    return twice.unionAll(n.join(above, "path", "left_semi").select("path", F.lit("collision").alias("problem")))


def nodes(files: DataFrame) -> DataFrame:
    """(path, node, files, modeled): files (path, kind, modeled), and the directories that stay.

    A directory whose only child is a directory isn't a node: its child stands for both. ``node`` is "directory" or the file's kind.
    """
    sums = files.select(_directories(C("path")), C("modeled").cast("long").alias("m")).groupBy("directory").agg(F.count("*").alias("files"), F.sum("m").alias("modeled"))
    parent = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    children = sums.select(C("directory").alias("path"), F.lit(1).alias("d")).unionAll(files.select("path", F.lit(0)))
    chained = children.groupBy(parent.alias("directory")).agg(F.count("*").alias("n"), F.sum("d").alias("d")).where("n = 1 and d = 1")
    stays = sums.join(chained, "directory", "left_anti").select(C("directory").alias("path"), F.lit("directory").alias("node"), "files", "modeled")
    return stays.unionAll(files.select("path", "kind", F.lit(1).cast("long"), C("modeled").cast("long")))


def node_counts(tree: DataFrame) -> DataFrame:
    """(directory, total): how many nodes a directory's subtree holds, itself included."""
    below = tree.select(_directories(C("path"))).groupBy("directory").agg(F.count("*").alias("n"))
    own = tree.where("node = 'directory'").select(C("path").alias("directory"))
    return own.join(below, "directory", "left").select("directory", (F.coalesce("n", F.lit(0)) + 1).alias("total"))


def breadth_first(tree: DataFrame, budget: int = 240) -> DataFrame:
    """(place, path, node): the first ``budget`` nodes in breadth-first order, kept by a top-k and not by a global sort.

    Siblings: directories, then manifests, sources, unknown files and assets, each by path in code point order. The order of a level
    is that of the nodes above, hence of the list of their keys.
    """
    rank = F.element_at(F.create_map(*[F.lit(x) for x in ("directory", "0", "manifest", "1", "source", "2", "unknown", "3", "asset", "4")]), C("node"))
    above = tree.select("path", F.explode_outer(paths.prefixes(C("path"), None)).alias("directory"))
    known = above.join(tree.where("node = 'directory'").select(C("path").alias("directory"), F.lit(True).alias("is")), "directory", "left")
    keys = known.groupBy("path").agg(F.sort_array(F.collect_list(F.when(C("is"), F.concat(F.lit("0"), "directory")))).alias("keys"))
    ordered = tree.join(keys, "path").select("path", "node", F.size("keys").alias("depth"), F.array_append("keys", F.concat(rank, C("path"))).alias("keys"))
    first = ordered.orderBy("depth", "keys").limit(budget)
    return first.select(F.row_number().over(Window.orderBy("depth", "keys")).alias("place"), "path", "node")


def projection(tree: DataFrame, budget: int = 240) -> DataFrame:
    """(directory, files, modeled, total, omitted): the chosen directories with the number of nodes below that weren't chosen."""
    chosen = breadth_first(tree, budget)
    shown = chosen.select(_directories(C("path"))).unionAll(chosen.where("node = 'directory'").select("path")).groupBy("directory").agg(F.count("*").alias("shown"))
    own = tree.where("node = 'directory'").select(C("path").alias("directory"), "files", "modeled")
    picked = shown.join(chosen.where("node = 'directory'").select(C("path").alias("directory")), "directory", "left_semi")
    return own.join(picked, "directory").join(node_counts(tree), "directory").select("directory", "files", "modeled", "total", (C("total") - C("shown")).alias("omitted"))


def path_problems(files: DataFrame) -> DataFrame:
    """(path, problem): invalid paths (as they came) and normalized paths that several files have."""
    known = files.select("path", paths.normalize(C("path")).alias("to"))
    bad = known.where(F.coalesce(C("to"), F.lit("")) == "").select("path", F.lit("invalid").alias("problem"))
    return bad.unionAll(known.where("to != ''").groupBy(C("to").alias("path")).agg(F.count("*").alias("n")).where("n > 1").select("path", F.lit("duplicate")))


def hydrate(listing: DataFrame, texts: DataFrame, most_bytes: int = 524_288) -> DataFrame:
    """Each listed file with its text; null where it is larger than ``most_bytes`` or has none."""
    return listing.join(texts.select("path", "text"), "path", "left").withColumn("text", F.when(C("size") <= most_bytes, C("text")))


def newest(rows: DataFrame, keys: list[str], at: list[str], n: int | None = None) -> DataFrame:
    """The last row of each key by the columns ``at``; of all these the ``n`` last ones."""
    rest = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*at)).alias("last")).select(*keys, "last.*")
    return last if n is None else last.orderBy(*[F.desc(c) for c in at]).limit(n)


def submissions(expected: DataFrame, submitted: DataFrame) -> DataFrame:
    """H7: (session, outcome) of (session, id) rows: whether each expected id was submitted exactly once, and no other."""
    e = expected.select("session", "id", F.lit(1).alias("e"), F.lit(0).alias("s")).unionAll(submitted.select("session", "id", F.lit(0), F.lit(1)))
    n = e.groupBy("session", "id").agg(F.sum("e").alias("e"), F.sum("s").alias("s"))
    outcome = F.when(F.max((C("e") != C("s")).cast("int")) == 1, "mismatch").when(F.max("s") > 1, "duplicate").otherwise("complete")
    return n.groupBy("session").agg(outcome.alias("outcome"))


def pending(packets: DataFrame, mapped: DataFrame) -> DataFrame:
    """Packets (id, fingerprint, ...) whose region isn't mapped with the same fingerprint."""
    return packets.join(mapped.select("id", "fingerprint").distinct(), ["id", "fingerprint"], "left_anti")


def confidence(claims: DataFrame, regions: DataFrame) -> DataFrame:
    """(region, confidence): the mean of a region's claims to two places; 0.35 without claims."""
    mean = claims.groupBy("region").agg(F.round(F.avg("confidence"), 2).alias("confidence"))
    return regions.join(mean, "region", "left").select("region", F.coalesce("confidence", F.lit(0.35)).alias("confidence"))


def handoff(references: DataFrame, runs: DataFrame) -> DataFrame:
    """References (run_id, repository, commit, profile, artifact) with the first reason against the stored run; null if it may be used.

    Runs have (run_id, repository, commit, profile, status, certificate); an empty artifact asks for no certain certificate.
    """
    run = runs.select("run_id", *[C(c).alias("r_" + c) for c in ("repository", "commit", "profile", "status", "certificate")], F.lit(True).alias("found"))
    differs = lambda c: ~C(c).eqNullSafe(C("r_" + c))
    reason = (F.when(C("found").isNull(), "run").when(differs("repository"), "repository").when(differs("commit"), "commit").when(differs("profile"), "profile")
              .when(~F.coalesce(C("r_status").isin("CERTIFIED", "PARTIAL"), F.lit(False)), "status").when(C("r_certificate").isNull(), "certificate")
              .when((F.coalesce("artifact", F.lit("")) != "") & (C("artifact") != C("r_certificate")), "artifact"))
    return references.join(run, "run_id", "left").select(*references.columns, reason.alias("reason"))


def frontier(path: Column, targets: Column) -> Column:
    """The last three steps of a path and the first three targets."""
    n = F.size(path)
    return F.concat(F.slice(path, F.greatest(n - 2, F.lit(1)), F.lit(3)), F.slice(targets, 1, 3))


def best_packet(packets: DataFrame, terms: list[str]) -> DataFrame:
    """(id, score): the one packet (id, kind, names, symbols, evidence) that matches best; equal ones: the repository last, then by id.

    A term counts 8 in paths and names, 6 in symbols, 3 in evidence; a repository starts with 1, others with 2. A null text matches nothing.
    """
    base = F.when(C("kind") == "repository", 1).otherwise(2)
    hits = [F.when(F.contains(F.lower(c), F.lit(t)), w).otherwise(0) for t in terms for c, w in (("names", 8), ("symbols", 6), ("evidence", 3))]
    scored = packets.select("id", "kind", sum(hits, base).alias("score"))
    return scored.orderBy(F.desc("score"), F.coalesce(C("kind") == "repository", F.lit(False)), "id").limit(1).select("id", "score")


def merge_regions(existing: DataFrame, expansion: DataFrame) -> DataFrame:
    """I16: regions (id, status) of both; a region of the expansion replaces that of the same id."""
    both = existing.select("id", "status", F.lit(0).alias("new")).unionAll(expansion.select("id", "status", F.lit(1)))
    return both.groupBy("id").agg(F.max_by("status", F.struct("new", "status")).alias("status"))


def coverage(regions: DataFrame, packets: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row of counts of merged regions (id, status) against packets (id) and the wanted ones among them (id)."""
    seen = (regions.select("id", "status", F.lit(0).alias("p"), F.lit(0).alias("w")).unionAll(packets.select("id", F.lit(None).cast("string"), F.lit(1), F.lit(0)))
            .unionAll(wanted.select("id", F.lit(None).cast("string"), F.lit(0), F.lit(1)))
            .groupBy("id").agg(F.max("status").alias("status"), F.max("p").alias("p"), F.max("w").alias("w")))
    n = lambda condition: F.count_if(condition)
    mapped = C("status").isNotNull()
    sums = seen.agg(n(mapped).alias("regions"), *[n(C("status") == x).alias(x) for x in ("synthesized", "partial", "deterministic")],
                    n((C("p") == 1) & ~mapped).alias("unmapped"), n(C("w") == 1).alias("wanted"), n((C("w") == 1) & mapped).alias("found"))
    status = F.when(C("unmapped") == 0, "COMPLETE").when((C("wanted") > 0) & (C("found") == C("wanted")), "OBJECTIVE_SUFFICIENT").otherwise("PARTIAL")
    return sums.withColumn("status", status)


def probes(found: DataFrame, n: int = 8) -> DataFrame:
    """of probes (clause, id, sequence, ...) the last of each id, and of each clause the ``n`` first by id.

    Spark cuts each task's groups to ``n`` rows before the shuffle, so a hot clause sends few.
    """
    last = newest(found, ["clause", "id"], ["sequence"])
    return last.withColumn("place", F.row_number().over(Window.partitionBy("clause").orderBy("id"))).where(C("place") <= n)
