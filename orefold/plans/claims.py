"""Claims about regions against the evidence of their packets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orefold.functions import text

# Fixed values (I17): the longest text of a claim, and how many claims of a kind a region takes.
LONGEST, NAME = 600, 120
MOST = {"purpose": 1, "responsibility": 5, "does-not-own": 4, "key-flow": 5}


def collapsed(value):
    return F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"\s+", " "))


def validate(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """(region, kind, pos, text, refs, confidence, accepted, reason) of submitted claims (region, kind, pos, text, refs: array).

    A claim is sound if its text, white space collapsed, has 1 to 600 characters and one of its references (trimmed, each once) is evidence (region, id, kind) of its
    own region; others are struck. Of the sound ones of a kind, the first as far as the region takes them are accepted. B57: confidence grows with the kinds
    of evidence and the references.

    References meet evidence by an equi-join, and are counted, so no claim looks through a packet. Null texts and references are as empty ones;
    repeated evidence counts once, repeated claims are claims of their own; claims on unknown regions and of unknown kinds are refused. Repeated positions are ordered by text. No claims give no rows.
    """
    key = ["region", "kind", "pos", "text"]
    c = claims.select("region", "kind", "pos", collapsed(F.col("text")).alias("text"), F.coalesce("refs", F.array().cast("array<string>")).alias("refs"))
    c = c.groupBy(*key, "refs").agg(F.count("*").cast("int").alias("times"))
    asked = c.select(*key, "refs", F.posexplode("refs").alias("at", "ref")).select(*key, "refs", "at", F.trim("ref").alias("id")).where("id <> ''")
    proof = evidence.select("region", "id", F.col("kind").alias("proof")).where("id is not null").dropDuplicates(["region", "id"])
    good = asked.join(proof, ["region", "id"]).groupBy(*key, F.col("refs").alias("given"), "id").agg(F.min("at").alias("at"), F.first("proof").alias("proof"))
    met = good.groupBy(*key, "given").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "id"))), lambda r: r["id"]).alias("found"), F.count_distinct("proof").alias("kinds"))
    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"m.{k}")) for k in key] + [F.col("c.refs") == F.col("m.given")]
    j = c.alias("c").join(met.alias("m"), same, "left").select("c.*", "found", "kinds")
    most = F.coalesce(F.create_map(*[F.lit(x) for pair in MOST.items() for x in pair])[F.col("kind")], F.lit(0))
    reason = F.when(F.col("text") == "", "no text").when(F.length("text") > LONGEST, "text too long").when(F.col("found").isNull(), "no evidence of the region")
    j = j.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("times")))).withColumn("reason", reason).withColumn("_ok", F.col("reason").isNull())
    j = j.withColumn("_n", F.sum(F.col("_ok").cast("int")).over(Window.partitionBy("region", "kind").orderBy("pos", "text", "refs", "_copy").rowsBetween(Window.unboundedPreceding, 0)))
    j = j.withColumn("reason", F.coalesce("reason", F.when(F.col("_n") > most, "the region takes no more")))
    value = text.claim_confidence(F.col("kinds"), F.size("found"), F.col("kind") == "does-not-own")
    ok = F.col("reason").isNull()
    return j.select("region", "kind", "pos", "text", F.when(ok, F.col("found")).alias("refs"), F.when(ok, value).alias("confidence"), ok.alias("accepted"), "reason")


def regions(packets: DataFrame, names: DataFrame, judged: DataFrame) -> DataFrame:
    """(id, name, accepted, rejected, confidence, status) of regions (packets: id, name_hint) with what was submitted of them (``names``: region, name; ``judged``: see ``validate``).

    A region is synthesized with a purpose and a responsibility, partial with any other claim, else deterministic at 0.35; its confidence is the mean of its claims.
    """
    g = judged.groupBy(F.col("region").alias("id")).agg(F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("rejected"), F.round(F.avg(F.when(F.col("accepted"), F.col("confidence"))), 2).alias("mean"), *[F.count_if(F.col("accepted") & (F.col("kind") == k)).alias(f"_{k}") for k in ("purpose", "responsibility")])
    given = names.select(F.col("region").alias("id"), collapsed(F.col("name")).alias("given")).where("given <> ''").dropDuplicates(["id"])
    j = packets.select("id", "name_hint").join(g, "id", "left").join(given, "id", "left").fillna(0, ["accepted", "rejected", "_purpose", "_responsibility"])
    status = F.when(F.col("accepted") == 0, "deterministic").when((F.col("_purpose") > 0) & (F.col("_responsibility") > 0), "synthesized").otherwise("partial")
    return j.select("id", F.substring(F.coalesce("given", "name_hint"), 1, NAME).alias("name"), "accepted", "rejected", F.coalesce("mean", F.lit(0.35)).alias("confidence"), status.alias("status"))
