"""Which texts hold which terms, for many terms at once: words that meet terms, then texts that meet words (quirk Q12 of I1, I9, I14)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orefold.operators.graph import Rounds

#: Code points of a word whose grams one row holds, and terms that are looked for in one copy of a text.
PIECE, TERMS = 1 << 12, 256
BLANK = r"\s+"


def grams(text: Column, size: int) -> Column:
    """All runs of ``size`` code points of a text, in order."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1))


def _held(words: DataFrame, parts: DataFrame, sizes: Sequence[int], size: int, longer: bool, store: Rounds) -> DataFrame:
    """(word, part): every distinct word and each of the parts that it holds, once.

    A part of ``size`` code points or fewer is itself a gram of the words that hold it, so these alone meet it; a longer one is
    looked up by its rarest gram and verified.
    """
    at = F.explode(F.sequence(F.lit(0), F.floor((F.length("word") - 1) / PIECE).cast("int"))).alias("_at")
    cut = words.select("word", at).select("word", F.substr("word", F.col("_at") * PIECE + 1, F.lit(PIECE + size - 1)).alias("_p"))
    found = cut.select("word", F.explode(F.array_distinct(F.concat(*[grams(F.col("_p"), n) for n in sizes]))).alias("gram"))
    short = F.length("part") <= size
    pieces = parts.select("part", F.explode(F.array_distinct(F.when(short, F.array("part")).otherwise(grams(F.col("part"), size)))).alias("gram"))
    index = store.save(found.join(pieces.select("gram").distinct(), "gram", "left_semi").distinct())
    key = parts.where(short).select(F.col("part").alias("gram"), "part")
    if longer:
        rarity = index.groupBy("gram").agg(F.count("*").alias("n"))
        # a part whose grams are not all in the index is in no word
        rare = pieces.where(~short).join(rarity, "gram", "left").groupBy("part").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"), F.count_if(F.col("n").isNull()).alias("missing")).where("missing = 0")
        key = key.unionByName(rare.select("gram", "part"))
    return index.join(key, "gram").where(F.contains("word", "part")).select("word", "part")


def containing(texts: DataFrame, terms: DataFrame, ids: Sequence[str], text_col: str = "text", term_col: str = "term", size: int = 8) -> DataFrame:
    """(ids, term): every text and each of the terms that it holds as a substring, once.

    A term without white space lies in a text if it lies in one of the text's words. So terms meet the distinct words of all texts, by grams
    of up to ``size`` code points, and texts meet terms by an equi-join on words: its rows are the answer's, once for each word that holds a term. A term
    with white space is looked up by its longest part without any, and then verified in the texts that hold this part; these are
    copied once for about TERMS of such terms. A long word is looked at in pieces.

    Null and empty texts hold nothing; null and empty terms are held by nothing. Rows with a null id are left out; of rows with one id,
    each text counts. Repeated terms count once. Other columns are not read.
    """
    store = Rounds(texts.sparkSession)
    part = F.array_max(F.transform(F.split("term", BLANK), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    known = store.save(terms.select(F.col(term_col).alias("term")).where("term <> ''").distinct().select("term", part.alias("part")))
    said = texts.select(*ids, F.col(text_col).alias("_text")).where(" and ".join(f"`{c}` is not null" for c in ids)).where("_text <> ''")
    counts = known.groupBy(F.least(F.length("part"), F.lit(size)).alias("n")).agg(F.count_if(F.col("part") != F.col("term")).alias("spaced"), F.max(F.length("part")).alias("most")).collect()  # 0 to size
    if not counts:
        return said.select(*ids).withColumn("term", F.lit("")).limit(0)
    sizes, spaced = sorted(r.n for r in counts if r.n), sum(r.spaced for r in counts)
    split = F.split("_text", BLANK)
    if len(sizes) < len(counts):  # terms of white space alone: their part is in every text
        split = F.concat(split, F.array(F.lit("")))
    found = said.select(*ids, F.explode(F.array_distinct(split)).alias("word"))
    held = known.where("part = ''").select(F.col("part").alias("word"), "part").distinct()
    if sizes:
        words = store.save(found.select("word").where(F.length("word") >= sizes[0]).distinct())
        held = held.unionByName(_held(words, known.where("part <> ''").select("part").distinct(), sizes, size, any(r.most > size for r in counts), store))
    met = store.save(held.join(known, "part").select("word", "term", (F.col("part") == F.col("term")).alias("_plain")))
    pairs = found.join(met, "word")
    out = pairs.where("_plain").select(*ids, "term")
    if spaced:
        buckets = -(-spaced // TERMS)
        some = pairs.where("not _plain").select(*ids, "term").distinct().groupBy(*ids, F.pmod(F.xxhash64("term"), F.lit(buckets)).alias("_b")).agg(F.collect_list("term").alias("_terms"))
        out = out.unionByName(some.join(said, list(ids)).select(*ids, F.explode(F.filter("_terms", lambda t: F.contains(F.col("_text"), t))).alias("term")))
    return store.finish(out.distinct())
