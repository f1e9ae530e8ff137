"""Document fingerprints by SpotSigs (operator 2): DataFrame and SQL functions only."""

from __future__ import annotations

from collections import Counter
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Common words of English, German, French and Spanish, the anchors of signatures.
ANCHORS = """
a about after all also an and any are as at be been but by can could did do does for from had has have he her his how if in into is it its
may more my no not of on one only or other our out over she so some such than that the their them then there these they this to up was we
were what when which who will with would you your
aber als am an auch auf aus bei bin bis das dass dem den der des die doch du durch ein eine einem einen einer er es für hat ich ihr im in
ist ja kein man mit nach nicht noch nur oder sein sich sie sind so und um uns von vor war was wenn werden wie wir wird zu zum zur über
au aux avec ce ces cette comme dans de des du elle en est et eux il ils je la le les leur mais ne nous on ou où par pas plus pour qu que
qui sa se ses si son sont sur un une vous
al como con cuando del donde el ella ellos en entre era esta este está ha hasta la las lo los me mi muy más ni o para pero por porque que
se ser si sin sobre son su sus también te tiene un una y ya yo
"""

#: Content words in a chain, after its anchor.
CHAIN = 3
#: Percentiles of ids that the driver gets, and buckets of neighbouring ids, at most.
PERCENTILES, MOST_BUCKETS = 256, 1 << 20


def _let(value: Column, body) -> Column:
    """body(value), with value computed once a row."""
    return F.transform(F.array(value), body)[0]


def signatures(text: Column, cover: bool = False) -> Column:
    """The sorted set of 32-bit spot signatures of a text.

    Words are runs of letters and digits in lower case; common words are anchors, the others content. Where content
    follows anchors, the last anchor and the next CHAIN content words make one signature (fewer at the end of the
    text). The start of a text is an anchor too, so a text with a content word has at least one signature. A text with
    no content word is one signature by itself; a null or empty text has none.

    With ``cover``, content that goes on past a chain without an anchor has signatures too, so that texts of few or no
    anchors (other languages, code, tables) are not judged by their starts: of each CHAIN successive such words (or what
    is left of them at the end of the text) the one of the least hash and the CHAIN - 1 content words after it make one.
    """
    text = F.coalesce(text.cast("string"), F.lit(""))
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    anchors = sorted(set(ANCHORS.split()))
    # one line for each content word, with the anchors before it: "of the\x20cat\n"
    lines = F.array_join(F.transform(words, lambda w: F.concat(w, F.when(w.isin(anchors), " ").otherwise("\n"))), "")
    spots = F.split(F.concat(F.lit("^ "), lines), "\n")

    def chain(all_spots: Column) -> Column:
        def at(x: Column, i: Column) -> Column:
            rest = [F.substring_index(F.get(all_spots, i + k), " ", -1) for k in range(1, CHAIN)]
            return F.when(F.contains(x, F.lit(" ")) & ~x.endswith(" "), F.hash(F.substring_index(x, " ", -2), *rest))
        return F.transform(all_spots, at)

    def covered(all_spots: Column) -> Column:
        end = F.lit(1 << 40)
        past = lambda i: F.coalesce(*[F.when(F.contains(F.get(all_spots, i - k), F.lit(" ")), F.lit(False)) for k in range(1, CHAIN)], F.lit(True))
        keys = F.transform(all_spots, lambda x, i: F.when(x == "", end).when(~F.contains(x, F.lit(" ")) & past(i), F.hash(x).cast("long")))

        def more(at: Column) -> Column:
            def chosen(x: Column, i: Column) -> Column:
                own = F.get(at, i)
                least = {k: F.coalesce(own <= F.get(at, i + k), F.lit(False)) for k in range(1 - CHAIN, CHAIN) if k}
                windows = [reduce(and_, [least[k] for k in range(first, first + CHAIN) if k]) for first in range(1 - CHAIN, 1)]
                return F.when((own < end) & reduce(or_, windows), F.hash(x, *[F.substring_index(F.get(all_spots, i + k), " ", -1) for k in range(1, CHAIN)]))
            return F.transform(all_spots, chosen)
        return F.concat(chain(all_spots), _let(F.concat(keys, F.array_repeat(end, CHAIN)), more))

    found = _let(spots, covered if cover else chain)
    return _let(F.sort_array(F.array_distinct(F.filter(found, lambda x: x.isNotNull()))),
                lambda s: F.when((F.size(s) == 0) & (text != ""), F.array(F.hash(text))).otherwise(s))


def fingerprint(sigs: Column) -> Column:
    """The signature set as a string: 8 hexadecimal digits each, separated by spaces."""
    return F.array_join(F.transform(sigs, lambda x: F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two signature sets; two empty sets are alike (1), an empty set and another are not (0)."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def with_next(docs: DataFrame, id_col: str, values: list[str], rows_in_bucket: int = 500) -> DataFrame:
    """Each row with the next one's ``values`` as next_<value>, ids descending (nulls last; ties by a hash of the first value); after the last row, the first.

    Rows are dealt to buckets of neighbouring ids: between percentiles of the ids (at most PERCENTILES) by equal steps, and an id
    that is itself several percentiles, like null, by the hash. The number of buckets follows the number of rows, up to MOST_BUCKETS.
    The first row of a bucket is also put at the end of the bucket above, so a window in each bucket sees every neighbour
    and no task sees the whole table. Only ids and hashes of the first rows, one a bucket, are broadcast (32 MB at most).
    """
    order = [F.col(id_col).desc_nulls_last(), F.col("_h")]
    size = docs.agg(F.count("*").alias("n"), F.count(id_col).alias("ids"), F.min(id_col).alias("lo"), F.max(id_col).alias("hi")).first()
    some = max(1, min(PERCENTILES, size.ids // rows_in_bucket))
    cuts = docs.select(F.percentile_approx(id_col, [i / some for i in range(1, some)], 10_000).alias("c")).first()["c"] if some > 1 else []
    heavy = [c for c, n in Counter(cuts or []).items() if n > 1]
    cuts = sorted(set(cuts or []))
    steps = max(1, min(MOST_BUCKETS, -(-size.ids // rows_in_bucket)) // (2 * (len(cuts) + 1)))
    held = docs.withColumn("_h", F.xxhash64(values[0]))
    array = lambda x: F.array(*[F.lit(c) for c in x]).cast("array<long>")

    def by_hash(k: int) -> Column:
        """0 .. k - 1, ascending with the hash."""
        return F.least(F.lit(k - 1), F.floor((F.col("_h").cast("double") / 2.0**64 + 0.5) * k)).cast("long")

    def between(i: Column) -> Column:
        """The bucket of an id in the i-th interval: a heavy lower end first, in falling order of the hash."""
        lo, hi, v = F.get(array([size.lo or 0, *cuts]), i), F.get(array([*cuts, (size.hi or 0) + 1]), i), F.col(id_col)
        step = F.least(F.lit(steps - 1), F.floor((v.cast("double") - lo) / F.greatest(hi.cast("double") - lo, F.lit(1.0)) * steps)).cast("long")
        return i * (2 * steps) + (F.when(v.isin(heavy), steps - 1 - by_hash(steps)).otherwise(steps + F.greatest(F.lit(0), step)) if heavy else steps + F.greatest(F.lit(0), step))

    place = _let(F.size(F.filter(array(cuts), lambda c: c <= F.col(id_col))), between) if cuts else between(F.lit(0))
    bucket = F.when(F.col(id_col).isNull(), -1 - by_hash(max(1, min(MOST_BUCKETS, (size.n - size.ids) // rows_in_bucket)))).otherwise(place)
    dealt = held.withColumn("_b", bucket)
    # the first row of each bucket, and the bucket that goes before
    firsts = docs.select(id_col, F.xxhash64(values[0]).alias("_h")).withColumn("_b", bucket).groupBy("_b").agg(F.min(F.struct((-F.col(id_col)).alias("k"), "_h")).alias("f"))
    every = Window.orderBy(F.col("_b").desc())
    firsts = firsts.withColumn("_to", F.coalesce(F.lag("_b").over(every), F.min("_b").over(Window.partitionBy())))
    firsts = firsts.select((-F.col("f.k")).alias("_fk"), F.col("f._h").alias("_fh"), "_to")
    dealt = dealt.join(F.broadcast(firsts), dealt[id_col].eqNullSafe(F.col("_fk")) & (F.col("_h") == F.col("_fh")), "left")
    own = F.struct(F.col("_b").alias("b"), F.lit(False).alias("ghost"))
    dealt = dealt.withColumn("_p", F.explode(F.when(F.col("_to").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("_to").alias("b"), F.lit(True).alias("ghost"))))))
    dealt = dealt.select(*docs.columns, "_h", F.col("_p.b").alias("_in"), F.col("_p.ghost").alias("_ghost"))
    w = Window.partitionBy("_in").orderBy("_ghost", *order)
    return dealt.select("*", F.lead(F.struct(*values)).over(w).alias("_next")).where("not _ghost").select(*docs.columns, *[F.col(f"_next.{v}").alias(f"next_{v}") for v in values])


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, cover: bool = False) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row.

    The edited text is the text whose last floor(n / 2) code points are replaced by the first as many of the next text
    (or all of it), ids descending; see with_next. Null texts count as empty; equal texts have equal fingerprints.
    Repeated rows give their rows; extra columns are not read. For ``cover`` see signatures.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    d = with_next(base.withColumn("sigs", signatures(F.col("text"), cover)), "doc_id", ["text", "sigs"])
    half = F.floor(F.length("text") / 2).cast("int")
    d = d.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next_text"), F.lit(1), half)))
    d = d.select("doc_id", F.length("text").cast("long").alias("n_chars"), "sigs", "next_sigs", F.sha2(F.col("edited"), 256).alias("edited_sha256"), signatures(F.col("edited"), cover).alias("edited_sigs"))
    return d.select("doc_id", "n_chars", "edited_sha256", fingerprint(F.col("sigs")).alias("fingerprint"), fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
                    likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"), likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"))


def near_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, *, cover: bool = False) -> DataFrame:
    """(a, b, near): pairs of classes of equal fingerprints with likeness >= threshold, a < b; see classes() for the members.

    Sets are partitioned by length so that a set's partners are in its own partition or the next one, and pruned twice:
    only sets that share one of their rarest signatures (as many as the threshold lets them miss, and one more) meet,
    and only when their lengths allow the threshold. Then the whole sets are compared. Texts without signatures and rows without id have no pairs.
    """
    c = _signed(docs, id_col, text_col, cover).where("size(sigs) > 0 and doc_id is not null").groupBy("sigs").agg(F.min("doc_id").alias("id"))
    c = c.withColumn("n", F.size("sigs")).withColumn("part", F.floor(F.log("n") / -F.log(F.lit(threshold)) + 1e-9).cast("int"))
    often = c.select(F.explode("sigs").alias("s")).groupBy("s").agg(F.count("*").alias("f"))
    rare = c.select("id", "n", "part", F.explode("sigs").alias("s")).join(often, "s")
    rare = rare.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("f", "s"))).where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1)
    left = rare.select("s", F.col("id").alias("i"), F.col("n").alias("ni"), F.explode(F.array(F.col("part"), F.col("part") + 1)).alias("part"), F.col("part").alias("pi"))
    right = rare.select("s", F.col("id").alias("j"), F.col("n").alias("nj"), "part")
    met = left.join(right, ["s", "part"]).where((F.col("i") != F.col("j")) & ((F.col("pi") != F.col("part")) | (F.col("i") < F.col("j"))) & (F.least("ni", "nj") >= threshold * F.greatest("ni", "nj") - 1e-9))
    met = met.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).distinct()
    sets = c.select("id", "sigs")
    both = met.join(sets.withColumnsRenamed({"id": "a", "sigs": "x"}), "a").join(sets.withColumnsRenamed({"id": "b", "sigs": "y"}), "b")
    return both.select("a", "b", likeness(F.col("x"), F.col("y")).alias("near")).where(F.col("near") >= threshold)


def _signed(docs: DataFrame, id_col: str, text_col: str, cover: bool) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), signatures(F.col(text_col), cover).alias("sigs"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, cover: bool = False, parts: int = 64) -> DataFrame:
    """(doc_id, class_id) of each row: rows of equal sets are one class, named by its smallest id (null: none of them has one).

    A class is joined to its rows in ``parts`` parts, so copies of one text are no hot task.
    """
    rows = _signed(docs, id_col, text_col, cover).select("doc_id", F.sha1(fingerprint(F.col("sigs")).cast("binary")).alias("set"), F.pmod(F.xxhash64("doc_id"), F.lit(parts)).alias("part"))
    named = rows.groupBy("set").agg(F.min("doc_id").alias("class_id"))
    met = rows.groupBy("set", "part").agg(F.lit(1).alias("one")).join(named, "set").select("set", "part", "class_id")
    return rows.join(met, ["set", "part"]).select("doc_id", "class_id")
