"""Ranked lexical search over a bit-sliced impact index (operator 13)."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from orefold.llm.common import Scratch, text_batches
from orefold.llm.decontaminate import word_lists

#: Documents, and postings, of one block of the index.
BLOCK_DOCS, BLOCK_POSTINGS = 32_768, 4_000_000
#: Bytes of query terms (and 16 for each) that one pass over the documents serves.
PASS_BYTES = 16 << 20
#: Queries whose sums a task holds at once, some 200 kB each.
QUERIES_AT_ONCE = 128


# --------------------------------------------------------------------------- terms

def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, term, times) of each row of (text, item)."""
    for batch in batches:
        for part in text_batches(batch, "text"):
            counts = [Counter(words) for words in word_lists(part.column(0))]
            at = np.repeat(np.arange(len(counts)), [len(c) for c in counts])
            yield pa.RecordBatch.from_arrays([part.column(1).take(pa.array(at)), pa.array([t.decode() for c in counts for t in c], pa.string()), pa.array([n for c in counts for n in c.values()], pa.int64())], names=["item", "term", "times"])


def _postings(batches: Iterator[pa.RecordBatch], vocabulary: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """(id, n, terms, counts) of each row of (text, id): all its words counted, those of the vocabulary kept."""
    for batch in batches:
        for part in text_batches(batch, "text"):
            n, terms, counts = [], [], []
            for words in word_lists(part.column(0)):
                found = Counter(map(vocabulary.get, words))
                found.pop(None, None)
                n.append(len(words))
                terms.append(list(found))
                counts.append(list(found.values()))
            yield pa.RecordBatch.from_arrays([part.column(1), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))], names=["id", "n", "terms", "counts"])


# --------------------------------------------------------------------------- index

class Weights:
    """What turns a count into an impact: the corpus' size and length, and each term's weight."""

    def __init__(self, n_docs: int, length: int, df: dict[int, int]):
        self.n_docs, self.length = n_docs, length
        self.of = np.zeros(max(df, default=-1) + 1, np.int64)
        for term, n in df.items():
            self.of[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1)))

    def impacts(self, term: np.ndarray, count: np.ndarray, n: np.ndarray) -> np.ndarray:
        return self.of[term] * ((1_000_000_000 * count) // (1000 * count + 8 * n))

    def norm(self, n: int) -> int:
        return 100 - 75 + (75 * n * self.n_docs) // max(1, self.length)


def _slices(values: np.ndarray) -> bytes:
    """The bits of the values, lowest first: for each bit as many bytes as the values' bits take."""
    bits = (values[None, :] >> np.arange(int(values.max()).bit_length())[:, None]) & 1
    return np.packbits(bits.astype(np.uint8), axis=1, bitorder="little").tobytes()


class Indexer:
    """Makes the index of a task's postings, a block of documents at a time.

    Rows are (block, term, places, slices, docs): for a term the places of its documents in the block (16 bits each) and
    its impacts in bit slices over these; for term -1 the block's document ids.
    """

    def __init__(self, weights: Weights):
        self.weights, self.most_docs, self.most_postings = weights, BLOCK_DOCS, BLOCK_POSTINGS

    def block(self, name: str, docs: list[pa.Array], n: list[int], terms: list[np.ndarray], counts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        held = [len(t) for t in terms]
        place = np.repeat(np.arange(len(n)), held)
        norms = np.array([self.weights.norm(x) for x in n], np.int64)
        term, count = np.concatenate(terms).astype(np.int64), np.concatenate(counts)
        value = self.weights.impacts(term, count, norms[place])
        keep = value > 0
        term, value, place = term[keep], value[keep], place[keep]
        order = np.argsort(term, kind="stable")
        term, value, place = term[order], value[order], place[order].astype("<u2")
        ids = pa.concat_arrays(docs)
        each, starts = np.unique(term, return_index=True)
        ends = np.r_[starts[1:], len(term)]
        rows = [(int(t), place[a:b].tobytes(), _slices(value[a:b])) for t, a, b in zip(each, starts, ends)]
        none = pa.array([None] * len(rows), pa.list_(ids.type))
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary()), none], names=["block", "term", "places", "slices", "docs"])
        whole = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([-1], pa.int32()), pa.array([None], pa.binary()), pa.array([None], pa.binary()), whole], names=["block", "term", "places", "slices", "docs"])

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, k = TaskContext.get().partitionId(), 0
        docs, n, terms, counts, held = [], [], [], [], 0
        step = min(1024, self.most_docs)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                rows = batch.slice(at, step)
                new = sum(len(t) for t in rows.column(2))
                if n and (len(n) + rows.num_rows > self.most_docs or held + new > self.most_postings):
                    yield from self.block(f"{task}-{k}", docs, n, terms, counts)
                    docs, n, terms, counts, held, k = [], [], [], [], 0, k + 1
                docs.append(rows.column(0))
                n += rows.column(1).to_pylist()
                terms += [t.values.to_numpy(zero_copy_only=False) for t in rows.column(2)]
                counts += [c.values.to_numpy(zero_copy_only=False) for c in rows.column(3)]
                held += new
        if n:
            yield from self.block(f"{task}-{k}", docs, n, terms, counts)


# --------------------------------------------------------------------------- search

class Sums:
    """Sums of queries over a block's documents as bit slices: ``bits[b, q]`` holds bit b of query q's sums, a bit a document."""

    def __init__(self, n_queries: int, n_docs: int, depth: int):
        self.words = -(-n_docs // 64)
        self.bits = np.zeros((depth, n_queries, self.words), np.uint64)

    def add(self, queries: np.ndarray, places: np.ndarray, slices: list[np.ndarray], shift: int) -> None:
        """Adds impacts times 2^shift to the sums of some queries by carries from slice to slice, in the words that hold one of the documents."""
        words = np.unique(places >> 6)
        dense = np.zeros((len(slices), len(words) * 64), np.uint8)
        dense[:, np.searchsorted(words, places >> 6) * 64 + (places & 63)] = slices
        addend = np.packbits(dense, axis=1, bitorder="little").view(np.uint64)
        at = np.ix_(queries, words)
        carry = np.zeros((len(queries), len(words)), np.uint64)
        for b in range(shift, len(self.bits)):
            old = self.bits[b][at]
            if b - shift < len(addend):
                half = old ^ addend[b - shift]
                self.bits[b][at] = half ^ carry
                carry = (old & addend[b - shift]) | (carry & half)
            elif carry.any():
                self.bits[b][at] = old ^ carry
                carry &= old
            else:
                break

    def top(self, query: int, k: int, order: np.ndarray) -> list[tuple[int, int]]:
        """(place, sum) of the k largest positive sums, equal ones by ``order`` (a rank for each document): down from the highest slice, documents with a one come first."""
        slices = self.bits[:, query]
        sure, tied = np.zeros(self.words, np.uint64), np.bitwise_or.reduce(slices, axis=0)
        count = lambda x: int(np.bitwise_count(x).sum())
        if count(tied) > k:
            for s in slices[::-1]:
                upper = sure | (tied & s)
                n = count(upper)
                if n > k:
                    tied = tied & s
                elif n < k:
                    sure, tied = upper, tied & ~s
                else:
                    sure, tied = upper, np.zeros_like(tied)
                    break
        places = lambda x: np.flatnonzero(np.unpackbits(x.view(np.uint8), bitorder="little"))
        first, rest = places(sure), places(tied)
        rest = rest[np.argsort(order[rest], kind="stable")][: k - len(first)]
        chosen = np.r_[first, rest]
        value = sum((((slices[b][chosen >> 6] >> (chosen & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64) << b for b in range(len(slices))), np.zeros(len(chosen), np.int64))
        return list(zip(chosen.tolist(), value.tolist()))


class Searcher:
    """Ranks the documents of one block of the index for all queries of a pass."""

    def __init__(self, items: pa.Array, uses: dict[int, list[tuple[int, int]]], depth: int, k: int):
        self.items, self.uses, self.depth, self.k, self.at_once = items, uses, depth, k, QUERIES_AT_ONCE

    def best(self, table: pa.Table) -> pa.Table:
        terms = table["term"].to_numpy()
        ids = table["docs"].combine_chunks().filter(pa.array(terms == -1)).flatten()
        order = np.argsort(np.argsort(pc.fill_null(ids, np.iinfo(np.int64).max).to_numpy(), kind="stable"), kind="stable") if pa.types.is_integer(ids.type) else np.argsort(pc.sort_indices(ids).to_numpy())
        query, place, score = [], [], []
        for first in range(0, len(self.items), self.at_once):
            sums = Sums(min(self.at_once, len(self.items) - first), len(ids), self.depth)
            for term, row_places, row_slices in zip(terms.tolist(), table["places"], table["slices"]):
                uses = [(q - first, times) for q, times in self.uses.get(term, ()) if first <= q < first + self.at_once]
                if not uses:
                    continue
                places = np.frombuffer(row_places.as_py(), "<u2").astype(np.int64)
                bits = np.unpackbits(np.frombuffer(row_slices.as_py(), np.uint8).reshape(-1, -(-len(places) // 8)), axis=1, bitorder="little")[:, : len(places)]
                for shift in range(max(t for _, t in uses).bit_length()):
                    which = np.array([q for q, t in uses if t >> shift & 1], np.int64)
                    if len(which):
                        sums.add(which, places, bits, shift)
            for q in range(sums.bits.shape[1]):
                for p, value in sums.top(q, self.k, order):
                    query.append(first + q)
                    place.append(p)
                    score.append(value)
        return pa.table([self.items.take(pa.array(query, pa.int64())), ids.take(pa.array(place, pa.int64())), pa.array(score, pa.int64())], names=["item", "doc", "score"])


def rank(spark: SparkSession, docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", *, k: int = 10) -> DataFrame:
    """(item, rank, id, score): for each item the ``k`` documents of the highest score above 0, equal scores by ascending id.

    A score sums, over the item's terms with repeats, the term's weight times its impact in the document. The impacts of
    the queries' terms are indexed in blocks of documents, as bitmaps of their bits; a task adds a query's bitmaps by
    carries and goes down the sums' slices for its best. A block sends k rows a query, which are ranked once more.
    Queries are dealt to passes by the size of their terms, so what travels with the tasks is bounded. Documents are
    shuffled by block, never by term, so a frequent term is no hot key.

    Null and empty texts hold no terms: such documents have no rank and such items no rows. Rows of one item id are one
    item with all their terms; null ids are an item, too. Repeated documents are ranked each; null document ids come last
    among equals. Empty tables give no rows. Very long texts are counted whole. Other columns are not read.
    """
    texts = items.select(F.col(item_text_col).cast("string").alias("text"), F.col(item_col).alias("item"))
    item_type, doc_type = texts.schema["item"].dataType, docs.schema[id_col].dataType
    s = Scratch(spark, "lexical")
    terms = texts.mapInArrow(_terms, T.StructType([T.StructField("item", item_type), *T.StructType.fromDDL("term string, times long").fields]))
    terms = s.save(terms.groupBy("item", "term").agg(F.sum("times").alias("times")), "terms")
    passes = -(-(terms.agg(F.sum(F.octet_length("term") + 16)).first()[0] or 0) // PASS_BYTES)
    thin = docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("id"))
    out = T.StructType([T.StructField("item", item_type), T.StructField("doc", doc_type), T.StructField("score", T.LongType())])
    best = spark.createDataFrame([], out)
    for p in range(passes):
        mine = terms.where(F.pmod(F.xxhash64("item"), F.lit(passes)) == p).orderBy("item", "term").toArrow()
        best = best.union(_search(s, thin, mine, f"{p}", k, out)) if mine.num_rows else best
    by = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc").asc_nulls_last())
    ranked = best.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(item_col), "rank", F.col("doc").alias(id_col), "score")


def _search(s: Scratch, thin: DataFrame, mine: pa.Table, name: str, k: int, out: T.StructType) -> DataFrame:
    """The best of each block for the queries whose terms are ``mine`` (item, term, times; ordered by item)."""
    numbers: dict[str, int] = {}
    term = [numbers.setdefault(t, len(numbers)) for t in mine["term"].to_pylist()]
    item = mine["item"].combine_chunks()
    items = item.unique()
    uses: dict[int, list[tuple[int, int]]] = {}
    for t, q, times in zip(term, pc.index_in(item, items).to_pylist(), mine["times"].to_pylist()):
        uses.setdefault(t, []).append((q, times))
    vocabulary = {t.encode(): i for t, i in numbers.items()}
    schema = T.StructType([thin.schema["id"], *T.StructType.fromDDL("n long, terms array<int>, counts array<long>").fields])
    posted = s.save(thin.mapInArrow(lambda b: _postings(b, vocabulary), schema), f"postings-{name}")
    n_docs, length = posted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = posted.select(F.explode("terms").alias("term")).groupBy("term").count()
    weights = Weights(n_docs, length, {r.term: r["count"] for r in df.collect()})  # a row a term of the vocabulary
    most: Counter = Counter()
    for t, each in uses.items():
        for q, times in each:
            most[q] += times * int(weights.of[t] if t < len(weights.of) else 0) * 1_000_000
    depth = max(1, max(most.values()).bit_length())
    rows = T.StructType([*T.StructType.fromDDL("block string, term int, places binary, slices binary").fields, T.StructField("docs", T.ArrayType(thin.schema["id"].dataType))])
    index = s.save(posted.mapInArrow(Indexer(weights), rows), f"index-{name}")
    searcher = Searcher(items, uses, depth, k)

    def search(table: pa.Table) -> pa.Table:
        return searcher.best(table)

    return index.groupBy("block").applyInArrow(search, out)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
q AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark) GROUP BY item_id, t),
c AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
p AS (SELECT r, doc_id, n, t, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY r, doc_id, n, t),
f AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, c GROUP BY t),
i AS (SELECT p.r, p.doc_id, p.t, f.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (100 - 75 + (75 * p.n * c.n_docs) // c.l))) AS v FROM p JOIN f ON p.t = f.t, c),
s AS (SELECT q.item_id, i.r, i.doc_id, CAST(sum(q.times * i.v) AS BIGINT) AS score FROM q JOIN i ON q.t = i.t GROUP BY q.item_id, i.r, i.doc_id),
k AS (SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10"""
