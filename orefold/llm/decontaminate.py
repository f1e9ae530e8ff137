"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all benchmark items (operator 12)."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orefold.llm.common import Scratch, text_batches, text_bytes
from orefold.llm.files import open_store

#: Bytes of windows in one automaton, which takes some fifty times as much memory. A larger benchmark becomes several automata.
BLOCK_BYTES = 4 << 20

#: What becomes of each byte: A-Z small, other ASCII but digits and letters a space, and bytes of other characters stay.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def word_lists(column: pa.Array) -> Iterator[list[bytes]]:
    """The words of each whole text of a column: runs of digits, letters (A-Z lower-cased) and characters beyond ASCII. Null has none."""
    raw, at = text_bytes(column)
    for a, b in zip(at[:-1], at[1:]):
        yield raw[a:b].tobytes().translate(PLAIN).split()


def _windows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """(window, item): runs of ``width`` words of each item, or all of a shorter one, words joined by spaces."""
    for batch in batches:
        for part in text_batches(batch, "text"):
            found, items = [], []
            for words, item in zip(word_lists(part.column(0)), part.column(1).to_pylist()):
                runs = {b" ".join(words[i: i + width]) for i in range(max(1, len(words) - width + 1))} if words else ()
                found.extend(r.decode() for r in runs)
                items.extend([item] * len(runs))
                if len(found) > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(items, pa.string())], names=["window", "item"])
                    found, items = [], []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(items, pa.string())], names=["window", "item"])


def _word_places(text: str) -> list[tuple[int, int]]:
    """Where each word of the text starts and ends, in code points of the original."""
    raw = text.encode()
    word = np.frombuffer(raw.translate(PLAIN), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.r_[False, word, False].astype(np.int8)))
    chars = np.r_[0, np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)]
    return list(zip(chars[edges[::2]].tolist(), chars[edges[1::2]].tolist()))


class Scanner:
    """Scans texts with the automata of the window files; an automaton's letters are the bytes of normalised UTF-8 text."""

    _held: dict[str, ahocorasick.Automaton] = {}

    def __init__(self, files: list[str]):
        self.files = files

    def _automaton(self, file: str) -> ahocorasick.Automaton:
        """The file's automaton, read once by a Python worker; of several files the last read one is kept."""
        if file not in self._held:
            store, path = open_store(file)
            with store.open_input_file(path) as f:
                table = pq.read_table(f)
            items: dict[str, list] = {}
            for window, item in zip(table["window"].to_pylist(), table["item"].to_pylist()):
                items.setdefault(window, []).append(item)
            made = ahocorasick.Automaton()
            for window, ids in items.items():
                letters = f" {window} ".encode().decode("latin-1")
                made.add_word(letters, (len(letters), ids))
            made.make_automaton()
            self._held.clear()
            self._held[file] = made
        return self._held[file]

    def scan(self, texts: pa.Array) -> Iterator[tuple[int, list[tuple[int, int]], set]]:
        """For each text its number of words, the runs of words (first, behind last) that windows cover, and the items found."""
        lists = [(len(w), (b" " + b" ".join(w) + b" ").decode("latin-1")) for w in word_lists(texts)]
        hits: list[list[tuple[int, int]]] = [[] for _ in lists]
        items: list[set] = [set() for _ in lists]
        for file in self.files:
            automaton = self._automaton(file)
            if not len(automaton):
                continue
            for (_, letters), spans, found in zip(lists, hits, items):
                for end, (length, ids) in automaton.iter(letters):
                    spans.append((end - length + 1, end))
                    found.update(ids)
        for (n, letters), spans, found in zip(lists, hits, items):
            runs, at, word = [], 0, -1  # word: how many words start before letters[at]
            for start, end in sorted(spans):
                if runs and start <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], end)
                else:
                    runs.append([start, end])
            covered = []
            for start, end in runs:
                word += letters.count(" ", at, start + 1)
                n_words = letters.count(" ", start + 1, end + 1)
                covered.append((word, word + n_words))
                word, at = word + n_words, end + 1
            yield n, covered, found - {None}

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
        for batch in batches:
            for part in text_batches(batch, "text"):
                n_words, n_hit, found, spans = [], [], [], []
                for i, (n, covered, items) in enumerate(self.scan(part.column(0))):
                    n_words.append(n)
                    n_hit.append(sum(b - a for a, b in covered))
                    found.append(sorted(items))
                    places = _word_places(part.column(0)[i].as_py()) if covered else []
                    spans.append([{"start": places[a][0], "end": places[b - 1][1]} for a, b in covered])
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(found, pa.list_(pa.string())), pa.array(spans, pa.list_(span))], names=["id", "n_words", "n_hit", "items", "spans"])


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", *, width: int = 10) -> DataFrame:
    """(id, n_words, n_hit, items, spans): which benchmark items stand in each whole text, and where.

    A window is ``width`` consecutive words of an item; an item of fewer words is one window. Words inside any
    occurrence of a window are hit. ``items`` are the ids of the items found, sorted as strings; ``spans`` the covered
    stretches in code points of the original text, touching ones joined. The documents are read once and never shuffled;
    the windows are written to the shared folder in files of about BLOCK_BYTES, one automaton each, however large the
    benchmark is, and a window that many items share is dealt over them.

    Null and empty texts have no words and no hits; items without words are never found, and those of a null id hit
    words but are in no list. Repeated item ids count as one item; repeated rows of documents are rows of their own.
    An empty benchmark hits nothing. Very long texts are scanned whole, one at a time. Other columns are not read.
    """
    texts = benchmark.select(F.col(item_text_col).cast("string").alias("text"), F.col(item_col).cast("string").alias("item"))
    windows = texts.mapInArrow(lambda b: _windows(b, width), "window string, item string").distinct()
    size = windows.agg(F.sum(F.octet_length("window") + 2)).first()[0] or 0
    files = sorted(Scratch(spark, "windows").save(windows.repartition(max(1, -(-size // BLOCK_BYTES))), "blocks").inputFiles())
    thin = docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("id"))
    struct = "array<struct<start:int,end:int>>"
    schema = T.StructType([T.StructField("id", thin.schema["id"].dataType), *T.StructType.fromDDL(f"n_words long, n_hit long, items array<string>, spans {struct}").fields])
    return thin.mapInArrow(Scanner(files), schema).withColumnRenamed("id", id_col)


def report(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``contaminated`` with the number and a digest of the items instead of their list."""
    found = contaminated(spark, docs, benchmark, id_col)
    return found.select(id_col, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
k AS (SELECT DISTINCT item, least(len(w), 10) AS n, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: array_to_string(w[i:i + 9], ' '))) AS t FROM b WHERE len(w) > 0),
n AS (SELECT DISTINCT n FROM k),
p AS (SELECT d.r, n.n, unnest(range(1, len(d.w) - n.n + 2)) AS i, d.w FROM d, n WHERE len(d.w) >= n.n),
h AS (SELECT p.r, p.i, p.n, k.item FROM p JOIN k ON k.n = p.n AND array_to_string(p.w[p.i:p.i + p.n - 1], ' ') = k.t),
hit AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM h) GROUP BY r),
found AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h WHERE item IS NOT NULL) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(hit.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(found.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(found.items, '')) AS items_sha256, coalesce(hit.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON hit.r = d.r LEFT JOIN found ON found.r = d.r"""
