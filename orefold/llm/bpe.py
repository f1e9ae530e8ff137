"""Byte-level BPE encoding and decoding by tree concatenation (operator 9)."""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orefold.llm.common import text_batches

#: Code points above which a text is cut in leaves that are encoded apart.
LEAF = 1 << 15
#: The pattern of byte-level pre-tokenization, and the printable stand-ins of bytes in vocabulary files
#: (the bytes of these ranges stand for themselves, the others for the code points from 256 on, in order).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PRINTABLE = ((33, 126), (161, 172), (174, 255))

_CLASSES = (regex.compile(r"\p{L}"), regex.compile(r"\p{N}"), regex.compile(r"\s"))
_SHORTENED = regex.compile(r"'(?:s|t|re|ve|m|ll|d)")
#: White space of so many characters is cut out as a pre-token by itself, before the pattern's look-ahead would step back through it.
_LONG_SPACE = regex.compile(r"\s{4096,}")


@lru_cache(maxsize=4)
def load(path: str) -> tiktoken.Encoding:
    """The encoding of a byte-level tokenizer file (JSON, merges in rank order, added tokens as special ones)."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    plain = [b for lo, hi in PRINTABLE for b in range(lo, hi + 1)]
    stand = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(stand[c] for c in w): i for w, i in spec["model"]["vocab"].items() if w not in special}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


@lru_cache(maxsize=4)
def _one_token(path: str) -> tiktoken.Encoding:
    """The encoding of a pre-token, whatever is in it."""
    return tiktoken.Encoding(f"{path}:pre-token", pat_str=r"(?s:.+)", mergeable_ranks=load(path)._mergeable_ranks, special_tokens={})


def vocabulary(ranks: dict[bytes, int]) -> list[str]:
    """Rank-file lines (base64 and id) of a vocabulary, for tools that read that format."""
    return [f"{base64.b64encode(b).decode()} {i}" for b, i in sorted(ranks.items(), key=lambda x: x[1])]


def _kind(c: str) -> int:
    return next((i for i, p in enumerate(_CLASSES) if p.match(c)), 3)


def cut_near(text: str, middle: int, specials: tuple[str, ...]) -> tuple[int, bool] | None:
    """Where to cut a text near its middle, and whether the parts encode independently there.

    A cut after a letter or digit, or after punctuation (an apostrophe only before white space), where the next code point is of another class,
    ends a pre-token for certain. Inside a run of one class the parts belong to one pre-token and have to be joined
    by windows: a run of white space is cut before its last two code points, and other punctuation not where the right part
    would begin like a shortened word. None: no cut of either kind.
    """
    margin = max((len(x) for x in specials), default=0)
    whole = lambda p: not any(x in text[max(0, p - len(x) + 1): p + len(x) - 1] for x in specials)
    inside = None
    for d in range(max(1, len(text) // 2)):
        for p in (middle - d, middle + d):
            if not margin < p < len(text) - margin:
                continue
            a, b = _kind(text[p - 1]), _kind(text[p])
            if a != b and a != 2 and (text[p - 1] != "'" or b == 2) and whole(p):
                return p, True
            if inside is None and a == b and whole(p) and (a < 2 or (a == 2 and (p + 1 == len(text) or _kind(text[p + 1]) == 2)) or (a == 3 and not _SHORTENED.match(text, p))):
                inside = p
        if inside is not None and d >= 4096:
            break
    return (inside, False) if inside is not None else None


def leaves(text: str, specials: tuple[str, ...], limit: int = LEAF) -> list[tuple[str, bool]]:
    """A text cut in halves until none is above ``limit`` (but where no cut is): (part, it stands apart from the one before)."""
    done, stack = [], [(text, True)]
    while stack:
        part, apart = stack.pop()
        at = cut_near(part, len(part) // 2, specials) if len(part) > limit else None
        if at is None:
            done.append((part, apart))
        else:
            stack += [(part[at[0]:], at[1]), (part[: at[0]], apart)]
    return done


def encode(enc: tiktoken.Encoding, text: str) -> list[int]:
    """The ids of a text. Long white space is encoded as the pre-token that it is: without its last code point where other text follows."""
    if len(text) < 4096 or not _LONG_SPACE.search(text):
        return enc.encode(text, allowed_special="all")
    out, at = [], 0
    for m in _LONG_SPACE.finditer(text):
        closed = m.end() == len(text) or any(text.startswith(x, m.end()) for x in enc.special_tokens_set)
        end = m.end() if closed else m.end() - 1
        out += enc.encode(text[at: m.start()], allowed_special="all") + _one_token(enc.name).encode_ordinary(text[m.start(): end])
        at = end
    return out + enc.encode(text[at:], allowed_special="all")


def join(enc: tiktoken.Encoding, left: list[int], right: list[int]) -> list[int]:
    """The ids of the joined text, from the ids of two parts of one run of letters, digits, white space or punctuation.

    The tokens around the join are decoded and encoded again, in a window that doubles until the new ids start with
    the window's first left id and end with its last right id; a side that the window covers whole needs no agreement.
    Agreeing neighbours are merged nowhere else, since a byte-pair encoding is right when each neighbouring pair is.
    """
    size = 8
    while True:
        a, b = left[-size:], right[:size]
        raw = enc.decode_bytes(a + b)
        try:
            new = encode(enc, raw.decode("utf-8"))
        except UnicodeDecodeError:  # the window starts or ends inside a code point
            new = []
        ends = len(a) == len(left), len(b) == len(right)
        if new and (ends[0] or new[:2] == a[:2]) and (ends[1] or new[-2:] == b[-2:]):
            return left[: len(left) - len(a)] + new + right[len(b):]
        if all(ends):
            return encode(enc, enc.decode(left + right))
        size *= 2


def join_all(enc: tiktoken.Encoding, level: list[list[int]]) -> list[int]:
    """The ids of a run from those of its parts, in order, joined pairwise in a tree."""
    while len(level) > 1:
        level = [join(enc, x, y) for x, y in zip(level[::2], level[1::2])] + level[len(level) // 2 * 2:]
    return level[0]


def runs_of(enc: tiktoken.Encoding, parts: Iterator[tuple[list[int], bool]]) -> Iterator[list[int]]:
    """The ids of successive runs that encode independently, from leaves (ids, it stands apart from the one before)."""
    held: list[list[int]] = []
    for ids, apart in parts:
        if apart and held:
            yield join_all(enc, held)
            held = []
        held.append(ids)
    if held:
        yield join_all(enc, held)


def encode_tree(enc: tiktoken.Encoding, text: str, limit: int = LEAF) -> list[int]:
    """The ids of a whole text by its leaves, joined pairwise; the same as encoding it at once."""
    specials = tuple(enc.special_tokens_set)
    return [i for run in runs_of(enc, ((encode(enc, part), apart) for part, apart in leaves(text, specials, limit))) for i in run]


def _digest(parts: Iterator[list[int]], enc: tiktoken.Encoding) -> tuple[int, str, str]:
    """Count of ids, SHA-256 of the ids as little-endian 32-bit integers, SHA-256 of the decoded text."""
    n, of_ids, of_text, rest = 0, hashlib.sha256(), hashlib.sha256(), b""
    for ids in parts:
        n += len(ids)
        of_ids.update(np.asarray(ids, dtype="<u4").tobytes())
        of_text.update(enc.decode_bytes(ids))  # parts end where texts do: between code points
    return n, of_ids.hexdigest(), of_text.hexdigest()


def encode_ids(docs: DataFrame, path: str, text_col: str = "text", *, leaf: int = LEAF) -> DataFrame:
    """(ids) for each row of ``docs``: the ids of encode_documents, without digests of short texts."""
    src = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = load(path)
        for whole in batches:
            for batch in text_batches(whole, "text"):
                found = [enc.encode_to_numpy(t, allowed_special="all") for t in batch.column(0).to_pylist()]
                ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found).astype(np.int32)))], names=["ids"])

    longs = encode_documents(src.where(F.length("text") > leaf).select(F.lit(None).cast("long").alias("doc_id"), "text"), path, leaf=leaf, with_ids=True)
    return src.where(F.length("text") <= leaf).mapInArrow(run, "ids array<int>").union(longs.select("ids"))


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", *, leaf: int = LEAF, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]) for each row of ``docs``; null and empty texts have no tokens.

    Texts up to ``leaf`` code points are encoded where they are read, without a shuffle. Longer ones become leaf rows,
    dealt to all tasks and encoded apart; the leaves of one text then meet again, in order, to be joined pairwise and digested run by run.
    Repeated rows and repeated ids each give their row; a null id stays null. Extra columns are not read. ``path`` must be readable
    where tasks run, as the installed vocabulary package is.
    """
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    is_long = F.length("text") > leaf

    def row(out: dict[str, list], key: int | None, parts: Iterable[list[int]], enc: tiktoken.Encoding) -> None:
        parts = list(parts) if with_ids else parts  # digests need one run at a time
        for name, v in zip(names, (key, *_digest(iter(parts), enc), [i for p in parts for i in p] if with_ids else None)):
            out[name].append(v)

    def batch_of(out: dict[str, list]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array(out[n], k) for n, k in zip(names, kinds)], names=names)

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = load(path)
        for whole in batches:
            for batch in text_batches(whole, "text"):
                out: dict[str, list] = {n: [] for n in names}
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    row(out, key, [encode(enc, text)], enc)
                yield batch_of(out)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        specials = tuple(load(path).special_tokens_set)
        for whole in batches:
            for batch in text_batches(whole, "text", 1):
                (key, uid, text), = zip(*(c.to_pylist() for c in batch.columns))
                for i, (part, apart) in enumerate(leaves(text, specials, leaf)):
                    yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([uid], pa.string()), pa.array([i], pa.int32()), pa.array([apart]), pa.array([part])], names=["id", "uid", "leaf", "apart", "text"])

    def encode_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, squeeze = load(path), zstandard.ZstdCompressor(level=3).compress
        for whole in batches:
            for batch in text_batches(whole, "text", 1 << 20):
                ids = [squeeze(np.asarray(encode(enc, t), dtype="<u4").tobytes()) for t in batch.column(4).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(ids, pa.binary())], names=["id", "uid", "leaf", "apart", "ids"])

    def whole_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, unpack = load(path), zstandard.ZstdDecompressor().decompress
        found = ((k, u, apart, unpack(raw)) for batch in batches for k, u, apart, raw in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4))))
        for (key, _), mine in groupby(found, lambda r: (r[0], r[1])):
            out: dict[str, list] = {n: [] for n in names}
            row(out, key, runs_of(enc, ((np.frombuffer(raw, dtype="<u4").tolist(), apart) for _, _, apart, raw in mine)), enc)
            yield batch_of(out)

    longs = src.where(is_long).select("id", F.concat_ws("-", F.coalesce(F.col("id").cast("string"), F.lit("null")), F.monotonically_increasing_id().cast("string")).alias("uid"), "text")
    found = longs.mapInArrow(cut, "id long, uid string, leaf int, apart boolean, text string")
    found = found.repartition("uid", "leaf").mapInArrow(encode_leaves, "id long, uid string, leaf int, apart boolean, ids binary")
    found = found.repartition("uid").sortWithinPartitions("uid", "leaf").mapInArrow(whole_again, schema)
    return src.where(~is_long).mapInArrow(short, schema).union(found)
