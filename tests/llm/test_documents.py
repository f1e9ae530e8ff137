"""Operators over document tables against brute force, on the smallest tables and on fixtures of odd rows."""

import collections
import hashlib
import re

import numpy as np
import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from orefold.llm import bpe, licenses, minhash, mixture, quality, spotsigs, token_shards
from orefold.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, words int, cut string, s string, i int, rep long"
WORDS = "the red fox of a quick hill runs over an old stone wall and sleeps in tall grass near water while birds sing to the moon at night"


def rows(*texts, source="src0"):
    """Documents 1, 2, ... with columns whose names the operators use, too."""
    return [(n + 1, t, "en", source, len(t or ""), 7, "k", 7, "c", "s", 1, 7) for n, t in enumerate(texts)]


@pytest.fixture(scope="module")
def odd(spark):
    """Null and empty texts, white space, ties, repeated rows, null ids and sources, a very long text, many copies."""
    long = " ".join(f"w{n}" for n in range(60_000)) + " " + "x" * 40_000
    got = rows(None, "", " \t\n", "one", WORDS, WORDS, WORDS.upper(), WORDS + " tail", "Ünï çödé 日本語 🙂", long, *[WORDS + " copy"] * 30)
    got += [got[4], (None, WORDS, None, None, None, None, None, None, None, None, None, None), (99, "lost words", None, None, 10, None, None, None, None, None, None, None)]
    return spark.createDataFrame(got, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


# --------------------------------------------------------------------------- 1

@pytest.mark.parametrize("size", [1, 2, 3, 16, 17, 1000])
def test_permutation_is_a_bijection(size):
    got = token_shards.permute(np.arange(size), size, key=5)
    assert sorted(got) == list(range(size))
    assert size < 1000 or (list(got) != list(token_shards.permute(np.arange(size), size, key=6)) and list(got) != sorted(got))


def test_shards_hold_all_texts(spark, odd, none, tmp_path):
    at = str(tmp_path / "stored")
    odd.write.parquet(at)
    stored = spark.read.parquet(at)
    folder = f"file://{tmp_path}/shards"
    made = token_shards.materialise(spark, stored, folder, length=512, in_shard=64).collect()
    ids, slots = {}, []
    for m in made:
        for n, (seq, data) in enumerate(token_shards.read_shard(folder, m.path, length=512)):
            ids[seq] = data
            slots.append((m.first_slot + n, seq))
    assert sorted(ids) == list(range(len(slots)))
    assert [s for s, _ in sorted(slots)] == list(range(len(slots)))
    assert {s for s, q in slots if token_shards.permute(np.array([q]), len(slots), 1)[0] != s} == set()
    texts = b"".join(ids[k] for k in sorted(ids)).split(bytes([token_shards.END]))[:-1]
    assert collections.Counter(t.decode() for t in texts) == collections.Counter(r.text or "" for r in stored.collect())
    m = made[0]
    whole = list(token_shards.read_shard(folder, m.path, length=512))
    assert list(token_shards.read_shard(folder, m.path, start=5, length=512)) == whole[5:]  # resumed
    assert token_shards.training_shards(spark, none).collect() == []


@pytest.mark.parametrize("width", [2, 4])
def test_shards_hold_token_ids(spark, odd, tmp_path, width):
    at, folder = str(tmp_path / "ids"), f"file://{tmp_path}/shards"
    bpe.encode_documents(odd, PATH, with_ids=True).write.parquet(at)
    stored, end = spark.read.parquet(at), 50_300 if width == 2 else 1 << 31
    form = {"length": 512, "width": width}
    made = token_shards.materialise(spark, stored, folder, in_shard=64, ids_col="ids", end=end, pad=end + 1, **form)
    ids = {seq: np.frombuffer(data, f"<u{width}") for m in made.collect() for seq, data in token_shards.read_shard(folder, m.path, **form)}
    assert sorted(ids) == list(range(len(ids))) and all(len(ids[k]) == 512 for k in list(sorted(ids))[:-1])
    run = np.concatenate([ids[k] for k in sorted(ids)])
    lists = [tuple(x[:-1].tolist()) for x in np.split(run, np.flatnonzero(run == end) + 1)[:-1]]
    assert collections.Counter(lists) == collections.Counter(tuple(r.ids) for r in stored.collect())
    assert collections.Counter(TOKENIZER.decode(list(x), skip_special_tokens=False) for x in lists) == collections.Counter(r.text or "" for r in odd.collect())
    back = token_shards.read_back(spark, made, folder, end=end, **form).collect()
    assert sum(r.n_tokens for r in back) == len(run) and sum(r.n_ends for r in back) == odd.count()
    assert stored.rdd.getNumPartitions() > 1  # all in one shard, too
    assert [m.records for m in token_shards.materialise(spark, stored, f"{folder}-1", ids_col="ids", end=end, pad=end + 1, **form).collect()] == [len(ids)]
    with pytest.raises(Exception, match="don't fit"):
        token_shards.materialise(spark, spark.createDataFrame([([1, 1 << 16],)], "ids array<int>"), folder, ids_col="ids", width=2, end=end % (1 << 16), pad=0).collect()


def test_ids_equal_the_tokenizer(spark, odd, none):
    for table, leaf in ((odd, bpe.LEAF), (odd, 256), (spark.createDataFrame(rows(*HARD), SCHEMA), bpe.LEAF)):
        want = collections.Counter(tuple(TOKENIZER.encode(r.text or "", add_special_tokens=False).ids) for r in table.collect())
        assert collections.Counter(tuple(r.ids) for r in bpe.encode_ids(table, PATH, leaf=leaf).collect()) == want
    assert bpe.encode_ids(none, PATH).collect() == []


def test_query_writes_the_tokenizer_s_ids(spark, docs):
    got = QUERIES["op1_token_shards"](spark, DATA).collect()
    assert sum(r.n_tokens for r in got) == sum(expected(r.text)[0] + 1 for r in docs.collect()) and sum(r.n_ends for r in got) == docs.count()
    assert {r.byte_offset % (token_shards.HEADER_BYTES + 2 * token_shards.LENGTH) for r in got} == {0}


# --------------------------------------------------------------------------- 2

def spots(text):
    anchors, words = set(spotsigs.ANCHORS.split()), [w for w in regex.split(r"[^\p{L}\p{N}]+", (text or "").lower()) if w]
    lines = ("^ " + "".join(w + (" " if w in anchors else "\n") for w in words)).split("\n")
    found = set()
    for n, x in enumerate(lines):
        if " " in x and not x.endswith(" "):
            found.add((*x.split(" ")[-2:], *[lines[n + k].split(" ")[-1] if n + k < len(lines) else None for k in range(1, spotsigs.CHAIN)]))
    return found or ({text} if text else set())


def jaccard(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def test_fingerprints_match_brute_force(docs):
    got = {r.doc_id: r for r in spotsigs.fingerprint_edits(docs).collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    order = sorted(texts, reverse=True)
    assert len(got) == len(texts)
    for n, i in enumerate(order):
        text, after = texts[i], texts[order[(n + 1) % len(order)]]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert got[i].near_edited == pytest.approx(jaccard(spots(text), spots(edited)))
        assert got[i].near_next == pytest.approx(jaccard(spots(text), spots(after)))
        assert len(got[i].fingerprint.split()) == len(spots(text))


def test_fingerprints_of_odd_rows(odd, none):
    got = spotsigs.fingerprint_edits(odd).collect()
    assert len(got) == odd.count() and spotsigs.fingerprint_edits(none).collect() == []
    assert {r.fingerprint for r in got if r.doc_id in (1, 2)} == {""}
    assert len({r.fingerprint for r in got if r.doc_id in (5, 6, None)}) == 1
    by_class = collections.defaultdict(set)
    for r in spotsigs.classes(odd).collect():
        by_class[r.class_id].add(r.doc_id)
    assert by_class[5] == {5, 6, 7, None} and by_class[11] == set(range(11, 41)) and by_class[1] == {1, 2}  # 3 is white space: its own signature


@pytest.mark.parametrize("rows_in_bucket", [1, 3, 500])
def test_next_rows_in_small_buckets(spark, rows_in_bucket):
    """Rows by id descending, with a third of one id and a third of no id, which are dealt by the hash."""
    rng = np.random.default_rng(rows_in_bucket)
    ids = [int(x) for x in rng.integers(-50, 10**12, 120)] + [77] * 120 + [None] * 120 + list(range(100))
    got = spotsigs.with_next(spark.createDataFrame([(i, f"t{n}") for n, i in enumerate(ids)], "id long, v string"), "id", ["v"], rows_in_bucket).selectExpr("id", "v", "next_v", "xxhash64(v) h").collect()
    order = sorted(got, key=lambda r: (r.id is None, -(r.id or 0), r.h))
    assert len(got) == len(ids) and [r.next_v for r in order] == [r.v for r in order[1:] + order[:1]]


def test_near_pairs_match_brute_force(spark):
    rng = np.random.default_rng(8)
    base = [[str(x) for x in rng.choice([f"w{n}" for n in range(300)] + ["the", "of", "and", "in"] * 30, 60)] for _ in range(12)]
    texts = {}
    for n in range(240):
        words = list(base[n % 12])[: rng.integers(20, 61)] if n % 3 else list(base[n % 12])
        for _ in range(rng.integers(0, 4)):
            words[rng.integers(0, len(words))] = f"w{rng.integers(0, 300)}"
        texts[n + 1] = " ".join(words)
    got = {(r.a, r.b): r.near for r in spotsigs.near_pairs(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    low, want = {}, {}
    for i, t in sorted(texts.items()):
        low.setdefault(frozenset(spots(t)), i)
    ids = sorted((i, s) for s, i in low.items())
    for n, (a, x) in enumerate(ids):
        for b, y in ids[n + 1:]:
            if jaccard(x, y) >= 0.8:
                want[a, b] = jaccard(x, y)
    assert len(want) > 20 and set(got) == set(want) and all(got[k] == pytest.approx(v) for k, v in want.items())


def test_fingerprints_cover_texts_without_anchors(spark, tmp_path):
    long = [f"q{n}" for n in range(80)]
    texts = [" ".join(long), " ".join(long[:40] + [f"z{n}" for n in range(40)]), "alpha beta gamma delta epsilon zeta", "alpha beta gamma eta theta iota", "the old fox " + " ".join(long), "alpha beta gamma delta", " ".join(["same"] * 50)]
    spark.createDataFrame(rows(*texts), SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: set(r.fingerprint.split()) for r in QUERIES["op2_spotsigs"](spark, str(tmp_path)).collect()}
    assert 0.2 < jaccard(got[1], got[2]) < 0.5 and jaccard(got[3], got[4]) < 0.5 and jaccard(got[1], got[5]) > 0.8
    words = [w.lower() for w in long]
    assert len(got[1]) >= len(words) // spotsigs.CHAIN and len(got[6]) == 2 and len(got[7]) <= 4  # a spot in every CHAIN words, the last ones too
    for n in range(0, 80, 7):  # each word counts
        other = spark.range(1).select(spotsigs.fingerprint(spotsigs.signatures(F.lit(" ".join(long[:n] + ["changed"] + long[n + 1:])), True))).first()[0]
        assert set(other.split()) != got[1] and jaccard(set(other.split()), got[1]) > 0.6


# --------------------------------------------------------------------------- 3

def sets_of(texts, width):
    out = {}
    for i, t in texts.items():
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        out[i] = {tuple(w[k: k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    return out


def lowest(sets, threshold):
    low = {i: i for i in sets}

    def root(i):
        while low[i] != i:
            i = low[i]
        return i
    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= threshold * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                low[y] = x
    return {i: root(i) for i in ids}


@pytest.mark.parametrize(("width", "threshold"), [(4, 80), (5, 80), (2, 90)])
def test_near_duplicates_match_brute_force(spark, width, threshold):
    rng = np.random.default_rng(3)
    base = [[f"v{x}" for x in rng.integers(0, 40, rng.integers(1, 60))] for _ in range(8)]
    texts = {}
    for n in range(160):  # chains of near copies around few texts, so that groups hold what isn't linked
        words = list(base[n % 8])
        for _ in range(rng.integers(0, 4)):
            words[rng.integers(0, len(words))] = f"v{rng.integers(0, 40)}"
        texts[n + 1] = " ".join(words)
    got = minhash.near_duplicates(spark, spark.createDataFrame(list(texts.items()), "doc_id long, text string"), width=width, threshold=threshold).collect()
    sets = sets_of(texts, width)
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(s) for i, s in sets.items()}
    assert {r.doc_id: r.component_id for r in got} == lowest(sets, threshold)


def test_near_duplicates_of_odd_rows(spark, odd, none):
    got = minhash.near_duplicates(spark, odd).collect()
    texts = {r.doc_id: r.text for r in odd.collect() if r.doc_id is not None}
    low = lowest(sets_of(texts, 4), 80)
    assert len(got) == odd.count()
    assert {(r.doc_id, r.component_id, r.kept) for r in got if r.doc_id is not None} == {(i, c, i == c) for i, c in low.items()}
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
    assert minhash.near_duplicates(spark, none).collect() == []
    kept = minhash.keep_one(spark, odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == sorted([0, *(i for i, c in lowest(sets_of(texts, 4), 80).items() if i == c)])


# --------------------------------------------------------------------------- 4

def filled(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda x: (x is None, x or ""))
    w = {x: weights[n % len(weights)] for n, x in enumerate(names)}
    out, free, rest = {}, set(names), share * sum(sizes.values())
    while free:
        level = rest / sum(w[x] for x in free)
        over = {x for x in free if w[x] * level > most * sizes[x]}
        if not over:
            return out | {x: w[x] * level for x in free}
        for x in over:
            out[x] = most * sizes[x]
            rest -= out[x]
        free -= over
    return out


def test_mix_matches_brute_force(spark, docs, odd):
    for table in (docs, odd):
        got = mixture.mix_report(spark, table).collect()
        sizes = collections.Counter()
        for r in table.collect():
            sizes[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        goals = filled(dict(sizes))
        taken = collections.Counter()
        assert len(got) == table.count()
        for r in got:
            assert r.target == pytest.approx(goals[r.source]) and r.source_size == sizes[r.source] and 0 <= r.taken <= 2 * r.size
            taken[r.source] += r.taken
        if table is docs:
            assert all(abs(taken[x] - goals[x]) <= 1 for x in goals)
            assert sorted(map(str, got)) == sorted(map(str, mixture.mix_report(spark, table.repartition(5)).collect()))
        first = [r.first_position for r in got if r.taken]
        assert first == sorted(first)


def test_mixed_documents(spark, odd, none):
    got = mixture.mixed_documents(odd)
    assert got.columns == odd.columns and mixture.mixed_documents(none).collect() == []
    by_id = {r.doc_id: r.text for r in odd.collect()}
    taken = {}
    for r in got.collect():
        assert by_id[r.doc_id].startswith(r.text.rstrip()) and r.n_chars == len(r.text) and (r.doc_id in (None, 99) or (r.cut, r.s, r.i) == ("c", "s", 1))
        taken[r.source] = taken.get(r.source, 0) + len(r.text.split())
    order = [r.doc_id for r in mixture.training_order(odd).collect()]
    assert [r.doc_id for r in got.collect()] == order
    report = collections.Counter()
    for r in mixture.mix(odd).collect():
        report[r.source] += r.taken
    assert taken == {k: v for k, v in report.items() if v}


def test_positions_invert_demand(spark):
    for slope in (0.5, -0.5, 0.0):
        for start in (0, 10, 55, 100):
            t = spark.range(1).select(mixture.position(F.lit(start), F.lit(100.0), slope)).first()[0]
            assert 100 * ((1 - slope) * t + slope * t * t) == pytest.approx(start, abs=1e-9)


# --------------------------------------------------------------------------- 5

def test_licenses_are_found(spark, odd, none):
    mit = licenses.TEMPLATES["MIT"]
    some = mit.split()
    cut = " ".join(w for n, w in enumerate(some) if n % 12)  # a twelfth of the words is lost
    more = " ".join(w + " inserted" * (n % 20 == 19) for n, w in enumerate(some))
    texts = rows("prose before. " + mit + " and after", "x " * 5000 + cut, licenses.TEMPLATES["Unlicense"] + " " + mit, WORDS, None, "Released under the MIT Licence terms", "Released under the MIT License. " * 2, more)
    got = licenses.scan(spark.createDataFrame(texts, SCHEMA)).collect()
    found = {(r.doc_id, r.license): r for r in got}
    assert {(1, "MIT"), (2, "MIT"), (3, "MIT"), (3, "Unlicense"), (6, "MIT-notice"), (7, "MIT-notice"), (8, "MIT")} == set(found)
    assert found[1, "MIT"].coverage == 1.0 and found[1, "MIT"].first_word == 2 and len(found[1, "MIT"].spans) == 1
    assert 0.9 <= found[2, "MIT"].coverage < 0.93 and found[2, "MIT"].first_word == 5000 and len(found[2, "MIT"].spans) == 1
    assert found[8, "MIT"].coverage == 1.0 and len(found[8, "MIT"].spans) == 9
    assert [(r.first_word, r.last_word) for r in sorted(got) if r.doc_id == 7] == [(0, 4), (5, 9)]
    assert licenses.scan(odd).collect() == [] and licenses.scan(none).collect() == []


def test_licenses_with_inserted_changed_and_split_words(spark):
    mit = licenses.TEMPLATES["MIT"].split()
    strange = [f"q{n}" for n in range(60)]
    quarter = " ".join("other" if n % 4 == 3 else w for n, w in enumerate(licenses.TEMPLATES["ISC"].split()))
    apache = "Licensed under the very permissive Apache License, Version 2.0."
    texts = rows("Released under the terms of the MIT License", "Released under a MIT License", apache, " ".join(mit[:80] + strange + mit[80:]), quarter,
                 "Released under the terms of the MIT License. " * 3, "Released under the old rules, as the fox and the hill", " ".join(mit[:80] + strange), WORDS + " under the MIT rules")
    got = licenses.scan(spark.createDataFrame(texts, SCHEMA)).collect()
    found = {(r.doc_id, r.license): r for r in got}
    assert {(1, "MIT-notice"), (2, "MIT-notice"), (3, "Apache-2.0-notice"), (4, "MIT"), (5, "ISC"), (6, "MIT-notice")} == set(found)
    assert found[1, "MIT-notice"].coverage == 1.0 and (found[1, "MIT-notice"].first_word, found[1, "MIT-notice"].last_word) == (0, 7)
    assert found[2, "MIT-notice"].coverage == 0.8 and found[3, "Apache-2.0-notice"].coverage == 1.0
    assert found[4, "MIT"].coverage == 1.0 and len(found[4, "MIT"].spans) == 2
    assert [(r.first_word, r.last_word) for r in sorted(got) if r.doc_id == 6] == [(0, 7), (8, 15), (16, 23)]


# --------------------------------------------------------------------------- 6

def test_licences_winnow_and_align_as_plain_loops_do():
    """Each window's least run is kept; banded alignments are as long as the longest common subsequence within the band."""
    rng = np.random.default_rng(3)
    for n in (0, 1, 3, 4, 5, 60):
        runs = rng.integers(0, 9, size=n).astype(np.uint64)
        w = min(4, n)
        want = {max(range(i, i + w), key=lambda p: (-int(runs[p]), p)) for i in range(n - w + 1)} if n else set()  # noqa: B023
        assert set(licenses.winnow(runs, 4).tolist()) == want
    names, words, lists = licenses.index(tuple(licenses.TEMPLATES.items()))
    kept = sum(len(x[0]) for x in lists.values())
    every = sum(max(0, len(w) - (licenses.RUN if len(w) >= licenses.SHORT else licenses.SHORT_RUN) + 1) for w in words)
    assert kept < 0.65 * every and all(len(w) < licenses.SHORT or sum(x[1].tolist().count(i) for x in lists.values()) >= (len(w) - 2) // 4 for i, w in enumerate(words))
    for _ in range(60):
        template = rng.integers(0, 6, size=rng.integers(1, 25)).astype(np.uint64)
        text = rng.integers(0, 6, size=rng.integers(1, 25)).astype(np.uint64)
        offset, band = int(rng.integers(-3, 4)), int(rng.integers(1, 8))
        best = np.zeros((len(template) + 1, len(text) + 1), int)
        for i in range(1, len(template) + 1):
            for j in range(1, len(text) + 1):
                hit = template[i - 1] == text[j - 1] and abs(j - 1 - (i - 1 + offset)) <= band
                best[i, j] = max(best[i - 1, j], best[i, j - 1], best[i - 1, j - 1] + 1 if hit else 0)
        pairs = licenses.align(text, template, offset, band)
        assert all(template[q] == text[p] and abs(p - q - offset) <= band for p, q in pairs)
        assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(pairs, pairs[1:])) and len(pairs) == best[-1, -1]


def test_quality_on_held_out_rows(spark):
    big = DATA.replace("0.001", "0.01")
    table, labels = (spark.read.parquet(f"{big}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.score(spark, table, quality.fit(spark, table, labels)).join(labels, "doc_id").where("held_out and quality is not null").collect()
    good, bad = [r.score for r in got if r.quality == 1], [r.score for r in got if r.quality == 0]
    ranked = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert ranked > 0.9 and np.mean([(r.score >= 0.5) == r.quality for r in got]) > 0.85
    assert all(r.predicted == (r.score >= 0.7) for r in got)


def test_contexts_match_brute_force():
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, 50, n) for n in (0, 1, 2, 3, 40, 0, 70_000)]
    index, want = quality.index_vectors(), np.zeros((quality.SLOTS, quality.DIM), np.int64)
    for t in texts:
        for d in (1, 2):
            if len(t) > d:
                np.add.at(want, t[d:], index[t[:-d]])
                np.add.at(want, t[:-d], index[t[d:]])
    seen, total = quality.contexts([(np.concatenate(texts), np.cumsum([0, *map(len, texts)]))])
    assert (total == want).all() and seen.sum() == sum(map(len, texts))


def test_quality_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(n, n % 2, 0) for n in range(1, 41)] + [(None, 1, 0), (5, None, 0), (5, 3, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(spark, odd, labels)
    got = quality.score(spark, odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1 and len({r.score for r in got if r.doc_id in (5, 6)}) == 1
    assert quality.score(spark, none, model).collect() == [] and quality.accepted(spark, odd, model).columns == odd.columns
    assert quality.fit(spark, odd, labels.where("quality = 1")) is None and quality.accepted(spark, odd, None).count() == odd.count()


# --------------------------------------------------------------------------- 9

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)
TOKENIZER.no_truncation()
TOKENIZER.no_padding()
HARD = ["", " ", "\n\n  \t", "a" * 3001, "ab" * 2000 + "1" * 999, "don't we'll I'd ''s", "🙂" * 300, "é" * 700, "日本語" * 400, "x<|endoftext|>y", "<|endoftext|>" * 50, "  a  b   c", "1234567890" * 100, "word " * 500, "!?" * 900, "'" * 700 + "s", "a" + " " * 500 + "b" + "\n" * 300 + "<|endoftext|>" + " " * 90, "'s" * 300, "' " * 300, "''t!" * 150, "''ll 'x" * 80, " \n" * 200 + "!", "''<|endoftext|>'s" * 20, "  's" * 90, "''  d" * 90, "''1'd" * 40, "''🙂're" * 60, "\t'm " * 90, "　 \xa0a", "á" * 300, "\x00\x01"]


def expected(text):
    ids = TOKENIZER.encode(text or "", add_special_tokens=False).ids
    return len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(TOKENIZER.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_equals_the_tokenizer(docs, odd, none):
    for table in (docs, odd):
        want = collections.Counter((r.doc_id, *expected(r.text)) for r in table.collect())
        assert collections.Counter(tuple(r) for r in bpe.encode_documents(table, PATH).collect()) == want
    assert bpe.encode_documents(none, PATH).collect() == []


@pytest.mark.parametrize("text", ["word " * 20_000 + " " * 1_500_000 + "then words " * 20_000, " " * 2_000_000 + "a", "\n" * 2_000_000, "!" * 2_000_000, "'" * 400_001 + "s" + "'s" * 300_000, " \n\t" * 700_000 + "<|endoftext|>x", "a" * 1_200_001, "' " * 600_000],
                         ids=["words and spaces", "spaces", "lines", "marks", "apostrophes", "mixed space", "letters", "alternating"])
def test_bpe_of_very_long_runs(spark, text):
    got = bpe.encode_documents(spark.createDataFrame([(1, text)], "doc_id long, text string"), PATH).collect()
    assert [tuple(r) for r in got] == [(1, *expected(text))]


@pytest.mark.parametrize("leaf", [16, 97, 256])
def test_bpe_trees_equal_the_tokenizer(spark, leaf):
    enc = bpe.load(PATH)
    rng = np.random.default_rng(leaf)
    mixed = ["".join(rng.choice(list("ab c1'é!\n日"), 400)) for _ in range(20)] + ["".join(rng.choice(list("etaoin"), 900)) for _ in range(20)]
    for text in HARD + mixed:
        assert bpe.encode_tree(enc, text, leaf) == TOKENIZER.encode(text, add_special_tokens=False).ids
    table = spark.createDataFrame(rows(*HARD), SCHEMA)
    assert {tuple(r) for r in bpe.encode_documents(table, PATH, leaf=leaf).collect()} == {(n + 1, *expected(t)) for n, t in enumerate(HARD)}
