"""Vector codes, decontamination and lexical search against brute force written from the definitions, and on odd rows."""

import hashlib
import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from orefold.llm import decontaminate, lexical, vector_codes
from orefold.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_decontaminate", "op13_lexical"])
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df, rel = QUERIES[name](spark, DATA), con.sql(ORACLES[name])
    names = sorted(df.columns)
    assert sorted(rel.columns) == names
    want = [tuple(r[rel.columns.index(c)] for c in names) for r in rel.fetchall()]
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(want) and want


# --------------------------------------------------------------------------- 11

def codes_by_hand(rows, parts=8, size=16, rounds=6, scale=4096):
    """(id, code, error, label error, digest) in Python integers, one vector and one entry at a time."""
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = -(-max((len(v) for _, v, _ in kept), default=0) // parts)
    cut = []
    for _, v, _ in kept:
        x = [math.floor(scale * c) for c in v] + [0] * (width * parts - len(v))
        cut.append([x[p * width:(p + 1) * width] for p in range(parts)])
    books = [[list(c[p]) for c in cut[:size]] for p in range(parts)]

    def best(part, book):
        d = [sum((a - b) ** 2 for a, b in zip(part, e)) for e in book]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for c in cut:
                members.setdefault(best(c[p], books[p])[0], []).append(c[p])
            for k, m in members.items():
                books[p][k] = [sum(x) // len(m) for x in zip(*m)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out = []
    for (i, _, label), c in zip(kept, cut):
        found = [best(c[p], books[p]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for k, _ in found), sum(d for _, d in found), label))
    sums = Counter()
    for _, _, e, label in out:
        sums[label] += e
    return Counter((i, code, e, sums[label], sha) for i, code, e, label in out)


@pytest.mark.parametrize("width", [16, 13])
def test_codes_match_brute_force(spark, width):
    rng = np.random.default_rng(width)
    rows = [(int(n), [float(np.float32(x)) for x in rng.normal(size=width) * 2.0 ** (n % 5)], n % 3 if n % 7 else None) for n in range(200)]
    rows += [rows[3], (3, rows[9][1], 1), (None, rows[4][1], 0), (900, None, 1), (901, [None] * width, 1), (902, [float("nan")] + [0.0] * (width - 1), 2), (903, [float("-inf")] * width, 2), (904, [], 1), (905, [-0.00001] * (width - 2), None), (906, [0.0] * width, 2)]
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], "vec_id long, embedding array<float>, label int, code string, vector int").repartition(5)
    got = vector_codes.compress(spark, df).collect()
    assert Counter((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got) == codes_by_hand(rows)
    assert {r.code for r in got if r.vec_id == 3} and len([r for r in got if r.vec_id == 3]) == 3


def test_codes_of_few_and_no_vectors(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "AT_ONCE", 40)
    rows = [(n, [float(n)] * 8, 0) for n in range(5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert Counter(map(tuple, vector_codes.compress(spark, df).collect())) == codes_by_hand(rows)
    assert vector_codes.compress(spark, df.limit(0)).collect() == []
    assert vector_codes.compress(spark, df.withColumn("embedding", F.lit(None).cast("array<double>"))).collect() == []
    with pytest.raises(Exception, match="would not fit"):
        vector_codes.compress(spark, spark.createDataFrame([(1, [1e30] * 8, 0)], df.schema)).collect()


def test_nearest_takes_the_first_of_equals():
    at, d = vector_codes.nearest(np.array([[0, 0], [4, 4]]), np.array([[1, 0], [0, 1], [4, 4], [4, 4]]))
    assert at.tolist() == [0, 2] and d.tolist() == [1, 0]


# --------------------------------------------------------------------------- 12

def contaminated_by_hand(docs, items, width=10):
    """(id, words, hit words, item ids) by looking for every window at every place."""
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    windows = {}
    for item, t in items:
        w = words(t)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[i:i + width]), set()).add(item)
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for run, ids in windows.items():
            for at in range(len(w) - len(run) + 1):
                if tuple(w[at:at + len(run)]) == run:
                    hit |= set(range(at, at + len(run)))
                    found |= ids
        out.append((i, len(w), len(hit), tuple(sorted(str(x) for x in found if x is not None))))
    return Counter(out)


ITEMS = [(1, "one two three four five six seven eight nine ten eleven twelve"), (2, "Short, item!"), (10, "short item"), (3, "one two three four five six seven eight nine ten"), (4, None), (5, "..."),
         (None, "hidden words"), (6, "äÖ ñandú straße Ⅷ"), (7, "a a a a a a a a a a a"), (2, "another text of the same id")]
DOCS = [(1, "He said: ONE two-three four five six\tseven eight nine ten, eleven. Short item"), (2, None), (3, ""), (4, "a " * 40), (5, "ones two three four five six seven eight nine ten"), (6, "xshort item shortx item short itemx"),
        (7, "(äÖ ñandú straße Ⅷ) hidden words; another text of the same id… more"), (8, "ÄÖ ñandú straße Ⅷ"), (1, "short item short item"), (None, "short\x00item"), (9, "filler words " * 30_000 + "short item" + " and more" * 30_000),
        (10, "eleven twelve one two three four five six seven eight nine ten eleven twelve"), (11, "SHORT item short İtem short Kitem")]


@pytest.mark.parametrize("block", [4 << 20, 60])
def test_contaminated_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    docs = spark.createDataFrame([(*r, 0, "x") for r in DOCS], "doc_id long, text string, item int, id string").repartition(3)
    items = spark.createDataFrame([(*r, 1) for r in ITEMS], "item_id long, text string, doc_id int")
    got = decontaminate.contaminated(spark, docs, items).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got) == contaminated_by_hand(DOCS, ITEMS)
    texts = {r[0]: r[1] for r in DOCS if r[0] not in (1, None)}
    spans = {r.doc_id: [texts[r.doc_id][s.start:s.end] for s in r.spans] for r in got if r.doc_id in texts}
    assert spans[7] == ["äÖ ñandú straße Ⅷ) hidden words"]  # "id…" is another word than "id"
    assert spans[9] == ["short item"] and spans[2] == spans[3] == spans[5] == [] and "".join(spans[10]) == texts[10][14:]
    rows = decontaminate.report(spark, docs, items).where("doc_id = 9").first()
    assert (rows.n_items, rows.items_sha256, rows.contaminated) == (2, hashlib.sha256(b"10,2").hexdigest(), True)
    none = decontaminate.report(spark, docs, items.limit(0))
    assert none.where("contaminated").count() == 0 and none.count() == len(DOCS)
    assert decontaminate.report(spark, docs.limit(0), items).collect() == []


# --------------------------------------------------------------------------- 13

def ranks_by_hand(docs, items, k=10):
    def terms(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    counted = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, length = sum(bool(c) for _, c in counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    asked = {}
    for item, t in items:
        asked.setdefault(item, Counter()).update(terms(t))
    out = set()
    for item, q in asked.items():
        found = []
        for i, c in counted:
            m = 25 + (75 * sum(c.values()) * n_docs) // length if length else 0
            score = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t, times in q.items() if c[t])
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out |= {(item, n + 1, i, -s) for n, (s, _, _, i) in enumerate(sorted(found, key=lambda r: r[:3])[:k])}
    return out


@pytest.mark.parametrize(("block", "queries", "size"), [(32_768, 128, 16 << 20), (70, 3, 16 << 20), (32_768, 128, 300)])
def test_ranks_match_brute_force(spark, monkeypatch, block, queries, size):
    monkeypatch.setattr(lexical, "PASS_BYTES", size)
    rng = np.random.default_rng(3)
    word = [f"w{int(x)}" for x in range(60)]
    docs = [(n, " ".join(rng.choice(word, size=rng.integers(1, 60), p=None if n % 2 else np.arange(60, 0, -1) / 1830))) for n in range(500)]
    docs += [(n, docs[7][1]) for n in range(600, 640)] + [(700, None), (701, ""), (702, "..."), (7, docs[7][1]), (None, docs[7][1]), (703, "w1 " * 50_000), (704, "Größe W1_w2")]
    items = [(n, " ".join(rng.choice(word, size=8))) for n in range(9)] + [(20, docs[7][1]), (21, "w1 w1 W1 w1 w1 w2 w2 w2"), (22, None), (23, "nowhere"), (24, ""), (None, "w5 größe"), (8, "w3 w4")]
    monkeypatch.setattr(lexical, "QUERIES_AT_ONCE", queries)
    frame = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, score int, term string").repartition(3)
    asked = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, rank int")
    monkeypatch.setattr(lexical, "BLOCK_DOCS", block)
    got = lexical.rank(spark, frame, asked).collect()
    assert {tuple(r) for r in got} == ranks_by_hand(docs, items) and len(got) == len(set(got))
    assert lexical.rank(spark, frame.limit(0), asked).collect() == [] == lexical.rank(spark, frame, asked.limit(0)).collect()


def test_sums_carry_and_rank():
    rng = np.random.default_rng(4)
    sums, want = lexical.Sums(3, 200, 50), np.zeros((3, 200), np.int64)
    for _ in range(60):
        places = np.unique(rng.integers(0, 200, size=rng.integers(1, 200)))
        v, which, shift = rng.integers(1, 1 << 30, size=len(places)), np.unique(rng.integers(0, 3, size=2)), int(rng.integers(0, 3))
        depth = int(v.max()).bit_length()
        sums.add(which, places, (v[None, :] >> np.arange(depth)[:, None] & 1).astype(np.uint8), shift)
        want[np.ix_(which, places)] += v << shift
    order = rng.permutation(200)
    for q in range(3):
        best = sorted((-want[q, p], order[p], p) for p in range(200) if want[q, p])
        for k in (1, 10, 200):
            assert set(sums.top(q, k, order)) == {(p, -s) for s, _, p in best[:k]}
