"""Bootstrap sessions as a stream of shuffled events against the batch, with a restart; claims by hand."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from orefold.plans import claims
from orefold.streaming import sessions

START = datetime(2024, 1, 1)


def log(rng, many):
    """Events of sessions of three regions in chunks of two: good and wrong submissions, repeated begins, breaks longer than an hour."""
    rows, n = [], 0
    for s in range(many):
        regions = [f"r{s}-{i}" for i in range(3)] if s != 1 else []
        chunks = [(sessions.chunk_id(f"s{s}", i, regions[2 * i:2 * i + 2]), regions[2 * i:2 * i + 2]) for i in range(2)]
        at, done = START + timedelta(seconds=rng.randrange(300)), 0
        for k in range(7):
            at += timedelta(seconds=rng.choice((1, 20, 300, 300, 4000)))
            n += 1
            kind = "begin" if k == 0 or rng.random() < 0.15 else "submit"
            good = rng.random() < 0.75
            chunk, ids = chunks[done % 2] if good else rng.choice(chunks)
            done += good and kind == "submit"
            rows.append((f"s{s}", at, n, kind, chunk, regions if kind == "begin" else ids[::-1] if good else rng.choice((ids[:1], None, ids + ids))))
    return rows


def test_a_stream_answers_as_the_batch(spark, tmp_path):
    """Events arrive in any order in small files, the query stops half way and goes on from its checkpoint."""
    rng = random.Random(8)
    rows = log(rng, 12)
    batch = spark.createDataFrame(rows, sessions.EVENT)
    want = sorted(map(tuple, sessions.answers(batch, size=2).collect()))
    results = [w[2] for w in want]
    assert len(want) == len(rows) and all(results.count(r) > 2 for r in ("issued", "refused", "complete"))
    rng.shuffle(rows)
    source, sink, at = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "at")

    def run():
        stream = spark.readStream.schema(sessions.EVENT).option("maxFilesPerTrigger", 1).parquet(source)
        query = sessions.answers(stream, size=2, late="10 days").writeStream.format("parquet").option("path", sink).option("checkpointLocation", at).outputMode("append").trigger(availableNow=True).start()
        assert query.awaitTermination(240) and query.exception() is None

    half = len(rows) // 2
    for part in (rows[:half], rows[half:] + [("zz", START + timedelta(days=400), 999, "begin", None, ["r"])]):
        spark.createDataFrame(part, sessions.EVENT).coalesce(2).write.mode("append").parquet(source)
        run()
    got = sorted(tuple(r) for r in spark.read.parquet(sink).where("session <> 'zz'").select("session", "n", "result", "detail", "chunk", "chunk_index", "chunk_count").collect())
    assert got == want


def test_odd_logs(spark):
    odd = [(None, START, 1, "begin", None, ["a"]), ("s", None, 1, "begin", None, ["a"]), ("s", START, 2, "begin", None, None), ("s", START, 3, "begin", None, ["b", None]), ("s", START, 3, "submit", None, None)]
    df = spark.createDataFrame([(*r, "x") for r in odd], sessions.EVENT + ", result string")
    assert [(r.n, r.result, r.detail) for r in sessions.answers(df).collect()] == [(2, "refused", sessions.NO_PACKETS), (3, "issued", ""), (3, "refused", sessions.OTHER_CHUNK)]
    assert sessions.still_open(df).collect() == [("s", sessions.chunk_id("s", 0, ["b"]), 0, 1)]
    assert sessions.answers(df.limit(0)).collect() == []


def test_claims_by_hand(spark):
    evidence = spark.createDataFrame([("a", "e1", "symbol"), ("a", "e1", "symbol"), ("a", "e2", "symbol"), ("a", "e3", "effect"), ("b", "e9", "symbol"), ("a", None, "x")], "region string, id string, kind string")
    rows = [("a", "purpose", 0, " what \n it  is ", ["e1", " e1 ", "e9", None]), ("a", "purpose", 1, "again", ["e1"]), ("a", "responsibility", 0, "x" * 600, ["e3", "e1", "e2"]), ("a", "responsibility", 1, "x" * 601, ["e1"]),
            ("a", "does-not-own", 0, None, ["e1"]), ("a", "does-not-own", 1, "own", ["e1", "e2", "e3"]), ("a", "odd", 0, "t", ["e1"]), ("gone", "purpose", 0, "t", ["e1"]), ("b", "key-flow", 0, "t", None)] + [("b", "key-flow", 1, "same", ["e9"])] * 7
    judged = claims.validate(spark.createDataFrame([(*r, 1) for r in rows], "region string, kind string, pos int, text string, refs array<string>, found int"), evidence)
    got = {(r.region, r.kind, r.pos): (r.refs, r.confidence, r.reason) for r in judged.where("region <> 'b'").collect()}
    assert got[("a", "purpose", 0)] == (["e1"], pytest.approx(0.68), None)
    assert got[("a", "purpose", 1)][2] == "the region takes no more" == got[("a", "odd", 0)][2]
    assert got[("a", "responsibility", 0)] == (["e3", "e1", "e2"], pytest.approx(0.82, abs=0.011), None)
    assert (got[("a", "responsibility", 1)][2], got[("a", "does-not-own", 0)][2], got[("gone", "purpose", 0)][2]) == ("text too long", "no text", "no evidence of the region")
    assert sorted(r.accepted for r in judged.where("region = 'b'").collect()) == [False] * 3 + [True] * 5
    packets = spark.createDataFrame([("a", "A hint"), ("b", "B"), ("c", "C")], "id string, name_hint string")
    names = spark.createDataFrame([("a", None), ("b", " The  B ")], "region string, name string")
    out = {r.id: (r.name, r.accepted, r.rejected, r.status) for r in claims.regions(packets, names, judged).collect()}
    assert out == {"a": ("A hint", 3, 4, "synthesized"), "b": ("The B", 5, 3, "partial"), "c": ("C", 0, 0, "deterministic")}
    assert claims.validate(judged.select("region", "kind", "pos", "text", F.col("refs")).limit(0), evidence).collect() == []
