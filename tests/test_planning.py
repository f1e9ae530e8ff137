"""Plans over many clauses against plain computations: substrings, scores, probes, hints, context packs."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from orefold.operators import substrings
from orefold.operators.graph import Rounds
from orefold.plans import contracts, corridor, packs, probes, projections


def test_texts_hold_terms(spark, monkeypatch):
    monkeypatch.setattr(substrings, "PIECE", 7)
    monkeypatch.setattr(substrings, "TERMS", 5)
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcé𝒳 \n") for _ in range(n))
    texts = [(i, rng.choice("xy"), word(rng.randrange(0, 40))) for i in range(60)] + [(70, "x", None), (71, "x", ""), (None, "x", "abc"), (0, "x", "abcabc"), (72, None, "abc"), (73, "x", "ab" * 3000 + "aaa")]
    terms = [word(rng.randrange(1, 6)) for _ in range(40)] + ["aaa", "", None, "abc", "abc"]
    got = substrings.containing(spark.createDataFrame([(*t, 1) for t in texts], "id int, kind string, text string, term int"), spark.createDataFrame([(t,) for t in terms], "term string"), ["id", "kind"])
    want = {(i, k, t) for i, k, x in texts if None not in (i, k) and x for t in terms if t and t in x}
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 100
    frame = spark.createDataFrame(texts, "id int, kind string, text string")
    assert substrings.containing(frame, spark.createDataFrame([("",)], "term string"), ["id"]).collect() == [] == substrings.containing(frame.limit(0), spark.createDataFrame([("a",)], "term string"), ["id"]).collect()


def test_a_term_counts_wherever_a_text_holds_it(spark):
    files = spark.createDataFrame([("a.js", "x" * 30_000 + " settings"), ("b.js", "x" * 30_000), ("c.js", "settings"), ("d.js", None)], "path string, text string")
    none = lambda cols: spark.createDataFrame([], ", ".join(f"{c} string" for c in cols.split()))
    model = {"files": files, "symbols": none("file name"), "effects": none("file kind detail symbol"), "states": none("file namespace key operation"), "references": none("file specifier"), "dependencies": none("from to")}
    stacks = corridor.haystacks(model)
    assert {r.path: r.score for r in corridor.scores(stacks, ["settings"]).collect()} == {"a.js": 2, "b.js": 0, "c.js": 2}
    clauses = spark.createDataFrame([("c1", "settings")], "clause string, term string")
    assert {r.path: r.score for r in corridor.clause_scores(stacks, clauses, keep=Rounds(spark).save).collect()} == {"a.js": 2, "b.js": 0, "c.js": 2}


def test_clause_scores_match_plain_scores(spark):
    """Scores of several clauses at once, with all evidence, against a loop over files and terms."""
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "lambdas", "delta9"]
    say = lambda n: " ".join(rng.choice(words)[: rng.randrange(2, 8)] for _ in range(n))
    stacks = [(f"{say(1)}/f{i}.js", *[say(rng.randrange(4)) for _ in corridor.WEIGHTS], rng.randrange(7), rng.randrange(7)) for i in range(30)]
    names = list(corridor.WEIGHTS)
    frame = spark.createDataFrame(stacks, "path string, " + ", ".join(f"h_{n} string" for n in names) + ", incoming int, outgoing int")
    files = [s[0] for s in stacks]
    clauses = {"c1": ["alpha", "beta"], "c2": ["lambdas"], "c3": ["nowhere"]}
    runtime = [(rng.choice(files), say(2), rng.choice(("entry-point", "runtime-operation"))) for _ in range(40)]
    flow = [(rng.choice(files), say(1), "identifier", rng.random() < 0.3) for _ in range(12)]
    hops = [(i, rng.choice(files), say(1)) for i in range(5)]
    contracts = [(f"k{i}", say(2), rng.choice(("native-authoritative", "resolved"))) for i in range(8)]
    endpoints = [(c[0], rng.choice(files), rng.choice(("provider", "consumer"))) for c in contracts for _ in range(3)]
    evidence = corridor.Evidence(
        hops=spark.createDataFrame(hops, "place int, file string, symbol string"), blocker=spark.createDataFrame([(hops[0][1], "alpha")], "file string, said string"),
        runtime=spark.createDataFrame([(f, "", "", s, k) for f, s, k in runtime], "file string, effect_kind string, symbol string, detail string, kind string"),
        flow=spark.createDataFrame(flow, "file string, symbol string, kind string, end boolean"),
        contracts=spark.createDataFrame(contracts, "id string, said string, verification string"), endpoints=spark.createDataFrame(endpoints, "id string, path string, role string"))
    flat = lambda t: re.sub(r"[_.\\/:-]+", " ", re.sub("([a-z0-9])([A-Z])", r"\1 \2", t)).lower()
    want = {}
    for clause, terms in clauses.items():
        for path, *rest in stacks:
            hits = sum(w + (len(t) >= 7) for n, w in corridor.WEIGHTS.items() for t in terms if t in rest[names.index(n)])
            score = min(4, rest[-2]) + min(3, rest[-1])
            said = [s for _, f, s in hops if f == path]
            if said:
                score += sum(6 * (t in flat(" ".join(said))) + 3 * (t in flat(path)) for t in terms) + (sum(4 for t in terms if t in "alpha") if path == hops[0][1] else 0)
            for i, text, how in contracts:
                if any(t in text for t in terms):
                    roles = {r for c, p, r in endpoints if (c, p) == (i, path)}
                    score += ("provider" in roles) * (8 if how == "native-authoritative" else 5) + 4 * ("consumer" in roles)
            if hits:
                score += min(12, sum((3 if k == "entry-point" else 1) for f, s, k in runtime if f == path for t in terms if t in flat(f"  {s}")))
                mine = [(s, k, e) for f, s, k, e in flow if f == path]
                if mine:
                    text = flat(path + " " + " ".join(f"{s} {k}" for s, k, _ in mine))
                    score += min(12, (3 if any(e for _, _, e in mine) else 1) + 4 * sum(t in text for t in terms))
            want[clause, path] = hits + score
    rows = spark.createDataFrame([(c, t) for c, ts in clauses.items() for t in ts], "clause string, term string")
    got = {(r.clause, r.path): r.score for r in corridor.clause_scores(frame, rows, evidence, Rounds(spark).save).collect()}
    assert all(want[k] == v for k, v in got.items())
    for clause in clauses:
        best = lambda s: sorted(((-v, p) for (c, p), v in s.items() if c == clause))[:4]  # noqa: E731, B023
        assert best(got) == best(want)


FACTS = {
    "effects": ([("a.js", "hooks", "Hook", 3, "go"), ("a.js", "settings", "Setting", 5, "go"), ("a.js", "settings", "Again", 5, "go"), ("z.js", "settings", "Far", 1, "z")], "file string, kind string, detail string, line int, symbol string"),
    "states": ([("a.js", "ns", "key", "read", "get", 7)], "file string, namespace string, key string, access string, operation string, line int"),
    "symbols": ([("a.js", n, "function", i, True) for i, n in enumerate(("goHome", "GOAL", "Go", "cargo", "stop"))], "file string, name string, kind string, line int, exported boolean"),
    "runtime_nodes": ([("n1", "a.js", "entry-point", "hooks", "Hook", 3, "lexically-associated"), ("n2", "a.js", "runtime-operation", "symbol-operation", "Op", 3, "x"), ("n3", "a.js", "effect-sink", "settings", "S", 3, "unresolved"), ("n4", "b.js", "effect-sink", "settings", "S", 4, "x")], "id string, file string, kind string, effect_kind string, detail string, line_start int, confidence string"),
}


def test_probes_of_clauses(spark):
    m = {k: spark.createDataFrame(*v) for k, v in FACTS.items()}
    clauses = [("clause-1", "go there", "a.js", ["a.js", None], True, ["go", None]), ("clause-2", "nothing", "q.js", None, True, []), ("clause-3", "half", None, ["a.js"], False, ["go"]), ("clause-10", "b", "b.js", ["b.js"], True, None), ("clause-11", "b again", "b.js", [], True, [])]
    asked = spark.createDataFrame(clauses, "clause string, said string, owner string, path array<string>, complete boolean, terms array<string>")
    rows, goals = probes.probes(asked, m, spark.createDataFrame([("r1", "n1"), ("r0", "n1")], "region string, node string"))
    by_id = {r.id: r for r in rows.collect()}
    goals = {r.clause: (r.probe_ids, r.status) for r in goals.collect()}
    assert goals["clause-1"] == (["effect-a-js-settings-5", "effect-n1", "hook-a-js-hooks-3", "state-a-js-ns-key-7", "symbol-a-js-go", "symbol-a-js-goal", "symbol-a-js-gohome"], "instrumented")
    assert goals["clause-2"] == (["manual-clause-2"], "manual") and goals["clause-3"] == (["manual-clause-3"], "manual")
    assert by_id["manual-clause-2"].evidence == {"reason": probes.UNSEEN} and by_id["manual-clause-3"].evidence == {"reason": probes.UNCERTAIN} and by_id["manual-clause-3"].path is None
    assert by_id["effect-a-js-settings-5"].label == "Setting at a.js:5" and by_id["effect-n1"].kind == "hook" and by_id["effect-n1"].evidence["runtimeRegionIds"] == "r0,r1"
    assert by_id["state-a-js-ns-key-7"].label == "read ns.key" and by_id["symbol-a-js-goal"].label == "function GOAL"
    assert by_id["effect-n4"].clause == "clause-11" and len(by_id) == 10  # of one id the last clause counts
    none = probes.probes(asked.limit(0), m)
    assert none[0].collect() == none[1].collect() == []


def test_probes_of_odd_rows(spark):
    """Files of one slug, ids that come twice in a file, more facts than a clause keeps, null files, lines and details; clauses that share files."""
    m = {k: spark.createDataFrame([], v[1]) for k, v in FACTS.items()}
    m["effects"] = spark.createDataFrame([("a/b", "settings", "Old", 1, "s"), ("a-b", "settings", "Mine", 1, "s"), ("a/b", "settings", "New", 1, "s"), ("a/b", "timer", None, 2, None), ("a/b", "hooks", "Late", None, "s"), (None, "settings", "No", 1, "s"), ("q", "settings", "Unasked", 1, "s")], FACTS["effects"][1])
    m["states"] = spark.createDataFrame([("big", "ns", f"k{i:02}", "read", "get", i) for i in range(30)] + [("big", "ns", "k00", "write", "set", 0), ("big", None, "k00", "read", "get", 0)], FACTS["states"][1])
    clauses = [("c1", "one", "a/b", ["a-b", "a/b", "", None], True, []), ("c2", "two", "big", ["big", "a-b"], True, None), ("c2", "two", "big", ["big", "a-b"], True, None), ("c03", "three", "a-b", [], True, []), (None, "null", "a-b", [], True, [])]
    rows, goals = probes.probes(spark.createDataFrame(clauses, "clause string, said string, owner string, path array<string>, complete boolean, terms array<string>"), m)
    ids = {r.clause: r.probe_ids for r in goals.collect()}
    assert ids["c1"] == ["effect-a-b-settings-1", "effect-a-b-timer-2", "hook-a-b-hooks"] and ids["c03"] == ["effect-a-b-settings-1"] and ids[None] == [None]
    assert ids["c2"] == ["effect-a-b-settings-1", "state-big-k00-0", *[f"state-big-ns-k{i:02}-{i}" for i in range(6)]]
    got = {r.id: (r.clause, r.path, r.label, r.evidence) for r in rows.collect()}
    assert got["effect-a-b-settings-1"] == ("c03", "a-b", "Mine at a-b:1", {"effectKind": "settings", "symbol": "s", "line": "1"})  # of the longest clause name
    assert got["effect-a-b-timer-2"] == ("c1", "a/b", None, {"effectKind": "timer", "line": "2"}) and got["hook-a-b-hooks"][2:] == (None, {"effectKind": "hooks", "symbol": "s"})
    assert got["state-big-ns-k05-5"] == ("c2", "big", "read ns.k05", {"namespace": "ns", "key": "k05", "operation": "get", "line": "5"}) and got["state-big-k00-0"][2] is None
    alone = {r.id: r.label for r in probes.probes(spark.createDataFrame(clauses[:1], "clause string, said string, owner string, path array<string>, complete boolean, terms array<string>"), m)[0].collect()}
    assert alone["effect-a-b-settings-1"] == "Old at a/b:1"  # the last by file, line, kind and detail


def test_probes_are_chosen_from_bare_facts(spark, monkeypatch):
    """No shuffle or sort carries the evidence of a probe: tasks hold it only for what they write."""
    held, save = [], Rounds.save

    def walk(node):
        if node.nodeName() in ("Exchange", "Sort"):
            held.extend(node.output().apply(i).dataType().catalogString() for i in range(node.output().size()))
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    def spy(self, df, *old):
        plan = df._jdf.queryExecution().executedPlan()
        walk(plan.initialPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan)
        return save(self, df, *old)

    monkeypatch.setattr(Rounds, "save", spy)
    m = {k: spark.createDataFrame(*v) for k, v in FACTS.items()}
    asked = spark.createDataFrame([("clause-1", "go there", "a.js", ["a.js"], True, ["go"])], "clause string, said string, owner string, path array<string>, complete boolean, terms array<string>")
    assert probes.probes(asked, m)[0].count() == 7
    assert held and not any("map<" in kind for kind in held)


def test_native_hints(spark):
    regions = spark.createDataFrame([("root", "repository"), ("a", "directory"), ("b", "directory"), ("none", "directory")], "region string, kind string")
    paths = spark.createDataFrame([("a", "src/a"), ("a", "lib/a"), ("b", "src/b"), ("b", None), ("root", "zz"), ("none", "")], "region string, path string")
    records = spark.createDataFrame([(i, f"r{i}", "s", text) for i, text in enumerate(["src/a lib/a", "src/b", None, "", *["x src/b y"] * 7])], "pos int, id string, source string, serialized string")
    got = {}
    for r in sorted(probes.native_hints(regions, paths, records).collect()):
        got.setdefault(r.region, []).append(r.hint)
    assert got == {"root": [f"r{i} (s)" for i in range(6)], "a": ["r0 (s)"], "b": [f"r{i} (s)" for i in (1, 4, 5, 6, 7, 8)]}


@pytest.fixture(scope="module")
def packed(spark):
    body = "\n".join(f"line {i}" for i in range(300))
    files = [("a.js", f"top\nfunction one() {{\n{body}\n}}\nfunction two() {{}}\nfunction three() {{}}"), ("b.js", "x" * 9001), ("c.js", None), ("d.js", "")]
    symbols = [("a.js", "one", "function", 2), ("a.js", "two", "function", 304), ("a.js", "three", "function", 305), ("b.js", "wide", "variable", 1), ("b.js", "wide2", "variable", 1), ("d.js", "gone", "variable", 9)]
    m = {"files": spark.createDataFrame(files, "path string, text string"), "symbols": spark.createDataFrame(symbols, "file string, name string, kind string, line int")}
    rows = [("o", 1, "a.js", ["r"], ["one", "three", "one", None]), ("o", 2, "b.js", None, ["wide2"]), ("o", 3, "c.js", [], ["x"]), ("o", 4, "d.js", [], ["gone"]), ("o", 5, "a.js", [], []), ("p", 1, "a.js", [], ["two"])]
    return files, m, spark.createDataFrame([(*r, "x") for r in rows], "objective string, place int, path string, reasons array<string>, names array<string>, text string")


def test_packs_and_their_continuations(spark, packed):
    files, m, asked = packed
    p = packs.pack(asked, m)
    segments = {(r.objective, r.path): r for r in p.segments.where("place < 5").collect()}
    assert set(segments) == {("o", "a.js"), ("o", "b.js"), ("o", "d.js"), ("p", "a.js")} and p.later.collect() == []
    assert {tuple(r) for r in p.omissions.collect()} == {("o", "c.js", packs.NO_FACTS), ("o", "a.js", packs.NO_ANCHOR)}
    one, three = segments["o", "a.js"].symbols
    assert (one.name, one.line_start, one.line_end, one.truncated, three.name, three.source, three.continuation) == ("one", 2, 121, True, "three", "function three() {}", None)
    assert segments["p", "a.js"].content == "/* two (function) lines 304-304 */\nfunction two() {}" and segments["o", "d.js"].symbols[0].source == ""
    assert segments["o", "a.js"].sha256 == hashlib.sha256(files[0][1].encode()).hexdigest()
    # from token to token, the chunks are the whole block
    rest = {r.id: r for r in p.continuations.where("objective = 'o'").collect()}
    text, at, chunk = one.source, one.continuation, 2
    while at:
        r = rest[at]
        assert (r.chunk, r.segment, at) == (chunk, "file:a.js", "ctx-" + hashlib.sha256(f"file:a.js\none\n{chunk}".encode()).hexdigest()[:20])
        text, at, chunk = text + r.source, r.next, chunk + 1
    assert text == "\n".join(files[0][1].split("\n")[1:303]) and chunk == 4
    wide = segments["o", "b.js"].symbols[0]
    assert len(wide.source) == 4000 and packs.resume(p.continuations, spark.createDataFrame([("o", wide.continuation), ("o", "ctx-no")], "objective string, id string")).select("chunk", "chunks", "continued").collect() == [(2, 3, True)]


def test_calls_go_on_where_the_last_one_ended(spark, packed):
    _, m, asked = packed
    whole = packs.pack(asked, m)
    rows = lambda p, t: {tuple(map(str, r)) for r in getattr(p, t).collect()}
    seen, after = {"segments": set(), "continuations": set(), "omissions": set()}, None
    for _ in range(4):
        p = packs.pack(asked.where("objective = 'o'"), m, after=after, most_segments=2)
        for t in seen:
            seen[t] |= rows(p, t)
        after = p.later
        if after.isEmpty():
            break
    assert all(seen[t] == {r for r in rows(whole, t) if r[0] == "o"} for t in seen)
    empty = packs.pack(asked.limit(0), m)
    assert all(t.collect() == [] for t in empty)


def test_projections_of_odd_rows(spark):
    """Empty lists, nulls, ties, more children than are shown; no task sends more than k rows of a group to the shuffle."""
    parents = spark.createDataFrame([("a",), ("b",), (None,)], "id string")
    children = spark.createDataFrame([("a", n, None if n == 3 else f"c{n}") for n in range(6)] + [("z", 1, "far"), (None, 1, "x")], "id string, n int, name string")
    out = projections.first_children(parents, children, ["id"], ["n"], 4, ["name"], "kids")
    assert {r.id: ([k.name for k in r.kids], r.kids_count, r.kids_truncated) for r in out.collect()} == {"a": (["c0", "c1", "c2", None], 6, True), "b": ([], 0, False), None: ([], 0, False)}
    top = projections.ranking.top_k(children, ["id"], ["n"], 2)
    assert "WindowGroupLimit" in top._jdf.queryExecution().toString() and "Partial" in top._jdf.queryExecution().toString()
    rows = spark.createDataFrame([(1, "x", 5), (2, "y", None), (3, "z", 5)], "pos int, id string, b int")
    said = spark.createDataFrame([("x", "one two"), ("y", "two"), ("z", None)], "id string, text string")
    asked = spark.createDataFrame([("o", "two"), ("p", None), ("q", "nothing"), ("o", "two")], "objective string, term string")
    got = projections.best(rows, ["id"], F.coalesce("b", F.lit(0)), said, asked, 10, None, 2, "pos")
    assert sorted((r.objective, r.id, r.score, r["rank"]) for r in got.collect()) == [("o", "x", 15, 1), ("o", "y", 10, 2), ("p", "x", 5, 1), ("p", "z", 5, 2), ("q", "x", 5, 1), ("q", "z", 5, 2)]
    assert projections.best(rows.limit(0), ["id"], F.lit(1), said, asked, 10, None, 2, "pos").collect() == []
    segments = spark.createDataFrame([("o", 1, "p", None, None, None, None, None), ("o", 2, "two", ["n"], ["e"], 1, 0, 9)], "objective string, place int, path string, names array<string>, evidence array<string>, contracts int, runtime int, consumers int")
    assert [(r.place, r.score, r.gain) for r in projections.grants(segments, asked).orderBy("rank").collect()] == [(2, 8 + 4 + 6 + 12, "medium"), (1, 0, "low")]


def test_tables_of_substrings_hold_answers(spark, monkeypatch):
    """What is stored on the way grows with the words and the answer: not with grams of whole texts, nor with words that share a gram."""
    sizes = []
    save = Rounds.save
    monkeypatch.setattr(Rounds, "save", lambda self, df, *old: (out := save(self, df, *old), sizes.append(out.count()))[0])
    numbers = [f"fun{i}" for i in range(300)]
    texts = spark.createDataFrame([(i, " ".join(numbers)) for i in range(50)], "id int, text string")
    terms = [f"n{i}" for i in range(0, 300, 10)]
    got = substrings.containing(texts, spark.createDataFrame([(t,) for t in [*terms, "un29 fun30", "un28 fun30"]], "term string"), ["id"])
    assert sorted(map(tuple, got.collect())) == sorted((i, t) for i in range(50) for t in [*terms, "un29 fun30"])
    assert max(sizes) == 50 * 31
    words = [f"{'long' * 3000}{i}x" for i in range(3)]  # pieces of one word
    assert sorted(map(tuple, substrings.containing(spark.createDataFrame([(0, words[1])], "id int, text string"), spark.createDataFrame([(w,) for w in [*words, "glong1x", "longlonglonglong", "g1x", "g2x"]], "term string"), ["id"]).collect())) == sorted((0, t) for t in [words[1], "glong1x", "longlonglonglong", "g1x"] if t in words[1])


def test_consumers_of_a_class_are_those_of_each_contract(spark):
    contracts = spark.createDataFrame([(i, f"k{i}", "kind", f"name{i}", f"n{i % 2}" if i % 3 else None, "s", "resolved", "repository-only", []) for i in range(20)], "pos int, id string, kind string, name string, file string, symbol string, verification string, reconciliation string, refs array<string>")
    shared = [(c, i, f"n{i % 4}", f"c{c}x{i}") for c in range(3) for i in range(11 - c)]
    sides = [(f"k{i}", i % 4) for i in range(20)]  # class 3 has no consumers
    listed = [(k, i, f, y) for k, c in sides for c2, i, f, y in shared if c == c2]
    evidence = spark.createDataFrame([("k1", 1, "part", "f", 1, "Told")], "id string, n int, kind string, file string, line int, summary string")
    terms = spark.createDataFrame([("o", "c1x1"), ("o", "name1"), ("o", "told"), ("p", "n3 c0x3"), ("q", None)], "objective string, term string")
    at = spark.createDataFrame([("o", "n1"), ("p", "n0")], "objective string, path string")
    few = evidence.select("id", "n", "kind", "summary").limit(0)
    by_id = projections.contract_map(terms, at, contracts, spark.createDataFrame(listed, "id string, n int, file string, symbol string"), evidence, few)
    by_class = projections.contract_map(terms, at, contracts, spark.createDataFrame(shared, "class int, n int, file string, symbol string"), evidence, few, spark.createDataFrame(sides, "id string, class int"))
    assert sorted(map(str, by_class.collect())) == sorted(map(str, by_id.select(by_class.columns).collect())) and by_class.count() == 36
    first = by_class.where("objective = 'o' and rank = 1").first()
    assert (first.id, first.score, first.consumers_count, first.evidence_count) == ("k1", 1 + 300 + 3 * 100 + 10 * 3, 10, 1)


def test_native_entries_of_a_name_match_all_its_contracts_once(spark):
    """By name as by pairs, without a row for each pair: a name of 3000 contracts and 3000 entries makes 9 million."""
    contract = lambda i, name: (f"k{i}", name, "resolved", "repository-only")
    frame = spark.createDataFrame([contract(0, "a"), contract(1, "a"), contract(2, "b"), contract(3, "c"), contract(4, None), contract(5, "d")], "id string, name string, verification string, reconciliation string")
    entries = spark.createDataFrame([("a", 1, None), ("a", 2, None), ("a", 2, None), ("b", 3, "parameters"), ("b", 4, None), (None, 5, None), ("d", None, None)], "name string, native_id int, conflict string")
    got = {r.id: (r.reconciliation, r.verification, r.refs) for r in contracts.reconciled_by(frame, entries).collect()}
    pairs = contracts.reconciled(frame, frame.select("id", "name").join(entries, "name"))
    assert got == {r.id: (r.reconciliation, r.verification, None if r.refs is None else len(r.refs)) for r in pairs.collect()} and len(got) == 6
    many = spark.range(3000).select(F.lit("n").alias("name"), F.col("id").alias("native_id"), F.lit(None).cast("string").alias("conflict"))
    hot = spark.range(3000).select(F.col("id").cast("string").alias("id"), F.lit("n").alias("name"), F.lit("resolved").alias("verification"), F.lit("repository-only").alias("reconciliation"))
    out = contracts.reconciled_by(hot, many)
    assert out.count() == 3000 and {r.refs for r in out.select("refs").distinct().collect()} == {3000}
