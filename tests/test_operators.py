"""Operators on small fixtures."""

import random
from collections import namedtuple

import pytest
from pyspark.sql import functions as F

from orefold.functions import paths, text
from orefold.operators import facts, graph, joins, rollups
from orefold.plans import corridor, edits, validation, walks
from orefold.sources import snapshot


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v"))).first()[0]


def test_paths(spark):
    norm = lambda p: one(spark, p, paths.normalize)
    assert [norm(p) for p in ("./a/../b//c", "/a/b", "..", "a\\b", " a/./b ", "a/../../b")] == ["b/c", "a/b", "", "a/b", "a/b", ""]
    assert [one(spark, p, paths.extension) for p in ("a/.env", "a/b.TS", "x.tar.gz", "a.b/c")] == ["", ".ts", ".gz", ""]
    assert one(spark, "./b", lambda v: paths.candidates(F.lit("src/a.js"), v))[:2] == ["src/b.js", "src/b.mjs"]
    assert one(spark, "../x.json?q", lambda v: paths.candidates(F.lit("src/a.js"), v)) == ["x.json"]
    assert one(spark, "lodash", lambda v: paths.candidates(F.lit("src/a.js"), v)) == []


def test_text(spark):
    assert one(spark, "BraceService", text.family) == "brace"
    assert one(spark, "Fix a; then b. New c, and d", text.clauses) == ["Fix a", "then b", "New c", "d"]
    assert one(spark, "", text.slug) == "probe"
    assert one(spark, "a", text.fnv1a) == "e40c292c"
    assert one(spark, "a\nb\nc", lambda v: text.line_number(v, F.lit(4))) == 3


def test_cycle_and_levels(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a"), ("d", "a")], "from string, to string")
    assert {tuple(r) for r in graph.strong_components(edges).collect()} == {("a", "b"), ("b", "b")}
    assert {r.node: r.component for r in graph.components(edges).collect()} == dict.fromkeys("abcd", "a")
    dag = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c")], "from string, to string")
    assert {r.node: r.level for r in graph.levels(dag).collect()} == {"a": 2, "b": 1, "c": 0}
    assert {r.node: r.path for r in graph.shortest_paths(dag, "c").collect()}["a"] == ["c", "a"]


def test_asof_and_last_wins(spark):
    probe = spark.createDataFrame([("f", 5), ("f", 1), ("g", 3)], "file string, line int")
    facts = spark.createDataFrame([("f", 2, "x"), ("f", 4, "y"), ("f", 4, "a")], "file string, since int, name string")
    got = {(r.file, r.line): r.name for r in joins.asof(probe, facts, ["file"], "line", "since", ["name"], ["name"]).collect()}
    assert got == {("f", 5): "a", ("f", 1): None, ("g", 3): None}
    rows = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (2, "c", 2)], "k int, v string, seq int")
    assert {(r.k, r.v) for r in joins.last_wins(rows, ["k"], "seq").collect()} == {(1, "b"), (2, "c")}


def test_families(spark):
    symbols = spark.createDataFrame([("BraceService", "a", True), ("brace_service", "b", True), ("other", "a", False)], "name string, file string, exported boolean")
    assert [tuple(r) for r in rollups.families(symbols).select("family", "kind").collect()] == [("brace", "distributed")]


def test_snapshot(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.js").write_text("import './b.js'\n")
    files = snapshot.checkout(spark, str(tmp_path), "r", "c")
    assert [tuple(r) for r in files.select("path", "size", "text").collect()] == [("src/a.js", 16, "import './b.js'\n")]


def test_edits_apply_in_order(spark):
    files = spark.createDataFrame([("a", "x y x"), ("b", "k")], "path string, text string")
    edits = spark.createDataFrame([("a", 2, "z", "w", 2), ("a", 1, "x", "z", 2), ("a", 3, "y", "q", 2), ("b", 1, "k", "", 1)], "path string, seq int, find string, put string, times int")
    got = {r.path: (r.after, r.applied) for r in validation.apply_edits(files, edits).collect()}
    assert got == {"a": ("w y w", 2), "b": ("", 1)}


def test_json_is_the_whole_text(spark):
    good = ['{"a": 1, "a": 2}', " [null] ", "1e999", '""', "-0", '{"a": {"b": [1]}}']
    bad = ["", " ", "12 more words", "{} {}", "1],[2", "1, 2", '1}, "b": {"c": 2', '1, "b": 2', "[1,]", "NaN", "{'a': 1}", "{a: 1}", '"\t"', "01"]
    rows = spark.createDataFrame([("a.json", None, v) for v in good + bad], "path string, before string, after string")
    assert {r.after: r.ok for r in rows.select("after", text.is_json(F.col("after")).alias("ok")).collect()} == dict.fromkeys(good, True) | dict.fromkeys(bad, False)
    found = validation.structural_findings(rows.where("after like '12%'"), 100)
    assert [r.code for r in found.collect()] == ["INVALID_JSON"]


def test_structural_findings(spark):
    rows = [("a.json", None, "{"), ("/abs", "x", "x"), ("ok.md", "a", "b\0"), ("ok2.md", "a", None), ("a\\b", "a", "=======\n"), ("c", "a", ">>>>>>> x")]
    got = {(r.path, r.code) for r in validation.structural_findings(spark.createDataFrame(rows, "path string, before string, after string"), 100).collect()}
    assert got == {("a.json", "INVALID_JSON"), ("/abs", "INVALID_PATH"), ("/abs", "NOOP_CHANGE"), ("ok.md", "NULL_BYTE"), ("a\\b", "INVALID_PATH"), ("c", "CONFLICT_MARKER")}


@pytest.mark.parametrize("few", [0, 200_000])
def test_levels_of_cyclic_graphs_match_a_plain_computation(spark, monkeypatch, few):
    monkeypatch.setattr(graph, "FEW_EDGES", few)
    rng = random.Random(4)
    for size, n in ((12, 18), (30, 34), (25, 60))[: 3 if few else 1]:
        pairs = {(f"n{rng.randrange(size):02}", f"n{rng.randrange(size):02}") for _ in range(n)}
        edges = spark.createDataFrame(sorted(pairs), "from string, to string")
        nodes = sorted({x for p in pairs for x in p})
        reach = {a: {a} for a in nodes}
        for _ in nodes:
            for a, b in pairs:
                reach[a] |= reach[b]
        comp = {a: max(b for b in nodes if b in reach[a] and a in reach[b]) for a in nodes}
        up = {(comp[a], comp[b]) for a, b in pairs if comp[a] != comp[b]}
        level = {}

        def depth(c):
            if c not in level:
                level[c] = 1 + max((depth(b) for a, b in up if a == c), default=-1)
            return level[c]
        assert {r.node: r.level for r in graph.levels(edges).collect()} == {a: depth(comp[a]) for a in nodes}
        several = {a: c for a, c in comp.items() if sum(x == c for x in comp.values()) > 1}
        assert {r.node: r.component for r in graph.strong_components(edges).collect()} == several


def test_long_ways_take_few_rounds(spark, monkeypatch):
    saved, save = [], graph.Rounds.save
    monkeypatch.setattr(graph.Rounds, "save", lambda self, df, *old: saved.append(1) or save(self, df, *old))
    # a chain without a cycle, and a ring that another chain leaves for a pair
    pairs = [(f"c{i}", f"c{i + 1}") for i in range(400)] + [(f"r{i}", f"r{(i + 1) % 90}") for i in range(90)] + [("r7", "x1"), ("x1", "x2"), ("x2", "y1"), ("y1", "y2"), ("y2", "y1"), ("y1", "z")]
    found = graph.strong_components(spark.createDataFrame(pairs, "from string, to string"), few=40)
    assert {r.node: r.component for r in found.collect()} == {f"r{i}": "r9" for i in range(90)} | {"y1": "y2", "y2": "y2"}
    assert len(saved) < 60  # a round a node would be hundreds


def test_rounds_send_no_table_to_the_driver(spark, monkeypatch):
    plans, save = [], graph.Rounds.save
    monkeypatch.setattr(graph.Rounds, "save", lambda self, df, *old: plans.append(df._jdf.queryExecution().executedPlan().toString()) or save(self, df, *old))
    monkeypatch.setattr(graph, "FEW_EDGES", 0)
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e")], "from string, to string")
    files = spark.createDataFrame([(p,) for p in "abcde"], "path string")
    rows = {r.path: (r.phase, r.cyclic) for r in corridor.stages(files, edges).collect()}
    assert rows == {"a": (3, True), "b": (3, True), "c": (3, True), "d": (2, False), "e": (1, False)}
    assert plans and not any("Broadcast" in p for p in plans)


def test_models_make_only_what_is_asked_for(spark):
    made = []
    m = facts.model(spark.createDataFrame([("a.js", 'import "./b.js";'), ("b.js", "")], "path string, text string"), keep=lambda t: made.append(t) or t)
    assert m["dependencies"].count() == 1 and m["references"].count() == 1 and len(made) == 1
    assert set(m) == {"files", "references", "dependencies", "unresolved", "symbols", "effects", "runtime_nodes", "runtime_edges", "states"}


def test_failed_edits_are_named_by_their_whole_number(spark):
    e = spark.createDataFrame([(2**53 + 1, "replace_exact", "a", None, "x", "y", None, None), (2**53 + 2, "remove_file", "b", None, None, None, None, None)], edits.COLUMNS)
    files = spark.createDataFrame([("a", "z"), ("b", "w")], "path string, text string")
    got = {r.path: (r.after, r.kind, r.error) for r in edits.stage(files, edits.normalized(e)).collect()}
    assert got == {"a": ("z", "modify", f"{2**53 + 1}: found 0 times"), "b": (None, "delete", None)}


def test_group_keys_are_found_once(spark):
    rows = spark.createDataFrame([("Feature_parse-tokens now",), ("the.",), ("a-b",)], "t string").select(text.group_key(F.col("t")).alias("key"))
    assert [r.key for r in rows.collect()] == ["parse-tokens", "misc", "misc"]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("array_join") == 1


def test_levels_of_a_long_chain(spark):
    edges = spark.range(10_000).selectExpr("cast(id as string) as `from`", "cast(id + 1 as string) as `to`")
    assert {int(r.node): r.level for r in graph.levels(edges).collect()} == {i: 10_000 - i for i in range(10_001)}


def test_shortest_paths_match_breadth_first_search(spark):
    rng = random.Random(7)
    pairs = {(f"n{rng.randrange(20):02}", f"n{rng.randrange(20):02}") for _ in range(30)}
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    start, paths_, queue = min(near), {}, [[min(near)]]
    paths_[start] = [start]
    while queue:
        way = queue.pop(0)
        for b in sorted(near[way[-1]]):
            if b not in paths_:
                paths_[b] = [*way, b]
                queue.append(paths_[b])
    got = graph.shortest_paths(spark.createDataFrame(sorted(pairs), "from string, to string"), start)
    assert {r.node: r.path for r in got.collect()} == paths_


def test_slices_and_their_limits(spark):
    nodes = spark.createDataFrame([("a", "f1", "s", "literal-source", "repository-confirmed"), ("b", "f1", "s", "assignment", "repository-confirmed"), ("c", "f2", "s", "effect-sink", "repository-confirmed"), ("d", "f3", "s", "identifier", "unresolved"), ("e", "f3", "s", "effect-sink", "repository-confirmed")], "id string, file string, symbol string, kind string, reconciliation string")
    edges = spark.createDataFrame([("1", "a", "b", "assigns"), ("2", "b", "c", "passes"), ("3", "b", "d", "reads"), ("4", "d", "e", "control-dependency"), ("5", "c", "a", "returns")], "id string, from string, to string, kind string")
    asked = spark.createDataFrame([("r", "a")], "request string, node string")

    def run(**options):
        rows = walks.slices(asked, nodes, edges, **options).collect()
        pick = lambda kind: sorted(r.id if kind != "frontier" else f"{r.id}:{r.detail}" for r in rows if r.row == kind)
        return pick("node"), pick("edge"), pick("frontier"), pick("status")[0]
    assert run() == (["a", "b", "c", "d"], ["1", "2", "3", "5"], ["d:unresolved"], "PARTIAL")
    assert run(allowed=F.col("file") != "f3") == (["a", "b", "c"], ["1", "2", "5"], [], "CERTIFIED")
    assert run(control=True)[0] == ["a", "b", "c", "d", "e"]
    assert run(direction="backward") == (["a", "b", "c"], ["1", "2", "5"], [], "CERTIFIED")
    assert run(limits=walks.Limits(nodes=2)) == (["a", "b"], ["1"], ["c:node-limit", "d:node-limit"], "LIMITS_EXCEEDED")
    assert run(limits=walks.Limits(hops=1))[2:] == (["b:hop-limit"], "LIMITS_EXCEEDED")
    assert run(limits=walks.Limits(files=1))[2:] == (["c:file-limit", "d:file-limit"], "LIMITS_EXCEEDED")
    assert run(limits=walks.Limits(edges=2))[2:] == (["b:edge-limit", "c:edge-limit"], "LIMITS_EXCEEDED")
    assert run(target=F.col("id") == "e")[3] == "UNABLE_TO_CERTIFY"
    assert walks.criterion(nodes.withColumn("line_start", F.lit(1)), F.col("symbol") == "s").collect() == [("a",)]


def _traces(spark, nodes, edges, *asked, **options):
    """(path, status, detail) of each (start, target), in one plan."""
    rows = walks.traces(spark.createDataFrame([(str(i), *a) for i, a in enumerate(asked)], "request string, node string, target_effect string"), nodes, edges, **options).collect()
    out = []
    for i in range(len(asked)):
        s = next(r for r in rows if (r.request, r.row) == (str(i), "status"))
        out.append(([r.id for r in sorted((r for r in rows if (r.request, r.row) == (str(i), "hop")), key=lambda r: r.place)], s.id, s.detail))
    return out


def test_traces_stop_where_they_should(spark):
    files = spark.createDataFrame([("a.js", "function go() {\n  next();\n}\nfunction next() {\n  if (event.x) return;\n}\n"), ("b.js", "function send() { }\nfunction use() { read(msg.id) }\n")], "path string, text string")
    symbols = facts.symbols(files)
    effects = spark.createDataFrame([("b.js", "network-request", "send", "integration-boundary")], "file string, kind string, symbol string, node_kind string")
    nodes = walks.trace_nodes(symbols, files, effects.where("false"))
    edges = spark.createDataFrame([("go@a.js", "next@a.js", "calls"), ("go@a.js", "send@b.js", "dependency"), ("send@b.js", "use@b.js", "calls")], "from string, to string, kind string")
    assert _traces(spark, nodes, edges, ("go@a.js", None), ("send@b.js", None), ("nowhere@a.js", None)) == [
        (["go@a.js", "next@a.js"], "BLOCKED", "if (event.x) return"), (["send@b.js", "use@b.js"], "BLOCKED", "possible-missing-field: message.id on use@b.js"), ([], "UNABLE_TO_CERTIFY", "")]
    found = walks.trace_nodes(symbols, files, effects)
    assert _traces(spark, found, edges, ("send@b.js", "network-request"), ("send@b.js", "send"), ("use@b.js", "network-request")) == [(["send@b.js"], "CERTIFIED", "network-request")] * 2 + [(["use@b.js"], "UNABLE_TO_CERTIFY", "")]
    assert _traces(spark, nodes.withColumns({"guard": F.lit(None).cast("string"), "suspects": F.lit("")}), edges, ("go@a.js", None), most_visits=1)[0][1] == "LIMITS_EXCEEDED"


def test_traces_find_any_effect_of_a_symbol_or_its_module(spark):
    """The wanted effect may be any of several, or one of the module's own."""
    files = spark.createDataFrame([("a.js", "function go() {\n  game.settings.set('a', 'b', 1); actor.update({});\n}\n"), ("m.js", "fetch('y');\nfunction quiet() {\n  1;\n}\n")], "path string, text string")
    symbols, effects = facts.symbols(files), facts.effects(files)
    none = spark.createDataFrame([], "from string, to string, kind string")
    first = sorted((r.line, r.kind) for r in effects.collect() if r.symbol == "go" and r.node_kind in ("effect-sink", "integration-boundary"))[0][1]
    asked = [("go@a.js", "settings"), ("go@a.js", "foundry-document"), ("go@a.js", "go"), ("go@a.js", None), ("quiet@m.js", "network-request"), ("quiet@m.js", "dialog"), ("quiet@m.js", None)]
    got = _traces(spark, walks.trace_nodes(symbols, files, effects), none, *asked)
    assert [g[1:] for g in got] == [("CERTIFIED", "settings"), ("CERTIFIED", "foundry-document"), ("CERTIFIED", first), ("CERTIFIED", first), ("CERTIFIED", "network-request"), ("UNABLE_TO_CERTIFY", ""), ("CERTIFIED", "")]
    unsure = walks.trace_nodes(symbols, files, effects.withColumn("reconciliation", F.lit("native-conflict")))
    assert _traces(spark, unsure, none, ("go@a.js", None)) == [(["go@a.js"], "CERTIFIED", "")]


def test_suspected_fields_that_something_mentions(spark):
    """G8d: a detail anywhere that holds the field, a path node named like an effect's symbol in any file, an effect in a path file."""
    files = spark.createDataFrame([("b.js", "function send() { }\nfunction use() { read(msg.id) }\n"), ("c.js", "")], "path string, text string")
    symbols = facts.symbols(files)
    edges = spark.createDataFrame([("send@b.js", "use@b.js", "calls")], "from string, to string, kind string")
    shape = "file string, kind string, symbol string, node_kind string, detail string, line int"
    told = lambda *rows: tuple(next(r for r in walks.trace_nodes(symbols, files, spark.createDataFrame(list(rows), shape)).collect() if r.node == "use@b.js")[c] for c in ("suspects", "told", "mentioned"))
    assert told() == told(("c.js", "hooks", "other", "entry-point", "x", 1)) == ("message.id", False, False)
    assert told(("c.js", "hooks", "other", "entry-point", "the MESSAGE.ID of", 1)) == ("message.id", True, False)
    assert told(("c.js", "hooks", "use", "entry-point", None, 1)) == told(("b.js", "hooks", "other", "entry-point", "x", 1)) == ("message.id", False, True)
    nodes = walks.trace_nodes(symbols, files, spark.createDataFrame([("c.js", "hooks", "send", "entry-point", "x", 1)], shape))
    assert _traces(spark, nodes, edges, ("send@b.js", None)) == [(["send@b.js", "use@b.js"], "CERTIFIED", "")]


def _shuffled(rows):
    """The names of the columns of each shuffle of a plan."""
    def walk(node):
        own = [[node.output().apply(i).name() for i in range(node.output().size())]] if node.nodeName() == "Exchange" else []
        return own + [x for i in range(node.children().size()) for x in walk(node.children().apply(i))]
    return walk(rows._jdf.queryExecution().executedPlan().initialPlan())


def test_trace_nodes_move_texts_once_and_no_code(spark):
    files = spark.createDataFrame([("a.js", "function go() {\n  game.settings.set('a', 'b', 1);\n}\n")], "path string, text string")
    moved = _shuffled(walks.trace_nodes(facts.symbols(files), files, facts.effects(files)))
    assert any("text" in m for m in moved) and not any("code" in m for m in moved)
    assert all(set(m) <= {"file", "text"} for m in moved if "text" in m)


def test_trace_nodes_of_odd_rows(spark):
    """Null files, names, lines and texts, a file that comes twice, a symbol named like a module; an effect of no symbol still lies in its file."""
    files = spark.createDataFrame([("a.js", "function go() {\n  1;\n}\nfunction go() {}\nvar z = msg.id;\n"), ("i.js", "var one = payload.id;\nvar two;"), ("i.js", "var one = payload.id;\nvar two;"), ("n.js", None), (None, "x"), ("e.js", "")], "path string, text string")
    symbols = spark.createDataFrame([("a.js", "go", 1), ("a.js", "go", 4), ("a.js", "z", 5), ("a.js", None, 5), ("a.js", "gone", None), (None, "go", 1), ("n.js", "go", 1), ("i.js", "one", 1), ("i.js", "two", 2), ("i.js", "<module>", 2), ("x.js", "one", 1)], "file string, name string, line int")
    effects = spark.createDataFrame([("a.js", "hooks", "go", "entry-point", 2, "s"), ("a.js", "settings", "go", "effect-sink", 3, "s"), ("a.js", "settings", "go", "effect-sink", 1, "unresolved"), ("a.js", "timer", "<module>", "effect-sink", None, "s"), ("a.js", "dialog", "<module>", "integration-boundary", 9, None), ("a.js", "chat", None, "effect-sink", 1, "s"), (None, "chat", "two", "effect-sink", 1, "s")], "file string, kind string, symbol string, node_kind string, line int, reconciliation string")
    got = sorted((r.node, r.suspects, r.mentioned, r.ends, r.raw) for r in walks.trace_nodes(symbols, files, effects).collect())
    own = ["<module>:timer", "<module>:dialog"]
    assert got == sorted([
        ("<module>@a.js", "", True, ["timer"], ["timer", "dialog", *own]), ("a.js", "message.id", True, [], own), ("go@a.js", "", True, ["settings"], ["settings", "hooks", *own]), ("z@a.js", "message.id", True, [], own),
        ("<module>@e.js", "", True, [], []), *[("<module>@i.js", "message.id", True, [], [])] * 4, *[("<module>@i.js", "", True, [], [])] * 2, *[("one@i.js", "message.id", False, [], [])] * 2, *[("two@i.js", "", True, [], [])] * 2])
    idle = walks.trace_nodes(symbols, files, effects.where("false")).collect()
    assert len(idle) == len(got) and not any(r.mentioned or r.ends or r.raw for r in idle)


def test_calls_begin_at_the_first_symbol(spark):
    files = spark.createDataFrame([("a.js", "run ();\nfunction one() {}\nfunction two() { run\n\n  (1); $run(2) }\n"), ("b.js", "function run() {}"), ("c.js", "run(); runner(); re_run()"), ("d.js", None)], "path string, text string")
    got = walks.call_edges(files, facts.symbols(files)).collect()
    assert {(r["from"], r["to"]) for r in got} == {("<module>@a.js", "run@b.js"), ("one@a.js", "run@b.js"), ("one@a.js", "one@a.js"), ("one@a.js", "two@a.js"), ("run@b.js", "run@b.js"), ("<module>@c.js", "run@b.js")}


@pytest.mark.parametrize("files", [None, 3])
def test_walks_gather_no_more_than_their_limits(spark, files):
    """On a dense graph each request gathers the edges of its walk, not the graph; slices equal those of all edges."""
    rng = random.Random(5)
    nodes = spark.createDataFrame([(f"n{i:02}", f"f{i % 9}", "s", rng.choice(("identifier", "effect-sink")), "repository-confirmed") for i in range(40)], "id string, file string, symbol string, kind string, reconciliation string")
    pairs = sorted({(rng.randrange(40), rng.randrange(40)) for _ in range(1500)})
    rows = [(f"e{rng.random():.9f}", f"n{a:02}", f"n{b:02}", "passes", "repository-confirmed") for a, b in pairs]
    edges = spark.createDataFrame(rows, "id string, from string, to string, kind string, reconciliation string")
    asked = spark.createDataFrame([(f"r{i}", f"n{i:02}") for i in range(40)], "request string, node string")
    limits = walks.Limits(nodes=9, edges=30, hops=4, files=files or 16)
    ways = edges.select("from", "to", edges.id.alias("edge"), edges.id.alias("rank"))
    got = walks.near(ways, nodes.select(nodes.id.alias("node"), "file"), asked, graph.Rounds(spark), rounds=5, most_nodes=9, most_edges=30, most_of_node=61, most_files=files)
    assert got.count() <= 40 * (30 + 9)
    ahead = [("", a, b, e, None, None, "repository-confirmed", None, None, None) for e, a, b, _, _ in rows]
    ways_of = {"forward": ahead, "both": ahead + [(*r[:1], r[2], r[1], *r[3:]) for r in ahead]}
    ends = {a for _, a, _, _, _ in rows}
    row = namedtuple("row", "request source end edge file kind reconciliation allowed target gap start needs_target")
    attributes = [("", None, r.id, None, r.file, r.kind, r.reconciliation, True, r.kind == "effect-sink" or r.id not in ends, False) for r in nodes.collect()]
    for direction in ("forward", "both"):
        out = {}
        for r in walks.slices(asked, nodes, edges, direction=direction, limits=limits).collect():
            out.setdefault(r.request, set()).add((r.row, r.id, r.detail))
        for i in range(40):
            whole = [row(f"r{i}", *r[1:], f"n{i:02}", False) for r in ways_of[direction] + attributes]
            assert {r[1:] for r in walks._slice(whole, limits)} == out[f"r{i}"]


def test_open_ends_leave_slices_partial(spark):
    nodes = spark.createDataFrame([("a", "f1", "s", "parameter", "x"), ("b", "f2", "s", "identifier", "x"), ("c", "f3", "s", "identifier", "x")], "id string, file string, symbol string, kind string, reconciliation string")
    edges = spark.createDataFrame([("1", "a", "b", "passes", "x"), ("2", "b", "c", "passes", "unresolved"), ("2", "b", "c", "passes", "unresolved")], "id string, from string, to string, kind string, reconciliation string")
    asked = spark.createDataFrame([("r", "a"), ("r", "a"), ("q", "c"), ("n", None), ("x", "gone")], "request string, node string")

    def run(edges=edges, **options):
        return {(r.request, r.row, r.id) for r in walks.slices(asked, nodes, edges, **options).collect() if r.row in ("status", "target")}
    assert run() == {("r", "status", "PARTIAL"), ("r", "target", "c"), ("q", "status", "CERTIFIED"), ("q", "target", "c"), ("x", "status", "UNABLE_TO_CERTIFY")}
    whole = edges.drop("reconciliation")
    assert ("r", "status", "CERTIFIED") in run(whole) and ("r", "status", "PARTIAL") in run(whole, gaps=spark.createDataFrame([("f3",)], "file string"))
    assert ("q", "status", "CERTIFIED") in run(whole, gaps=spark.createDataFrame([("f2",), (None,)], "file string"))
    assert run(edges.limit(0)) >= {("r", "status", "CERTIFIED"), ("r", "target", "a")}
    assert walks.slices(asked.limit(0), nodes, edges).collect() == walks.traces(asked.limit(0).withColumn("target_effect", F.lit("")), walks.trace_nodes(nodes.selectExpr("file", "symbol as name", "1 as line").limit(0), nodes.selectExpr("file as path", "'' as text").limit(0), nodes.selectExpr("file", "kind", "symbol", "kind as node_kind").limit(0)), edges).collect() == []


def test_path_trees(spark):
    from orefold.plans import atlas
    files = spark.createDataFrame([("a/b/c/x.js", "source", True), ("a/b/d/y.json", "manifest", False), ("z.bin", "asset", False), ("q/r/only.js", "source", True)], "path string, kind string, modeled boolean")
    tree = atlas.nodes(files)
    assert {r.path: (r.files, r.modeled) for r in tree.where("node = 'directory'").collect()} == {"a/b": (2, 1), "a/b/c": (1, 1), "a/b/d": (1, 0), "q/r": (1, 1)}
    assert {r.directory: r.total for r in atlas.node_counts(tree).collect()} == {"a/b": 5, "a/b/c": 2, "a/b/d": 2, "q/r": 2}
    assert [r.path for r in atlas.breadth_first(tree, 6).orderBy("place").collect()] == ["a/b", "q/r", "z.bin", "a/b/c", "a/b/d", "q/r/only.js"]
    assert {r.directory: r.omitted for r in atlas.projection(tree, 4).collect()} == {"a/b": 3, "a/b/c": 1, "q/r": 1}
    assert atlas.nodes(files.limit(0)).count() == atlas.projection(atlas.nodes(files.limit(0))).count() == 0
    odd = spark.createDataFrame([("a",), ("a/b",), ("a/b",)], "path string")
    assert {tuple(r) for r in atlas.collisions(odd).collect()} == {("a", "collision"), ("a/b", "duplicate")}


def test_chunks():
    from orefold.functions.chunks import _cut
    assert _cut("") == [("", 1, 1, False)]
    assert [(len(p), a, b, c) for p, a, b, c in _cut("x" * 9000)] == [(4000, 1, 1, False), (4000, 1, 1, True), (1000, 1, 1, True)]
    assert [(len(p), a, b, c) for p, a, b, c in _cut("\n" * 250)] == [(120, 1, 120, False), (120, 121, 240, False), (10, 241, 250, False)]


def test_facts_are_found_once_a_text(spark):
    """No filter repeats the search for matches, and few blocks of a small table are work for all tasks."""
    from orefold.sources import testdata
    files = testdata.programs(spark, "/root/testdata/sf0.001")
    for found in (facts.effects, facts.states):
        plan = found(files)._jdf.queryExecution().optimizedPlan().toString()
        assert not [line for line in plan.split("\n") if "Filter" in line and "aggregate(" in line]
    assert testdata.programs(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_crossings_are_counted_without_pairs(spark):
    from orefold.operators import linking
    rng = random.Random(7)
    for case in range(4):
        side = lambda n: [(rng.choice([f"n{i}" for i in range(12)] + [None]), rng.choice("abcde") if rng.random() < 0.9 else None) for _ in range(n)]
        p, c = side(20 * (case > 0)), [("n1", "z"), *side(25)]
        rows = lambda rows, name: spark.createDataFrame(rows, f"{name} string, contract string")
        p = [*p, ("n1", "z")] if case > 1 else p
        pairs = {(x, y) for x, k in c for y, m in p if None not in (x, y, k) and k == m and x != y}
        got = linking.crossing_counts(rows(p, "provider"), rows(c, "consumer"), "contract")
        assert [tuple(r) for r in got.select("edges", "consumers", "providers").collect()] == [(len(pairs), len({x for x, _ in pairs}), len({y for _, y in pairs}))]
    # sixteen million pairs of one contract are no rows
    many = spark.range(4000).select(F.col("id").cast("string").alias("consumer"), F.lit("k").alias("contract"))
    assert tuple(linking.crossing_counts(many.withColumnRenamed("consumer", "provider"), many, "contract").select("edges", "consumers", "providers").first()) == (4000 * 3999, 4000, 4000)


def test_either_lists_each_pair_once(spark):
    from orefold.operators import linking
    rng = random.Random(3)
    for ids in (10**6, 8):  # rows told apart by their ids, and repeated ones
        side = lambda n: [(rng.randrange(ids), rng.choice("ab"), rng.choice([1, 2, 3, None]), rng.choice([1, 2, None])) for _ in range(n)]
        a, b = side(30), side(25)
        got = linking.either(*[spark.createDataFrame(r, f"{k} int, file string, symbol int, line int") for r, k in ((a, "x"), (b, "y"))], ["file"], ["symbol", "line"], ["x", "y"])
        want = {(x[0], y[0]) for x in a for y in b if x[1] == y[1] and any(u == v is not None for u, v in zip(x[2:], y[2:]))}
        assert sorted(tuple(r) for r in got.collect()) == sorted(want)
        # told apart: pairs leave the joins as they are
        root = got._jdf.queryExecution().optimizedPlan().nodeName()
        assert (root == "Aggregate") == (ids == 8)


def test_references_are_found_once_when_resolved(spark):
    seen = spark.sparkContext.accumulator(0)

    def noted(x):
        seen.add(1)
        return x

    refs = spark.createDataFrame([("a/x.js", s, i) for i, s in enumerate(["./b.js", "./b.js", "./none.js", "lib", "", None, "/a/b.js"])], "file string, specifier string, line int").repartition(2)
    refs = refs.withColumn("specifier", F.udf(noted, "string")("specifier"))
    got = facts.resolve(refs, spark.createDataFrame([("a/b.js",), ("a/b.js",), (None,)], "path string")).select("line", "specifier", "to", "external").collect()
    assert sorted(map(tuple, got)) == [(0, "./b.js", "a/b.js", False), (1, "./b.js", "a/b.js", False), (2, "./none.js", None, False), (3, "lib", None, True), (4, "", None, False), (5, None, None, None), (6, "/a/b.js", "a/b.js", False)]
    assert seen.value == 7


def test_walks_ask_for_no_more_than_they_may_take():
    """A walk that begins with nothing asks, round by round, for nodes and edges within its limits, each edge about once, and ends as with the whole graph."""
    rng = random.Random(8)
    out = {i: sorted((f"e{rng.random():.9f}", str(rng.randrange(60)), "x") for _ in range(rng.choice((0, 2, 5, 50)))) for i in map(str, range(50))}
    node = {i: walks.Node(f"f{int(i) % 7}", "identifier", "x", not out[i], False) for i in out}
    limits = walks.Limits(nodes=12, edges=40, hops=5, files=6)
    names = [*out, *map(str, range(50, 60))]
    whole = walks.Met({i: node.get(i) for i in names}, {i: len(out.get(i, ())) for i in names}, {i: out.get(i, []) for i in names})
    for start in names:
        met, wanted, taken, rounds = walks.Met({None: None}, {}, {}), {start: limits.edges + 1}, 0, 0
        while wanted:
            assert sum(wanted.values()) <= 2 * limits.edges + len(wanted) and len(wanted) <= limits.edges + 1
            rounds += 1
            for i, n in wanted.items():
                taken += len(out.get(i, [])[:n]) - len(met.out.get(i, ()))
                met.node[i], met.degree[i], met.out[i] = node.get(i), len(out.get(i, ())), out.get(i, [])[:n]
            wanted, rows = walks._sliced(walks.Asked("r", start, None), met, limits, False)
        assert rows == walks._sliced(walks.Asked("r", start, None), whole, limits, False)[1] and rounds <= 10 and taken <= 3 * limits.edges
