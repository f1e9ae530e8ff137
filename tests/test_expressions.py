"""Expressions on cases by hand; the queries run them over whole columns."""

from pyspark.sql import functions as F

from orefold.functions import paths, source, text
from orefold.operators import facts
from orefold.plans import policy

C = F.col


def check(spark, inputs, results, expressions, rows):
    """The expressions over each row's inputs give its results."""
    kinds = lambda i: "string" if any(isinstance(r[i], str) for r in rows) else "boolean" if any(isinstance(r[i], bool) for r in rows) else "int"
    df = spark.createDataFrame([r[: len(inputs)] for r in rows], ", ".join(f"{n} {kinds(i)}" for i, n in enumerate(inputs)))
    got = df.select(*[e.alias(n) for n, e in zip(results.split(), expressions())]).collect()
    assert [tuple(r) for r in got] == [r[len(inputs):] for r in rows]


def test_name_hint_b28(spark):
    check(spark, ["prefix"], "hint region", lambda: [paths.name_hint(C("prefix"), F.lit("me/my-repo")), F.length(text.region_id(F.lit("me/my-repo"), C("prefix")))], [
    ("", "my-repo", 30), ("src/data-flow_x", "Data Flow X", 35), ("a/b c", "B C", 25), ("lib", "Lib", 23)])


def test_text_terms_b22(spark):
    check(spark, ["t"], "flat terms catalog key", lambda: [text.normalize(C("t")), F.array_join(text.terms(C("t"), text.TRACE_STOP), ","), F.array_join(text.catalog_terms(F.array(C("t"))), ","), text.group_key(C("t"))], [
    ("fixTheActorUpdate", "fix the actor update", "fix,actor,update", "fixtheactorupdate", "fix-actor"), ("roll_dice/now", "roll dice now", "roll,dice,now", "roll_dice,now", "roll-dice"),
    ("the bug", "the bug", "", "the,bug", "bug"), ("doTheUpdate", "do the update", "update", "dotheupdate", "misc")])


def test_bounded_b30(spark):
    check(spark, ["t"], "short raw around bytes", lambda: [text.bounded(C("t"), 5), text.bounded(C("t"), 5, False), text.snippet(F.lit("name"), C("t")), text.first_bytes(C("t"), 4)], [
    ("a  b", "a b", "a  b", "a  b", "a  b"), ("abcdefg", "abcde…", "abcde…", "abcdefg", "abcd"), ("x" * 130 + "name" + "y" * 300, "xxxxx…", "xxxxx…", "x" * 120 + "name" + "y" * 276, "xxxx"), ("z" * 500, "zzzzz…", "zzzzz…", "z" * 400, "zzzz")])


def test_call_names_b40(spark):
    check(spark, ["t"], "root simple state sink callbacks lifecycle index", lambda: [text.call_root(C("t")), text.simple_name(C("t")), text.state_operation(C("t")), text.effect_sink(C("t")), text.takes_callbacks(C("t")), text.lifecycle_event(C("t")), text.argument_index(C("t"))], [
    ("game.settings.get", "game", "get", "read", False, False, False, None), ("a[0].setFlag", "a", "setFlag", "write", False, False, False, None), ("token.update", "token", "update", None, True, False, False, None), ("list.map", "list", "map", None, False, True, False, None),
    ("Ready", "Ready", "Ready", None, False, False, True, None), ("renderChat", "renderChat", "renderChat", None, False, False, True, None), ("register", "register", "register", None, False, True, False, None)])


def test_levels_b55(spark):
    check(spark, ["label", "n", "m"], "crossed gain seam claim clamp", lambda: [text.cross_map(C("label")), text.information_gain(C("n")), text.seam_confidence(C("m")), text.claim_confidence(C("m"), C("n"), C("label") == "x"), F.round(text.confidence(C("n")), 6)], [
    ("repository-only", 3, 1, "cross-map-confirmed", "low", "high", 0.75, 0.2), ("x", 30, 2, "x", "medium", "medium", 0.78, 1.0), ("native-conflict", 60, 9, "native-conflict", "high", "low", 0.95, 1.0), ("x", 12, 0, "x", "low", "high", 0.66, 0.5)])


def test_plan_ids_b75(spark):
    check(spark, ["t"], "h", lambda: [text.fnv1a(C("t"))], [("a", "e40c292c"), ("", "811c9dc5"), ("foobar", "bf9cf968")])


def test_transaction_k6(spark):
    check(spark, ["failed", "committed", "same"], "state", lambda: [policy.transaction_state(C("failed"), C("committed"), C("same"))], [(False, False, False, "STAGED"), (True, False, False, "ABORTED"), (False, True, True, "COMMITTED"), (False, True, False, "VALIDATED")])


def test_compact_json_b51(spark):
    long = "é" * 241
    check(spark, ["t"], "short", lambda: [policy.compact_json(C("t"))], [
        ('{"b": [1, 2.5, true, null, "x", [], {}, -7, 9], "a": {"d": {"e": {"f": 1}, "g": [1, [2, 3]]}}}', '{"a":{"d":{"e":"[object]","g":"[2 items]"}},"b":[1,2.5,true,null,"x",[],{},-7]}'),
        ("[[[[1, 2]]], [[{}]]]", '[[["[2 items]"]],[["[object]"]]]'), ('"a\\"b\\n"', '"a\\"b\\n"'), (f'"{long}"', f'"{long[:240]}…"'), ("null", "null"), ("7", "7"), ("no json", None), (None, None),
        ("{" + ",".join(f'"k{i:02}": {i}' for i in reversed(range(12))) + "}", "{" + ",".join(f'"k{i:02}":{i}' for i in range(10)) + "}"), ('{"q\\"": {"x": 1}}', '{"q\\"":{"x":1}}')])


def test_matches_of_long_and_odd_texts_b21(spark):
    """An import of very many lines, texts without any word that a pattern needs, nulls, comments of several lines, groups that take no part."""
    far = 'import {\n' + "a,\n" * 40_000 + '} from "far";'
    rows = [(1, far, True), (2, "", True), (3, None, True), (4, "/* é\nfunction no() {} */ x\n\n  export class A {}\nlet b = '// \\' const c';", True), (5, "class A {}", False), (6, "let a = 1\rlet b = 2\nlet c = 3", None)]
    df = spark.createDataFrame(rows, "i int, t string, code boolean")
    found = source.all_matches(C("t"), facts.REFERENCES, facts.SYMBOLS, C("code"))
    got = {r.i: [(m.kind, m.line, m.a, m.b, m.c) for m in r.m] for r in df.select("i", found.alias("m")).collect()}
    assert got == {1: [("import", 1, "far", None, None)], 2: [], 3: [], 4: [("class", 2, "export ", "A", None), ("variable", 4, "", "b", None)], 5: [], 6: []}
    blank = df.where("i = 4").select(source.blank_comments(C("t"))).first()[0]
    assert blank.split("\n")[:2] == ["    ", " " * 19 + " x"] and blank.endswith("let b = '// \\' const c';")


def test_words_that_patterns_need(spark):
    """What a pattern matches holds one of its words, so skipping texts without them skips no match."""
    hits = {"foundry-document": "actor.update(", "embedded-documents": "deleteEmbeddedDocuments (", "settings": "game.settings.register(", "hooks": "Hooks.on(Hooks.call(Hooks.off(", "chat-output": "ChatMessage.create(", "notifications": "ui.notifications.warn(",
            "canvas-token": "canvas.tokens.x.release(", "application-lifecycle": "app.close(", "native-execution": "rollNativeX(", "network-request": "axios.put(", "timer": "queueMicrotask(", "event-emission": "a.emit("}
    files = spark.createDataFrame([(f"{k}.txt", v) for k, v in hits.items()], "path string, text string")
    got = {(r.file, r.kind) for r in facts.effects(files).collect()}
    assert {(f"{k}.txt", k) for k in hits} <= got and ("embedded-documents.txt", "foundry-document") not in got
    said = spark.createDataFrame([("a.txt", "a.unsetFlag(x, y) game.settings.get(p, q) sessionStorage.getItem(z) globalThis.b = 1; flags.m.k")], "path string, text string")
    assert {r.kind for r in facts.states(said).collect()} == {p[0] for p in facts.STATES}
