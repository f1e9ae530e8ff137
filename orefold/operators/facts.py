"""Facts of source files, each file's found in its own row (C1-C14, C24, A14, D1, D2): no shuffle before facts are linked.

``files`` tables have path and text. A file's facts are arrays until they are exploded, so owners and constants meet
their uses inside a row and no join by file is needed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orefold.functions import paths, source, text

# Fixed values (C1-C5): endings of programs, styles and templates; manifests and their lists; patterns of references and symbols, their groups, and words of which one is in every match.
PROGRAMS = (".js", ".mjs", ".cjs", ".jsx", ".ts", ".tsx", ".mts", ".cts")
STYLES = (".css", ".scss")
TEMPLATES = (".html", ".hbs", ".handlebars")
MANIFESTS = ("module.json", "system.json")
MANIFEST_LISTS = ("scripts", "esmodules", "styles")
REFERENCES = (
    ("import", r"""(?s)\bimport\s+(?!\()(?:(?!;).)*?\bfrom\s*["']([^"']+)["']""", (1,), ("import",)),
    ("side-effect-import", r"""\bimport\s*["']([^"']+)["']""", (1,), ("import",)),
    ("export-from", r"""(?s)\bexport\s+(?:(?!;).)*?\bfrom\s*["']([^"']+)["']""", (1,), ("export",)),
    ("dynamic-import", r"""\bimport\s*\(\s*["']([^"']+)["']\s*\)""", (1,), ("import",)),
    ("require", r"""\brequire\s*\(\s*["']([^"']+)["']\s*\)""", (1,), ("require",)),
)
STYLE_REFERENCE = ("style-import", r"""(?i)@(?:import|use|forward)\s+(?:url\(\s*)?["']([^"']+)["']\s*\)?""", (1,))
TEMPLATE_REFERENCE = ("template-reference", r"""(?i)(?:src|href)\s*=\s*["']([^"']+)["']""", (1,))
SYMBOLS = (
    ("function", r"(?:^|\n)\s*(export\s+)?(?:default\s+)?(?:async\s+)?function\s+([A-Za-z_$][\w$]*)\s*\(", (1, 2), ("function",)),
    ("class", r"(?:^|\n)\s*(export\s+)?(?:default\s+)?class\s+([A-Za-z_$][\w$]*)\b", (1, 2), ("class",)),
    ("variable", r"(?:^|\n)\s*(export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=", (1, 2), ("const", "let", "var")),
)
# Fixed values (C7): effects by kind, label, kind of node, kind of edge, pattern, and words of which one is in every match.
EFFECTS = (
    ("foundry-document", "Foundry document mutation", "effect-sink", "mutates-document", r"\b(?:actor|item|token|document|combat|scene)\s*\.\s*(?:update|delete|createEmbeddedDocuments|updateEmbeddedDocuments|deleteEmbeddedDocuments)\s*\(", ("update", "delete", "EmbeddedDocuments")),
    ("embedded-documents", "Embedded document mutation", "effect-sink", "mutates-document", r"\b(?:createEmbeddedDocuments|updateEmbeddedDocuments|deleteEmbeddedDocuments)\s*\(", ("EmbeddedDocuments",)),
    ("settings", "Settings mutation or registration", "effect-sink", "writes-state", r"\bgame\s*\.\s*settings\s*\.\s*(?:set|register)\s*\(", ("settings",)),
    ("hooks", "Foundry hook registration", "entry-point", "registers", r"\bHooks\s*\.\s*(?:on|once)\s*\(", ("Hooks",)),
    ("hooks", "Foundry hook emission", "observation-point", "emits", r"\bHooks\s*\.\s*(?:call|callAll)\s*\(", ("Hooks",)),
    ("hooks", "Foundry hook unregistration", "runtime-operation", "invokes-callback", r"\bHooks\s*\.\s*off\s*\(", ("Hooks",)),
    ("chat-output", "Chat output", "observation-point", "observed-by", r"\bChatMessage\s*\.\s*create\s*\(", ("ChatMessage",)),
    ("notifications", "User notification", "observation-point", "observed-by", r"\bui\s*\.\s*notifications\s*\.\s*(?:info|warn|error)\s*\(", ("notifications",)),
    ("canvas-token", "Canvas or token mutation", "effect-sink", "mutates-document", r"\b(?:canvas\s*\.\s*tokens|token\s*\.\s*document)\b[\s\S]{0,80}?\.\s*(?:setTarget|control|release|update)\s*\(", ("setTarget", "control", "release", "update")),
    ("application-lifecycle", "Application lifecycle operation", "effect-sink", "crosses-integration-boundary", r"\b(?:FrameConnApplication|application|app)\s*\.\s*(?:render|close)\s*\(", ("render", "close")),
    ("native-execution", "Native execution boundary", "integration-boundary", "delegates-native", r"\b(?:(?:execute|run|roll)Native(?![A-Za-z0-9_$]*(?:Verification|Verifier|Probe|Check)\b)[A-Za-z0-9_$]*)\s*\(", ("Native",)),
    ("network-request", "Network request", "integration-boundary", "crosses-integration-boundary", r"\b(?:fetch|axios\s*\.\s*(?:get|post|put|patch|delete))\s*\(", ("fetch", "axios")),
    ("timer", "Scheduled callback", "entry-point", "registers", r"\b(?:setTimeout|setInterval|queueMicrotask)\s*\(", ("setTimeout", "setInterval", "queueMicrotask")),
    ("event-emission", "Event emission", "observation-point", "emits", r"\.\s*emit\s*\(", ("emit",)),
)
# Fixed values (C9-C13): accesses of states by kind, pattern, groups (operation or namespace, then what is accessed) and words of which one is in every match.
STATES = (
    ("foundry-flag", r"\.\s*(getFlag|setFlag|unsetFlag)\s*\(\s*([^,\n)]+)\s*,\s*([^,\n)]+)(?:\s*,|\s*\))", (1, 2, 3), ("Flag",)),
    ("foundry-setting", r"\bgame\s*\.\s*settings\s*\.\s*(register|get|set)\s*\(\s*([^,\n)]+)\s*,\s*([^,\n)]+)(?:\s*,|\s*\))", (1, 2, 3), ("settings",)),
    ("web-storage", r"\b(localStorage|sessionStorage)\s*\.\s*(getItem|setItem|removeItem)\s*\(\s*([^,\n)]+)(?:\s*,|\s*\))", (1, 2, 3), ("Storage",)),
    ("public-global", r"\b(game|globalThis)\s*\.\s*([A-Za-z_$][\w$]*)\s*=", (1, 2), ("game", "globalThis")),
    ("flag-path", r"flags\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_.-]+)", (1, 2), ("flags.",)),
)
ACCESS = {"getFlag": "read", "setFlag": "write", "unsetFlag": "delete", "get": "read", "set": "write", "register": "write", "getItem": "read", "setItem": "write", "removeItem": "delete", "assign": "write", "path-reference": "unknown"}
MODULE = "<module>"


def _is(ending: Column, endings: tuple[str, ...]) -> Column:
    return ending.isin(*endings)


def _none() -> Column:
    return F.array().cast(source.MATCHES)


def _texts(files: DataFrame) -> DataFrame:
    """Files that have a text, with their ending."""
    return files.where("text is not null").select("path", "text", paths.extension(F.col("path")).alias("ending"))


def dependencies(files: DataFrame) -> DataFrame:
    """(file, kind, specifier, line): what each file refers to, each (kind, specifier, line) once.

    Programs without comments by REFERENCES, styles, templates, and the lists of manifests (line 1; what isn't JSON has none).
    """
    f = _texts(files)
    name = F.lower(F.substring_index("path", "/", -1))
    json = F.try_parse_json("text")
    listed = F.concat(*[F.coalesce(F.filter(F.try_variant_get(json, f"$.{k}", "array<variant>"), lambda v: F.schema_of_variant(v) == "STRING"), F.array().cast("array<variant>")) for k in MANIFEST_LISTS])
    manifest = F.transform(listed, lambda v: F.struct(F.lit("manifest-reference").alias("kind"), F.lit(1).alias("line"), F.lit("").alias("whole"), F.try_variant_get(v, "$", "string").alias("a"), F.lit(None).cast("string").alias("b"), F.lit(None).cast("string").alias("c")))
    ending = F.col("ending")
    of = lambda which, *patterns: source.all_matches(F.when(which, F.col("text")), patterns)
    program, style, page = _is(ending, PROGRAMS), _is(ending, STYLES), _is(ending, TEMPLATES)
    found = (F.when(program, source.all_matches(F.when(program, F.col("text")), (), REFERENCES, program)).when(style, of(style, STYLE_REFERENCE))
             .when(page, of(page, TEMPLATE_REFERENCE)).when(name.isin(*MANIFESTS), manifest.cast(source.MATCHES)).otherwise(_none()))
    refs = F.array_distinct(F.transform(found, lambda m: F.struct(m["kind"].alias("kind"), m["a"].alias("specifier"), m["line"].alias("line"))))
    return f.select(F.col("path").alias("file"), F.explode(refs).alias("r")).select("file", "r.*")


def _symbols(found: Column, compat_lines: bool) -> Column:
    """Symbols of a program, from their matches, in order of line and name, as (line, name, kind, exported)."""
    skip = lambda m: F.lit(0) if compat_lines else source.breaks(m["whole"]) - source.breaks(F.ltrim(m["whole"], F.lit(" \t\n\x0b\f\r")))
    rows = F.transform(found, lambda m: F.struct((m["line"] + skip(m)).alias("line"), m["b"].alias("name"), m["kind"].alias("kind"), (m["a"] != "").alias("exported")))
    return F.sort_array(rows)


def symbols(files: DataFrame, compat_lines: bool = False) -> DataFrame:
    """(file, name, kind, exported, line) of declarations at the start of a line.

    The line is the declaration's own. With ``compat_lines`` it is that of the line break or blank line before it.
    """
    f = _texts(files).where(_is(F.col("ending"), PROGRAMS))
    found = source.all_matches(F.col("text"), (), SYMBOLS, F.lit(True))
    return f.select(F.col("path").alias("file"), F.explode(_symbols(found, compat_lines)).alias("s")).select("file", "s.name", "s.kind", "s.exported", "s.line")


def owner_of(known: Column, line: Column) -> Column:
    """The last symbol, in order, that begins at or before a line."""
    return F.coalesce(F.try_element_at(F.filter(known, lambda s: s["line"] <= line), F.lit(-1))["name"], F.lit(MODULE))


def effects(files: DataFrame, compat_lines: bool = False) -> DataFrame:
    """(file, kind, detail, line, symbol, node_kind, edge_kind, symbol_line) of each place in a whole text (comments too) that an effect's pattern matches.

    Patterns overlap, so one place may have several effects. ``symbol_line`` is the first line of a symbol of the owner's name.
    """
    every = source.all_matches(F.col("text"), [(str(i), p[4], (), p[5]) for i, p in enumerate(EFFECTS)], SYMBOLS, _is(F.col("ending"), PROGRAMS))
    f = _texts(files).select("path", every.alias("every"))
    names = [p[0] for p in SYMBOLS]
    known, found = _symbols(F.filter("every", lambda m: m["kind"].isin(*names)), compat_lines), F.filter("every", lambda m: ~m["kind"].isin(*names))
    # both as one generated row: the optimizer would repeat an expression in a filter (also one that it infers) below the tables' own columns
    rows = f.select(F.col("path").alias("file"), F.explode(F.array(F.struct(known.alias("known"), found.alias("found")))).alias("x")).select("file", F.col("x.known").alias("known"), F.explode("x.found").alias("m"))
    of = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("kind", "detail", "node_kind", "edge_kind"), p)]) for p in EFFECTS])
    rows = rows.select("file", "known", F.col("m.line").alias("line"), F.get(of, F.col("m.kind").cast("int")).alias("e"), owner_of(F.col("known"), F.col("m.line")).alias("symbol"))
    first = F.get(F.filter("known", lambda s: s["name"] == F.col("symbol")), F.lit(0))["line"]
    return rows.select("file", "e.kind", "e.detail", "line", "symbol", "e.node_kind", "e.edge_kind", F.coalesce(first, "line").alias("symbol_line"))


def runtime_graph(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of effects: each place, its owner's operation (or an unresolved one), and the edge between them.

    Of rows with one id the last place counts; ids are those of B70.
    """
    own = F.col("symbol") != MODULE
    cast = lambda c: F.col(c).cast("string")
    ids = found.select("*", text.stable_id("runtime-node", F.col("file"), F.col("node_kind"), F.col("kind"), cast("line"), F.col("symbol"), F.col("detail")).alias("node"),
                       F.when(own, text.stable_id("runtime-operation", F.col("file"), F.col("symbol"))).otherwise(text.stable_id("runtime-unresolved", F.col("file"), F.col("kind"), cast("line"))).alias("op"))
    label = lambda yes, no: F.when(own, yes).otherwise(no)
    place = F.struct(F.col("node").alias("id"), F.col("node_kind").alias("kind"), F.col("kind").alias("effect_kind"), "file", "symbol", F.col("line").alias("line_start"), F.col("line").alias("line_end"), "detail", label("lexically-associated", "pattern-detected").alias("confidence"))
    op = F.struct(F.col("op").alias("id"), label("runtime-operation", "unresolved-runtime-site").alias("kind"), label(F.lit("symbol-operation"), F.col("kind")).alias("effect_kind"), "file", "symbol", label(F.col("symbol_line"), F.col("line")).alias("line_start"), F.col("line").alias("line_end"),
                  label(F.concat(F.lit("Runtime operation "), "symbol"), F.concat(F.lit("Owner unresolved for "), "detail")).alias("detail"), label("lexically-associated", "unresolved").alias("confidence"))
    rows = ids.select(F.explode(F.array(place, op)).alias("n")).select("n.*")
    rest = [c for c in rows.columns if c != "id"]
    nodes = rows.groupBy("id").agg(F.max_by(F.struct(*rest), F.struct("line_end", "detail")).alias("r")).select("id", "r.*")
    kind = label(F.col("edge_kind"), F.lit("unresolved-runtime-link"))
    edges = ids.select(text.stable_id("runtime-edge", F.col("op"), kind, F.col("node")).alias("id"), kind.alias("kind"), F.col("op").alias("from"), F.col("node").alias("to"), "file", "line", label("lexically-associated", "unresolved").alias("confidence"))
    return nodes, edges.dropDuplicates(["id"])


def states(files: DataFrame) -> DataFrame:
    """(file, kind, namespace, key, operation, access, namespace_resolved, key_resolved, line): flags, settings, web storage, globals, flag paths."""
    m = F.col("m")
    both = F.struct(source.constants(F.col("text")).alias("known"), source.all_matches(F.col("text"), STATES).alias("found"))  # once a text, not a match
    found = files.where("text is not null").select(F.col("path").alias("file"), F.explode(F.array(both)).alias("x")).select("file", F.col("x.known").alias("known"), F.explode("x.found").alias("m"))
    storage, plain = m["kind"] == "web-storage", m["kind"].isin("public-global", "flag-path")
    known = F.struct(F.when(plain | storage, m["a"]).otherwise("").alias("value"), F.lit(True).alias("resolved"))
    ns = F.when(plain | storage, known).otherwise(source.resolve_token(m["b"], F.col("known")))
    key = F.when(plain, F.struct(m["b"].alias("value"), F.lit(True).alias("resolved"))).otherwise(source.resolve_token(m["c"], F.col("known")))
    operation = F.when(m["kind"] == "public-global", "assign").when(m["kind"] == "flag-path", "path-reference").when(storage, m["b"]).otherwise(m["a"])
    access = F.create_map(*[F.lit(x) for pair in ACCESS.items() for x in pair])
    rows = found.select("file", m["kind"].alias("kind"), ns.alias("ns"), key.alias("key"), operation.alias("operation"), m["line"].alias("line"))
    return rows.select("file", "kind", F.col("ns.value").alias("namespace"), F.col("key.value").alias("key"), "operation", access[F.col("operation")].alias("access"), F.col("ns.resolved").alias("namespace_resolved"), F.col("key.resolved").alias("key_resolved"), "line")


def resolve(refs: DataFrame, files: DataFrame) -> DataFrame:
    """Refs (file, kind, specifier, line) with (to, external): the first candidate that is a file; null where none is.

    A specifier that begins with "." has the candidates of B7; one that begins with "/" is a path itself; any other, and a path
    that is no file, is external. Candidates of distinct (file, specifier) become rows for one equi-join; the refs of each ride on its first candidate,
    so what finds them in texts runs once.
    """
    spec = F.trim("specifier")
    tries = F.when(spec.startswith("."), paths.candidates(F.col("file"), spec)).when(spec.startswith("/"), F.filter(F.array(paths.normalize(spec)), lambda p: p != "")).otherwise(F.array().cast("array<string>"))
    rest = [c for c in refs.columns if c not in ("file", "specifier")]
    asked = refs.groupBy("file", "specifier").agg(F.collect_list(F.struct(F.lit(True).alias("_row"), *rest)).alias("_rows"))
    asked = asked.select("file", "specifier", "_rows", F.posexplode_outer(tries).alias("pos", "path")).withColumn("_rows", F.when(F.coalesce("pos", F.lit(0)) == 0, F.col("_rows")))
    known = files.select("path").where("path is not null").distinct().withColumn("_is", F.lit(True))
    hits = asked.join(known, "path", "left").groupBy("file", "specifier").agg(F.first("_rows", ignorenulls=True).alias("_rows"), F.min(F.when(F.col("_is"), F.struct("pos", "path"))).alias("_to"))
    out = hits.select("file", "specifier", F.explode("_rows").alias("_r"), F.col("_to.path").alias("to")).select("file", "specifier", *[F.col(f"_r.{c}") for c in rest], "to")
    return out.withColumn("external", F.col("to").isNull() & ~spec.startswith(".") & (spec != ""))


class Model(Mapping):
    """Fact tables by name, each made when it is first asked for."""

    def __init__(self, makers: Mapping[str, Callable[[Model], DataFrame]]):
        self._makers, self._made = dict(makers), {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._makers[name](self)
        return self._made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)


def model(files: DataFrame, compat_lines: bool = False, keep: Callable[[DataFrame], DataFrame] = lambda table: table) -> Model:
    """All fact tables of the files that have a text, by name.

    Only what a query asks for is computed; where several of its parts use the facts, ``keep`` (as graph.Rounds.save) stores
    references, symbols, effects and states once, when they are first asked for.
    """
    return Model({
        "files": lambda m: files, "references": lambda m: keep(resolve(dependencies(files), files)), "dependencies": lambda m: m["references"].where("to is not null").withColumnRenamed("file", "from"),
        "unresolved": lambda m: m["references"].where("to is null").drop("to"), "symbols": lambda m: keep(symbols(files, compat_lines)), "effects": lambda m: keep(effects(files, compat_lines)),
        "runtime_nodes": lambda m: runtime_graph(m["effects"])[0], "runtime_edges": lambda m: runtime_graph(m["effects"])[1], "states": lambda m: keep(states(files))})
