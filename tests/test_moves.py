"""Plans of path moves on generated trees against plain loops."""

import posixpath
import random

import pytest

from orefold.plans import moves


def by_hand(files, edges, asked):
    """(rewrites, moved, gaps) by the rules, one file, move and import at a time."""
    norm = lambda p: posixpath.normpath(p.replace("\\", "/").lstrip("/")) if p.strip("/") else ""
    mv = [(norm(a), norm(b)) for a, b in asked]

    def remap(f, only=None):
        for a, b in only or mv:
            if f == a:
                return b
            if f.startswith(a + "/"):
                return b + f[len(a):]
        return f

    gaps, seen = set(), {}
    if not mv:
        gaps.add("move plan requires at least one move")
    for a, b in mv:
        if not a or not b or a == b:
            gaps.add(f"invalid move {a} -> {b}")
        mine = [f for f in files if f == a or f.startswith(a + "/")]
        if not mine:
            gaps.add(f"move source does not exist: {a}")
        gaps |= {f"move destination already exists: {remap(f, [(a, b)])}" for f in mine if remap(f, [(a, b)]) in files and remap(f, [(a, b)]) not in mine}
    for f in files:
        if remap(f) != f:
            if remap(f) in seen:
                gaps.add(f"multiple sources map to destination: {remap(f)}")
            seen[remap(f)] = f
    rewrites = set()
    for a, b, spec in edges:
        if not spec.startswith(".") or (remap(a) == a and remap(b) == b):
            continue
        rel = posixpath.relpath(remap(b), posixpath.dirname(remap(a)) or ".")
        rel = rel if rel.startswith(".") else "./" + rel
        if not posixpath.splitext(spec)[1]:
            rel = posixpath.splitext(rel)[0] if posixpath.splitext(rel)[1] else rel
            rel = rel[: -len("/index")] if rel.endswith("/index") else rel
            rel = "./" if rel == "." else rel
        if rel == spec:
            continue
        if not files[a]:
            gaps.add(f"importer has no text for rewrite: {a}")
            continue
        quote = next((q for q in "\"'" if f"{q}{spec}{q}" in files[a]), None)
        if quote is None:
            gaps.add(f"cannot locate quoted import specifier {spec} in {a}")
            continue
        rewrites.add((a, f"{quote}{spec}{quote}", f"{quote}{rel}{quote}", files[a].count(f"{quote}{spec}{quote}")))
    return rewrites, {(f, remap(f)) for f in files if remap(f) != f}, gaps


def tree(rng):
    dirs = ["src", "src/a", "src/a/b", "lib", "lib/c"]
    files = {f"{rng.choice(dirs)}/{rng.choice('fgh')}{n}.js": "" for n in range(14)} | {"lib/c/index.js": "", "src/a/x.ts": None}
    edges = []
    for a in list(files):
        for b in rng.sample(sorted(files), 3):
            spec = posixpath.relpath(b, posixpath.dirname(a))
            spec = spec if spec.startswith(".") else "./" + spec
            spec = spec if rng.random() < 0.7 else posixpath.splitext(spec)[0]
            edges.append((a, b, spec))
            quote = rng.choice("\"'`")
            files[a] = None if files[a] is None else files[a] + f"import {quote}{spec}{quote};\n" * rng.choice((1, 2))
    edges.append((edges[0][0], "lib/c/index.js", "lodash"))
    return files, edges


@pytest.mark.parametrize("asked", [
    [("src/a", "core/a"), ("lib/c/index.js", "lib/d/index.js")],
    [("src", "lib"), ("lib", "src")],  # a swap
    [("src/a", "src/z"), ("src/z", "src/q"), ("src/a/b", "never")],  # a chain: each file goes by the first move of it
    [("src/a", "lib/c"), ("", "x"), ("gone", "x"), ("lib", "lib"), ("./src//a/b/", "\\one")],
    [],
])
def test_plans_match_plain_loops(spark, asked):
    files, edges = tree(random.Random(11))
    m = {"files": spark.createDataFrame(list(files.items()), "path string, text string"), "dependencies": spark.createDataFrame(edges + edges[:3], "from string, to string, specifier string")}
    p = moves.plan(m, spark.createDataFrame([(i, *a) for i, a in enumerate(asked)], "pos int, source string, target string"))
    rewrites, moved, gaps = by_hand(files, edges, asked)
    assert {tuple(r) for r in p.rewrites.collect()} == rewrites and p.rewrites.count() == len(rewrites)
    assert {tuple(r) for r in p.moved.collect()} == moved
    assert {r.gap for r in p.gaps.collect()} == gaps
    assert {r.path for r in p.affected().collect()} == {a for a, _ in moved} | {r[0] for r in rewrites}
    assert [r.type for r in p.edits.orderBy("place").collect()] == ["replace_exact"] * len(rewrites) + ["move_file"] * len(asked)
