"""Iterative graph queries over edge tables (from, to).

Each round is written to the shared folder and read back, which cuts the lineage; what later rounds don't need is
removed. Only counts come to the driver.
"""

from __future__ import annotations

import tempfile
import uuid
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Rounds:
    """Tables of the rounds of one query, in the folder that driver and executors share.

    That is ``spark.checkpoint.dir``. Where it is unset, a session on one machine gets a temporary folder; on a cluster
    that is an error, because executors would not see each other's files.
    """

    def __init__(self, spark: SparkSession):
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            root = "file://" + tempfile.mkdtemp(prefix="orefold-")
            spark.conf.set("spark.checkpoint.dir", root)
        self.spark, self.root, self.at = spark, f"{root.rstrip('/')}/orefold/graph-{uuid.uuid4().hex}", {}

    def save(self, df: DataFrame, *old: DataFrame) -> DataFrame:
        """The table as read back; the tables that it takes the place of are removed."""
        at = f"{self.root}/{len(self.at)}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        self.at[id(out)] = (at, out)
        self.drop(*old)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            at, _ = self.at.pop(id(t), (None, None))
            if at:
                p = self.spark._jvm.org.apache.hadoop.fs.Path(at)
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def finish(self, df: DataFrame) -> DataFrame:
        """The result as a stored table; all others are removed."""
        return self.finish_all(df)[0]

    def finish_all(self, df: DataFrame, *kept: DataFrame) -> tuple[DataFrame, ...]:
        """The result and stored tables that stay."""
        old = [t for _, t in self.at.values() if all(t is not k for k in kept)]
        return self.save(df, *old), *kept


#: Edges of a graph (some tens of bytes each) that one task handles by itself: a long chain then costs no round for each
#: of its nodes. Larger graphs take rounds over all tasks, with the same results.
FEW_EDGES = 200_000


def _pairs(frames: Iterator[pd.DataFrame]) -> list[tuple[str, str]]:
    return [(a, b) for f in frames for a, b in zip(f["from"], f["to"])]


def _strong(pairs: list[tuple[str, str]]) -> dict[str, str]:
    """The greatest node of each node's strongly connected component (depth first, with a stack of its own)."""
    out: dict[str, list[str]] = {}
    for a, b in pairs:
        out.setdefault(a, []).append(b)
        out.setdefault(b, [])
    index, low, stack, on, name = {}, {}, [], set(), {}
    for root in out:
        work = [(root, 0)] if root not in index else []
        while work:
            v, i = work.pop()
            if v not in index:
                index[v] = low[v] = len(index)
                stack.append(v)
                on.add(v)
            for k in range(i, len(out[v])):
                w = out[v][k]
                if w not in index:
                    work += [(v, k), (w, 0)]
                    break
                if w in on:
                    low[v] = min(low[v], low[w])
            else:
                if low[v] == index[v]:
                    part = [stack.pop()]
                    while part[-1] != v:
                        part.append(stack.pop())
                    on.difference_update(part)
                    name.update(dict.fromkeys(part, max(part)))
    return name


def _strong_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    name = _strong(_pairs(frames))
    many = Counter(name.values())
    rows = [(v, c) for v, c in name.items() if many[c] > 1]
    yield pd.DataFrame(rows, columns=["node", "component"], dtype=object)


def _level_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    pairs = _pairs(frames)
    name = _strong(pairs)
    up, level = {}, dict.fromkeys(name.values(), 0)
    for a, b in {(name[a], name[b]) for a, b in pairs if name[a] != name[b]}:
        up.setdefault(b, []).append(a)
    for c in _by_depth(level, up):
        for a in up.get(c, ()):
            level[a] = max(level[a], level[c] + 1)
    yield pd.DataFrame([(v, level[c]) for v, c in name.items()], columns=["node", "level"]).astype({"level": "int32"})


def _by_depth(nodes: dict[str, int], up: dict[str, list[str]]) -> list[str]:
    """Nodes in an order in which each comes after all that it depends on."""
    waiting = Counter(a for b in nodes for a in up.get(b, ()))
    order = [v for v in nodes if not waiting[v]]
    for v in order:
        for a in up.get(v, ()):
            waiting[a] -= 1
            if not waiting[a]:
                order.append(a)
    return order


def reach(edges: DataFrame, roots: DataFrame, most: int | None = None) -> DataFrame:
    """(node, hops): what the roots (column node) reach, by the fewest hops; frontiers grow by one join a round."""
    r = Rounds(edges.sparkSession)
    edges = r.save(edges.select("from", "to").distinct())
    seen = r.save(roots.select("node").distinct().withColumn("hops", F.lit(0)))
    front, hop = seen, 0
    while most is None or hop < most:
        hop += 1
        step = edges.join(front.select(F.col("node").alias("from")), "from").select(F.col("to").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("hops", F.lit(hop))
        new = r.save(step)
        if new.isEmpty():
            break
        seen, front = r.save(seen.union(new), seen, *([front] if front is not seen else [])), new
    r.drop(edges)
    return seen


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node of each undirected component, by neighbours' labels and jumps along them."""
    r = Rounds(edges.sparkSession)
    both = r.save(edges.select("from", "to").union(edges.select("to", "from")).distinct())
    label = r.save(both.groupBy(F.col("from").alias("node")).agg(F.min("to").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        near = both.join(label.withColumnRenamed("node", "to"), "to").groupBy(F.col("from").alias("node")).agg(F.min("label").alias("m"))
        step = label.join(near, "node").select("node", F.least("label", "m").alias("label"))
        jump = step.toDF("label", "far")
        new = r.save(step.join(jump, "label").select("node", F.least("label", "far").alias("label")))
        if new.join(label, ["node", "label"], "left_anti").isEmpty():
            r.drop(both, label)
            return new.withColumnRenamed("label", "component")
        r.drop(label)
        label = new


def _meet(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join of two tables that both grow with the graph: neither is sent to the driver to be broadcast, however small its file."""
    return left.join(right.hint("merge"), on, how)


def shrink(edges: DataFrame, rounds: Rounds, few: int) -> tuple[DataFrame, list[DataFrame]]:
    """(edges, passed): a graph with the same cycles, of ``few`` edges or as many as can't be left out; what was left out of its ways.

    A round leaves out all nodes without an edge in or out, which lie on no cycle, and takes nodes with one edge of each kind out of their
    way: a -> node -> b becomes a -> b (``passed``: node, a, b, a table a round). Of neighbours on such a way only those
    with the least hash go, at least a third of a long one, so a chain or ring takes as many rounds as its length has digits.
    """
    n, passed = edges.count(), []
    while n > few:
        ends = edges.select(F.col("from").alias("node"), F.col("to").alias("b"), F.lit(None).cast(edges.schema["from"].dataType).alias("a")).union(edges.select("to", F.lit(None), "from"))
        inner = ends.groupBy("node").agg(F.count("a").alias("i"), F.count("b").alias("o"), F.max("a").alias("a"), F.max("b").alias("b")).where("i > 0 and o > 0")
        inner = rounds.save(inner.select("node", ((F.col("i") == 1) & (F.col("o") == 1)).alias("thin"), "a", "b", F.xxhash64("node", F.lit(len(passed))).alias("h")))
        kept = _meet(_meet(edges, inner.select(F.col("node").alias("from")), "from", "left_semi"), inner.select(F.col("node").alias("to")), "to", "left_semi").select("from", "to")
        thin = inner.where("thin").select("node", "h")
        near = lambda end: thin.select(F.col("node").alias(end), F.struct("h", F.col("node").alias("n")).alias(f"{end}_h"))
        # both ends stay: they are no nodes of this kind, or come later in the order of hashes
        mine, last = F.struct("h", F.col("node").alias("n")), inner.select("node")
        way = _meet(_meet(inner.where("thin and a <> node").select("node", "h", "a", "b"), near("a"), "a", "left"), near("b"), "b", "left")
        way = way.where((F.col("a_h").isNull() | (mine < F.col("a_h"))) & (F.col("b_h").isNull() | (mine < F.col("b_h"))))
        way = rounds.save(_meet(_meet(way, last.withColumnRenamed("node", "a"), "a", "left_semi"), last.withColumnRenamed("node", "b"), "b", "left_semi").select("node", "a", "b"))
        gone = way.select("node")
        rest = _meet(_meet(kept, gone.withColumnRenamed("node", "from"), "from", "left_anti"), gone.withColumnRenamed("node", "to"), "to", "left_anti")
        new = rounds.save(rest.select("from", "to").union(way.where("a <> b").select(F.col("a").alias("from"), F.col("b").alias("to"))).distinct(), edges, inner)
        passed.append(way)
        was, n, edges = n, new.count(), new
        if was == n and way.isEmpty():
            break
    return edges, passed


def _widened(components: DataFrame, passed: list[DataFrame], rounds: Rounds) -> DataFrame:
    """Components (node, component) with the nodes that ``shrink`` took out of their ways: a node belongs to a component if both its neighbours do."""
    if not passed:
        return components
    components = rounds.save(components)
    for way in reversed(passed):
        of = lambda end: components.select(F.col("node").alias(end), F.col("component").alias(f"{end}_c"))  # noqa: B023, E731
        at = _meet(_meet(way, of("a"), "a", "left"), of("b"), "b", "left").withColumn("c", F.coalesce("a_c", "a")).where(F.col("c") == F.coalesce("b_c", "b"))
        # a neighbour that was in no component of two is in one now
        both = at.select(F.explode(F.array("node", "a", "b")).alias("node"), F.col("c").alias("component"))
        components = rounds.save(components.union(both).distinct())
    named = components.groupBy("component").agg(F.max("node").alias("greatest"))
    return _meet(components, named, "component").select("node", F.col("greatest").alias("component"))


def strong_components(edges: DataFrame, few: int | None = None) -> DataFrame:
    """(node, component): the greatest node of each strongly connected component of two nodes or more.

    What lies on no cycle goes first and after each component, and long ways are made short (``shrink``). Then colours: every node takes the greatest node
    that reaches it; the nodes of a colour that reach its namesake backwards are its component. What is left goes round again.
    """
    r = Rounds(edges.sparkSession)
    live = r.save(edges.select("from", "to").where("from <> to").distinct())
    bound = (FEW_EDGES if few is None else few) if live.schema["from"].dataType.simpleString() == "string" else 0
    live, passed = shrink(live, r, bound)
    if bound and not passed and live.count() <= bound:
        return live.coalesce(1).mapInPandas(_strong_rows, "node string, component string")
    return _widened(_strong_rounds(live, r, bound), passed, r)


def _strong_rounds(live: DataFrame, r: Rounds, bound: int) -> DataFrame:
    found: list[DataFrame] = []
    out = live.select(F.col("from").alias("node"), F.col("from").alias("component")).limit(0)
    while True:
        if bound and live.count() <= bound:
            found.append(live.coalesce(1).mapInPandas(_strong_rows, "node string, component string"))
            break
        if live.isEmpty():
            break
        nodes = live.select(F.col("from").alias("node")).union(live.select("to")).distinct()
        colour = r.save(nodes.withColumn("colour", F.col("node")))
        while True:
            up = _meet(live, colour.withColumnRenamed("node", "from"), "from").groupBy(F.col("to").alias("node")).agg(F.max("colour").alias("m"))
            new = r.save(_meet(colour, up, "node", "left").select("node", F.greatest("colour", F.coalesce("m", "colour")).alias("colour")))
            if _meet(new, colour, ["node", "colour"], "left_anti").isEmpty():
                break
            r.drop(colour)
            colour = new
        inner = _meet(_meet(live, colour.toDF("from", "c1"), "from"), colour.toDF("to", "c2"), "to").where("c1 = c2")
        back = inner.select(F.struct("c1", "to").alias("from"), F.struct(F.col("c1"), F.col("from").alias("to")).alias("to"))
        own = reach(back, colour.where("node = colour").select(F.struct(F.col("colour").alias("c1"), F.col("node").alias("to")).alias("node"))).select(F.col("node.to").alias("node"), F.col("node.c1").alias("component"))
        found.append(own)
        rest = _meet(_meet(live, own.select(F.col("node").alias("from")), "from", "left_anti"), own.select(F.col("node").alias("to")), "to", "left_anti")
        live, passed = shrink(r.save(rest.select("from", "to"), live, new), r, bound)
        if passed:
            found.append(_widened(_strong_rounds(live, r, bound), passed, r))
            break
    for f in found:
        out = out.union(f)
    several = out.groupBy("component").agg(F.count("*").alias("c")).where("c > 1").select("component")
    return _meet(out, several, "component").select("node", "component")


def levels(edges: DataFrame, few: int | None = None, named: DataFrame | None = None) -> DataFrame:
    """(node, level): the longest way down from a node, each cycle counted as one node; nodes that depend on nothing have 0.

    Nodes without an edge in are set aside with their edges, while that takes a good part of the edges: their level follows from the others' by one join. In what is
    left, strongly connected components (``named``, where they are known) are condensed. Then nodes without an edge out go, with the edges to
    them, round by round, so the number of rounds is that of its levels.
    """
    r = Rounds(edges.sparkSession)
    plain = r.save(edges.select("from", "to").distinct())
    bound = (FEW_EDGES if few is None else few) if plain.schema["from"].dataType.simpleString() == "string" else 0
    n, live, aside = plain.count(), plain, []
    while n > bound:
        inner = r.save(live.where("from <> to").select(F.col("to").alias("from")).distinct())
        new = r.save(_meet(live, inner, "from", "left_semi").select("from", "to"))
        was, n = n, new.count()
        if n > was - max(1, was // 8):
            r.drop(inner, new)
            n = was
            break
        aside.append(r.save(_meet(live.where("from <> to"), inner, "from", "left_anti").select("from", "to"), *([live] if live is not plain else []), inner))
        live = new
    if n == 0:
        found = r.save(live.select(F.col("from").alias("node"), F.lit(0).alias("level")))
    elif n <= bound:
        found = live.coalesce(1).mapInPandas(_level_rows, "node string, level int")
        found = r.save(found) if aside else found
    else:
        found = r.save(_peeled(live, few, named, r))
    for rows in reversed(aside):
        above = _meet(rows, found.withColumnRenamed("node", "to"), "to", "left").groupBy(F.col("from").alias("node")).agg((F.max(F.coalesce("level", F.lit(0))) + 1).alias("level"))
        found = r.save(found.union(above), found)
    if not aside:
        return found
    # what only nodes set aside depend on, and depends on nothing
    nodes = plain.select(F.col("from").alias("node")).union(plain.select("to")).distinct()
    return _meet(nodes, found, "node", "left").select("node", F.coalesce("level", F.lit(0)).alias("level"))


def _peeled(plain: DataFrame, few: int | None, named: DataFrame | None, r: Rounds) -> DataFrame:
    named = r.save(strong_components(plain, few)) if named is None else named
    of = lambda c: named.select(F.col("node").alias(c), F.col("component").alias(f"{c}_c"))
    live = r.save(_meet(_meet(plain, of("from"), "from", "left"), of("to"), "to", "left").select(F.coalesce("from_c", "from").alias("from"), F.coalesce("to_c", "to").alias("to")).where("from <> to").distinct())
    nodes = r.save(_meet(plain.select(F.col("from").alias("node")).union(plain.select("to")).distinct(), named, "node", "left").select("node", F.coalesce("component", "node").alias("c")))
    done, level = [], 0
    left = r.save(nodes.select("c").distinct())
    while not left.isEmpty():
        waiting = live.select(F.col("from").alias("c")).distinct()
        now = r.save(_meet(left, waiting, "c", "left_anti").withColumn("level", F.lit(level)))
        done.append(now)
        left = r.save(_meet(left, now, "c", "left_anti").select("c"), left)
        live = r.save(_meet(live, now.select(F.col("c").alias("to")), "to", "left_anti").select("from", "to"), live)
        level += 1
    out = done[0] if done else nodes.select("c", F.lit(0).alias("level")).limit(0)
    for d in done[1:]:
        out = out.union(d)
    return _meet(nodes, out, "c").select("node", "level")


def shortest_paths(edges: DataFrame, start: str, targets: DataFrame | None = None) -> DataFrame:
    """(node, path): the shortest undirected way from ``start``, the least in code-point order among equals.

    With ``targets`` (node) the search ends once all of them are found, so it takes as many rounds as the farthest is away.
    """
    r = Rounds(edges.sparkSession)
    both = r.save(edges.select("from", "to").union(edges.select("to", "from")).distinct())
    seen = r.save(both.where(F.col("from") == start).select(F.col("from").alias("node")).distinct().withColumn("path", F.array("node")))
    front = seen
    while not front.isEmpty() and (targets is None or not targets.join(seen, "node", "left_anti").isEmpty()):
        step = both.join(front.withColumnRenamed("node", "from"), "from").join(seen.select(F.col("node").alias("to")), "to", "left_anti")
        new = r.save(step.groupBy(F.col("to").alias("node")).agg(F.min(F.concat("path", F.array("to"))).alias("path")))
        seen, front = r.save(seen.union(new), seen, *([front] if front is not seen else [])), new
    r.drop(both)
    return seen
