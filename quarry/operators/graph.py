"""Graph operators as loops of joins. Rounds are cut by written tables, so lost executors cost one round."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import Rounds, discard, written

#: Steps of a loop that one written table takes.
LEVELS = 3


def reach(edges: DataFrame, seeds: DataFrame, depth: int | None = None, hub: int | None = None) -> DataFrame:
    """(seed, node, depth) by breadth-first rounds; the seed itself only if a cycle leads back to it.

    Nodes with more than ``hub`` edges are reached but not expanded after the first step.
    """
    e = written(edges.select("src", "dst").distinct())  # each round reads them
    if hub is not None:
        busy = e.groupBy("src").agg(F.count("*").alias("n")).where(F.col("n") > hub).select("src")
    rounds, step = Rounds(edges.sparkSession), 1
    first = seeds.select("seed").distinct().join(e, F.col("seed") == F.col("src")).select("seed", F.col("dst").alias("node")).distinct()
    frontier = rounds.add(first.withColumn("depth", F.lit(step)))
    while (depth is None or step < depth) and not frontier.isEmpty():
        step += 1
        grow = frontier if hub is None else frontier.join(busy, frontier["node"] == busy["src"], "left_anti")
        new = grow.join(e, grow["node"] == e["src"]).select("seed", F.col("dst").alias("node")).distinct()
        frontier = rounds.add(new.join(rounds.table(), ["seed", "node"], "left_anti").withColumn("depth", F.lit(step)))
    discard(e)
    return rounds.table()


def closure(edges: DataFrame) -> DataFrame:
    """(src, dst) of the transitive closure."""
    return reach(edges, edges.select(F.col("src").alias("seed"))).select(F.col("seed").alias("src"), F.col("node").alias("dst"))


def shortest_path(edges: DataFrame, source, target, depth: int | None = None) -> DataFrame:
    """(path, hops) of a shortest path, the first in order of nodes; with ``depth``, of at most so many hops."""
    e = edges.select("src", "dst").distinct()
    rounds = Rounds(edges.sparkSession)
    frontier = rounds.add(e.where(F.col("src") == source).groupBy("dst").agg(F.min(F.array("src", "dst")).alias("path")).select(F.col("dst").alias("node"), "path"))
    for _ in count() if depth is None else range(depth - 1):
        if frontier.isEmpty() or not frontier.where(F.col("node") == target).isEmpty():
            break
        step = frontier.join(e, frontier["node"] == e["src"]).select(F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        frontier = rounds.add(step.groupBy("node").agg(F.min("path").alias("path")).join(rounds.table(), "node", "left_anti"))
    return rounds.table().where(F.col("node") == target).select("path", (F.size("path") - 1).alias("hops"))


def _spread(start: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, color): the smallest color that reaches each node along the edges, from (node, color)."""
    before = start_table = None
    while True:
        for _ in range(LEVELS):
            pushed = start.join(edges, start["node"] == edges["src"]).select(F.col("dst").alias("node"), "color")
            start = start.union(pushed).groupBy("node").agg(F.min("color").alias("color"))
        old, start = start_table, written(start)
        start_table = start
        discard(*[x for x in [old] if x is not None])
        state = start.agg(F.count("*"), F.sum(F.xxhash64("node", "color").cast("decimal(38,0)"))).first()
        if state == before:
            return start
        before = state


def components(edges: DataFrame) -> DataFrame:
    """(node, component): strongly connected components, named by their smallest node.

    Colouring in both directions: every node takes the first node, in the order of a hash, that reaches it, and the first that it
    reaches. Where both are one node, that node's component is found; edges between nodes that differ in either go, since no
    component holds both ends. So parts of a chain of components are worked on at once. Nodes without edges in or out of what is left are components
    of their own and trimmed, two layers a round. Rows never exceed twice the edges and nodes.
    """
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).where("node is not null").distinct()
    left = written(edges.select("src", "dst").where("src <> dst").distinct())
    found = None
    while True:
        old = left
        for _ in range(2):
            ends = left.select(F.col("src").alias("node")).intersect(left.select(F.col("dst").alias("node")))
            left = left.join(ends.select(F.col("node").alias("src")), "src", "left_semi").join(ends.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst")
        left = written(left)
        discard(old)
        if left.isEmpty():
            break
        way = lambda node, back: F.struct(F.col(node).alias("node"), F.lit(back).alias("back"))
        both = left.select(way("src", False).alias("src"), way("dst", False).alias("dst")).union(left.select(way("dst", True).alias("src"), way("src", True).alias("dst")))
        first = F.struct(F.xxhash64("src.node").alias("p"), F.col("src.node").alias("root"))
        color = _spread(both.select(F.col("src").alias("node"), first.alias("color")).distinct(), both)
        pair = color.groupBy("node.node").agg(F.max(F.when(F.col("node.back"), F.col("color.root"))).alias("to"), F.max(F.when(~F.col("node.back"), F.col("color.root"))).alias("from"))
        pair = written(pair)
        same = pair.where("from = to")
        done = same.join(same.groupBy("to").agg(F.min("node").alias("component")), "to").select("node", "component")
        found = done if found is None else found.union(done)
        open_ = pair.where("from <> to").select("node", F.struct("from", "to").alias("pair"))
        left = written(left.join(open_.toDF("src", "a"), "src").join(open_.toDF("dst", "b"), "dst").where("a = b").select("src", "dst"))
    if found is None:
        return nodes.select("node", F.col("node").alias("component"))
    return nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def cycles(edges: DataFrame) -> DataFrame:
    """(component, node) of the nodes on cycles: those of components of several nodes, and those with an edge to themselves."""
    scc = written(components(edges))
    own = edges.where("src = dst").select(F.col("src").alias("node")).distinct().withColumn("own", F.lit(True))
    size = scc.groupBy("component").agg(F.count("*").alias("n"))
    return scc.join(size, "component").join(own, "node", "left").where("n > 1 or own").select("component", "node")


def layers(edges: DataFrame, scc: DataFrame | None = None) -> DataFrame:
    """(node, layer): 0 without dependencies, else 1 + the highest of them, over the graph of components; a cycle shares a layer.

    ``src`` depends on ``dst``.
    """
    scc = written(scc if scc is not None else components(edges))
    a, b = scc.toDF("src", "a"), scc.toDF("dst", "b")
    dag = written(edges.select("src", "dst").distinct().join(a, "src").join(b, "dst").where("a <> b").select("a", "b").distinct())
    rounds, top = Rounds(edges.sparkSession), 0
    frontier = rounds.add(scc.select("component", F.lit(0).alias("layer")).distinct())
    while not frontier.isEmpty():
        steps = [frontier]
        for _ in range(LEVELS):  # who depends on a component of a path's length is on a path one longer
            steps.append(dag.join(steps[-1], dag["b"] == steps[-1]["component"]).select(F.col("a").alias("component"), (F.col("layer") + 1).alias("layer")).distinct())
        top += LEVELS
        frontier = rounds.add(reduce(DataFrame.union, steps[1:])).where(F.col("layer") == top)
    level = rounds.table().groupBy("component").agg(F.max("layer").alias("layer"))
    return scc.join(level, "component").select("node", "component", "layer")


def waves(edges: DataFrame) -> DataFrame:
    """(wave, nodes): what can move together, from 1."""
    return layers(edges).groupBy((F.col("layer") + 1).alias("wave")).agg(F.count("*").alias("nodes"))


def blast_radius(edges: DataFrame, high: int = 3, busy: int = 20, exact: bool = True) -> DataFrame:
    """(node, direct, transitive, level) of the dependents of each node.

    Exact counts need as many rows as there are reachable pairs. Without ``exact``, ``transitive`` is the estimate of a
    sketch of the dependents, which edges pass on until nothing changes: rows never exceed the edges.
    """
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).where("node is not null").distinct()
    direct = edges.where("src <> dst").groupBy("dst").agg(F.countDistinct("src").alias("direct"))
    if exact:
        every = closure(edges).where("src <> dst").groupBy("dst").agg(F.count("*").alias("transitive"))
    else:
        e = written(edges.select("src", "dst").where("src <> dst").distinct())
        own = e.groupBy("dst").agg(F.hll_sketch_agg("src").alias("s"))
        sketch, before = written(own), None
        while (state := sketch.agg(F.sum(F.hll_sketch_estimate("s"))).first()[0]) != before:
            before = state
            passed = e.join(sketch.toDF("src", "s"), "src").select("dst", "s")
            sketch = written(passed.union(sketch).groupBy("dst").agg(F.hll_union_agg("s").alias("s")))
        member = cycles(edges.where("src <> dst")).select(F.col("node").alias("dst"), F.lit(1).alias("self"))
        every = sketch.join(member, "dst", "left").select("dst", (F.hll_sketch_estimate("s") - F.coalesce("self", F.lit(0))).alias("transitive"))
    out = nodes.join(direct, nodes["node"] == direct["dst"], "left").drop("dst").join(every, nodes["node"] == every["dst"], "left").drop("dst").na.fill(0)
    level = F.when(F.col("transitive") >= high, "High").when((F.col("transitive") > 0) | (F.col("direct") >= busy), "Medium").otherwise("Low")
    return out.withColumn("level", level)


def lift(edges: DataFrame, owner: DataFrame) -> DataFrame:
    """(src_owner, dst_owner, n) of edges between different owners; ``owner`` is (node, owner)."""
    a, b = owner.toDF("src", "src_owner"), owner.toDF("dst", "dst_owner")
    return edges.join(a, "src").join(b, "dst").where("src_owner <> dst_owner").groupBy("src_owner", "dst_owner").agg(F.count("*").alias("n"))


def degree(edges: DataFrame) -> DataFrame:
    """(node, degree) over both ends."""
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).groupBy("node").agg(F.count("*").alias("degree"))


def merge_parallel(edges: DataFrame) -> DataFrame:
    """One edge per pair: inferred only if all are; with their number."""
    return edges.groupBy("src", "dst").agg(F.bool_and("inferred").alias("inferred"), F.count("*").alias("n"))
