"""Edges of call graphs, reach through dispatch, call trees and workflows."""

import pytest

from quarry.operators import callgraph as G
from quarry.plans.callgraphs import CODE, EDGES


def edges(spark, code):
    df = spark.createDataFrame([("a", code), ("n", None), ("e", "")], "path string, code string")
    return {tuple(r) for r in G.resolve(df, "path", "code").collect()}


def test_every_kind_has_its_edges_and_no_other(spark):
    want = {(a, b, kind) for kind, pairs in EDGES.items() for a, b in (x.replace("§", "1").split() for x in pairs.split(", "))}
    want.add(("Service1.Raise", "Service1.Keep2", "E7"))  # with one source, one type alone has the event
    assert edges(spark, CODE.replace("§", "1")) == want


def test_cases_without_edges(spark):
    many = "interface I { void M(); } " + " ".join(f"class C{k} : I {{ public void M() {{ }} }}" for k in range(7))
    assert edges(spark, many) == set()  # more implementers than may be meant
    assert edges(spark, many.replace("class C6 : I", "class C6")) == {("I.M", f"C{k}.M", "E2") for k in range(6)}
    assert edges(spark, "interface I { void M(); } class A : I { public void M() { } }") == set()  # one implementer is the plain reading's
    assert edges(spark, "class A { void M() { N(); } } class B { void N() { } }") == set()
    assert edges(spark, "class A { event H E; void R() { E(1); } } class B { event H E; void On() { } void S(A a, B b, X x) { b.E += On; x.E += On; } }") == set()
    assert edges(spark, "class A { event H E; void R() { E(1); } } class B { void On() { } void S(X x) { x.E += On; } }") == {("A.R", "B.On", "E7")}


def test_members_are_inherited(spark):
    code = "class A { protected void M() { } } class B : A { } class C : B { void R(B b) { M(); b.M(); } } class D : N.A, IX<A> { void Q() { M(); } }"
    assert edges(spark, code) == {("C.R", "A.M", "calls"), ("D.Q", "A.M", "calls")}


def test_no_sources(spark):
    assert G.resolve(spark.createDataFrame([], "path string, code string"), "path", "code").collect() == []


def test_reach_goes_down_through_types_that_do_not_declare(spark):
    calls = spark.createDataFrame([("X.Run", "I.M"), ("C.M", "Y.Z"), ("U.V", "W.W")], "caller string, callee string")
    members = spark.createDataFrame([("I", "M"), ("C", "M"), ("Y", "Z"), ("X", "Run"), ("W", "W")], "type string, member string")
    bases = spark.createDataFrame([("B", "I"), ("C", "B"), ("I", "I"), ("B", "C")], "type string, base string")
    entries = spark.createDataFrame([("X.Run",), ("Gone.M",)], "node string")
    assert {r[0] for r in G.dispatch_reach(calls, members, bases, entries).collect()} == {"X.Run", "I.M", "C.M", "Y.Z"}


def plain_tree(below, root, depth, limit):
    lines, seen = [], set()

    def walk(node, level):
        if limit and len(lines) >= limit:
            return
        lines.append((level, node, node in seen))
        if node in seen or level >= depth:
            return
        seen.add(node)
        for x in below.get(node, []):
            walk(x, level + 1)

    walk(root, 0)
    return lines


@pytest.mark.parametrize(("depth", "limit"), [(4, 60), (1, 0), (6, 0), (0, 0), (9, 7)])
def test_trees_are_those_of_a_plain_walk(spark, depth, limit):
    pairs = [(a, (a * a + k * 7) % 23, k) for a in range(23) for k in range(3)] + [(5, 5, 9), (6, 7, 1), (6, 7, 2)]
    first, below = {}, {}
    for a, b, k in pairs:
        first[a, b] = min(k, first.get((a, b), 99))
    for (a, b), _ in sorted(first.items(), key=lambda x: (x[0][0], x[1], x[0][1])):
        below.setdefault(a, []).append(b)
    df = spark.createDataFrame(pairs, "src long, dst long, place int")
    roots = spark.createDataFrame([(k,) for k in (0, 3, 5, 99)], "root long")
    got = {}
    for r in G.call_tree(df, roots, depth, limit).orderBy("root", "line").collect():
        got.setdefault(r["root"], []).append((r["level"], r["node"], r["again"]))
    assert got == {k: plain_tree(below, k, depth, limit) for k in (0, 3, 5, 99)}


def test_workflows_without_nodes_or_marks(spark):
    graph = spark.createDataFrame([(1, 2), (2, 1), (2, 3)], "src long, dst long")
    nodes = spark.createDataFrame([(1, "a", 10, 20), (2, "b", 1, 600), (3, "c", 1, 5)], "node long, file string, first int, last int")
    entries = spark.createDataFrame([("e1", "a", 5, 12), ("e2", "z", 1, 3), ("e3", "a", 11, 30)], "entry string, file string, first int, last int")
    marks = spark.createDataFrame([("host", "h1", "b", 599), ("host", "h2", "b", 601), ("db", "t", "c", 1), ("db", "u", "z", 3), ("db", "t", "c", 2)], "kind string, name string, file string, line int")
    got = {r["entry"]: (r["nodes"], r["db"], r["host"]) for r in G.workflows(graph, nodes, entries, marks).collect()}
    assert got == {"e1": (3, ["t"], ["h1"]), "e2": (0, ["u"], []), "e3": (0, [], [])}
