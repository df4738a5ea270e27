"""Walks below any root, build orders with cycles, roles of conflicting evidence, needles, and written tables that go."""

import os

from quarry import session as S
from quarry.operators import estate
from quarry.sources import files


def test_walk_below_a_root_whose_name_repeats(spark, tmp_path):
    root = tmp_path / "src" / "app" / "src"
    for name, text in {"lib/a.cs": "a", "src/b.cs": "b", "packages/p/x.cs": "x", "packages/p/x.nupkg": "n", "keep/packages/y.cs": "y", "bin/z.cs": "z", ".git/c": "c"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    for given in (str(root), str(root) + "/"):
        assert {r["path"] for r in files.walk(spark, given).collect()} == {"lib/a.cs", "src/b.cs", "keep/packages/y.cs"}


def test_a_cycle_has_level_1(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("e", "a"), ("f", "e"), ("g", "g")], "src string, dst string")
    assert {tuple(r) for r in estate.build_order(edges).collect()} == {("a", 1), ("b", 1), ("c", 2), ("d", 1), ("e", 2), ("f", 3), ("g", 1)}


def test_roles_that_conflict(spark):
    rows = [("a", "explicit", "db"), ("a", "port", "web"), ("b", "explicit", "db"), ("b", "port", "db"), ("c", "port", "web"), ("c", "weak", "x"), ("d", "explicit", "p"), ("d", "explicit", "q"), ("e", "other", "z"), ("f", "weak", None)]
    df = spark.createDataFrame(rows, "k string, s string, r string")
    got = {r["k"]: (r["role"], r["confidence"], r["roles"]) for r in estate.role_vote(df, "k", "s", "r", ["explicit", "port", "weak"], against=("explicit", "port")).collect()}
    assert got == {"a": ("MIXED", "explicit against port", ["db", "web"]), "b": ("db", "explicit", ["db"]), "c": ("web", "port", ["web", "x"]), "d": ("MIXED", "explicit", ["p", "q"])}


def test_needles_beyond_the_broadcast(spark, monkeypatch):
    needles = spark.createDataFrame([("p", "x"), ("p", "y"), ("q", "x"), ("q", None)], "g string, n string")
    texts = spark.createDataFrame([("p", 1, "xy"), ("p", 2, "x"), ("q", 3, "y"), ("q", 4, None), ("r", 5, "x")], "g string, id int, t string")
    want = {("p", "x", 1), ("p", "x", 2), ("p", "y", 1)}
    for limit in (100_000, 0):
        monkeypatch.setattr(estate, "BROADCAST_NEEDLES", limit)
        assert {(r["g"], r["n"], r["id"]) for r in estate.where_found(needles, texts, "g", "n", "id", "t").collect()} == want


def test_tables_are_discarded(spark):
    one = S.written(spark.range(3))
    path = S._paths[one].removeprefix("file:")
    assert os.path.isdir(path)
    S.discard(one)
    assert not os.path.isdir(path)
    rounds = S.Rounds(spark)
    rounds.add(spark.range(2))
    rounds.add(spark.range(5, 7))
    assert sorted(r[0] for r in rounds.table().collect()) == [0, 1, 5, 6]
