"""Tokens, statements and lineage of SQL scripts, SQL in C# sources, and wrappers of procedures."""

import pytest

from quarry.functions import csharp, lexers
from quarry.operators import codesql, sqltext


def facts(spark, text):
    return {(r["object"], r["op"]) for r in sqltext.facts(spark.createDataFrame([(1, text)], "id int, body string"), "id", "body").collect()}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("SELECT 'from ghost', a FROM [my schema].[Order Details] o, dbo.Other x; UPDATE o SET a=1 FROM dbo.Orders o; WITH c AS (SELECT 1 a FROM dbo.Base) SELECT * FROM c",
         {("my schema.order details", "read"), ("dbo.other", "read"), ("dbo.orders", "update"), ("dbo.orders", "read"), ("dbo.base", "read")}),
        ("with a as (select 1 x from t1), b(x) as (select x from a join t2 on 1=1) update t3 set y = 1 from t3 join b on b.x = t3.x", {("t1", "read"), ("t2", "read"), ("t3", "update"), ("t3", "read")}),
        ("UPDATE o SET a = 1 FROM dbo.A o UPDATE o SET a = 1 FROM dbo.B o", {("dbo.a", "update"), ("dbo.a", "read"), ("dbo.b", "update"), ("dbo.b", "read")}),
        ("DELETE x FROM (SELECT id FROM t) x", {("t", "read")}),
        ("insert t (a, b) values (1, (select max(a) from u))", {("t", "insert"), ("u", "read")}),
        ("insert into #t select 1 from v; drop table #t; truncate table dbo.w", {("#t", "temp"), ("v", "read"), ("#t", "drop"), ("dbo.w", "truncate")}),
        ("select trim(both from x), f(a, b) from t where a in (1, c) and b is distinct from d", {("t", "read")}),
        ("fetch next from cur into @x; exec (@sql); execute as user = 'dbo'; exec @rc = [srv].[db]..[p q] 1", {("srv.db..p q", "call")}),
        ("grant select, insert on t to u; declare c cursor for select 1 from k for update of a", {("k", "read")}),
        ("create or alter view v as select * from t; alter table a add b int; drop procedure if exists p", {("v", "create"), ("t", "read"), ("a", "alter"), ("p", "drop")}),
        ("create trigger tr on t after insert, update as if update(a) insert log select i.a from inserted i join deleted d on 1=1", {("tr", "create"), ("log", "insert")}),
        ('select 1 from "a""b" /* from x */ -- from y\n, c', {('ab', "read"), ("c", "read")}),
        ("select * from t1 left join (t2 cross join t3) on 1=1 cross apply fn(t1.x) f", {("t1", "read"), ("t2", "read"), ("t3", "read")}),
        ("select 1 from a union all select 2 from b except select 3 from c order by 1", {("a", "read"), ("b", "read"), ("c", "read")}),
        ("select 'it''s from z', N'from y' from [from x]", {("from x", "read")}),
        ("", set()),
        (None, set()),
    ],
)
def test_lineage(spark, text, want):
    assert facts(spark, text) == want


def test_a_bad_batch_loses_only_itself(spark):
    df = spark.createDataFrame([(1, "select 1 from a\ngo\nselect (1 from b\nGO\nselect 1 from c where x = 'open"), (2, "/* never"), (3, "select [a from t"), (4, "select 1) from t")], "id int, body string")
    assert {(r["id"], r["object"]) for r in sqltext.facts(df, "id", "body").collect()} == {(1, "a")}
    assert {(r["id"], r["batch"], r["message"]) for r in sqltext.errors(df, "id", "body").collect()} == {(1, 1, "parentheses do not match"), (1, 2, "string without end"), (2, None, "comment without end"), (3, 0, "quoted name without end"), (4, 0, "parentheses do not match")}


def test_constructs_in_comments_and_strings_do_not_count(spark):
    df = spark.createDataFrame([(1, "-- merge into x\nselect '(nolock)' from t with (nolock) /* cursor for */ where [merge into] = 1")], "id int, body string")
    assert {k for k, v in sqltext.census(df, "body").first().asDict().items() if v} == {"nolock"}


def test_long_scripts_do_not_overflow(spark):
    text = "select '" + "a''" * 50_000 + "' from t; /*" + "*" * 100_000 + "*/ select [" + "x]]" * 50_000 + "] from u"
    assert {r[0] for r in sqltext.facts(spark.createDataFrame([(1, text)], "id int, body string"), "id", "body").select("object").collect()} == {"t", "u"}


@pytest.mark.parametrize(
    ("code", "want"),
    [
        ('"a\\"b\\n\\u0041\\q"', 'a"b\nAq'),
        ('@"c:\\x ""q"" {0}"', 'c:\\x "q" \x01'),
        ('$"a{b}c{{d}}{(x ? "}" : $"{y}")}"', "a\x01c{d}\x01"),
        ('$@"a\\{b}"', "a\\\x01"),
        ('"""\n  a "b" {c}\n  """', '  a "b" {c}'),
        ('$$"""a {b} {{c}} {{d("}")}}"""', "a {b} \x01 \x01"),
        ('""', ""),
        ('"open', "open"),
        ('"{0:N2} {1,-5} {x}"', "\x01 \x01 {x}"),
    ],
)
def test_strings(code, want):
    assert [t[1] for t in csharp.lex(code + "\n;") if t[0] == "str"] == [want]


def test_places_and_blocks():
    tokens = csharp.lex('a("x\n", /* b\n c) // "d"\n  #if "e"\n[f]')
    assert [(t[1], t[2], t[3], t[5], t[6]) for t in tokens] == [("a", 1, 1, -1, -1), ("(", 1, 1, -1, 5), ("x", 1, 1, 1, -1), (", /* b", 2, 2, 1, -1), ("c", 3, 3, 1, -1), (")", 3, 3, -1, 1), ("[", 5, 5, -1, 8), ("f", 5, 5, 6, -1), ("]", 5, 5, -1, 6)]
    assert [t[1] for t in csharp.lex('  #region "x"\na\n   #endregion "y"\nb')] == ["a", "b"]


def test_comments_and_strings_are_blanked_where_they_nest():
    code = 'var a = $"{F("x // y")} // no"; // yes\nvar b = """\n// no\n"""; /* yes */'
    assert lexers.strip_text(code) == 'var a = $"{F("x // y")} // no";       \nvar b = """\n// no\n""";          '
    assert len(lexers.strip_text(code, strings=True)) == len(code)
    assert lexers.strip_text(None) is None


def scan(spark, code):
    df = spark.createDataFrame([("a", code), ("b", None), ("c", "")], "path string, code string")
    return {r["sql"] or r["text"]: r["reason"] for r in codesql.scan_code(df, "path", "code").collect()}


def test_candidates_and_reasons(spark):
    assert scan(spark, 'x.Query("SELECT a FROM t WHERE b = " + F("u", 1) + " AND c = 2");') == {"SELECT a FROM t WHERE b =  @p  AND c = 2": "accepted"}
    assert scan(spark, 'var q = "DELETE FROM t "; q += "WHERE a = 1"; q = "SELECT 1 x"; if (a) { q += ", 2 y"; }') == {"DELETE FROM t WHERE a = 1": "accepted", "SELECT 1 x, 2 y": "accepted"}
    assert scan(spark, 'Show("Select an item"); Show("Update now");') == {"Select an item": "no_context", "Update now": "parse_error"}
    assert scan(spark, 's.CreateQuery("select o from Order o");') == {"select o from Order o": "object_query"}
    assert scan(spark, '// "select 1 from t"\n/* "select 2 from t" */ var a = \'"\'; var b = "selection of things";') == {}


def test_wrappers_in_a_cycle_end(spark):
    code = 'class A { void P(string n) { Exec(n); } void Q(string n) { R(n); P(n); } void R(string n) { Q(n); } void U() { P("p1"); Q("q1"); Q("q2"); Q("q3"); R("r1"); R("r2"); Exec(x); Exec(K); } const string K = "k1"; }'
    df = spark.createDataFrame([("a", code)], "path string, code string")
    sites, wrappers = codesql.procedure_sites(df, "path", "code", spark.createDataFrame([("Exec", 0)], "method string, param int"))
    assert {(r["callee"], r["procedure"]) for r in sites.collect()} == {("P", "p1"), ("Q", "q1"), ("Q", "q2"), ("Q", "q3"), ("R", "r1"), ("R", "r2"), ("Exec", None), ("Exec", "k1")}
    assert {(r["method"], r["round"], r["kept"]) for r in wrappers.collect()} == {("Exec", 0, True), ("P", 1, True), ("Q", 2, True), ("R", 3, True)}


def test_no_sources(spark):
    df = spark.createDataFrame([], "path string, code string")
    assert codesql.scan_code(df, "path", "code").collect() == []
    sites, wrappers = codesql.procedure_sites(df, "path", "code", spark.createDataFrame([("Exec", 0)], "method string, param int"))
    assert sites.collect() == [] and wrappers.count() == 1
