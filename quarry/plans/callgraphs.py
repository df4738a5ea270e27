"""Queries over call graphs: sources written from table rows, and graphs of keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import callgraph as G
from quarry.plans.models import _CLOSURE, _edges
from quarry.plans.registry import query
from quarry.session import spread

#: Sources that one task writes and cuts into tokens.
SOURCES = 250
#: A source for each supplier; § is its key. Every kind of edge has a case that makes it and one that does not.
CODE = r"""
interface IStore§ { void Save(int a); int Load(); }
class SqlStore§ : IStore§ { public void Save(int a) { Log(a); } public int Load() => Make(1); void Log(int a) { } int Make(int b) { return b; } }
class MemStore§ : Base§, IStore§ { public void Save(int a) { } public int Load() { return 1; } }
interface IPick§ { void Pick(); }
class PickA§ : IPick§ { public void Pick() { } }
class PickB§ : PickMid§ { public override void Run() { } }
class PickMid§ : IPick§ { public void Pick() { } public virtual void Run() { Pick(); } }
abstract class Base§ { public abstract void Go(); public void Stay() { Go(); } }
class Child§ : Base§ { public override void Go() { } public void Stay() { } }
class Startup§ { void Configure(IServiceCollection services) {
  services.AddScoped<IStore§, SqlStore§>(); services.AddKeyedScoped<IMail§, FastMail§>("fast"); services.AddKeyedSingleton<IMail§, SlowMail§>("slow");
  services.AddTransient<IOther§>(sp => new Other§()); services.AddSingleton(typeof(IGen§), typeof(Gen§)); builder.RegisterType<Auto§>().As<IAuto§>(); // AddScoped<IPick§, PickA§>()
  var text = "services.AddScoped<IPick§, PickA§>()"; } }
interface IMail§ { void Mail(); }
class FastMail§ : IMail§ { public void Mail() { } }
class SlowMail§ : IMail§ { public void Mail() { } }
interface IOther§ { void O(); } class Other§ : IOther§ { public void O() { } }
interface IGen§ { void N(); } class Gen§ : IGen§ { public void N() { } }
interface IAuto§ { void A(); } class Auto§ : IAuto§ { public void A() { } }
class Service§ {
  private readonly IStore§ _store; IMail§ mail; List<PickA§> _items; Action<int> _cb; int _n; event EventHandler Changed;
  public Service§(IStore§ store, [FromKeyedServices("fast")] IMail§ mail) { _store = store; }
  public void Work(IPick§ pick) { _store.Save(1); mail.Mail(); pick.Pick(); this._store.Load(); Static§.Help(); bus.Send(new Order§(1)); bus.Publish(new Gone§()); bus.Send(order); _store.Nothing(); }
  public void Locals() { var c = new Child§(); c.Go(); foreach (var p in _items) { p.Pick(); } var s = sp.GetRequiredService<IStore§>(); s.Load(); if (x is SlowMail§ m) m.Mail(); var q = x as FastMail§; q.Mail(); unknown.Mail(); }
  void Raise() { Changed?.Invoke(this, e); }
  void OnChanged() { }
  void Sub(Service§ other) { other.Changed += OnChanged; unknown.Changed += Keep2; _n += Keep2; items.Select(Format); Task.Run(Work); _cb = Keep; _n = Keep2; client.Enqueue<Child§>(x => x.Go()); JobBuilder.Create<Nightly§>(); }
  void Use() { _cb(1); }
  int Format(int a) { return a; } void Keep(int a) { } int Keep2() { return 1; }
  void Shadow(int Format) { items.Select(Format); }
}
class Static§ { public static void Help() { } }
class Nightly§ { public void Execute() { } public void Other() { } }
class Order§Handler : IRequestHandler<Order§> { public void Handle(Order§ o) { } public void Help(Order§ o) { } }
class Gone§Consumer { public void Consume(Gone§ g) { } public void Other(Gone§ g) { } }
class Home§Controller { [ServiceFilter(typeof(Audit§Filter))] public void Index() { RedirectToAction("About"); RedirectToAction("List", "Shop§"); RedirectToAction("None"); } public void About() { } }
[TypeFilter(typeof(Audit§Filter))]
class Shop§Controller { public void List() { } }
class Audit§Filter { public void OnActionExecuting(X c) { } void Helper() { } }
class Router§ { Dictionary<string, Action> _map = new() { { "a", DoA }, ["b"] = DoB }; int[] _other = { 1 }; void DoA() { } void DoB() { } void Route(string k) { _map[k](); } void Miss(int k) { _other[k](); } }
"""
EDGES = {
    "calls": "Base§.Stay Base§.Go, PickMid§.Run PickMid§.Pick, Service§.Work IMail§.Mail, Service§.Work IPick§.Pick, Service§.Work IStore§.Load, Service§.Work IStore§.Save, Service§.Work Static§.Help, SqlStore§.Load SqlStore§.Make, SqlStore§.Save SqlStore§.Log",
    "E1": "IAuto§.A Auto§.A, IGen§.N Gen§.N, IOther§.O Other§.O, IStore§.Load SqlStore§.Load, IStore§.Save SqlStore§.Save",
    "E2": "IPick§.Pick PickA§.Pick, IPick§.Pick PickMid§.Pick",
    "E3": "Base§.Go Child§.Go, PickMid§.Run PickB§.Run",
    "E4": "Service§.Work FastMail§.Mail",
    "E5": "Service§.Work Gone§Consumer.Consume, Service§.Work Order§Handler.Handle",
    "E6": "Service§.Locals Child§.Go, Service§.Locals FastMail§.Mail, Service§.Locals IStore§.Load, Service§.Locals PickA§.Pick, Service§.Locals SlowMail§.Mail",
    "E7": "Service§.Raise Service§.OnChanged",
    "E8": "Service§.Sub Service§.Format, Service§.Sub Service§.Work",
    "E9": "Service§.Sub Child§.Go, Service§.Sub Nightly§.Execute",
    "E10": "Home§Controller.Index Home§Controller.About, Home§Controller.Index Shop§Controller.List",
    "E11": "Home§Controller.Index Audit§Filter.OnActionExecuting, Shop§Controller.List Audit§Filter.OnActionExecuting",
    "E12": "Service§.Use Service§.Keep",
    "E13": "Router§.Route Router§.DoA, Router§.Route Router§.DoB",
}
_PAIRS = ", ".join(f"('{a}', '{b}', '{kind}')" for kind, pairs in EDGES.items() for a, b in (x.split() for x in pairs.split(", ")))
_RESOLVED = f"SELECT replace(caller, '§', CAST(s_suppkey AS VARCHAR)) AS caller, replace(callee, '§', CAST(s_suppkey AS VARCHAR)) AS callee, kind FROM supplier, (VALUES {_PAIRS}) v(caller, callee, kind)"


def _sources(t):
    rows = spread(t.supplier.select(F.col("s_suppkey").cast("string").alias("path")), SOURCES, "path")
    return rows.select("path", F.replace(F.lit(CODE), F.lit("§"), F.col("path")).alias("code"))


@query(_RESOLVED)
def call_edges(t):
    return G.resolve(_sources(t), "path", "code")


@query(f"SELECT kind, count(*) AS edges, count(DISTINCT caller) AS callers FROM ({_RESOLVED}) GROUP BY 1")
def call_edge_kinds(t):
    return G.resolve(_sources(t), "path", "code").groupBy("kind").agg(F.count("*").alias("edges"), F.countDistinct("caller").alias("callers"))


#: Types are parts: each derives from an eighth of its number unless that is divisible by 3, and declares two members. Line items are calls within four parts.
_TYPES = """b(type, base) AS (SELECT p_partkey, p_partkey // 8 FROM part WHERE p_partkey % 3 <> 0 AND p_partkey >= 8),
m(type, member) AS (SELECT p_partkey, p_partkey % 5 FROM part UNION SELECT p_partkey, p_size % 5 FROM part),
k(a, x, b, y) AS (SELECT DISTINCT l_partkey, l_suppkey % 5, least(l_partkey + 1 + l_suppkey % 2, l_partkey - l_partkey % 4 + 3), l_linenumber % 5 FROM lineitem WHERE l_returnflag <> 'R')"""


def _types(t):
    key = F.col("p_partkey")
    bases = t.part.where((key % 3 != 0) & (key >= 8)).select(F.concat(F.lit("T"), key).alias("type"), F.concat(F.lit("T"), F.floor(key / 8)).alias("base"))
    members = t.part.select(F.concat(F.lit("T"), key).alias("type"), F.explode(F.array(key % 5, F.col("p_size") % 5)).alias("m")).select("type", F.concat(F.lit("m"), "m").alias("member")).distinct()
    to = F.least(F.col("l_partkey") + 1 + F.col("l_suppkey") % 2, F.col("l_partkey") - F.col("l_partkey") % 4 + 3)
    node = lambda p, m: F.concat(F.lit("T"), p, F.lit(".m"), m)
    calls = t.lineitem.where("l_returnflag <> 'R'").select(node(F.col("l_partkey"), F.col("l_suppkey") % 5).alias("caller"), node(to, F.col("l_linenumber") % 5).alias("callee"))
    return calls, members, bases


_RAN = f"WITH RECURSIVE {_TYPES}, w(type, member) AS (SELECT p_partkey, p_partkey % 5 FROM part WHERE p_partkey % 7 = 1 UNION (SELECT k.b, k.y FROM w JOIN k ON w.type = k.a AND w.member = k.x UNION ALL SELECT b.type, w.member FROM w JOIN b ON b.base = w.type)), ran AS (SELECT type, member FROM w JOIN m USING (type, member))"


def _ran(t):
    calls, members, bases = _types(t)
    entries = t.part.where("p_partkey % 7 = 1").select(F.concat(F.lit("T"), "p_partkey", F.lit(".m"), F.col("p_partkey") % 5).alias("node"))
    return G.dispatch_reach(calls, members, bases, entries)


@query(f"{_RAN} SELECT 'T' || type || '.m' || member AS node FROM ran")
def dispatch_reach(t):
    return _ran(t)


@query(f"WITH RECURSIVE {_TYPES}, u(type, super) AS (SELECT type, base FROM b UNION SELECT u.type, b.base FROM u JOIN b ON u.super = b.type) SELECT 'T' || super AS type, 'T' || type AS implementer FROM u WHERE type % 2 = 1 AND type <> super")
def impl_closure(t):
    return G.implementers(_types(t)[2], t.part.where("p_partkey % 2 = 1").select(F.concat(F.lit("T"), "p_partkey").alias("type")))


@query(f"{_RAN}, s AS (SELECT 'dbo.R' || l_suppkey AS routine, l_partkey AS type, l_linenumber % 5 AS member FROM lineitem) SELECT routine, count(*) AS sites, count(ran.type) AS reachable_sites, count(ran.type) > 0 AS reachable FROM s LEFT JOIN ran USING (type, member) GROUP BY 1")
def routine_reach(t):
    sites = t.lineitem.select(F.concat(F.lit("dbo.R"), "l_suppkey").alias("routine"), F.concat(F.lit("T"), "l_partkey", F.lit(".m"), F.col("l_linenumber") % 5).alias("node"))
    return G.routine_reach(sites, _ran(t))


@query()
def call_tree(t):
    """The walk of every seventh part; tests hold it against a plain depth-first walk."""
    edges = _edges(t).withColumn("place", -F.col("dst"))
    return G.call_tree(edges, edges.where("src % 7 = 1").select(F.col("src").alias("root")), depth=4, limit=60)


_LINKS = "links AS (SELECT l_partkey AS src, l_suppkey AS dst, CASE l_linenumber WHEN 1 THEN 'implements' WHEN 2 THEN 'inherits' WHEN 3 THEN 'contains' ELSE 'calls' END AS relation FROM lineitem)"


@query(f"WITH {_LINKS} SELECT src, dst FROM links WHERE relation <> 'contains' UNION SELECT dst, src FROM links WHERE relation IN ('implements', 'inherits')")
def graph_load(t):
    relation = F.when(F.col("l_linenumber") == 1, "implements").when(F.col("l_linenumber") == 2, "inherits").when(F.col("l_linenumber") == 3, "contains").otherwise("calls")
    return G.load_graph(t.lineitem.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), relation.alias("relation")))


_PLACES = """nodes AS (SELECT p_partkey AS node, p_partkey // 32 AS file, p_partkey % 32 * 20 + 1 AS first, p_partkey % 32 * 20 + 10 + p_size % 9 AS last FROM part),
entries AS (SELECT s_suppkey AS entry, s_suppkey % 7 AS file, s_suppkey * 3 % 600 AS first, s_suppkey * 3 % 600 + 25 AS last FROM supplier),
marks AS (SELECT 'findings' AS kind, 'F' || c_custkey % 50 AS name, c_custkey % 40 AS file, c_custkey * 7 % 650 AS line FROM customer UNION ALL SELECT 'hosts', 'h' || c_nationkey, c_custkey % 25, c_custkey * 11 % 650 FROM customer UNION ALL SELECT 'objects', 'dbo.T' || o_custkey % 90, o_orderkey % 60, o_orderkey * 13 % 650 FROM orders)"""


@query(f"""{_CLOSURE}, {_PLACES}, seeds AS (SELECT DISTINCT entry, node FROM entries JOIN nodes ON entries.file = nodes.file AND nodes.first BETWEEN entries.first AND entries.last),
ran AS (SELECT entry, node FROM seeds UNION SELECT entry, dst FROM seeds JOIN c ON c.src = seeds.node), spans AS (SELECT entry, nodes.* EXCLUDE (node) FROM ran JOIN nodes USING (node) UNION SELECT entry, file, first, last FROM entries),
hits AS (SELECT DISTINCT entry, kind, name FROM spans JOIN marks ON spans.file = marks.file AND line BETWEEN first AND last), n AS (SELECT entry, count(*) AS nodes FROM ran GROUP BY 1)
SELECT entry, coalesce(nodes, 0) AS nodes, coalesce(list_sort(list(name) FILTER (kind = 'findings')), []) AS findings, coalesce(list_sort(list(name) FILTER (kind = 'hosts')), []) AS hosts, coalesce(list_sort(list(name) FILTER (kind = 'objects')), []) AS objects
FROM entries LEFT JOIN n USING (entry) LEFT JOIN hits USING (entry) GROUP BY ALL""")
def workflows(t):
    part, key = t.part, F.col("p_partkey")
    nodes = part.select(key.alias("node"), F.floor(key / 32).alias("file"), (key % 32 * 20 + 1).alias("first"), (key % 32 * 20 + 10 + F.col("p_size") % 9).alias("last"))
    s = F.col("s_suppkey")
    entries = t.supplier.select(s.alias("entry"), (s % 7).alias("file"), (s * 3 % 600).alias("first"), (s * 3 % 600 + 25).alias("last"))
    c, o = F.col("c_custkey"), F.col("o_orderkey")
    marks = t.customer.select(F.lit("findings").alias("kind"), F.concat(F.lit("F"), c % 50).alias("name"), (c % 40).alias("file"), (c * 7 % 650).alias("line"))
    marks = marks.union(t.customer.select(F.lit("hosts"), F.concat(F.lit("h"), "c_nationkey"), c % 25, c * 11 % 650)).union(t.orders.select(F.lit("objects"), F.concat(F.lit("dbo.T"), F.col("o_custkey") % 90), o % 60, o * 13 % 650))
    return G.workflows(_edges(t), nodes, entries, marks)
