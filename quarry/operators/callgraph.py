"""Call graphs of C# sources: symbols from tokens, edges that a plain reading cannot see, reach through dispatch, call trees and workflows.

Sources become rows of tokens; declarations, receivers, registrations and the like are short patterns over the tokens next to each other
(``lead`` and ``lag`` within a source), and edges are joins of the tables so found, on type and member names. Types are known by their simple names. A source is
one row of text, so a window holds one source.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.codesql import _CONTROL, code_tokens
from quarry.operators.graph import LEVELS, reach
from quarry.session import Rounds, written

_MODIFIERS = ["abstract", "virtual", "override"]
_HANDLES = r"^(Handle|Consume)(Async)?$"
_FILTERED = r"^On(Action|Result|Exception|ResourceExecut|Authoriz)"


def _around(tokens: DataFrame, back: int = 5, ahead: int = 9) -> DataFrame:
    """The tokens with b1, b2, ... before and a1, a2, ... after, and s1, s2, ... for those after that are strings; brace and semicolon are the next ones at the same bracket level,
    ``declares`` is the declaration of a type that begins at the token, ``of`` the one in whose header it is. All windows follow ``path``, so tokens are dealt once.
    Names, strings, ends of lists, square brackets and headers are kept; of other tokens only what their neighbours know of them.
    """
    here = Window.partitionBy("path").orderBy("pos")
    rows = tokens.select(
        "*", *[F.lag("value", k).over(here).alias(f"b{k}") for k in range(1, back + 1)], *[F.lead("value", k).over(here).alias(f"a{k}") for k in range(1, ahead + 1)],
        *[(F.lead("kind", k).over(here) == "str").alias(f"s{k}") for k in (2, 4, 7)], F.lag("kind").over(here).alias("b1_kind"), F.lead("kind").over(here).alias("a1_kind"), F.lead("match").over(here).alias("a1_match"), F.lead("pos").over(here).alias("a1_pos"),
    )
    back_to = Window.partitionBy("path", "block").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)  # from the end, as a frame up to the end is read anew for each row
    next_ = lambda mark, what: F.last(F.when(F.col("value") == mark, what), ignorenulls=True).over(back_to)
    rows = rows.select("*", next_("{", F.struct(F.col("pos").alias("begin"), F.col("match").alias("end"))).alias("brace"), next_(";", F.col("pos")).alias("semicolon"))
    starts = (F.col("kind") == "id") & F.col("value").isin("class", "interface", "struct", "record") & (F.col("a1_kind") == "id") & ~F.coalesce(F.col("b1").isin(":", ","), F.lit(False))
    abstract = reduce(lambda x, y: x | y, [F.col(f"b{k}").eqNullSafe("abstract") for k in (1, 2, 3)])
    rows = rows.withColumn("declares", F.when(starts, F.struct("pos", F.col("a1").alias("type"), F.col("value").alias("kind"), abstract.alias("abstract"), F.col("brace.begin").alias("begin"), F.col("brace.end").alias("end"))))
    of = F.last("declares", ignorenulls=True).over(Window.partitionBy("path", "block").orderBy("pos"))
    rows = rows.withColumn("of", of).withColumn("of", F.when(F.col("pos") < F.col("of.begin"), F.struct("of.pos", "of.type")))
    return rows.where(F.col("kind").isin("id", "str") | F.col("value").isin(")", "[", "]") | F.col("of").isNotNull())


def _is(*pattern: str | None) -> Column:
    """Whether the tokens after are these; None matches anything."""
    return reduce(lambda x, y: x & y, [F.col(f"a{k}") == v for k, v in enumerate(pattern, 1) if v is not None])


class Symbols:
    """Tables of what C# sources declare; each is written once, as several edges read it."""

    def __init__(self, sources: DataFrame, path: str, text: str):
        self.near = written(_around(code_tokens(sources, path, text)))
        self.types, self.bases = map(written, self._types())
        self.up = supertypes(self.bases)
        self.members = written(self._members())
        self.owned = written(self._owned())
        self.vars = written(self._vars())
        self.sites = written(self._sites())

    def _types(self) -> tuple[DataFrame, DataFrame]:
        """(path, pos, type, kind, abstract, begin, end) and (type, base, arg); arg is the first argument of a generic base."""
        types = self.near.where("declares IS NOT NULL").select("path", "declares.*")
        rows = self.near.where("of IS NOT NULL")
        header = Window.partitionBy("path", "block", "of.pos").orderBy("pos")
        count = lambda v: F.count_if(F.col("value") == v).over(header)
        rows = rows.select("*", (count("<") - count(">")).alias("angle"), count(":").alias("colons"), count("where").alias("wheres"))
        base = (F.col("kind") == "id") & (F.col("angle") == 0) & (F.col("colons") > 0) & (F.col("wheres") == 0) & F.col("b1").isin(":", ",", ".") & (F.col("a1") != ".")
        return types, rows.where(base).select(F.col("of.type").alias("type"), F.col("value").alias("base"), F.when(F.col("a1") == "<", F.col("a2")).alias("arg")).distinct()

    def _members(self) -> DataFrame:
        """(path, pos, type, member, list, begin, end, open, params): begin and end are the places around a body, open says that it may be overridden, params are the types."""
        typed = (F.col("b1_kind") == "id") & ~F.col("b1").isin("new", "return", "await", "throw") | F.col("b1").isin(">", "]", "?")
        heads = self.near.where((F.col("kind") == "id") & (F.col("a1") == "(") & typed & ~F.col("value").isin(_CONTROL))
        stops = lambda k: F.col(f"b{k}").isin(";", "}", "{", "]")
        said = lambda word: reduce(lambda x, y: x | y, [F.col(f"b{k}").eqNullSafe(word) & ~reduce(lambda p, q: p | q, [F.coalesce(stops(j), F.lit(False)) for j in range(1, k)], F.lit(False)) for k in range(1, 6)])
        heads = heads.select("path", "pos", "block", F.col("value").alias("member"), F.col("a1_pos").alias("list"), F.col("a1_match").alias("close"), "semicolon", (said("abstract") | said("virtual")).alias("open"), said("override").alias("override"))
        heads = heads.join(self.types.select("path", F.col("begin").alias("block"), "type"), ["path", "block"])
        follow = self.near.where("value = ')'").select("path", F.col("pos").alias("close"), F.col("a1").alias("next"), F.col("a1_pos").alias("next_pos"), F.col("a1_match").alias("next_match"))
        heads = heads.join(follow, ["path", "close"]).where(F.col("next").isin("{", "=>", ";", "where", ":"))
        kinds = self.near.where((F.col("kind") == "id") & (F.col("b1_kind") == "id") & F.col("a1").isin(",", ")", "=")).groupBy("path", F.col("block").alias("list")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "b1"))), lambda p: p["b1"]).alias("params"))
        body = F.col("next").isin("{", "=>")
        return heads.join(kinds, ["path", "list"], "left").select("path", "pos", "type", "member", "list", F.when(body, F.col("next_pos")).alias("begin"), F.when(F.col("next") == "{", F.col("next_match")).when(body, F.col("semicolon")).alias("end"), "open", "override", F.coalesce("params", F.array().cast("array<string>")).alias("params"))

    def _owned(self) -> DataFrame:
        """(type, member, owner): the members that a type has itself or from the nearest type above it."""
        own = self.members.select("type", "member").distinct()
        every = own.select("type", "member", F.col("type").alias("owner"), F.lit(0).alias("depth")).unionByName(self.up.join(own.withColumnRenamed("type", "super"), "super").select("type", "member", F.col("super").alias("owner"), "depth"))
        return every.groupBy("type", "member").agg(F.min(F.struct("depth", "owner"))["owner"].alias("owner"))

    def given(self) -> DataFrame:
        """(path, pos, given): the names that are whole arguments of calls, at the places of the calls."""
        ends = F.col("a1").isNull() | ((F.col("a1_kind") == "op") & F.col("a1").isin(",", ")", "]", "}"))
        names = self.near.where((F.col("kind") == "id") & (F.col("block") >= 0) & (F.col("b1_kind") == "op") & F.col("b1").isin("(", ",") & ends).select("path", F.col("block").alias("list"), F.col("value").alias("given"))
        typed = (F.col("b1_kind") == "id") & ~F.col("b1").isin("new", "return", "await", "throw", "else", "in", "is", "as") | F.col("b1").isin(">", "]", "?")
        sites = self.near.where((F.col("kind") == "id") & (F.col("a1") == "(") & ~F.col("value").isin(_CONTROL)).select("path", "pos", F.col("a1_pos").alias("list"), F.when(typed, F.col("a1_match")).alias("close"))
        bodies = self.near.where("value = ')' AND a1 = '{'").select("path", F.col("pos").alias("close"))  # with a body after it, it is a declaration
        return sites.join(names, ["path", "list"]).join(bodies, ["path", "close"], "left_anti").select("path", "pos", "given")

    def inside(self, rows: DataFrame) -> DataFrame:
        """The rows (path, pos, ...) with the type and member whose body they are in."""
        heads = self.members.where("begin IS NOT NULL").select("path", F.col("begin").alias("pos"), F.struct("type", "member", "begin", "end", F.col("pos").alias("head")).alias("body"), F.lit(0).alias("order"))
        both = heads.unionByName(rows.withColumn("order", F.lit(1)), allowMissingColumns=True)
        last = F.last("body", ignorenulls=True).over(Window.partitionBy("path").orderBy("pos", "order"))
        return both.withColumn("around", last).where((F.col("order") == 1) & (F.col("pos") < F.col("around.end"))).select(*rows.columns, "around.type", "around.member", F.col("around.head").alias("head"))

    def _vars(self) -> DataFrame:
        """(scope, type, head, name, vtype, element): local names by the member's place, fields by the type; element is what a generic collection of one argument holds."""
        name = (F.col("kind") == "id") & ~F.col("value").isin(_CONTROL)
        vtype = F.when((F.col("b1_kind") == "id") & ~F.col("b1").isin("var", "return", "new", "in", "is", "as", "await", "else", "out", "ref", "using", "event"), F.col("b1"))
        element = F.when((F.col("b1") == ">") & (F.col("b3") == "<"), F.col("b2"))
        typed = self.near.where(name & (vtype.isNotNull() | element.isNotNull()))
        keep = [F.col("value").alias("name"), vtype.alias("vtype"), element.alias("element")]
        fields = typed.where(F.col("a1").isin(";", "=")).join(self.types.select("path", F.col("begin").alias("block"), "type"), ["path", "block"]).select(F.lit("field").alias("scope"), "path", "type", F.lit(None).cast("int").alias("head"), *keep)
        params = typed.where(F.col("a1").isin(",", ")", "=")).join(self.members.select("path", F.col("list").alias("block"), "type", F.col("pos").alias("head")), ["path", "block"]).select(F.lit("param").alias("scope"), "path", "type", "head", *keep)
        made = F.when((F.col("b1") == "var") & _is("=", "new"), F.col("a3")).when((F.col("b1") == "var") & _is("=", None, ".", None, "<") & F.col("a4").isin("GetRequiredService", "GetService"), F.col("a6"))
        made = made.when((F.col("b2") == "is") & (F.col("b1_kind") == "id"), F.col("b1")).when((F.col("b1") == "var") & _is("=", None, "as"), F.col("a4")).when(F.col("a1").isin("=", ";"), vtype)
        walked = F.when((F.col("b1") == "var") & (F.col("a1") == "in"), F.col("a2"))
        local = self.inside(self.near.where(name & (made.isNotNull() | walked.isNotNull())).select("path", "pos", F.col("value").alias("name"), made.alias("vtype"), walked.alias("walked")))
        known = fields.where("element IS NOT NULL").select("type", F.col("name").alias("walked"), F.col("element").alias("held"))
        local = local.join(known, ["type", "walked"], "left").select(F.lit("local").alias("scope"), "path", "type", "head", "name", F.coalesce("vtype", "held").alias("vtype"), F.lit(None).cast("string").alias("element"))
        return fields.unionByName(params).unionByName(local).where("vtype IS NOT NULL OR element IS NOT NULL").distinct()

    def _sites(self) -> DataFrame:
        """(path, pos, type, member, head, receiver, callee, on, scope): the calls in bodies, with the type that they are made on and how its name is known."""
        heads = self.members.select("path", "pos", F.lit(True).alias("declared"))
        call = (F.col("kind") == "id") & (F.col("a1") == "(") & ~F.col("value").isin(_CONTROL) & ~F.coalesce(F.col("b1") == "new", F.lit(False))
        dotted = F.col("b1") == "."
        receiver = F.when(dotted & (F.col("b2") == "?"), F.col("b3")).when(dotted & ((F.col("b3") != ".") | (F.col("b4") == "this")), F.col("b2")).when(dotted, "?")
        found = self.near.where(call).join(heads, ["path", "pos"], "left").where("declared IS NULL")
        found = self.inside(found.select("path", "pos", F.when(receiver != "this", receiver).alias("receiver"), F.col("value").alias("callee")))
        return self.typed(found).select("path", "pos", "type", "member", "head", "receiver", "callee", "on", "scope")

    def typed(self, rows: DataFrame) -> DataFrame:
        """The rows (path, type, head, receiver, ...) with ``on``, the type of the receiver, and ``scope``, how its name is known: own (no receiver), param, local, field or static."""
        local = self.vars.where("scope <> 'field' AND vtype IS NOT NULL").groupBy("path", "head", F.col("name").alias("receiver")).agg(F.max_by(F.struct("scope", "vtype"), F.col("scope")).alias("l"))
        field = self.vars.where("scope = 'field' AND vtype IS NOT NULL").groupBy("type", F.col("name").alias("receiver")).agg(F.min("vtype").alias("f"))
        static = self.types.select(F.col("type").alias("receiver")).distinct().withColumn("s", F.col("receiver"))
        out = rows.join(local, ["path", "head", "receiver"], "left").join(field, ["type", "receiver"], "left").join(static, "receiver", "left")
        own = F.col("receiver").isNull()
        scope = F.when(own, "own").when(F.col("l").isNotNull(), F.col("l.scope")).when(F.col("f").isNotNull(), "field").otherwise("static")
        return out.select(*rows.columns, F.when(own, F.col("type")).otherwise(F.coalesce("l.vtype", "f", "s")).alias("on"), scope.alias("scope"))


def supertypes(bases: DataFrame) -> DataFrame:
    """(type, super, depth) of all types above each."""
    edges = bases.select(F.col("type").alias("src"), F.col("base").alias("dst")).where("src <> dst").distinct()
    return reach(edges, edges.select(F.col("src").alias("seed"))).select(F.col("seed").alias("type"), F.col("node").alias("super"), "depth").where("type <> super")


def implementers(bases: DataFrame, concrete: DataFrame, up: DataFrame | None = None) -> DataFrame:
    """(type, implementer): the types of ``concrete`` (type) below each type, at any depth. ``up`` are the supertypes of ``bases`` where they are known."""
    up = supertypes(bases) if up is None else up
    return up.join(concrete.select("type").distinct(), "type", "left_semi").select(F.col("super").alias("type"), F.col("type").alias("implementer")).distinct()


def registrations(near: DataFrame) -> DataFrame:
    """(service, impl, key, lifetime) that containers are told to build: generic pairs, keyed ones, factories, ``typeof`` pairs and ``RegisterType<T>().As<I>()``."""
    name = F.regexp_extract("value", r"^(?:Try)?Add(?:Keyed)?(Scoped|Transient|Singleton)$", 1)
    rows = near.where((F.col("kind") == "id") & ((name != "") | (F.col("value") == "RegisterType")))
    pair, factory, types = _is("<", None, ",", None, ">"), _is("<", None, ">", "(", None, "=>", "new"), _is("(", "typeof", "(", None, ")", ",", "typeof", "(")
    built = _is("<", None, ">", "(", ")", ".", "As", "<") & (F.col("value") == "RegisterType")
    service = F.when(built, F.col("a9")).when(pair | factory, F.col("a2")).when(types, F.col("a4"))
    impl = F.when(built, F.col("a2")).when(pair, F.col("a4")).when(factory, F.col("a8")).when(types, F.col("a9"))
    key = F.when(F.col("value").contains("Keyed") & pair & F.col("s7"), F.col("a7"))
    return rows.select(service.alias("service"), impl.alias("impl"), key.alias("key"), F.when(name != "", name).alias("lifetime")).where("service IS NOT NULL AND impl IS NOT NULL").distinct()


def resolve(sources: DataFrame, path: str, text: str, most: int = 6) -> DataFrame:
    """(caller, callee, kind) of the calls between members (``Type.Member``).

    kind is calls for those that the receiver's declared type shows (a parameter, field, type or the object itself), and else: E1 a registered implementation,
    E2 the implementers of an interface without registration (2 to ``most``), E3 an override, E4 the implementation under an injected key, E5 the handlers of a message,
    E6 a call on a local of inferred type, E7 the subscribers of an event that is raised, E8 a method given by name, E9 a background job, E10 a transfer to an action,
    E11 a filter around an action, E12 a delegate kept in a field, E13 an entry of a table of delegates. A pair that the plain calls have is not given again.
    """
    s = Symbols(sources, path, text)
    at = lambda t, m: F.concat_ws(".", t, m)
    near, members, owned = s.near, s.members.select("type", "member").distinct(), s.owned
    kinds = s.types.groupBy("type").agg(F.bool_or((F.col("kind") == "interface") | F.col("abstract")).alias("abstract"))
    regs = written(registrations(near))
    plain = s.sites.where("on IS NOT NULL").join(owned.toDF("on", "callee", "owner"), ["on", "callee"])
    edges = [plain.select(at("type", "member").alias("caller"), at("owner", "callee").alias("callee"), F.when(F.col("scope") == "local", "E6").otherwise("calls").alias("kind"))]

    def add(df: DataFrame, caller: Column, callee: Column, kind: str) -> None:
        edges.append(df.select(caller.alias("caller"), callee.alias("callee"), F.lit(kind).alias("kind")))

    declared = members.toDF("service", "member")
    implemented = owned.toDF("impl", "member", "owner")
    add(regs.where("key IS NULL").join(declared, "service").join(implemented, ["impl", "member"]), at("service", "member"), at("owner", "member"), "E1")
    below = implementers(s.bases, kinds.where("NOT abstract"), s.up).toDF("service", "impl")
    loose = below.join(regs, "service", "left_anti").join(s.types.where("kind = 'interface'").select(F.col("type").alias("service")).distinct(), "service", "left_semi")
    few = loose.groupBy("service").agg(F.count("*").alias("n")).where((F.col("n") >= 2) & (F.col("n") <= most)).select("service")
    add(loose.join(few, "service").join(declared, "service").join(implemented, ["impl", "member"]), at("service", "member"), at("owner", "member"), "E2")
    base = s.members.where("open").select(F.col("type").alias("super"), "member").distinct()
    add(s.up.join(base, "super").join(s.members.where("override").select("type", "member").distinct(), ["type", "member"]), at("super", "member"), at("type", "member"), "E3")
    lists = s.members.select("path", F.col("list").alias("block"), "type").distinct()
    keyed = near.where((F.col("value") == "FromKeyedServices") & _is("(", None, ")", "]") & F.col("s2"))
    outer = near.where("value = '['").select("path", F.col("pos").alias("bracket"), F.col("block").alias("list"))
    keyed = keyed.withColumnRenamed("block", "bracket").join(outer, ["path", "bracket"]).withColumnRenamed("list", "block").join(lists, ["path", "block"]).select("type", F.col("a5").alias("service"), F.col("a2").alias("key"))
    narrowed = plain.where("scope IN ('field', 'param')").select("type", "member", F.col("on").alias("service"), "callee").join(keyed, ["type", "service"]).join(regs.where("key IS NOT NULL").select("service", "key", "impl"), ["service", "key"]).join(implemented.withColumnRenamed("member", "callee"), ["impl", "callee"])
    add(narrowed, at("type", "member"), at("owner", "callee"), "E4")
    sent = s.inside(near.where((F.col("kind") == "id") & F.col("value").rlike("^(Send|Publish|Dispatch)(Async)?$") & _is("(", "new")).select("path", "pos", F.col("a3").alias("message")))
    handling = s.members.where(F.col("member").rlike(_HANDLES))
    by_base = handling.join(s.bases.where(F.col("base").rlike("Handler$|^IConsumer$|^IHandleMessages$")).select("type", F.col("arg").alias("message")), "type")
    by_name = handling.where(F.col("type").rlike("(Handler|Consumer)$")).withColumn("message", F.get("params", F.lit(0)))
    handlers = by_base.select("message", "type", "member").union(by_name.select("message", "type", "member")).where("message IS NOT NULL").distinct().toDF("message", "handler", "handles")
    add(sent.join(handlers, "message"), at("type", "member"), at("handler", "handles"), "E5")
    events = near.where("b2 = 'event' OR (b1 = '>' AND b5 = 'event')").join(s.types.select("path", F.col("begin").alias("block"), "type"), ["path", "block"]).select(F.col("value").alias("event"), F.col("type").alias("raiser")).distinct()
    subscribed = s.inside(near.where((F.col("kind") == "id") & _is("+=") & F.col("a3").isin(";", ".")).select("path", "pos", F.col("value").alias("event"), F.when(F.col("a2") == "this", F.col("a4")).otherwise(F.col("a2")).alias("handler"), F.when((F.col("b1") == ".") & (F.col("b2") != "this"), F.col("b2")).alias("receiver")))
    alone = events.groupBy("event").agg(F.min("raiser").alias("only"), F.count("*").alias("n")).where("n = 1").select("event", "only")  # a receiver of unknown type is no doubt if one type alone has the event
    declares = events.select("event", F.col("raiser").alias("on"), F.col("raiser").alias("known"))
    subscribed = s.typed(subscribed).join(declares, ["event", "on"], "left").join(alone, "event", "left").withColumn("raiser", F.coalesce("known", "only"))
    subscribed = subscribed.join(owned.toDF("type", "handler", "owner"), ["type", "handler"]).select("raiser", "event", "owner", "handler")
    raised = s.sites.select(F.col("type").alias("raiser"), "member", F.when(F.col("callee") == "Invoke", F.col("receiver")).when(F.col("receiver").isNull(), F.col("callee")).alias("event"))
    add(raised.join(events, ["raiser", "event"]).join(subscribed, ["raiser", "event"]), at("raiser", "member"), at("owner", "handler"), "E7")
    named = s.inside(s.given())
    shadowed = s.vars.select("path", "head", F.col("name").alias("given")).where("head IS NOT NULL").distinct()
    add(named.join(shadowed, ["path", "head", "given"], "left_anti").join(owned.toDF("type", "given", "owner"), ["type", "given"]), at("type", "member"), at("owner", "given"), "E8")
    job = F.when(F.col("value").isin("Enqueue", "Schedule", "AddOrUpdate") & _is("<", None, ">", "(", None, "=>", None, "."), F.struct(F.col("a2").alias("on"), F.col("a9").alias("run"))).when((F.col("value") == "Create") & (F.col("b2") == "JobBuilder") & _is("<"), F.struct(F.col("a2").alias("on"), F.lit("Execute").alias("run")))
    jobs = s.inside(near.where(job.isNotNull()).select("path", "pos", job.alias("job"))).select("type", "member", "job.*")
    add(jobs.join(owned.toDF("on", "run", "owner"), ["on", "run"]), at("type", "member"), at("owner", "run"), "E9")
    action = F.when(F.col("s2"), F.col("a2")).when(F.col("a2") == "nameof", F.col("a4"))
    moves = s.inside(near.where((F.col("value") == "RedirectToAction") & (F.col("a1") == "(") & action.isNotNull()).select("path", "pos", action.alias("action"), F.when(F.col("s2") & (F.col("a3") == ",") & F.col("s4"), F.concat("a4", F.lit("Controller"))).alias("controller")))
    moves = moves.withColumn("on", F.coalesce("controller", "type"))
    add(moves.join(owned.toDF("on", "action", "owner"), ["on", "action"]), at("type", "member"), at("owner", "action"), "E10")
    filters = near.where(F.col("value").isin("ServiceFilter", "TypeFilter") & _is("(", "typeof", "(")).select("path", F.col("block").alias("bracket"), F.col("a4").alias("filter")).join(outer, ["path", "bracket"])
    spots = filters.select("path", F.col("bracket").alias("pos"), F.col("list").alias("block"), "filter")
    block_of = self_blocks(s)
    heads = block_of.unionByName(spots.select("path", "pos", "block", "filter"), allowMissingColumns=True)
    following = F.first(F.when(F.col("head").isNotNull(), F.col("head")), ignorenulls=True).over(Window.partitionBy("path", "block").orderBy("pos").rowsBetween(1, Window.unboundedFollowing))
    filtered = heads.withColumn("next", following).where("filter IS NOT NULL AND next IS NOT NULL").select("filter", "next.*")
    filtered = filtered.where("member IS NOT NULL").select("filter", "type", "member").union(filtered.where("member IS NULL").select("filter", "type").join(members, "type").select("filter", "type", "member"))
    hooks = owned.where(F.col("member").rlike(_FILTERED)).toDF("filter", "hook", "owner")
    add(filtered.join(hooks, "filter"), at("type", "member"), at("owner", "hook"), "E11")
    delegates = s.vars.where("scope = 'field' AND (vtype IN ('Action', 'Func', 'EventHandler') OR vtype RLIKE 'Delegate$|Callback$' OR element IS NOT NULL)").select("type", "name").distinct()
    kept = s.inside(near.where((F.col("kind") == "id") & (F.col("a1") == "=") & (F.col("a3") == ";")).select("path", "pos", F.col("value").alias("name"), F.col("a2").alias("given"))).select("type", "name", "given")
    kept = kept.join(delegates, ["type", "name"]).join(owned.toDF("type", "given", "owner"), ["type", "given"])
    used = s.sites.select("type", "member", F.when(F.col("callee") == "Invoke", F.col("receiver")).when(F.col("receiver").isNull(), F.col("callee")).alias("name")).distinct()
    add(used.join(kept, ["type", "name"]), at("type", "member"), at("owner", "given"), "E12")
    fields = near.where((F.col("kind") == "id") & (F.col("a1") == "=") & ((F.col("b1_kind") == "id") | (F.col("b1") == ">"))).join(s.types.select("path", F.col("begin").alias("block"), "type"), ["path", "block"]).select("path", "pos", F.struct("type", F.col("value").alias("name")).alias("field"), F.lit(0).alias("order"))
    entry = near.where((F.col("kind") == "id") & ((F.col("b1") == ",") & (F.col("a1") == "}") & (F.col("b3") == "{") | (F.col("b1") == "=") & (F.col("b2") == "]") & F.col("a1").isin(",", "}"))).select("path", "pos", F.col("value").alias("given"), F.lit(1).alias("order"))
    tables = fields.unionByName(entry, allowMissingColumns=True).withColumn("of", F.last("field", ignorenulls=True).over(Window.partitionBy("path").orderBy("pos", "order"))).where("given IS NOT NULL AND of IS NOT NULL").select("of.*", "given")
    tables = tables.join(owned.toDF("type", "given", "owner"), ["type", "given"]).distinct()
    indexed = near.where((F.col("kind") == "id") & (F.col("a1") == "[")).select("path", "pos", F.col("value").alias("name"), F.col("a1_match").alias("close"))
    invoked = near.where((F.col("value") == "]") & ((F.col("a1") == "(") | (F.col("a1") == ".") & (F.col("a2") == "Invoke"))).select("path", F.col("pos").alias("close"))
    add(s.inside(indexed.join(invoked, ["path", "close"]).select("path", "pos", "name")).join(tables, ["type", "name"]), at("type", "member"), at("owner", "given"), "E13")
    every = written(reduce(DataFrame.unionByName, edges).distinct())
    direct = every.where("kind = 'calls'")
    return direct.unionByName(every.where("kind <> 'calls'").join(direct.select("caller", "callee"), ["caller", "callee"], "left_anti"))


def self_blocks(s: Symbols) -> DataFrame:
    """(path, pos, block, head): the heads of members and types, each in the block it is declared in."""
    of = s.near.select("path", "pos", "block")
    heads = s.members.select("path", "pos", F.struct("type", "member").alias("head")).union(s.types.select("path", "pos", F.struct("type", F.lit(None).cast("string").alias("member"))))
    return heads.join(of, ["path", "pos"]).select("path", "pos", "block", "head", F.lit(None).cast("string").alias("filter"))


def dispatch_reach(calls: DataFrame, members: DataFrame, bases: DataFrame, entries: DataFrame) -> DataFrame:
    """(node,) of the members (``Type.Member``) that run when the ``entries`` (node) do.

    A call on a type may run the member of any type below it. It goes down one level at a time, from ``T.M`` to ``S.M`` for each S right below T,
    declared there or not, so neither implementers nor their pairs with calls are spelled out; rows never exceed the edges and, for each member name, the types below its callers' types.
    ``calls`` is (caller, callee), ``members`` (type, member), ``bases`` (type, base).
    """
    edges = written(calls.select(F.col("caller").alias("src"), F.col("callee").alias("dst")).where("src <> dst").distinct())
    down = bases.select(F.col("base").alias("over"), F.col("type").alias("under")).where("over <> under").distinct()

    def onward(rows: DataFrame) -> DataFrame:
        called = rows.join(edges, rows["node"] == edges["src"]).select(F.col("dst").alias("node"))
        parts = rows.select(F.substring_index("node", ".", 1).alias("over"), F.substring_index("node", ".", -1).alias("member"))
        return called.union(parts.join(down, "over").select(F.concat_ws(".", "under", "member").alias("node"))).distinct()

    rounds = Rounds(calls.sparkSession)
    frontier = rounds.add(entries.select("node").distinct())
    while not frontier.isEmpty():
        steps = [frontier]
        for _ in range(LEVELS):
            steps.append(onward(steps[-1]))
        frontier = rounds.add(reduce(DataFrame.union, steps[1:]).distinct().join(rounds.table(), "node", "left_anti"))
    seen = rounds.table()
    return seen.join(members.select(F.concat_ws(".", "type", "member").alias("node")).distinct(), "node", "left_semi")


def routine_reach(sites: DataFrame, reached: DataFrame) -> DataFrame:
    """(routine, sites, reachable_sites, reachable) of database routines from (routine, node) of the members that name them and the (node,) that entry points reach."""
    known = reached.select("node").distinct().withColumn("hit", F.lit(True))
    return sites.join(known, "node", "left").groupBy("routine").agg(F.count("*").alias("sites"), F.count("hit").alias("reachable_sites"), (F.count("hit") > 0).alias("reachable"))


def call_tree(edges: DataFrame, roots: DataFrame, depth: int = 4, limit: int = 400) -> DataFrame:
    """(root, line, level, node, again) of the call tree of each root as a depth-first walk writes it, callees in the order of ``place``.

    A node is expanded where the walk meets it first, above ``depth``; later meetings are lines marked ``again``. A tree has ``limit`` lines at most (0: no limit).
    ``edges`` is (src, dst, place), ``roots`` (root). The part of the graph within ``depth`` calls of a root is gathered in one group, and only that.
    """
    e = edges.groupBy("src", "dst").agg(F.min("place").alias("place"))
    starts = roots.select(F.col("root").alias("seed")).distinct()
    near = reach(e.select("src", "dst"), starts, depth=max(1, depth - 1)).select("seed", F.col("node").alias("src")) if depth > 1 else starts.limit(0).select("seed", F.col("seed").alias("src"))
    part = near.union(starts.select("seed", F.col("seed").alias("src"))).distinct().join(e, "src").select(F.col("seed").alias("root"), "src", "dst", "place")
    part = part.unionByName(starts.select(F.col("seed").alias("root")), allowMissingColumns=True)
    kind = dict(edges.dtypes)["src"]
    arrow = pa.string() if kind == "string" else pa.int64()

    def walk(key, table):
        below: dict = {}
        for src, _, dst in sorted((r["src"], r["place"], r["dst"]) for r in table.to_pylist() if r["src"] is not None):
            below.setdefault(src, []).append(dst)
        root, seen, lines, todo = key[0].as_py(), set(), [], [(key[0].as_py(), 0)]
        while todo and (not limit or len(lines) < limit):
            node, level = todo.pop()
            lines.append((level, node, node in seen))
            if node not in seen and level < depth:
                seen.add(node)
                todo += [(x, level + 1) for x in reversed(below.get(node, []))]
        return pa.table({"root": pa.array([root] * len(lines), arrow), "line": pa.array(range(1, len(lines) + 1), pa.int32()), "level": pa.array([x[0] for x in lines], pa.int32()), "node": pa.array([x[1] for x in lines], arrow), "again": pa.array([x[2] for x in lines], pa.bool_())})

    return part.groupBy("root").applyInArrow(walk, f"root {kind}, line int, level int, node {kind}, again boolean")


def load_graph(links: DataFrame, relations=("calls", "indirect_call", "dispatches_to", "implements", "inherits", "uses", "references")) -> DataFrame:
    """(src, dst) of a code graph's links (src, dst, relation); what implements or inherits is reached from what it implements as well."""
    kept = links.where(F.col("relation").isin(*relations))
    back = kept.where(F.col("relation").isin("implements", "inherits")).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return kept.select("src", "dst").union(back).distinct()


def workflows(graph: DataFrame, nodes: DataFrame, entries: DataFrame, marks: DataFrame, bucket: int = 256) -> DataFrame:
    """One row for each entry point: its ``entry``, ``nodes`` (how many it reaches), and one sorted array of names for each kind of mark.

    ``graph`` is (src, dst), ``nodes`` (node, file, first, last), ``entries`` (entry, file, first, last), ``marks`` (kind, name, file, line). An entry starts at the nodes
    that begin within its lines; the code it runs is its own lines and those of all nodes reached. A mark belongs to it if it stands in that code: spans and marks
    meet on file and a block of ``bucket`` lines. Of entries with the same lines one is followed, as they run the same code, and marks that are the same count once.
    """
    blocks = lambda a, b: F.explode(F.sequence((F.col(a) / bucket).cast("long"), (F.col(b) / bucket).cast("long")))
    marks = written(marks.select("kind", "name", "file", "line").distinct())
    kinds = [r[0] for r in marks.select("kind").distinct().orderBy("kind").collect()]  # a few names of kinds
    places = entries.where("entry IS NOT NULL").groupBy("entry").agg(F.array_sort(F.collect_set(F.struct("file", "first", "last"))).alias("places"))
    first_of = places.groupBy("places").agg(F.min("entry").alias("lead"))
    led = written(places.join(first_of, "places").select("entry", "lead", "places"))
    followed = led.where("entry = lead").select("entry", F.explode("places").alias("place")).select("entry", "place.*")
    asked = followed.select("entry", "file", "first", "last", blocks("first", "last").alias("block"))
    placed = nodes.select("node", "file", F.col("first").alias("at"), (F.col("first") / bucket).cast("long").alias("block"))
    seeds = asked.join(placed, ["file", "block"]).where("at BETWEEN first AND last").select("entry", F.col("node").alias("seed")).distinct()
    seeds = written(seeds)
    ran = reach(graph, seeds.select("seed").distinct()).select("seed", "node")
    ran = written(seeds.join(ran, "seed").select("entry", "node").union(seeds.select("entry", F.col("seed").alias("node"))).distinct())
    spans = ran.join(nodes, "node").select("entry", "file", "first", "last").union(followed).distinct()
    spans = spans.select("entry", "file", "first", "last", blocks("first", "last").alias("block"))
    hits = spans.join(marks.withColumn("block", (F.col("line") / bucket).cast("long")), ["file", "block"]).where("line BETWEEN first AND last").select("entry", "kind", "name").distinct()
    sets = hits.groupBy("entry").agg(*[F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.col("name")))).alias(k) for k in kinds])
    counts = ran.groupBy("entry").agg(F.count("*").alias("nodes"))
    found = led.select("entry", "lead").join(counts.join(sets, "entry", "full").withColumnRenamed("entry", "lead"), "lead").drop("lead")
    out = entries.select("entry").distinct().join(found, "entry", "left")
    return out.select("entry", F.coalesce("nodes", F.lit(0)).alias("nodes"), *[F.coalesce(k, F.array().cast("array<string>")).alias(k) for k in kinds])
