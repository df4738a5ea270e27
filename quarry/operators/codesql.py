"""SQL in C# sources: concatenations joined to one text, candidates accepted or rejected with reasons, and procedures called through wrappers.

Sources become rows of tokens (``functions.csharp``). A concatenation is a run of tokens between separators at one bracket level, and its operands
are the parts between plus signs, so windows and groups over (source, block) join it; what is appended to a variable later (``+=``) follows its
assignment. Wrapper methods are found by a fixpoint over calls: facts of one round are the call patterns of the next.
A source is one row of text, so a window holds one source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.csharp import HOLE, tokens_of
from quarry.operators import sqltext
from quarry.session import written

#: First words of SQL text. Fixed values.
SQL_START = "SELECT INSERT UPDATE DELETE MERGE EXEC EXECUTE WITH CREATE ALTER DROP TRUNCATE DECLARE SET IF BEGIN BULK USE GRANT SP_EXECUTESQL".split()
#: Names of data-access calls and types near SQL text; those of object query languages alone do not make it SQL. Fixed values.
DATA_API = """SqlCommand CommandText ExecuteReader ExecuteReaderAsync ExecuteNonQuery ExecuteNonQueryAsync ExecuteScalar ExecuteScalarAsync Query QueryAsync
QueryFirst QueryFirstAsync QueryFirstOrDefault QueryFirstOrDefaultAsync QuerySingle QuerySingleAsync QuerySingleOrDefault QuerySingleOrDefaultAsync QueryMultiple QueryMultipleAsync
Execute ExecuteAsync FromSqlRaw FromSqlInterpolated FromSql ExecuteSqlRaw ExecuteSqlRawAsync ExecuteSqlInterpolated ExecuteSqlInterpolatedAsync ExecuteSql ExecuteSqlAsync
SqlQuery SqlQueryRaw ExecuteSqlCommand ExecuteSqlCommandAsync ExecuteStoreQuery ExecuteStoreCommand CreateSQLQuery CreateSqlQuery ExecuteQuery ExecuteCommand DbCommand
OleDbCommand OdbcCommand SqlDataAdapter DataAdapter CreateCommand SqlBulkCopy Database DbContext IDbConnection SqlConnection DbConnection CreateQuery""".split()
OBJECT_QUERIES = ["CreateQuery"]
ALSO_SQL = "CreateSQLQuery CreateSqlQuery SqlCommand CommandText FromSqlRaw ExecuteSqlRaw Query QueryAsync Execute ExecuteAsync ExecuteReader ExecuteScalar ExecuteNonQuery".split()
#: Tokens around a candidate in which a data-access name counts.
BEFORE, AFTER = 120, 40
_STOPS = [";", ",", "=", "+=", "?", ":", "{", "}", "=>"]
#: Words that are followed by a bracket without being methods.
_CONTROL = "if for foreach while switch catch using lock return new nameof typeof sizeof default await throw when base this".split()
#: What the text of each first word must look like to be a statement.
_SHAPES = {
    "SELECT": r"(?is)^select\s+\S", "INSERT": r"(?is)^insert\s+(into\s+)?\S+.*(\(|\bvalues\b|\bselect\b|\bexec|\bdefault\b)", "UPDATE": r"(?is)^update\s+\S.*\bset\s+\S+\s*[-+*/]?=",
    "DELETE": r"(?is)^delete\s+(from\s+)?[\[\"@#\w.]+\s*(;|$|where\b|from\b|output\b|\w+\s+from\b)", "MERGE": r"(?is)^merge\s+.*\busing\b.*\bwhen\b", "EXEC": r"(?is)^exec\s*[\[\"@#\w(]", "EXECUTE": r"(?is)^execute\s*[\[\"@#\w(]",
    "WITH": r"(?is)^with\s+\S+\s*(\([^()]*\)\s*)?as\s*\(", "CREATE": r"(?is)^create\s+(or\s+alter\s+)?(unique\s+)?((non)?clustered\s+)?(table|view|proc|function|trigger|type|sequence|synonym|schema|index)",
    "ALTER": r"(?is)^alter\s+(table|view|proc|function|trigger|sequence|schema|index|database)", "DROP": r"(?is)^drop\s+(table|view|proc|function|trigger|type|sequence|synonym|schema|index)", "TRUNCATE": r"(?is)^truncate\s+table\s",
    "DECLARE": r"(?is)^declare\s+@", "SET": r"(?is)^set\s+(@|[a-z_]+\s+(on|off|\S+\s+(on|off))\b|transaction\b|rowcount\b)", "IF": r"(?is)^if\s+(not\s+)?(exists\s*\(|@|\(|object_id)", "BEGIN": r"(?is)^begin\s*(tran|try|\S+\s)", "BULK": r"(?is)^bulk\s+insert\s", "USE": r"(?is)^use\s+\S+\s*(;|$)", "GRANT": r"(?is)^grant\s+.*\bto\s", "SP_EXECUTESQL": r"(?is)^sp_executesql\s",
}
#: What a hole may stand for, the plainest reading first: a value, a name, nothing.
READINGS = [("value", "@p"), ("name", "dyn_p"), ("nothing", "")]


def code_tokens(sources: DataFrame, path: str, text: str) -> DataFrame:
    """(path, pos, kind, value, line, end_line, holes, block, match) of every token of C# sources."""
    return sources.select(F.col(path).alias("path"), F.posexplode(tokens_of(F.col(text))).alias("pos", "t")).select("path", "pos", "t.*")


def concatenations(tokens: DataFrame) -> DataFrame:
    """(path, pos, last_pos, line, end_line, text, holes, operands, variable, opener) of each string and each concatenation with a string.

    Operands that are no strings, and what holes stand for, are HOLE in the text; operands before the first string are left out. ``variable`` is the name to the left
    of the assignment that the text follows, ``opener`` the separator before it.
    """
    level = Window.partitionBy("path", "block").orderBy("pos")
    stop = (F.col("kind") == "op") & F.col("value").isin(_STOPS) | (F.col("kind") == "id") & (F.col("value") == "return")
    rows = tokens.select("*", stop.alias("stop"), F.lag("value").over(level).alias("left"))
    rows = rows.select("*", F.count_if("stop").over(level).alias("run"))
    plus = F.count_if((F.col("kind") == "op") & (F.col("value") == "+"))
    rows = rows.select("*", plus.over(Window.partitionBy("path", "block", "run").orderBy("pos")).alias("operand"))
    opened = F.first(F.when(F.col("stop"), F.struct(F.col("value").alias("opener"), "left")), ignorenulls=True)
    body = ~F.col("stop") & ~((F.col("kind") == "op") & (F.col("value") == "+"))
    single = (F.count_if(body) == 1) & (F.count_if(body & (F.col("kind") == "str")) == 1)
    of = lambda c: F.min(F.when(body & (F.col("kind") == "str"), F.col(c)))
    parts = rows.groupBy("path", "block", "run", "operand").agg(
        F.when(single, of("value")).alias("value"), F.when(single, of("holes")).otherwise(1).alias("holes"), F.when(single, of("pos")).alias("pos"), F.when(single, of("line")).alias("line"),
        F.when(single, of("end_line")).alias("end_line"), F.max("pos").alias("last_pos"), opened.alias("opened"),
    )
    runs = parts.groupBy("path", "block", "run").agg(
        F.array_sort(F.collect_list(F.struct("operand", F.coalesce("value", F.lit(f" {HOLE} ")).alias("value"), "holes", F.col("pos").isNotNull().alias("string")))).alias("parts"),
        F.min("pos").alias("pos"), F.max("last_pos").alias("last_pos"), F.min_by("line", "pos").alias("line"), F.max("end_line").alias("end_line"), F.max("opened").alias("opened"), F.min(F.when(F.col("pos").isNotNull(), F.col("operand"))).alias("first"),
    )
    kept = F.filter("parts", lambda p: p["operand"] >= F.col("first"))
    runs = runs.where("first IS NOT NULL").withColumn("parts", kept)
    holes = F.aggregate("parts", F.lit(0), lambda n, p: n + p["holes"].cast("int"))
    assigned = F.col("opened")["opener"].isin("=", "+=")
    return runs.select("path", "pos", "last_pos", "line", "end_line", F.array_join(F.transform("parts", lambda p: p["value"]), "").alias("text"), holes.alias("holes"), F.size("parts").alias("operands"), F.when(assigned, F.col("opened")["left"]).alias("variable"), F.col("opened")["opener"].alias("opener"))


def assembled(found: DataFrame) -> DataFrame:
    """The concatenations, with what ``+=`` appends to a variable joined to the text that was assigned to it before."""
    here = Window.partitionBy("path", "variable").orderBy("pos")
    begins = F.coalesce(F.col("opener") != "+=", F.lit(True)) | F.col("variable").isNull()
    rows = found.withColumn("chain", F.when(F.col("variable").isNull(), F.col("pos")).otherwise(F.max(F.when(begins, F.col("pos"))).over(here)))
    rows = rows.withColumn("chain", F.coalesce("chain", "pos"))
    parts = F.array_sort(F.collect_list(F.struct("pos", "text")))
    grouped = rows.groupBy("path", F.coalesce("variable", F.lit("")).alias("variable"), "chain").agg(parts.alias("parts"), F.max("last_pos").alias("last_pos"), F.min("line").alias("line"), F.max("end_line").alias("end_line"), F.sum("holes").cast("int").alias("holes"), F.sum("operands").cast("int").alias("operands"))
    return grouped.select("path", F.col("chain").alias("pos"), "last_pos", "line", "end_line", F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"), "holes", "operands", "variable")


def sql_candidates(sources: DataFrame, path: str, text: str) -> DataFrame:
    """(path, pos, line, end_line, text, holes, dynamic, context, keyword, keyword_case) of the texts in C# sources whose first word is one of SQL."""
    tokens = code_tokens(sources, path, text)
    found = assembled(concatenations(tokens))
    first = F.regexp_extract("text", r"^[\s(;]*(\w+)", 1)
    found = found.withColumn("first", first).where(F.upper("first").isin(SQL_START) & (F.length("text") >= 8))
    apis = tokens.where((F.col("kind") == "id") & F.col("value").isin(DATA_API)).groupBy("path").agg(F.collect_list(F.struct("pos", "value")).alias("apis"))
    near = F.filter(F.coalesce("apis", F.array()), lambda a: (a["pos"] >= F.col("pos") - BEFORE) & (a["pos"] < F.col("last_pos") + AFTER))
    case = F.when(F.col("first") == F.upper("first"), "upper").when(F.col("first") == F.lower("first"), "lower").otherwise("mixed")
    return found.join(apis, "path", "left").select("path", "pos", "line", "end_line", "text", "holes", (F.col("holes") > 0).alias("dynamic"), F.array_sort(F.array_distinct(F.transform(near, lambda a: a["value"]))).alias("context"), F.upper("first").alias("keyword"), case.alias("keyword_case"))


def scan_code(sources: DataFrame, path: str, text: str) -> DataFrame:
    """The candidates with ``reading``, ``sql`` and ``reason``: accepted, parse_error, no_context or object_query.

    A candidate parses if its brackets and strings match and it has its statement's shape in one of READINGS; the first that does is taken.
    Without a data-access name near it, a keyword in mixed case is taken for prose.
    """
    found = sql_candidates(sources, path, text)
    readings = F.array(*[F.struct(F.lit(k).alias("order"), F.lit(n).alias("reading"), F.replace("text", F.lit(HOLE), F.lit(v)).alias("sql")) for k, (n, v) in enumerate(READINGS)])
    tried = found.select("path", "pos", "keyword", F.explode(F.when(F.col("holes") > 0, readings).otherwise(F.slice(readings, 1, 1))).alias("r")).select("path", "pos", "keyword", "r.*")
    code = tried.withColumn("code", F.trim(F.regexp_replace(sqltext.code_only("sql"), r"^[\s(;]+", "")))
    shape = F.lit(False)
    for word, pattern in _SHAPES.items():
        shape = F.when(F.col("keyword") == word, F.col("code").rlike(pattern)).otherwise(shape)
    marks = F.regexp_count("code", F.lit(r"\(")) == F.regexp_count("code", F.lit(r"\)"))
    whole = ~F.replace("code", F.lit("''"), F.lit("")).contains("'") & ~F.col("code").rlike(r"(?i)(,|=|\b(?:where|and|or|from|join|on|set|by|into|values|in|like))\s*;?\s*$")
    good = code.where(shape & marks & whole).groupBy("path", "pos").agg(F.min(F.struct("order", "reading", "sql")).alias("best"))
    out = found.join(good, ["path", "pos"], "left")
    is_object_query = F.arrays_overlap("context", F.array(*map(F.lit, OBJECT_QUERIES))) & ~F.arrays_overlap("context", F.array(*map(F.lit, ALSO_SQL)))
    reason = F.when(F.col("best").isNull(), "parse_error").when((F.size("context") == 0) & (F.col("keyword_case") == "mixed"), "no_context").when(is_object_query, "object_query").otherwise("accepted")
    return out.select(*found.columns, F.col("best")["reading"].alias("reading"), F.col("best")["sql"].alias("sql"), reason.alias("reason"))


def methods(tokens: DataFrame) -> DataFrame:
    """(path, pos, method, params, begin, end) of each method with a body; begin and end are the places of its braces."""
    here = Window.partitionBy("path").orderBy("pos")
    rows = tokens.select("path", "pos", "kind", "value", "block", "match", *[F.lead(c).over(here).alias(f"next_{c}") for c in ("value", "match", "pos")], F.lag("value").over(here).alias("prev"), F.lag("kind").over(here).alias("prev_kind"))
    typed = (F.col("prev_kind") == "id") & ~F.col("prev").isin("new", "return", "await", "throw", "else", "in", "is", "as") | F.col("prev").isin(">", "]", "?")
    heads = rows.where((F.col("kind") == "id") & (F.col("next_value") == "(") & typed & ~F.col("value").isin(_CONTROL)).select("path", "pos", F.col("value").alias("method"), F.col("next_pos").alias("list"), F.col("next_match").alias("close"))
    bodies = rows.where((F.col("value") == ")") & (F.col("next_value") == "{")).select("path", F.col("pos").alias("close"), F.col("next_pos").alias("begin"), F.col("next_match").alias("end"))
    heads = heads.join(bodies, ["path", "close"])
    level = Window.partitionBy("path", "block").orderBy("pos")
    inner = tokens.where((F.col("block") >= 0) & F.col("kind").isin("id", "op")).select("*", F.count_if(F.col("value") == ",").over(level).alias("arg"), F.max(F.col("value") == "=").over(level).alias("default"))
    names = inner.where((F.col("kind") == "id") & ~F.col("default")).groupBy("path", F.col("block").alias("list"), "arg").agg(F.max_by("value", "pos").alias("name"))
    params = names.groupBy("path", "list").agg(F.transform(F.array_sort(F.collect_list(F.struct("arg", "name"))), lambda p: p["name"]).alias("params"))
    return heads.join(params, ["path", "list"], "left").select("path", "pos", "method", F.coalesce("params", F.array().cast("array<string>")).alias("params"), "begin", "end")


def calls(tokens: DataFrame) -> DataFrame:
    """(path, pos, line, callee, arg, form, value, method, param) for every argument of every call.

    form is literal, name or expression. method is the method around the call, and param the number of its parameter that a name is (null: none).
    """
    declared = methods(tokens)
    here = Window.partitionBy("path").orderBy("pos")
    bodies = declared.select("path", F.col("begin").alias("pos"), F.struct("method", "params", "end").alias("body"))
    rows = tokens.join(bodies, ["path", "pos"], "left").join(declared.select("path", "pos", F.lit(True).alias("is_head")), ["path", "pos"], "left")
    rows = rows.select("*", F.last("body", ignorenulls=True).over(here).alias("around"), F.lead("value").over(here).alias("next_value"), F.lead("pos").over(here).alias("next_pos"))
    site = (F.col("kind") == "id") & (F.col("next_value") == "(") & ~F.col("value").isin(_CONTROL) & F.col("is_head").isNull()
    around = F.when(F.col("around")["end"] > F.col("pos"), F.col("around"))
    sites = rows.where(site).select("path", "pos", "line", F.col("value").alias("callee"), F.col("next_pos").alias("list"), around.alias("around"))
    level = Window.partitionBy("path", "block").orderBy("pos")
    inner = tokens.where("block >= 0").select("*", F.count_if((F.col("kind") == "op") & (F.col("value") == ",")).over(level).alias("arg")).where(~((F.col("kind") == "op") & (F.col("value") == ",")))
    args = inner.groupBy("path", F.col("block").alias("list"), "arg").agg(F.count("*").alias("n"), F.min(F.struct("pos", "kind", "value", "holes")).alias("t"))
    form = F.when((F.col("n") == 1) & (F.col("t")["kind"] == "str") & (F.col("t")["holes"] == 0), "literal").when((F.col("n") == 1) & (F.col("t")["kind"] == "id"), "name").otherwise("expression")
    param = F.array_position(F.col("around")["params"], F.col("t")["value"]) - 1
    return sites.join(args, ["path", "list"]).select("path", "pos", "line", "callee", F.col("arg").cast("int").alias("arg"), form.alias("form"), F.col("t")["value"].alias("value"), F.col("around")["method"].alias("method"), F.when((form == "name") & (param >= 0), param.cast("int")).alias("param"))


def constants(tokens: DataFrame) -> DataFrame:
    """(name, value) of the string constants of all sources: ``const string Name = "..."`` and ``static readonly string``; of several values the least."""
    here = Window.partitionBy("path").orderBy("pos")
    rows = tokens.select("kind", "value", "holes", *[F.lag("value", k).over(here).alias(f"p{k}") for k in (1, 2, 3, 4)])
    found = rows.where((F.col("kind") == "str") & (F.col("holes") == 0) & (F.col("p1") == "=") & (F.lower("p3") == "string") & F.col("p4").isin("const", "readonly"))
    return found.groupBy(F.col("p2").alias("name")).agg(F.min("value").alias("value"))


def procedure_sites(sources: DataFrame, path: str, text: str, roots: DataFrame, share: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """((path, line, callee, procedure, how) of the calls that name a stored procedure, (method, param, round, kept) of the wrappers).

    ``roots`` (method, param) are the calls whose argument ``param`` is a procedure's name. A method that hands one of its own parameters to such a
    call is a wrapper, and its calls are looked at in the next round; each round joins only the wrappers that the last one added, until none is new. A wrapper found that way is kept if at least ``share`` of the
    calls to it (and at least one) name the procedure by a literal or a constant, and if what it was found through is kept. how is literal, constant, variable or expression.
    """
    tokens = written(code_tokens(sources, path, text))
    sites = written(calls(tokens))
    known = written(roots.select(F.col("method"), F.col("param").cast("int").alias("param"), F.lit(0).alias("round"), F.lit(None).cast("string").alias("through")))
    delta, number = known, 0
    while not delta.isEmpty():
        number += 1
        hits = sites.join(delta.select(F.col("method").alias("callee"), F.col("param").alias("arg")), ["callee", "arg"])
        new = hits.where("param IS NOT NULL").groupBy("method", "param").agg(F.lit(number).alias("round"), F.min("callee").alias("through"))
        delta = written(new.join(known, ["method", "param"], "left_anti"))
        known = written(known.unionByName(delta))
    named = sites.join(known.select(F.col("method").alias("callee"), F.col("param").alias("arg"), "round"), ["callee", "arg"])
    own = constants(tokens).withColumnRenamed("value", "constant")
    named = named.join(own, (F.col("form") == "name") & (F.col("value") == F.col("name")), "left")
    clear = (F.col("form") == "literal") | F.col("constant").isNotNull()
    rated = named.groupBy(F.col("callee").alias("method"), F.col("arg").alias("param")).agg(F.count("*").alias("calls"), F.count_if(clear).alias("clear"))
    rated = known.join(rated, ["method", "param"], "left")
    poor = (F.col("round") > 0) & (F.coalesce("clear", F.lit(0)) < F.greatest(F.lit(1.0), share * F.coalesce("calls", F.lit(0))))
    rated = written(rated.select("method", "param", "round", "through", poor.alias("poor")))
    for step in range(1, number + 1):  # what was found through a rejected wrapper goes too, round by round
        bad = rated.where("poor").select(F.col("method").alias("through")).distinct().withColumn("bad", F.lit(True))
        rated = written(rated.join(bad, "through", "left").select("method", "param", "round", "through", (F.col("poor") | (F.col("bad").isNotNull() & (F.col("round") == step))).alias("poor")))
    kept = rated.where("NOT poor").select(F.col("method").alias("callee"), F.col("param").alias("arg"))
    forwards = rated.where("NOT poor").select("method", "param", F.lit(True).alias("forwards"))
    out = named.join(kept, ["callee", "arg"], "left_semi").join(forwards, ["method", "param"], "left").where(F.col("forwards").isNull())
    how = F.when(F.col("form") == "literal", "literal").when(F.col("constant").isNotNull(), "constant").when(F.col("form") == "name", "variable").otherwise("expression")
    procedure = F.when(F.col("form") == "literal", F.col("value")).otherwise(F.col("constant"))
    return out.select("path", "line", "callee", procedure.alias("procedure"), how.alias("how")), rated.select("method", "param", "round", (~F.col("poor")).alias("kept"))
