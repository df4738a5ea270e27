"""SQL scripts (T-SQL) as data: batches, tokens, statements, objects, lineage, constructs and errors.

A script is cut into tokens by one pattern; tokens are rows, and what a token means follows from windows over the tokens of its
script: the words around it, the depth of parentheses, the clause it stands in, and the statement it belongs to. Common table
expressions, aliases and targets are resolved within their statement. Comments, strings and quoted names are tokens of
their own, so nothing inside them counts. A script is one row of text, so a window holds one script.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.rules import line_explode

_NAME = r'(?:\[[^\]]*+(?:\]\][^\]]*+)*+\]|"[^"]*+(?:""[^"]*+)*+"|[@#]{0,2}[\p{L}_][\p{L}\p{N}_@#$]*+)'
_COMMENT = r"--[^\n]*|/\*(?:[^*]|\*(?!/))*+(?:\*/)?"
_STRING = r"[Nn]?'[^']*+(?:''[^']*+)*+'?"
#: Tokens in the order in which they are tried: separators of batches, comments, strings, row limits, names of several parts, numbers, line breaks, single characters.
TOKEN = rf"(?m:^)[ \t]*[Gg][Oo](?:[ \t]+[0-9]+)?[ \t]*;?[ \t]*(?=\r?(?m:$))|{_COMMENT}|{_STRING}|(?i:\btop)\s*\([^()]*\)(?i:\s+percent\b)?(?i:\s+with\s+ties\b)?|{_NAME}(?:[ \t]*\.[ \t]*(?:{_NAME})?)*|[0-9]+(?:\.[0-9]+)?\w*|\n|\S"

#: Words that never name a table or an alias after one.
RESERVED = """add all alter and any apply as asc begin between by case close commit create cross cursor deallocate declare default delete desc
distinct drop else end escape except exec execute exists fetch for foreign from full function go grant group having if in index inner insert
intersect into is join key left like merge next not null of on open option or order outer output over percent pivot primary print proc procedure raiserror
references return returns revoke right rollback select set table tablesample then throw to top trigger truncate union unique unpivot update use using values view
when where while with""".upper().split()
#: Words that begin a statement wherever they stand outside parentheses.
OPENERS = "TRUNCATE EXEC EXECUTE CREATE ALTER DROP DECLARE IF WHILE RETURN PRINT BEGIN FETCH OPEN CLOSE DEALLOCATE USE GRANT DENY REVOKE RAISERROR THROW COMMIT ROLLBACK".split()
VERBS = "SELECT INSERT UPDATE DELETE MERGE".split()
CLAUSES = "SELECT FROM WHERE GROUP ORDER HAVING SET VALUES INTO USING WHEN OPTION OUTPUT INSERT UPDATE DELETE MERGE EXEC EXECUTE CREATE ALTER DROP DECLARE".split()
KINDS = {"TABLE": "table", "VIEW": "view", "PROC": "procedure", "PROCEDURE": "procedure", "FUNCTION": "function", "TRIGGER": "trigger", "TYPE": "type", "SEQUENCE": "sequence", "SYNONYM": "synonym", "SCHEMA": "schema", "INDEX": "index"}
#: Words after WITH that are options, not names of common table expressions.
_OPTIONS = "RECOMPILE ENCRYPTION SCHEMABINDING EXECUTE EXEC NATIVE_COMPILATION VIEW_METADATA CHECK NOCHECK TIES GRANT XMLNAMESPACES NOLOCK".split()
_HINTS = "NOLOCK READUNCOMMITTED READPAST UPDLOCK XLOCK HOLDLOCK SERIALIZABLE REPEATABLEREAD TABLOCK TABLOCKX PAGLOCK ROWLOCK NOWAIT READCOMMITTED READCOMMITTEDLOCK FORCESEEK INDEX".split()

#: Constructs that a port has to look at, with the pattern that counts them in code without comments and strings. The patterns mean the same in Java and RE2.
CONSTRUCTS = {
    "top": r"(?i)\btop[ ]*\(?[ ]*[0-9@]",
    "apply": r"(?i)\b(?:cross|outer)\s+apply\b",
    "nolock": r"(?i)\b(?:nolock|readuncommitted)\b",
    "readpast": r"(?i)\breadpast\b",
    "locking_hints": r"(?i)\b(?:updlock|xlock|holdlock|tablockx?|paglock)\b",
    "temp_table": r"#[A-Za-z_]+",
    "table_variable": r"(?i)\bdeclare\s+@[a-z0-9_]+\s+(?:as\s+)?table\b",
    "dynamic": r"(?i)\b(?:exec(?:ute)?\s*\(|sp_executesql\b)",
    "merge": r"(?i)\bmerge\s+(?:into\s+)?[\[a-z#\"]",
    "output": r"(?i)\boutput\s+(?:inserted|deleted)\b",
    "identity": r"(?i)(?:@@identity|\bscope_identity\b|\bident_current\b)",
    "identity_column": r"(?i)\bidentity\s*(?:\(|[,)\n])",
    "identity_insert": r"(?i)\bidentity_insert\b",
    "cursor": r"(?i)\bcursor\s+(?:local\s+|global\s+|fast_forward\s+|static\s+|read_only\s+|forward_only\s+)*for\b",
    "cte": r"(?i)(?:\bwith|,)\s*[\[\]a-z0-9_]+\s*(?:\([^()]*\)\s*)?as\s*\(\s*select\b",
    "try_catch": r"(?i)\bbegin\s+try\b",
    "transactions": r"(?i)\bbegin\s+tran(?:saction)?\b",
    "savepoint": r"(?i)\bsave\s+tran(?:saction)?\b",
    "raiserror": r"(?i)\braiserror\b",
    "throw": r"(?i)\bthrow\b",
    "waitfor": r"(?i)\bwaitfor\b",
    "goto": r"(?i)\bgoto\b",
    "while_loop": r"(?i)\bwhile\b",
    "print": r"(?i)\bprint\b",
    "pivot": r"(?i)\b(?:un)?pivot\s*\(",
    "for_xml": r"(?i)\bfor\s+xml\b",
    "for_json": r"(?i)\bfor\s+json\b",
    "openjson": r"(?i)\bopenjson\s*\(",
    "openxml": r"(?i)\bopenxml\s*\(",
    "openquery": r"(?i)\bopen(?:query|rowset)\s*\(",
    "bulk_insert": r"(?i)\bbulk\s+insert\b",
    "full_text": r"(?i)\b(?:contains|freetext)(?:table)?\s*\(",
    "execute_as": r"(?i)\bexecute\s+as\b",
    "use_database": r"(?i)\buse\s+[\[a-z]",
    "sequence": r"(?i)\b(?:next\s+value\s+for|create\s+sequence)\b",
    "synonym": r"(?i)\bcreate\s+synonym\b",
    "iif": r"(?i)\biif\s*\(",
    "try_convert": r"(?i)\btry_(?:convert|cast|parse)\s*\(",
    "convert": r"(?i)\bconvert\s*\(",
    "isnull": r"(?i)\bisnull\s*\(",
    "getdate": r"(?i)\b(?:getdate|getutcdate|sysdatetime)\s*\(",
    "date_functions": r"(?i)\b(?:dateadd|datediff|datepart|datename|eomonth)\s*\(",
    "newid": r"(?i)\bnew(?:sequential)?id\s*\(",
    "max_type": r"(?i)\(\s*max\s*\)",
    "money": r"(?i)\b(?:small)?money\b",
    "uniqueidentifier": r"(?i)\buniqueidentifier\b",
    "datetime": r"(?i)\b(?:small)?datetime\b",
    "xml_type": r"(?i)\bxml\b",
    "hierarchy_spatial": r"(?i)\b(?:hierarchyid|geography|geometry)\b",
    "extended_procedure": r"(?i)\bxp_[a-z]+",
    "global_variable": r"(?i)@@[a-z_]+",
    "index": r"(?i)\bcreate\s+(?:unique\s+)?(?:(?:non)?clustered\s+)?index\b",
    "permissions": r"(?i)\b(?:grant|deny|revoke)\s",
    "set_options": r"(?i)\bset\s+(?:ansi_nulls|quoted_identifier|xact_abort|ansi_padding|arithabort|concat_null_yields_null)\b",
}

#: Words, in lower case, of which a text holds one wherever the pattern of the construct can match; the name of the construct where nothing is said.
WORDS = {k: k for k in CONSTRUCTS} | {
    "nolock": "nolock readuncommitted", "locking_hints": "updlock xlock holdlock tablock paglock", "temp_table": "#", "table_variable": "declare", "dynamic": "exec", "identity": "identity ident_current",
    "identity_column": "identity", "cte": "select", "try_catch": "try", "transactions": "tran", "savepoint": "tran", "while_loop": "while", "for_xml": "xml", "for_json": "json", "openquery": "openquery openrowset",
    "bulk_insert": "bulk", "full_text": "contains freetext", "execute_as": "execute", "use_database": "use", "sequence": "sequence next", "try_convert": "try_", "getdate": "getdate getutcdate sysdatetime",
    "date_functions": "date eomonth", "newid": "newid newsequentialid", "max_type": "max", "xml_type": "xml", "hierarchy_spatial": "hierarchyid geography geometry", "extended_procedure": "xp_", "global_variable": "@@",
    "permissions": "grant deny revoke", "set_options": "set",
}


def batches(scripts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, batch, line_no, body): parts between lines of GO alone (or GO n), blank ones left out; line_no is their first line."""
    lines = line_explode(scripts.select(key, text), text)
    go = F.col("line").rlike(r"(?i)^[ \t]*go([ \t]+[0-9]+)?[ \t]*;?[ \t]*$")
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("part", F.count_if(go).over(w)).where(~go)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    parts = lines.groupBy(key, "part").agg(F.min("line_no").alias("line_no"), body.alias("body")).where(F.trim(F.regexp_replace("body", r"[\s]+", "")) != "")
    return parts.select(key, F.row_number().over(Window.partitionBy(key).orderBy("part")).alias("batch"), "line_no", "body")


def code_only(text: str) -> Column:
    """The text with each comment as a blank and each string as ''; quoted names stay."""
    pieces = F.regexp_extract_all(text, F.lit(rf"""{_COMMENT}|{_STRING}|\[[^\]]*+\]|"[^"]*+"|[^\["'/Nn-]++|[\["'/Nn-]"""), 0)
    return F.array_join(F.transform(pieces, lambda t: F.when(t.startswith("--") | t.startswith("/*"), " ").when(t.rlike("^[Nn]?'"), "''").otherwise(t)), "")


def census(rows: DataFrame, text: str, *keep: str) -> DataFrame:
    """One column for each construct with its count outside comments, strings and quoted names.

    Comments, strings and names become a mark and their first character in one pass, and then a blank, '' and [x]. Patterns are only tried on texts that hold one of their WORDS.
    """
    mark = "\x01"  # a character of its own in no pattern, so one that is there already may become another such
    marked = F.regexp_replace(F.replace(F.col(text), F.lit(mark), F.lit("\x02")), r"""(-)-[^\n]*|(/)\*(?:[^*]|\*(?!/))*+(?:\*/)?|[Nn]?(')[^']*+(?:''[^']*+)*+'?|(\[)[^\]]*+\]|(")[^"]*+\"""", f"{mark}$1$2$3$4$5")
    for first, put in {"-": " ", "/": " ", "'": "''", "[": "[x]", '"': "[x]"}.items():
        marked = F.replace(marked, F.lit(mark + first), F.lit(put))
    code = rows.select(*keep, marked.alias("__code")).select("*", F.lower("__code").alias("__low"))
    lacks = lambda k: ~reduce(lambda x, y: x | y, [F.contains("__low", F.lit(w)) for w in WORDS[k].split()])
    return code.select(*keep, *[F.when(lacks(k), 0).otherwise(F.regexp_count("__code", F.lit(p))).cast("long").alias(k) for k, p in CONSTRUCTS.items()])


def plain_name(name):
    """Lower-case name without brackets, quotes and blanks around its dots."""
    marked = name.contains("[") | name.contains("]") | name.contains('"') | name.contains(".")  # few names have any
    return F.lower(F.when(marked, F.regexp_replace(F.regexp_replace(name, r"[\[\]\"]", ""), r"[ \t]*\.[ \t]*", ".")).otherwise(name))


def tokens(scripts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, line, raw, kind, word, name, batch, depth, error): the tokens that are neither comments nor line breaks.

    kind is word, quoted, string, number, go, top or mark; ``error`` says what is wrong with the token's batch, if anything; ``word`` is in upper case and null for quoted names, strings and numbers, ``name`` is
    the plain name of words and quoted names. depth counts open parentheses; a parenthesis has the depth of what is in it.
    batch counts the lines of GO before. A null text has no tokens.
    """
    cut = scripts.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(TOKEN), 0)).alias("pos", "raw"))
    before = Window.partitionBy(key).orderBy("pos")
    raw, alone = F.col("raw"), lambda c: c.isNull() | (c == "\n")
    newlines = F.length("raw") - F.length(F.replace("raw", F.lit("\n"), F.lit("")))
    go = raw.rlike(r"(?i)^[ \t]*go([ \t]+[0-9]+)?[ \t]*;?[ \t]*$") & alone(F.lag("raw").over(before)) & alone(F.lead("raw").over(before))
    kind = F.when(raw == "\n", "break").when(raw.startswith("--") | raw.startswith("/*"), "comment").when(raw.startswith("'") | raw.startswith("N'") | raw.startswith("n'"), "string").when(go, "go")
    kind = kind.when(raw.rlike(r"(?i)^top\s*\("), "top").when(raw.startswith("[") | raw.startswith('"'), "quoted").when(raw.rlike(r"^[@#]{0,2}[\p{L}_]"), "word").when(raw.rlike("^[0-9]"), "number").otherwise("mark")
    rows = cut.select("*", (1 + F.sum(newlines).over(before) - newlines).cast("int").alias("line"), kind.alias("kind")).where(~((raw == "\n") | raw.startswith("--") | raw.startswith("/*")))
    step = F.when(raw == "(", 1).when(raw == ")", -1).otherwise(0)
    rows = rows.select("*", F.count_if(F.col("kind") == "go").over(before).alias("batch"))
    inside = Window.partitionBy(key, "batch").orderBy("pos")
    depth = F.sum(step).over(inside) + F.when(raw == ")", 1).otherwise(0)
    word = F.when(F.col("kind").isin("word", "mark", "go"), F.upper("raw"))
    rows = rows.select("*", word.alias("word"), F.when(F.col("kind").isin("word", "quoted"), plain_name(raw)).alias("name"), depth.cast("int").alias("depth"))
    whole = Window.partitionBy(key, "batch")
    cut_off = F.max(F.when((F.col("kind") == "string") & ~raw.rlike(r"(?s)^[Nn]?'[^']*+(?:''[^']*+)*+'$"), "string without end").when(raw.isin("[", '"'), "quoted name without end")).over(whole)
    unequal = (F.sum(step).over(whole) != 0) | (F.min("depth").over(whole) < 0)
    return rows.withColumn("error", F.coalesce(cut_off, F.when(unequal, "parentheses do not match")))


def errors(scripts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, batch, line, message) of batches whose parentheses do not match or that end inside a string or quoted name (line: the batch's last), and of scripts that end inside a comment."""
    found = tokens(scripts, key, text).where("error IS NOT NULL").groupBy(key, "batch").agg(F.max("line").alias("line"), F.first("error").alias("message"))
    comments = scripts.select(key, F.explode(F.regexp_extract_all(text, F.lit(TOKEN), 0)).alias("raw")).where(F.col("raw").startswith("/*") & ~F.col("raw").rlike(r"(?s)^/\*.*\*/$"))
    return found.union(comments.select(key, F.lit(None).cast("long"), F.lit(None).cast("int"), F.lit("comment without end")))


def statements(scripts: DataFrame, key: str, text: str) -> DataFrame:
    """The tokens of sound batches with the words around them (p1, p2, p3 before, n1, n2 after), ``stmt``, ``clause`` and ``opens`` (the last and the
    first clause word before it in its parentheses), and ``cte`` for names of common table expressions.

    A statement begins at a semicolon, at GO, at a word of OPENERS, and at a verb that does not go on with what stands before it: the query of a
    common table expression, the source of an INSERT, the next part of a UNION, the body of a view or cursor.
    """
    return _claused(_parted(scripts, key, text), key).drop("seq", "p1_verb", "written", "said")


def _parted(scripts: DataFrame, key: str, text: str) -> DataFrame:
    """The tokens of ``statements`` but for clauses, with their number ``seq``, whether the one before is a verb, what the last verb of the statement is (``written``) and what it says if it is a clause word.

    Batches follow each other as places do, so windows over a script and over a batch need one sort by batch and place.
    """
    rows = tokens(scripts, key, text).where("kind <> 'top' AND error IS NULL")
    here = Window.partitionBy(key).orderBy("batch", "pos")
    before = here.rowsBetween(Window.unboundedPreceding, -1)
    word, flat = F.col("word"), F.col("depth") == 0
    rows = rows.select("*", *[F.lag("word", k).over(here).alias(f"p{k}") for k in (1, 2, 3)], *[F.lead("word", k).over(here).alias(f"n{k}") for k in (1, 2)], F.lead("name").over(here).alias("n1_name"), F.lag("kind").over(here).alias("p1_kind"))
    cte = flat & (word == "WITH") & F.col("n1_name").isNotNull() & ~F.coalesce(F.col("n1").isin(_OPTIONS), F.lit(False)) & F.col("n2").isin("AS", "(")
    verb = flat & word.isin(VERBS) & ~F.coalesce(F.col("p1").isin("THEN", "ON", "FOR", "AFTER", "OF", ",", "GRANT", "DENY", "REVOKE") & ((word != "SELECT") | ~F.col("p1").isin("FOR", "THEN", "ON")), F.lit(False)) & ~((word == "UPDATE") & F.coalesce(F.col("n1").isin("(", "STATISTICS"), F.lit(False)))
    parted = (F.col("kind") == "go") | (flat & (word == ";"))
    rows = rows.select("*", F.coalesce(cte, F.lit(False)).alias("opens_cte"), F.coalesce(verb, F.lit(False)).alias("verb"), F.coalesce(parted, F.lit(False)).alias("parted"))
    last = lambda what: F.coalesce(F.max(F.when(what, F.col("pos"))).over(before), F.lit(-1))
    fed = F.col("parted") | (flat & word.isin("SELECT", "VALUES", "EXEC", "EXECUTE", "DEFAULT"))
    rows = rows.select("*", (last(F.col("opens_cte")) > last(F.col("verb") | F.col("parted"))).alias("in_cte"), (last(F.col("verb") & (word == "INSERT")) > last(fed)).alias("in_insert"))
    goes_on = F.col("in_cte") | ((word == "SELECT") & (F.col("in_insert") | F.coalesce(F.col("p1").isin("UNION", "ALL", "EXCEPT", "INTERSECT", "AS", "FOR"), F.lit(False))))
    opener = flat & F.coalesce(word.isin(OPENERS), F.lit(False)) & ~F.coalesce(F.col("p1").isin("WITH", "OR", "GRANT", "DENY", "REVOKE", ","), F.lit(False))
    begins = F.col("parted") | opener | F.col("opens_cte") | (F.col("verb") & ~goes_on)
    rows = rows.select("*", F.count_if(begins).over(here).alias("stmt"))
    named = flat & F.col("name").isNotNull() & (F.lag("opens_cte").over(here) | (F.col("in_cte") & (F.col("p1") == ",") & (F.col("p2") == ")") & F.col("n1").isin("AS", "(")))
    verbs = F.when(word == "OUTPUT", "OUTPUT").when(word.isin("SELECT", "INSERT", "MERGE", "UPDATE", "DELETE"), word)
    last_verb = F.last(F.when(verbs.isNotNull(), F.struct("stmt", verbs.alias("verb"))), ignorenulls=True).over(here)
    rows = rows.select("*", F.coalesce(named, F.lit(False)).alias("cte"), F.row_number().over(here).alias("seq"), F.lag("verb").over(here).alias("p1_verb"), last_verb.alias("written"), F.when(word.isin(CLAUSES), word).alias("said"))
    return rows.withColumn("written", F.when(F.col("written.stmt") == F.col("stmt"), F.col("written.verb")))


def _claused(rows: DataFrame, key: str) -> DataFrame:
    """The tokens with ``block``, ``clause`` and ``opens``; tokens that are neither asked for, clause words nor opening parentheses may be missing.

    At one depth, statements and blocks follow each other as places do, so what was said last is looked up in one order and counts if it was said in the same ones.
    """
    level = Window.partitionBy(key, "depth").orderBy("pos")
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    block = F.coalesce(F.max(F.when(F.col("raw") == "(", F.col("pos"))).over(level), F.lit(-1))
    rows = rows.select("*", F.when(F.col("depth") > 0, block).otherwise(-1).alias("block"))
    said = F.when(F.col("said").isNotNull(), F.struct("stmt", "block", "said"))
    here = lambda c: (F.col(c)["stmt"] == F.col("stmt")) & (F.col(c)["block"] == F.col("block"))
    rows = rows.select("*", F.last(said, ignorenulls=True).over(before).alias("clause"))
    rows = rows.withColumn("clause", F.when(here("clause"), F.col("clause")["said"]))
    rows = rows.select("*", F.last(F.when(F.col("clause").isNull(), said), ignorenulls=True).over(before).alias("opens"))
    return rows.withColumn("opens", F.when(here("opens"), F.col("opens")["said"]))


def facts(scripts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, stmt, line, owner, object, op, kind) of what scripts read, write, call, create, alter and drop.

    op is read, insert, update, delete, merge, truncate, select-into, call, temp, create, alter or drop; kind is the kind of object for the last three.
    Targets that are aliases become the tables they stand for; reads of common table expressions, aliases and the pseudo tables
    ``inserted`` and ``deleted`` are none. ``owner`` is the routine, view or trigger created before in the same batch.
    """
    p1, p2, p3, n1, n2, word = (F.col(c) for c in ("p1", "p2", "p3", "n1", "n2", "word"))
    is_name = F.col("name").isNotNull() & ~F.col("name").startswith("@") & ~F.coalesce(word.isin(RESERVED), F.lit(False))
    rows = _parted(scripts, key, text)
    rows = _claused(rows.where(is_name | F.col("cte") | F.col("said").isNotNull() | (F.col("raw") == "(")), key).where(is_name | F.col("cte"))  # names are what facts are about
    here = Window.partitionBy(key).orderBy("batch", "pos")
    call_of = (n1 == "(") & ~F.coalesce(n2.isin(_HINTS), F.lit(False))
    kinds = reduce(lambda c, kv: c.when(F.lit(kv[0]) == p1, kv[1]), list(KINDS.items())[1:], F.when(p1 == "TABLE", "table"))
    dropped = reduce(lambda c, kv: c.when(F.lit(kv[0]) == p3, kv[1]), list(KINDS.items())[1:], F.when(p3 == "TABLE", "table"))
    made = p2.isin("CREATE", "ALTER", "DROP") | (kinds.eqNullSafe("index") & p2.isin("UNIQUE", "CLUSTERED", "NONCLUSTERED"))
    target = (
        F.when((p1 == "INTO") & (p2 == "INSERT") | (p1 == "INSERT"), "insert")
        .when((p1 == "UPDATE") & F.col("p1_verb") | ((p1 == "UPDATE") & (F.col("clause") == "UPDATE")), "update")
        .when((p1 == "DELETE") & F.col("p1_verb") | ((p1 == "FROM") & (p2 == "DELETE")), "delete")
        .when((p1 == "MERGE") | ((p1 == "INTO") & (p2 == "MERGE")), "merge")
        .when((p1 == "TABLE") & (p2 == "TRUNCATE"), "truncate")
        .when((p1 == "INTO") & (F.col("clause") == "INTO"), "into")
    )
    function = (F.col("depth") > 0) & (F.col("opens") == "FROM")  # a function's argument: trim(x from y)
    read = (p1.isin("FROM", "JOIN", "USING") & ~F.coalesce(function, F.lit(False)) | ((p1 == "(") & p2.isin("FROM", "JOIN")) | ((p1 == ",") & F.col("clause").isin("FROM", "USING"))) & ~F.coalesce(p2.isin("NEXT", "PRIOR", "FIRST", "LAST", "DISTINCT"), F.lit(False)) & ~F.coalesce(call_of, F.lit(False))
    call = p1.isin("EXEC", "EXECUTE") & ~F.coalesce(p2.isin("WITH", "GRANT", "DENY", "REVOKE", ","), F.lit(False)) | ((p1 == "=") & p3.isin("EXEC", "EXECUTE") & p2.startswith("@"))
    op = F.when(is_name & made & kinds.isNotNull(), F.when(p2 == "DROP", "drop").when((p2 == "ALTER") & ~p3.eqNullSafe("OR"), "alter").otherwise("create"))
    op = op.when(is_name & (p1 == "EXISTS") & (p2 == "IF") & dropped.isNotNull(), "drop").when(is_name & target.isNotNull(), target).when(is_name & read, "read").when(is_name & call, "call")
    rows = rows.select("*", op.alias("op"), F.coalesce(F.when(made, kinds), F.when((p1 == "EXISTS") & (p2 == "IF"), dropped)).alias("made"), is_name.alias("is_name"))
    rows = rows.withColumn("op", F.when(F.col("op") == "into", F.when(F.col("written") == "OUTPUT", "insert").otherwise("select-into")).otherwise(F.col("op")))
    rows = rows.select("*", *[F.lag(F.struct("seq", "op", "name"), k).over(here).alias(f"near{k}") for k in (1, 2)])
    at = lambda k: reduce(lambda x, y: x.when(F.col(y)["seq"] == F.col("seq") - k, F.col(y)), ["near2"], F.when(F.col("near1")["seq"] == F.col("seq") - k, F.col("near1")))
    table = lambda k: at(k)["op"].isin("read", "insert", "update", "delete", "merge")
    stands_for = F.when(table(1), at(1)["name"]).when((p1 == "AS") & table(2), at(2)["name"])
    alias = F.col("is_name") & F.col("op").isNull() & (stands_for.isNotNull() | ((p1 == ")") | ((p1 == "AS") & (p2 == ")"))) & F.col("clause").isin("FROM", "USING"))
    routine = F.when(F.col("op").isin("create", "alter") & F.col("made").isin("procedure", "function", "view", "trigger"), F.col("name"))
    rows = rows.select("*", F.when(alias, F.struct(F.col("name").alias("alias"), stands_for.alias("table"))).alias("alias"), F.last(routine, ignorenulls=True).over(Window.partitionBy(key, "batch").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)).alias("owner"))
    each = F.struct("pos", "line", "owner", "name", "op", F.when(F.col("op").isin("create", "alter", "drop"), F.col("made")).alias("kind"))
    grouped = rows.where(F.col("op").isNotNull() | F.col("cte") | F.col("alias").isNotNull()).groupBy(key, "stmt").agg(F.collect_list(F.when(F.col("op").isNotNull(), each)).alias("facts"), F.collect_list("alias").alias("aliases"), F.collect_set(F.when(F.col("cte"), F.col("name"))).alias("ctes"))
    f = grouped.select(key, "stmt", "aliases", "ctes", F.explode("facts").alias("f")).select(key, "stmt", "aliases", "ctes", "f.*")
    short = ~F.col("name").contains(".")
    known = F.filter("aliases", lambda a: a["alias"] == F.col("name"))
    is_alias = short & (F.size(known) > 0) & ~F.exists(known, lambda a: a["table"].eqNullSafe(F.col("name")))
    is_cte = short & F.array_contains("ctes", F.col("name"))
    own = F.col("op").isin("read", "insert", "update", "delete", "merge")
    real = F.when(own & is_alias, F.get(F.filter(known, lambda a: a["table"].isNotNull()), F.lit(0))["table"]).otherwise(F.col("name"))
    gone = ((F.col("op") == "read") & (is_alias | is_cte | F.col("name").isin("inserted", "deleted"))) | (own & is_cte)
    f = f.where(~gone).withColumn("name", real).where(F.col("name").isNotNull())
    temp = F.col("name").startswith("#")
    return f.select(key, "stmt", "line", "owner", F.col("name").alias("object"), F.when(temp & ~F.col("op").isin("call", "drop"), "temp").otherwise(F.col("op")).alias("op"), F.when(~temp, F.col("kind")).alias("kind"))


def lineage(rows: DataFrame, text: str, key: str) -> DataFrame:
    """(key, object, op) of the objects that scripts read, write, create, alter, drop or call."""
    return facts(rows, key, text).select(key, "object", "op").distinct()


def kind_of(text):
    """statement, fragment or none."""
    return F.when(text.rlike(r"(?i)^\s*(select\s.+\sfrom\s|insert\s+into\s|update\s+(\[[^\]]*\]|\S+)\s+set\s|delete\s+from\s|exec(ute)?\s|create\s|alter\s|merge\s+into\s)"), "statement").when(text.rlike(r"(?i)^\s*(where|and|order\s+by|group\s+by|inner\s+join|left\s+join|from)\s"), "fragment").otherwise("none")
