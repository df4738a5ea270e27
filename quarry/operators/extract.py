"""Extractors: catalogues of patterns over source lines, each giving a table of facts.

A catalogue is a literal of the plan, so a scan tests all of its patterns in one pass and explodes only lines of files that
can match.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import scalars as S
from quarry.operators.rules import line_explode


@dataclass(frozen=True)
class Pattern:
    """``value`` and ``extra`` are groups of the pattern (0: none); ``ext`` are the file extensions that it is for (none: all)."""

    kind: str
    pattern: str
    value: int = 1
    extra: int = 0
    ext: tuple[str, ...] = ()


API = [
    Pattern("attribute", r"\[Http(Get|Post|Put|Delete|Patch)(?:\(\"([^\"]*)\"\))?\]", 2, 1, ("cs",)),
    Pattern("minimal", r"\.Map(Get|Post|Put|Delete|Patch)\(\s*\"([^\"]+)\"", 2, 1, ("cs",)),
    Pattern("express", r"\b(?:app|router)\.(get|post|put|delete|patch)\(\s*['\"`]([^'\"`]+)", 2, 1, ("js", "ts")),
    Pattern("decorator", r"@\w+\.(get|post|put|delete|patch|route)\(\s*['\"]([^'\"]+)", 2, 1, ("py",)),
    Pattern("spring", r"@(Get|Post|Put|Delete|Patch|Request)Mapping\(\s*(?:value\s*=\s*|path\s*=\s*)?\"([^\"]+)", 2, 1, ("java", "kt")),
    Pattern("go", r"\.(?:HandleFunc|Handle)\(\s*\"([^\"]+)\"", 1, 0, ("go",)),
]
JOBS = [
    Pattern("recurring", r"RecurringJob\.AddOrUpdate[^;]*?\"([^\"]+)\"[^;]*?(\"[^\"]*\"|Cron\.\w+)", 1, 2, ("cs",)),
    Pattern("cron", r"^\s*((?:[0-9*/,-]+\s+){4}[0-9*/,-]+)\s+(\S.*)$", 2, 1, ("cron", "crontab")),
    Pattern("scheduled", r"@Scheduled\((?:cron|fixedRate|fixedDelay)\s*=\s*\"?([^\")]+)", 1, 0, ("java", "kt")),
    Pattern("timer", r"\[TimerTrigger\(\"([^\"]+)\"", 1, 0, ("cs",)),
    Pattern("hosted", r"class\s+(\w+)\s*:\s*(?:BackgroundService|IHostedService)", 1, 0, ("cs",)),
    Pattern("workflow", r"^\s*-\s*cron:\s*['\"]([^'\"]+)", 1, 0, ("yml", "yaml")),
]
ERRORS = [
    Pattern("throw", r"throw\s+new\s+(\w+)\s*\(\s*\$?\"([^\"]*)", 2, 1, ("cs", "java", "js", "ts")),
    Pattern("raise", r"raise\s+(\w+)\s*\(\s*f?['\"]([^'\"]*)", 2, 1, ("py",)),
    Pattern("log", r"\.(?:Log)?(Error|Critical|Fatal)\w*\(\s*\$?\"([^\"]*)", 2, 1, ("cs", "java")),
]
CONFIG_READS = [
    Pattern("indexer", r"[Cc]onfig(?:uration)?\[\"([^\"]+)\"\]", 1, 0, ("cs",)),
    Pattern("settings", r"AppSettings(?:\[|\.Get\()\"([^\"]+)\"", 1, 0, ("cs", "vb")),
    Pattern("environment", r"(?:GetEnvironmentVariable\(|os\.environ(?:\.get)?[\[(]|process\.env\[|getenv\()\s*['\"]([^'\"]+)", 1, 0),
    Pattern("environment", r"process\.env\.([A-Za-z_][A-Za-z0-9_]*)", 1, 0, ("js", "ts")),
]
REGISTRATIONS = [
    Pattern("service", r"\.Add(Singleton|Scoped|Transient)<\s*([\w.]+)\s*[,>]", 2, 1, ("cs",)),
    Pattern("implementation", r"\.Add(?:Singleton|Scoped|Transient)<\s*([\w.]+)\s*,\s*([\w.]+)\s*>", 1, 2, ("cs",)),
]
UI_TRIGGERS = [
    Pattern("fetch", r"\bfetch\(\s*['\"`]([^'\"`]+)", 1, 0, ("js", "ts", "html", "cshtml")),
    Pattern("ajax", r"\$\.(get|post|ajax)\(\s*(?:\{\s*url:\s*)?['\"]([^'\"]+)", 2, 1, ("js", "ts", "html", "cshtml")),
    Pattern("form", r"<form[^>]*\saction=\"([^\"]+)\"", 1, 0, ("html", "cshtml")),
    Pattern("handler", r"\bon(click|change|submit)=\"([^\"(]+)", 2, 1, ("html", "cshtml")),
]
BUILD_FACTS = [
    Pattern("base_image", r"^FROM\s+(\S+)", 1, 0, ("dockerfile",)),
    Pattern("port", r"^EXPOSE\s+([0-9]+)", 1, 0, ("dockerfile",)),
    Pattern("pipeline_image", r"^\s*(?:image|runs-on|vmImage):\s*['\"]?([^'\"\s]+)", 1, 0, ("yml", "yaml")),
    Pattern("sdk", r"\"version\"\s*:\s*\"([0-9.]+)\"", 1, 0, ("json",)),
]
DATA_ACCESS = [
    Pattern("stored_procedure", r"CommandType\.StoredProcedure|\bEXEC(?:UTE)?\s+([\w.\[\]]+)", 1),
    Pattern("micro_orm", r"\.(Query|Execute|QueryAsync|ExecuteAsync)(?:<[^>]*>)?\(\s*@?\"", 0, 1),
    Pattern("orm", r"\b(?:_?[Cc]ontext|db)\.(\w+)\.(?:Where|Find|Add|Remove|FirstOrDefault)\(", 1),
    Pattern("raw_command", r"new\s+(?:Sql|Npgsql|Oracle|OleDb)Command\(", 0),
]


def extract(files: DataFrame, catalogue: list[Pattern], path: str, text: str) -> DataFrame:
    """(path, line, kind, value, extra) of every match."""
    name = F.lower(F.substring_index(path, "/", -1))
    ext = F.when(name.startswith("dockerfile"), "dockerfile").otherwise(F.substring_index(name, ".", -1))
    fits = lambda p: F.col("__ext").isin(*p.ext) if p.ext else F.lit(True)
    any_ = None
    for p in catalogue:
        one = fits(p) & F.col(text).rlike("(?m)" + p.pattern)
        any_ = one if any_ is None else any_ | one
    lines = line_explode(files.select(path, text, ext.alias("__ext")).where(any_), text).drop(text)
    every = lambda p, k: F.regexp_extract_all("line", F.lit(p.pattern), F.lit(k))
    none = F.array().cast("array<struct<kind: string, value: string, extra: string>>")

    def hits(p: Pattern) -> Column:
        at = F.arrays_zip(every(p, 0).alias("m"), every(p, p.value).alias("v"), every(p, p.extra).alias("x"))
        made = F.transform(at, lambda z: F.struct(F.lit(p.kind).alias("kind"), (z["v"] if p.value else F.lit("")).alias("value"), (z["x"] if p.extra else F.lit("")).alias("extra")))
        return F.when(fits(p) & F.col("line").rlike(p.pattern), made).otherwise(none)

    return lines.withColumn("hit", F.explode(F.flatten(F.array(*map(hits, catalogue))))).select(path, F.col("line_no").alias("line"), "hit.*")


def endpoints(files: DataFrame, path: str, text: str) -> DataFrame:
    """(path, line, host, port, scheme, kind, url) of URLs in texts; schema and placeholder hosts are left out."""
    lines = line_explode(files.select(path, text).where(F.col(text).contains("://")), text).where(F.col("line").contains("://"))
    urls = lines.select(path, F.col("line_no").alias("line"), F.explode(F.regexp_extract_all("line", F.lit(r"\b([a-z][a-z0-9+.-]*://[^\s\"'<>)\]},;]+)"), 1)).alias("url"))
    host = S.url_host(F.col("url"))
    rows = urls.select(path, "line", host.alias("host"), S.url_port(F.col("url")).alias("port"), S.url_scheme(F.col("url")).alias("scheme"), S.host_kind(host).alias("kind"), "url")
    noise = F.col("host").rlike(r"^$|^(www\.)?w3\.org$|schemas?\.|^(your|my)?-?(host|server|domain|site)|[{}$%*]") | (F.col("host").rlike(r"^[0-9.]+$") & ~F.col("host").rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"))
    return rows.where(~noise)


def role(scheme: Column, name: Column) -> Column:
    """What an address is for, by the first hint in its scheme and the setting's name."""
    hint = F.lower(F.concat_ws(" ", scheme, name))
    out = F.lit("network service")
    for pattern, found in reversed([("soap|wsdl|svc|asmx", "SOAP service"), ("smtp|mail", "mail"), ("ldap|directory", "directory"), ("redis|cache", "cache"), ("amqp|queue|rabbit|kafka|bus", "messaging"), ("ftp|file|share", "files"), ("sql|db|database|jdbc|mongodb", "database"), ("auth|identity|login|oauth|sso", "identity"), ("^https?", "web service")]):
        out = F.when(hint.rlike(pattern), found).otherwise(out)
    return out


def project_type(rows: DataFrame) -> DataFrame:
    """With ``type``: the first that fits of a project's (name, output, packages, files)."""
    has = lambda p: F.exists("packages", lambda x: F.lower(x).rlike(p))
    file = lambda p: F.exists("files", lambda x: F.lower(x).rlike(p))
    cases = [(has("xunit|nunit|mstest"), "test"), (file(r"\.svc$"), "WCF service"), (file(r"\.aspx$"), "Web Forms"), (file(r"\.asmx$"), "SOAP service"), (has("aspnetcore") | file(r"\.cshtml$|program\.cs$") & has("swashbuckle|mvc"), "web application"), (has("topshelf|windowsservices"), "Windows service"), (file(r"\.xaml$") | has("wpf"), "desktop"), (F.lower("output").isin("exe", "winexe"), "console"), (file(r"\.sqlproj$|\.sql$"), "database")]
    out = F.lit("library")
    for condition, name in reversed(cases):
        out = F.when(F.coalesce(condition, F.lit(False)), name).otherwise(out)
    return rows.withColumn("type", out)


def build_failure(text: Column) -> Column:
    """A plain reason for a build's error text."""
    out = F.lit("see the log")
    for pattern, why in reversed([(r"NU1[0-9]{3}|unable to (find|resolve) package", "a package cannot be restored"), (r"MSB3644|reference assemblies .* were not found", "the targeting pack is missing"), (r"MSB4019|imported project .* was not found", "a build tool's targets are missing"), (r"NETSDK1045|does not support targeting", "the SDK is too old"), (r"CS0246|CS0234|could not be found", "a reference is missing"), (r"CS[0-9]{4}|error TS[0-9]+", "the sources have compile errors"), (r"(?i)timed? ?out", "it took too long"), (r"(?i)out of memory", "memory ran out")]):
        out = F.when(text.rlike(pattern), why).otherwise(out)
    return out


def linked_issues(rows: DataFrame, key: str, text: str, most: int | None = None) -> DataFrame:
    """(key, issue) of issue references, with ``most`` the first so many of each row; well-known codes of that shape are none."""
    found = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(r"(?:^|[\s(\[])(#[0-9]+|[A-Z][A-Z0-9]+-[0-9]+)\b"), 1))
    real = F.filter(found, lambda x: ~x.rlike(r"^(UTF|ISO|SHA|RFC|CVE|TLS|HTTP)-"))
    return rows.select(key, F.explode(real if most is None else F.slice(real, 1, most)).alias("issue"))


def insert_rows(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, table, values) of INSERT ... VALUES rows; doubled quotes are one."""
    statements = rows.select(key, F.explode(F.regexp_extract_all(F.col(text), F.lit(r"(?is)insert\s+into\s+([^;]+?\bvalues\b(?:[^';]|'(?:[^']|'')*')*)"), 1)).alias("s"))
    table = F.lower(F.regexp_replace(F.regexp_extract("s", r"^\s*([\w.\[\]\"]+)", 1), r"[\[\]\"]", ""))
    tuples = F.regexp_extract_all(F.regexp_replace("s", r"(?is)^.*?\bvalues\b", ""), F.lit(r"\(((?:[^()']|'(?:[^']|'')*')*)\)"), 1)
    split = lambda t: F.transform(F.regexp_extract_all(t, F.lit(r"(?:^|,)\s*(N?'(?:[^']|'')*'|[^,']+)"), 1), lambda v: F.regexp_replace(F.regexp_replace(F.trim(v), r"^N?'|'$", ""), "''", "'"))
    return statements.select(key, table.alias("table"), F.explode(tuples).alias("t")).select(key, "table", split(F.col("t")).alias("values"))
