"""Sources and sinks: file trees, text with unknown encodings, settings files, manifests, diffs and tables."""

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folders that a walk leaves out.
SKIP = ("bin", "obj", "node_modules", "target", "dist", "build", "__pycache__", "vendor")


def walk(spark: SparkSession, root: str, skip: tuple[str, ...] = SKIP, glob: str | None = None, max_bytes: int = 2_000_000) -> DataFrame:
    """(path, size, content, rejected): files below root without skipped and hidden folders (.github stays).

    Content is read only for files within the size cap; others are rows with ``rejected``. Spark's file sources pass over
    hidden folders, so .github is named to them. A folder ``packages`` is left out if it holds a .nupkg file. Paths are those below the root, whatever its name.
    """
    jvm = spark.sparkContext._jvm
    ci = jvm.org.apache.hadoop.fs.Path(root.rstrip("/") + "/.github")
    roots = [root] + [root.rstrip("/") + "/.github"] * ci.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(ci)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    whole = ci.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(jvm.org.apache.hadoop.fs.Path(root)).toString().rstrip("/")
    rel = F.substring("path", len(whole) + 2, 1 << 30)
    parts = F.split(rel, "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    pruned = F.exists(folders, lambda x: x.isin(*skip) | (x.startswith(".") & (x != ".github")))
    rows = reader.load(roots).where(~pruned)
    store = lambda c: F.regexp_extract(c, r"^((?:.*?/)?packages)/", 1)
    packed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.nupkg").load(root).select(store(rel).alias("__store")).where("__store <> ''").distinct()
    rows = rows.withColumn("__store", store(rel)).join(packed, "__store", "left_anti").drop("__store")
    fits, size = F.col("length") <= max_bytes, F.col("length").alias("size")
    small = rows.where(fits).select(rel.alias("path"), size, "content", F.lit(False).alias("rejected"))  # the scan gets the condition
    return small.union(rows.where(~fits).select(rel, size, F.lit(None).cast("binary"), F.lit(True)))


def sniff_text(content: Column) -> Column:
    """Text by its byte-order mark or zero bytes: UTF-16 either way round, else UTF-8."""
    head = F.hex(F.substring(content, 1, 4))
    body = lambda k: F.substring(content, k, 1 << 30)
    utf8 = F.decode(content, "UTF-8")
    return F.when(head.startswith("FFFE"), F.decode(body(3), "UTF-16LE")).when(head.startswith("FEFF"), F.decode(body(3), "UTF-16BE")).when(head.startswith("EFBBBF"), F.decode(body(4), "UTF-8")).when(head.rlike("^[0-9A-F]{2}00[0-9A-F]{2}00"), F.decode(content, "UTF-16LE")).otherwise(utf8)


def file_type(path: Column) -> Column:
    """Type of a file by its name, else by its extension."""
    name, ext = F.lower(F.substring_index(path, "/", -1)), F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(name.startswith("dockerfile"), "docker").when(name.rlike(r"^appsettings.*\.json$|^web.*\.config$|^app.*\.config$"), "config").when(path.contains(".github/workflows/") | name.isin("jenkinsfile", ".gitlab-ci.yml", "azure-pipelines.yml"), "ci").when(ext.isin("cs", "vb", "java", "py", "js", "ts", "go", "rs"), "code").when(ext.isin("csproj", "vbproj", "sln", "slnx"), "project").when(ext.isin("sql", "ddl"), "sql").when(ext.isin("json", "xml", "yml", "yaml", "ini", "config", "env", "properties"), "config").when(ext.isin("md", "txt", "rst"), "doc").otherwise("other")


def json_leaves(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, path, value) of the leaves of JSON texts; names are joined by ``:`` and places in lists are numbers.

    Lines that are // comments are left out; what is not JSON has no leaves.
    """
    schema = T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("value", T.StringType())]))

    def leaves(value, path):
        if isinstance(value, dict):
            for k, v in value.items():
                yield from leaves(v, [*path, k])
        elif isinstance(value, list):
            for k, v in enumerate(value):
                yield from leaves(v, [*path, str(k)])
        else:
            yield ":".join(path), value if value is None or isinstance(value, str) else json.dumps(value)

    def parse(x):
        try:
            return list(leaves(json.loads(re.sub(r"(?m)^[ \t]*//.*$", "", x or "null")), []))
        except ValueError:
            return []

    @F.pandas_udf(schema)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: [{"path": p, "value": v} for p, v in parse(x)])

    return rows.select(key, F.explode(run(text)).alias("leaf")).select(key, "leaf.path", "leaf.value").where("path <> ''")


def key_values(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, name, value) of ``name=value`` and ``name: value`` lines; # and ; lines are comments."""
    from quarry.operators.rules import line_explode

    lines = line_explode(rows.select(key, text), text).where(~F.col("line").rlike(r"^[ \t]*[#;]"))
    name = F.regexp_extract("line", r"^[ \t]*(?:export[ ]+|ENV[ ]+)?([A-Za-z_][A-Za-z0-9_.:-]*?)[ \t]*[=:][ \t]*(.*)$", 1)
    value = F.regexp_replace(F.regexp_extract("line", r"^[ \t]*(?:export[ ]+|ENV[ ]+)?([A-Za-z_][A-Za-z0-9_.:-]*?)[ \t]*[=:][ \t]*(.*)$", 2), r"^[\"']|[\"' \t]+$", "")
    return lines.select(key, "line_no", name.alias("name"), value.alias("value")).where("name <> ''")


def xml_settings(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, name, value) of ``<add key= value=>`` and ``<add name= connectionString=>`` elements."""
    attr = lambda n: F.regexp_extract("tag", rf'(?i)\b{n}="([^"]*)"', 1)
    tags = rows.select(key, F.explode(F.regexp_extract_all(F.col(text), F.lit(r"(?is)<add\s[^>]*>"), 0)).alias("tag"))
    first = lambda a, b: F.when(attr(a) != "", attr(a)).otherwise(attr(b))
    return tags.select(key, first("key", "name").alias("name"), first("value", "connectionString").alias("value")).where("name <> ''")


def xml_project(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, frameworks, packages, references, error) of project files, whatever their namespace."""
    every = lambda p: F.regexp_extract_all(F.col(text), F.lit(p), 1)
    tfm = F.flatten(F.transform(F.concat(every(r"<TargetFrameworks?>([^<]*)<"), every(r"<TargetFrameworkVersion>([^<]*)<")), lambda x: F.split(x, ";")))
    return rows.select(key, F.filter(F.transform(tfm, lambda x: F.trim(x)), lambda x: x != "").alias("frameworks"), every(r'<PackageReference[^>]*\sInclude="([^"]*)"').alias("packages"), every(r'<ProjectReference[^>]*\sInclude="([^"]*)"').alias("references"), (~F.col(text).rlike(r"(?s)<Project[\s>].*</Project>")).alias("error"))


def solution_projects(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, project) of the projects that solution files list."""
    old, new = F.regexp_extract_all(F.col(text), F.lit(r'Project\("[^"]*"\)\s*=\s*"[^"]*",\s*"([^"]*proj)"'), 1), F.regexp_extract_all(F.col(text), F.lit(r'<Project\s[^>]*Path="([^"]*)"'), 1)
    return rows.select(key, F.explode(F.concat(old, new)).alias("project")).withColumn("project", F.replace("project", F.lit("\\"), F.lit("/")))


def packages(rows: DataFrame, path: str, text: str) -> DataFrame:
    """(path, ecosystem, name, version) of package manifests, by the file's name."""
    name = F.lower(F.substring_index(path, "/", -1))
    forms = [
        ("npm", name == "package.json", r'"(@?[a-z0-9][a-z0-9@/._-]*)"\s*:\s*"([\^~]?[0-9][^"]*)"'),
        ("pip", name.rlike(r"^requirements.*\.txt$"), r"(?m)^([A-Za-z0-9_.-]+)\s*==\s*([0-9][^\s;#]*)"),
        ("nuget", name.rlike(r"proj$|^packages\.config$|^directory\.packages\.props$"), r'(?:Include|id)="([^"]+)"\s+[Vv]ersion="([^"]+)"'),
        ("maven", name == "pom.xml", r"(?s)<artifactId>([^<]+)</artifactId>\s*<version>([^<]+)</version>"),
        ("gradle", name.startswith("build.gradle"), r"['\"][^'\":]+:([^'\":]+):([^'\"]+)['\"]"),
        ("go", name == "go.mod", r"(?m)^\s*(?:require\s+)?([a-z0-9.-]+\.[a-z]+/[^\s]+)\s+(v[0-9][^\s]*)"),
        ("cargo", name == "cargo.toml", r'(?m)^([a-z0-9_-]+)\s*=\s*(?:\{[^}]*version\s*=\s*)?"([0-9^~][^"]*)"'),
    ]
    out = None
    for eco, when, pattern in forms:
        both = F.arrays_zip(F.regexp_extract_all(F.col(text), F.lit(pattern), 1).alias("name"), F.regexp_extract_all(F.col(text), F.lit(pattern), 2).alias("version"))
        one = rows.where(when).select(path, F.lit(eco).alias("ecosystem"), F.explode(both).alias("p")).select(path, "ecosystem", "p.name", "p.version")
        out = one if out is None else out.union(one)
    return out


def git_activity(log: DataFrame, days: int) -> DataFrame:
    """(commits, authors, per_week, last) of a table (sha, author, at)."""
    return log.agg(F.countDistinct("sha").alias("commits"), F.countDistinct("author").alias("authors"), F.bround(F.countDistinct("sha") / F.lit(max(days / 7, 1)), 2).alias("per_week"), F.max("at").alias("last"))


def diff_lines(diffs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, file, line) of the new side's lines that a unified diff shows: added and context lines."""
    from quarry.operators.rules import line_explode

    lines = line_explode(diffs.select(key, text), text)
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    file = F.when(F.col("line").startswith("+++ "), F.regexp_replace("line", r"^\+\+\+ (b/)?", ""))
    start = F.regexp_extract("line", r"^@@ -[0-9,]+ \+([0-9]+)", 1)
    lines = lines.withColumn("file", F.last(file, True).over(w)).withColumn("hunk", F.count_if(start != "").over(w)).withColumn("from", F.last(F.when(start != "", start.cast("int")), True).over(w))
    shown = F.col("line").rlike(r"^[+ ]") & ~F.col("line").startswith("+++ ")
    inside = Window.partitionBy(key, "hunk").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.where("hunk > 0 and not line like '--- %' and not line like 'diff %' and not line like 'index %'")
    return lines.withColumn("line_at", F.col("from") + F.count_if(shown).over(inside) - 1).where(shown).select(key, "file", F.col("line_at").alias("line"))


def header_alias(df: DataFrame, names: dict[str, list[str]]) -> DataFrame:
    """Columns by the first of their synonyms that is there, whatever its case; absent ones are null."""
    norm = lambda x: "".join(c for c in x.lower() if c.isalnum())
    have = {norm(c): c for c in reversed(df.columns)}
    pick = lambda want: next((have[norm(s)] for s in want if norm(s) in have), None)
    return df.select(*[(F.col(f"`{c}`") if (c := pick([name, *synonyms])) else F.lit(None).cast("string")).alias(name) for name, synonyms in names.items()])


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    df = (reader.schema(schema) if schema else reader).csv(path)
    return df.withColumnRenamed(df.columns[0], df.columns[0].lstrip("\ufeff")) if df.columns else df


def write_csv(df: DataFrame, path: str) -> None:
    """Values keep their outer blanks and line ends."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def read_json(spark: SparkSession, path: str, schema: str, lines: bool = True) -> DataFrame:
    """Blank lines are skipped; a document over several lines needs ``lines=False``."""
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A table for people: the first ``most`` rows, and a line that says so if there are more."""
    rows = df.limit(most + 1).collect()
    cell = lambda x: "" if x is None else str(x).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(cell, r)) + " |" for r in rows[:most]] + [f"(the first {most} rows)"] * (len(rows) > most))


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Without columns that are null or blank in every row."""
    full = df.agg(*[F.max(F.coalesce(F.trim(F.col(f"`{c}`").cast("string")) != "", F.lit(False))).alias(c) for c in df.columns]).first()
    return df.select(*[F.col(f"`{c}`") for c in df.columns if full[c]])
