import pytest
from pyspark.sql import functions as F

from quarry.sources import files, xlsx


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "estate"
    contents = {
        "src/App/Main.cs": b"class A {}",
        "src/App/bin/x.dll": b"no",
        ".git/config": b"no",
        ".github/workflows/ci.yml": b"on: push",
        "utf16.txt": "\ufeffgr\u00fc\u00df".encode("utf-16-le"),
        "bom.txt": b"\xef\xbb\xbfhi",
        "bare16.txt": "abc".encode("utf-16-le"),
        "big.sql": b"x" * 100,
    }
    for name, data in contents.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    return str(root)


def test_walk_prunes_caps_and_sniffs(spark, tree):
    rows = {r["path"]: r for r in files.walk(spark, tree, max_bytes=50).withColumn("text", files.sniff_text(F.col("content"))).withColumn("kind", files.file_type(F.col("path"))).collect()}
    assert set(rows) == {"src/App/Main.cs", ".github/workflows/ci.yml", "utf16.txt", "bom.txt", "bare16.txt", "big.sql"}
    assert rows["big.sql"]["rejected"] and rows["big.sql"]["text"] is None
    assert [rows[n]["text"] for n in ("utf16.txt", "bom.txt", "bare16.txt")] == ["grüß", "hi", "abc"]
    assert [rows[n]["kind"] for n in ("src/App/Main.cs", ".github/workflows/ci.yml", "big.sql")] == ["code", "ci", "sql"]


def one(spark, text):
    return spark.createDataFrame([(1, text)], "id int, text string")


def test_json_leaves(spark):
    got = files.json_leaves(one(spark, '// top\n{"a": {"b": [1, "x", null]},\n // c\n "d": true}'), "id", "text")
    assert sorted((r["path"], r["value"]) for r in got.collect()) == [("a:b:0", "1"), ("a:b:1", "x"), ("a:b:2", None), ("d", "true")]
    assert files.json_leaves(one(spark, "{oops"), "id", "text").count() == 0


def test_key_values_and_xml(spark):
    got = files.key_values(one(spark, "# no\nA=1\nexport B = \"two\"\nc.d: x=y\n;no\nplain"), "id", "text").collect()
    assert [(r["line_no"], r["name"], r["value"]) for r in got] == [(2, "A", "1"), (3, "B", "two"), (4, "c.d", "x=y")]
    got = files.xml_settings(one(spark, '<add key="k" value="v"/><add name="n" connectionString="Server=x" />'), "id", "text").collect()
    assert [(r["name"], r["value"]) for r in got] == [("k", "v"), ("n", "Server=x")]


def test_projects_and_solutions(spark):
    text = '<Project Sdk="x"><PropertyGroup><TargetFrameworks>net48; net8.0</TargetFrameworks></PropertyGroup><ItemGroup><PackageReference Include="P" Version="1.0"/><ProjectReference Include="..\\B\\B.csproj"/></ItemGroup></Project>'
    r = files.xml_project(one(spark, text), "id", "text").first()
    assert (r["frameworks"], r["packages"], r["references"], r["error"]) == (["net48", "net8.0"], ["P"], ["..\\B\\B.csproj"], False)
    assert files.xml_project(one(spark, "<Proj"), "id", "text").first()["error"]
    text = 'Project("{A}") = "App", "src\\App.csproj", "{B}"\n<Project Path="lib/L.vbproj" />'
    assert [r["project"] for r in files.solution_projects(one(spark, text), "id", "text").collect()] == ["src/App.csproj", "lib/L.vbproj"]


def test_manifests(spark):
    rows = [("package.json", '{"dependencies": {"left-pad": "^1.3.0", "@a/b": "2.0.0"}}'), ("requirements.txt", "x==1.0\ny>=2\nz == 3.1 ; python_version"), ("go.mod", "require github.com/a/b v1.2.3"), ("Cargo.toml", 'serde = "1.0"\nt = { version = "0.2", features = [] }'), ("pom.xml", "<artifactId>j</artifactId>\n<version>4</version>"), ("A.csproj", '<PackageReference Include="N" Version="5.0" />'), ("build.gradle", "implementation 'g:lib:1.1'")]
    got = files.packages(spark.createDataFrame(rows, "path string, text string"), "path", "text").collect()
    assert sorted((r["ecosystem"], r["name"], r["version"]) for r in got) == [("cargo", "serde", "1.0"), ("cargo", "t", "0.2"), ("go", "github.com/a/b", "v1.2.3"), ("gradle", "lib", "1.1"), ("maven", "j", "4"), ("npm", "@a/b", "2.0.0"), ("npm", "left-pad", "^1.3.0"), ("nuget", "N", "5.0"), ("pip", "x", "1.0"), ("pip", "z", "3.1")]


def test_diff_lines(spark):
    text = "diff --git a/f b/f\n--- a/f\n+++ b/f\n@@ -1,3 +1,3 @@\n one\n-two\n+TWO\n three\n@@ -10,1 +20,2 @@\n ten\n+more\n"
    assert [(r["file"], r["line"]) for r in files.diff_lines(one(spark, text), "id", "text").orderBy("line").collect()] == [("f", 1), ("f", 2), ("f", 3), ("f", 20), ("f", 21)]


def test_tables_come_back(spark, tmp_path):
    df = spark.createDataFrame([("a,b", 'say "x"', ""), ("c", None, " ")], "Name string, note string, empty string")
    files.write_csv(df, str(tmp_path / "csv"))
    assert {r["Name"] for r in files.read_csv(spark, str(tmp_path / "csv")).collect()} == {"a,b", "c"}
    files.write_json(df, str(tmp_path / "json"))
    assert files.read_json(spark, str(tmp_path / "json"), "Name string, note string").where("note is not null").first()["note"] == 'say "x"'
    assert files.drop_empty_columns(df).columns == ["Name", "note"]
    assert files.header_alias(df, {"server": ["host", "NAME"], "os": []}).columns == ["server", "os"]
    (tmp_path / "b.xlsx").write_bytes(xlsx.workbook(["id", "txt"], [[1, "a<b"], [2, None]]))
    assert [tuple(r) for r in xlsx.read(spark, str(tmp_path / "b.xlsx")).collect()] == [("1", "a<b"), ("2", "")]
    assert "| a,b |" in files.markdown(df)


def shared_workbook() -> bytes:
    """Two sheets in an order of their own, shared and rich strings, gaps and a blank row."""
    import io
    import zipfile

    main, rel = xlsx.MAIN, xlsx.OFFICE
    parts = {
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="Second &amp; last" sheetId="2" r:id="b"/><sheet name="First" sheetId="1" r:id="a"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{xlsx.PACKAGE}/relationships"><Relationship Id="a" Target="worksheets/one.xml"/><Relationship Id="b" Target="/xl/worksheets/two.xml"/></Relationships>',
        "xl/sharedStrings.xml": f'<sst xmlns="{main}"><si><t>name</t></si><si><r><t>a</t></r><r><t xml:space="preserve"> b</t></r><rPh><t>no</t></rPh></si></sst>',
        "xl/worksheets/one.xml": f'<worksheet xmlns="{main}"><sheetData><row r="2"><c r="B2" t="s"><v>0</v></c><c r="AA2"><v>1.5</v></c></row><row r="3"/><row r="5"><c r="B5" t="s"><v>1</v></c><c t="b"><v>1</v></c></row></sheetData></worksheet>',
        "xl/worksheets/two.xml": f'<worksheet xmlns="{main}"><sheetData/></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def test_workbooks(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(shared_workbook())
    (tmp_path / "broken.xlsx").write_bytes(b"no workbook")
    (tmp_path / "b.xlsx").write_bytes(xlsx.workbook(["id", "ok", "x"], [[1, True, None], [], [2.5, False, "<&>"]], sheet='T "1"'))
    got = xlsx.cells(spark, str(tmp_path)).where("col is not null").collect()
    assert sorted((r["sheet"], r["row"], r["col"], r["kind"], r["value"]) for r in got if r["path"].endswith("a.xlsx")) == [("First", 2, 2, "text", "name"), ("First", 2, 27, "number", "1.5"), ("First", 5, 2, "text", "a b"), ("First", 5, 3, "bool", "1")]
    assert sorted((r["row"], r["col"], r["kind"], r["value"]) for r in got if r["sheet"] == 'T "1"' and r["row"] > 1) == [(2, 1, "number", "1"), (2, 2, "bool", "1"), (4, 1, "number", "2.5"), (4, 2, "bool", "0"), (4, 3, "text", "<&>")]
    assert [tuple(r) for r in xlsx.read(spark, str(tmp_path / "b.xlsx")).collect()] == [("1", "1", ""), ("", "", ""), ("2.5", "0", "<&>")]
    table = xlsx.read(spark, str(tmp_path / "a.xlsx"), "First")
    assert len(table.columns) == 27 and table.columns[1] == "name" and [r["name"] for r in table.collect()] == ["", "a b"]
    assert xlsx.read(spark, str(tmp_path / "broken.xlsx")).collect() == []
