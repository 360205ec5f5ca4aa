"""Columns and sources on small rows."""

import subprocess

import pytest
from pyspark.sql import functions as F

from corvane.functions import paths as P
from corvane.functions import text as T
from corvane.functions import vectors as V
from corvane.sources import files as SF
from corvane.sources import registry as SR
from corvane.sources import research as RS


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "path,norm",
    [("C:\\Work\\\\A.cs", "c:/work/a.cs"), ("file:///srv//x", "file:///srv/x"), ("a////b", "a/b"), ("://x//y", ":/x/y"), ("", ""), (None, None)],
)
def test_normalize(spark, path, norm):
    assert one(spark, P.normalize_path(F.lit(path).cast("string"))) == norm


def test_workspace_id(spark):
    assert one(spark, P.workspace_id(F.lit("C:\\A"))) == one(spark, P.workspace_id(F.lit("c:/a")))
    assert one(spark, P.workspace_id(F.lit(" "))) is None
    assert not one(spark, P.is_workspace_id(F.lit("xyz"))) and not one(spark, P.is_workspace_id(F.lit(None).cast("string")))


@pytest.mark.parametrize("path,glob,hit", [("/a/OBJ/x", "**/obj/**", True), ("/a/x.dll", "**/*.dll", False), ("/a/X.Dll", "*.dll", True), ("/a/foo/b", "foo", True), ("a\\bin\\c", "**/bin/**", True)])
def test_globs(spark, path, glob, hit):
    assert one(spark, P.matches_glob(F.lit(path), glob)) is hit


def test_symbols(spark):
    assert one(spark, T.pascal_symbols(F.lit("OrderService and IOrderService, OrderService MyX"))) == ["IOrderService", "OrderService"]
    assert one(spark, T.symbol_candidates(F.lit("find the foo_bar(x) in Größe 9a; foo_bar"))) == ["foo_bar", "Größe"]


def test_vectors(spark):
    a, z = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(0.0), F.lit(0.0))
    assert abs(one(spark, V.cosine_similarity(a, a)) - 1) < 1e-12
    assert one(spark, V.cosine_similarity(a, z)) is None and one(spark, V.cosine_similarity(a, F.array(F.lit(1.0)))) is None


def test_html(spark):
    page = '<html><head><title>A &amp; B</title><meta name="author" content="X"></head><script>var x = "<b>";</script><p>Hi&nbsp;<b>there</b></p></html>'
    assert one(spark, T.html_title(F.lit(page))) == "A & B" and one(spark, T.html_author(F.lit(page))) == "X"
    assert one(spark, T.html_text(F.lit(page))) == "A & B Hi there"
    assert one(spark, T.html_title(F.lit("<h1>only <i>h</i></h1>"))) == "only h" and one(spark, T.html_title(F.lit("x"))) is None


PDF = """arXiv:2401.01234v2
A Study of Many Interesting Things
Authors: Ann Lee, Bob Ray and Cy
Abstract
We look at
things.

1 Introduction
Text.
2.1 Second Part
Figure 1: A plot
More \f
3 Third
References
[1] First ref doi 10.1234/abc
[2] Second
ref
"""


def test_pdf(spark):
    t = F.lit(PDF)
    assert one(spark, T.pdf_title(t)) == "A Study of Many Interesting Things"
    assert one(spark, T.pdf_authors(t)) == ["Ann Lee", "Bob Ray"]
    assert one(spark, T.pdf_abstract(t)) == "We look at things."
    assert [(s.number, s.level, s.title) for s in one(spark, T.pdf_sections(t))] == [("1", 1, "Introduction"), ("2.1", 2, "Second Part")]  # a title of five characters is too short
    assert [(c.number, c.text, c.doi) for c in one(spark, T.pdf_citations(t))] == [(1, "First ref doi 10.1234/abc", "10.1234/abc"), (2, "Second\nref", None)]
    assert [(f.number, f.caption) for f in one(spark, T.pdf_figures(t))] == [(1, "A plot\nMore \f\n3 Third\nReferences\n[1] First ref doi 10.1234/abc\n[2] Second\nref")]  # no blank line ends it
    assert "### 2.1 Second Part" in one(spark, T.pdf_markdown(t)) and "## 1 Introduction" in one(spark, T.pdf_markdown(t))
    assert one(spark, T.arxiv_id(t)) == "2401.01234"


def test_sources(spark):
    atom = "<feed><entry><id>http://arxiv.org/abs/2401.01234v1</id><title>T\n  x</title><summary>S</summary><published>2024-01-02</published><author><name>A</name></author><author><name>B</name></author></entry></feed>"
    r = RS.from_atom(spark.createDataFrame([(atom,)], "payload string")).first()
    assert (r.source_id, r.title, r.authors, r.year) == ("2401.01234", "T x", ["A", "B"], 2024)
    js = '{"data":[{"paperId":"p","title":"T","year":2020,"citationCount":3,"authors":[{"name":"A"}],"externalIds":{"DOI":"10.1/x"}}]}'
    rows = RS.from_paper_json(spark.createDataFrame([(js,), ("{",)], "payload string")).collect()
    assert [(r.source_id, r.citation_count, r.doi) for r in rows] == [("p", 3, "10.1/x")]


def test_files(spark, tmp_path):
    for name in ("a.py", "b.md", "obj/c.py", "d.bin"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(f"# {name}")
    got = SF.scan_folder(spark, str(tmp_path), ["*.py", "a.py", "*.md"])
    assert sorted(r.path.rsplit("/", 1)[1] for r in got.collect()) == ["a.py", "a.py", "b.md"]
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", "a.py", "obj/c.py")
    assert [r.path for r in SF.tracked_files(spark, str(tmp_path)).collect()] == [f"{tmp_path}/a.py"]
    assert {(r.name, r.content_type, r.language) for r in SF.described(got).collect()} == {("a.py", "Code", "python"), ("b.md", "Markdown", None)}


def test_registry(spark, tmp_path):
    assert SR.read_registry(spark, str(tmp_path / "none.json")).count() == 0
    rows = spark.createDataFrame([("1", "/a", "A", ["x"], True), ("2", "/b", None, [], False)], "id string, path string, alias string, tags array<string>, is_default boolean")
    SR.write_registry(rows, str(tmp_path / "r"))
    assert sorted((r.id, r.is_default) for r in SR.read_registry(spark, str(tmp_path / "r")).collect()) == [("1", True), ("2", False)]


def test_excluded_files_are_never_read(spark, tmp_path):
    for name in ("a.txt", "obj/b.txt", "c.bin"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(name)
    found = SF.scan_folder(spark, str(tmp_path), ["*.txt"])
    assert [r.content for r in found.collect()] == ["a.txt"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "file_path" in plan.split("FileScan")[-1].split("DataFilters")[1].split("\n")[0]


def test_registry_that_cannot_be_read(spark, tmp_path):
    (tmp_path / "r.json").write_text("{broken")
    assert SR.read_registry(spark, str(tmp_path / "r.json")).count() == 0


@pytest.mark.parametrize(
    ("rule", "after", "then"),
    [
        ("* * * * *", "2024-01-01 00:00:30", "2024-01-01 00:01:00"), ("0 0 31 * *", "2024-04-01 00:00:00", "2024-05-31 00:00:00"), ("0 12 13 * FRI", "2024-01-01 00:00:00", "2024-09-13 12:00:00"), ("0 0 * * 7", "2024-01-06 23:59:00", "2024-01-07 00:00:00"),
        ("10/20 5 * * *", "2024-01-01 05:30:00", "2024-01-01 05:50:00"), ("0 0 30 2 *", "2024-01-01 00:00:00", None), ("0 0 29 2 MON", "2024-03-01 00:00:00", "2044-02-29 00:00:00"), ("* * * *", "2024-01-01 00:00:00", None), ("*/0 * * * *", "2024-01-01 00:00:00", None), ("5-1 * * * *", "2024-01-01 00:00:00", None),
    ],
)
def test_cron(spark, rule, after, then):
    from corvane.functions.cron import next_run

    got = one(spark, next_run(F.lit(rule), F.lit(after).cast("timestamp")))
    assert (got and str(got)) == then


def test_tools(spark):
    from dataclasses import dataclass

    from corvane import tools as TL

    @dataclass
    class Numbers:
        upto: int
        factor: float = 2.0

    globals()["Numbers"] = Numbers
    TL.register(TL.Tool("numbers", "Counts", Numbers, lambda s, p: s.range(p.upto).select((F.col("id") * p.factor).alias("x"))))
    assert [r.x for r in TL.call(spark, "numbers", '{"upto": 3, "factor": 3}').collect()] == [0.0, 3.0, 6.0]
    for name, arguments in (("none", "{}"), ("numbers", "{}"), ("numbers", '{"upto": "3"}'), ("numbers", '{"upto": 1, "more": 2}')):
        with pytest.raises(ValueError):
            TL.call(spark, name, arguments)
