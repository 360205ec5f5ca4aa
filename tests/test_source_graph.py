"""Scopes, one-pass extraction and the graph of source files, against results worked out by hand."""

import time

import pytest

from corvane.operators import chunking as C
from corvane.operators import extract as E
from corvane.operators import source_graph as G
from corvane.operators.scopes import blanked, facts, line_of

WORKER = """using System;
using Acme.Tools;
namespace Acme.Core;

public interface IRun { string Run(int x); }

public abstract class Worker : IRun
{
    // a } brace
    protected readonly Helper _helper = new Helper();
    public virtual string Run(int x) { var s = "}{"; return _helper.Help(x, Twice(x)); }
    protected int Twice(int x) => x * 2;
    protected int Twice(int x, int y) => x * y;
}
"""
RUNNER = """using Acme.Core;
using Acme.Tools;
using Alias = Acme.Tools.Maker;
namespace Acme.App
{
    public class Runner : Worker, IDisposable
    {
        public Runner(int x) : base() { }
        public override string Run(int x)
        {
            var made = new Maker();
            made.Make("a, b");
            Alias.Shared();
            Console.WriteLine(Twice(x, 2));
            Twice(1); Twice(2);
            this.Stop();
            var unknown = new Nowhere();
            return base.Run(x);
        }
        private void Stop() { }
        public void Dispose() { Stop(); }
        enum Kind { A, B }
    }
}
"""
TOOLS = "namespace Acme.Tools;\r\npublic class Helper\r\n{\r\n    public string Help(int a, int b) => $\"{a}}\";\r\n}\r\npublic class Maker { public void Make(string s) { } public static void Shared() { } }\r\n"
BASE_PY = 'class Base:\n    """Base of all. More."""\n    def go(self, n):\n        return self.step(n)\n    def step(self, n):\n        return n\n\n\ndef helper(x):\n    return len(x)\n'
APP_PY = "from pkg.base import Base, helper as h\nimport pkg.base\nfrom .base import *\n\n\nclass App(Base):\n    def step(self, n):\n        b = Base()\n        b.go(1)\n        h('}')\n        pkg.base.helper('x')\n        return super().step(n)\n\n\ndef main():\n    App().go(2)\n"
PROJECT = '<Project><ItemGroup><ProjectReference Include="..\\Core\\Acme.Core.csproj" /><ProjectReference Include="..\\None\\None.csproj"/></ItemGroup></Project>'
SOLUTION = 'Project("{F}") = "Acme.Core", "Core\\Acme.Core.csproj", "{A}"\r\nProject("{F}") = "Acme.App", "App\\Acme.App.csproj", "{B}"\r\n'
FILES = [
    ("/s/Core/Worker.cs", WORKER), ("/s/App/Runner.cs", RUNNER), ("/s/Core/Tools/Tools.cs", TOOLS), ("/s/pkg/base.py", BASE_PY), ("/s/pkg/app.py", APP_PY), ("/s/pkg/broken.py", "def f(:\n"),
    ("/s/Core/Acme.Core.csproj", "<Project/>"), ("/s/App/Acme.App.csproj", PROJECT), ("/s/All.sln", SOLUTION), ("/s/empty.cs", ""), ("/s/none.cs", None),
]


@pytest.fixture(scope="module")
def graph(spark):
    nodes, edges, errors = G.source_graph(spark.createDataFrame(FILES, "path string, content string").repartition(4), "/s")
    return {r.id: r for r in nodes.collect()}, {tuple(r) for r in edges.collect()}, errors.collect()


def test_edges_cross_files(graph):
    _, edges, _ = graph
    run = "Acme.App.Runner.Run(int)"
    by = lambda kind, source: {t for k, s, t in edges if (k, s) == (kind, source)}
    # By scope, by import, by alias, by a variable's type, by a field's type, by base class, and from outside.
    assert by("Calls", run) == {
        "Acme.Tools.Maker.Make(string)", "Acme.Tools.Maker.Shared()", "Console.WriteLine", "Acme.Core.Worker.Twice(int, int)", "Acme.Core.Worker.Twice(int)", "Acme.App.Runner.Stop()", run,
    }
    assert by("Uses", run) == {"Acme.Tools.Maker"}
    assert by("Calls", "Acme.Core.Worker.Run(int)") == {"Acme.Tools.Helper.Help(int, int)", "Acme.Core.Worker.Twice(int)"}
    assert by("Inherits", "Acme.App.Runner") == {"Acme.Core.Worker"} and by("Implements", "Acme.App.Runner") == {"IDisposable"}
    assert by("Implements", "Acme.Core.Worker") == {"Acme.Core.IRun"}
    assert by("Overrides", run) == {"Acme.Core.Worker.Run(int)"}
    assert by("Declares", "Acme.App") == {"Acme.App.Runner"} and by("Declares", "pkg.base") == {"pkg.base.Base"}
    assert by("Contains", "Acme.App.Runner") >= {run, "Acme.App.Runner.Stop()", "Acme.App.Runner.Runner(int)"}
    assert by("Contains", "file|/s/App/Runner.cs") == {"Acme.App.Runner", "Acme.App.Runner.Kind"}


def test_edges_of_python(graph):
    _, edges, _ = graph
    by = lambda kind, source: {t for k, s, t in edges if (k, s) == (kind, source)}
    assert by("Inherits", "pkg.app.App") == {"pkg.base.Base"} and by("Overrides", "pkg.app.App.step(n)") == {"pkg.base.Base.step(n)"}
    assert by("Calls", "pkg.app.App.step(n)") == {"pkg.base.Base.go(n)", "pkg.base.helper(x)", "pkg.app.App.step(n)"}
    assert by("Uses", "pkg.app.App.step(n)") == {"pkg.base.Base"} and by("Uses", "pkg.app.main()") == {"pkg.app.App"}
    assert by("Calls", "pkg.base.Base.go(n)") == {"pkg.base.Base.step(n)"} and by("Calls", "pkg.base.helper(x)") == {"len"}


def test_projects_and_placeholders(graph):
    nodes, edges, errors = graph
    assert {e for e in edges if e[1].startswith(("project|", "solution|"))} == {
        ("References", "project|Acme.App", "project|Acme.Core"), ("Contains", "solution|All", "project|Acme.Core"), ("Contains", "solution|All", "project|Acme.App"),
        ("Contains", "project|Acme.Core", "file|/s/Core/Worker.cs"), ("Contains", "project|Acme.Core", "file|/s/Core/Tools/Tools.cs"), ("Contains", "project|Acme.App", "file|/s/App/Runner.cs"),
    }
    assert {i: n.node_type for i, n in nodes.items() if n.is_external} == {"IDisposable": "Interface", "Console.WriteLine": "Method", "len": "Method"}
    assert nodes["Acme.App.Runner"].line_number == 6 and nodes["Acme.Core.Worker"].modifiers == "public abstract" and nodes["Acme.App.Runner.Kind"].node_type == "Enum"
    assert nodes["Acme.Core.Worker._helper"].node_type == "Field" and nodes["Acme.App.Runner.Runner(int)"].node_type == "Constructor"
    assert [e.path for e in errors] == ["/s/pkg/broken.py"] and errors[0].error.startswith("SyntaxError")
    assert {k for k, _, _ in edges} == {"Contains", "Declares", "Inherits", "Implements", "References", "Calls", "Uses", "Overrides"}


def test_graph_of_nothing(spark):
    nodes, edges, errors = G.source_graph(spark.createDataFrame([], "path string, content string"))
    assert nodes.count() == edges.count() == errors.count() == 0


SOURCES = {
    "java": ('package a.b;\nimport java.util.List;\n/** Docs. More. */\n@Ann("x{")\npublic class A<T> extends B implements C {\n  private int n = 0;\n  /** Runs. */\n  @Override\n  public String run(List<String> xs) throws E { char c = \'}\'; String s = """\n   } { """; return go(xs, 1); }\n  interface I { void m(int q); }\n}\n',
        [("imports", "Imports", 2, 2, None, None), ("class", "A", 4, 12, None, "Docs."), ("method", "A.run", 8, 10, "A", "Runs."), ("interface", "A.I", 11, 11, "A", None), ("method", "I.m", 11, 11, "I", None)]),
    "go": ('package main\n\nimport (\n    "fmt"\n)\n\n// T is a type. More.\ntype T struct {\n    A int\n}\n\n// Run runs.\nfunc (t *T) Run(a int) error {\n    s := `}`\n    if a > 1 {\n        fmt.Println("}")\n    }\n    return nil\n}\n\nfunc main() { helper(1) }\n',
        [("imports", "Imports", 4, 4, None, None), ("struct", "T", 8, 10, None, "T is a type."), ("method", "T.Run", 13, 19, "T", "Run runs."), ("function", "main", 21, 21, None, None)]),
    "rs": ("use std::fmt;\n/// A struct. More.\npub struct P<'a> { x: &'a str }\n/* a /* nested } */ } */\nimpl<'a> Display for P<'a> {\n    /// Formats.\n    fn fmt(&self) -> R { let c = '}'; let r = r#\"}\"#; ok() }\n}\nmod inner { pub fn f(x: i32) -> i32 { x } }\ntrait T { fn a(&self); }\n",
        [("imports", "Imports", 1, 1, None, None), ("struct", "P", 3, 3, None, "A struct."), ("impl", "P", 5, 8, None, "a /* nested } */ }"), ("method", "P.fmt", 7, 7, "P", "Formats."), ("namespace", "inner", 9, 9, None, None), ("function", "f", 9, 9, None, None), ("trait", "T", 10, 10, None, None), ("method", "T.a", 10, 10, "T", None)]),
    "cpp": ('#include <vector>\n#define X {\nnamespace n {\n// A class.\nclass K : public Base {\n public:\n  K(int x) : v(x) {}\n  int get() const { return v; }\n private:\n  int v;\n};\n}\nint n::K::other(int a) { const char* s = "}"; return get(); }\n',
        [("imports", "Imports", 1, 1, None, None), ("namespace", "n", 3, 12, None, None), ("class", "K", 5, 11, None, "A class."), ("constructor", "K.K", 7, 7, "K", None), ("method", "K.get", 8, 8, "K", None), ("method", "n.K.other", 13, 13, "n.K", None)]),
    "c": ("#include <stdio.h>\nstruct S { int a; };\n/* Adds. */\nstatic int add(int a, int b)\n{\n    if (a) { return '}'; }\n    return a + b;\n}\n",
        [("imports", "Imports", 1, 1, None, None), ("struct", "S", 2, 2, None, None), ("function", "add", 4, 8, None, "Adds.")]),
}


@pytest.mark.parametrize("ext", list(SOURCES))
def test_scope_chunks(ext):
    text, want = SOURCES[ext]
    for t in (text, text.replace("\n", "\r\n")):
        got = [(c.chunk_type, c.title, c.start_line, c.end_line, c.parent, c.doc) for c in C.ingest_outline(f"x.{ext}", t)]
        assert got == want
    lines = text.split("\n")
    for c in C.ingest_outline(f"x.{ext}", text):
        assert c.text in text and lines[c.start_line - 1].strip().startswith(c.text.split("\n")[0].strip()[:10]) or c.chunk_type in ("imports",) or c.start_line == c.end_line


def test_members_after_braces_in_strings_stay():
    text = 'public class T\n{\n    string A() { return "}"; }\n    // } and {\n    int B() { return 1; }\n}\n'
    assert [(c.title, c.start_line, c.end_line) for c in C.ingest_members("a.cs", text)] == [("T", 1, 6), ("T.A", 3, 3), ("T.B", 5, 5)]


def test_blanks_keep_places():
    for language in ("csharp", "java", "go", "rust", "c", "cpp", "typescript"):
        for text in ('a "b\\"c" d // e\n\'x\' /* y\n z */ f', '"open\nnext', "/* open", "", '@"a""b" `c` r#"d"#', "'a"):
            got = blanked(text, language)
            assert len(got) == len(text) and [k for k, c in enumerate(text) if c == "\n"] == [k for k, c in enumerate(got) if c == "\n"]


@pytest.mark.parametrize("piece", ["a b\n", "{", "(", '"a",', "class A { void f() { g(1); } }\n", "/*", "= {", "x.y.", "@a(", "<"])
def test_time_is_linear(piece):
    def took(n):
        began = time.perf_counter()
        for language in ("csharp", "java", "go", "rust", "cpp", "typescript"):
            facts(piece * n, language)
        return time.perf_counter() - began

    assert took(8000) < 12 * max(took(2000), 0.05)


def test_odd_sources_never_raise():
    for text in ("}", "}}}{", ");", "class", "class {", "namespace ;", "public", "{;}", "\x00", "using ;", "int f(", "func", "impl {", "x => {", "a(b{c)d}e"):
        for language in ("csharp", "java", "go", "rust", "c", "cpp", "typescript"):
            f = facts(text, language)
            assert all(0 <= d.start <= d.end <= len(text) for d in f.declared)
    assert line_of("a\nb\n")(2) == 2


def test_one_python_stage_and_kinds(spark):
    files = spark.createDataFrame([("/s/A.cs", TOOLS), ("/s/x.zzz", "text"), ("/s/b.py", "def f(:")], "path string, content string")
    df = E.source_facts(files, "chunk,node,edge", "/s")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PythonUDTF") == 1
    assert set(E.source_facts(files, "edge").columns) == {"tag", "path", "ord", "edge_type", "source_id", "target_id", "name", "text"}
    assert [c.title for c in E.split_by_kind(df, "chunk").orderBy("ord").collect()] == ["Helper", "Helper.Help", "Maker", "Maker.Make", "Maker.Shared"]
    assert sorted((r.path, r.name) for r in E.split_by_kind(df, "error").collect()) == [("/s/b.py", "SyntaxError"), ("/s/x.zzz", "KeyError")]
    E.register(spark)
    files.createOrReplaceTempView("files_of_facts")
    got = spark.sql("SELECT f.node_type, f.name FROM files_of_facts AS s, LATERAL facts_of_source(s.path, s.content, 'node', '') AS f WHERE f.tag = 'node' AND f.node_type = 'Class'").collect()
    assert sorted(tuple(r) for r in got) == [("Class", "Helper"), ("Class", "Maker")]
    with pytest.raises(Exception, match="unknown kinds"):
        E.source_facts(files, "chunk,nothing").collect()


def test_a_failing_file_ends_no_run(spark):
    def picky(path, text):
        if "bad" in text:
            raise RuntimeError(f"cannot read {path}")
        return [C.Chunk(text, "good")]

    C.register_ingestor("picky", picky, ("pick",))
    files = spark.createDataFrame([("/a.pick", "fine"), ("/b.pick", "bad one"), ("/c.md", "# T\nx"), ("/d.md", " "), ("/e.md", None)], "path string, content string")
    chunks, errors, summary = C.index_run(files)
    assert sorted(r.path for r in chunks.collect()) == ["/a.pick", "/c.md"]
    assert [tuple(r) for r in errors.collect()] == [("/b.pick", "RuntimeError: cannot read /b.pick")]
    assert tuple(summary.first()) == (5, 2, 1, 2, 2, "Completed")
    assert C.ingest(files).filter("chunk_type = 'error'").count() == 0
    assert C.index_run(files.filter("path = '/b.pick'"))[2].first()["state"] == "Failed"
    with pytest.raises(ValueError, match="no ingestor"):
        C.index_run(files, "no such ingestor")
