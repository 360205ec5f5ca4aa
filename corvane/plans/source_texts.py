"""Queries over source text: trees of scopes, extraction in one pass, the graph across files, and runs in which files fail.

Each supplier has some files whose calls cross to other suppliers' files; the SQL fills the same templates.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixtures as X
from ..operators import chunking as C
from ..operators import extract as E
from ..operators import source_graph as G
from .base import add
from .code_texts import _filled, _filled_sql

#: Which other supplier's file a supplier's files call.
_OTHER = "s_suppkey % 7 + 1"


def _sql(template: str | None) -> str:
    return "NULL::VARCHAR" if template is None else _filled_sql(template, k="s_suppkey", m=_OTHER)


def _files(t: X.Tables, templates: dict[str, str]) -> DataFrame:
    """A file per supplier and template, whose name and text have the supplier's number."""
    rows = F.array(*[F.struct(_of(p).alias("path"), _of(c).alias("content")) for p, c in templates.items()])
    return t.supplier.select(F.explode(rows).alias("f")).select("f.*")


def _of(template: str) -> Column:
    return _filled(template, k=F.col("s_suppkey"), m=F.expr(_OTHER))


def _rows_sql(columns: tuple[str, ...], rows: list[tuple], union: str = "UNION ALL") -> str:
    """SQL of rows of templates and numbers for each supplier."""
    shown = lambda v: str(v) if isinstance(v, (int, bool)) else _sql(v)
    return f" {union} ".join("SELECT " + ", ".join(f"{shown(v)} AS {c}" for c, v in zip(columns, r)) + " FROM supplier" for r in rows)


# ---- trees of scopes: braces in strings and comments, members without bodies, line ends of two characters

_JAVA = (
    'package a.b{k};\nimport java.util.List;\nimport x.Y;\n\n/** Type {k}. More. */\n@Named("{")\npublic class A{k}<T> extends B{m} implements C, D {\n  private int n = {k}; // }\n  /** Runs it. */\n  public String run(List<String> xs, int b) {\n    String s = "}{";\n'
    '    if (b > {k}) { return go(xs); }\n    return s;\n  }\n  void empty() {}\n  interface I { void m(int q); }\n}\nenum E{k} { X, Y }\n'
)
_GO = (
    'package p{k}\n\nimport (\n\t"fmt"\n\tq "a/p{m}"\n)\n\n// T{k} is one. More.\ntype T{k} struct {\n\tA int\n}\n\n// Run runs.\nfunc (t *T{k}) Run(a int, b string) error {\n\ts := `}\n}`\n\tif a > {k} {\n\t\tfmt.Println("}", s)\n\t}\n\treturn q.Do(a)\n}\n\n'
    "type I{k} interface {\n\tDo(a int) error\n}\n\nfunc main() { helper({k}) }\n"
)
_RUST = "use std::fmt;\n\n/// A struct of {k}. More.\npub struct P{k}<'a> { x: &'a str }\n\nimpl<'a> Show for P{k}<'a> {\n    /// Shows.\n    fn show(&self, n: u8) -> R { let c = '}'; let r = r#\"}\"{\"#; ok(r) }\n}\nmod inner{k} {\n    pub fn f(x: i32) -> i32 { x /* } /* } */ } */ }\n}\npub trait T{k} { fn a(&self); }\n"
_CPP = '#include <vector>\r\n#include "m{m}.h"\r\n#define X {\r\nnamespace n{k} {\r\n// A class {k}. More.\r\nclass K{k} : public Base, Other {\r\n public:\r\n  K{k}(int x) : v(x) {}\r\n  int get() const { return v; }\r\n  int v;\r\n};\r\n}\r\nint n{k}::K{k}::other(int a) { const char* s = "}"; return get(); }\r\n'
_C = "#include <stdio.h>\n\nstruct S{k} { int a; };\n\n/* Adds {k}. Well. */\nstatic int add{k}(int a, int b)\n{\n    if (a) { return '}'; }\n    return a + b; // }\n}\n\nint proto(int a);\n"

_TREE = ("path", "chunk_index", "chunk_type", "title", "language", "start_line", "end_line", "parent", "signature", "doc")


def _tree(ext: str, template: str, language: str, rows: list[tuple]) -> None:
    """A query of the chunks (type, title, first and last line, parent, signature, documentation, text) of a supplier's file; the text is checked by its hash."""
    path = f"/src/f{{k}}.{ext}"
    full = [(path, i, r[0], r[1], language, r[2], r[3], *r[4:7]) for i, r in enumerate(rows)]
    sha = [f"sha256({_sql(r[7])})" for r in rows]
    sql = " UNION ALL ".join(_rows_sql(_TREE, [f]).replace(" FROM supplier", f", {h} AS sha FROM supplier") for f, h in zip(full, sha))
    add(f"tree_{language}", lambda t: C.ingest(_files(t, {path: template}), "outline").select(*_TREE, F.sha2("text", 256).alias("sha")), sql)


def _lines(text: str, a: int, b: int) -> str:
    """Lines a to b as they are, without the indent of the first."""
    return "\n".join(text.split("\n")[a - 1 : b]).lstrip()


_tree("java", _JAVA, "java", [
    ("imports", "Imports", 2, 3, None, None, None, _lines(_JAVA, 2, 3)), ("class", "A{k}", 6, 17, None, "public class A{k}<T> extends B{m} implements C, D", "Type {k}.", _lines(_JAVA, 6, 17)),
    ("method", "A{k}.run", 10, 14, "A{k}", "public String run(List<String> xs, int b)", "Runs it.", _lines(_JAVA, 10, 14)), ("method", "A{k}.empty", 15, 15, "A{k}", "void empty()", None, _lines(_JAVA, 15, 15)),
    ("interface", "A{k}.I", 16, 16, "A{k}", "interface I", None, _lines(_JAVA, 16, 16)), ("method", "I.m", 16, 16, "I", "void m(int q)", None, "void m(int q);"), ("enum", "E{k}", 18, 18, None, "enum E{k}", None, _lines(_JAVA, 18, 18)),
])
_tree("go", _GO, "go", [
    ("imports", "Imports", 4, 5, None, None, None, '"fmt"\n\tq "a/p{m}"'), ("struct", "T{k}", 9, 11, None, "type T{k} struct", "T{k} is one.", _lines(_GO, 9, 11)),
    ("method", "T{k}.Run", 14, 21, "T{k}", "func (t *T{k}) Run(a int, b string) error", "Run runs.", _lines(_GO, 14, 21)), ("interface", "I{k}", 23, 25, None, "type I{k} interface", None, _lines(_GO, 23, 25)),
    ("function", "main", 27, 27, None, "func main()", None, _lines(_GO, 27, 27)),
])
_tree("rs", _RUST, "rust", [
    ("imports", "Imports", 1, 1, None, None, None, "use std::fmt;"), ("struct", "P{k}", 4, 4, None, "pub struct P{k}<'a>", "A struct of {k}.", _lines(_RUST, 4, 4)), ("impl", "P{k}", 6, 9, None, "impl<'a> Show for P{k}<'a>", None, _lines(_RUST, 6, 9)),
    ("method", "P{k}.show", 8, 8, "P{k}", "fn show(&self, n: u8) -> R", "Shows.", _lines(_RUST, 8, 8)), ("namespace", "inner{k}", 10, 12, None, "mod inner{k}", None, _lines(_RUST, 10, 12)),
    ("function", "f", 11, 11, None, "pub fn f(x: i32) -> i32", None, _lines(_RUST, 11, 11)), ("trait", "T{k}", 13, 13, None, "pub trait T{k}", None, _lines(_RUST, 13, 13)), ("method", "T{k}.a", 13, 13, "T{k}", "fn a(&self)", None, "fn a(&self);"),
])
_tree("cpp", _CPP, "cpp", [
    ("imports", "Imports", 1, 2, None, None, None, '#include <vector>\r\n#include "m{m}.h"'), ("namespace", "n{k}", 4, 12, None, "namespace n{k}", None, _lines(_CPP, 4, 12).rstrip("\r")),
    ("class", "K{k}", 6, 11, None, "class K{k} : public Base, Other", "A class {k}.", _lines(_CPP, 6, 11).removesuffix(";\r")), ("constructor", "K{k}.K{k}", 8, 8, "K{k}", "K{k}(int x) : v(x)", None, "K{k}(int x) : v(x) {}"),
    ("method", "K{k}.get", 9, 9, "K{k}", "int get() const", None, "int get() const { return v; }"), ("method", "n{k}.K{k}.other", 13, 13, "n{k}.K{k}", "int n{k}::K{k}::other(int a)", None, _lines(_CPP, 13, 13).rstrip("\r")),
])
_tree("c", _C, "c", [
    ("imports", "Imports", 1, 1, None, None, None, "#include <stdio.h>"), ("struct", "S{k}", 3, 3, None, "struct S{k}", None, "struct S{k} { int a; }"), ("function", "add{k}", 6, 10, None, "static int add{k}(int a, int b)", "Adds {k}.", _lines(_C, 6, 10)),
])

# ---- the graph across files

_WORKER = (
    'using Tools;\nnamespace Core{k};\n\npublic interface IRun{k} { string Run(int x); }\n\npublic abstract class W{k} : IRun{k}\n{\n    // a } brace\n    protected readonly T{m} _tool = new T{m}();\n    public virtual string Run(int x) { var s = "}{"; return _tool.Help(x, Twice(x)); }\n'
    "    protected int Twice(int x) => x * 2;\n    protected int Twice(int x, int y) => x * y;\n}\n"
)
_RUNNER = (
    "using Core{m};\nusing Tools;\nusing Alias = Tools.T{k};\nnamespace App{k}\n{\n    public class R{k} : W{m}, IDisposable\n    {\n        public R{k}(int x) : base() { }\n        public override string Run(int x)\n        {\n            var made = new T{m}();\n            made.Help(1, 2);\n            Alias.Shared();\n"
    '            Console.WriteLine(Twice(x, 2), "a, b");\n            Twice(1); Twice(2);\n            this.Stop();\n            var gone = new Nowhere();\n            return base.Run(x);\n        }\n        private void Stop() { }\n        public void Dispose() { Stop(); }\n    }\n}\n'
)
_TOOL = 'namespace Tools;\r\npublic class T{k}\r\n{\r\n    public string Help(int a, int b) => $"}";\r\n    public static void Shared() { }\r\n}\r\n'
_BASE_PY = 'class B{k}:\n    """Base of all."""\n    def go(self, n):\n        return self.step(n)\n    def step(self, n):\n        return n\n\n\ndef helper(x):\n    return len(x)\n'
_APP_PY = "from pkg.b{m} import B{m}, helper as h\nimport pkg.b{k}\n\n\nclass A{k}(B{m}):\n    def step(self, n):\n        b = B{m}()\n        b.go(1)\n        h('}')\n        pkg.b{k}.helper('x')\n        return super().step(n)\n"
_PROJECT = '<Project><ItemGroup><ProjectReference Include="..\\P{m}\\P{m}.csproj" /><ProjectReference Include="..\\None\\None.csproj"/></ItemGroup></Project>'
_SOURCES = {
    "/s/P{k}/core/W{k}.cs": _WORKER, "/s/P{k}/R{k}.cs": _RUNNER, "/s/P{k}/T{k}.cs": _TOOL, "/s/pkg/b{k}.py": _BASE_PY, "/s/pkg/a{k}.py": _APP_PY, "/s/pkg/broken{k}.py": "def f(:\n", "/s/P{k}/P{k}.csproj": _PROJECT,
}
_W, _R, _RUN = "Core{k}.W{k}", "App{k}.R{k}", "App{k}.R{k}.Run(int)"
#: (kind, source, target) of all edges of a supplier's files.
_EDGES = [
    *[("Contains", f"file|/s/P{{k}}/{f}", i) for f, i in (("core/W{k}.cs", "Core{k}.IRun{k}"), ("core/W{k}.cs", _W), ("R{k}.cs", _R), ("T{k}.cs", "Tools.T{k}"))],
    *[("Contains", f"file|/s/pkg/{f}", i) for f, i in (("b{k}.py", "pkg.b{k}.B{k}"), ("b{k}.py", "pkg.b{k}.helper(x)"), ("a{k}.py", "pkg.a{k}.A{k}"))],
    *[("Contains", _W, f"{_W}.{m}") for m in ("_tool", "Run(int)", "Twice(int)", "Twice(int, int)")], ("Contains", "Core{k}.IRun{k}", "Core{k}.IRun{k}.Run(int)"),
    *[("Contains", _R, f"{_R}.{m}") for m in ("R{k}(int)", "Run(int)", "Stop()", "Dispose()")], *[("Contains", "Tools.T{k}", f"Tools.T{{k}}.{m}") for m in ("Help(int, int)", "Shared()")],
    *[("Contains", "pkg.b{k}.B{k}", f"pkg.b{{k}}.B{{k}}.{m}") for m in ("go(n)", "step(n)")], ("Contains", "pkg.a{k}.A{k}", "pkg.a{k}.A{k}.step(n)"),
    *[("Contains", "project|P{k}", f"file|/s/P{{k}}/{f}") for f in ("core/W{k}.cs", "R{k}.cs", "T{k}.cs")],
    ("Declares", "Core{k}", "Core{k}.IRun{k}"), ("Declares", "Core{k}", _W), ("Declares", "App{k}", _R), ("Declares", "Tools", "Tools.T{k}"), ("Declares", "pkg.b{k}", "pkg.b{k}.B{k}"), ("Declares", "pkg.a{k}", "pkg.a{k}.A{k}"),
    ("Inherits", _R, "Core{m}.W{m}"), ("Inherits", "pkg.a{k}.A{k}", "pkg.b{m}.B{m}"), ("Implements", _R, "IDisposable"), ("Implements", _W, "Core{k}.IRun{k}"), ("References", "project|P{k}", "project|P{m}"),
    ("Overrides", _RUN, "Core{m}.W{m}.Run(int)"), ("Overrides", "pkg.a{k}.A{k}.step(n)", "pkg.b{m}.B{m}.step(n)"), ("Uses", _RUN, "Tools.T{m}"), ("Uses", "pkg.a{k}.A{k}.step(n)", "pkg.b{m}.B{m}"),
    *[("Calls", _RUN, i) for i in ("Tools.T{m}.Help(int, int)", "Tools.T{k}.Shared()", "Console.WriteLine", "Core{m}.W{m}.Twice(int, int)", "Core{m}.W{m}.Twice(int)", f"{_R}.Stop()", _RUN)],
    ("Calls", f"{_R}.Dispose()", f"{_R}.Stop()"), *[("Calls", f"{_W}.Run(int)", i) for i in ("Tools.T{m}.Help(int, int)", f"{_W}.Twice(int)")],
    ("Calls", "pkg.b{k}.B{k}.go(n)", "pkg.b{k}.B{k}.step(n)"), ("Calls", "pkg.b{k}.helper(x)", "len"),
    *[("Calls", "pkg.a{k}.A{k}.step(n)", i) for i in ("pkg.b{m}.B{m}.go(n)", "pkg.b{m}.helper(x)", "pkg.b{k}.helper(x)", "pkg.a{k}.A{k}.step(n)")],
]
#: (id, kind, name, file, line, external) of all nodes.
_NODES = [
    *[(f"file|{p}", "File", p.rsplit("/", 1)[-1], p, 1, False) for p in _SOURCES if "broken" not in p and not p.endswith("proj")], ("project|P{k}", "Project", "P{k}", "/s/P{k}/P{k}.csproj", None, False),
    ("Core{k}", "Namespace", "Core{k}", "/s/P{k}/core/W{k}.cs", 2, False), ("App{k}", "Namespace", "App{k}", "/s/P{k}/R{k}.cs", 4, False), *[(f"pkg.{x}{{k}}", "Namespace", f"{x}{{k}}", f"/s/pkg/{x}{{k}}.py", 1, False) for x in "ab"],
    *[(i, kind, i.partition("(")[0].rsplit(".", 1)[-1], f"/s/P{{k}}/{f}", line, False) for i, kind, f, line in (
        ("Core{k}.IRun{k}", "Interface", "core/W{k}.cs", 4), ("Core{k}.IRun{k}.Run(int)", "Method", "core/W{k}.cs", 4), (_W, "Class", "core/W{k}.cs", 6), (f"{_W}._tool", "Field", "core/W{k}.cs", 9), (f"{_W}.Run(int)", "Method", "core/W{k}.cs", 10),
        (f"{_W}.Twice(int)", "Method", "core/W{k}.cs", 11), (f"{_W}.Twice(int, int)", "Method", "core/W{k}.cs", 12), (_R, "Class", "R{k}.cs", 6), (f"{_R}.R{{k}}(int)", "Constructor", "R{k}.cs", 8), (_RUN, "Method", "R{k}.cs", 9),
        (f"{_R}.Stop()", "Method", "R{k}.cs", 20), (f"{_R}.Dispose()", "Method", "R{k}.cs", 21), ("Tools.T{k}", "Class", "T{k}.cs", 2), ("Tools.T{k}.Help(int, int)", "Method", "T{k}.cs", 4), ("Tools.T{k}.Shared()", "Method", "T{k}.cs", 5))],
    *[(i, kind, i.partition("(")[0].rsplit(".", 1)[-1], f"/s/pkg/{f}", line, False) for i, kind, f, line in (
        ("pkg.b{k}.B{k}", "Class", "b{k}.py", 1), ("pkg.b{k}.B{k}.go(n)", "Method", "b{k}.py", 3), ("pkg.b{k}.B{k}.step(n)", "Method", "b{k}.py", 5), ("pkg.b{k}.helper(x)", "Method", "b{k}.py", 9), ("pkg.a{k}.A{k}", "Class", "a{k}.py", 5), ("pkg.a{k}.A{k}.step(n)", "Method", "a{k}.py", 6))],
    ("IDisposable", "Interface", "IDisposable", None, None, True), ("Console.WriteLine", "Method", "WriteLine", None, None, True), ("len", "Method", "len", None, None, True),
]


def _graph(part: int, *columns: str) -> Callable[[X.Tables], DataFrame]:
    return lambda t: G.source_graph(_files(t, _SOURCES), "/s")[part].select(*columns)


add("source_graph_edges", _graph(1, "edge_type", "source_id", "target_id"), _rows_sql(("edge_type", "source_id", "target_id"), _EDGES, "UNION"))
_NODE_COLUMNS = ("id", "node_type", "name", "file_path", "line_number", "is_external")
_NODE_ROWS = [tuple(v if c != "line_number" or v is not None else None for c, v in zip(_NODE_COLUMNS, r)) for r in _NODES]
# The namespace of all tools is one node, where its first part by path stands.
add("source_graph_nodes", _graph(0, *_NODE_COLUMNS),
    _rows_sql(_NODE_COLUMNS, _NODE_ROWS, "UNION").replace("NULL::VARCHAR AS line_number", "NULL::INTEGER AS line_number") + " UNION SELECT 'Tools', 'Namespace', 'Tools', min('/s/P' || s_suppkey || '/T' || s_suppkey || '.cs'), 1, false FROM supplier HAVING count(*) > 0")
add("source_graph_errors", lambda t: G.source_graph(_files(t, _SOURCES), "/s")[2].select("path", F.substring_index("error", ":", 1).alias("error")), "SELECT '/s/pkg/broken' || s_suppkey || '.py' AS path, 'SyntaxError' AS error FROM supplier")
#: (caller, called) of calls between different suppliers' files.
add("cross_file_calls",
    lambda t: (lambda n, e: e.filter("edge_type = 'Calls'").join(n.select(F.col("id").alias("source_id"), F.col("file_path").alias("a")), "source_id").join(n.select(F.col("id").alias("target_id"), F.col("file_path").alias("b")), "target_id")
        .filter("a <> b").groupBy(F.col("a").alias("file_path")).agg(F.count(F.lit(1)).alias("n_calls"), F.array_join(F.sort_array(F.collect_set("b")), ",").alias("files")))(*G.source_graph(_files(t, _SOURCES), "/s")[:2]),
    f"""WITH e AS ({_rows_sql(("edge_type", "source_id", "target_id"), _EDGES, "UNION")}), n AS ({_rows_sql(("id", "file_path"), [(r[0], r[3]) for r in _NODES if r[3]], "UNION")}),
    c AS (SELECT a.file_path AS file_path, b.file_path AS b FROM e JOIN n AS a ON e.source_id = a.id JOIN n AS b ON e.target_id = b.id WHERE e.edge_type = 'Calls' AND a.file_path <> b.file_path)
    SELECT file_path, count(*) AS n_calls, array_to_string(list_sort(list_distinct(list(b))), ',') AS files FROM c GROUP BY file_path""")  # fmt: skip

# ---- one pass for chunks, nodes and edges

_ONE = {p: c for p, c in _SOURCES.items() if p.endswith(("T{k}.cs", "b{k}.py", "broken{k}.py"))}


def _one_pass(kind: str, *columns: str) -> Callable[[X.Tables], DataFrame]:
    """Rows of a kind in SQL, of an extraction that gives all three."""

    def build(t: X.Tables) -> DataFrame:
        E.register(t.spark)
        view = "files_in_one_pass"
        _files(t, _ONE).createOrReplaceTempView(view)
        return t.spark.sql(f"SELECT f.path, {', '.join('f.' + c for c in columns)} FROM {view} AS s, LATERAL facts_of_source(s.path, s.content, 'chunk,node,edge', '/s') AS f WHERE f.tag = '{kind}'")

    return build


_T, _B = "/s/P{k}/T{k}.cs", "/s/pkg/b{k}.py"
add("one_pass_chunks", _one_pass("chunk", "chunk_type", "title", "parent", "start_line", "end_line"), _rows_sql(("path", "chunk_type", "title", "parent", "start_line", "end_line"), [
    (_T, "class", "T{k}", None, 2, 6), (_T, "method", "T{k}.Help", "T{k}", 4, 4), (_T, "method", "T{k}.Shared", "T{k}", 5, 5), (_B, "class", "B{k}", None, 1, 6), (_B, "method", "B{k}.go", "B{k}", 3, 4), (_B, "method", "B{k}.step", "B{k}", 5, 6), (_B, "function", "helper", None, 9, 10),
]))
add("one_pass_nodes", _one_pass("node", "node_id", "node_type", "owner", "signature"), _rows_sql(("path", "node_id", "node_type", "owner", "signature"), [
    (_T, f"file|{_T}", "File", None, None), (_T, "Tools", "Namespace", "", "namespace Tools"), (_T, "Tools.T{k}", "Class", "Tools", "public class T{k}"), (_T, "Tools.T{k}.Help(int, int)", "Method", "Tools.T{k}", 'public string Help(int a, int b) => $"}"'),
    (_T, "Tools.T{k}.Shared()", "Method", "Tools.T{k}", "public static void Shared()"), (_B, f"file|{_B}", "File", None, None), (_B, "pkg.b{k}", "Namespace", None, None), (_B, "pkg.b{k}.B{k}", "Class", "pkg.b{k}", "class B{k}:"),
    (_B, "pkg.b{k}.B{k}.go(n)", "Method", "pkg.b{k}.B{k}", "def go(self, n):"), (_B, "pkg.b{k}.B{k}.step(n)", "Method", "pkg.b{k}.B{k}", "def step(self, n):"), (_B, "pkg.b{k}.helper(x)", "Method", "pkg.b{k}", "def helper(x):"),
]))
add("one_pass_edges", _one_pass("edge", "edge_type", "source_id", "target_id"), _rows_sql(("path", "edge_type", "source_id", "target_id"), [
    (_T, "Contains", f"file|{_T}", "Tools.T{k}"), (_T, "Declares", "Tools", "Tools.T{k}"), (_T, "Contains", "Tools.T{k}", "Tools.T{k}.Help(int, int)"), (_T, "Contains", "Tools.T{k}", "Tools.T{k}.Shared()"), (_B, "Contains", f"file|{_B}", "pkg.b{k}.B{k}"),
    (_B, "Declares", "pkg.b{k}", "pkg.b{k}.B{k}"), (_B, "Contains", "pkg.b{k}.B{k}", "pkg.b{k}.B{k}.go(n)"), (_B, "Contains", "pkg.b{k}.B{k}", "pkg.b{k}.B{k}.step(n)"), (_B, "Contains", f"file|{_B}", "pkg.b{k}.helper(x)"),
]))

# ---- runs in which files fail


def _raises_at(path: str, text: str) -> list[C.Chunk]:
    """Refuses texts of a word; else a chunk a line."""
    if "refuse" in text:
        raise ValueError(f"refused {path}")
    return [C.Chunk(x, "line", None, None, k, k) for k, x in enumerate(text.split("\n"), 1)]


def _failing(t: X.Tables) -> DataFrame:
    C.register_ingestor("raises_at", _raises_at, ("odd",))
    k = F.col("s_suppkey")
    text = F.when(k % 5 == 0, F.lit("one\nrefuse this")).when(k % 7 == 0, F.lit("  ")).when(k % 11 == 0, F.lit(None)).otherwise(F.concat(F.lit("a\nb\n"), "s_name"))
    return t.supplier.select(F.concat(F.lit("/r/f"), k.cast("string"), F.lit(".odd")).alias("path"), text.alias("content"))


_ODD = "SELECT *, '/r/f' || s_suppkey || '.odd' AS path, CASE WHEN s_suppkey % 5 = 0 THEN 'failed' WHEN s_suppkey % 7 = 0 OR s_suppkey % 11 = 0 THEN 'empty' ELSE 'indexed' END AS how FROM supplier"
add("ingest_errors", lambda t: C.index_run(_failing(t))[1], f"SELECT path, 'ValueError: refused ' || path AS error FROM ({_ODD}) WHERE how = 'failed'")
add("ingest_survivors", lambda t: C.index_run(_failing(t))[0].select("path", "chunk_index", "text"), f"SELECT path, unnest([0, 1, 2])::INTEGER AS chunk_index, unnest(['a', 'b', s_name]) AS text FROM ({_ODD}) WHERE how = 'indexed'")
add("index_run_summary", lambda t: C.index_run(_failing(t))[2],
    f"SELECT count(*) AS files, count(*) FILTER (how = 'indexed') AS indexed, count(*) FILTER (how = 'failed') AS failed, count(*) FILTER (how = 'empty') AS empty, 3 * count(*) FILTER (how = 'indexed') AS chunks, 'Completed' AS state FROM ({_ODD})")
