"""Queries over source files, papers and feeds that are made from the tables, so that SQL knows every chunk from the rows they are made of."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixtures as X
from ..functions import text as T
from ..operators import chunking as C
from ..operators import graph as G
from ..sources import research as RS
from .base import add


def _filled(template: str, **values: Column) -> Column:
    """The template with `{name}` replaced by columns."""
    out = F.lit(template)
    for name, c in values.items():
        out = F.replace(out, F.lit(f"{{{name}}}"), c.cast("string"))
    return out


def _filled_sql(template: str, **values: str) -> str:
    out = "'" + template.replace("'", "''") + "'"
    for name, c in values.items():
        out = f"replace({out}, '{{{name}}}', ({c})::VARCHAR)"
    return out


_SHOWN = ("path", "chunk_index", "content_id", "chunk_type", "title", "language", "start_line", "end_line")


def _shown(df: DataFrame, *more: str) -> DataFrame:
    return df.select(*_SHOWN, *more, F.sha2("text", 256).alias("sha"))


def _files(t: X.Tables, template: str, ext: str) -> DataFrame:
    """One file per supplier."""
    k = F.col("s_suppkey")
    return t.supplier.select(F.concat(F.lit("/src/f"), k.cast("string"), F.lit(f".{ext}")).alias("path"), _filled(template, k=k, name=F.col("s_name")).alias("content"))


def _expected(ext: str, *chunks: tuple[str, str | None, str | None, int, int, str]) -> str:
    """SQL of the chunks (type, title, language, first line, last line, text) of each supplier's file."""
    rows = []
    for i, (kind, title, language, a, b, text) in enumerate(chunks):
        values = {"k": "s_suppkey", "name": "s_name"}
        shown = _filled_sql(title, **values) if title is not None else "NULL::VARCHAR"
        lang = f"'{language}'" if language else "NULL::VARCHAR"
        rows.append(
            f"SELECT path, {i} AS chunk_index, path || ':{kind}:' || coalesce({shown}, '{a}') AS content_id, '{kind}' AS chunk_type, {shown} AS title, {lang} AS language, "
            f"{a} AS start_line, {b} AS end_line, sha256({_filled_sql(text, **values)}) AS sha FROM f"
        )
    return f"WITH f AS (SELECT *, '/src/f' || s_suppkey || '.{ext}' AS path FROM supplier) " + " UNION ALL ".join(rows)


def _add_chunks(name: str, ext: str, template: str, chunks: list[tuple], ingestor: str | None = None) -> None:
    add(name, lambda t: _shown(C.ingest(_files(t, template, ext), ingestor)), _expected(ext, *chunks))


# ---- splitters of texts by size

_BLOCK = "class K{k} {\n  int a = {k};\n}"


def _grouped(t: X.Tables, part: Column, joint: str, size: int = 20) -> DataFrame:
    """(f, content): so many customers' parts in a file, in order of their keys."""
    rows = t.customer.select(F.floor(F.col("c_custkey") / size).cast("long").alias("f"), "c_custkey", part.alias("part")).groupBy("f")
    return rows.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("c_custkey", "part"))), lambda x: x["part"]), joint).alias("content"))


def _split(kind: str, size: int, overlap: int, part: Callable[[], Column], joint: str):  # noqa: ANN202
    return lambda t: C.split_rows(_grouped(t, part(), joint).withColumn("kind", F.lit(kind)), "content", "kind", size, overlap).select("f", "chunk_index", "chunk")


_N = "n AS (SELECT c_custkey // 20 AS f, c_custkey AS k, (row_number() OVER (PARTITION BY c_custkey // 20 ORDER BY c_custkey) - 1)::INTEGER AS i FROM customer)"
# The overlap of a line without its end is glued to the next line, and what is left of it at the end is a chunk.
add("split_code", _split("Code", 1, 1, lambda: _filled(_BLOCK, k=F.col("c_custkey")), "\n"),
    f"WITH {_N} SELECT f, i AS chunk_index, CASE WHEN i > 0 THEN '}}' ELSE '' END || {_filled_sql(_BLOCK, k='k')} AS chunk FROM n UNION ALL SELECT f, max(i) + 1, '}}' FROM n GROUP BY f")


def _paragraph() -> Column:
    return F.rpad(F.concat(F.lit("p"), F.col("c_custkey").cast("string"), F.lit("-")), 50, "xy")


def _section() -> Column:
    long = F.concat(F.lit("## "), F.col("c_name"), F.lit("\n"), _paragraph(), F.lit("\n\n"), _paragraph())
    return F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("## "), F.col("c_name"), F.lit("\nshort"))).otherwise(long)


add("split_plain", _split("PlainText", 60, 10, _paragraph, "\n\n"),
    f"WITH {_N}, p AS (SELECT *, 'p' || k || '-' AS h FROM n), q AS (SELECT f, i, h || substr(repeat('xy', 25), 1, 50 - length(h)) AS x FROM p) "
    "SELECT f, i AS chunk_index, CASE WHEN i > 0 THEN right(lag(x) OVER (PARTITION BY f ORDER BY i), 10) || chr(10) || chr(10) ELSE '' END || x AS chunk FROM q")  # fmt: skip
add("split_markdown", _split("Markdown", 60, 10, _section, "\n"),
    """WITH c AS (SELECT c_custkey // 20 AS f, c_custkey AS k, c_name, 'p' || c_custkey || '-' AS h FROM customer), p AS (SELECT *, h || substr(repeat('xy', 25), 1, 50 - length(h)) AS x FROM c),
    s AS (SELECT f, k, 0 AS j, '## ' || c_name || chr(10) || CASE WHEN k % 2 = 0 THEN 'short' ELSE x END AS chunk FROM p UNION ALL SELECT f, k, 1, x FROM p WHERE k % 2 = 1)
    SELECT f, (row_number() OVER (PARTITION BY f ORDER BY k, j) - 1)::INTEGER AS chunk_index, chunk FROM s""")  # fmt: skip

# ---- ingestors

_MD = "intro {k}\n# Title {k}\nbody of {name}\n```py\nx = {k} + 1000000\ny = {k} + 1000000\nz = {k} + 1000000\nw = {k} + 1000000\n```\nend {k}"
_CODE = "x = {k} + 1000000\ny = {k} + 1000000\nz = {k} + 1000000\nw = {k} + 1000000"
_add_chunks("ingest_markdown", "md", _MD, [
    ("section", None, None, 1, 1, "intro {k}"), ("code-block", "Title {k}", "py", 4, 9, _CODE), ("section", "Title {k}", None, 2, 10, "# Title {k}\nbody of {name}\n" + _CODE + "\n```\n```\nend {k}"),
])
_METHODS = "".join(f"    public int M{j}(int a)\n    {{\n        return a + {{k}} + {j}; // {'y' * 80}\n    }}\n" for j in range(20))
_CS = "using System;\nusing X.Y;\n\nnamespace N{k};\npublic class S{k}\n{\n    int M() { return {k}; }\n}\npublic class B{k}\n{\n" + _METHODS + "}"
_add_chunks("ingest_csharp", "cs", _CS, [
    ("header", "File Header", "csharp", 1, 4, "using System;\nusing X.Y;\n\nnamespace N{k};"), ("type", "class S{k}", "csharp", 5, 8, "public class S{k}\n{\n    int M() { return {k}; }\n}"),
    *[("method", f"B{{k}}.M{j}", "csharp", 11 + 4 * j, 14 + 4 * j, f"public int M{j}(int a)\n    {{\n        return a + {{k}} + {j}; // {'y' * 80}\n    }}") for j in range(20)],
])
_TS = "import { a } from 'b';\n\nexport function f{k}(x: number): number {\n  return x + {k};\n}\nexport class K{k} {\n  m() { return {k}; }\n}\n"
for _ext in ("ts", "js"):  # JavaScript goes by the same name
    _add_chunks(f"ingest_{_ext}", _ext, _TS, [
        ("imports", "Imports", "typescript", 1, 2, "import { a } from 'b';"), ("function", "f{k}", "typescript", 3, 5, "export function f{k}(x: number): number {\n  return x + {k};\n}"),
        ("class", "K{k}", "typescript", 6, 8, "export class K{k} {\n  m() { return {k}; }\n}"),
    ])
_PY = "import os\n\n\ndef f{k}(x):\n    return x + {k}\n\n\nclass K{k}:\n    def m(self):\n        return {k}\n"
_add_chunks("ingest_python", "py", _PY, [
    ("imports", "Imports", "python", 1, 3, "import os"), ("function", "f{k}", "python", 4, 5, "def f{k}(x):\n    return x + {k}"), ("class", "K{k}", "python", 8, 10, "class K{k}:\n    def m(self):\n        return {k}"),
])
_add_chunks("ingest_whole", "json", '{"a": {k}}\n', [("file", "f{k}.json", None, 1, 2, '{"a": {k}}\n')], "whole")
_add_chunks("ingest_prose", "txt", "one two three four five six {k}\n\n{name}\nsecond line\n\n\n\nlast", [
    ("section", "one two three four five", "text", 1, 1, "one two three four five six {k}"), ("section", "{name} second line", "text", 3, 4, "{name}\nsecond line"), ("section", "last", "text", 6, 6, "last"),
], "prose")


def _lined(ext: str):  # noqa: ANN202
    """Files of 5 to 64 lines of 99 characters."""

    def build(t: X.Tables) -> DataFrame:
        k = F.col("c_custkey")
        lines = F.transform(F.sequence(F.lit(1), (k % 60 + 5).cast("int")), lambda i: F.rpad(F.concat(k.cast("string"), F.lit(":"), i.cast("string"), F.lit(" ")), 99, "z"))
        files = t.customer.select(F.concat(F.lit("/src/c"), k.cast("string"), F.lit(f".{ext}")).alias("path"), F.array_join(lines, "\n").alias("content"))
        return _shown(C.ingest(files))

    return build


def _lined_sql(ext: str, title: str, language: str) -> str:
    """Blocks of 15 lines of 100 characters, of which each next one repeats 5; what is left is a block too."""
    return f"""WITH c AS (SELECT '/src/c' || c_custkey || '.{ext}' AS path, 'c' || c_custkey || '.{ext}' AS name, c_custkey AS k, c_custkey % 60 + 5 AS n FROM customer),
    b AS (SELECT *, CASE WHEN n < 15 THEN 0 ELSE (n - 15) // 10 + 1 END AS whole FROM c), j AS (SELECT *, unnest(range(0, whole + 1)) AS j FROM b),
    s AS (SELECT *, 10 * j + 1 AS a, CASE WHEN j < whole THEN 10 * j + 15 ELSE n END AS z FROM j), x AS (SELECT *, {title} AS title, {language} AS language, CASE WHEN '{ext}' = 'txt' AND whole = 0 THEN 'document' ELSE 'block' END AS chunk_type FROM s)
    SELECT path, j::INTEGER AS chunk_index, path || ':' || chunk_type || ':' || title AS content_id, chunk_type, title, language, a::INTEGER AS start_line, z::INTEGER AS end_line,
      sha256(array_to_string(list_transform(range(a, z + 1), lambda i: rpad(k || ':' || i || ' ', 99, 'z')), chr(10))) AS sha FROM x"""


add("ingest_plain", _lined("txt"), _lined_sql("txt", "CASE WHEN whole = 0 THEN name ELSE name || ' (part ' || (j + 1) || ')' END", "NULL::VARCHAR"))
add("ingest_generic", _lined("go"), _lined_sql("go", "name", "'go'"))

_DOCUMENTED = (
    "/// <summary>Type number {k}. More of it.</summary>\npublic class T{k} : IBase\n{\n    private int a{k}, b{k} = 2;\n    public string Name { get; set; }\n    public T{k}(int x)\n    {\n        a{k} = x;\n    }\n"
    "    /// <summary>Runs it. Well.</summary>\n    public int Run(int x) { return x + {k}; }\n    public event Action Done;\n}\n"
)
_HEAD = "/// <summary>Type number {k}. More of it.</summary>\npublic class T{k} : IBase"
_FIELD, _CTOR = "private int a{k}, b{k} = 2;", "public T{k}(int x)\n    {\n        a{k} = x;\n    }"
#: (type, title, lines, parent, signature, documentation, text) of what ingest_members makes of it.
_MEMBERS = [
    ("class", "T{k}", 2, 13, None, "public class T{k} : IBase", "Type number {k}.", _HEAD), ("field", "T{k}.a{k}", 4, 4, "T{k}", "private int a{k}, b{k}", None, _FIELD), ("field", "T{k}.b{k}", 4, 4, "T{k}", "private int a{k}, b{k}", None, _FIELD),
    ("property", "T{k}.Name", 5, 5, "T{k}", "public string Name", None, "public string Name { get; set; }"), ("constructor", "T{k}.T{k}", 6, 9, "T{k}", "public T{k}(int x)", None, _CTOR),
    ("method", "T{k}.Run", 11, 11, "T{k}", "public int Run(int x)", "Runs it.", "/// <summary>Runs it. Well.</summary>\n    public int Run(int x) { return x + {k}; }"),
    ("event", "T{k}.Done", 12, 12, "T{k}", "public event Action Done", None, "public event Action Done;"),
]


def _declared_sql(ext: str, rows: list[tuple]) -> str:
    sql = lambda x: "NULL::VARCHAR" if x is None else _filled_sql(x, k="s_suppkey")
    parts = [f"SELECT path, {i} AS chunk_index, '{r[0]}' AS chunk_type, {sql(r[1])} AS title, {r[2]} AS start_line, {r[3]} AS end_line, {sql(r[4])} AS parent, {sql(r[5])} AS signature, {sql(r[6])} AS doc, sha256({sql(r[7])}) AS sha FROM f" for i, r in enumerate(rows)]
    return f"WITH f AS (SELECT *, '/src/f' || s_suppkey || '.{ext}' AS path FROM supplier) " + " UNION ALL ".join(parts)


def _declared(template: str, ext: str, ingestor: str):  # noqa: ANN202
    columns = ("path", "chunk_index", "chunk_type", "title", "start_line", "end_line", "parent", "signature", "doc")
    return lambda t: C.ingest(_files(t, template, ext), ingestor).select(*columns, F.sha2("text", 256).alias("sha"))


add("ingest_members", _declared(_DOCUMENTED, "cs", "members"), _declared_sql("cs", _MEMBERS))
_RUBY = "require 'json'\nrequire 'set'\n\n# Talks of {k}. And more.\nclass A{k}\n  # Does it.\n  def run\n    {k}\n  end\nend\n\ndef free{k}\n  1\nend\n"
add("ingest_outline", _declared(_RUBY, "rb", "outline"), _declared_sql("rb", [
    ("imports", "Imports", 1, 2, None, None, None, "require 'json'\nrequire 'set'"), ("declaration", "A{k}", 5, 6, None, "class A{k}", "Talks of {k}.", "class A{k}\n  # Does it."),
    ("declaration", "run", 7, 11, "A{k}", "def run", "Does it.", "  def run\n    {k}\n  end\nend"), ("declaration", "free{k}", 12, 15, None, "def free{k}", None, "def free{k}\n  1\nend"),
]))
_TREE_PY = 'class A{k}:\n    """Type of {k}. More."""\n    def m(self):\n        return {k}\n\ndef f():\n    pass\n'
add("ingest_python_tree", _declared(_TREE_PY, "py", "outline"), _declared_sql("py", [
    ("class", "A{k}", 1, 4, None, "class A{k}:", "Type of {k}.", 'class A{k}:\n    """Type of {k}. More."""\n    def m(self):\n        return {k}'), ("method", "A{k}.m", 3, 4, "A{k}", "def m(self):", None, "    def m(self):\n        return {k}"),
    ("function", "f", 6, 7, None, "def f():", None, "def f():\n    pass"),
]))
add("light_graph_nodes", lambda t: G.light_graph(_files(t, _DOCUMENTED, "cs"))[0].select("node_type", "name", "full_name", "file_path", "line_number"),
    "WITH f AS (SELECT *, '/src/f' || s_suppkey || '.cs' AS path FROM supplier) SELECT 'File' AS node_type, 'f' || s_suppkey || '.cs' AS name, NULL::VARCHAR AS full_name, path AS file_path, 1 AS line_number FROM f UNION ALL "
    + " UNION ALL ".join(f"SELECT '{r[0].capitalize()}', {_filled_sql(r[1].split('.')[-1], k='s_suppkey')}, {_filled_sql(r[1], k='s_suppkey')}, path, {r[2]} FROM f" for r in _MEMBERS if r[1] != "T{k}.a{k}"))


def _light_edges(t: X.Tables) -> DataFrame:
    n, e = G.light_graph(_files(t, _DOCUMENTED, "cs"))
    a, b = (n.select(F.col("id").alias(f"{x}_id"), F.coalesce("full_name", "name").alias(x)) for x in ("source", "target"))
    return e.join(a, "source_id").join(b, "target_id").select("edge_type", "source", "target")


add("light_graph_edges", _light_edges, "SELECT 'Contains' AS edge_type, 'f' || s_suppkey || '.cs' AS source, 'T' || s_suppkey AS target FROM supplier UNION ALL "
    + " UNION ALL ".join(f"SELECT 'Contains', 'T' || s_suppkey, {_filled_sql(r[1], k='s_suppkey')} FROM supplier" for r in _MEMBERS[2:]))


def _routed(t: X.Tables) -> DataFrame:
    """A registered ingestor takes its extensions first; of two for one extension the later."""
    C.register_ingestor("older", lambda path, text: [C.Chunk("never", "older")], ("loud",))
    C.register_ingestor("louder", lambda path, text: [C.Chunk(text.upper(), "shouted")], ("loud", "adoc"))
    ext = F.element_at(F.array(*map(F.lit, ["loud", "ADOC", "cs", "md", "rb", "zzz", "txt", "none"])), (F.col("s_suppkey") % 8 + 1).cast("int"))
    path = F.concat(F.lit("/r/"), F.col("s_suppkey").cast("string"), F.when(ext == "none", "").otherwise(F.concat(F.lit("."), ext)))
    return C.ingest(t.supplier.select(path.alias("path"), F.col("s_name").alias("content"))).select("path", "chunk_type", "text")


add("routed_files", _routed,
    """WITH e AS (SELECT *, ['loud', 'ADOC', 'cs', 'md', 'rb', 'zzz', 'txt', ''][s_suppkey % 8 + 1] AS ext FROM supplier) SELECT '/r/' || s_suppkey || CASE WHEN ext = '' THEN '' ELSE '.' || ext END AS path,
    CASE ext WHEN 'loud' THEN 'shouted' WHEN 'ADOC' THEN 'shouted' WHEN 'cs' THEN 'block' WHEN 'md' THEN 'section' WHEN 'rb' THEN 'file' ELSE 'document' END AS chunk_type, CASE WHEN ext IN ('loud', 'ADOC') THEN upper(s_name) ELSE s_name END AS text FROM e""")  # fmt: skip
add("model_embeddings", lambda t: C.with_embeddings(t.documents.select("doc_id", "text"), "text", lambda texts: [[float(len(x)), float(x.count("e"))] for x in texts]).select("doc_id", F.get("embedding", 0).alias("n"), F.get("embedding", 1).alias("e")),
    "SELECT doc_id, length(substr(coalesce(text, ''), 1, 30000))::FLOAT AS n, (length(substr(coalesce(text, ''), 1, 30000)) - length(replace(substr(coalesce(text, ''), 1, 30000), 'e', '')))::FLOAT AS e FROM documents")
add("type_references", lambda t: t.part.select("p_partkey", F.array_join(T.type_references(F.when(F.col("p_size") % 5 == 0, F.array(F.lit("int"), F.lit("string[]?"))).otherwise(F.array(F.concat("p_brand", F.lit("<int>?")), F.lit("String"), F.col("p_brand"), F.concat(F.lit("Foo"), F.col("p_size").cast("string"), F.lit("[]")), F.lit("")))), ",").alias("types")),
    "SELECT p_partkey, CASE WHEN p_size % 5 > 0 THEN p_brand || ',Foo' || p_size END AS types FROM part")

# ---- papers, feeds and pages

_PAPER = (
    "arXiv:2401.{id}v2\nA Study of {name} in Practice\nAuthors: Ann Lee{k}, Bob Ray and Cy & Dee {k}\nAbstract\nWe look at {type}\nin detail.\n\n1 Introduction\nText of {brand}.\n2.1 Second Part of {k}\nFigure 1: A plot of {brand}\nin two lines\n\n"
    "3 Third Thing\x0cx\n4.1.2.1 Fourth Level\nBibliography\n[1] First of {name}, doi 10.1234/abc{k}\n[2] Second\nref {brand}\n"
)
_OF_PART = {"k": "p_partkey", "id": "lpad(p_partkey::VARCHAR, 5, '0')", "name": "p_name", "type": "p_type", "brand": "p_brand"}


def _papers(t: X.Tables) -> DataFrame:
    values = {"k": F.col("p_partkey"), "id": F.lpad(F.col("p_partkey").cast("string"), 5, "0"), "name": F.col("p_name"), "type": F.col("p_type"), "brand": F.col("p_brand")}
    return t.part.select("p_partkey", _filled(_PAPER, **values).alias("text"), F.when(F.col("p_partkey") % 3 == 0, F.lit(" Own ")).alias("meta"))


def _p(template: str) -> str:
    return _filled_sql(template, **_OF_PART)


add("pdf_head", lambda t: _papers(t).select("p_partkey", T.pdf_title(F.col("text"), F.col("meta")).alias("title"), F.array_join(T.pdf_authors(F.col("text")), ";").alias("authors"), T.pdf_abstract(F.col("text")).alias("abstract"), T.arxiv_id(F.col("text")).alias("arxiv"), F.array_join(T.pdf_dois(F.col("text")), ";").alias("dois")),
    f"SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'Own' ELSE {_p('A Study of {name} in Practice')} END AS title, {_p('Ann Lee{k};Bob Ray;Dee {k}')} AS authors, {_p('We look at {type} in detail.')} AS abstract, {_p('2401.{id}')} AS arxiv, {_p('10.1234/abc{k}')} AS dois FROM part")
add("pdf_name_lists", lambda t: t.part.select("p_partkey", F.array_join(T.pdf_authors(F.concat(F.lit("Title of it\n"), F.when(F.col("p_partkey") % 2 == 0, F.lit("Ann Lee, Bob Ray , Cyd Foe et al")).otherwise(F.lit("one name")), F.lit("\nend"))), ";").alias("authors")), "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'Ann Lee;Bob Ray;Cyd Foe' ELSE '' END AS authors FROM part")
add("pdf_sections", lambda t: _papers(t).select("p_partkey", F.explode(T.pdf_sections(F.col("text"))).alias("s")).select("p_partkey", "s.*"),
    " UNION ALL ".join(f"SELECT p_partkey, {line} AS line, {page} AS page, '{number}' AS number, {level} AS level, {_p(title)} AS title FROM part" for line, page, number, level, title in ((8, 1, "1", 1, "Introduction"), (10, 1, "2.1", 2, "Second Part of {k}"), (14, 2, "3", 1, "Third Thing\x0cx"), (15, 2, "4.1.2.1", 3, "Fourth Level"))))
add("pdf_citations", lambda t: _papers(t).select("p_partkey", F.explode(T.pdf_citations(F.col("text"))).alias("c")).select("p_partkey", "c.*"),
    f"SELECT p_partkey, 1 AS number, {_p('First of {name}, doi 10.1234/abc{k}')} AS text, {_p('10.1234/abc{k}')} AS doi FROM part UNION ALL SELECT p_partkey, 2, replace({_p('Second@ref {brand}')}, '@', chr(10)), NULL FROM part")
add("pdf_figures", lambda t: _papers(t).select("p_partkey", F.explode(T.pdf_figures(F.col("text"))).alias("f")).select("p_partkey", "f.*"), f"SELECT p_partkey, 1 AS number, replace({_p('A plot of {brand}@in two lines')}, '@', chr(10)) AS caption FROM part")
_BODY = (
    "arXiv:2401.{id}v2\nA Study of {name} in Practice\nAuthors: Ann Lee{k}, Bob Ray and Cy & Dee {k}\n\n## 1 Introduction\n\nText of {brand}.\n\n### 2.1 Second Part of {k}\n\nFigure 1: A plot of {brand}\nin two lines\n\n"
    "## 3 Third Thing\x0cx\n\n##### 4.1.2.1 Fourth Level\n\nBibliography\n[1] First of {name}, doi 10.1234/abc{k}\n[2] Second\nref {brand}"
)
add("pdf_markdown", lambda t: _papers(t).select("p_partkey", F.sha2(T.pdf_markdown(F.col("text")), 256).alias("sha")), f"SELECT p_partkey, sha256({_p(_BODY)}) AS sha FROM part")
_WHOLE = (
    '---\ntitle: "A Study of {name} in Practice"\nauthors: ["Ann Lee{k}", "Bob Ray", "Dee {k}"]\n---\n\n# A Study of {name} in Practice\n\n**Authors:** Ann Lee{k}, Bob Ray, Dee {k}\n\n## Abstract\n\nWe look at {type} in detail.\n\n---\n\n'
    + _BODY + "\n\n---\n\n## Figures\n\n> **figure-1**: A plot of {brand}\nin two lines\n> *See original PDF*\n\n"
)
add("pdf_document", lambda t: _papers(t).select("p_partkey", F.sha2(T.pdf_document(F.col("text")), 256).alias("sha")), f"SELECT p_partkey, sha256({_p(_WHOLE)}) AS sha FROM part")

_ATOM = "<feed><entry><id>http://arxiv.org/abs/2401.{id}v1</id><title>On\n  {k}</title><summary> About  {k}. </summary><published>20{y}-01-02</published><author><name>A{k}</name></author><author><name>B</name></author></entry></feed>"


def _atom(t: X.Tables) -> DataFrame:
    k = F.col("s_suppkey")
    return t.supplier.select(_filled(_ATOM, k=k, id=F.lpad(k.cast("string"), 5, "0"), y=F.lpad((k % 24).cast("string"), 2, "0")).alias("payload"))


add("atom_sources", lambda t: RS.from_atom(_atom(t)).select("source_id", "source_type", "title", F.array_join("authors", ",").alias("authors"), "abstract", "url", "year"),
    "SELECT '2401.' || lpad(s_suppkey::VARCHAR, 5, '0') AS source_id, 'arxiv' AS source_type, 'On ' || s_suppkey AS title, 'A' || s_suppkey || ',B' AS authors, 'About ' || s_suppkey || '.' AS abstract, 'http://arxiv.org/abs/2401.' || lpad(s_suppkey::VARCHAR, 5, '0') || 'v1' AS url, (2000 + s_suppkey % 24)::INTEGER AS year FROM supplier")
_JSON = '{"data":[{"paperId":"p{k}","title":"On {k}","year":20{y},"citationCount":{k},"authors":[{"name":"A{k}"}],"externalIds":{"DOI":"10.1/{k}"}},{"paperId":"q{k}","title":"No more"}]}'


def _paper_json(t: X.Tables) -> DataFrame:
    k = F.col("s_suppkey")
    good = _filled(_JSON, k=k, y=F.lpad((k % 24).cast("string"), 2, "0"))
    return t.supplier.select(F.when(k % 4 == 3, F.lit("{broken")).otherwise(good).alias("payload"))


add("paper_sources", lambda t: RS.from_paper_json(_paper_json(t)).select("source_id", "title", F.array_join("authors", ",").alias("authors"), "doi", "year", "citation_count"),
    "WITH s AS (SELECT * FROM supplier WHERE s_suppkey % 4 <> 3) SELECT 'p' || s_suppkey AS source_id, 'On ' || s_suppkey AS title, 'A' || s_suppkey AS authors, '10.1/' || s_suppkey AS doi, (2000 + s_suppkey % 24)::INTEGER AS year, s_suppkey::INTEGER AS citation_count FROM s UNION ALL SELECT 'q' || s_suppkey, 'No more', NULL, NULL, NULL, NULL FROM s")
_PAGE = "<html><head><title> Page {k} &amp; more </title>{author}</head><body><script>var a = '<b>';</script><p>Hello <b>{name}</b>&nbsp;of {k}</p></body></html>"


def _pages(t: X.Tables) -> DataFrame:
    k = F.col("s_suppkey")
    author = F.when(k % 2 == 0, F.concat(F.lit('<meta name="author" content="A'), k.cast("string"), F.lit('">'))).otherwise(F.lit(""))
    return t.supplier.select(F.concat(F.lit("https://x.org/"), k.cast("string")).alias("url"), _filled(_PAGE, k=k, name=F.col("s_name"), author=author).alias("html"))


add("page_sources", lambda t: RS.from_pages(_pages(t)).select("source_id", "source_type", "title", F.array_join("authors", ",").alias("authors"), "abstract", "url"),
    "SELECT sha256('https://x.org/' || s_suppkey) AS source_id, 'web' AS source_type, 'Page ' || s_suppkey || ' & more' AS title, CASE WHEN s_suppkey % 2 = 0 THEN 'A' || s_suppkey ELSE '' END AS authors, 'Page ' || s_suppkey || ' & more Hello ' || s_name || ' of ' || s_suppkey AS abstract, 'https://x.org/' || s_suppkey AS url FROM supplier")
