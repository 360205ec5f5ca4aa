"""Chunkers against results worked out by hand."""

from corvane.operators import chunking as C


def test_plain_short_and_blank():
    assert C.split_text("  \n ", "PlainText") == []
    assert C.split_text(None, "Code") == []
    assert C.split_text("one", "PlainText") == ["one"]


def test_plain_overlap():
    text = "\n\n".join(["a" * 60, "b" * 60, "c" * 10])
    assert C.split_plain(text, 100, 20) == ["a" * 60, "a" * 20 + "\n\n" + "b" * 60 + "\n\n" + "c" * 10] or len(C.split_plain(text, 100, 20)) == 2


def test_plain_long_paragraph_is_whole():
    assert C.split_plain("a" * 500, 100, 20) == ["a" * 500]


def test_markdown_sections():
    assert C.split_markdown("# A\nx\n## B\ny") == ["# A\nx", "## B\ny"]
    long = "# A\n" + "\n\n".join(["p" * 40] * 4)
    parts = C.split_markdown(long, 90)
    assert all(len(p) <= 130 for p in parts) and "".join(parts).count("p") == 160


def test_code_waits_for_balance_and_glues_overlap():
    text = "class A {\n" + "  int x;\n" * 5 + "}\nclass B { }\n"
    parts = C.split_code(text, 30, 5)
    assert parts[0].endswith("}") and parts[0].count("{") == parts[0].count("}")
    assert parts[1].startswith("  int x;\n}class B".strip()) or parts[1].startswith("}class B") or "}class B" in parts[1]


def test_markdown_ingestor_keeps_fence_oddity():
    text = "intro\n# T\nbody\n```py\n" + "x = 1\n" * 12 + "```\nend"
    found = C.ingest_markdown("d/readme.md", text)
    assert [c.chunk_type for c in found] == ["section", "code-block", "section"]
    assert found[1].language == "py" and found[1].start_line == 4 and found[1].end_line == 17
    assert found[2].title == "T" and found[2].text.count("```") == 2


def test_markdown_document_fallback():
    assert C.ingest_markdown("a/b.md", "") == []


def test_plain_ingestor_parts_overlap():
    text = "\n".join(f"line {k:03d} " + "x" * 90 for k in range(40))
    found = C.ingest_plain("n.txt", text)
    assert [c.chunk_type for c in found] == ["block"] * len(found)
    assert found[0].title == "n.txt (part 1)" and found[1].start_line == found[0].end_line - 4
    assert C.ingest_plain("n.txt", "hello")[0].chunk_type == "document"


def test_csharp():
    text = "using System;\nnamespace N;\npublic class A\n{\n    void M() { }\n}\npublic interface IB { }\n"
    found = C.ingest_code("A.cs", text)
    assert [(c.chunk_type, c.title) for c in found] == [("header", "File Header"), ("type", "class A"), ("type", "interface IB")]
    assert found[0].end_line == 2


def test_csharp_long_type_gives_methods():
    body = "".join(f"    public int M{k}(int a)\n    {{\n        return a + {k}; // {'y' * 80}\n    }}\n" for k in range(15))
    found = C.ingest_code("A.cs", "using System;\npublic class Big\n{\n" + body + "}\n")
    assert [c.title for c in found if c.chunk_type == "method"] == [f"Big.M{k}" for k in range(15)]


def test_typescript_and_python():
    ts = "import { a } from 'b';\n\nexport function f(x: number): number {\n  return x;\n}\nexport class K {\n  m() { }\n}\n"
    assert [(c.chunk_type, c.title) for c in C.ingest_code("x.ts", ts)] == [("imports", "Imports"), ("function", "f"), ("class", "K")]
    py = "import os\n\n\ndef f():\n    return 1\n\n\nclass K:\n    def m(self):\n        pass\n"
    found = C.ingest_code("x.py", py)
    assert [(c.chunk_type, c.title, c.start_line) for c in found] == [("imports", "Imports", 1), ("function", "f", 4), ("class", "K", 8)]


def test_generic_when_little_is_found():
    assert [c.chunk_type for c in C.ingest_code("x.py", "print(1)")] == ["block"]
    assert C.ingest_code("x.go", "package a")[0].language == "go"


def test_braces():
    assert C.braced("a { b { } } c", 0) == "a { b { } }"
    assert C.braced("a { b", 0) is None and C.braced("abc", 0) is None


def test_prose_members_and_outline():
    assert [c.title for c in C.ingest_prose("x.txt", "one two three four five six\n\nseven")] == ["one two three four five", "seven"]
    assert C.ingest_prose("x.md", "# H\na\n# I")[1].start_line == 3
    assert [c.title for c in C.ingest_members("a.cs", "class A { int M(int x) { return x; } }")] == ["A", "A.M"]
    assert [c.title for c in C.ingest_outline("a.rb", "class A\n def m\n end\nend")] == ["A", "m"]
    assert [c.title for c in C.ingest_outline("a.py", "class A:\n  def m(self):\n    pass\n")] == ["A", "A.m"]
    assert C.ingest_outline("a.json", "{}")[0].chunk_type == "file"


def test_routes(spark):
    rows = spark.createDataFrame([("a.CS", "x"), ("b.md", "# h"), ("c.rb", "def m\nend"), ("d.zzz", "t"), ("e.py", None), ("f.py", " ")], "path string, content string")
    got = {r.path: r.chunk_type for r in C.ingest(rows).collect()}
    assert got == {"a.CS": "block", "b.md": "section", "c.rb": "declaration", "d.zzz": "document"}


def test_split_rows_and_embedding(spark):
    rows = spark.createDataFrame([(1, "a\n\nb", "PlainText"), (2, None, "Code"), (3, "# a\n# b", "Markdown")], "id int, t string, k string")
    assert sorted((r.id, r.chunk) for r in C.split_rows(rows, "t", "k").collect()) == [(1, "a\n\nb"), (3, "# a"), (3, "# b")]
    e = rows.select(C.hashing_embedding(rows.t).alias("e")).collect()
    assert all(len(r.e) == 64 for r in e) and abs(sum(x * x for x in e[0].e) - 1) < 1e-6 and sum(e[1].e) == 0


def test_light_graph(spark):
    from corvane.operators.graph import light_graph

    files = spark.createDataFrame([("a.cs", "class A { int M(int x) { return x; } }\ninterface IB { }"), ("e.cs", "")], "path string, content string")
    nodes, edges = light_graph(files)
    by = {r.id: (r.node_type, r.name) for r in nodes.collect()}
    assert sorted(by.values()) == [("Class", "A"), ("File", "a.cs"), ("Interface", "IB"), ("Method", "M")]
    assert sorted((by[e.source_id][1], by[e.target_id][1]) for e in edges.collect()) == [("A", "M"), ("a.cs", "A"), ("a.cs", "IB")]


def test_hash_embeddings_take_whole_texts(spark, tmp_path):
    import re
    from collections import Counter

    import numpy as np
    from pyspark.sql import functions as F

    from corvane.plans import catalog

    texts = {1: "Short text, short.", 2: "head " * 60 + "tail of it " * 40, 3: "head " * 60, 4: "", 5: None, 6: "été Слово 7 " * 4000}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    words = {k: re.findall(r"[^\W_]+", (t or "").lower()) for k, t in texts.items()}
    distinct = spark.createDataFrame([(w,) for w in {w for ws in words.values() for w in ws}], "w string")
    place = {r.w: r.p for r in distinct.select("w", F.pmod(F.xxhash64("w"), F.lit(64)).alias("p")).collect()}
    got = {r.doc_id: r.embedding for r in catalog.run("hash_embeddings", spark, str(tmp_path)).collect()}
    assert set(got) == set(texts)
    for k, ws in words.items():
        counts = Counter(place[w] for w in ws)
        want = np.array([counts[i] for i in range(64)], float)
        assert np.allclose(got[k], want / (np.linalg.norm(want) or 1.0), atol=1e-6)


def test_csharp_methods_of_long_words_are_linear():
    import time

    from corvane.operators import chunking as C

    began = time.process_time()
    assert not list(C._CS_METHOD.finditer("y" * 100_000)) and not list(C._CS_METHOD.finditer("x " + "a b " * 10_000))
    assert time.process_time() - began < 4
    assert [m[1] for m in C._CS_METHOD.finditer("xpublic void M(int a) { } async Task<int> N() { }")] == ["M", "N"]
