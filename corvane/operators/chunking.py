"""Chunkers: text to chunks by kind of content, as Arrow-batched table functions over (path, content).

Each is a fold over a file's lines or paragraphs, so a row's work is its own size and rows are independent. Blank
content gives no rows. Known oddities of the chunks are kept and named beside the code that makes them.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..batches import groups
from ..functions.paths import LANGUAGES, extension, relative_path
from ..shipping import ship_package
from ..storage import Stored
from . import scopes as S

SIZE, OVERLAP = 2000, 200
BLOCK, BLOCK_OVERLAP_LINES = 1500, 5
WHOLE_TYPE_BELOW = 2000
CODE_BLOCK_ABOVE = 50
SYMBOL_KINDS = ("class", "interface", "record", "struct", "enum", "method", "constructor", "property", "field", "event", "function")


@dataclass(frozen=True)
class Chunk:
    text: str
    chunk_type: str
    title: str | None = None
    language: str | None = None
    start_line: int | None = None
    end_line: int | None = None
    parent: str | None = None
    signature: str | None = None
    doc: str | None = None  # the first sentence of its documentation


def _joined(parts: list[str]) -> str:
    return "".join(f"{p}\n" for p in parts)


# ---- sizes: plain text, code and markdown as lists of texts


def _gather(paragraphs: list[str], size: int, tail: Callable[[str], str]) -> list[str]:
    """Paragraphs filled into chunks of about size; tail(chunk) opens the next one. A longer paragraph stays whole."""
    done, held = [], ""
    for p in paragraphs:
        if held and len(held) + len(p) > size:
            if chunk := held.strip():
                done.append(chunk)
            lead = tail(chunk)
            held = f"{lead}\n\n" if lead else ""
        held += f"{p}\n\n"
    return done + ([held.strip()] if held.strip() else [])


def _paragraphs(text: str) -> list[str]:
    return [p for p in re.split(r"\r\n\r\n|\n\n", text) if p]


def split_plain(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    return _gather(_paragraphs(text), size, lambda chunk: chunk[-overlap:] if overlap > 0 else "")


def split_markdown(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """A section per line that starts with a number sign, in fences too; long ones by paragraphs, without overlap."""
    starts = [m.start() for m in re.finditer(r"(?m)^#", text)]
    cuts = sorted({0, *starts, len(text)})
    sections = [s for a, b in zip(cuts, cuts[1:]) if (s := text[a:b].strip())]
    return [c for s in sections for c in ([s] if len(s) <= size else _gather([p for p in s.split("\n\n") if p], size, lambda _: ""))]


def _last_lines(text: str, limit: int) -> str:
    """Whole lines from the end, until they hold limit characters."""
    lines, held = text.split("\n"), 0
    at = len(lines)
    while at and held < limit:
        at -= 1
        held += len(lines[at]) + 1
    return "\n".join(lines[at:]).rstrip() if limit > 0 else ""


def split_code(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """Cuts where braces are balanced and size is reached. Oddity: the overlap has no line end, so the next line is glued to it."""
    done, held, n, depth = [], [], 0, 0
    for line in text.split("\n"):
        depth += line.count("{") - line.count("}")
        held.append(f"{line}\n")
        n += len(line) + 1
        if depth == 0 and n >= size:
            chunk = "".join(held).strip()
            done += [chunk] if chunk else []
            held = [_last_lines(chunk, overlap)] if chunk else []
            n = sum(map(len, held))
    rest = "".join(held).strip()
    return done + ([rest] if rest else [])


def split_text(text: str | None, content_type: str | None, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    if not text or not text.strip():
        return []
    return {"Code": split_code, "Markdown": split_markdown}.get(content_type or "", split_plain)(text, size, overlap)


# ---- ingestors: chunks with kinds, titles and lines


def _name(path: str) -> str:
    return re.split(r"[/\\]", path)[-1]


def _blocks(text: str, size: int = BLOCK, overlap_lines: int = BLOCK_OVERLAP_LINES) -> Iterator[tuple[str, int, int]]:
    """(text, first line, last line) of blocks of at least size characters; each next one repeats the last lines."""
    lines = [x.removesuffix("\r") for x in text.split("\n")]
    first = 0
    held = 0
    for k, line in enumerate(lines, 1):
        held += len(line) + 1
        if held >= size:
            yield _joined(lines[first:k]).strip(), first + 1, k
            first = max(0, k - overlap_lines)
            held = sum(len(x) + 1 for x in lines[first:k])
    if rest := _joined(lines[first:]).strip():
        yield rest, first + 1, len(lines)


def ingest_plain(path: str, text: str) -> list[Chunk]:
    """Blocks; a file of one is a document. The first of several is a block too."""
    found = list(_blocks(text))
    # A file that never fills a block is a document.
    if len(found) == 1 and len(_joined([x.removesuffix("\r") for x in text.split("\n")])) < BLOCK:
        return [Chunk(found[0][0], "document", _name(path), None, *found[0][1:])]
    return [Chunk(t, "block", f"{_name(path)} (part {k})", None, a, b) for k, (t, a, b) in enumerate(found, 1)]


def ingest_generic(path: str, text: str, language: str = "text") -> list[Chunk]:
    return [Chunk(t, "block", _name(path), language, a, b) for t, a, b in _blocks(text)]


_HEADING = re.compile(r"^(#{1,6})\s+(.+)$")


def ingest_markdown(path: str, text: str) -> list[Chunk]:
    """A section per heading outside fences, and a code-block for each long fence.

    Oddity: a section lacks its opening fences and has its closing fences twice.
    """
    out: list[Chunk] = []
    title, first, body = None, 1, []
    fence: list[str] | None = None
    fence_at, fence_language = 0, None
    lines = [x.removesuffix("\r") for x in text.split("\n")]
    for k, line in enumerate(lines, 1):
        if line.startswith("```"):
            if fence is None:
                fence, fence_at, fence_language = [], k, line[3:].strip() if len(line) > 3 else None
            else:
                code = _joined(fence).strip()
                if len(code) > CODE_BLOCK_ABOVE:
                    out.append(Chunk(code, "code-block", title, fence_language, fence_at, k))
                body += [line, line]
                fence = None
        elif fence is not None:
            fence.append(line)
            body.append(line)
        elif m := _HEADING.match(line):
            if section := _joined(body).strip():
                out.append(Chunk(section, "section", title, None, first, k - 1))
            title, first, body = m[2].strip(), k, [line]
        else:
            body.append(line)
    if section := _joined(body).strip():
        out.append(Chunk(section, "section", title, None, first, len(lines)))
    if not out and text.strip():
        out.append(Chunk(text.strip(), "document", _name(path).rsplit(".", 1)[0], None, 1, len(lines)))
    return out


_BRACE = re.compile(r"[{}]")


def braced(text: str, start: int) -> str | None:
    """From start to the brace that closes the first one after it; null if none does. Strings and comments count, unless they are blank already."""
    opening = text.find("{", start)
    depth = 0
    for m in _BRACE.finditer(text, opening) if opening >= 0 else ():
        depth += 1 if m[0] == "{" else -1
        if depth == 0:
            return text[start : m.end()]
    return None


def _head(text: str, belongs: Callable[[str], bool], passes: Callable[[str], bool] = lambda x: False) -> tuple[str, int]:
    """The lines at a file's start that belong to its head, and the last one's number; some may be passed over."""
    kept, last = [], 0
    for k, line in enumerate((x.removesuffix("\r") for x in text.split("\n")), 1):
        bare = line.lstrip()
        if belongs(bare):
            kept.append(line)
            last = k
        elif not passes(bare):
            break
    return _joined(kept).strip(), last


def _lines_of(text: str) -> Callable[[int], int]:
    """The line of a place in the text; its line ends are looked for once."""
    ends = [m.start() for m in re.finditer("\n", text)]
    return lambda at: bisect_left(ends, at) + 1


_COMMENT = ("//", "/*", "* ", "*/")
#: Declarations as the chunkers know them.
# A match may begin within a word only at a keyword, as otherwise the whole word makes it too; blanks and words are never given back, as no part after them could take one.
_CS_TYPE = re.compile(r"(?:public|private|protected|internal)?\s*+(?:static|sealed|abstract|partial)?\s*+(class|interface|record|struct|enum)\s++(\w++)")
_CS_METHOD = re.compile(
    r"(?:(?<!\w)|(?=\s)|(?=public|private|protected|internal|static|async|virtual|override|sealed))"
    r"(?:public|private|protected|internal)?\s*+(?:static|async|virtual|override|sealed)?\s*+(?:\w++(?:<[^>]+>)?)\s++(\w++)\s*+\([^)]*+\)\s*(?:where\s+\w+\s*:\s*[^{]+)?"
)
_TS_FUNCTION = re.compile(r"(?:export\s+)?(?:async\s+)?function\s+(\w+)\s*\([^)]*\)\s*(?::\s*[^{]+)?")
_TS_CLASS = re.compile(r"(?:export\s+)?class\s+(\w+)(?:\s+extends\s+\w+)?(?:\s+implements\s+[^{]+)?")
# Functions and classes in one pattern, as a block ends where the next of either begins.
_PY_BLOCK = re.compile(r"(?m)^(?:(def)\s+(\w+)\s*\([^)]*\)\s*(?:->\s*[^:]+)?:|(class)\s+(\w+)(?:\([^)]*\))?:)")


def ingest_csharp(path: str, text: str) -> list[Chunk]:
    """Head; types under 2000 characters whole, of longer ones their methods; blocks if that gives no more than one chunk."""
    out = []
    head, last = _head(text, lambda s: not s.strip() or s.startswith(("using ", "namespace ", "#", "[", *_COMMENT)))
    if head:
        out.append(Chunk(head, "header", "File Header", "csharp", 1, last))
    line_of = _lines_of(text)
    for m in _CS_TYPE.finditer(text):
        if (body := braced(text, m.end())) is None:
            continue
        whole, line = m[0] + body, line_of(m.start())
        if len(whole) < WHOLE_TYPE_BELOW:
            out.append(Chunk(whole, "type", f"{m[1]} {m[2]}", "csharp", line, line + body.count("\n")))
            continue
        inner_line = _lines_of(whole)
        for k in _CS_METHOD.finditer(whole):
            if (inner := braced(whole, k.end())) is not None:
                at = line + inner_line(k.start()) - 1
                out.append(Chunk(k[0] + inner, "method", f"{m[2]}.{k[1]}", "csharp", at, at + (k[0] + inner).count("\n")))
    return out if len(out) > 1 else ingest_generic(path, text, "csharp")


def ingest_typescript(path: str, text: str) -> list[Chunk]:
    """Imports, functions, classes; all called typescript, JavaScript too."""
    out = []
    head, last = _head(
        text, lambda s: not s.strip() or s.startswith(("import ", *_COMMENT)) or (s.startswith("export ") and " from " in s), lambda s: s.startswith("export ")
    )
    if head:
        out.append(Chunk(head, "imports", "Imports", "typescript", 1, last))
    line_of = _lines_of(text)
    for kind, pattern in (("function", _TS_FUNCTION), ("class", _TS_CLASS)):
        for m in pattern.finditer(text):
            if (body := braced(text, m.end())) is not None:
                line = line_of(m.start())
                out.append(Chunk(m[0] + body, kind, m[1], "typescript", line, line + (m[0] + body).count("\n")))
    return out if len(out) > 1 else ingest_generic(path, text, "typescript")


def ingest_python(path: str, text: str) -> list[Chunk]:
    """Imports, then each top-level def or class up to the next."""
    out = []
    head, last = _head(text, lambda s: not s.strip() or s.startswith(("import ", "from ", "#", '"""', "'''")))
    if head:
        out.append(Chunk(head, "imports", "Imports", "python", 1, last))
    found, line_of = list(_PY_BLOCK.finditer(text)), _lines_of(text)
    for m, end in zip(found, [*(m.start() for m in found[1:]), len(text)]):
        block, line = text[m.start() : end].rstrip(), line_of(m.start())
        out.append(Chunk(block, "function" if m[1] else "class", m[2] or m[4], "python", line, line + block.count("\n")))
    return out if len(out) > 1 else ingest_generic(path, text, "python")


def ingest_code(path: str, text: str) -> list[Chunk]:
    language = LANGUAGES.get(path.rsplit(".", 1)[-1].lower(), "text")
    by = {"csharp": ingest_csharp, "typescript": ingest_typescript, "javascript": ingest_typescript, "python": ingest_python}
    return by[language](path, text) if language in by else ingest_generic(path, text, language)


def _first_words(text: str, n: int = 5) -> str:
    return " ".join(text.split()[:n])


def ingest_paragraphs(path: str, text: str) -> list[Chunk]:
    """A chunk per paragraph, titled by its first words; line numbers allow one blank line between two."""
    out, line = [], 1
    for p in _paragraphs(text):
        if bare := p.strip():
            n = p.count("\n") + 1
            out.append(Chunk(bare, "section", _first_words(bare) or f"Section at line {line}", "text", line, line + n - 1))
            line += n + 1
    return out


def ingest_headed(path: str, text: str) -> list[Chunk]:
    """A chunk per heading, fences not regarded, with lines as they are."""
    lines = text.split("\n")
    heads = [k for k, x in enumerate(lines) if _HEADING.match(x)]
    cuts = sorted({0, *heads, len(lines)})
    titles = {k: _HEADING.match(lines[k])[2].strip() for k in heads}
    return [Chunk("\n".join(lines[a:b]), "section", titles.get(a) or f"Section at line {a + 1}", "text", a + 1, b) for a, b in zip(cuts, cuts[1:])]


def ingest_prose(path: str, text: str) -> list[Chunk]:
    return ingest_headed(path, text) if path.lower().endswith((".md", ".markdown")) else ingest_paragraphs(path, text)


def ingest_whole(path: str, text: str) -> list[Chunk]:
    return [Chunk(text, "file", _name(path), None, 1, text.count("\n") + 1)] if text.strip() else []


_MOD = r"(?:(?:public|private|protected|internal|static|abstract|final|sealed|open|data|override|virtual|async|suspend|inline|export|default|pub(?:\([^)]*\))?|unsafe|extern|const)\s+)*"
_C_LIKE = r"^(?:(?:class|struct|enum|union|namespace)\s+(\w+)|(?:[\w:<>,*&~]+\s+)+\**&?([\w:~]+)\s*\([^;]*$)"
#: Declarations by language for files without a chunker of their own: the first group that took part is the name.
_OUTLINES = {
    "rb": r"^\s*(?:def|class|module)\s+([\w.:?!]+)",
    "php": rf"^\s*{_MOD}(?:function|class|interface|trait)\s+(\w+)",
    "sh": r"^\s*(?:function\s+)?(\w+)\s*\(\)\s*\{",
    "kt": rf"^\s*{_MOD}(?:fun|class|interface|object)\s+(\w+)",
    "swift": rf"^\s*{_MOD}(?:func|class|struct|protocol|enum|extension)\s+(\w+)",
    "lua": r"^\s*(?:local\s+)?function\s+([\w.:]+)",
    "sql": r"(?i)^\s*create\s+(?:or\s+replace\s+)?(?:table|view|function|procedure)\s+([\w.]+)",
    "proto": r"^\s*(?:message|service|enum)\s+(\w+)",
    "scala": rf"^\s*{_MOD}(?:case\s+)?(?:def|class|object|trait)\s+(\w+)",
    "dart": rf"^\s*{_MOD}(?:class|mixin|enum|extension)\s+(\w+)",
    "groovy": rf"^\s*{_MOD}(?:def|class|interface|enum)\s+(\w+)",
    "ex": r"^\s*(?:defmodule|defp?|defmacro|defprotocol)\s+([\w.?!]+)",
    "erl": r"^([a-z]\w*)\s*\([^)]*\)\s*(?:when\b.*)?->",
    "hs": r"^(?:data|newtype|class|instance|type)\s+(\w+)|^([a-z]\w*)\s*::",
    "ml": r"^\s*(?:let(?:\s+rec)?|type|module)\s+(\w+)",
    "clj": r"^\s*\((?:defn-?|def|defmacro|defrecord|defprotocol|ns)\s+([^\s\[\]()]+)",
    "jl": r"^\s*(?:function|struct|mutable struct|module|macro)\s+([\w.!]+)",
    "r": r"^\s*([\w.]+)\s*(?:<-|=)\s*function\b",
    "pl": r"^\s*(?:sub|package)\s+([\w:]+)",
    "ps1": r"(?i)^\s*(?:function|filter|class)\s+([\w-]+)",
    "zig": rf"^\s*{_MOD}fn\s+(\w+)",
    "nim": r"^\s*(?:proc|func|method|template|macro|iterator)\s+(\w+)",
    "cr": r"^\s*(?:def|class|module|struct)\s+([\w.:?!]+)",
    "vb": r"(?i)^\s*(?:(?:public|private|friend|shared)\s+)*(?:sub|function|class|module|interface|structure)\s+(\w+)",
    "pas": r"(?i)^\s*(?:procedure|function|constructor|destructor)\s+([\w.]+)",
    "tf": r"^(?:resource|data)\s+\"[^\"]+\"\s+\"([^\"]+)\"|^(?:variable|module|output)\s+\"([^\"]+)\"",
    "sol": r"^\s*(?:contract|interface|library|function|event|struct|modifier)\s+(\w+)",
    "graphql": r"^\s*(?:type|input|enum|interface|scalar|union)\s+(\w+)",
    "m": _C_LIKE,
    "mm": _C_LIKE,
}
_OUTLINES |= {"bash": _OUTLINES["sh"], "kts": _OUTLINES["kt"], "exs": _OUTLINES["ex"], "cljs": _OUTLINES["clj"], "gql": _OUTLINES["graphql"], "pm": _OUTLINES["pl"], "rake": _OUTLINES["rb"]}
_IMPORT = re.compile(r"^\s*(?:import|use|using|require|require_relative|include|#include|#import|from|package|open|library|source|alias|\(:require)\b")
_REMARK = re.compile(r"^\s*(?://+!?|#+|--+|%+|;+|\*|/\*+)\s?(.*?)(?:\*/)?\s*$")


def _sentence(text: str) -> str | None:
    """The first sentence of a documentation."""
    flat = " ".join(text.split())
    m = re.match(r".*?[.!?](?=\s|$)", flat)
    return (m[0] if m else flat) or None


def ingest_outline(path: str, text: str) -> list[Chunk]:
    """Python by its syntax tree, with parents and first sentences of doc strings; Java, Go, Rust, C, C++, C# and JavaScript by their
    scopes; other languages by their declarations' first lines.

    There a declaration's parent is the nearest one above it that is indented less, its documentation the remarks right above it, and
    the imports at a file's head are a chunk of their own. Python files come here by the ingestor's name only.
    """
    ext = path.rsplit(".", 1)[-1].lower()
    if ext == "py":
        return _python_tree(path, text)
    if ext in S.SCOPED:
        return scope_chunks(text, S.facts(text, S.SCOPED[ext], S.module_of(path)), S.SCOPED[ext]) or ingest_whole(path, text)
    pattern = re.compile(_OUTLINES[ext]) if ext in _OUTLINES else None
    lines = text.split("\n")
    heads = [(k, next(g for g in m.groups() if g)) for k, x in enumerate(lines) if pattern and (m := pattern.match(x))]
    if not heads:
        return ingest_whole(path, text)
    out = []
    imports = [k for k in range(heads[0][0]) if _IMPORT.match(lines[k])]
    if imports:
        out.append(Chunk("\n".join(lines[imports[0] : imports[-1] + 1]), "imports", "Imports", ext, imports[0] + 1, imports[-1] + 1))
    ends = [k for k, _ in heads[1:]] + [len(lines)]
    above: list[tuple[int, str]] = []
    for (a, name), b in zip(heads, ends):
        indent = len(lines[a]) - len(lines[a].lstrip())
        while above and above[-1][0] >= indent:
            above.pop()
        remarks, k = [], a - 1
        while k >= 0 and (m := _REMARK.match(lines[k])):
            remarks.insert(0, m[1])
            k -= 1
        out.append(Chunk("\n".join(lines[a:b]).rstrip(), "declaration", name, ext, a + 1, b, above[-1][1] if above else None, lines[a].strip(), _sentence(" ".join(remarks))))
        above.append((indent, name))
    return out


def _remarks_above(lines: list[str], k: int) -> str:
    """What the remarks right above a line say, without marks and tags."""
    said: list[str] = []
    block = False
    while (k := k - 1) >= 0:
        bare = lines[k].strip()
        if block or bare.endswith("*/"):
            block = not bare.startswith("/*")
        elif not bare.startswith("//"):
            break
        said.insert(0, re.sub(r"^(?:/\*+!?|\*+/|\*|//[/!]*)\s?|\s*\*+/\s*$|</?\w[^>]*>", "", bare))
    return " ".join(x for x in said if x)


#: Declarations that are chunks; fields and properties belong to their type's.
_TREE_KINDS = (*S.TYPES, *S.CALLABLE, "type")


def scope_chunks(text: str, facts: S.Facts, language: str) -> list[Chunk]:
    """The imports of a file, and each type and callable of its tree of scopes with its parent, head and documentation."""
    lines, line_of, out = text.split("\n"), S.line_of(text), []
    if facts.head:
        a, b = facts.head
        out.append(Chunk(text[a:b].strip(), "imports", "Imports", language, line_of(a), line_of(b)))
    for d in facts.declared:
        if d.kind in _TREE_KINDS or d.kind == "namespace" and text[d.end - 1 : d.end] == "}":
            first = line_of(d.start)
            doc = d.doc or _remarks_above(lines, first - 1)
            title = f"{d.parent}.{d.name}" if d.parent else d.name
            out.append(Chunk(text[d.start : d.end], d.kind, title, language, first, line_of(max(d.start, d.end - 1)), d.parent, d.signature, _sentence(doc)))
    return out


def _python_tree(path: str, text: str) -> list[Chunk]:
    import ast

    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return ingest_python(path, text)
    lines, out = text.split("\n"), []

    def visit(node: ast.AST, parent: str | None) -> None:
        for n in ast.iter_child_nodes(node):
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                kind = "class" if isinstance(n, ast.ClassDef) else "method" if parent else "function"
                body = "\n".join(lines[n.lineno - 1 : n.end_lineno])
                out.append(Chunk(body, kind, f"{parent}.{n.name}" if parent else n.name, "python", n.lineno, n.end_lineno, parent, lines[n.lineno - 1].strip(), _sentence(ast.get_docstring(n) or "")))
                if isinstance(n, ast.ClassDef):
                    visit(n, n.name)

    visit(tree, None)
    return out or ingest_whole(path, text)


_ASSIGNED = re.compile(r"\s*=")
_CS_DOC = re.compile(r"\s*///\s?(.*)")
_CS_NAME = re.compile(r"([\w~]+)\s*(?:<[^>()]*>)?\s*$")
_CS_VARIABLE = re.compile(r"(\w+)\s*(?:=[^,;]*)?\s*[,;]")


def _doc_above(text: str, at: int) -> tuple[int, str]:
    """Where the documentation lines right above a place begin, and what they say without tags."""
    start, said = text.rfind("\n", 0, at) + 1, []
    while start and (m := _CS_DOC.fullmatch(text[(up := text.rfind("\n", 0, start - 1) + 1) : start - 1].rstrip("\r"))):
        said.insert(0, re.sub("<[^>]+>", "", m[1]))
        start = up
    return (start if said else at), " ".join(said)


def _members(body: str, code: str) -> Iterator[tuple[int, str]]:
    """(place, text) of what stands right inside the braces of a type: up to a semicolon, or to the brace that closes its own.

    Braces are those of code, where strings and comments are blank.
    """
    inside, depth, start = code.index("{") + 1, 0, None
    for m in re.finditer(r"[{};]", code[inside:-1]):
        at = inside + m.start()
        if start is None:
            start = inside
        depth += {"{": 1, "}": -1}.get(m[0], 0)
        if depth == 0 and (m[0] == ";" or m[0] == "}" and not _ASSIGNED.match(code, at + 1)):
            piece = body[start : at + 1]
            lead = len(piece) - len(piece.lstrip())
            if piece.strip(" ;\n\r\t"):
                yield start + lead, piece[lead:]
            start = at + 1


def ingest_members(path: str, text: str) -> list[Chunk]:
    """C# by types and members: a type's chunk is its documentation and declaration alone, members are whole, with theirs.

    Members are methods, constructors, properties, events and fields; a field of several variables gives a chunk for each.
    """
    out: list[Chunk] = []
    line_of = _lines_of(text)
    plain = S.blanked(text, "csharp")
    for m in _CS_TYPE.finditer(plain):
        if (code := braced(plain, m.end())) is None:
            continue
        body = text[m.end() : m.end() + len(code)]
        begin = m.start() + len(m[0]) - len(m[0].lstrip())
        top, said = _doc_above(text, begin)
        declared = text[top : m.end()] + body[: code.index("{")]
        signature = (m[0] + body[: code.index("{")]).strip()
        line = line_of(begin)
        out.append(Chunk(declared.strip(), m[1], m[2], "csharp", line, line_of(m.end() + len(body) - 1), None, signature, _sentence(said)))
        if m[1] == "enum":
            continue
        for at, piece in _members(body, code):
            remarks = re.match(r"(?:\s*(?://[^\n]*|\[[^\]\n]*\])\s*\n)*\s*", piece)
            bare = piece[remarks.end() :]
            said = " ".join(re.sub("<[^>]+>", "", x) for x in re.findall(r"///\s?(.*)", remarks[0]))
            head = re.split(r"[{;]|=>|(?<![=<>!])=(?!=)", bare, maxsplit=1)[0]
            if _CS_TYPE.match(bare) or not head.strip():
                continue  # a type within is found by itself
            first = m.end() + at
            lines = (line_of(first + remarks.end()), line_of(first + len(piece) - 1))
            if "(" in head:
                name = _CS_NAME.search(head[: head.index("(")])
                kind = "constructor" if name and name[1] == m[2] else "method"
                names = [name[1]] if name else []
            elif re.search(r"\bevent\b", head):
                kind, names = "event", [x[1]] if (x := _CS_NAME.search(head.strip())) else []
            elif "=>" in bare[: len(head) + 2] or bare[len(head) : len(head) + 1] == "{":
                kind, names = "property", [x[1]] if (x := _CS_NAME.search(head.strip())) else []
            else:
                kind, names = "field", _CS_VARIABLE.findall(re.sub(r"<[^<>]*>", "", bare))
            for name in names:
                out.append(Chunk(piece.strip(), kind, f"{m[2]}.{name}", "csharp", *lines, m[2], head.strip(), _sentence(said)))
    return out


#: Ingestors by name. Each takes (path, text).
INGESTORS: dict[str, Callable[[str, str], list[Chunk]]] = {
    "code": ingest_code,
    "markdown": ingest_markdown,
    "plaintext": ingest_plain,
    "prose": ingest_prose,
    "outline": ingest_outline,
    "members": ingest_members,
    "whole": ingest_whole,
}
_OUTLINED = tuple(_OUTLINES)
#: Ingestors that were registered for extensions, the latest first.
_REGISTERED: list[tuple[str, tuple[str, ...]]] = []


def register_ingestor(name: str, ingest: Callable[[str, str], list[Chunk]], extensions: tuple[str, ...] = ()) -> None:
    """Adds a table function (path, text) to chunks, to be used by `ingest` under this name, and first of all for files of these extensions."""
    INGESTORS[name] = ingest
    _REGISTERED[:] = [(n, e) for n, e in _REGISTERED if n != name]
    if extensions:
        _REGISTERED.insert(0, (name, tuple(e.lower().lstrip(".") for e in extensions)))


def route(path: Column) -> Column:
    """Ingestor of a file by its extension: a registered one, the latest first, then code, markdown, declarations; plain text for all else."""
    e = extension(path)
    chain = [*_REGISTERED, ("code", tuple(x for x in LANGUAGES if x != "cc")), ("markdown", ("md", "markdown")), ("outline", _OUTLINED)]
    return F.coalesce(*[F.when(e.isin(*extensions), F.lit(name)) for name, extensions in chain], F.lit("plaintext"))


_OUT = [
    ("text", pa.string()), ("chunk_type", pa.string()), ("title", pa.string()), ("language", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()),
    ("parent", pa.string()), ("signature", pa.string()), ("doc", pa.string()),
]


_INGESTED = "path string, chunk_index int, text string, chunk_type string, title string, language string, start_line int, end_line int, parent string, signature string, doc string"
#: The kind of a row that tells why a file gave no chunks.
FAILED = "error"


def ingest_or_fail(files: DataFrame, ingestor: str | None = None, path_col: str = "path", text_col: str = "content") -> DataFrame:
    """Chunks of files as `ingest` gives them, and for each file whose ingestor raised one row of type FAILED with the reason as text.

    What a file gave before it failed is left out, so a file is indexed as a whole or not at all. An ingestor that isn't known is the caller's error.
    """
    if ingestor is not None and ingestor not in INGESTORS:
        raise ValueError(f"no ingestor named {ingestor}")
    ship_package(files.sparkSession)
    how = F.lit(ingestor) if ingestor else route(F.col(path_col))
    known = dict(INGESTORS)
    schema = pa.schema([("path", pa.string()), ("chunk_index", pa.int32()), *_OUT])
    nothing = (None,) * (len(_OUT) - 2)

    def chunks(path: str, text: str, how: str) -> list[tuple]:
        try:
            return [(path, k, *vars(c).values()) for k, c in enumerate(known[how](path or "", text))]
        except Exception as e:  # whatever an ingestor raises is the file's own fault and no other's  # noqa: BLE001
            return [(path, -1, f"{type(e).__name__}: {e}", FAILED, *nothing)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in groups(whole):
                rows = [r for p, t, h in zip(*(b.column(k).to_pylist() for k in range(3))) if t and t.strip() for r in chunks(p, t, h)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    own = files.select(F.col(path_col).alias("path"), F.col(text_col).alias("content"), how.alias("how"))
    df = own.mapInArrow(run, _INGESTED)
    return df.withColumn("content_id", content_id(F.col("path"), F.col("chunk_type"), F.col("title"), F.col("start_line")))


def ingest(files: DataFrame, ingestor: str | None = None, path_col: str = "path", text_col: str = "content") -> DataFrame:
    """Chunks of files: (path, content_id, chunk_index, text, chunk_type, title, language, start_line, end_line, parent, signature, doc).

    Without an ingestor's name each file goes by its route. Null and blank contents give no rows, and neither do files whose ingestor
    raises, which end no run: `index_run` counts them and tells why.
    """
    return ingest_or_fail(files, ingestor, path_col, text_col).filter(F.col("chunk_type") != FAILED)


def index_run(files: DataFrame, ingestor: str | None = None, path_col: str = "path", text_col: str = "content") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks, errors, summary) of one run over files: errors are (path, error); the summary counts files, files without chunks, failures and chunks.

    The run's rows are written to the shared folder once, so each file is ingested once for all three. A run has failed if all files that
    have a text did, as the state of a job.
    """
    store = Stored(files.sparkSession, "index_run")
    rows = store.cut(ingest_or_fail(files, ingestor, path_col, text_col))
    chunks, failed = rows.filter(F.col("chunk_type") != FAILED), rows.filter(F.col("chunk_type") == FAILED)
    by = rows.agg(F.count_distinct(F.when(F.col("chunk_type") != FAILED, F.col("path"))).alias("indexed"), F.count_if(F.col("chunk_type") == FAILED).alias("failed"), F.count_if(F.col("chunk_type") != FAILED).alias("chunks"))
    total = files.agg(F.count(F.lit(1)).alias("files"))
    state = F.when((F.col("failed") > 0) & (F.col("indexed") == 0), "Failed").otherwise("Completed")
    # Both sides are one row.
    summary = total.join(F.broadcast(by)).select("files", "indexed", "failed", (F.col("files") - F.col("indexed") - F.col("failed")).alias("empty"), "chunks", state.alias("state"))
    return chunks, failed.select("path", F.col("text").alias("error")), summary


def tree_chunks(chunks: DataFrame, root: str) -> DataFrame:
    """Chunks of `ingest` as a tree reads them: (rel_path, chunk_type, symbol, parent, title, signature, content, start_line, end_line)."""
    symbol = F.when(F.col("chunk_type").isin(*SYMBOL_KINDS), F.substring_index("title", ".", -1))
    return chunks.select(
        relative_path(F.col("path"), F.lit(root)).alias("rel_path"), "chunk_type", symbol.alias("symbol"), "parent", "title", "signature", F.col("text").alias("content"), "start_line", "end_line"
    )


def content_id(path: Column, chunk_type: Column, symbol: Column, start_line: Column) -> Column:
    return F.concat_ws(":", path, chunk_type, F.coalesce(symbol, start_line.cast("string")))


def split_rows(df: DataFrame, text_col: str, type_col: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """df with one row per chunk of text_col, in `chunk` and `chunk_index`; blank texts give no rows."""
    ship_package(df.sparkSession)
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("array<string>")
    def parts(text, kind):  # noqa: ANN001, ANN202
        return text.combine(kind, lambda t, k: split_text(t, k, size, overlap))

    return df.select("*", F.posexplode(parts(F.col(text_col), F.col(type_col))).alias("chunk_index", "chunk"))


def paragraph_chunks(df: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """Paragraph chunks without Python: (keep..., chunk_index, text, title)."""
    parts = F.filter(F.transform(F.split(F.col(text_col), "\r\n\r\n|\n\n"), lambda p: F.btrim(p, F.lit(" \t\r\n"))), lambda p: p != "")
    df = df.select(*keep, F.posexplode(parts).alias("chunk_index", "text"))
    return df.withColumn("title", F.array_join(F.slice(F.filter(F.split("text", r"[ \n\r\t]+"), lambda w: w != ""), 1, 5), " "))


def hashing_embedding(text: Column, dimension: int = 64) -> Column:
    """A stand-in for a model: words' hashes counted by bucket, as a unit vector of floats. Deterministic and without Python."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{Nd}]+"), lambda w: w != "")
    hashed = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(dimension)).cast("int"))
    # A variable of a function over a one-element array is computed once, where a repeated expression would be computed anew.
    places = F.sequence(F.lit(0), F.lit(dimension - 1))
    counts = F.get(F.transform(F.array(hashed), lambda b: F.transform(places, lambda k: F.size(F.filter(b, lambda x: x == k)).cast("double"))), 0)
    unit = F.transform(
        F.array(F.struct(counts.alias("c"))), lambda s: F.transform(s["c"], lambda x: F.coalesce(F.try_divide(x, F.sqrt(F.aggregate(s["c"], F.lit(0.0), lambda n, y: n + y * y))), F.lit(0.0)).cast("float"))
    )
    return F.get(unit, 0)


def with_embeddings(df: DataFrame, text_col: str, model: Callable[[list[str]], list[list[float]]], limit: int = 30_000) -> DataFrame:
    """df with an `embedding` that a model makes of batches of texts, of their first characters up to a limit."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("array<float>")
    def embed(text):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series(model([(t or "")[:limit] for t in text]))

    return df.withColumn("embedding", embed(F.col(text_col)))
