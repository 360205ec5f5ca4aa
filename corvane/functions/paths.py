"""Paths, workspace ids, globs and file types as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The language of a file extension.
LANGUAGES = {
    "cs": "csharp", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "py": "python",
    "rs": "rust", "go": "go", "java": "java", "cpp": "cpp", "cc": "cpp", "hpp": "cpp", "c": "c", "h": "c", "fs": "fsharp", "fsx": "fsharp",
}
#: Extensions that count as code, and those of the other content types.
CODE_EXTENSIONS = ("cs", "ts", "tsx", "js", "jsx", "py", "rs", "go", "java", "cpp", "c", "h")
CONTENT_TYPES = {"md": "Markdown", "markdown": "Markdown", "txt": "PlainText", "pdf": "Documentation"}
#: What an alias of a content type stands for; None is no restriction.
CONTENT_ALIASES = {"code": ["Code"], "docs": ["Documentation", "Markdown", "PlainText"], "config": ["PlainText"], "all": None}
#: Folders that no listing enters.
SKIPPED_FOLDERS = ("node_modules", "bin", "obj", ".git")


def normalize_path(path: Column) -> Column:
    """Forward slashes, lower case, single slashes but for those after a scheme."""
    slashed = F.lower(F.replace(F.replace(path, F.lit("\\\\"), F.lit("/")), F.lit("\\"), F.lit("/")))
    at = F.instr(slashed, "://")
    scheme = F.substring(slashed, F.lit(1), at + 2)
    rest = F.substring(slashed, at + 3, F.length(slashed))
    return F.when(at > 1, F.concat(scheme, F.regexp_replace(rest, "/+", "/"))).otherwise(F.regexp_replace(slashed, "/+", "/"))


def workspace_id(path: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the normalised path; null for a blank path."""
    return F.when(F.trim(path) != "", F.substring(F.sha2(normalize_path(path), 256), 1, 16))


def is_workspace_id(value: Column) -> Column:
    return F.coalesce(value.rlike("^[0-9a-f]{16}$"), F.lit(False))


def file_name(path: Column) -> Column:
    return F.substring_index(F.substring_index(path, "/", -1), "\\", -1)


def folder(path: Column) -> Column:
    """What stands before the last slash; empty for a bare name."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def extension(path: Column) -> Column:
    """Lower-case extension without its dot, or empty."""
    return F.lower(F.regexp_extract(file_name(path), r"\.([^.]*)$", 1))


def _lookup(key: Column, table: dict[str, str], default: Column) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), default)


def content_type(path: Column) -> Column:
    table = {e: "Code" for e in CODE_EXTENSIONS} | CONTENT_TYPES
    return _lookup(extension(path), table, F.lit("Unknown"))


def language(path: Column) -> Column:
    """Language of a source file by its extension; null for none."""
    return _lookup(extension(path), LANGUAGES, F.lit(None).cast("string"))


def relative_path(path: Column, root: Column) -> Column:
    """path without root and the slash after it, where it starts with root in any case."""
    return F.when(F.startswith(F.lower(path), F.lower(root)), F.substring(path, F.length(root) + 2, F.length(path))).otherwise(path)


def translate_root(path: Column, old: Column, new: Column) -> Column:
    """path under new where it stood under old, as for the files of a second checkout."""
    under = F.startswith(normalize_path(path), normalize_path(old))
    return F.when(under, F.concat(new, F.substring(path, F.length(old) + 1, F.length(path)))).otherwise(path)


def matches_include(path: Column, pattern: str) -> Column:
    """`*.ext` by its suffix, anything else by the file's name; in any case."""
    if pattern.startswith("*."):
        return F.endswith(F.lower(path), F.lit(pattern[1:].lower()))
    return F.lower(file_name(path)) == pattern.lower()


def matches_glob(path: Column, pattern: str) -> Column:
    """A small glob language, in any case: `**/d/**` is a folder anywhere, `*.e` a suffix, all else a literal part.

    After `**/` the rest is literal, stars included, so `**/*.dll` finds nothing in practice; that is kept.
    """
    p = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    g = pattern.replace("\\", "/").lower()
    if g.startswith("**/") and g.endswith("/**"):
        return F.contains(p, F.lit(f"/{g[3:-3]}/"))
    if g.startswith("**/"):
        return F.contains(p, F.lit(g[3:]))
    if g.startswith("*."):
        return F.endswith(p, F.lit(g[1:]))
    return F.contains(p, F.lit(g))


def matches_any(path: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [matches_glob(path, p) for p in patterns], F.lit(False))


def should_include(path: Column, include: list[str], exclude: list[str]) -> Column:
    """Excluded paths are out; of the others, those that match an include pattern, or all if there is none."""
    return ~matches_any(path, exclude) & (matches_any(path, include) if include else F.lit(True))


def is_prioritized(path: Column, wanted: list[str]) -> Column:
    """File name, path end or folder entry that equals one of the wanted, in any case."""
    if not wanted:
        return F.lit(False)
    low, name = F.lower(path), F.lower(file_name(path))
    return F.coalesce(
        F.exists(
            F.array(*[F.lit(w.lower()) for w in wanted]),
            lambda w: (name == w) | F.endswith(low, w) | F.contains(low, F.concat(F.lit("/"), w)) | F.contains(low, F.concat(F.lit("\\"), w)),
        ),
        F.lit(False),
    )
