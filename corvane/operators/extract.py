"""Chunks, nodes, edges and references of source files in one pass: a polymorphic table function with tagged rows.

`facts_of_source(path, content, outputs, root)` parses a file once and emits rows of the kinds that `outputs` names. Its schema depends on that
constant: only the columns that those kinds have. In SQL it stands in a lateral join, after `register`:

    SELECT f.* FROM files, LATERAL facts_of_source(files.path, files.content, 'node,edge', '/src') AS f

A file that can't be parsed, or in a language without scopes, gives one row of kind `error`, whatever the outputs, and ends no run.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..shipping import ship_package
from . import chunking as C
from . import scopes as S

#: Columns of each kind of rows. Kinds share columns of one name.
KINDS = {
    "chunk": "chunk_type string, title string, language string, start_line int, end_line int, parent string, signature string, doc string, text string",
    "node": "node_id string, node_type string, name string, full_name string, owner string, language string, start_line int, signature string, modifiers string, takes int, least int",
    "edge": "edge_type string, source_id string, target_id string",
    "ref": "relation string, source_id string, scope string, owner string, target string, name string, own boolean, args int, language string, start_line int",
    "import": "name string, target string",
    "error": "name string, text string",
}
_TYPES = {"string": StringType(), "int": IntegerType(), "boolean": BooleanType()}
_KEYS = "tag string, path string, ord int"
_NODE_TYPES = {
    "namespace": "Namespace", "class": "Class", "interface": "Interface", "trait": "Interface", "record": "Record", "struct": "Struct", "type": "Struct", "enum": "Enum",
    "method": "Method", "function": "Method", "constructor": "Constructor", "property": "Property", "field": "Field", "event": "Event",
}


def columns(outputs: str) -> dict[str, str]:
    """Names and types of the columns of these kinds."""
    kinds = [k for k in KINDS if k in [x.strip() for x in outputs.split(",")] or k == "error"]
    return dict(c.split() for k in (_KEYS, *(KINDS[k] for k in kinds)) for c in k.split(", "))


def _file_facts(path: str, text: str, outputs: set[str], root: str) -> Iterator[dict]:
    extension = path.rsplit(".", 1)[-1].lower()
    language = S.SCOPED[extension]
    module = S.module_of(path, root)
    found = S.facts(text, language, module)
    line_of = S.line_of(text)
    if "chunk" in outputs:
        yield from ({"tag": "chunk", **vars(c)} for c in C.scope_chunks(text, found, language))
    file_id = f"file|{path}"
    ids = [d.full_name for d in found.declared]
    owners = {d.qualified for d in found.declared if d.kind in S.TYPES}
    spaces = {d.qualified for d in found.declared if d.kind == "namespace"} | ({module} if language == "python" and module else set())
    if "node" in outputs:
        yield {"tag": "node", "node_id": file_id, "node_type": "File", "name": path.rsplit("/", 1)[-1], "full_name": path, "start_line": 1, "language": language}
        if language == "python" and module:
            yield {"tag": "node", "node_id": module, "node_type": "Namespace", "name": module.rsplit(".", 1)[-1], "full_name": module, "start_line": 1, "language": language}
        for d, i in zip(found.declared, ids):
            if kind := _NODE_TYPES.get(d.kind):
                yield {
                    "tag": "node", "node_id": i, "node_type": kind, "name": d.name.rsplit(".", 1)[-1] if kind == "Namespace" else d.name, "full_name": i, "owner": d.scope, "language": language,
                    "start_line": line_of(d.start), "signature": d.signature, "modifiers": d.modifiers, "takes": 99 if any(t.startswith(("params ", "...", "*")) for t in d.takes) else len(d.takes), "least": d.least,
                }
    if "edge" in outputs:
        for d, i in zip(found.declared, ids):
            if d.kind in S.TYPES and d.kind != "impl" or d.kind == "type":
                # A type is contained by its file; the namespace around declares it.
                yield {"tag": "edge", "edge_type": "Contains", "source_id": file_id, "target_id": i}
                if d.scope in spaces:
                    yield {"tag": "edge", "edge_type": "Declares", "source_id": d.scope, "target_id": i}
            elif d.kind not in ("namespace", "impl"):
                yield {"tag": "edge", "edge_type": "Contains", "source_id": d.scope if d.scope in owners or d.parent else file_id, "target_id": i}
    if "ref" in outputs:
        for r in found.references:
            d = found.declared[r.source]
            yield {
                "tag": "ref", "relation": r.relation, "source_id": ids[r.source], "scope": d.scope if r.relation != "base" else d.scope, "owner": d.scope if d.parent else None, "target": r.target, "name": r.name, "own": r.own,
                "args": r.args, "language": language, "start_line": line_of(r.at),
            }
    if "import" in outputs:
        yield from ({"tag": "import", "name": i.name, "target": i.target} for i in found.imports)


class FactsOfSource:
    """The table function. Its analysis gives the columns of the kinds that are asked for."""

    @staticmethod
    def analyze(path: AnalyzeArgument, content: AnalyzeArgument, outputs: AnalyzeArgument, root: AnalyzeArgument) -> AnalyzeResult:
        if not outputs.isConstantExpression or outputs.value is None:
            raise ValueError("outputs must be a constant list of kinds")
        asked = {x.strip() for x in outputs.value.split(",")}
        if unknown := asked - set(KINDS):
            raise ValueError(f"unknown kinds {sorted(unknown)}; there are {sorted(KINDS)}")
        return AnalyzeResult(schema=StructType([StructField(c, _TYPES[t]) for c, t in columns(outputs.value).items()]))

    def eval(self, path: str, content: str, outputs: str, root: str) -> Iterator[tuple]:
        names = list(columns(outputs))
        if not content or not content.strip():
            return
        try:
            rows = list(_file_facts(path, content, {x.strip() for x in outputs.split(",")}, root or ""))
        except Exception as e:  # a file's own fault  # noqa: BLE001
            rows = [{"tag": "error", "name": type(e).__name__, "text": str(e)}]
        for k, r in enumerate(rows):
            yield tuple(path if c == "path" else k if c == "ord" else r.get(c) for c in names)


def _function(spark: SparkSession):  # noqa: ANN202
    ship_package(spark)
    return F.udtf(FactsOfSource)


def register(spark: SparkSession, name: str = "facts_of_source") -> None:
    """Makes the table function known to SQL."""
    spark.udtf.register(name, _function(spark))


def source_facts(files: DataFrame, outputs: str, root: str = "", path_col: str = "path", text_col: str = "content") -> DataFrame:
    """Tagged rows of these kinds for all files, by one Python stage."""
    own = files.select(F.col(path_col).alias("__path"), F.col(text_col).alias("__content"))
    found = _function(files.sparkSession)(F.col("__path").outer(), F.col("__content").outer(), F.lit(outputs), F.lit(root))
    return own.lateralJoin(found).drop("__path", "__content")


def split_by_kind(facts: DataFrame, kind: str) -> DataFrame:
    """The rows of one kind, with its own columns."""
    own = [c.split()[0] for c in KINDS[kind].split(", ")]
    return facts.filter(F.col("tag") == kind).select("path", "ord", *own)
