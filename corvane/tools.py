"""Named queries with typed parameters, listed with their schemas and called by JSON arguments."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import MISSING, dataclass, fields
from typing import Any, get_type_hints

from pyspark.sql import DataFrame, SparkSession

_KINDS = {str: "string", int: "integer", float: "number", bool: "boolean", list[str]: "array"}


@dataclass(frozen=True)
class Tool:
    """run takes the session and an instance of parameters, a dataclass of str, int, float, bool and list[str]."""

    name: str
    description: str
    parameters: type
    run: Callable[[SparkSession, Any], DataFrame]

    def schema(self) -> dict:
        hints = get_type_hints(self.parameters)
        props = {f.name: {"type": _KINDS[hints[f.name]]} for f in fields(self.parameters)}
        return {"type": "object", "properties": props, "required": [f.name for f in fields(self.parameters) if f.default is MISSING and f.default_factory is MISSING]}

    def arguments(self, text: str) -> Any:
        """Parameters out of a JSON object; what is missing, unknown or of another type is an error."""
        given = json.loads(text or "{}")
        hints = get_type_hints(self.parameters)
        if unknown := sorted(set(given) - set(hints)):
            raise ValueError(f"{self.name} has no parameter {', '.join(unknown)}")
        for name, value in given.items():
            want = hints[name]
            ok = isinstance(value, list) and all(isinstance(x, str) for x in value) if want == list[str] else type(value) is want or (want is float and type(value) is int)
            if not ok:
                raise ValueError(f"{name} of {self.name} is {_KINDS[want]}")
        if missing := [n for n in self.schema()["required"] if n not in given]:
            raise ValueError(f"{self.name} needs {', '.join(missing)}")
        return self.parameters(**given)


TOOLS: dict[str, Tool] = {}


def register(tool: Tool) -> None:
    TOOLS[tool.name] = tool


def listing(spark: SparkSession) -> DataFrame:
    """(name, description, parameters) of the registered tools; parameters as a JSON schema."""
    rows = [(t.name, t.description, json.dumps(t.schema())) for t in sorted(TOOLS.values(), key=lambda t: t.name)]
    return spark.createDataFrame(rows, "name string, description string, parameters string")


def call(spark: SparkSession, name: str, arguments: str = "{}") -> DataFrame:
    if name not in TOOLS:
        raise ValueError(f"no tool named {name}")
    tool = TOOLS[name]
    return tool.run(spark, tool.arguments(arguments))
