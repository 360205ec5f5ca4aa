"""Queries over an extracted symbol table: (name, kind, return_type, attributes array<string>, first_parameter, is_static, file_path, line_number)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import base_type, preview
from .lines import capped

USAGE_CAP, LIST_CAP = 50, 100


def _ordered(df: DataFrame, cap: int) -> DataFrame:
    return capped(df, ["file_path", "line_number", "name"], cap)


def usages(files: DataFrame, symbol: str, cap: int = USAGE_CAP) -> DataFrame:
    """(path, line_number, preview, truncated) of the lines that hold a symbol as a whole word."""
    rows = files.filter(F.contains("content", F.lit(symbol))).select("path", F.posexplode(F.split("content", "\n")).alias("k", "line")).filter(F.col("line").rlike(rf"(?U)\b\Q{symbol}\E\b"))
    return capped(rows.select("path", (F.col("k") + 1).alias("line_number"), preview(F.col("line"), 200).alias("preview")), ["path", "line_number"], cap)


def references(symbols: DataFrame, files: DataFrame, name: str, cap: int = USAGE_CAP) -> DataFrame:
    """`usages` of a known symbol without the lines that declare it, each with whether its file declares the symbol; none of a name that no symbol has."""
    own = symbols.filter(F.col("name") == name).select(F.col("file_path").alias("path"), "line_number").distinct()
    rows = files.filter(F.contains("content", F.lit(name))).select("path", F.posexplode(F.split("content", "\n")).alias("k", "line"))
    rows = rows.filter(F.col("line").rlike(rf"(?U)\b\Q{name}\E\b")).select("path", (F.col("k") + 1).alias("line_number"), preview(F.col("line"), 200).alias("preview"))
    there = own.limit(1).select(F.lit(True).alias("is_symbol"))
    rows = rows.join(own, ["path", "line_number"], "left_anti").join(F.broadcast(there)).drop("is_symbol")  # one row
    declares = own.select("path").distinct().withColumn("in_declaring_file", F.lit(True))
    rows = rows.join(declares, "path", "left").withColumn("in_declaring_file", F.coalesce("in_declaring_file", F.lit(False)))
    return capped(rows, ["path", "line_number"], cap)


def by_attribute(symbols: DataFrame, attribute: str, cap: int = LIST_CAP) -> DataFrame:
    bare = attribute.lower().removesuffix("attribute")
    return _ordered(symbols.filter(F.exists("attributes", lambda a: F.contains(F.lower(a), F.lit(bare)))), cap)


def extension_methods(symbols: DataFrame, type_name: str, cap: int = LIST_CAP) -> DataFrame:
    return _ordered(symbols.filter(F.col("is_static") & (F.col("kind") == "Method") & (F.lower(base_type(F.col("first_parameter"))) == type_name.lower())), cap)


def by_return_type(symbols: DataFrame, type_name: str, cap: int = LIST_CAP) -> DataFrame:
    return _ordered(symbols.filter(F.contains(F.lower("return_type"), F.lit(type_name.lower()))), cap)


def list_types(symbols: DataFrame, namespace: str | None = None, name: str | None = None, kinds: list[str] | None = None, cap: int = LIST_CAP) -> DataFrame:
    df = symbols.filter(F.col("kind").isin(kinds or ["Class", "Interface", "Record", "Struct", "Enum"]))
    for column, part in (("namespace", namespace), ("name", name)):
        if part:
            df = df.filter(F.contains(F.lower(column), F.lit(part.lower())))
    return _ordered(df, cap)
