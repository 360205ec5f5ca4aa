"""Texts by line: search, ranges and listings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import SKIPPED_FOLDERS
from ..functions.text import preview

MAX_HITS = 50


def hits(files: DataFrame, needle: str, path_col: str = "path", text_col: str = "content", any_case: bool = True) -> DataFrame:
    """(path, line_number, preview) of the lines that hold a literal text; hidden and built folders are left out."""
    p = F.col(path_col)
    skipped = reduce(lambda a, b: a | b, [F.contains(p, F.lit(f"/{d}/")) for d in SKIPPED_FOLDERS]) | p.rlike(r"/\.[^/]")
    def holds(text: str) -> Column:
        return F.contains(F.lower(text), F.lit(needle.lower())) if any_case else F.contains(text, F.lit(needle))

    # Whole texts first, so that only those with a hit are cut into lines.
    own = files.filter(~F.coalesce(skipped, F.lit(False))).filter(holds(text_col))
    rows = own.select(p.alias("path"), F.posexplode(F.split(text_col, "\n")).alias("k", "line"))
    hit = holds("line")
    return rows.filter(hit).select("path", (F.col("k") + 1).alias("line_number"), preview(F.col("line")).alias("preview"))


def grep(files: DataFrame, needle: str, limit: int = MAX_HITS, **how) -> DataFrame:  # noqa: ANN003
    """The first hits by path and line."""
    return hits(files, needle, **how).orderBy("path", "line_number").limit(limit)


def capped(rows: DataFrame, order: list[Column | str], cap: int) -> DataFrame:
    """At most cap rows, and in `truncated` whether there are as many."""
    first = rows.orderBy(*order).limit(cap)
    n = first.agg((F.count(F.lit(1)) >= cap).alias("truncated"))
    return first.join(F.broadcast(n))  # one row


def line_range(text: Column, start: int, end: int) -> Column:
    """Lines start to end, from 0 and without the last."""
    return F.array_join(F.slice(F.split(text, "\n"), start + 1, max(0, end - start)), "\n")


def list_files(files: DataFrame, matches: Column, cap: int, path_col: str = "path") -> DataFrame:
    return files.filter(matches).select(path_col).orderBy(path_col).limit(cap)
