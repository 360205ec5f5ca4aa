"""Analytics of tool-call traces: (trace_id, seq, tool_name, path, result), in order within a trace by the columns given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tools that ask an index, that read or search files, and that edit.
SEMANTIC_TOOLS = ("search_code", "navigate", "inspect", "tree", "docs")
FILE_TOOLS = ("file_read", "file_list", "grep", "glob")
EDIT_TOOLS = ("file_edit", "file_write", "refactor", "generate")
FISHING_RUN = 5


def is_semantic(tool: Column) -> Column:
    return tool.isin(*SEMANTIC_TOOLS)


def is_file_level(tool: Column) -> Column:
    return tool.isin(*FILE_TOOLS)


def is_edit(tool: Column) -> Column:
    return tool.isin(*EDIT_TOOLS)


def is_success(result: Column) -> Column:
    """Not blank, no error, nothing `not found`, and more than ten characters."""
    low = F.lower(F.trim(result))
    return F.coalesce((low != "") & ~F.startswith(low, F.lit("error")) & ~F.contains(low, F.lit("not found")) & (F.length(low) > 10), F.lit(False))


def _order(order: list[str]):  # noqa: ANN202
    return Window.partitionBy("trace_id").orderBy(*order)


def semantic_ratio(trace: DataFrame) -> DataFrame:
    """Share of semantic calls among semantic and file-level ones, 0 without any, half to even at three places."""
    s, f = F.count_if(is_semantic(F.col("tool_name"))), F.count_if(is_file_level(F.col("tool_name")))
    df = trace.groupBy("trace_id").agg(s.alias("semantic"), f.alias("file_level"))
    return df.withColumn("ratio", _ratio())


def _ratio() -> Column:
    total = F.col("semantic") + F.col("file_level")
    return F.when(total > 0, F.bround(F.col("semantic") / total, 3)).otherwise(F.lit(0.0))


def fishing(trace: DataFrame, order: list[str], run: int = FISHING_RUN) -> DataFrame:
    """Traces with a run of file-level calls without a semantic one between; other tools neither count nor end it."""
    island = F.sum(is_semantic(F.col("tool_name")).cast("int")).over(_order(order).rowsBetween(Window.unboundedPreceding, 0))
    df = trace.withColumn("island", island).groupBy("trace_id", "island").agg(F.count_if(is_file_level(F.col("tool_name"))).alias("n"))
    return df.groupBy("trace_id").agg(F.max("n").alias("longest_run")).withColumn("fishing", F.col("longest_run") >= run)


def direct_edits(trace: DataFrame, order: list[str]) -> DataFrame:
    """Semantic calls that an edit follows at once, per trace."""
    nxt = F.lead("tool_name").over(_order(order))
    df = trace.withColumn("next_tool", nxt)
    return df.groupBy("trace_id").agg(F.count_if(is_semantic(F.col("tool_name")) & F.coalesce(is_edit(F.col("next_tool")), F.lit(False))).alias("direct"))


def guessing(trace: DataFrame) -> DataFrame:
    t = F.col("tool_name")
    return trace.groupBy("trace_id").agg((F.bool_or(t == "grep") & ~F.bool_or(is_semantic(t))).alias("guessing"))


def first_hit(trace: DataFrame, order: list[str]) -> DataFrame:
    """Place of the first edit or successful semantic call; the trace's length without one."""
    df = trace.withColumn("place", F.row_number().over(_order(order)))
    hit = is_edit(F.col("tool_name")) | (is_semantic(F.col("tool_name")) & is_success(F.col("result")))
    return df.groupBy("trace_id").agg(F.coalesce(F.min(F.when(hit, F.col("place"))), F.count(F.lit(1))).cast("long").alias("steps_to_target"))


def backtracking(trace: DataFrame) -> DataFrame:
    """(trace_id, path): files that were read and never edited, by path in any case."""
    p = F.lower("path").alias("path")
    read, edited = F.bool_or(F.col("tool_name") == "file_read"), F.bool_or(is_edit(F.col("tool_name")))
    by = trace.filter(F.col("path").isNotNull()).groupBy("trace_id", p).agg(read.alias("read"), edited.alias("edited"))
    return by.filter(F.col("read") & ~F.col("edited")).select("trace_id", "path")


def effectiveness(trace: DataFrame, order: list[str]) -> DataFrame:
    """All measures of each trace in one row."""
    # Calls are dealt by trace once: islands of calls between semantic ones are summed up, then traces.
    w, tool = _order(order), F.col("tool_name")
    calls = trace.withColumns(
        {
            "island": F.sum(is_semantic(tool).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)),
            "direct": is_semantic(tool) & F.coalesce(is_edit(F.lead("tool_name").over(w)), F.lit(False)),
            "place": F.row_number().over(w),
        }
    )
    hit = is_edit(tool) | (is_semantic(tool) & is_success(F.col("result")))
    islands = calls.groupBy("trace_id", "island").agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(is_semantic(tool)).alias("semantic"), F.count_if(is_file_level(tool)).alias("file_level"),
        F.count_if("direct").alias("direct"), F.bool_or(tool == "grep").alias("grep"), F.min(F.when(hit, F.col("place"))).alias("hit"),
    )
    df = islands.groupBy("trace_id").agg(
        F.sum("semantic").alias("semantic"), F.sum("file_level").alias("file_level"), F.max("file_level").alias("longest_run"), F.sum("direct").alias("direct"),
        (F.bool_or("grep") & (F.sum("semantic") == 0)).alias("guessing"), F.coalesce(F.min("hit"), F.sum("calls")).cast("long").alias("steps_to_target"),
    )
    lost = backtracking(trace).groupBy("trace_id").agg(F.count(F.lit(1)).alias("backtracking"))
    df = df.join(lost, "trace_id", "left").withColumn("ratio", _ratio()).withColumn("fishing", F.col("longest_run") >= FISHING_RUN)
    return df.select("trace_id", "semantic", "file_level", "ratio", "longest_run", "fishing", "direct", "guessing", "steps_to_target", F.coalesce("backtracking", F.lit(0)).alias("backtracking"))


def outcome_counts(results: DataFrame) -> DataFrame:
    """(passed, failed, total) of rows with a boolean `success`."""
    return results.agg(F.count_if("success").alias("passed"), F.count_if(~F.col("success")).alias("failed"), F.count(F.lit(1)).alias("total"))
