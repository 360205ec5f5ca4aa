"""Changes to tables as functions from one snapshot to the next: anti-joins and unions, no row-level writes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..naming import free_name
from .chunking import OVERLAP, SIZE, split_rows


def replace_content(chunks: DataFrame, new: DataFrame, key: str = "content_id") -> DataFrame:
    """chunks without the content that new names, and new's rows. new: numbered rows; content without rows left stays deleted."""
    return chunks.join(new.select(key).distinct(), key, "left_anti").select(*chunks.columns).unionByName(new.select(*chunks.columns))


def latest_per_key(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """Of rows with equal keys those of the last seq."""
    last = free_name(rows, "last")
    return rows.withColumn(last, F.max(seq).over(Window.partitionBy(key))).filter(F.col(last) == F.col(seq)).drop(last)


def index_batch(chunks: DataFrame, rows: DataFrame, seq: str) -> DataFrame:
    """Rows indexed as they are, numbered within their content in order of seq, in place of what their content had."""
    number = F.row_number().over(Window.partitionBy("content_id").orderBy(seq)) - 1
    return replace_content(chunks, rows.withColumn("chunk_index", number.cast("int")).drop(seq))


def index_content(chunks: DataFrame, texts: DataFrame, embed: Callable[[Column], Column], size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """chunks with each text (content_id, content, content_type, ...) cut, embedded and put in place of what its content had.

    A text without chunks leaves its content deleted. Columns of chunks that texts lack are null.
    """
    parts = split_rows(texts, "content", "content_type", size, overlap)
    rows = parts.withColumn("content", F.col("chunk")).withColumn("embedding", embed(F.col("chunk")))
    own = [F.col(c) if c in rows.columns else F.lit(None).cast(chunks.schema[c].dataType).alias(c) for c in chunks.columns]
    gone = chunks.join(texts.select("content_id").distinct(), "content_id", "left_anti").select(*chunks.columns)
    return gone.unionByName(rows.select(*own))


def delete_content(chunks: DataFrame, content_id: str) -> DataFrame:
    """chunks without a content; null ids stay."""
    return chunks.filter(F.coalesce(F.col("content_id") != content_id, F.lit(True)))


def was_there(chunks: DataFrame, content_id: str) -> DataFrame:
    """One row: whether there is something to delete."""
    return chunks.filter(F.col("content_id") == content_id).agg((F.count(F.lit(1)) > 0).alias("deleted"))


def cleared(table: DataFrame) -> DataFrame:
    return table.limit(0)


def delete_prefix(chunks: DataFrame, prefix: str) -> DataFrame:
    """chunks whose path doesn't start with prefix, by case and without regard to slashes; null paths stay."""
    return chunks.filter(~F.coalesce(F.startswith("source_path", F.lit(prefix)), F.lit(False)))


def clear_repository(nodes: DataFrame, edges: DataFrame, repository: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without a repository's nodes and all edges at them."""
    dead = nodes.filter(F.col("repository_path").ilike(repository)).select("id")
    left = edges
    for end in ("source_id", "target_id"):
        left = left.join(dead.select(F.col("id").alias(end)), end, "left_anti")
    return nodes.join(dead, "id", "left_anti").select(*nodes.columns), left.select(*edges.columns)


def reindex(nodes: DataFrame, edges: DataFrame, repository: str, build: Callable[[], tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges with a repository's part cleared and built anew; edges of a cleared node from elsewhere go with it."""
    left, new = clear_repository(nodes, edges, repository), build()
    return tuple(add_rows(a, b.select(*a.columns)) for a, b in zip(left, new))


def add_rows(table: DataFrame, rows: DataFrame) -> DataFrame:
    return table.unionByName(rows, allowMissingColumns=True)


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """table with rows in place of those with equal keys; null keys meet."""
    on: Column = F.lit(True)
    for k in keys:
        on = on & F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}"))
    return table.alias("o").join(rows.alias("n"), on, "left_anti").select(*[F.col(f"o.{c}").alias(c) for c in table.columns]).unionByName(rows.select(*table.columns))


def index_metadata_rows(workspace_path: str, files_found: int, files_done: int, now: Column, commit: str | None, spark) -> DataFrame:  # noqa: ANN001
    """Both metadata rows of a run: files_indexed is what was found, items_created what was processed."""
    one = spark.range(1)
    kinds = F.explode(F.array(F.lit("rag"), F.lit("graph"))).alias("index_type")
    return one.select(F.lit(workspace_path).alias("workspace_path"), kinds).select(
        "*", now.alias("indexed_at"), F.lit(commit).cast("string").alias("commit_sha"), F.lit(files_found).alias("files_indexed"), F.lit(files_done).alias("items_created")
    )


def delete_with_children(parents: DataFrame, children: DataFrame, key: str, value: str) -> tuple[DataFrame, DataFrame]:
    return parents.filter(~(F.col(key).eqNullSafe(value))), children.filter(~(F.col(key).eqNullSafe(value)))


def add_workspace(registry: DataFrame, rows: DataFrame) -> DataFrame:
    """registry with the rows whose id and alias, in any case, are free; the first of an empty registry becomes the default."""
    ids, aliases = registry.select(F.col("id").alias("t_id")), registry.select(F.lower("alias").alias("t_alias"))
    new, rank = free_name(registry, "new"), free_name(rows, "rank")
    first = Window.partitionBy(F.lower("id")).orderBy("path")
    same_alias = Window.partitionBy(F.lower("alias")).orderBy("path")
    free = rows.join(ids, F.col("id") == F.col("t_id"), "left_anti").join(aliases, F.lower("alias") == F.col("t_alias"), "left_anti")
    free = free.withColumn(rank, F.row_number().over(first)).filter(F.col(rank) == 1).withColumn(rank, F.row_number().over(same_alias)).filter((F.col(rank) == 1) | F.col("alias").isNull()).drop(rank)
    both = registry.withColumn(new, F.lit(0)).unionByName(free.withColumn("is_default", F.lit(False)).withColumn(new, F.lit(1)))
    return _one_default(both, new)


def _one_default(registry: DataFrame, new: str) -> DataFrame:
    """Without a default, the first row by age and path becomes it. A registry is a handful of rows that one person wrote."""
    w = Window.partitionBy(F.lit(0))
    order = F.row_number().over(w.orderBy(new, "path"))
    any_default = F.max(F.col("is_default").cast("int")).over(w) == 1
    return registry.withColumn("is_default", F.when(any_default, F.col("is_default")).otherwise(order == 1)).drop(new)


def remove_workspace(registry: DataFrame, id_or_alias: str) -> DataFrame:
    """registry without a workspace; if it was the default, the first left is."""
    x = id_or_alias.lower()
    left = registry.filter(~((F.lower("id") == x) | F.coalesce(F.lower("alias") == x, F.lit(False))))
    new = free_name(left, "new")
    return _one_default(left.withColumn(new, F.lit(0)), new)


def set_default(registry: DataFrame, workspace: str) -> DataFrame:
    """The named workspace as the default; an unknown name changes nothing."""
    hit = (F.lower("id") == workspace.lower()) | F.coalesce(F.lower("alias") == workspace.lower(), F.lit(False))
    known = F.max(hit.cast("int")).over(Window.partitionBy(F.lit(0))) == 1
    return registry.withColumn("is_default", F.when(known, hit).otherwise(F.col("is_default")))
