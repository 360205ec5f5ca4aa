"""Vector retrieval: filtered, prioritised and multi-query top-k over embedded chunks.

Ranks are by score, then content_id and chunk_index, so that results don't depend on partitions. A query vector is a
relation of one row; rows with null, zero or other-sized vectors have no score and take no part.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import is_prioritized, normalize_path
from ..functions.vectors import cosine_similarity, norm

ORDER = ("content_id", "chunk_index")
#: Questions up to which they go to every task.
MAX_BROADCAST = 1000


@dataclass(frozen=True)
class RetrievalOptions:
    top_k: int = 5
    min_score: float | None = 0.3
    content_types: list[str] = field(default_factory=list)
    path_prefix: str | None = None
    workspace_ids: list[str] | None = None
    prioritized: list[str] = field(default_factory=list)


def in_scope(chunks: DataFrame, o: RetrievalOptions) -> DataFrame:
    """Rows that the options admit. The path prefix is a pattern as given: no slash is added and wildcards work."""
    df = chunks.filter(F.col("embedding").isNotNull())
    if o.content_types:
        df = df.filter(F.col("content_type").isin(o.content_types))
    if o.path_prefix:
        df = df.filter(F.ilike("source_path", F.concat(normalize_path(F.lit(o.path_prefix)), F.lit("%"))))
    if o.workspace_ids is not None:
        df = df.filter(F.col("workspace_id").isNotNull() & F.col("workspace_id").isin(o.workspace_ids))
    return df


def scored(chunks: DataFrame, query: DataFrame) -> DataFrame:
    """chunks with a score against the vector in query's one row, whose norm is taken once."""
    q = query.limit(1).select("query", norm(F.col("query")).alias("query_norm"))
    df = chunks.join(F.broadcast(q))  # one row
    return df.withColumn("score", cosine_similarity(F.col("embedding"), F.col("query"), F.col("query_norm"))).drop("query", "query_norm").filter(F.col("score").isNotNull())


def _first(df: DataFrame, k: int) -> DataFrame:
    return df.orderBy(F.desc("score"), *ORDER).limit(k)


def vector_top_k(chunks: DataFrame, query: DataFrame, o: RetrievalOptions = RetrievalOptions()) -> DataFrame:
    """The best chunks at or above the least score. With prioritised files, they come from the best 2k and get slots first."""
    df = scored(in_scope(chunks, o), query)
    if not o.prioritized:
        # In descending order, a least score and then a limit give what 2k, the least score and a limit give.
        df = df if o.min_score is None else df.filter(F.col("score") >= o.min_score)
        return _first(df, o.top_k)
    df = _first(df, 2 * o.top_k)
    if o.min_score is not None:
        df = df.filter(F.col("score") >= o.min_score)
    return prioritise(df, o.top_k, o.prioritized)


def prioritise(candidates: DataFrame, k: int, wanted: list[str]) -> DataFrame:
    """Of at most 2k candidates, prioritised ones get max(k / 2, 3) slots, the rest of k goes to others; adds `prioritized` and `place`."""
    df = candidates.withColumn("prioritized", is_prioritized(F.col("source_path"), wanted))
    by = Window.partitionBy("prioritized").orderBy(F.desc("score"), *ORDER)
    df = df.withColumn("r", F.row_number().over(by)).withColumn("n_wanted", F.sum(F.col("prioritized").cast("int")).over(Window.partitionBy(F.lit(0))))
    slots = F.least("n_wanted", F.lit(max(k // 2, 3)))
    df = df.filter(F.when(F.col("prioritized"), F.col("r") <= slots).otherwise(F.col("r") <= k - slots))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("prioritized"), "r"))
    return df.withColumn("place", place).filter(F.col("place") <= k).drop("r", "n_wanted")


def multi_query_top_k(chunks: DataFrame, queries: DataFrame, per_query: int, total: int, key: list[str], min_score: float = 0.35) -> DataFrame:
    """The best of each query, of equal keys the best, and of those the best. queries: (query_id, query).

    Every chunk is scored for every question. More questions than MAX_BROADCAST are taken in blocks, each a pass over the chunks with
    the block in every task, so that no product is ever shuffled.
    """
    q = queries.withColumn("query_norm", norm(F.col("query")))
    n = queries.limit(MAX_BROADCAST + 1).count()
    blocks = 1 if n <= MAX_BROADCAST else -(-2 * queries.count() // MAX_BROADCAST)  # by hash, of half the bound on average

    def scored(block: int) -> DataFrame:
        own = q if blocks == 1 else q.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        df = chunks.filter(F.col("embedding").isNotNull()).join(F.broadcast(own))
        df = df.withColumn("score", cosine_similarity(F.col("embedding"), F.col("query"), F.col("query_norm"))).filter(F.col("score") >= min_score)
        return df.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), *ORDER))).filter(F.col("r") <= per_query)

    df = reduce(DataFrame.unionByName, [scored(k) for k in range(blocks)])
    best = Window.partitionBy(*key).orderBy(F.desc("score"), *ORDER, "query_id")
    df = df.withColumn("b", F.row_number().over(best)).filter(F.col("b") == 1)
    return _first(df.drop("r", "b", "query", "query_norm"), total)


def per_query_slots(total: int, n_queries: int) -> int:
    return max(1, total // max(1, n_queries) + 1)


def chunks_for_tree(chunks: DataFrame, root: str, pattern: str | None) -> DataFrame:
    """Chunks under a folder with their relative path and map fields; a pattern other than blank or `.` must be part of path, symbol or title."""
    from ..functions.paths import relative_path
    from ..functions.text import map_int

    r = normalize_path(F.lit(root))
    df = chunks.filter(F.ilike("source_path", F.concat(r, F.lit("/%")))).withColumn("rel_path", relative_path(F.col("source_path"), r))
    m = F.col("metadata")
    df = df.select(
        "*",
        F.coalesce(F.try_element_at(m, F.lit("chunkType")), F.lit("unknown")).alias("chunk_type"),
        *[F.try_element_at(m, F.lit(k)).alias(c) for k, c in (("symbolName", "symbol"), ("parentSymbol", "parent"), ("title", "title"), ("signature", "signature"))],
        map_int(m, "startLine").alias("start_line"),
        map_int(m, "endLine").alias("end_line"),
    )
    if pattern and pattern != ".":
        p = F.lit(pattern.lower())
        hit: Column = F.contains(F.lower("rel_path"), p)
        for c in ("symbol", "title"):
            hit = hit | F.coalesce(F.contains(F.lower(c), p), F.lit(False))
        # Path or raw metadata, wildcards as given, then the parts that are shown.
        df = df.filter(F.ilike("source_path", F.lit(f"%{pattern}%")) | F.coalesce(F.ilike(F.to_json("metadata"), F.lit(f"%{pattern}%")), F.lit(False))).filter(hit)
    return df
