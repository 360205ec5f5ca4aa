"""Statistics, freshness and the registry of workspaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import normalize_path

BYTES_PER_CHUNK = 5072


def rag_stats(chunks: DataFrame) -> DataFrame:
    """One row: chunks, different contents, counts by type, and an estimate of bytes in 64 bits."""
    by = chunks.groupBy("content_type").agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("content_type", "n")))).alias("by_type"))
    total = chunks.agg(F.count(F.lit(1)).alias("total_chunks"), F.countDistinct("content_id").alias("total_documents"))
    return total.join(F.broadcast(by)).select("*", (F.col("total_chunks") * BYTES_PER_CHUNK).alias("estimated_bytes"))  # both sides have one row


def directory_stats(chunks: DataFrame, root: str, time_col: str) -> DataFrame:
    """Chunks, files and last time under a folder; no row where there is nothing."""
    under = chunks.filter(F.ilike("source_path", F.concat(normalize_path(F.lit(root)), F.lit("/%"))))
    return under.agg(F.count(F.lit(1)).alias("chunk_count"), F.countDistinct("source_path").alias("file_count"), F.max(time_col).alias("last_indexed")).filter("chunk_count > 0")


def registry_with_stats(registry: DataFrame, chunks: DataFrame, metadata: DataFrame) -> DataFrame:
    """registry with each workspace's chunks, by path prefix with its case, and its latest run.

    Chunks are counted by path first. A prefix is a start of one of the lengths that the registry's paths have, so the join is by equality.
    """
    paths = chunks.filter(F.col("source_path").isNotNull()).groupBy("source_path").agg(F.count(F.lit(1)).alias("n"))
    r = registry.select(F.col("path").alias("root")).distinct()
    lengths = r.agg(F.collect_set(F.length("root")).alias("lengths"))
    starts = paths.join(F.broadcast(lengths))  # one row, of no more lengths than a path can have
    starts = starts.withColumn("k", F.explode("lengths")).filter(F.col("k") <= F.length("source_path")).groupBy(F.substring("source_path", F.lit(1), F.col("k")).alias("root")).agg(F.sum("n").alias("chunk_count"))
    counts = starts.join(r, "root", "left_semi")
    latest = metadata.groupBy(F.col("workspace_path").alias("root")).agg(F.max("indexed_at").alias("last_indexed"))
    df = registry.join(counts, registry["path"] == counts["root"], "left").drop("root").join(latest, F.col("path") == F.col("root"), "left").drop("root")
    return df.withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))


def resolve_workspaces(registry: DataFrame, wanted: list[str]) -> DataFrame:
    """The workspaces of a list of ids or aliases in any case, once each; `*` is all, unknown ones are dropped."""
    if "*" in wanted:
        return registry
    low = [w.lower() for w in wanted]
    return registry.filter(F.lower("id").isin(low) | F.coalesce(F.lower("alias").isin(low), F.lit(False))).distinct()


def staleness(indexed_at: Column, is_git: Column, indexed_sha: Column, head_sha: Column, commits_behind: Column, now: Column, max_hours: int = 24) -> Column:
    """not-indexed without a run; a repository is stale if another commit is ahead or it can't be told; a folder after a day."""
    git = (head_sha != indexed_sha) & F.coalesce(commits_behind > 0, F.lit(True))
    old = indexed_at < now - F.expr(f"INTERVAL {max_hours} HOURS")
    return F.when(indexed_at.isNull(), "not-indexed").when(F.coalesce(F.when(is_git, git).otherwise(old), F.lit(False)), "stale").otherwise("fresh")


def overall_status(rag: Column, graph: Column) -> Column:
    return F.when((rag == "not-indexed") & (graph == "not-indexed"), "not-indexed").when((rag == "stale") | (graph == "stale"), "stale").otherwise("fresh")


def index_status(workspaces: DataFrame, metadata: DataFrame, now: Column) -> DataFrame:
    """Per workspace (path, is_git, head_sha, commits_behind) the freshness of both indexes and of the whole."""
    m = metadata.groupBy(F.col("workspace_path").alias("path")).pivot("index_type", ["rag", "graph"]).agg(F.max_by(F.struct("indexed_at", "commit_sha"), "indexed_at"))
    df = workspaces.join(m, "path", "left")
    for k in ("rag", "graph"):
        df = df.withColumn(f"{k}_status", staleness(F.col(k)["indexed_at"], F.col("is_git"), F.col(k)["commit_sha"], F.col("head_sha"), F.col("commits_behind"), now))
    return df.select("path", "rag_status", "graph_status", overall_status(F.col("rag_status"), F.col("graph_status")).alias("status"))


def workspace_status(workspaces: DataFrame, metadata: DataFrame, chunks: DataFrame, jobs: DataFrame, now: Column, time_col: str) -> DataFrame:
    """`index_status` with each folder's chunks, files and last time, and its active job: (path, ..., chunk_count, file_count, last_indexed, active_job).

    jobs: (job_id, path, state). Folders are compared as normalised; a chunk belongs to each registered folder that its path stands under.
    """
    low = F.lower(F.col("source_path"))
    parts = F.split(low, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    files = chunks.filter(F.col("source_path").isNotNull()).groupBy("source_path").agg(F.count(F.lit(1)).alias("n"), F.max(time_col).alias("t"))
    roots = workspaces.select("path", normalize_path(F.col("path")).alias("root"))
    under = files.filter(F.instr("source_path", "/") > 0).select("n", "t", F.explode(above).alias("root")).join(roots.select("root").distinct(), "root", "left_semi")
    stats = under.groupBy("root").agg(F.sum("n").alias("chunk_count"), F.count(F.lit(1)).alias("file_count"), F.max("t").alias("last_indexed"))
    active = jobs.filter(F.col("state").isin("Queued", "Processing")).groupBy(normalize_path(F.col("path")).alias("root")).agg(F.min("job_id").alias("active_job"))
    more = roots.join(stats, "root", "left").join(active, "root", "left").drop("root")
    return index_status(workspaces, metadata, now).join(more, "path")


def latest_job_state(events: DataFrame) -> DataFrame:
    """(job_id, state, ...) of the last event of each job; events: (job_id, seq, state, processed, total, failed)."""
    last = F.max_by(F.struct("state", "processed", "total", "failed"), "seq").alias("s")
    done = F.when(F.col("s.total") > 0, F.floor(F.col("s.processed") * 100 / F.col("s.total")).cast("int")).otherwise(0)
    return events.groupBy("job_id").agg(last).select("job_id", "s.state", "s.processed", "s.total", "s.failed", done.alias("percent"))
