"""Composed queries: exact symbols with semantic hits, prompt enrichment, and context as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import CONTENT_ALIASES
from ..functions.text import namespace_of, pascal_symbols, symbol_candidates
from .graph import expand_neighbourhood, project_structure, with_key
from .records import first_per_key, kind_weight
from .retrieval import RetrievalOptions, multi_query_top_k, per_query_slots, vector_top_k
from .status import resolve_workspaces

EXACT_LIMIT = 5


def exact_symbols(nodes: DataFrame, queries: DataFrame, limit: int = EXACT_LIMIT) -> DataFrame:
    """Per query (query_id, text) the best nodes that its words name: one per full name, by weight of kind, then id."""
    words = queries.select("query_id", F.posexplode(symbol_candidates(F.col("text"))).alias("word_no", "word"))
    words = words.withColumn("key", F.lower("word"))
    found = with_key(nodes, words.select("key")).join(words, "key")
    found = first_per_key(found, ["query_id", "full_name"], [F.col("word_no"), F.col("id")])
    w = Window.partitionBy("query_id").orderBy(kind_weight(F.col("node_type")).desc(), "word_no", "id")
    return found.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= limit).select("query_id", "place", "id", "node_type", "name", "full_name", *(["file_path"] if "file_path" in nodes.columns else []))


def hybrid_search(nodes: DataFrame, chunks: DataFrame, text: str, query: DataFrame, limit: int = 10, o: RetrievalOptions | None = None) -> DataFrame:
    """(place, kind, id, path, score): exact symbols at score 1, then semantic hits whose path no exact one has; null paths meet."""
    spark = nodes.sparkSession
    q = spark.range(1).select(F.lit(0).alias("query_id"), F.lit(text).alias("text"))
    exact = exact_symbols(nodes, q).select(F.lit("exact").alias("kind"), "id", (F.col("file_path") if "file_path" in nodes.columns else F.lit(None).cast("string")).alias("path"), F.lit(1.0).alias("score"), "place")
    hits = vector_top_k(chunks, query, o or RetrievalOptions(top_k=limit)).select(F.lit("semantic").alias("kind"), F.col("content_id").alias("id"), F.col("source_path").alias("path"), "score")
    rest = hits.join(exact.select(F.col("path").alias("p")), F.col("path").eqNullSafe(F.col("p")), "left_anti")
    rest = rest.withColumn("place", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("score"), "id")))
    both = exact.unionByName(rest).orderBy("kind", "place").limit(limit)
    return both.select("kind", "place", "id", "path", "score")


def docs_search(chunks: DataFrame, query: DataFrame) -> DataFrame:
    return vector_top_k(chunks, query, RetrievalOptions(top_k=10, min_score=0.5, content_types=["Documentation", "Markdown"]))


def workspace_search(chunks: DataFrame, query: DataFrame, root: str, content_alias: str = "all", k: int = 10, min_score: float | None = 0.3) -> DataFrame:
    """The best chunks under a workspace's path, of the content types that an alias stands for; an unknown alias is no restriction."""
    kinds = CONTENT_ALIASES.get(content_alias.lower()) or []
    return vector_top_k(chunks, query, RetrievalOptions(top_k=k, min_score=min_score, content_types=kinds, path_prefix=root))


def multi_workspace_search(chunks: DataFrame, registry: DataFrame, wanted: list[str], query: DataFrame, k: int = 20, min_score: float | None = 0.3) -> DataFrame:
    """(content_id, source_path, workspace_id, score, error): the best over the workspaces that resolve, or one row with an error if none does."""
    ws = resolve_workspaces(registry, wanted).select(F.col("id").alias("workspace_id"))
    hits = vector_top_k(chunks.join(ws, "workspace_id", "left_semi"), query, RetrievalOptions(top_k=k, min_score=min_score))
    none = F.lit(None).cast("string")
    rows = hits.select("content_id", "source_path", "workspace_id", "score", none.alias("error"))
    missing = ws.agg(F.count(F.lit(1)).alias("n")).filter("n = 0")
    failed = missing.select(none.alias("content_id"), none.alias("source_path"), none.alias("workspace_id"), F.lit(None).cast("double").alias("score"), F.lit("no workspace of that name").alias("error"))
    return rows.unionByName(failed)


def library_top_k(excerpts: DataFrame, query: DataFrame, k: int) -> DataFrame:
    """The k nearest without a least score; the score as a float."""
    return vector_top_k(excerpts, query, RetrievalOptions(top_k=k, min_score=None)).withColumn("score", F.col("score").cast("float"))


def codebase_context(chunks: DataFrame, queries: DataFrame, n_queries: int, total: int) -> DataFrame:
    """Best texts over several queries, each text once."""
    return multi_query_top_k(chunks, queries, per_query_slots(total, n_queries), total, ["content"])


def chat_context(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    return multi_query_top_k(chunks, queries, 5, 20, ["content_id", "chunk_index"])


def rag_text(hits: DataFrame) -> DataFrame:
    """One row: the hits as numbered sections in order of score."""
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "content_id", "chunk_index")
    part = F.concat(F.lit("## "), F.col("r").cast("string"), F.lit(". "), F.coalesce("source_path", "content_id"), F.lit("\n"), F.coalesce("content", F.lit("")))
    rows = hits.withColumn("r", F.row_number().over(w)).select("r", part.alias("part"))  # top-k rows
    return rows.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "part"))), lambda x: x["part"]), "\n\n").alias("context"))


def prompt_symbols(prompts: DataFrame, text: Column) -> DataFrame:
    """(seq, symbol) of the PascalCase names in prompts, the longest first."""
    return prompts.select(F.posexplode(pascal_symbols(text)).alias("seq", "symbol"))


def enrichment_text(nodes: DataFrame, edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(namespace, text): the neighbourhood of symbols as text, a section per namespace."""
    n = expand_neighbourhood(nodes, edges, symbols).withColumn("namespace", namespace_of(F.coalesce("full_name", "name")))
    line = F.concat(F.lit("- "), "node_type", F.lit(" "), "name", F.lit(" ("), "relation", F.lit(")"))
    parts = F.sort_array(F.collect_list(F.struct("seq", "r", "step", "k", line.alias("line"))))
    return n.groupBy("namespace").agg(F.array_join(F.transform(parts, lambda x: x["line"]), "\n").alias("text"))


def structure_report(nodes: DataFrame, edges: DataFrame, namespaces: int = 30) -> DataFrame:
    """(section, text): projects with what they refer to, and the first namespaces with the number of the rest."""
    p = project_structure(nodes, edges).select(F.lit("projects").alias("section"), F.concat("project", F.lit(": "), "references").alias("text"))
    ns = nodes.filter("node_type = 'Namespace'").select(F.coalesce("full_name", "name").alias("n")).distinct()
    first = ns.orderBy("n").limit(namespaces).agg(F.array_sort(F.collect_list("n")).alias("a"))
    both = first.join(F.broadcast(ns.agg(F.count(F.lit(1)).alias("all"))))  # one row each
    text = F.concat(F.array_join("a", ", "), F.when(F.col("all") > namespaces, F.concat(F.lit(" +"), (F.col("all") - namespaces).cast("string"), F.lit(" more"))).otherwise(""))
    return p.unionByName(both.select(F.lit("namespaces").alias("section"), text.alias("text")))


def prompt_enrichment(nodes: DataFrame, edges: DataFrame, prompt: str) -> DataFrame:
    """`enrichment_text` of the symbols that a prompt names."""
    one = nodes.sparkSession.range(1).select(F.lit(prompt).alias("prompt"))
    return enrichment_text(nodes, edges, prompt_symbols(one, F.col("prompt")))


def describe_codebase(nodes: DataFrame, edges: DataFrame, chunks: DataFrame, queries: DataFrame, n_queries: int, total: int, focus: str | None = None) -> DataFrame:
    """(section, place, title, text): the structure report, the best texts over several queries, and a type in focus with its surroundings."""
    none = F.lit(None).cast("string")
    out = structure_report(nodes, edges).select("section", F.lit(0).alias("place"), none.alias("title"), "text")
    hits = codebase_context(chunks, queries, n_queries, total)
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "content_id", "chunk_index"))  # at most total rows
    out = out.unionByName(hits.select(F.lit("texts").alias("section"), place.alias("place"), F.col("content_id").alias("title"), F.col("content").alias("text")))
    if focus:
        own = focus_type(nodes, edges, focus)
        place = F.row_number().over(Window.partitionBy("relation").orderBy("name", "id"))  # at most 20 rows each
        out = out.unionByName(own.select(F.lit("focus").alias("section"), place.alias("place"), F.col("relation").alias("title"), F.col("name").alias("text")))
    return out


def focus_type(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """(relation, id, name): the first type of a name with up to 20 members, 10 implementations and 10 heirs."""
    t = nodes.filter(F.col("node_type").isin("Class", "Interface", "Record", "Struct") & (F.lower("name") == name.lower())).orderBy("id").limit(1).select(F.col("id").alias("t"))
    parts = None
    for relation, kind, near, far, limit in (("member", "Contains", "source_id", "target_id", 20), ("implementation", "Implements", "target_id", "source_id", 10), ("derived", "Inherits", "target_id", "source_id", 10)):
        got = edges.filter(F.col("edge_type") == kind).join(F.broadcast(t), F.col(near) == F.col("t")).select(F.col(far).alias("id")).distinct()  # t has one row
        got = got.join(nodes.select("id", "name"), "id").orderBy("name", "id").limit(limit).select(F.lit(relation).alias("relation"), "id", "name")
        parts = got if parts is None else parts.unionByName(got)
    return parts
