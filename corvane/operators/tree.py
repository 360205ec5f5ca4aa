"""Trees of chunks: folder, file, type, member. chunks: (rel_path, chunk_type, symbol, parent, title, signature, content, start_line, end_line)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import file_name, folder

#: Chunk kinds that are types. Records are not among them.
TYPE_CHUNKS = ("class", "interface", "struct", "enum", "type")
MEMBER_CHUNKS = ("method", "function", "constructor", "property")


def tree_rows(chunks: DataFrame, max_depth: int = 3, detail: bool = False) -> DataFrame:
    """(node_id, parent_id, kind, name, signature, depth), folders and files, types and functions, members.

    A member tied to its type by title alone stands under the type and under the file too.
    """
    c = chunks.filter(F.col("rel_path").isNotNull())
    files = c.select("rel_path").distinct()
    dirs = files.select(folder(F.col("rel_path")).alias("d")).filter("d != ''").distinct()
    none = F.lit(None).cast("string")
    sig = F.col("signature") if detail else none
    out = dirs.select(F.concat(F.lit("folder:"), "d").alias("node_id"), none.alias("parent_id"), F.lit("folder").alias("kind"), F.col("d").alias("name"), none.alias("signature"), F.lit(0).alias("depth"))
    d = folder(F.col("rel_path"))
    out = out.unionByName(files.select(F.concat(F.lit("file:"), "rel_path").alias("node_id"), F.when(d != "", F.concat(F.lit("folder:"), d)).alias("parent_id"), F.lit("file").alias("kind"), file_name(F.col("rel_path")).alias("name"), none.alias("signature"), F.lit(1).alias("depth")))
    if max_depth >= 2:
        own = F.coalesce("symbol", "title")
        types = c.filter(F.col("chunk_type").isin(*TYPE_CHUNKS))
        out = out.unionByName(types.select(F.concat_ws(":", F.lit("type"), "rel_path", own).alias("node_id"), F.concat(F.lit("file:"), "rel_path").alias("parent_id"), F.lit("type").alias("kind"), own.alias("name"), sig.alias("signature"), F.lit(2).alias("depth")))
        loose = c.filter(F.col("chunk_type").isin(*MEMBER_CHUNKS) & F.col("parent").isNull())
        out = out.unionByName(loose.select(F.concat_ws(":", F.lit("function"), "rel_path", own).alias("node_id"), F.concat(F.lit("file:"), "rel_path").alias("parent_id"), F.lit("function").alias("kind"), own.alias("name"), sig.alias("signature"), F.lit(2).alias("depth")))
        if max_depth >= 3:
            t = types.select(F.col("rel_path").alias("t_path"), own.alias("t_name")).distinct()
            m = c.filter(F.col("chunk_type").isin(*MEMBER_CHUNKS))
            # A type that owns a member is its parent or what stands before a dot of its title: a few names, so the join is by equality.
            parts = F.split(F.coalesce("title", F.lit("")), "[.]")
            heads = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda x, k: F.array_join(F.slice(parts, F.lit(1), k + 1), "."))
            owners = F.array_distinct(F.filter(F.concat(F.array("parent"), heads), lambda x: x.isNotNull()))
            m = m.select("*", F.explode(owners).alias("owner"))
            pairs = m.join(t, (m["rel_path"] == t["t_path"]) & (m["owner"] == t["t_name"]))
            out = out.unionByName(pairs.select(F.concat_ws(":", F.lit("method"), "rel_path", own).alias("node_id"), F.concat_ws(":", F.lit("type"), "rel_path", "t_name").alias("parent_id"), F.lit("method").alias("kind"), own.alias("name"), sig.alias("signature"), F.lit(3).alias("depth")))
    return out


def tree_nested(chunks: DataFrame) -> DataFrame:
    """(rel_path, types): each file with its types, each with its members in order."""
    rows = tree_rows(chunks)
    members = rows.filter("kind = 'method'").groupBy(F.col("parent_id").alias("node_id")).agg(F.sort_array(F.collect_list("name")).alias("members"))
    types = rows.filter("kind = 'type'").join(members, "node_id", "left").select(F.col("parent_id").alias("file_id"), F.struct("name", F.coalesce("members", F.array().cast("array<string>")).alias("members")).alias("t"))
    nested = types.groupBy("file_id").agg(F.sort_array(F.collect_list("t")).alias("types"))
    files = rows.filter("kind = 'file'").select(F.col("node_id").alias("file_id"), F.expr("substring(node_id, 6)").alias("rel_path"))
    return files.join(nested, "file_id", "left").drop("file_id")


def node_count(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("nodes"))


def parse_node_id(node_id: Column) -> Column:
    """(kind, path, symbol) of `kind:path:symbol`; the symbol may hold colons."""
    parts = F.split(node_id, ":", 3)
    return F.struct(F.get(parts, 0).alias("kind"), F.get(parts, 1).alias("path"), F.get(parts, 2).alias("symbol"))


def node_content(chunks: DataFrame, node_id: str) -> DataFrame:
    """The chunk of a node: of a file its header, else its first; of a symbol the first of that name."""
    kind, path, symbol = [*node_id.split(":", 2), "", ""][:3]
    df = chunks.filter(F.col("rel_path") == path)
    if kind == "file":
        rank = F.when(F.col("chunk_type") == "header", 0).otherwise(1)
    else:
        df = df.filter((F.col("symbol") == symbol) | F.coalesce(F.col("title") == symbol, F.lit(False)))
        rank = F.lit(0)
    w = Window.partitionBy("rel_path").orderBy(rank, F.asc_nulls_last("start_line"))
    return df.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")
