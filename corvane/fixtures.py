"""Views of the star-schema tables as a code graph, embedded chunks, tool traces and change events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.paths import workspace_id


class Tables:
    """The tables of a folder, each read when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        for f in df.schema.fields:
            if f.dataType.simpleString() == "timestamp_ntz":
                df = df.withColumn(f.name, F.col(f.name).cast("timestamp"))
        self.__dict__[name] = df
        return df


NODE_SQL = """
SELECT 'R:' || r_regionkey AS id, 'Solution' AS node_type, r_name AS name, CAST(NULL AS STRING) AS full_name, '/repo/' || lower(r_name) AS repository_path FROM region
UNION ALL SELECT 'P:' || n_nationkey, 'Project', n_name, CAST(NULL AS STRING), '/repo/' || lower(r_name) FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'N:' || n_nationkey, 'Namespace', n_name, r_name || '.' || n_name, '/repo/' || lower(r_name) FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'C:' || c_custkey, 'Class', c_name, r_name || '.' || n_name || '.' || c_name, '/repo/' || lower(r_name) FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'I:' || s_suppkey, 'Interface', s_name, r_name || '.' || n_name || '.' || s_name, '/repo/' || lower(r_name) FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'M:' || o_orderkey, 'Method', 'order_' || (o_orderkey % 50), c_name || '.order_' || (o_orderkey % 50), '/repo/' || lower(r_name) FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'F:' || p_partkey, 'Property', p_name, p_brand || '.' || p_name, '/repo/shared' FROM part
"""
EDGE_SQL = """
SELECT 'Contains' AS edge_type, 'R:' || n_regionkey AS source_id, 'P:' || n_nationkey AS target_id FROM nation
UNION ALL SELECT 'Contains', 'C:' || o_custkey, 'M:' || o_orderkey FROM orders
UNION ALL SELECT 'Declares', 'N:' || c_nationkey, 'C:' || c_custkey FROM customer
UNION ALL SELECT 'Declares', 'N:' || s_nationkey, 'I:' || s_suppkey FROM supplier
UNION ALL SELECT 'Implements', 'C:' || c_custkey, 'I:' || (c_custkey % (SELECT count(*) FROM supplier)) FROM customer
UNION ALL SELECT 'Inherits', 'C:' || c_custkey, 'C:' || CAST(floor(c_custkey / 10) AS BIGINT) FROM customer WHERE c_custkey >= 10
UNION ALL SELECT 'Calls', 'M:' || o_orderkey, 'M:' || ((o_orderkey * 7 + 3) % (SELECT count(*) FROM orders)) FROM orders
UNION ALL SELECT 'Calls', 'M:' || o_orderkey, 'M:' || ((o_orderkey * 3 + 1) % (SELECT count(*) FROM orders)) FROM orders
UNION ALL SELECT DISTINCT 'Uses', 'M:' || l_orderkey, 'F:' || l_partkey FROM lineitem
UNION ALL SELECT 'References', 'P:' || n_nationkey, 'P:' || ((n_nationkey * 2 + 1) % 25) FROM nation
UNION ALL SELECT 'Overrides', 'M:' || o_orderkey, 'M:' || (o_orderkey - 100) FROM orders WHERE o_orderkey >= 100 AND o_orderkey % 5 = 0
"""


def nodes(t: Tables) -> DataFrame:
    sql = NODE_SQL
    for name in ("region", "nation", "customer", "supplier", "orders", "part"):
        sql = sql.replace(f"FROM {name} ", f"FROM {{{name}}} ").replace(f"FROM {name}\n", f"FROM {{{name}}}\n").replace(f"JOIN {name} ", f"JOIN {{{name}}} ")
    return t.spark.sql(sql, region=t.region, nation=t.nation, customer=t.customer, supplier=t.supplier, orders=t.orders, part=t.part)


def edges(t: Tables) -> DataFrame:
    """(id, edge_type, source_id, target_id); ids are made of the other columns, so equal edges share one."""
    sql = EDGE_SQL
    for name in ("nation", "orders", "customer", "supplier", "lineitem"):
        for end in (" ", "\n", ")"):
            sql = sql.replace(f"FROM {name}{end}", f"FROM {{{name}}}{end}")
    e = t.spark.sql(sql, nation=t.nation, orders=t.orders, customer=t.customer, supplier=t.supplier, lineitem=t.lineitem)
    return e.withColumn("id", F.concat_ws("|", "edge_type", "source_id", "target_id"))


def chunks(t: Tables) -> DataFrame:
    """One embedded chunk per vector, with the document of the same number where there is one."""
    d = t.documents.select("doc_id", "text", "lang", "source")
    c = t.embeddings.join(d, F.col("vec_id") == F.col("doc_id"), "left")
    kind = F.when(F.col("lang") == "en", "Markdown").when(F.col("lang") == "de", "Code").otherwise("PlainText")
    return c.select(
        F.concat(F.lit("doc:"), "vec_id").alias("content_id"),
        F.lit(0).alias("chunk_index"),
        F.col("text").alias("content"),
        kind.alias("content_type"),
        F.concat(F.lit("/corpus/"), "source", F.lit("/"), "lang", F.lit("/"), "vec_id", F.lit(".md")).alias("source_path"),
        workspace_id(F.concat(F.lit("/corpus/"), "source")).alias("workspace_id"),
        "embedding",
        "vec_id",
    )


def query_vector(t: Tables, vec_id: int) -> DataFrame:
    """A relation of one row: the vector with this id."""
    return t.embeddings.filter(F.col("vec_id") == vec_id).select(F.col("embedding").alias("query")).limit(1)


#: How event types stand for tools.
TOOL_OF_EVENT = {"view": "search_code", "click": "file_read", "purchase": "file_edit", "error": "grep", "signup": "plan"}


def trace(t: Tables) -> DataFrame:
    """(trace_id, seq, tool_name, path, result): events as tool calls, a trace for each user."""
    pairs = F.create_map(*[F.lit(x) for kv in TOOL_OF_EVENT.items() for x in kv])
    return t.events.select(
        F.col("user_id").alias("trace_id"),
        "ts",
        F.col("event_id").alias("seq"),
        F.element_at(pairs, F.col("event_type")).alias("tool_name"),
        F.concat(F.lit("/src/F"), (F.col("event_id") % 7).cast("string"), F.lit(".cs")).alias("path"),
        F.when(F.col("value") > 50, F.concat(F.lit("found "), F.col("props"))).otherwise(F.lit("error: none")).alias("result"),
    )


def changes(t: Tables) -> DataFrame:
    kind = F.when(F.col("event_type").isin("signup", "view"), "Created").when(F.col("event_type") == "error", "Deleted").otherwise("Modified")
    return t.events.select("ts", "event_id", kind.alias("change_type"), F.concat(F.lit("/w/"), "user_id", F.lit(".cs")).alias("path"))


def register_views(t: Tables) -> None:
    """The derived tables as temporary views, so that queries can be written in SQL."""
    for name, df in (("nodes", nodes(t)), ("edges", edges(t)), ("chunks", chunks(t)), ("trace", trace(t)), ("changes", changes(t))):
        df.createOrReplaceTempView(name)


# The same views for the oracle, in its SQL.
ORACLE_NODES = "WITH nodes AS (" + NODE_SQL.replace("STRING", "VARCHAR") + ")"
ORACLE_GRAPH = ORACLE_NODES + ", edges AS (SELECT *, concat_ws('|', edge_type, source_id, target_id) AS id FROM (" + EDGE_SQL + "))"
ORACLE_CHUNKS = """WITH chunks AS (SELECT 'doc:' || vec_id AS content_id, 0 AS chunk_index, text AS content,
  CASE WHEN lang = 'en' THEN 'Markdown' WHEN lang = 'de' THEN 'Code' ELSE 'PlainText' END AS content_type,
  '/corpus/' || source || '/' || lang || '/' || vec_id || '.md' AS source_path, substring(sha256('/corpus/' || source), 1, 16) AS workspace_id, embedding, vec_id
  FROM embeddings LEFT JOIN documents ON vec_id = doc_id)"""
ORACLE_TRACE = """WITH trace AS (SELECT user_id AS trace_id, ts, event_id AS seq,
  CASE event_type WHEN 'view' THEN 'search_code' WHEN 'click' THEN 'file_read' WHEN 'purchase' THEN 'file_edit' WHEN 'error' THEN 'grep' WHEN 'signup' THEN 'plan' END AS tool_name,
  '/src/F' || (event_id % 7) || '.cs' AS path, CASE WHEN value > 50 THEN 'found ' || props ELSE 'error: none' END AS result FROM events)"""
ORACLE_CHANGES = """WITH changes AS (SELECT ts, event_id, CASE WHEN event_type IN ('signup', 'view') THEN 'Created' WHEN event_type = 'error' THEN 'Deleted' ELSE 'Modified' END AS change_type,
  '/w/' || user_id || '.cs' AS path FROM events)"""
