"""The engine's queries by name over the star-schema tables, each with the SQL that gives the same rows where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import fixtures as X
from ..functions import paths as P
from ..functions import text as T
from ..operators import chunking as C
from ..operators import graph as G
from ..operators import lines as L
from ..operators import mutate as M
from ..operators import records as R
from ..operators import retrieval as V
from ..operators import search as S
from ..operators import status as ST
from ..operators import symbols as Y
from ..operators import trace as TR
from ..operators import tree as TREE
from ..sources import research as RS
from ..streaming import changes as CH
from ..streaming import jobs as J
from .base import CATALOG, Query, add, oracle_sql, queries, run  # noqa: F401


# ---- vectors


def _hits(df: DataFrame, *more: str) -> DataFrame:
    return df.select("content_id", F.round("score", 6).alias("score"), *more)


def _scores(vec: int, where: str = "TRUE") -> str:
    return f"""{X.ORACLE_CHUNKS}, scored AS (SELECT c.*, list_cosine_similarity(c.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS s
      FROM chunks c, embeddings q WHERE q.vec_id = {vec} AND c.embedding IS NOT NULL AND {where})"""


def _topk(o: V.RetrievalOptions, vec: int = 0, *more: str) -> Callable[[X.Tables], DataFrame]:
    return lambda t: _hits(V.vector_top_k(X.chunks(t), X.query_vector(t, vec), o), *more)


add("vec_topk", _topk(V.RetrievalOptions()), _scores(0) + "SELECT content_id, round(s, 6) AS score FROM scored WHERE s >= 0.3 ORDER BY s DESC, content_id LIMIT 5")
_SRC1 = "substring(sha256('/corpus/src1'), 1, 16)"
add(
    "vec_topk_filtered",
    _topk(V.RetrievalOptions(top_k=10, min_score=0.0, content_types=["Markdown", "Code"], path_prefix="/corpus/src1")),
    _scores(1 - 1, "content_type IN ('Markdown', 'Code') AND source_path ILIKE '/corpus/src1%'") + "SELECT content_id, round(s, 6) AS score FROM scored WHERE s >= 0 ORDER BY s DESC, content_id LIMIT 10",
)
add(
    "vec_topk_prioritized",
    _topk(V.RetrievalOptions(top_k=8, min_score=0.0, prioritized=["en"] + [f"{i}.md" for i in range(0, 500, 3)]), 0, "prioritized", "place"),
    _scores(0)
    + """, c AS (SELECT * FROM scored ORDER BY s DESC, content_id LIMIT 16), w AS (SELECT unnest(list_concat(['en'], [i || '.md' for i in range(0, 500, 3)])) AS w),
    p AS (SELECT c.*, EXISTS (SELECT 1 FROM w WHERE source_path LIKE '%' || w OR source_path LIKE '%/' || w || '%') AS prioritized FROM c WHERE s >= 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY prioritized ORDER BY s DESC, content_id) AS r, sum(prioritized::INT) OVER () AS n FROM p),
    k AS (SELECT *, least(n, 4) AS slots FROM r), f AS (SELECT * FROM k WHERE CASE WHEN prioritized THEN r <= slots ELSE r <= 8 - slots END),
    z AS (SELECT *, row_number() OVER (ORDER BY prioritized DESC, r) AS place FROM f)
    SELECT content_id, round(s, 6) AS score, prioritized, place FROM z WHERE place <= 8""",
)


def _workspaces(t: X.Tables) -> DataFrame:
    """A registry with one workspace per source."""
    s = t.documents.select("source").distinct()
    path = F.concat(F.lit("/corpus/"), "source")
    return s.select(P.workspace_id(path).alias("id"), path.alias("path"), F.upper("source").alias("alias"), F.array(F.lit("corpus"), "source").alias("tags"), (F.col("source") == "src0").alias("is_default"))


def _multi_workspace(t: X.Tables) -> DataFrame:
    return _hits(S.multi_workspace_search(X.chunks(t), _workspaces(t), ["SRC1", "src2", "nowhere"], X.query_vector(t, 3), 20, 0.0), "workspace_id")


add(
    "vec_multi_workspace",
    _multi_workspace,
    _scores(3, f"workspace_id IN ({_SRC1}, substring(sha256('/corpus/src2'), 1, 16))") + "SELECT content_id, round(s, 6) AS score, workspace_id FROM scored WHERE s >= 0 ORDER BY s DESC, content_id LIMIT 20",
)
add(
    "library_search",
    lambda t: S.library_top_k(X.chunks(t), X.query_vector(t, 7), 5).select("content_id", F.round(F.col("score").cast("double"), 4).alias("score")),
    _scores(7) + "SELECT content_id, round(s, 4) AS score FROM scored ORDER BY s DESC, content_id LIMIT 5",
)
add("docs_search", lambda t: _hits(S.docs_search(X.chunks(t), X.query_vector(t, 1))), _scores(1, "content_type IN ('Documentation', 'Markdown')") + "SELECT content_id, round(s, 6) AS score FROM scored WHERE s >= 0.5 ORDER BY s DESC, content_id LIMIT 10")


def _questions(t: X.Tables) -> DataFrame:
    return t.embeddings.filter("vec_id IN (0, 11, 22)").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


def _merge_sql(per: int, total: int, key: str) -> str:
    return f"""{X.ORACLE_CHUNKS}, q AS (SELECT vec_id AS query_id, embedding AS qe FROM embeddings WHERE vec_id IN (0, 11, 22)),
    s AS (SELECT c.*, query_id, list_cosine_similarity(c.embedding::DOUBLE[], qe::DOUBLE[]) AS s FROM chunks c, q),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, content_id) AS r FROM s WHERE s >= 0.35),
    b AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY s DESC, content_id, query_id) AS b FROM r WHERE r <= {per})
    SELECT content_id, round(s, 6) AS score FROM b WHERE b = 1 ORDER BY s DESC, content_id LIMIT {total}"""


add("multi_query_merge", lambda t: _hits(S.codebase_context(X.chunks(t), _questions(t), 3, 10)), _merge_sql(4, 10, "content"))
add("multi_query_merge_chunk", lambda t: _hits(S.chat_context(X.chunks(t), _questions(t))), _merge_sql(5, 20, "content_id, chunk_index"))
add(
    "rag_context",
    lambda t: S.rag_text(V.vector_top_k(X.chunks(t), X.query_vector(t, 0), V.RetrievalOptions(top_k=3, min_score=0.0))).select(F.sha2("context", 256).alias("context_sha256")),
    _scores(0) + ", k AS (SELECT * FROM scored WHERE s >= 0 ORDER BY s DESC, content_id LIMIT 3), n AS (SELECT *, row_number() OVER (ORDER BY s DESC, content_id) AS r FROM k) "
    "SELECT sha256(string_agg('## ' || r || '. ' || coalesce(source_path, content_id) || chr(10) || coalesce(content, ''), chr(10) || chr(10) ORDER BY r)) AS context_sha256 FROM n",
)



def _mapped(t: X.Tables) -> DataFrame:
    """Chunks with a metadata map, some of its numbers malformed."""
    line = F.when(F.col("vec_id") % 3 == 0, F.lit("x")).otherwise(F.col("vec_id").cast("string"))
    m = F.create_map(F.lit("chunkType"), F.lit("method"), F.lit("symbolName"), F.concat(F.lit("Sym"), F.col("vec_id") % 50), F.lit("startLine"), line)
    return X.chunks(t).withColumn("metadata", m)


add("chunks_for_tree", lambda t: V.chunks_for_tree(_mapped(t), "/Corpus//src1", "SYM1").select("content_id", "rel_path", "symbol", "start_line", "chunk_type"),
    X.ORACLE_CHUNKS + " SELECT content_id, substring(source_path, 14) AS rel_path, 'Sym' || (vec_id % 50) AS symbol, CASE WHEN vec_id % 3 > 0 THEN vec_id::INTEGER END AS start_line, 'method' AS chunk_type FROM chunks WHERE source_path ILIKE '/corpus/src1/%' AND (contains(lower(substring(source_path, 14)), 'sym1') OR contains(lower('Sym' || (vec_id % 50)), 'sym1'))")
add("workspace_search", lambda t: _hits(S.workspace_search(X.chunks(t), X.query_vector(t, 2), "/corpus/src2", "DOCS", 10, 0.0)),
    _scores(2, "content_type IN ('Documentation', 'Markdown', 'PlainText') AND source_path ILIKE '/corpus/src2%'") + "SELECT content_id, round(s, 6) AS score FROM scored WHERE s >= 0 ORDER BY s DESC, content_id LIMIT 10")
add("multi_workspace_error",
    lambda t: S.multi_workspace_search(X.chunks(t), _workspaces(t), ["nowhere"], X.query_vector(t, 2)).unionByName(S.multi_workspace_search(X.chunks(t), _workspaces(t), ["SRC1", "nowhere"], X.query_vector(t, 2), min_score=None)).select("content_id", "error"),
    _scores(2, f"workspace_id = {_SRC1}") + "SELECT content_id, NULL::VARCHAR AS error FROM (SELECT * FROM scored ORDER BY s DESC, content_id LIMIT 20) UNION ALL SELECT NULL, 'no workspace of that name'")

# ---- graph


def _g(f: Callable[..., DataFrame], *args, **kw) -> Callable[[X.Tables], DataFrame]:  # noqa: ANN002, ANN003
    return lambda t: f(X.nodes(t), X.edges(t), *args, **kw).select("id", "node_type", "name", "full_name")


_COLS = "n.id, n.node_type, n.name, n.full_name"


def _along(kind: str, near: str, far: str, where: str, distinct: bool = True, also: str = "") -> str:
    return f"{X.ORACLE_GRAPH} SELECT {'DISTINCT ' if distinct else ''}{_COLS} FROM nodes n JOIN edges e ON e.{far} = n.id JOIN nodes m ON m.id = e.{near} WHERE e.edge_type IN ({kind}) AND {where} {also}"


def _name(x: str) -> str:
    return f"(m.name = '{x}' OR m.full_name = '{x}')"


add("find_implementations", _g(G.find_implementations, "Supplier#000000003"), _along("'Implements'", "target_id", "source_id", _name("Supplier#000000003")))
add("find_implementations_in_repo", _g(G.find_implementations, "Supplier#000000003", "/REPO/a%"), _along("'Implements'", "target_id", "source_id", _name("Supplier#000000003"), also="AND n.repository_path ILIKE '/REPO/a%'"))
add("find_derived", _g(G.find_derived_types, "Customer#000000003"), _along("'Inherits'", "target_id", "source_id", _name("Customer#000000003")))
_METHOD = "m.node_type = 'Method' AND " + _name("order_7")
add("find_callers", _g(G.find_callers, "order_7"), _along("'Calls'", "target_id", "source_id", _METHOD))
_IN_TYPE = " AND m.id IN (SELECT e2.target_id FROM edges e2 JOIN nodes y ON y.id = e2.source_id WHERE e2.edge_type = 'Contains' AND (y.name = '{0}' OR y.full_name = '{0}'))".format("Customer#000000022")
add("find_callers_in_type", lambda t: _g(G.find_callers, "order_7", "Customer#000000022")(t), _along("'Calls'", "target_id", "source_id", _METHOD + _IN_TYPE))
add("find_dependencies", _g(G.find_dependencies, "order_7"), _along("'Calls', 'Uses'", "source_id", "target_id", _METHOD))
add("type_members", _g(G.type_members, "Customer#000000007"), _along("'Contains'", "source_id", "target_id", _name("Customer#000000007"), False, "AND n.node_type IN ('Method', 'Property', 'Field', 'Event', 'Constructor')"))
add("types_in_namespace", _g(G.types_in_namespace, "NATION_3"), _along("'Declares'", "source_id", "target_id", "m.node_type = 'Namespace' AND " + _name("NATION_3"), False, "AND n.node_type IN ('Class', 'Interface', 'Record', 'Struct', 'Enum')"))
add("project_refs", _g(G.project_references, "NATION_0"), _along("'References'", "source_id", "target_id", "m.node_type = 'Project' AND m.name = 'NATION_0'", False))
add("reverse_refs", _g(G.reverse_references, "NATION_3"), _along("'References'", "target_id", "source_id", "m.node_type = 'Project' AND m.name = 'NATION_3'", False))
_FIND = "(name ILIKE 'nation_1%' OR full_name ILIKE 'nation_1%' OR full_name ILIKE '%.nation_1%')"
add("find_nodes", lambda t: G.find_nodes(X.nodes(t), "nation_1%", "Namespace").select("id", "name", "full_name"), X.ORACLE_NODES + f" SELECT id, name, full_name FROM nodes WHERE {_FIND} AND node_type = 'Namespace'")
add("find_definition", lambda t: G.definition(X.nodes(t), "order_7", "Customer#0000000").select("id", "name"), X.ORACLE_NODES + " SELECT id, name FROM nodes WHERE (name ILIKE 'order_7' OR full_name ILIKE 'order_7' OR full_name ILIKE '%.order_7') AND contains(lower(full_name), 'customer#0000000') ORDER BY id LIMIT 1")


def _stats_in_sql(t: X.Tables) -> DataFrame:
    X.register_views(t)
    return t.spark.sql("SELECT n.node_type, e.edge_type, count(*) AS n FROM nodes n JOIN edges e ON e.source_id = n.id GROUP BY ALL")


add("graph_sql", _stats_in_sql, X.ORACLE_GRAPH + " SELECT n.node_type, e.edge_type, count(*) AS n FROM nodes n JOIN edges e ON e.source_id = n.id GROUP BY ALL")
add("graph_stats", lambda t: G.graph_stats(X.nodes(t), X.edges(t)), X.ORACLE_GRAPH + " SELECT 'node' AS what, node_type AS kind, count(*) AS n FROM nodes GROUP BY 2 UNION ALL SELECT 'edge', edge_type, count(*) FROM edges GROUP BY 2")
add("edge_stats_repo", lambda t: G.graph_stats(X.nodes(t), X.edges(t), "/repo/asia"), X.ORACLE_GRAPH + " SELECT 'node' AS what, node_type AS kind, count(*) AS n FROM nodes WHERE repository_path ILIKE '/repo/asia' GROUP BY 2 UNION ALL SELECT 'edge', edge_type, count(*) FROM edges JOIN nodes n ON n.id = source_id WHERE repository_path ILIKE '/repo/asia' GROUP BY 2")
add("distinct_calls", lambda t: G.distinct_edges(X.edges(t).unionByName(X.edges(t)), "Calls").select("source_id", "target_id"), X.ORACLE_GRAPH + " SELECT DISTINCT source_id, target_id FROM edges WHERE edge_type = 'Calls'")
add("known_edges", lambda t: G.known_edges(X.edges(t), X.nodes(t).filter("node_type IN ('Method', 'Class')")).select("edge_type", "source_id", "target_id"), X.ORACLE_GRAPH + " SELECT edge_type, source_id, target_id FROM edges WHERE source_id IN (SELECT id FROM nodes WHERE node_type IN ('Method', 'Class')) AND target_id IN (SELECT id FROM nodes WHERE node_type IN ('Method', 'Class'))")
add("incident_edges", lambda t: G.incident_edges(X.edges(t).dropDuplicates(["id"]), X.nodes(t).filter("name = 'order_7'")).select("id"), X.ORACLE_GRAPH + " SELECT DISTINCT id FROM edges WHERE source_id IN (SELECT id FROM nodes WHERE name = 'order_7') OR target_id IN (SELECT id FROM nodes WHERE name = 'order_7')")
add("edge_text", lambda t: G.edge_text(X.nodes(t).filter("node_type != 'Property'"), X.edges(t).filter("edge_type IN ('Uses', 'References')")), X.ORACLE_GRAPH + " SELECT edge_type, CASE edge_type WHEN 'References' THEN 4 ELSE 6 END AS edge_ordinal, coalesce(a.name, '?') || ' -> ' || coalesce(b.name, '?') AS line FROM edges LEFT JOIN (SELECT * FROM nodes WHERE node_type != 'Property') a ON a.id = source_id LEFT JOIN (SELECT * FROM nodes WHERE node_type != 'Property') b ON b.id = target_id WHERE edge_type IN ('Uses', 'References')")
add("members_by_name", lambda t: G.members_by_name(X.nodes(t).withColumn("file_path", F.when(F.col("node_type").isin("Class", "Property"), F.concat(F.lit("f"), F.expr("substring(id, 3)")))), "Customer#000000007").select("id"),
    X.ORACLE_NODES + " SELECT id FROM nodes WHERE node_type IN ('Method', 'Property') AND (contains(full_name, 'Customer#000000007.') OR (node_type = 'Property' AND substring(id, 3) IN (SELECT substring(id, 3) FROM nodes WHERE node_type = 'Class' AND name = 'Customer#000000007')))")
add("project_closure", lambda t: G.closure(X.edges(t), X.nodes(t).filter("node_type = 'Project'"), "References"),
    X.ORACLE_GRAPH.replace("WITH nodes", "WITH RECURSIVE nodes") + ", e AS (SELECT DISTINCT source_id, target_id FROM edges WHERE edge_type = 'References'), r(start_id, id, depth) AS (SELECT id, id, 0 FROM nodes WHERE node_type = 'Project' UNION SELECT start_id, target_id, depth + 1 FROM r JOIN e ON source_id = id WHERE depth < 20) SELECT start_id, id, min(depth) AS depth FROM r GROUP BY ALL HAVING min(depth) > 0")


def _diagram(t: X.Tables) -> DataFrame:
    n, e = X.nodes(t), X.edges(t)
    a = G.find_callers(n, e, "order_7").select(F.lit("callers").alias("side"), F.col("full_name").alias("name"))
    b = G.find_dependencies(n, e, "order_7").select(F.lit("callees").alias("side"), F.col("full_name").alias("name"))
    return G.diagram_lines(a.unionByName(b))


add("call_graph_diagram", _diagram,
    X.ORACLE_GRAPH + f""", m AS (SELECT * FROM nodes m WHERE {_METHOD}),
    p AS (SELECT 'callers' AS side, x.full_name AS name, x.id FROM nodes x WHERE id IN (SELECT source_id FROM edges WHERE edge_type = 'Calls' AND target_id IN (SELECT id FROM m))
      UNION ALL SELECT 'callees', x.full_name, x.id FROM nodes x WHERE id IN (SELECT target_id FROM edges WHERE edge_type IN ('Calls', 'Uses') AND source_id IN (SELECT id FROM m))),
    r AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY name) AS r, count(*) OVER (PARTITION BY side) AS n FROM p)
    SELECT side, max(n) AS n_nodes, string_agg(name, ', ' ORDER BY r) || CASE WHEN max(n) > 10 THEN ' +' || (max(n) - 10) || ' more' ELSE '' END AS label FROM r WHERE r <= 10 GROUP BY side""")  # fmt: skip
add("project_structure", lambda t: G.project_structure(X.nodes(t), X.edges(t)), X.ORACLE_GRAPH + " SELECT p.name AS project, coalesce(string_agg(q.name, ', ' ORDER BY q.name), '') AS \"references\" FROM nodes p LEFT JOIN edges e ON e.source_id = p.id AND e.edge_type = 'References' LEFT JOIN nodes q ON q.id = e.target_id WHERE p.node_type = 'Project' GROUP BY p.id, p.name")
add("structure_report", lambda t: S.structure_report(X.nodes(t), X.edges(t), 5).filter("section = 'namespaces'"), X.ORACLE_NODES + ", a AS (SELECT list_sort(list(DISTINCT full_name)) AS a FROM nodes WHERE node_type = 'Namespace') SELECT 'namespaces' AS section, array_to_string(a[1:5], ', ') || ' +' || (len(a) - 5) || ' more' AS text FROM a")
add("focus_type", lambda t: S.focus_type(X.nodes(t), X.edges(t), "customer#000000003"),
    X.ORACLE_GRAPH + """, t AS (SELECT min(id) AS t FROM nodes WHERE node_type IN ('Class', 'Interface', 'Record', 'Struct') AND lower(name) = 'customer#000000003'),
    p AS (SELECT DISTINCT 'member' AS relation, target_id AS id, 20 AS k FROM edges, t WHERE edge_type = 'Contains' AND source_id = t UNION SELECT 'implementation', source_id, 10 FROM edges, t WHERE edge_type = 'Implements' AND target_id = t UNION SELECT 'derived', source_id, 10 FROM edges, t WHERE edge_type = 'Inherits' AND target_id = t),
    r AS (SELECT p.*, name, row_number() OVER (PARTITION BY relation ORDER BY name, p.id) AS r FROM p JOIN nodes USING (id)) SELECT relation, id, name FROM r WHERE r <= k""")  # fmt: skip


def _symbols(t: X.Tables) -> DataFrame:
    return t.spark.range(1).select(F.posexplode(F.array(F.lit("Supplier#000000003"), F.lit("order_7"), F.lit("Customer#000000003"))).alias("seq", "symbol"))


_NBR = X.ORACLE_GRAPH + """, s(seq, symbol) AS (VALUES (0, 'Supplier#000000003'), (1, 'order_7'), (2, 'Customer#000000003')), o AS (SELECT *, CASE node_type WHEN 'Solution' THEN 0 WHEN 'Project' THEN 1 WHEN 'Namespace' THEN 3 WHEN 'Class' THEN 4 WHEN 'Interface' THEN 5 WHEN 'Method' THEN 9 ELSE 10 END AS ord FROM nodes),
    own AS (SELECT * FROM (SELECT seq, symbol, o.*, row_number() OVER (PARTITION BY seq ORDER BY ord, id) AS r FROM o JOIN s ON lower(name) = lower(symbol) OR lower(full_name) = lower(symbol) OR lower(full_name) LIKE '%.' || lower(symbol)) WHERE r <= 10),
    rel(step, relation, kinds, edge, inward, k, members) AS (VALUES (1, 'implementation', ['Interface'], 'Implements', TRUE, 5, FALSE), (2, 'derived', ['Class'], 'Inherits', TRUE, 5, FALSE), (3, 'member', ['Class', 'Interface', 'Record', 'Struct'], 'Contains', FALSE, 10, TRUE), (4, 'caller', ['Method'], 'Calls', TRUE, 5, FALSE)),
    pairs AS (SELECT DISTINCT own.seq, own.symbol, own.r, step, relation, k AS lim, CASE WHEN inward THEN e.source_id ELSE e.target_id END AS id, members FROM own JOIN rel ON list_contains(kinds, own.node_type) JOIN edges e ON e.edge_type = rel.edge AND CASE WHEN inward THEN e.target_id ELSE e.source_id END = own.id),
    got AS (SELECT * FROM (SELECT p.*, row_number() OVER (PARTITION BY seq, r, step ORDER BY p.id) AS k FROM pairs p JOIN nodes n ON n.id = p.id WHERE NOT members OR n.node_type IN ('Method', 'Property')) WHERE k <= lim),
    every AS (SELECT seq, symbol, r, 0 AS step, 0 AS k, 'match' AS relation, id FROM own UNION ALL SELECT seq, symbol, r, step, k, relation, id FROM got),
    first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq, r, step, k) AS f FROM every) WHERE f = 1)"""
add("enrich_neighbourhood", lambda t: G.expand_neighbourhood(X.nodes(t), X.edges(t), _symbols(t)).select("seq", "r", "step", "k", "relation", "id"), _NBR + " SELECT seq, r, step, k, relation, id FROM first")
add("enrichment_text", lambda t: S.enrichment_text(X.nodes(t), X.edges(t), _symbols(t)),
    _NBR + """ SELECT CASE WHEN contains(coalesce(full_name, name), '.') THEN regexp_replace(coalesce(full_name, name), '\\.[^.]*$', '') ELSE coalesce(full_name, name) END AS namespace,
    string_agg('- ' || node_type || ' ' || name || ' (' || relation || ')', chr(10) ORDER BY seq, r, step, k) AS text FROM first JOIN nodes USING (id) GROUP BY 1""")  # fmt: skip


def _hybrid(t: X.Tables) -> DataFrame:
    n = X.nodes(t).withColumn("file_path", F.when(F.col("node_type") == "Class", F.concat(F.lit("/corpus/src1/en/"), F.expr("substring(id, 3)"), F.lit(".md"))))
    got = S.hybrid_search(n, X.chunks(t), "find NATION_3 and order_7, please", X.query_vector(t, 0), 10, V.RetrievalOptions(top_k=10, min_score=0.0))
    return got.select("kind", "place", "id", "path", F.round("score", 6).alias("score"))


_EXACT = """, w(no, word) AS (VALUES (0, 'nation_3'), (1, 'order_7'), (2, 'please')),
    x AS (SELECT * FROM (SELECT n.*, no, row_number() OVER (PARTITION BY full_name ORDER BY no, id) AS d FROM nodes n JOIN w ON lower(name) = word OR lower(full_name) = word OR lower(full_name) LIKE '%.' || word) WHERE d = 1),
    e AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY CASE node_type WHEN 'Interface' THEN 100 WHEN 'Class' THEN 90 WHEN 'Method' THEN 50 WHEN 'Property' THEN 40 ELSE 0 END DESC, no, id) AS place FROM x) WHERE place <= 5)"""
add("exact_symbols", lambda t: S.exact_symbols(X.nodes(t), t.spark.range(1).select(F.lit(0).alias("query_id"), F.lit("find NATION_3 and order_7, please").alias("text"))).select("place", "id", "name"), X.ORACLE_NODES + _EXACT + " SELECT place, id, name FROM e")
add("hybrid_search", _hybrid,
    X.ORACLE_NODES + "," + _scores(0).removeprefix("WITH") + _EXACT + """, h AS (SELECT * FROM scored WHERE s >= 0 ORDER BY s DESC, content_id LIMIT 10),
    k AS (SELECT content_id, source_path, s, row_number() OVER (ORDER BY s DESC, content_id) AS place FROM h WHERE source_path IS NOT NULL)
    SELECT * FROM (SELECT 'exact' AS kind, place, id, NULL AS path, 1.0 AS score FROM e UNION ALL SELECT 'semantic', place, content_id, source_path, round(s, 6) FROM k) ORDER BY kind, place LIMIT 10""")  # fmt: skip

# ---- statistics, registry, freshness
add("rag_stats", lambda t: ST.rag_stats(X.chunks(t)).select("total_chunks", "total_documents", "estimated_bytes", F.col("by_type")["Markdown"].alias("n_markdown")), X.ORACLE_CHUNKS + " SELECT count(*) AS total_chunks, count(DISTINCT content_id) AS total_documents, count(*) * 5072 AS estimated_bytes, count(*) FILTER (content_type = 'Markdown') AS n_markdown FROM chunks")
add("chunks_by_type", lambda t: X.chunks(t).groupBy("content_type").agg(F.count(F.lit(1)).alias("n")), X.ORACLE_CHUNKS + " SELECT content_type, count(*) AS n FROM chunks GROUP BY 1")
add("directory_stats", lambda t: ST.directory_stats(X.chunks(t), "/corpus//SRC1", "vec_id"), X.ORACLE_CHUNKS + " SELECT count(*) AS chunk_count, count(DISTINCT source_path) AS file_count, max(vec_id) AS last_indexed FROM chunks WHERE source_path ILIKE '/corpus/src1/%' HAVING count(*) > 0")


def _metadata(t: X.Tables) -> DataFrame:
    """Runs as metadata: users' events, one workspace per user number up to 20."""
    kind = F.when(F.col("event_type").isin("view", "click"), "rag").otherwise("graph")
    path = F.concat(F.lit("/corpus/src"), (F.col("user_id") % 20).cast("string"))
    e = t.events.select(path.alias("workspace_path"), kind.alias("index_type"), F.col("ts").alias("indexed_at"), F.substring(F.sha2(F.col("event_id").cast("string"), 256), 1, 40).alias("commit_sha"))
    return R.latest(e, ["workspace_path", "index_type"], "indexed_at", "commit_sha")


_META = """m AS (SELECT * EXCLUDE r FROM (SELECT *, row_number() OVER (PARTITION BY workspace_path, index_type ORDER BY indexed_at DESC, commit_sha) AS r FROM
    (SELECT '/corpus/src' || (user_id % 20) AS workspace_path, CASE WHEN event_type IN ('view', 'click') THEN 'rag' ELSE 'graph' END AS index_type, ts AS indexed_at, substring(sha256(event_id::VARCHAR), 1, 40) AS commit_sha FROM events)) WHERE r = 1)"""
add("latest_runs", _metadata, f"WITH {_META} SELECT * FROM m")
add("registry_enriched", lambda t: ST.registry_with_stats(_workspaces(t), X.chunks(t), _metadata(t)).select("path", "chunk_count", "last_indexed"),
    X.ORACLE_CHUNKS + f", {_META}, w AS (SELECT DISTINCT '/corpus/' || source AS path FROM documents) SELECT path, (SELECT count(*) FROM chunks WHERE starts_with(source_path, path)) AS chunk_count, (SELECT max(indexed_at) FROM m WHERE workspace_path = path) AS last_indexed FROM w")
add("resolve_workspaces", lambda t: ST.resolve_workspaces(_workspaces(t), ["SRC3", "src4", "none"]).select("id", "path"), "SELECT DISTINCT substring(sha256('/corpus/' || source), 1, 16) AS id, '/corpus/' || source AS path FROM documents WHERE source IN ('src3', 'src4')")


def _status(t: X.Tables) -> DataFrame:
    w = _workspaces(t).select("path", (F.length("path") == 12).alias("is_git"), F.substring(F.sha2("path", 256), 1, 40).alias("head_sha"), F.when(F.col("path") != "/corpus/src1", (F.length("path") - 12).cast("int")).alias("commits_behind"))
    return ST.index_status(w, _metadata(t), F.lit("2024-01-30 12:00:00").cast("timestamp"))


_STALE = "CASE WHEN {0}_at IS NULL THEN 'not-indexed' WHEN coalesce(CASE WHEN is_git THEN head_sha <> {0}_sha AND coalesce(commits_behind > 0, TRUE) ELSE {0}_at < TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 24 HOURS END, FALSE) THEN 'stale' ELSE 'fresh' END"
add("index_status", _status,
    f"""WITH {_META}, w AS (SELECT DISTINCT '/corpus/' || source AS path FROM documents), p AS (SELECT path, length(path) = 12 AS is_git, substring(sha256(path), 1, 40) AS head_sha, CASE WHEN path <> '/corpus/src1' THEN length(path) - 12 END AS commits_behind FROM w),
    j AS (SELECT p.*, r.indexed_at AS rag_at, r.commit_sha AS rag_sha, g.indexed_at AS graph_at, g.commit_sha AS graph_sha FROM p LEFT JOIN m r ON r.workspace_path = path AND r.index_type = 'rag' LEFT JOIN m g ON g.workspace_path = path AND g.index_type = 'graph'),
    s AS (SELECT path, {_STALE.format("rag")} AS rag_status, {_STALE.format("graph")} AS graph_status FROM j)
    SELECT *, CASE WHEN rag_status = 'not-indexed' AND graph_status = 'not-indexed' THEN 'not-indexed' WHEN rag_status = 'stale' OR graph_status = 'stale' THEN 'stale' ELSE 'fresh' END AS status FROM s""")  # fmt: skip
add("workspaces_by_access", lambda t: R.newest(_metadata(t), "indexed_at", 7, ("workspace_path", "index_type")), f"WITH {_META} SELECT * FROM m ORDER BY indexed_at DESC NULLS FIRST, workspace_path, index_type LIMIT 7")

# ---- scalars
_PATHS = "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'C:\\Work\\\\' || source || '\\' || doc_id || '.MD' WHEN 1 THEN 'file:///srv//' || source || '//' || doc_id || '.cs' WHEN 2 THEN '/Repo///' || source || '/' || doc_id || '.Cc' ELSE '://odd//' || lang END AS path FROM documents"


def _paths(t: X.Tables) -> DataFrame:
    s, d = F.col("source"), F.col("doc_id").cast("string")
    path = (
        F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("C:\\Work\\\\"), s, F.lit("\\"), d, F.lit(".MD")))
        .when(F.col("doc_id") % 4 == 1, F.concat(F.lit("file:///srv//"), s, F.lit("//"), d, F.lit(".cs")))
        .when(F.col("doc_id") % 4 == 2, F.concat(F.lit("/Repo///"), s, F.lit("/"), d, F.lit(".Cc")))
        .otherwise(F.concat(F.lit("://odd//"), "lang"))
    )
    return t.documents.select("doc_id", path.alias("path"))


_SLASHED = "lower(replace(replace(path, '\\\\', '/'), '\\', '/'))"
_NORM = f"CASE WHEN instr({_SLASHED}, '://') > 1 THEN substring({_SLASHED}, 1, instr({_SLASHED}, '://') + 2) || regexp_replace(substring({_SLASHED}, instr({_SLASHED}, '://') + 3), '/+', '/', 'g') ELSE regexp_replace({_SLASHED}, '/+', '/', 'g') END"
add("normalize_paths", lambda t: _paths(t).select("doc_id", P.normalize_path(F.col("path")).alias("norm")), f"SELECT doc_id, {_NORM} AS norm FROM ({_PATHS})")
add("workspace_ids", lambda t: _paths(t).select("doc_id", P.workspace_id(F.col("path")).alias("id"), P.is_workspace_id(P.workspace_id(F.col("path"))).alias("valid")), f"SELECT doc_id, substring(sha256({_NORM}), 1, 16) AS id, TRUE AS valid FROM ({_PATHS})")
add("glob_filter", lambda t: _paths(t).filter(P.should_include(F.col("path"), ["*.md", "*.cs"], ["**/src1/**", "**/odd"])).select("doc_id"),
    f"SELECT doc_id FROM (SELECT doc_id, lower(replace(path, '\\', '/')) AS p FROM ({_PATHS})) WHERE (ends_with(p, '.md') OR ends_with(p, '.cs')) AND NOT contains(p, '/src1/') AND NOT contains(p, 'odd')")
add("content_types", lambda t: _paths(t).select("doc_id", P.content_type(F.col("path")).alias("content_type"), P.language(F.col("path")).alias("language"), P.file_name(F.col("path")).alias("name"), P.extension(F.col("path")).alias("ext")),
    f"WITH p AS (SELECT doc_id, regexp_extract(path, '([^/\\\\]*)$', 1) AS name FROM ({_PATHS})), e AS (SELECT *, lower(CASE WHEN contains(name, '.') THEN regexp_extract(name, '\\.([^.]*)$', 1) ELSE '' END) AS ext FROM p) SELECT doc_id, CASE ext WHEN 'md' THEN 'Markdown' WHEN 'cs' THEN 'Code' ELSE 'Unknown' END AS content_type, CASE ext WHEN 'cs' THEN 'csharp' WHEN 'cc' THEN 'cpp' END AS language, name, ext FROM e")
add("translated_paths", lambda t: X.chunks(t).filter("source_path IS NOT NULL").select("content_id", P.translate_root(F.col("source_path"), F.lit("/corpus/src1"), F.lit("/tree/a")).alias("path"), P.relative_path(F.col("source_path"), F.lit("/CORPUS")).alias("rel")),
    X.ORACLE_CHUNKS + " SELECT content_id, CASE WHEN starts_with(lower(source_path), '/corpus/src1') THEN '/tree/a' || substring(source_path, 13) ELSE source_path END AS path, substring(source_path, 9) AS rel FROM chunks WHERE source_path IS NOT NULL")
_MSG = "conv_id, turn"
_MIXED = "('see FooBarBaz and IOrderService, ' || c_name || ' in HttpClient2Factory; FooBarBaz. the ' || c_mktsegment)"


def _mixed(t: X.Tables) -> DataFrame:
    return t.customer.select("c_custkey", F.concat(F.lit("see FooBarBaz and IOrderService, "), "c_name", F.lit(" in HttpClient2Factory; FooBarBaz. the "), "c_mktsegment").alias("text"))


def _arguments():  # noqa: ANN202
    """Arguments of tool calls, under one of the names of a path, under two, and malformed."""
    i = F.col("event_id").cast("string")
    forms = ['{"path": "a%s.cs"}', '{"file": "b%s", "line": 3}', '{"filePath": "c%s.md"}', '{"file": "x", "filePath": "first%s"}', "{broken %s"]
    return F.element_at(F.array(*[F.concat(*[F.lit(x) for x in f.split("%s")[:1]], i, F.lit(f.split("%s")[1])) for f in forms]), (F.col("event_id") % 5 + 1).cast("int"))


def _pascal(t: X.Tables) -> DataFrame:
    k = F.col("c_custkey")
    parts = [F.lit("Call "), F.get(F.split("c_mktsegment", " "), 0), F.lit("x FooBar"), (k % 3).cast("string"), F.lit("z then IOrder"), F.repeat(F.lit("Ab"), (k % 4).cast("int")), F.lit("Service, FooBar0z end")]
    return t.customer.select("c_custkey", F.concat(*parts).alias("text"))


add("pascal_symbols", lambda t: _pascal(t).select("c_custkey", F.array_join(T.pascal_symbols(F.col("text")), ",").alias("symbols")), 
    """WITH m AS (SELECT c_custkey, 'Call ' || string_split(c_mktsegment, ' ')[1] || 'x FooBar' || (c_custkey % 3) || 'z' || ' then I' || 'Order' || repeat('Ab', (c_custkey % 4)::INT) || 'Service, FooBar0z end' AS t FROM customer),
    x AS (SELECT c_custkey, list_distinct(['FooBar' || (c_custkey % 3) || 'z', 'IOrder' || repeat('Ab', (c_custkey % 4)::INT) || 'Service', 'FooBar0z']) AS l FROM m)
    SELECT c_custkey, array_to_string(list_transform(list_sort(list_transform(l, lambda s: {'n': -length(s), 'i': CASE WHEN s = 'FooBar' || (c_custkey % 3) || 'z' THEN 0 WHEN starts_with(s, 'IOrder') THEN 1 ELSE 2 END, 's': s})), lambda r: r.s), ',') AS symbols FROM x""")
add("symbol_candidates", lambda t: _mixed(t).select("c_custkey", F.array_join(T.symbol_candidates(F.col("text")), ",").alias("words")),
    f"SELECT c_custkey, array_to_string(list_filter(list_distinct_in_order, lambda w: length(w) >= 2 AND w NOT IN ('the', 'and', 'in') AND regexp_matches(w, '^[\\pL_][\\pL\\p{{Nd}}_]*$')), ',') AS words FROM (SELECT c_custkey, list_filter(l, lambda w, i: list_position(l, w) = i) AS list_distinct_in_order FROM (SELECT c_custkey, regexp_split_to_array({_MIXED}, '[\\s,;:()\\[\\]{{}}]+') AS l FROM customer))")
add("metadata_map", lambda t: t.events.select("event_id", T.map_int(T.json_map(F.col("props")), "k").alias("k"), T.map_int(T.merged_map(T.json_map(F.col("props")), F.create_map(F.lit("k"), F.lit("7"))), "k").alias("merged"), T.json_path_field(_arguments()).alias("path")),
    "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, 7 AS merged, CASE event_id % 5 WHEN 0 THEN 'a' || event_id || '.cs' WHEN 1 THEN 'b' || event_id WHEN 2 THEN 'c' || event_id || '.md' WHEN 3 THEN 'first' || event_id END AS path FROM events")
add("text_scalars", lambda t: t.part.select("p_partkey", T.truncate(F.col("p_name"), 10).alias("cut"), T.namespace_of(F.concat("p_brand", F.lit("."), "p_type")).alias("ns"), T.accessibility(F.element_at(F.array(*map(F.lit, ["static public", "protected internal", "internal sealed", "private", "", "override"])), (F.col("p_partkey") % 6 + 1).cast("int"))).alias("access"), T.is_primitive(F.when(F.col("p_size") % 2 == 0, F.lit("Int[]?")).otherwise(F.col("p_brand"))).alias("primitive"), T.budget_band(F.col("p_size") * 2).alias("band"), T.severity_priority(F.when(F.col("p_size") > 25, "ERROR").otherwise("info")).alias("priority"), T.node_label(F.col("p_brand")).alias("label"), T.short_sha(F.sha2("p_name", 256)).alias("sha"), T.progress_percent(F.col("p_size"), F.lit(60)).alias("percent"), T.base_type(F.concat("p_brand", F.lit("<int>[]?"))).alias("base")),
    "SELECT p_partkey, CASE WHEN length(p_name) > 10 THEN substring(p_name, 1, 7) || '...' ELSE p_name END AS cut, CASE WHEN contains(p_brand || '.' || p_type, '.') THEN regexp_replace(p_brand || '.' || p_type, '\\.[^.]*$', '') END AS ns, CASE p_partkey % 6 WHEN 0 THEN 'public' WHEN 1 THEN 'protected' WHEN 2 THEN 'internal' ELSE 'private' END AS access, p_size % 2 = 0 AS primitive, CASE WHEN p_size * 2 >= 90 THEN 'complete_now' WHEN p_size * 2 >= 70 THEN 'spawn_subagent' WHEN p_size * 2 >= 50 THEN 'summarize' ELSE 'continue' END AS band, CASE WHEN p_size > 25 THEN 'High' ELSE 'Low' END AS priority, regexp_replace(p_brand, '[^\\pL\\p{Nd}_]', '', 'g') AS label, substring(sha256(p_name), 1, 7) AS sha, (p_size * 100) // 60 AS percent, p_brand AS base FROM part")
add("first_sentences", lambda t: t.documents.select("doc_id", T.first_sentence(F.col("text")).alias("first"), F.length(T.embedding_input(F.col("text"))).alias("n_input")),
    "SELECT doc_id, CASE WHEN instr(text, '.') > 1 AND instr(text, '.') <= 200 THEN substring(text, 1, instr(text, '.')) WHEN length(trim(split_part(text, chr(10), 1))) > 200 THEN substring(trim(split_part(text, chr(10), 1)), 1, 200) || '...' ELSE trim(split_part(text, chr(10), 1)) END AS first, least(length(text), 30000)::INT AS n_input FROM documents")

# ---- pages and papers
_DECODE = "replace(replace(replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')"
_BARE = _DECODE.format("regexp_replace(regexp_replace(regexp_replace(html, '<script[^>]*>.*?</script>', ' ', 'gis'), '<style[^>]*>.*?</style>', ' ', 'gis'), '<[^>]+>', ' ', 'g')")
add("html_text", lambda t: t.pages.select("page_id", F.sha2(T.html_text(F.col("html")), 256).alias("text_sha256")), f"SELECT page_id, sha256(trim(regexp_replace({_BARE}, '[ \\t\\n\\r\\f]+', ' ', 'g'))) AS text_sha256 FROM pages")


def _first_group(p: str) -> str:
    return "nullif(trim(" + _DECODE.format(f"regexp_replace(regexp_extract(html, '{p}', 1, 'is'), '<[^>]+>', '', 'g')") + "), '')"


add("html_title", lambda t: t.pages.select("page_id", T.html_title(F.col("html")).alias("title"), T.html_author(F.col("html")).alias("author")),
    "SELECT page_id, coalesce(" + ", ".join(map(_first_group, ["<title[^>]*>(.*?)</title>", '<meta[^>]*property=["'']og:title["''][^>]*content=["'']([^"'']*)["'']'.replace("['", "[''").replace("\"']", "\"'']"), "<h1[^>]*>(.*?)</h1>"])) + ") AS title, " + _first_group('<meta[^>]*name="author"[^>]*content="([^"]*)"') + " AS author FROM pages")
add("source_dispatch", lambda t: RS.dispatch(t.pages.select("page_id", "url")).select("page_id", "fetcher"), "SELECT page_id, CASE WHEN contains(lower(url), 'arxiv.org') THEN 'arxiv' WHEN contains(lower(url), 'semanticscholar.org') THEN 'paper' WHEN ends_with(lower(url), '.pdf') THEN 'pdf' WHEN regexp_matches(lower(url), '^https?://') THEN 'web' END AS fetcher FROM pages")


def _federated(t: X.Tables) -> DataFrame:
    a = t.supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("source_id"), F.col("s_name").alias("title"), F.col("s_nationkey").alias("citation_count"))
    b = t.customer.select(F.concat(F.lit("c"), "c_custkey").alias("source_id"), F.col("c_name").alias("title"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_nationkey")).alias("citation_count"))
    return R.federated_search([a, b, a], 25)


add("federated_search", _federated, "SELECT * FROM (SELECT 's' || s_suppkey AS source_id, s_name AS title, s_nationkey AS citation_count FROM supplier UNION ALL SELECT 'c' || c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN c_nationkey END FROM customer UNION ALL SELECT 's' || s_suppkey, s_name, s_nationkey FROM supplier) ORDER BY coalesce(citation_count, 0) DESC, title, source_id LIMIT 25")

# ---- texts
add("paragraph_chunks", lambda t: C.paragraph_chunks(t.documents.withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n"))), "text", ["doc_id"]).select("doc_id", "chunk_index", F.sha2("text", 256).alias("sha"), "title"),
    """WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda p: trim(p, ' ' || chr(9) || chr(10) || chr(13))), lambda p: p <> '') AS l FROM documents)
    SELECT doc_id, (i - 1)::INTEGER AS chunk_index, sha256(l[i]) AS sha, array_to_string(list_filter(regexp_split_to_array(l[i], '[ \\n\\r\\t]+'), lambda w: w <> '')[1:5], ' ') AS title FROM p, unnest(range(1, len(l) + 1)) AS u(i)""")  # fmt: skip


def _files(t: X.Tables) -> DataFrame:
    return t.documents.select(F.concat(F.lit("/corpus/"), "source", F.lit("/"), "doc_id", F.lit(".txt")).alias("path"), F.col("text").alias("content"))


_FILES = "f AS (SELECT '/corpus/' || source || '/' || doc_id || '.txt' AS path, text AS content FROM documents)"
_GREP = f"WITH {_FILES}, g AS (SELECT path, i AS line_number, trim(l[i]) AS line FROM (SELECT path, string_split(content, chr(10)) AS l FROM f), unnest(range(1, len(l) + 1)) AS u(i)), h AS (SELECT path, line_number::INTEGER AS line_number, CASE WHEN length(line) > 120 THEN substring(line, 1, 120) || '...' ELSE line END AS preview FROM g WHERE contains(lower(line), 'licen'))"
add("grep_lines", lambda t: L.grep(_files(t), "LICEN"), _GREP + " SELECT * FROM h ORDER BY path, line_number LIMIT 50")
add("grep_all", lambda t: L.hits(_files(t), "LICEN"), _GREP + " SELECT * FROM h")
add("grep_capped", lambda t: L.capped(L.hits(_files(t), "LICEN"), ["path", "line_number"], 5).select("path", "line_number", "truncated"), _GREP + " SELECT path, line_number, (SELECT count(*) FROM h) >= 5 AS truncated FROM h ORDER BY path, line_number LIMIT 5")
add("line_ranges", lambda t: _files(t).select("path", F.sha2(L.line_range(F.col("content"), 1, 4), 256).alias("sha")), f"WITH {_FILES} SELECT path, sha256(array_to_string(string_split(content, chr(10))[2:4], chr(10))) AS sha FROM f")
add("list_files", lambda t: L.list_files(_files(t), P.matches_glob(F.col("path"), "**/src1/**"), 20), f"WITH {_FILES} SELECT path FROM f WHERE contains(path, '/src1/') ORDER BY path LIMIT 20")
add("symbol_usages", lambda t: Y.usages(_files(t), "License").select("path", "line_number"), f"WITH {_FILES}, g AS (SELECT path, i AS line_number, l[i] AS line FROM (SELECT path, string_split(content, chr(10)) AS l FROM f), unnest(range(1, len(l) + 1)) AS u(i)) SELECT path, line_number::INTEGER AS line_number FROM g WHERE regexp_matches(line, '\\bLicense\\b') ORDER BY path, line_number LIMIT 50")
add("pdf_pages", lambda t: RS.pdf_pages(t.documents.withColumn("text", F.replace("text", F.lit("\n"), F.lit("\f"))), ["doc_id"]).select("doc_id", "page", F.sha2("content", 256).alias("sha")), "SELECT doc_id, i::INTEGER AS page, sha256(l[i]) AS sha FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), unnest(range(1, len(l) + 1)) AS u(i) WHERE trim(l[i]) <> ''")

# ---- mutations


def _new_chunks(t: X.Tables) -> DataFrame:
    """Messages as rows for contents doc:0, doc:1, ... in order of turns."""
    c = t.conversations
    return c.select(F.concat(F.lit("doc:"), "conv_id").alias("content_id"), F.col("text").alias("content"), "turn")


_OLD = "o AS (SELECT content_id, chunk_index, content FROM chunks)"
_NEW = "n AS (SELECT 'doc:' || conv_id AS content_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INTEGER AS chunk_index, text AS content FROM conversations)"
_OUT = "SELECT content_id, chunk_index, sha256(coalesce(content, '')) AS sha FROM"


def _sha(df: DataFrame) -> DataFrame:
    return df.select("content_id", "chunk_index", F.sha2(F.coalesce("content", F.lit("")), 256).alias("sha"))


def _old(t: X.Tables) -> DataFrame:
    return X.chunks(t).select("content_id", "chunk_index", "content")


_REPLACED = f"{X.ORACLE_CHUNKS}, {_OLD}, {_NEW} {_OUT} (SELECT * FROM o WHERE content_id NOT IN (SELECT content_id FROM n) UNION ALL SELECT * FROM n)"
add("batch_upsert", lambda t: _sha(M.index_batch(_old(t), _new_chunks(t), "turn")), _REPLACED)
add("replace_content", lambda t: _sha(M.replace_content(_old(t), _new_chunks(t).withColumn("chunk_index", (F.row_number().over(Window.partitionBy("content_id").orderBy("turn")) - 1).cast("int")))), _REPLACED)
add("index_many_last_wins", lambda t: M.latest_per_key(t.conversations.select("conv_id", "turn", "role"), "conv_id", "turn"), "SELECT conv_id, turn, role FROM conversations QUALIFY turn = max(turn) OVER (PARTITION BY conv_id)")
add("delete_content", lambda t: _sha(M.delete_content(_old(t), "doc:3")), f"{X.ORACLE_CHUNKS}, {_OLD} {_OUT} o WHERE content_id <> 'doc:3'")
add("delete_prefix", lambda t: M.delete_prefix(X.chunks(t), "/corpus/src1").select("content_id"), X.ORACLE_CHUNKS + " SELECT content_id FROM chunks WHERE NOT coalesce(starts_with(source_path, '/corpus/src1'), FALSE)")
add("clear_repo_nodes", lambda t: M.clear_repository(X.nodes(t), X.edges(t), "/repo/asia")[0].select("id"), X.ORACLE_NODES + " SELECT id FROM nodes WHERE NOT repository_path ILIKE '/repo/asia'")
add("clear_repo_graph", lambda t: M.clear_repository(X.nodes(t), X.edges(t), "/repo/asia")[1].select("edge_type", "source_id", "target_id"), X.ORACLE_GRAPH + ", d AS (SELECT id FROM nodes WHERE repository_path ILIKE '/repo/asia') SELECT edge_type, source_id, target_id FROM edges WHERE source_id NOT IN (SELECT id FROM d) AND target_id NOT IN (SELECT id FROM d)")
add("metadata_upsert", lambda t: M.upsert(_metadata(t), _metadata(t).filter("index_type = 'rag'").withColumn("commit_sha", F.lit("new")), ["workspace_path", "index_type"]), f"WITH {_META} SELECT workspace_path, index_type, indexed_at, CASE WHEN index_type = 'rag' THEN 'new' ELSE commit_sha END AS commit_sha FROM m")
add("cascade_delete", lambda t: M.delete_with_children(t.orders, t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", 7)[1].agg(F.count(F.lit(1)).alias("n")), "SELECT count(*) AS n FROM lineitem WHERE l_orderkey <> 7")


def _registry_change(t: X.Tables) -> DataFrame:
    ws = _workspaces(t)
    more = t.spark.createDataFrame([("feed", "/feed", "NEWS", ["x"]), ("feed2", "/g", "news", ["x"]), ("other", "/h", "src1", ["y"])], "id string, path string, alias string, tags array<string>")
    return M.remove_workspace(M.add_workspace(ws, more), "SRC0").select("path", "alias", "is_default")


add("registry_change", _registry_change, "SELECT path, alias, path = '/corpus/src1' AS is_default FROM (SELECT DISTINCT '/corpus/' || source AS path, upper(source) AS alias FROM documents WHERE source <> 'src0' UNION ALL SELECT '/feed', 'NEWS')")

# ---- traces
_W = ["ts", "seq"]
_SEM, _FIL, _EDI = "tool_name = 'search_code'", "tool_name IN ('file_read', 'grep')", "tool_name = 'file_edit'"
_OK = "(trim(result) <> '' AND NOT starts_with(lower(trim(result)), 'error') AND NOT contains(lower(result), 'not found') AND length(trim(result)) > 10)"
add("trace_ratio", lambda t: TR.semantic_ratio(X.trace(t)), X.ORACLE_TRACE + f", c AS (SELECT trace_id, count(*) FILTER ({_SEM}) AS semantic, count(*) FILTER ({_FIL}) AS file_level FROM trace GROUP BY 1) SELECT *, CASE WHEN semantic + file_level > 0 THEN round_even(semantic / (semantic + file_level), 3) ELSE 0.0 END AS ratio FROM c")
add("trace_fishing", lambda t: TR.fishing(X.trace(t), _W, 3), X.ORACLE_TRACE + f", i AS (SELECT *, sum(({_SEM})::INT) OVER (PARTITION BY trace_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS i FROM trace), n AS (SELECT trace_id, i, count(*) FILTER ({_FIL}) AS n FROM i GROUP BY ALL) SELECT trace_id, max(n) AS longest_run, max(n) >= 3 AS fishing FROM n GROUP BY 1")
add("trace_direct", lambda t: TR.direct_edits(X.trace(t), _W), X.ORACLE_TRACE + f", l AS (SELECT *, lead(tool_name) OVER (PARTITION BY trace_id ORDER BY ts, seq) AS nx FROM trace) SELECT trace_id, count(*) FILTER ({_SEM} AND nx = 'file_edit') AS direct FROM l GROUP BY 1")
add("trace_guessing", lambda t: TR.guessing(X.trace(t)), X.ORACLE_TRACE + f" SELECT trace_id, bool_or(tool_name = 'grep') AND NOT bool_or({_SEM}) AS guessing FROM trace GROUP BY 1")
_FIRST = f"r AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY ts, seq) AS r FROM trace), fh AS (SELECT trace_id, coalesce(min(r) FILTER ({_EDI} OR ({_SEM} AND {_OK})), count(*)) AS steps_to_target FROM r GROUP BY 1)"
add("trace_first_hit", lambda t: TR.first_hit(X.trace(t), _W), f"{X.ORACLE_TRACE}, {_FIRST} SELECT * FROM fh")
_BACK = f"bk AS (SELECT DISTINCT trace_id, lower(path) AS path FROM trace a WHERE tool_name = 'file_read' AND NOT EXISTS (SELECT 1 FROM trace b WHERE b.trace_id = a.trace_id AND lower(b.path) = lower(a.path) AND b.tool_name = 'file_edit'))"
add("trace_backtracking", lambda t: TR.backtracking(X.trace(t)), f"{X.ORACLE_TRACE}, {_BACK} SELECT * FROM bk")
add("trace_effectiveness", lambda t: TR.effectiveness(X.trace(t), _W).select("trace_id", "semantic", "file_level", "steps_to_target", "backtracking"), f"{X.ORACLE_TRACE}, {_FIRST}, {_BACK}, c AS (SELECT trace_id, count(*) FILTER ({_SEM}) AS semantic, count(*) FILTER ({_FIL}) AS file_level FROM trace GROUP BY 1) SELECT c.*, steps_to_target, (SELECT count(*) FROM bk WHERE bk.trace_id = c.trace_id) AS backtracking FROM c JOIN fh USING (trace_id)")
add("outcome_counts", lambda t: TR.outcome_counts(X.trace(t).withColumn("success", TR.is_success(F.col("result")))), f"{X.ORACLE_TRACE} SELECT count(*) FILTER ({_OK}) AS passed, count(*) FILTER (NOT {_OK}) AS failed, count(*) AS total FROM trace")

# ---- stories, agents, sources


def _steps(t: X.Tables) -> DataFrame:
    return t.lineitem.select(F.col("l_orderkey").alias("story_id"), (F.col("l_linenumber") % 3).alias("wave"), F.col("l_linenumber").alias("order"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("step_id"), F.when(F.col("l_linestatus") == "F", "Completed").otherwise("Pending").alias("status"), (F.col("l_returnflag") == "R").alias("needs_rework"))


def _stories(t: X.Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("story_id"), (F.col("o_orderkey") % 3).cast("int").alias("current_wave"), F.col("o_orderstatus").alias("status"), F.concat(F.lit("C:\\Repo\\"), F.col("o_orderkey") % 5).alias("repository_path"))


_STEPS = "st AS (SELECT l_orderkey AS story_id, l_linenumber % 3 AS wave, l_linenumber AS \"order\", l_orderkey || '-' || l_linenumber AS step_id, CASE WHEN l_linestatus = 'F' THEN 'Completed' ELSE 'Pending' END AS status, l_returnflag = 'R' AS needs_rework FROM lineitem)"
add("steps_nested", lambda t: R.with_steps(_stories(t), _steps(t).select("story_id", "order", "step_id"), "story_id", ["order", "step_id"]).select("story_id", F.array_join(F.transform("steps", lambda s: s["step_id"]), ",").alias("steps")), f"WITH {_STEPS} SELECT o_orderkey AS story_id, coalesce(string_agg(step_id, ',' ORDER BY \"order\", step_id), '') AS steps FROM orders LEFT JOIN st ON story_id = o_orderkey GROUP BY 1")
add("stories_filtered", lambda t: R.stories_of(_stories(t), "O", "C:/repo/3").select("story_id"), "SELECT o_orderkey AS story_id FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 5 = 3")
add("pending_steps", lambda t: R.pending_steps(_steps(t)).select("step_id"), f"WITH {_STEPS} SELECT step_id FROM st WHERE status = 'Pending' OR needs_rework")
add("wave_summary", lambda t: R.wave_summary(_steps(t)), f"WITH {_STEPS} SELECT story_id, max(wave) AS waves, max(\"order\") + 1 AS next_order, bool_and(status = 'Completed') AS complete FROM st GROUP BY 1")
add("wave_schedule", lambda t: R.schedule_wave(_stories(t), _steps(t)).select("story_id", "wave", F.array_join("step_ids", ",").alias("steps"), "prior_done", "action"),
    f"""WITH {_STEPS}, g AS (SELECT story_id, o_orderkey % 3 AS cw, coalesce(string_agg(step_id, ',' ORDER BY step_id) FILTER (wave = o_orderkey % 3 AND status = 'Pending'), '') AS steps, bool_and(wave >= o_orderkey % 3 OR status = 'Completed') AS prior_done, max(wave) AS waves FROM st JOIN orders ON o_orderkey = story_id GROUP BY ALL),
    a AS (SELECT *, CASE WHEN NOT prior_done THEN 'blocked' WHEN steps <> '' THEN 'run' WHEN cw >= waves THEN 'finished' ELSE 'advance' END AS action FROM g) SELECT story_id, CASE WHEN action = 'advance' THEN cw + 1 ELSE cw END AS wave, steps, prior_done, action FROM a""")  # fmt: skip
add("verification_summary", lambda t: R.verification_summary(t.lineitem.select(F.element_at(F.array(*map(F.lit, ["build", "test", "lint", "format"])), (F.col("l_linenumber") % 4 + 1).cast("int")).alias("step_type"), (F.col("l_returnflag") != "R").alias("success"), (F.col("l_tax") > 0.04).alias("required"))),
    "WITH v AS (SELECT ['build', 'test', 'lint', 'format'][l_linenumber % 4 + 1] AS k, l_returnflag <> 'R' AS ok, l_tax > 0.04 AS req FROM lineitem) SELECT count(*) FILTER (NOT ok AND k = 'build') AS build_failures, count(*) FILTER (NOT ok AND k = 'test') AS test_failures, count(*) FILTER (NOT ok AND k IN ('lint', 'format')) AS style_failures, count(*) FILTER (NOT ok AND req) AS required_failures, count(*) FILTER (ok) AS passed FROM v")
add("excerpts_sorted", lambda t: R.excerpts_in_order(t.lineitem.select(F.col("l_orderkey").alias("source_id"), F.when(F.col("l_linenumber") > 1, F.col("l_linenumber")).alias("page"), F.col("l_shipdate").alias("created_at")), 3).withColumn("place", F.row_number().over(Window.partitionBy("source_id").orderBy(F.asc_nulls_last("page"), "created_at"))),
    "SELECT l_orderkey AS source_id, CASE WHEN l_linenumber > 1 THEN l_linenumber END AS page, l_shipdate AS created_at, row_number() OVER (ORDER BY CASE WHEN l_linenumber > 1 THEN l_linenumber END NULLS LAST, l_shipdate) AS place FROM lineitem WHERE l_orderkey = 3")
add("sources_with_excerpts", lambda t: R.sources_with_excerpts(t.customer.select(F.col("c_custkey").alias("source_id"), "c_name"), t.orders.select(F.col("o_custkey").alias("source_id"), "o_orderkey")), "SELECT c_custkey AS source_id, c_name, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey")


def _tagged(t: X.Tables) -> DataFrame:
    return t.part.select("p_partkey", F.split("p_type", " ").alias("tags"), F.col("p_brand").alias("source_type"), F.lit("ready").alias("status"))


_TAGS = "SELECT p_partkey FROM part WHERE list_has_any(string_split(p_type, ' '), {0})"
add("tag_overlap", lambda t: R.filter_sources(_tagged(t), None, "ready", ["ECONOMY", "PROMO", "promo"]).select("p_partkey"), _TAGS.format("['ECONOMY', 'PROMO', 'promo']"))
add("tag_overlap_any_case", lambda t: R.tagged(_tagged(t), ["economy", "Promo"], any_case=True).select("p_partkey"), "SELECT p_partkey FROM part WHERE list_has_any(string_split(lower(p_type), ' '), ['economy', 'promo'])")


def _agents(t: X.Tables) -> DataFrame:
    caps = F.when(F.col("s_suppkey") % 3 == 0, F.array(F.lit("Coding"))).when(F.col("s_suppkey") % 3 == 1, F.array(F.lit("ingest:*"))).otherwise(F.array(F.lit("ingest:cs"), F.lit("coding")))
    langs = F.when(F.col("s_suppkey") % 2 == 0, F.array(F.lit("csharp")))
    return t.supplier.select(F.col("s_suppkey").alias("agent_id"), caps.alias("capabilities"), langs.alias("languages"), F.col("s_nationkey").alias("priority"))


add("capable_agents", lambda t: R.capable_agents(_agents(t), "CODING", "CSharp").select("agent_id"), "SELECT s_suppkey AS agent_id FROM supplier WHERE s_suppkey % 3 IN (0, 2)")
add("best_agent", lambda t: R.best_agent(_agents(t), "ingest:CS").select("agent_id", "tier"), "SELECT s_suppkey AS agent_id, CASE s_suppkey % 3 WHEN 2 THEN 0 ELSE 1 END AS tier FROM supplier WHERE s_suppkey % 3 > 0 ORDER BY 2, s_nationkey, 1 LIMIT 1")
add("lookup_by_id", lambda t: R.by_id(t.orders, "o_orderkey", 7).select("o_orderkey", "o_totalprice"), "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 7")
add("token_estimate", lambda t: R.token_estimate(t.conversations, "text"), "SELECT sum(length(text))::BIGINT // 4 AS tokens FROM conversations")
add("vanished_ids", lambda t: R.vanished(t.part.select(F.col("p_partkey").alias("id")), t.supplier.select(F.col("s_suppkey").alias("id")), t.customer.select(F.col("c_custkey").alias("id"))), "SELECT p_partkey AS id FROM part EXCEPT SELECT s_suppkey FROM supplier EXCEPT SELECT c_custkey FROM customer")
add("overlays", lambda t: R.resolve_overlays(t.nation.select(F.col("n_name").alias("name")), t.customer.select(F.concat(F.lit("NATION_"), F.col("c_nationkey") + 5).alias("name"), F.col("c_mktsegment").alias("language"))).select("name", F.array_join("languages", ",").alias("languages"), "has_base"),
    "WITH o AS (SELECT 'NATION_' || (c_nationkey + 5) AS name, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS languages FROM customer GROUP BY 1) SELECT coalesce(n_name, name) AS name, coalesce(languages, '') AS languages, n_name IS NOT NULL AS has_base FROM (SELECT DISTINCT n_name FROM nation) FULL JOIN o ON n_name = name")
add("distinct_on", lambda t: R.first_per_key(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")]), "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")

# ---- trees and symbols


def _tree_chunks(t: X.Tables) -> DataFrame:
    """Classes as type chunks with their methods, a file per nation."""
    path = F.concat(F.lit("src/n"), F.col("c_nationkey").cast("string"), F.lit(".cs"))
    none = F.lit(None).cast("string")
    a = t.customer.select(path.alias("rel_path"), F.lit("class").alias("chunk_type"), F.col("c_name").alias("symbol"), none.alias("parent"), F.col("c_name").alias("title"), F.concat(F.lit("class "), "c_name").alias("signature"), F.col("c_custkey").cast("int").alias("start_line"))
    m = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    name = F.concat(F.lit("m"), F.col("o_orderkey").cast("string"))
    b = m.select(path.alias("rel_path"), F.lit("method").alias("chunk_type"), name.alias("symbol"), F.when(F.col("o_orderkey") % 4 > 0, F.col("c_name")).alias("parent"), F.concat_ws(".", "c_name", name).alias("title"), none.alias("signature"), F.col("o_orderkey").cast("int").alias("start_line"))
    return a.unionByName(b).withColumn("content", F.col("title"))


_TREE = """c AS (SELECT 'src/n' || c_nationkey || '.cs' AS f, c_name FROM customer), m AS (SELECT f, c_name, 'm' || o_orderkey AS name, o_orderkey % 4 = 0 AS loose FROM orders JOIN customer ON o_custkey = c_custkey JOIN c USING (c_name)),
    n AS (SELECT 'folder:src' AS node_id, NULL AS parent_id, 'folder' AS kind, 'src' AS name, 0 AS depth UNION ALL SELECT DISTINCT 'file:' || f, 'folder:src', 'file', substring(f, 5), 1 FROM c
    UNION ALL SELECT 'type:' || f || ':' || c_name, 'file:' || f, 'type', c_name, 2 FROM c UNION ALL SELECT 'function:' || f || ':' || name, 'file:' || f, 'function', name, 2 FROM m WHERE loose
    UNION ALL SELECT 'method:' || f || ':' || name, 'type:' || f || ':' || c_name, 'method', name, 3 FROM m)"""
add("tree_nodes", lambda t: TREE.tree_rows(_tree_chunks(t)).select("node_id", "parent_id", "kind", "name", "depth"), f"WITH {_TREE} SELECT * FROM n")
add("tree_count", lambda t: TREE.node_count(TREE.tree_rows(_tree_chunks(t), 2)), f"WITH {_TREE} SELECT count(*) AS nodes FROM n WHERE depth < 3")
add("tree_nested", lambda t: TREE.tree_nested(_tree_chunks(t)).select("rel_path", F.size("types").alias("n_types"), F.aggregate("types", F.lit(0), lambda s, x: s + F.size(x["members"])).alias("n_members")), f"WITH {_TREE} SELECT f AS rel_path, count(DISTINCT c_name)::INT AS n_types, (SELECT count(*) FROM m WHERE m.f = c.f)::INT AS n_members FROM c GROUP BY f")
add("tree_node_content", lambda t: TREE.node_content(_tree_chunks(t), "type:src/n3.cs:Customer#000000007").unionByName(TREE.node_content(_tree_chunks(t), "file:src/n4.cs")).select("rel_path", "title"),
    "SELECT * FROM (SELECT 'src/n' || c_nationkey || '.cs' AS rel_path, c_name AS title FROM customer WHERE c_nationkey = 3 AND c_name = 'Customer#000000007') UNION ALL SELECT * FROM (SELECT 'src/n4.cs', t FROM (SELECT c_name AS t, c_custkey AS s FROM customer WHERE c_nationkey = 4 UNION ALL SELECT c_name || '.m' || o_orderkey, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 4) ORDER BY s LIMIT 1)")


def _symbol_table(t: X.Tables) -> DataFrame:
    return t.part.select(
        F.col("p_name").alias("name"), F.when(F.col("p_size") % 2 == 0, "Method").otherwise("Class").alias("kind"), F.col("p_type").alias("return_type"), F.split("p_type", " ").alias("attributes"),
        F.concat("p_brand", F.lit("<int>?")).alias("first_parameter"), (F.col("p_size") > 10).alias("is_static"), F.concat(F.lit("f"), F.col("p_partkey") % 9).alias("file_path"), F.col("p_partkey").alias("line_number"), F.col("p_brand").alias("namespace"),
    )


_SYM = "sy AS (SELECT p_name AS name, p_size, p_type, p_brand, 'f' || (p_partkey % 9) AS file_path, p_partkey AS line_number FROM part)"


def _sym_sql(where: str, cap: int = 100) -> str:
    return f"WITH {_SYM}, k AS (SELECT name, file_path, line_number FROM sy WHERE {where} ORDER BY file_path, line_number, name LIMIT {cap}) SELECT *, (SELECT count(*) FROM k) >= {cap} AS truncated FROM k"


_SC = ("name", "file_path", "line_number", "truncated")
add("symbols_by_attribute", lambda t: Y.by_attribute(_symbol_table(t), "economyAttribute").select(*_SC), _sym_sql("list_contains(list_transform(string_split(lower(p_type), ' '), lambda x: contains(x, 'economy')), TRUE)"))
add("symbols_by_return_type", lambda t: Y.by_return_type(_symbol_table(t), "Promo", 20).select(*_SC), _sym_sql("contains(lower(p_type), 'promo')", 20))
add("extension_methods", lambda t: Y.extension_methods(_symbol_table(t), "brand#13").select(*_SC), _sym_sql("p_size > 10 AND p_size % 2 = 0 AND lower(p_brand) = 'brand#13'"))
add("list_types", lambda t: Y.list_types(_symbol_table(t), "BRAND#1", None, ["Class"]).select(*_SC), _sym_sql("p_size % 2 = 1 AND contains(lower(p_brand), 'brand#1')"))

# ---- changes and jobs
add("changes", X.changes, X.ORACLE_CHANGES + " SELECT ts, event_id, change_type, path FROM changes")
add("windowed_changes", lambda t: J.windowed_counts(t.events, "6 hours"), "SELECT time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n FROM events GROUP BY ALL")


def _session(t: X.Tables) -> DataFrame:
    c = X.changes(t).withColumn("gap", (F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(Window.partitionBy("path").orderBy("ts", "event_id")))) > 3_600_000_000)
    s = c.withColumn("session", F.sum(F.coalesce(F.col("gap").cast("int"), F.lit(0))).over(Window.partitionBy("path").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy("path", "session").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("n"))


add("change_sessions", _session, X.ORACLE_CHANGES + ", g AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY path ORDER BY ts, event_id) > INTERVAL 1 HOUR, FALSE) AS gap FROM changes), s AS (SELECT *, sum(gap::INT) OVER (PARTITION BY path ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT path, session, min(ts) AS start, max(ts) AS \"end\", count(*) AS n FROM s GROUP BY ALL")
add("debounce_batch", lambda t: CH.debounce_batch(X.changes(t).withColumn("workspace", F.concat(F.lit("w"), F.col("event_id") % 16)), 600_000),
    X.ORACLE_CHANGES.replace("WITH changes", "WITH RECURSIVE changes") + """, e AS (SELECT 'w' || (event_id % 16) AS workspace, epoch_us(ts) // 1000 AS ms, change_type || ':' || path AS key FROM changes),
    n AS (SELECT *, row_number() OVER (PARTITION BY workspace ORDER BY ms, key) AS i FROM e),
    r(workspace, i, pending, first, last, out, out_first, out_last) AS (
      SELECT workspace, 0::BIGINT, []::VARCHAR[], 0::BIGINT, 0::BIGINT, []::VARCHAR[], 0::BIGINT, 0::BIGINT FROM (SELECT DISTINCT workspace FROM e)
      UNION ALL SELECT r.workspace, r.i + 1,
        CASE WHEN n.i IS NULL THEN [] WHEN len(r.pending) > 0 AND n.ms >= r.last + 600000 THEN [n.key] WHEN list_contains(r.pending, n.key) THEN r.pending ELSE list_append(r.pending, n.key) END,
        CASE WHEN len(r.pending) = 0 OR n.ms >= r.last + 600000 THEN n.ms ELSE r.first END,
        CASE WHEN len(r.pending) > 0 AND n.ms < r.last + 600000 AND list_contains(r.pending, n.key) THEN r.last ELSE n.ms END,
        CASE WHEN n.i IS NULL OR len(r.pending) > 0 AND n.ms >= r.last + 600000 THEN r.pending ELSE [] END, r.first, r.last
      FROM r LEFT JOIN n ON n.workspace = r.workspace AND n.i = r.i + 1 WHERE n.i IS NOT NULL OR len(r.pending) > 0)
    SELECT workspace, make_timestamp(out_first * 1000) AS batch_start, make_timestamp(out_last * 1000) AS batch_end, string_split(k, ':')[1] AS change_type, substring(k, instr(k, ':') + 1) AS path FROM r, unnest(out) AS u(k)""")  # fmt: skip
add("job_states", lambda t: ST.latest_job_state(t.events.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("state"), (F.col("event_id") % 7).alias("processed"), F.lit(7).alias("total"), F.lit(0).alias("failed"))),
    "SELECT user_id AS job_id, arg_max(event_type, event_id) AS state, max(event_id) % 7 AS processed, 7 AS total, 0 AS failed, ((max(event_id) % 7) * 100 // 7)::INT AS percent FROM events GROUP BY 1")
add("job_final_states", lambda t: J.final_state(t.events.select(F.col("user_id").alias("job_id"), F.when(F.col("event_type") == "error", "x").alias("error"), (F.col("value") > 140).alias("cancelled"))),
    "WITH j AS (SELECT user_id AS job_id, count(*) FILTER (event_type <> 'error') AS processed, count(*) FILTER (event_type = 'error') AS failed, bool_or(value > 140) AS c FROM events GROUP BY 1) SELECT job_id, CASE WHEN c THEN 'Cancelled' WHEN processed = 0 AND failed > 0 THEN 'Failed' ELSE 'Completed' END AS state, processed, failed FROM j")


def _requests(t: X.Tables) -> tuple[DataFrame, DataFrame]:
    r = t.events.filter("event_type = 'view'").select(F.concat(F.lit("r"), "event_id").alias("job_id"), F.concat(F.lit("\\W\\"), F.col("user_id") % 30).alias("path"), F.col("ts").alias("requested_at"))
    j = t.events.filter("event_type = 'click'").select(F.concat(F.lit("j"), "event_id").alias("job_id"), F.concat(F.lit("/w/"), F.col("user_id") % 50).alias("path"), F.when(F.col("event_id") % 2 == 0, "Queued").otherwise("Completed").alias("state"))
    return r, j


add("job_dedupe", lambda t: J.without_active(*_requests(t)).select("job_id", "run_by"),
    "WITH r AS (SELECT 'r' || event_id AS job_id, '/w/' || (user_id % 30) AS p, ts FROM events WHERE event_type = 'view'), a AS (SELECT '/w/' || (user_id % 50) AS p, min('j' || event_id) AS id FROM events WHERE event_type = 'click' AND event_id % 2 = 0 GROUP BY 1) SELECT job_id, coalesce(a.id, first_value(job_id) OVER (PARTITION BY r.p ORDER BY ts, job_id)) AS run_by FROM r LEFT JOIN a ON a.p = r.p")
add("schedules_due", lambda t: J.due(t.events.select(F.col("event_id").alias("name"), F.col("ts").alias("next_run"), F.lit(90).alias("every_minutes")), F.lit("2024-01-10 00:00:00").cast("timestamp")).select("name"), "SELECT event_id AS name FROM events WHERE ts <= TIMESTAMP '2024-01-10'")

# ---- chunkers and embedding, without SQL


def _ingested(t: X.Tables) -> DataFrame:
    ext = F.element_at(F.array(*map(F.lit, ["md", "txt", "py", "cs", "ts", "go", "rb"])), (F.col("doc_id") % 7 + 1).cast("int"))
    return C.ingest(t.documents.select(F.concat(F.lit("/c/"), "doc_id", F.lit("."), ext).alias("path"), F.col("text").alias("content")))


add("ingest_files", lambda t: _ingested(t).select("content_id", "chunk_index", "chunk_type", "title", "start_line", "end_line", F.length("text").alias("n_chars")))
add("split_texts", lambda t: C.split_rows(t.documents.select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"), F.lit("PlainText").alias("kind")), "text", "kind").select("doc_id", "chunk_index", F.length("chunk").alias("n_chars")),
    """WITH RECURSIVE p AS (SELECT doc_id, [x for x in string_split(text, chr(10)) if x <> ''] AS ps FROM documents WHERE text IS NOT NULL),
    r(doc_id, i, held, done) AS (SELECT doc_id, 1, '', NULL::VARCHAR FROM p WHERE len(ps) > 0
      UNION ALL SELECT r.doc_id, r.i + 1,
        CASE WHEN r.i > len(p.ps) THEN '' WHEN length(r.held) > 0 AND length(r.held) + length(p.ps[r.i]) > 2000 THEN right(trim(r.held, chr(10) || chr(9) || chr(13) || ' '), 200) || chr(10) || chr(10) || p.ps[r.i] || chr(10) || chr(10)
          ELSE r.held || p.ps[r.i] || chr(10) || chr(10) END,
        CASE WHEN r.i > len(p.ps) OR length(r.held) > 0 AND length(r.held) + length(p.ps[r.i]) > 2000 THEN trim(r.held, chr(10) || chr(9) || chr(13) || ' ') END
      FROM r JOIN p ON r.doc_id = p.doc_id WHERE r.i <= len(p.ps) + 1)
    SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INTEGER AS chunk_index, length(done)::INTEGER AS n_chars FROM r WHERE done <> ''""")  # fmt: skip
add("hash_embeddings", lambda t: t.documents.select("doc_id", C.hashing_embedding(F.col("text")).alias("embedding")))

from . import code_texts, compositions, source_texts, stores  # noqa: E402, F401  they add more queries
