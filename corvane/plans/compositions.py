"""Queries of operators put together, and of those that read or write files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import fixtures as X
from .. import tools as TOOLS
from ..functions import paths as P
from ..operators import chunking as C
from ..operators import graph as G
from ..operators import mutate as M
from ..operators import retrieval as V
from ..operators import search as S
from ..operators import status as ST
from ..operators import symbols as Y
from ..operators import tree as TREE
from ..sources import files as FILES
from ..sources import registry as REG
from ..sources import research as RS
from ..storage import Stored
from ..streaming import changes as CH
from ..streaming import jobs as J
from . import catalog as K
from . import code_texts as T
from .base import add
from .code_texts import _DOCUMENTED, _MEMBERS, _files, _filled_sql

# ---- files in the shared folder


def _folder(t: X.Tables) -> str:
    """Each nation's name and number as a text file under a folder of its region, one region's in a folder that listings leave out."""
    top = Stored(t.spark, "files").top
    rows = t.nation.select(F.when(F.col("n_regionkey") == 4, "obj").otherwise(F.concat(F.lit("r"), "n_regionkey")).alias("d"), F.concat_ws(" ", "n_nationkey", "n_name").alias("value"))
    rows.repartition(1).sortWithinPartitions("d", "value").write.partitionBy("d").text(top)
    return top


def _scanned(t: X.Tables) -> DataFrame:
    """Twice each, as each file matches both patterns; the folder `obj` is left out."""
    found = FILES.scan_folder(t.spark, _folder(t), ["*.txt", "*.TXT", "*.md"], ["**/d=obj/**"])
    return found.select(F.regexp_extract("path", "/d=(r[0-9])/", 1).alias("folder"), "content")


add("scan_folder", _scanned,
    "WITH f AS (SELECT 'r' || n_regionkey AS folder, string_agg(n_nationkey || ' ' || n_name, chr(10) ORDER BY n_nationkey || ' ' || n_name) || chr(10) AS content FROM nation WHERE n_regionkey <> 4 GROUP BY 1) SELECT * FROM f UNION ALL SELECT * FROM f")


def _registry(t: X.Tables) -> DataFrame:
    path = f"{Stored(t.spark, 'registry').top}/registry.json"
    REG.write_registry(K._workspaces(t), path)
    return REG.read_registry(t.spark, path).unionByName(REG.read_registry(t.spark, f"{path}-none")).select("id", "path", "alias", F.array_join("tags", ",").alias("tags"), "is_default")


add("registry_round_trip", _registry, "SELECT DISTINCT substring(sha256('/corpus/' || source), 1, 16) AS id, '/corpus/' || source AS path, upper(source) AS alias, 'corpus,' || source AS tags, source = 'src0' AS is_default FROM documents")


def _appended(t: X.Tables) -> DataFrame:
    path = f"{Stored(t.spark, 'appended').top}/table"
    FILES.append_table(t.nation.select("n_nationkey", "n_name"), path)
    FILES.append_table(t.region.select(F.col("r_regionkey").alias("n_nationkey"), F.col("r_name").alias("n_name")), path)
    return FILES.scan_table(t.spark, path, "n_nationkey int, n_name string, n_missing string")


add("appended_rows", _appended, "SELECT n_nationkey, n_name, NULL::VARCHAR AS n_missing FROM nation UNION ALL SELECT r_regionkey, r_name, NULL FROM region")
add("included_files", lambda t: K._paths(t).filter(P.matches_include(F.col("path"), "*.md") | P.matches_include(F.col("path"), "1.CS")).select("doc_id"), f"SELECT doc_id FROM ({K._PATHS}) WHERE ends_with(lower(path), '.md') OR regexp_matches(lower(path), '(^|[/\\\\])1\\.cs$')")
add("default_listing", lambda t: K._paths(t).filter(P.should_include(F.col("path"), FILES.DEFAULT_INCLUDE, [*FILES.DEFAULT_EXCLUDE, "**/src2/**"])).select("doc_id"),
    f"SELECT doc_id FROM (SELECT doc_id, lower(replace(path, '\\', '/')) AS p FROM ({K._PATHS})) WHERE (ends_with(p, '.md') OR ends_with(p, '.cs')) AND NOT contains(p, '/src2/')")

# ---- changes to tables


def _embedded(text: Column) -> Column:
    return F.array(F.length(text).cast("float"))


def _indexed(t: X.Tables) -> DataFrame:
    """All documents indexed with their own texts over the chunks; every eighth of them is blank, which deletes its content."""
    old = X.chunks(t).select("content_id", "chunk_index", "content", "content_type", "embedding")
    text = F.when(F.col("doc_id") % 8 == 0, " ").otherwise(F.col("text"))
    new = t.documents.select(F.concat(F.lit("doc:"), "doc_id").alias("content_id"), text.alias("content"), F.lit("PlainText").alias("content_type"))
    return M.index_content(old, new, _embedded).select("content_id", "chunk_index", F.sha2(F.coalesce("content", F.lit("")), 256).alias("sha"), F.size("embedding").alias("width"))


# The texts have no blank lines and no blanks at their ends, so that each is one chunk as it is.
add("index_content", _indexed,
    X.ORACLE_CHUNKS + """ SELECT content_id, chunk_index, sha256(coalesce(content, '')) AS sha, len(embedding)::INTEGER AS width FROM chunks WHERE content_id NOT IN (SELECT 'doc:' || doc_id FROM documents)
    UNION ALL SELECT 'doc:' || doc_id, 0, sha256(text), 1 FROM documents WHERE doc_id % 8 <> 0 AND trim(text) <> ''""")  # fmt: skip
add("deleted_content", lambda t: M.was_there(X.chunks(t), "doc:3").unionByName(M.was_there(X.chunks(t), "doc:none")), X.ORACLE_CHUNKS + " SELECT count(*) > 0 AS deleted FROM chunks WHERE content_id = 'doc:3' UNION ALL SELECT count(*) > 0 FROM chunks WHERE content_id = 'doc:none'")
add("clear_all", lambda t: X.chunks(t).groupBy("content_type").agg(F.count(F.lit(1)).alias("before")).join(M.cleared(X.chunks(t)).groupBy("content_type").agg(F.count(F.lit(1)).alias("n")), "content_type", "left").select("content_type", "before", F.coalesce("n", F.lit(0)).alias("n")),
    X.ORACLE_CHUNKS + " SELECT content_type, count(*) AS before, 0::BIGINT AS n FROM chunks GROUP BY content_type")
add("add_rows", lambda t: M.add_rows(t.nation.select("n_nationkey", "n_name"), t.region.select(F.col("r_regionkey").alias("n_nationkey"))).select("n_nationkey", "n_name"), "SELECT n_nationkey, n_name FROM nation UNION ALL SELECT r_regionkey, NULL FROM region")
add("index_metadata_rows", lambda t: M.index_metadata_rows("/w", t.documents.count(), t.documents.filter("lang = 'en'").count(), F.lit("2024-01-01 00:00:00").cast("timestamp"), None, t.spark),
    "SELECT '/w' AS workspace_path, unnest(['rag', 'graph']) AS index_type, TIMESTAMP '2024-01-01' AS indexed_at, NULL::VARCHAR AS commit_sha, count(*)::INTEGER AS files_indexed, (count(*) FILTER (lang = 'en'))::INTEGER AS items_created FROM documents")
add("set_default", lambda t: M.set_default(M.set_default(K._workspaces(t), "SRC2"), "nowhere").select("path", "is_default"), "SELECT DISTINCT '/corpus/' || source AS path, source = 'src2' AS is_default FROM documents")


def _reindexed(t: X.Tables) -> tuple[DataFrame, DataFrame]:
    """The repository of Asia built anew from its classes alone, one of which inherits from another."""
    n, e = X.nodes(t), X.edges(t)

    def build() -> tuple[DataFrame, DataFrame]:
        own = n.filter("repository_path = '/repo/asia' AND node_type = 'Class'")
        inherits = own.select(F.lit("Inherits").alias("edge_type"), F.col("id").alias("source_id"), F.lit("C:0").alias("target_id"))
        return own, inherits.withColumn("id", F.concat_ws("|", "edge_type", "source_id", "target_id"))

    return M.reindex(n, e, "/REPO/asia", build)


_ASIA = X.ORACLE_GRAPH + ", d AS (SELECT id FROM nodes WHERE repository_path = '/repo/asia'), c AS (SELECT * FROM nodes WHERE repository_path = '/repo/asia' AND node_type = 'Class')"
add("reindex_nodes", lambda t: _reindexed(t)[0].select("id", "node_type"), _ASIA + " SELECT id, node_type FROM nodes WHERE id NOT IN (SELECT id FROM d) UNION ALL SELECT id, node_type FROM c")
add("reindex_edges", lambda t: _reindexed(t)[1].select("edge_type", "source_id", "target_id"), _ASIA + " SELECT edge_type, source_id, target_id FROM edges WHERE source_id NOT IN (SELECT id FROM d) AND target_id NOT IN (SELECT id FROM d) UNION ALL SELECT 'Inherits', id, 'C:0' FROM c")

# ---- filters that no other query has
add("vec_workspace_ids", lambda t: K._hits(V.vector_top_k(X.chunks(t), X.query_vector(t, 4), V.RetrievalOptions(top_k=15, min_score=None, workspace_ids=[row.id for row in K._workspaces(t).filter("alias IN ('SRC1', 'SRC3')").collect()])), "workspace_id"),
    K._scores(4, "workspace_id IN (substring(sha256('/corpus/src1'), 1, 16), substring(sha256('/corpus/src3'), 1, 16))") + "SELECT content_id, round(s, 6) AS score, workspace_id FROM scored ORDER BY s DESC, content_id LIMIT 15")
for _name, _pattern in (("chunks_for_tree_all", "."), ("chunks_for_tree_blank", "")):
    add(_name, lambda t, p=_pattern: V.chunks_for_tree(K._mapped(t), "/corpus/src1", p).select("content_id", "symbol"), X.ORACLE_CHUNKS + " SELECT content_id, 'Sym' || (vec_id % 50) AS symbol FROM chunks WHERE source_path ILIKE '/corpus/src1/%'")
# A pattern that the raw metadata holds as a key, but no part that is shown, finds nothing; one in the path does.
add("chunks_for_tree_path", lambda t: V.chunks_for_tree(K._mapped(t), "/corpus", "startLine").unionByName(V.chunks_for_tree(K._mapped(t), "/corpus", "SRC1/de")).select("content_id"), X.ORACLE_CHUNKS + " SELECT content_id FROM chunks WHERE source_path ILIKE '%src1/de%'")
add("list_types_named", lambda t: Y.list_types(K._symbol_table(t), "brand#1", "a").select(*K._SC), K._sym_sql("p_size % 2 = 1 AND contains(lower(p_brand), 'brand#1') AND contains(lower(name), 'a')"))
add("without_generated", lambda t: G.without_generated(t.documents.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("/a/obj/"), "doc_id")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("/a/x"), "doc_id", F.lit(".g.cs"))).when(F.col("doc_id") % 2 == 0, "/a/x.cs").alias("file_path"))).select("doc_id"), "SELECT doc_id FROM documents WHERE doc_id % 3 = 2")


def _references(t: X.Tables) -> DataFrame:
    """Nations' names as symbols, each declared in the first line of its file, and texts that use others' names."""
    files = t.nation.select(F.concat(F.lit("f"), "n_nationkey").alias("path"), F.concat(F.lit("class "), "n_name", F.lit(" { }\nuses NATION_3 and NATION_33\nagain "), "n_name", F.lit(";")).alias("content"))
    symbols = t.nation.select(F.col("n_name").alias("name"), F.concat(F.lit("f"), "n_nationkey").alias("file_path"), F.lit(1).alias("line_number"))
    return Y.references(symbols, files, "NATION_3", 20).unionByName(Y.references(symbols, files, "NATION_33")).select("path", "line_number", "preview", "in_declaring_file", "truncated")


add("symbol_references", _references,
    """WITH x AS (SELECT 'f' || n_nationkey AS path, 2 AS line_number, 'uses NATION_3 and NATION_33' AS preview, n_nationkey = 3 AS in_declaring_file FROM nation UNION ALL SELECT 'f3', 3, 'again NATION_3;', TRUE), k AS (SELECT * FROM x ORDER BY path, line_number LIMIT 20)
    SELECT *, (SELECT count(*) FROM k) >= 20 AS truncated FROM k""")  # fmt: skip

# ---- graphs


def _lines_sql(pairs: str) -> str:
    return f"""{X.ORACLE_GRAPH}, p AS ({pairs}), r AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY name) AS r, count(*) OVER (PARTITION BY side) AS n FROM p)
    SELECT side, max(n) AS n_nodes, string_agg(name, ', ' ORDER BY r) || CASE WHEN max(n) > 10 THEN ' +' || (max(n) - 10) || ' more' ELSE '' END AS label FROM r WHERE r <= 10 GROUP BY side"""


def _side(side: str, kind: str, near: str, far: str, name: str, extra: str = "") -> str:
    return f"SELECT '{side}' AS side, name FROM (SELECT DISTINCT n.id, n.name FROM edges e JOIN nodes m ON m.id = e.{near} JOIN nodes n ON n.id = e.{far} WHERE e.edge_type = '{kind}' AND m.name = '{name}' {extra})"


add("type_hierarchy_diagram", lambda t: G.type_hierarchy(X.nodes(t), X.edges(t), "Customer#000000003").unionByName(G.type_hierarchy(X.nodes(t), X.edges(t), "Supplier#000000003").withColumn("side", F.concat(F.lit("of supplier: "), "side"))),
    _lines_sql(" UNION ALL ".join([_side("base", "Inherits", "source_id", "target_id", "Customer#000000003"), _side("interfaces", "Implements", "source_id", "target_id", "Customer#000000003"), _side("derived", "Inherits", "target_id", "source_id", "Customer#000000003"), _side("of supplier: implementations", "Implements", "target_id", "source_id", "Supplier#000000003")])))
add("dependency_diagram", lambda t: G.dependency_diagram(X.nodes(t), X.edges(t), "NATION_3"), _lines_sql(_side("references", "References", "source_id", "target_id", "NATION_3") + " UNION ALL " + _side("referenced by", "References", "target_id", "source_id", "NATION_3")))
add("structure_projects", lambda t: S.structure_report(X.nodes(t), X.edges(t), 5).filter("section = 'projects'"),
    X.ORACLE_GRAPH + " SELECT 'projects' AS section, p.name || ': ' || coalesce(string_agg(q.name, ', ' ORDER BY q.name), '') AS text FROM nodes p LEFT JOIN edges e ON e.source_id = p.id AND e.edge_type = 'References' LEFT JOIN nodes q ON q.id = e.target_id WHERE p.node_type = 'Project' GROUP BY p.id, p.name")


def _symbol_graph(t: X.Tables) -> tuple[DataFrame, DataFrame]:
    """Nations as namespaces, customers as classes in them, orders as methods; methods call the next one, the last ones what nobody knows."""
    none = F.lit(None).cast("string")
    space = t.nation.select(F.concat(F.lit("N."), "n_nationkey").alias("key"), F.lit("Namespace").alias("kind"), F.col("n_name").alias("name"), F.col("n_name").alias("full_name"), none.alias("container"))
    types = t.customer.select(F.concat(F.lit("T."), "c_custkey").alias("key"), F.lit("Class").alias("kind"), F.col("c_name").alias("name"), F.col("c_name").alias("full_name"), F.concat(F.lit("N."), "c_nationkey").alias("container"))
    o = t.orders
    methods = o.select(F.concat(F.lit("M."), "o_orderkey").alias("key"), F.lit("Method").alias("kind"), F.concat(F.lit("m"), "o_orderkey").alias("name"), F.concat(F.lit("m"), "o_orderkey").alias("full_name"), F.concat(F.lit("T."), "o_custkey").alias("container"))
    symbols = space.unionByName(types).unionByName(methods).withColumn("file_path", F.lit("a.cs")).withColumn("line_number", F.lit(1))
    calls = o.select(F.lit("Calls").alias("relation"), F.concat(F.lit("M."), "o_orderkey").alias("key"), F.concat(F.lit("M."), F.col("o_orderkey") + 7).alias("other"))
    bases = t.customer.select(F.lit("Inherits").alias("relation"), F.concat(F.lit("T."), "c_custkey").alias("key"), F.lit("System.Base").alias("other"))
    stray = t.region.select(F.lit("Calls").alias("relation"), F.concat(F.lit("?"), "r_name").alias("key"), F.lit("M.1").alias("other"))
    return G.graph_of_symbols(symbols, calls.unionByName(calls).unionByName(bases).unionByName(stray))


add("symbol_graph_nodes", lambda t: _symbol_graph(t)[0].select("id", "node_type", "name", "is_external"),
    """SELECT 'N.' || n_nationkey AS id, 'Namespace' AS node_type, n_name AS name, FALSE AS is_external FROM nation UNION ALL SELECT 'T.' || c_custkey, 'Class', c_name, FALSE FROM customer UNION ALL SELECT 'M.' || o_orderkey, 'Method', 'm' || o_orderkey, FALSE FROM orders
    UNION ALL SELECT 'System.Base', 'Class', 'Base', TRUE UNION ALL SELECT DISTINCT 'M.' || (o_orderkey + 7), 'Method', (o_orderkey + 7)::VARCHAR, TRUE FROM orders WHERE o_orderkey + 7 NOT IN (SELECT o_orderkey FROM orders)""")  # fmt: skip
add("symbol_graph_edges", lambda t: _symbol_graph(t)[1],
    "SELECT 'Declares' AS edge_type, 'N.' || c_nationkey AS source_id, 'T.' || c_custkey AS target_id FROM customer UNION ALL SELECT 'Contains', 'T.' || o_custkey, 'M.' || o_orderkey FROM orders UNION ALL SELECT 'Calls', 'M.' || o_orderkey, 'M.' || (o_orderkey + 7) FROM orders UNION ALL SELECT 'Inherits', 'T.' || c_custkey, 'System.Base' FROM customer")

# ---- trees


def _tree(t: X.Tables, depth: int = 3, detail: bool = True) -> DataFrame:
    chunks = C.tree_chunks(C.ingest(_files(t, _DOCUMENTED, "cs"), "members"), "/src")
    return TREE.tree_rows(chunks, depth, detail)


def _tree_sql() -> str:
    """A file's type, and its methods, constructor and property beneath it."""
    f = "WITH f AS (SELECT s_suppkey, 'f' || s_suppkey || '.cs' AS f, 'T' || s_suppkey AS ty FROM supplier)"
    rows = ["SELECT 'file:' || f AS node_id, NULL::VARCHAR AS parent_id, 'file' AS kind, f AS name, NULL::VARCHAR AS signature, 1 AS depth FROM f", f"SELECT 'type:' || f || ':' || ty, 'file:' || f, 'type', ty, {_filled_sql(_MEMBERS[0][5], k='s_suppkey')}, 2 FROM f"]
    for kind, title, _, _, _, signature, _, _ in _MEMBERS[1:]:
        if kind in TREE.MEMBER_CHUNKS:
            name = _filled_sql(title.split(".")[1], k="s_suppkey")
            rows.append(f"SELECT 'method:' || f || ':' || {name}, 'type:' || f || ':' || ty, 'method', {name}, {_filled_sql(signature, k='s_suppkey')}, 3 FROM f")
    return f + " ".join(["", " UNION ALL ".join(rows)])


add("tree_of_files", _tree, _tree_sql())


def _mapped_members(t: X.Tables) -> DataFrame:
    """Members of the files as index rows, their places and kinds in the metadata map."""
    c = C.ingest(_files(t, _DOCUMENTED, "cs"), "members")
    keys = (("chunkType", F.col("chunk_type")), ("symbolName", F.substring_index("title", ".", -1)), ("parentSymbol", F.col("parent")), ("title", F.col("title")), ("signature", F.col("signature")), ("startLine", F.col("start_line").cast("string")), ("endLine", F.col("end_line").cast("string")))
    m = F.map_filter(F.create_map(*[x for k, v in keys for x in (F.lit(k), v)]), lambda k, v: v.isNotNull())
    return c.select(F.col("path").alias("source_path"), "content_id", "chunk_index", F.col("text").alias("content"), m.alias("metadata"))


def _explored(t: X.Tables) -> DataFrame:
    """The tree under a folder of what a pattern finds, and the text of one of its nodes."""
    found = V.chunks_for_tree(_mapped_members(t), "/SRC", "T1").select("rel_path", "chunk_type", "symbol", "parent", "title", "signature", "content", "start_line", "end_line")
    one = TREE.node_content(found, "method:f1.cs:Run").select(F.lit("content").alias("node_id"), F.col("content").alias("name"))
    return TREE.tree_rows(found).select("node_id", "name").unionByName(one)


add("tree_explore", _explored,
    _tree_sql().replace("WITH f AS (", "WITH f AS (SELECT * FROM (").replace("FROM supplier)", "FROM supplier) WHERE s_suppkey::VARCHAR LIKE '1%')", 1).replace(" SELECT 'file:'", ", tree AS (SELECT 'file:'", 1)
    + f") SELECT node_id, name FROM tree UNION ALL SELECT 'content', {_filled_sql(_MEMBERS[5][7], k='1')}")

# ---- composed searches and states
add("prompt_enrichment", lambda t: S.prompt_enrichment(*_pascal_graph(t), "who calls AfricaHandler, or is the IEuropeMaker?"),
    """WITH r AS (SELECT r_regionkey AS k, upper(r_name[1:1]) || lower(r_name[2:]) AS name FROM region), n AS (SELECT k, 'Space' || k AS namespace, name || 'Handler' AS c, 'I' || name || 'Maker' AS i FROM r)
    SELECT namespace, '- Interface ' || i || ' (match)' AS text FROM n WHERE i = 'IEuropeMaker' UNION ALL
    SELECT namespace, CASE c WHEN 'AfricaHandler' THEN '- Class AfricaHandler (match)' ELSE '- Class ' || c || ' (implementation)' END FROM n WHERE c = 'AfricaHandler' OR (k + 1) % (SELECT count(*) FROM region) = (SELECT k FROM r WHERE name = 'Europe')""")  # fmt: skip


def _pascal_graph(t: X.Tables) -> tuple[DataFrame, DataFrame]:
    """Of each region a class and an interface with PascalCase names; a class implements the next region's interface."""
    k, name = F.col("r_regionkey").cast("string"), F.initcap(F.lower("r_name"))
    n = t.region.count()

    def own(mark: str, kind: str, called: Column) -> DataFrame:
        return t.region.select(F.concat(F.lit(mark), k).alias("id"), F.lit(kind).alias("node_type"), called.alias("name"), F.concat(F.lit("Space"), k, F.lit("."), called).alias("full_name"))

    types = own("x", "Class", F.concat(name, F.lit("Handler"))).unionByName(own("y", "Interface", F.concat(F.lit("I"), name, F.lit("Maker"))))
    implements = t.region.select(F.lit("Implements").alias("edge_type"), F.concat(F.lit("x"), k).alias("source_id"), F.concat(F.lit("y"), ((F.col("r_regionkey") + 1) % n).cast("string")).alias("target_id"))
    edges = X.edges(t).select("edge_type", "source_id", "target_id").unionByName(implements)
    return types.unionByName(X.nodes(t).select("id", "node_type", "name", "full_name")), edges


def _described(t: X.Tables) -> DataFrame:
    got = S.describe_codebase(X.nodes(t), X.edges(t), X.chunks(t), K._questions(t), 3, 10, "customer#000000003")
    return got.groupBy("section").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"), F.max("place").alias("last"), F.sha2(F.array_join(F.sort_array(F.collect_list(F.coalesce("title", F.lit("")))), ","), 256).alias("titles"))


add("describe_codebase", _described,
    K._merge_sql(4, 10, "content").replace("WITH chunks", X.ORACLE_GRAPH + ", chunks", 1).replace("SELECT content_id, round(s, 6) AS score FROM b WHERE b = 1", ", h AS (SELECT content_id AS title FROM b WHERE b = 1", 1)
    + """), ty AS (SELECT min(id) AS t FROM nodes WHERE node_type IN ('Class', 'Interface', 'Record', 'Struct') AND lower(name) = 'customer#000000003'),
    fp AS (SELECT DISTINCT 'member' AS title, target_id AS id, 20 AS k FROM edges, ty WHERE edge_type = 'Contains' AND source_id = t UNION SELECT 'implementation', source_id, 10 FROM edges, ty WHERE edge_type = 'Implements' AND target_id = t UNION SELECT 'derived', source_id, 10 FROM edges, ty WHERE edge_type = 'Inherits' AND target_id = t),
    fr AS (SELECT title, k, row_number() OVER (PARTITION BY title ORDER BY name, fp.id) AS place FROM fp JOIN nodes USING (id)),
    a AS (SELECT 'focus' AS section, place, title FROM fr WHERE place <= k UNION ALL SELECT 'texts', row_number() OVER (), title FROM h UNION ALL SELECT 'projects', 0, '' FROM nodes WHERE node_type = 'Project' UNION ALL SELECT 'namespaces', 0, '')
    SELECT section, count(*) AS n, min(place)::INTEGER AS first, max(place)::INTEGER AS last, sha256(string_agg(title, ',' ORDER BY title)) AS titles FROM a GROUP BY 1""")  # fmt: skip


def _workspace_status(t: X.Tables) -> DataFrame:
    w = K._workspaces(t).select("path", (F.length("path") == 12).alias("is_git"), F.substring(F.sha2("path", 256), 1, 40).alias("head_sha"), F.when(F.col("path") != "/corpus/src1", (F.length("path") - 12).cast("int")).alias("commits_behind"))
    jobs = K._requests(t)[1].select("job_id", F.regexp_replace("path", "^/w/", "/Corpus//src").alias("path"), "state")
    return ST.workspace_status(w, K._metadata(t), X.chunks(t), jobs, F.lit("2024-01-30 12:00:00").cast("timestamp"), "vec_id")


add("workspace_status", _workspace_status,
    "WITH base AS (" + K.CATALOG["index_status"].sql + "), " + X.ORACLE_CHUNKS.removeprefix("WITH ")
    + """, st AS (SELECT regexp_extract(source_path, '^(/corpus/[^/]*)/', 1) AS path, count(*) AS chunk_count, count(DISTINCT source_path) AS file_count, max(vec_id) AS last_indexed FROM chunks WHERE source_path IS NOT NULL GROUP BY 1),
    j AS (SELECT '/corpus/src' || (user_id % 50) AS path, min('j' || event_id) AS active_job FROM events WHERE event_type = 'click' AND event_id % 2 = 0 GROUP BY 1) SELECT base.*, chunk_count, file_count, last_indexed, active_job FROM base LEFT JOIN st USING (path) LEFT JOIN j USING (path)""")  # fmt: skip

# ---- changes and jobs


def _renames(t: X.Tables) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "Renamed").otherwise("Modified")
    e = t.events.select("ts", F.lit("w").alias("workspace"), kind.alias("change_type"), F.concat(F.lit("/old/"), "event_id").alias("old_path"), F.concat(F.lit("/new/"), "event_id").alias("path"))
    return CH.with_renames(e).select("ts", "change_type", "path")


add("rename_events", _renames, "SELECT ts, 'Modified' AS change_type, '/new/' || event_id AS path FROM events WHERE event_type <> 'view' UNION ALL SELECT ts, 'Deleted', '/old/' || event_id FROM events WHERE event_type = 'view' UNION ALL SELECT ts, 'Created', '/new/' || event_id FROM events WHERE event_type = 'view'")


def _applied(t: X.Tables) -> DataFrame:
    """Users' last change decides: deleted files lose their chunks, others are chunked anew."""
    chunks = t.customer.select(F.concat(F.lit("/w/"), "c_custkey", F.lit(".cs")).alias("source_path"), F.col("c_name").alias("content"))
    changes = X.changes(t).withColumnRenamed("event_id", "seq")
    return CH.apply_changes(chunks, changes, lambda files: files.select(F.col("path").alias("source_path"), F.concat(F.lit("new "), "path").alias("content")))


add("apply_changes", _applied,
    X.ORACLE_CHANGES + ", l AS (SELECT path, arg_max(change_type, event_id) AS k FROM changes GROUP BY 1) SELECT '/w/' || c_custkey || '.cs' AS source_path, c_name AS content FROM customer WHERE '/w/' || c_custkey || '.cs' NOT IN (SELECT path FROM l) UNION ALL SELECT path, 'new ' || path FROM l WHERE k <> 'Deleted'")


def _admitted(t: X.Tables) -> DataFrame:
    r = t.events.select(F.concat(F.lit("r"), "event_id").alias("job_id"), F.when(F.col("event_type") == "view", "folder").otherwise("content").alias("kind"), F.col("ts").alias("requested_at"))
    return J.admitted(r, 9_900).select("job_id", "accepted")


add("admitted_jobs", _admitted, "SELECT 'r' || event_id AS job_id, event_type = 'view' OR row_number() OVER (ORDER BY ts, 'r' || event_id) <= 100 AS accepted FROM events")


def _indexed_documents(t: X.Tables) -> DataFrame:
    """Documents to index, end to end: by their routes to chunks, with ids of what they hold, vectors, and in place of what was there."""
    k = F.col("s_suppkey")
    files = _files(t, _DOCUMENTED, "cs").filter(F.col("path") != "/src/f0.cs").unionByName(t.supplier.select(F.concat(F.lit("/src/n"), k.cast("string"), F.lit(".txt")).alias("path"), F.col("s_name").alias("content")))
    new = C.ingest(files).select("content_id", F.col("path").alias("source_path"), F.lit(0).alias("chunk_index"), F.col("text").alias("content"), C.hashing_embedding(F.col("text"), 8).alias("embedding"))
    old = t.supplier.select(F.concat(F.lit("old:"), k.cast("string")).alias("content_id"), F.concat(F.lit("/src/f"), k.cast("string"), F.lit(".cs")).alias("source_path"), F.lit(0).alias("chunk_index"), F.lit("old").alias("content"), F.array().cast("array<float>").alias("embedding"))
    every = M.replace_content(old, new, "source_path")
    place = F.row_number().over(Window.partitionBy("source_path").orderBy("content_id"))
    return every.withColumn("place", place).select("source_path", "place", F.substring_index("content_id", ":", 1).alias("head"), F.size("embedding").alias("width"))


add("index_documents", _indexed_documents,
    """WITH f AS (SELECT s_suppkey AS k FROM supplier), g AS (SELECT '/src/n' || k || '.txt' AS p FROM f)
    SELECT '/src/f0.cs' AS source_path, 1 AS place, 'old' AS head, 0 AS width UNION ALL SELECT p, 1, p, 8 FROM g UNION ALL SELECT '/src/f' || k || '.cs', unnest([1, 2]), '/src/f' || k || '.cs', 8 FROM f WHERE k > 0""")  # a header and a type each  # fmt: skip

_RULES = ("*/15 * * * *", "0 9 * * MON", "30 2 1 * *", "not a rule", "5,35 8-10/2 * jan-dec 0-7", "0 0 29 2 *", "61 * * * *")


def _due(t: X.Tables) -> DataFrame:
    rule = F.element_at(F.array(*map(F.lit, _RULES)), (F.col("event_id") % len(_RULES) + 1).cast("int"))
    return J.due_rules(t.events.select(F.col("event_id").alias("name"), rule.alias("rule"), F.col("ts").alias("since")), F.lit("2024-01-20 08:05:00").cast("timestamp")).select("name", "next_run", "then")


def _rule_sql(a: str) -> str:
    """The next time from a minute on, by rule."""
    day = f"date_trunc('day', {a})"
    times = "[485, 515, 605, 635]"
    return f"""CASE event_id % 7 WHEN 0 THEN time_bucket(INTERVAL 15 MINUTES, {a} + INTERVAL 14 MINUTES, TIMESTAMP '2000-01-01')
      WHEN 1 THEN date_trunc('week', {a}) + INTERVAL 9 HOURS + CASE WHEN date_trunc('week', {a}) + INTERVAL 9 HOURS >= {a} THEN INTERVAL 0 DAYS ELSE INTERVAL 7 DAYS END
      WHEN 2 THEN CASE WHEN date_trunc('month', {a}) + INTERVAL 150 MINUTES >= {a} THEN date_trunc('month', {a}) ELSE date_trunc('month', {a}) + INTERVAL 1 MONTH END + INTERVAL 150 MINUTES
      WHEN 4 THEN coalesce(list_min(list_filter(list_transform({times}, lambda m: {day} + to_minutes(m)), lambda x: x >= {a})), {day} + INTERVAL 1 DAY + INTERVAL 485 MINUTES)
      WHEN 5 THEN CASE WHEN {a} <= TIMESTAMP '2024-02-29' THEN TIMESTAMP '2024-02-29' ELSE TIMESTAMP '2028-02-29' END END"""


add("due_rules", _due,
    f"WITH e AS (SELECT *, date_trunc('minute', ts) + INTERVAL 1 MINUTE AS a, TIMESTAMP '2024-01-20 08:06:00' AS b FROM events), n AS (SELECT event_id AS name, ({_rule_sql('a')})::TIMESTAMP AS next_run, ({_rule_sql('b')})::TIMESTAMP AS \"then\" FROM e) SELECT * FROM n WHERE next_run <= TIMESTAMP '2024-01-20 08:05:00'")


@dataclass
class _Lookup:
    prefix: str
    regions: list[str]
    limit: int = 3


def _tools(t: X.Tables) -> None:
    def run(spark: SparkSession, p: _Lookup) -> DataFrame:
        own = t.nation.join(t.region.filter(F.col("r_name").isin(p.regions)), F.col("n_regionkey") == F.col("r_regionkey"))
        return own.filter(F.startswith("n_name", F.lit(p.prefix))).select("n_name", "r_name").orderBy("n_name").limit(p.limit)

    TOOLS.register(TOOLS.Tool("nation_lookup", "Nations by the start of their names", _Lookup, run))


def _called(t: X.Tables) -> DataFrame:
    _tools(t)
    return TOOLS.call(t.spark, "nation_lookup", '{"prefix": "NATION_1", "regions": ["ASIA", "AFRICA"], "limit": 4}')


def _listed(t: X.Tables) -> DataFrame:
    """A tool for each region, described by the number of its nations, as the listing shows them."""
    counts = t.nation.groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n"))
    for r in t.region.join(counts, F.col("r_regionkey") == F.col("n_regionkey")).collect():  # a row for each region
        TOOLS.register(TOOLS.Tool(f"nations_of_{r['r_name'].lower()}", f"{r['n']} nations", _Lookup, lambda spark, p: spark.range(0)))
    return TOOLS.listing(t.spark).filter("name LIKE 'nations_of_%'").select("name", "description", F.get_json_object("parameters", "$.properties.regions.type").alias("regions"), F.get_json_object("parameters", "$.required[1]").alias("second"))


add("tool_call", _called, "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'AFRICA') AND starts_with(n_name, 'NATION_1') ORDER BY n_name LIMIT 4")
add("tool_listing", _listed, "SELECT 'nations_of_' || lower(r_name) AS name, count(*) || ' nations' AS description, 'array' AS regions, 'regions' AS second FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name")


def _fetched(t: X.Tables) -> DataFrame:
    k = F.col("s_suppkey").cast("string")
    page = T._pages(t).select("url", F.col("html").alias("payload"))
    atom = T._atom(t).select(F.lit("https://arxiv.org/abs/1").alias("url"), "payload")
    paper = T._paper_json(t).select(F.lit("https://api.semanticscholar.org/x").alias("url"), "payload")
    none = t.supplier.select(F.concat(F.lit("ftp://x/"), k).alias("url"), F.lit("<html>").alias("payload"))
    return RS.fetched(page.unionByName(atom).unionByName(paper).unionByName(none)).select("source_id", "source_type", "title")


add("fetched_sources", _fetched,
    """SELECT sha256('https://x.org/' || s_suppkey) AS source_id, 'web' AS source_type, 'Page ' || s_suppkey || ' & more' AS title FROM supplier UNION ALL SELECT '2401.' || lpad(s_suppkey::VARCHAR, 5, '0'), 'arxiv', 'On ' || s_suppkey FROM supplier
    UNION ALL SELECT 'p' || s_suppkey, 'paper', 'On ' || s_suppkey FROM supplier WHERE s_suppkey % 4 <> 3 UNION ALL SELECT 'q' || s_suppkey, 'paper', 'No more' FROM supplier WHERE s_suppkey % 4 <> 3""")  # fmt: skip
add("code_with_graph", lambda t: _counted(*G.code_with_graph(_files(t, _DOCUMENTED, "cs"))), "SELECT unnest(['chunks', 'nodes', 'edges']) AS what, unnest([7, 7, 6]) * (SELECT count(*) FROM supplier) AS n")


def _counted(*parts: DataFrame) -> DataFrame:
    out = [p.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "n") for what, p in zip(("chunks", "nodes", "edges"), parts)]
    return RS.everything(out)
