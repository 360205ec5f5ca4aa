"""Navigation of a code graph kept as two tables: nodes (id, node_type, name, full_name, ...) and edges (id, edge_type, source_id, target_id).

Names are compared exactly, except in `find_nodes`. The side that a name selects is small in practice but
not bounded, so no side is forced to be broadcast; the optimiser sees the filters.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import EDGE_TYPES, MEMBER_KINDS, NODE_TYPES, TYPE_KINDS, ordinal
from ..storage import Stored


def named(name: str, node: str = "") -> Column:
    return (F.col(f"{node}name") == name) | F.coalesce(F.col(f"{node}full_name") == name, F.lit(False))


def in_repository(df: DataFrame, repository: str | None) -> DataFrame:
    return df if repository is None else df.filter(F.col("repository_path").ilike(repository))


def _ends(nodes: DataFrame, column: str) -> DataFrame:
    return nodes.select(F.col("id").alias(column))


def sources_of(nodes: DataFrame, edges: DataFrame, kinds: list[str], targets: DataFrame) -> DataFrame:
    """Nodes with an edge of these kinds to one of the targets, a row per edge."""
    e = edges.filter(F.col("edge_type").isin(kinds)).select("source_id", "target_id").join(_ends(targets, "target_id"), "target_id", "left_semi")
    return nodes.join(e, nodes["id"] == e["source_id"]).drop("source_id", "target_id")


def targets_of(nodes: DataFrame, edges: DataFrame, kinds: list[str], sources: DataFrame) -> DataFrame:
    """Nodes with an edge of these kinds from one of the sources, a row per edge."""
    e = edges.filter(F.col("edge_type").isin(kinds)).select("source_id", "target_id").join(_ends(sources, "source_id"), "source_id", "left_semi")
    return nodes.join(e, nodes["id"] == e["target_id"]).drop("source_id", "target_id")


def find_implementations(nodes: DataFrame, edges: DataFrame, name: str, repository: str | None = None) -> DataFrame:
    return in_repository(sources_of(nodes, edges, ["Implements"], nodes.filter(named(name))), repository).distinct()


def find_derived_types(nodes: DataFrame, edges: DataFrame, name: str, repository: str | None = None) -> DataFrame:
    """Direct heirs only."""
    return in_repository(sources_of(nodes, edges, ["Inherits"], nodes.filter(named(name))), repository).distinct()


def methods_named(nodes: DataFrame, edges: DataFrame, name: str, type_name: str | None) -> DataFrame:
    m = nodes.filter((F.col("node_type") == "Method") & named(name))
    if type_name is None:
        return m
    types = _ends(nodes.filter(named(type_name)), "source_id")
    inside = edges.filter("edge_type = 'Contains'").join(types, "source_id", "left_semi").select(F.col("target_id").alias("id"))
    return m.join(inside, "id", "left_semi")


def find_callers(nodes: DataFrame, edges: DataFrame, method: str, type_name: str | None = None, repository: str | None = None) -> DataFrame:
    return in_repository(sources_of(nodes, edges, ["Calls"], methods_named(nodes, edges, method, type_name)), repository).distinct()


def find_dependencies(nodes: DataFrame, edges: DataFrame, method: str, type_name: str | None = None, repository: str | None = None) -> DataFrame:
    return in_repository(targets_of(nodes, edges, ["Calls", "Uses"], methods_named(nodes, edges, method, type_name)), repository).distinct()


def type_members(nodes: DataFrame, edges: DataFrame, type_name: str, repository: str | None = None) -> DataFrame:
    """Members of a type; a member that two edges lead to appears twice."""
    found = targets_of(nodes, edges, ["Contains"], nodes.filter(named(type_name)))
    return in_repository(found.filter(F.col("node_type").isin(*MEMBER_KINDS)), repository)


def types_in_namespace(nodes: DataFrame, edges: DataFrame, namespace: str, repository: str | None = None) -> DataFrame:
    inside = nodes.filter((F.col("node_type") == "Namespace") & named(namespace))
    return in_repository(targets_of(nodes, edges, ["Declares"], inside).filter(F.col("node_type").isin(*TYPE_KINDS)), repository)


def project_references(nodes: DataFrame, edges: DataFrame, project: str, repository: str | None = None) -> DataFrame:
    """Projects that a project refers to; the repository is theirs."""
    own = nodes.filter((F.col("node_type") == "Project") & (F.col("name") == project))
    return in_repository(targets_of(nodes, edges, ["References"], own), repository)


def reverse_references(nodes: DataFrame, edges: DataFrame, project: str) -> DataFrame:
    own = nodes.filter((F.col("node_type") == "Project") & (F.col("name") == project))
    return sources_of(nodes, edges, ["References"], own)


def find_nodes(nodes: DataFrame, name: str | None, node_type: str | None = None, repository: str | None = None) -> DataFrame:
    """Nodes whose name, full name or its last part matches, in any case and with wildcards as given; a blank name matches all."""
    df = nodes
    if name and name.strip():
        df = df.filter(F.col("name").ilike(name) | F.col("full_name").ilike(name) | F.col("full_name").ilike(f"%.{name}"))
    if node_type is not None:
        df = df.filter(F.col("node_type") == node_type)
    return in_repository(df, repository)


def definition(nodes: DataFrame, name: str, containing_type: str | None = None) -> DataFrame:
    """The first match in order of kind and id; a containing type must be part of the full name, in any case."""
    df = find_nodes(nodes, name)
    if containing_type:
        df = df.filter(F.contains(F.lower("full_name"), F.lit(containing_type.lower())))
    return df.orderBy(ordinal(F.col("node_type"), NODE_TYPES), "id").limit(1)


def graph_stats(nodes: DataFrame, edges: DataFrame, repository: str | None = None) -> DataFrame:
    """(what, kind, n): nodes and edges by kind; an edge belongs to the repository of its source."""
    n = in_repository(nodes, repository)
    e = edges.select("edge_type", "source_id").join(_ends(n, "source_id"), "source_id", "left_semi")
    by = n.groupBy(F.lit("node").alias("what"), F.col("node_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return by.unionByName(e.groupBy(F.lit("edge").alias("what"), F.col("edge_type").alias("kind")).agg(F.count(F.lit(1)).alias("n")))


def distinct_edges(edges: DataFrame, kind: str) -> DataFrame:
    """One edge of a kind per pair of ends, that of the smallest id."""
    return edges.filter(F.col("edge_type") == kind).groupBy("edge_type", "source_id", "target_id").agg(F.min("id").alias("id"))


def known_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends are nodes."""
    return edges.join(_ends(nodes, "source_id"), "source_id", "left_semi").join(_ends(nodes, "target_id"), "target_id", "left_semi")


def without_generated(nodes: DataFrame) -> DataFrame:
    """Nodes of files that no build wrote: their path has neither `obj` nor `.g.cs` in it."""
    p = F.coalesce("file_path", F.lit(""))
    return nodes.filter(~F.contains(p, F.lit("obj")) & ~F.contains(p, F.lit(".g.cs")))


def incident_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges that start or end at one of the ids, once each."""
    hit = [edges.join(ids.select(F.col("id").alias(c)), c, "left_semi").select(*edges.columns) for c in ("source_id", "target_id")]
    w = Window.partitionBy("id").orderBy("source_id", "target_id")
    return hit[0].unionByName(hit[1]).withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


#: Names up to which they are compared as one row with every node.
FEW_NAMES = 1000


def with_key(nodes: DataFrame, wanted: DataFrame, known: int | None = None) -> DataFrame:
    """A row (..., key) for each of a node's names in lower case that is wanted: name, full name and its last part.

    wanted: (key). A few names meet nodes as one row before any node is multiplied or shuffled; more are joined by key. known: how many at most
    there are, if that is known, else they are counted up to the bound.
    """
    full = F.coalesce("full_name", "name")
    named_nodes = nodes.withColumn("name_keys", F.array_distinct(F.array(F.lower("name"), F.lower(full), F.lower(F.substring_index(full, ".", -1)))))
    if (wanted.limit(FEW_NAMES + 1).count() if known is None else known) > FEW_NAMES:
        return named_nodes.select(*nodes.columns, F.explode("name_keys").alias("key")).join(wanted.select("key").distinct(), "key", "left_semi").select(*nodes.columns, "key")
    one = wanted.agg(F.collect_set("key").alias("wanted_keys"))
    hit = named_nodes.join(F.broadcast(one), F.arrays_overlap("name_keys", "wanted_keys"))  # one row
    return hit.select(*nodes.columns, F.explode(F.array_intersect("name_keys", "wanted_keys")).alias("key"))


def expand_neighbourhood(nodes: DataFrame, edges: DataFrame, symbols: DataFrame, max_symbols: int = 5, max_nodes: int = 10, related: int = 5, members: int = 10) -> DataFrame:
    """Nodes around symbols (seq, symbol), each once, where it is first met: (visit, relation, symbol, id, ...).

    Per symbol the first max_nodes matches; interfaces bring implementations, classes derived types, both
    their members, methods their callers, each up to its limit in order of id.
    """
    s = symbols.orderBy("seq").limit(max_symbols).select("seq", "symbol")
    own = with_key(nodes, s.select(F.lower("symbol").alias("key")), max_symbols).join(s.withColumn("key", F.lower("symbol")), "key").select("seq", "symbol", *nodes.columns).distinct()
    rank = F.row_number().over(Window.partitionBy("seq").orderBy(ordinal(F.col("node_type"), NODE_TYPES), "id"))
    # At most max_symbols * max_nodes rows; stored, as each relation starts from them.
    own = Stored(nodes.sparkSession, "neighbourhood").cut(own.withColumn("r", rank).filter(F.col("r") <= max_nodes))
    steps = [("implementation", ["Interface"], "Implements", "target_id", "source_id", related, NODE_TYPES), ("derived", ["Class"], "Inherits", "target_id", "source_id", related, NODE_TYPES),
             ("member", ["Class", "Interface", "Record", "Struct"], "Contains", "source_id", "target_id", members, MEMBER_KINDS), ("caller", ["Method"], "Calls", "target_id", "source_id", related, NODE_TYPES)]
    parts = [own.select("seq", "symbol", F.col("r"), F.lit(0).alias("step"), F.lit(0).alias("k"), F.lit("match").alias("relation"), *nodes.columns)]
    # One pass over edges and one over nodes: each edge is seen from both ends, and meets the few starts of its kind and end.
    starts = [
        own.filter(F.col("node_type").isin(kinds)).select(
            "seq", "symbol", "r", F.lit(i).alias("step"), F.lit(relation).alias("relation"), F.lit(edge).alias("edge_type"), F.lit(near).alias("end"), F.col("id").alias("near"), F.lit(limit).alias("most"),
            F.array(*map(F.lit, allowed)).alias("allowed"),
        ) for i, (relation, kinds, edge, near, far, limit, allowed) in enumerate(steps, 1)
    ]
    ends = [F.struct(F.lit(near).alias("end"), F.col(near).alias("near"), F.col(far).alias("id")) for near, far in (("source_id", "target_id"), ("target_id", "source_id"))]
    seen = edges.filter(F.col("edge_type").isin([x[2] for x in steps])).select("edge_type", F.explode(F.array(*ends)).alias("e")).select("edge_type", "e.*")
    # The starts are bounded as above.
    near_by = seen.join(F.broadcast(reduce(DataFrame.unionByName, starts)), ["edge_type", "end", "near"]).drop("edge_type", "end", "near").distinct()
    got = near_by.join(nodes, "id").filter(F.array_contains("allowed", F.col("node_type")))
    k = F.row_number().over(Window.partitionBy("seq", "r", "step").orderBy("id"))
    parts.append(got.withColumn("k", k).filter(F.col("k") <= F.col("most")).select("seq", "symbol", "r", "step", "k", "relation", *nodes.columns))
    every = reduce(DataFrame.unionByName, parts)
    first = Window.partitionBy("id").orderBy("seq", "r", "step", "k")
    return every.withColumn("first", F.row_number().over(first)).filter("first = 1").select("seq", "r", "step", "k", "relation", "symbol", *nodes.columns)


def closure(edges: DataFrame, start: DataFrame, kind: str, max_depth: int = 20, levels: int = 5) -> DataFrame:
    """(start_id, id, depth): what a kind of edge leads to, with the fewest steps.

    Level by level, each id once per start and level, so cycles end and paths don't multiply. After some levels what is new is
    written to the shared folder, and only the ids that the last of them found first lead on.
    """
    store = Stored(edges.sparkSession, "closure")
    step = store.cut(edges.filter(F.col("edge_type") == kind).select(F.col("source_id").alias("id"), F.col("target_id").alias("next")).distinct())
    seen = front = start.select(F.col("id").alias("start_id"), "id", F.lit(0).alias("depth")).distinct()
    depth = 0
    while depth < max_depth:
        found, level = [], front.select("start_id", "id")
        for _ in range(min(levels, max_depth - depth)):
            depth += 1
            level = level.join(step, "id").select("start_id", F.col("next").alias("id")).distinct()
            found.append(level.withColumn("depth", F.lit(depth)))
        new = reduce(DataFrame.unionByName, found).groupBy("start_id", "id").agg(F.min("depth").alias("depth")).join(seen, ["start_id", "id"], "left_anti")
        new = store.cut(new)
        front = new.filter(F.col("depth") == depth)
        seen = seen.unionByName(new)
        if front.isEmpty():
            break
    return seen.filter("depth > 0")


def diagram_lines(pairs: DataFrame, limit: int = 10) -> DataFrame:
    """Text of a diagram for (side, name) rows: the first names of each side, and how many more there are."""
    w = Window.partitionBy("side").orderBy("name")
    df = pairs.withColumn("r", F.row_number().over(w)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("side")))
    some = df.filter(F.col("r") <= limit).groupBy("side", "n").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "name"))), lambda x: x["name"]), ", ").alias("names"))
    more = F.when(F.col("n") > limit, F.concat(F.lit(" +"), (F.col("n") - limit).cast("string"), F.lit(" more"))).otherwise("")
    return some.select("side", F.col("n").alias("n_nodes"), F.concat("names", more).alias("label"))


def project_structure(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(project, references): each project with the names that it refers to, in order."""
    p = nodes.filter("node_type = 'Project'").select("id", F.col("name").alias("project"))
    refs = edges.filter("edge_type = 'References'").select(F.col("source_id").alias("id"), F.col("target_id").alias("to")).join(p.select(F.col("id").alias("to"), F.col("project").alias("ref")), "to")
    refs = refs.groupBy("id").agg(F.array_join(F.sort_array(F.collect_list("ref")), ", ").alias("references"))
    return p.join(refs, "id", "left").select("project", F.coalesce("references", F.lit("")).alias("references"))


def edge_text(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(edge_type, line): each edge as text by the names of its ends, `?` for one that isn't known."""
    a = nodes.select(F.col("id").alias("source_id"), F.col("name").alias("a"))
    b = nodes.select(F.col("id").alias("target_id"), F.col("name").alias("b"))
    df = edges.join(a, "source_id", "left").join(b, "target_id", "left")
    return df.select("edge_type", ordinal(F.col("edge_type"), EDGE_TYPES).alias("edge_ordinal"), F.concat(F.coalesce("a", F.lit("?")), F.lit(" -> "), F.coalesce("b", F.lit("?"))).alias("line"))


def members_by_name(nodes: DataFrame, type_name: str) -> DataFrame:
    """Members of a type told by file or by full name, for graphs without containment edges."""
    t = nodes.filter(F.col("node_type").isin(*TYPE_KINDS) & (F.col("name") == type_name))
    m = nodes.filter(F.col("node_type").isin(*MEMBER_KINDS))
    by_file = m.join(t.select("file_path"), "file_path", "left_semi").select(*nodes.columns)
    there = t.limit(1).select(F.lit(True).alias("type_is_there"))
    by_name = m.filter(F.contains("full_name", F.lit(f"{type_name}."))).join(F.broadcast(there)).select(*nodes.columns)  # one row
    return by_file.unionByName(by_name).distinct()


def type_hierarchy(nodes: DataFrame, edges: DataFrame, name: str, limit: int = 10) -> DataFrame:
    """`diagram_lines` of a type: what it derives from and implements, what derives from it, and what implements it."""
    own = nodes.filter(F.col("node_type").isin(*TYPE_KINDS) & named(name))
    sides = [
        ("base", targets_of(nodes, edges, ["Inherits"], own)), ("interfaces", targets_of(nodes, edges, ["Implements"], own)),
        ("derived", sources_of(nodes, edges, ["Inherits"], own)), ("implementations", sources_of(nodes, edges, ["Implements"], own)),
    ]
    return diagram_lines(reduce(DataFrame.unionByName, [df.select("id", "name").distinct().select(F.lit(side).alias("side"), "name") for side, df in sides]), limit)


def dependency_diagram(nodes: DataFrame, edges: DataFrame, project: str, limit: int = 10) -> DataFrame:
    """`diagram_lines` of a project: what it refers to, and what refers to it."""
    to, back = project_references(nodes, edges, project), reverse_references(nodes, edges, project)
    return diagram_lines(to.select(F.lit("references").alias("side"), "name").unionByName(back.select(F.lit("referenced by").alias("side"), "name")), limit)


def call_graph(nodes: DataFrame, edges: DataFrame, method: str, limit: int = 10) -> DataFrame:
    """`diagram_lines` of a method: who calls it, and what it calls or uses."""
    a = find_callers(nodes, edges, method).select(F.lit("callers").alias("side"), F.col("full_name").alias("name"))
    b = find_dependencies(nodes, edges, method).select(F.lit("callees").alias("side"), F.col("full_name").alias("name"))
    return diagram_lines(a.unionByName(b), limit)


def graph_of_symbols(symbols: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of an extracted symbol table: (key, kind, name, full_name, file_path, line_number, container) and (relation, key, other).

    A symbol's container gives `Declares` for types in a namespace and `Contains` else. Ends that no symbol has become
    placeholder nodes, of the kind that the relation leads to, so that calls, bases and interfaces from outside stay known.
    """
    s = symbols.select("key", F.col("kind").alias("node_type"), "name", "full_name", "file_path", "line_number", "container")
    kinds = symbols.select(F.col("key").alias("container"), F.col("kind").alias("outer"))
    inside = s.filter(F.col("container").isNotNull()).join(kinds, "container")
    within = F.when((F.col("outer") == "Namespace") & F.col("node_type").isin(*TYPE_KINDS), "Declares").otherwise("Contains")
    e = inside.select(within.alias("edge_type"), F.col("container").alias("source_id"), F.col("key").alias("target_id"))
    rel = relations.select(F.col("relation").alias("edge_type"), F.col("key").alias("source_id"), F.col("other").alias("target_id"))
    rel = rel.join(symbols.select(F.col("key").alias("source_id")), "source_id", "left_semi").select("edge_type", "source_id", "target_id")
    edges = e.unionByName(rel).distinct()
    outside = {"Calls": "Method", "Uses": "Property", "Implements": "Interface", "Inherits": "Class", "Overrides": "Method", "References": "Project"}
    kind = F.coalesce(*[F.when(F.col("edge_type") == k, v) for k, v in outside.items()])
    lacking = rel.join(symbols.select(F.col("key").alias("target_id")), "target_id", "left_anti")
    external = lacking.groupBy("target_id").agg(F.min(kind).alias("node_type")).filter("node_type IS NOT NULL")
    none = F.lit(None)
    placeholders = external.select(
        F.col("target_id").alias("id"), "node_type", F.substring_index("target_id", ".", -1).alias("name"), F.col("target_id").alias("full_name"),
        none.cast("string").alias("file_path"), none.cast("int").alias("line_number"), F.lit(True).alias("is_external"),
    )
    own = s.select(F.col("key").alias("id"), "node_type", "name", "full_name", "file_path", F.col("line_number").cast("int").alias("line_number"), F.lit(False).alias("is_external"))
    return own.unionByName(placeholders), edges


def code_with_graph(files: DataFrame, path_col: str = "path", text_col: str = "content") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks, nodes, edges) of source files at once: what an index and a graph need of them. Files are read and cut once for all three."""
    from .chunking import ingest

    found = Stored(files.sparkSession, "code_with_graph").cut(ingest(files, "members", path_col, text_col))
    return found, *_light_graph_of(found)


def light_graph(files: DataFrame, path_col: str = "path", text_col: str = "content") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of source files by their declarations alone: files, types and members, and what contains what."""
    from .chunking import ingest

    return _light_graph_of(ingest(files, "members", path_col, text_col))


def _light_graph_of(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    from ..functions.paths import file_name

    kind = F.initcap("chunk_type")
    owner = F.col("parent")
    member = F.col("parent").isNotNull()
    # A field of several variables has a chunk for each, of which only the last is a node.
    same = Window.partitionBy("path", "start_line", "text", "chunk_type").orderBy(F.desc("chunk_index"))
    found = found.withColumn("last", F.row_number().over(same)).filter((F.col("chunk_type") != "field") | (F.col("last") == 1))
    own = found.select(
        F.concat_ws("|", "path", "title", "start_line").alias("id"), kind.alias("node_type"), F.when(member, F.substring_index("title", ".", -1)).otherwise(F.col("title")).alias("name"),
        F.col("title").alias("full_name"), F.col("path").alias("file_path"), F.col("start_line").alias("line_number"), F.when(member, owner).alias("owner"),
    )
    file_id = F.concat(F.lit("file|"), F.col("file_path"))
    paths = own.select("file_path").distinct()
    file_nodes = paths.select(file_id.alias("id"), F.lit("File").alias("node_type"), file_name(F.col("file_path")).alias("name"), F.lit(None).cast("string").alias("full_name"), "file_path", F.lit(1).alias("line_number"))
    types = own.filter(F.col("owner").isNull())
    in_file = types.select(F.lit("Contains").alias("edge_type"), file_id.alias("source_id"), F.col("id").alias("target_id"))
    t = types.groupBy("file_path", F.col("full_name").alias("owner")).agg(F.min("id").alias("source_id"))
    in_type = own.filter(F.col("owner").isNotNull()).join(t, ["file_path", "owner"]).select(F.lit("Contains").alias("edge_type"), "source_id", F.col("id").alias("target_id"))
    return file_nodes.unionByName(own.drop("owner")), in_file.unionByName(in_type)
