"""The code graph out of source text: facts of single files by one table function, names resolved across files by joins.

A name that a file uses is looked for where the language looks: in the scopes around it, the nearest first, in what the file imports by
that name, in the namespaces that it imports whole, and at last as it is written. Each possibility is a row with its rank, an equi-join
finds those that exist, and an aggregate keeps the best, so that nothing is looked up on the driver or in one task. A call is looked
for among the members of its receiver's type and of that type's ancestors. Of overloads the one that takes so many arguments is preferred.

Ends that no file declares stay known as placeholder nodes: bases, interfaces and called methods. An edge is there once for its ends.
A type that several files declare in parts is one node, where its first part stands.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import file_name, folder
from ..schemas import TYPE_KINDS
from ..storage import Stored
from .extract import source_facts, split_by_kind

#: Ranks of where a name may be found; scopes around come before, by their distance.
BY_NAME, BY_NAMESPACE, AS_WRITTEN = 1000, 2000, 3000
NODE = ("id", "node_type", "name", "full_name", "file_path", "line_number", "signature", "modifiers", "is_external")


def _scopes(scope: Column) -> Column:
    """The scopes around, the nearest first, as (rank, scope)."""
    parts = F.split(F.coalesce(scope, F.lit("")), r"\.")
    n = F.size(parts)
    return F.filter(
        F.transform(F.sequence(n, F.lit(1)), lambda k: F.struct((n - k).alias("rank"), F.array_join(F.slice(parts, F.lit(1), k), ".").alias("scope"))), lambda s: s["scope"] != ""
    )


def resolved_types(wanted: DataFrame, imports: DataFrame, types: DataFrame) -> DataFrame:
    """(path, scope, target, found, found_type) for the (path, language, scope, target) of wanted names that are declared somewhere.

    types are (full_name, language, node_type).
    """
    key = ["path", "language", "scope", "target"]
    wanted = wanted.select(*key).distinct()
    around = wanted.select(*key, F.explode(_scopes(F.col("scope"))).alias("s")).select(*key, F.col("s.rank").alias("rank"), F.concat("s.scope", F.lit("."), "target").alias("full"))
    first, rest = F.substring_index("target", ".", 1), F.regexp_extract("target", r"^[^.]*(.*)$", 1)
    named = imports.filter(F.col("name").isNotNull()).select("path", F.col("name").alias("first"), F.col("target").alias("to"))
    whole = imports.filter(F.col("name").isNull()).select("path", F.col("target").alias("to"))
    by_name = wanted.withColumns({"first": first, "rest": rest}).join(named, ["path", "first"]).select(*key, F.lit(BY_NAME).alias("rank"), F.concat("to", "rest").alias("full"))
    by_space = wanted.join(whole, "path").select(*key, F.lit(BY_NAMESPACE).alias("rank"), F.concat("to", F.lit("."), "target").alias("full"))
    written = wanted.select(*key, F.lit(AS_WRITTEN).alias("rank"), F.col("target").alias("full"))
    every = reduce(DataFrame.unionByName, [around, by_name, by_space, written])
    known = types.select(F.col("full_name").alias("full"), "language", F.col("node_type").alias("found_type"))
    best = every.join(known, ["full", "language"]).groupBy(*key).agg(F.min(F.struct("rank", "full", "found_type")).alias("best"))
    return best.select("path", "scope", "target", F.col("best.full").alias("found"), F.col("best.found_type").alias("found_type"))


def ancestors(derives: DataFrame, store: Stored, depth: int = 8) -> DataFrame:
    """(full, ancestor, up) of (full, base) pairs: each type with itself at 0 and what it derives from, up to so many levels."""
    pairs = store.cut(derives.distinct())
    level = pairs.select("full", F.col("base").alias("ancestor"))
    out = []
    for up in range(1, depth + 1):
        level = store.cut(level.distinct())
        if level.isEmpty():
            break
        out.append(level.withColumn("up", F.lit(up)))
        level = level.join(pairs.select(F.col("full").alias("ancestor"), "base"), "ancestor").select("full", F.col("base").alias("ancestor"))
    found = reduce(DataFrame.unionByName, out) if out else pairs.select("full", F.col("base").alias("ancestor"), F.lit(1).alias("up")).limit(0)
    return found.filter("full <> ancestor").groupBy("full", "ancestor").agg(F.min("up").alias("up"))


def _owners(calls: DataFrame, receivers: DataFrame, imports: DataFrame, above: DataFrame) -> DataFrame:
    """(rid, language, called, args, rank, owner): where the member that a call names may be declared."""
    key = ["rid", "language", "called", "args"]
    own = calls.filter("own AND owner IS NOT NULL").select(*key, F.lit(0).alias("rank"), "owner")
    plain = calls.filter("NOT own AND target IS NULL")
    around = plain.select(*key, F.explode(_scopes(F.col("scope"))).alias("s")).select(*key, (F.col("s.rank") * 100).alias("rank"), F.col("s.scope").alias("owner"))
    named = imports.filter("name IS NOT NULL AND contains(target, '.')").select("path", F.col("name").alias("called"), F.col("target").alias("to"))
    last = F.substring_index("to", ".", -1)
    by_name = plain.join(named, ["path", "called"]).select("rid", "language", last.alias("called"), "args", F.lit(BY_NAME * 100).alias("rank"), F.expr("left(to, length(to) - length(substring_index(to, '.', -1)) - 1)").alias("owner"))
    whole = imports.filter("name IS NULL").select("path", F.col("target").alias("to"))
    by_space = plain.join(whole, "path").select(*key, F.lit(BY_NAMESPACE * 100).alias("rank"), F.col("to").alias("owner"))
    by_type = calls.filter("target IS NOT NULL").join(receivers.select("path", "scope", "target", "found"), ["path", "scope", "target"]).select(*key, F.lit(0).alias("rank"), F.col("found").alias("owner"))
    every = reduce(DataFrame.unionByName, [own, around, by_name, by_space, by_type])
    inherited = every.join(above, every["owner"] == above["full"]).select(*key, (F.col("rank") + F.col("up")).alias("rank"), F.col("ancestor").alias("owner"))
    return every.unionByName(inherited)


def _projects(files: DataFrame, path_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of solutions and projects: what they refer to, and which files stand below which project."""
    path, text = F.col(path_col), F.col(text_col)
    own = files.filter(path.rlike(r"\.(cs|fs|vb)proj$|\.sln$")).select(path.alias("path"), text.alias("text"))
    project = own.filter("path NOT LIKE '%.sln'").withColumn("name", F.regexp_extract(file_name(F.col("path")), r"^(.*)\.[^.]*$", 1))
    solution = own.filter("path LIKE '%.sln'").withColumn("name", F.regexp_extract(file_name(F.col("path")), r"^(.*)\.[^.]*$", 1))

    def nodes(df: DataFrame, kind: str) -> DataFrame:
        return df.select(F.concat(F.lit(f"{kind.lower()}|"), "name").alias("id"), F.lit(kind).alias("node_type"), "name", F.col("name").alias("full_name"), F.col("path").alias("file_path"))

    ids = project.select(F.concat(F.lit("project|"), "name").alias("target_id"))
    refs = project.select(F.concat(F.lit("project|"), "name").alias("source_id"), F.explode(F.regexp_extract_all("text", F.lit(r'<ProjectReference\s+Include="(?:[^"]*[\\/])?([^"\\/]+)\.\w+"'), 1)).alias("to"))
    inside = solution.select(F.concat(F.lit("solution|"), "name").alias("source_id"), F.explode(F.regexp_extract_all("text", F.lit(r'(?m)^Project\("[^"]*"\)\s*=\s*"([^"]+)"'), 1)).alias("to"))
    known = lambda df, kind: df.select(F.lit(kind).alias("edge_type"), "source_id", F.concat(F.lit("project|"), "to").alias("target_id")).join(ids.distinct(), "target_id", "left_semi")
    # A file belongs to the project of the nearest folder above it: each of its folders is a row, an equi-join finds projects.
    parts = F.split(F.ltrim(folder(path), F.lit("/")), "/")
    above = files.filter(~path.rlike(r"\.(cs|fs|vb)proj$|\.sln$")).select(path.alias("file"), F.explode(F.transform(F.sequence(F.size(parts), F.lit(1)), lambda k: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), k), "/")))).alias("folder"))
    homes = project.select(folder(F.col("path")).alias("folder"), F.concat(F.lit("project|"), "name").alias("source_id"))
    nearest = above.join(homes, "folder").groupBy("file").agg(F.max_by("source_id", F.struct(F.length("folder"), "source_id")).alias("source_id"))
    belongs = nearest.select(F.lit("Contains").alias("edge_type"), "source_id", F.concat(F.lit("file|"), "file").alias("target_id"))
    edges = reduce(DataFrame.unionByName, [known(refs, "References"), known(inside, "Contains"), belongs])
    return nodes(project, "Project").unionByName(nodes(solution, "Solution")), edges


def source_graph(files: DataFrame, root: str = "", path_col: str = "path", text_col: str = "content") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, errors) of source files: NODE columns; (edge_type, source_id, target_id); (path, error) of files that gave nothing.

    Project and solution files give projects, what they refer to and contain. Python modules are named by their paths below root.
    """
    store = Stored(files.sparkSession, "source_graph")
    sources = files.filter(~F.col(path_col).rlike(r"\.(cs|fs|vb)proj$|\.sln$"))
    facts = store.cut(source_facts(sources, "node,edge,ref,import", root, path_col, text_col))
    declared, imports = split_by_kind(facts, "node"), split_by_kind(facts, "import").select("path", "name", "target")
    refs = split_by_kind(facts, "ref").withColumn("rid", F.struct("path", "ord"))
    errors = split_by_kind(facts, "error").select("path", F.concat_ws(": ", "name", "text").alias("error"))

    # Parts of a type, and a namespace of many files, are one node: the first by path and line.
    first = F.min(F.struct("path", F.col("start_line").alias("line"), "node_type", "name", "full_name", "owner", "language", "signature", "modifiers", "takes", "least")).alias("n")
    nodes = store.cut(declared.groupBy("node_id").agg(first).select("node_id", "n.*"))
    types = nodes.filter(F.col("node_type").isin(*TYPE_KINDS, "Namespace")).select("full_name", "language", "node_type")

    # Names of types: bases, constructions, receivers of calls. In Python a construction is written as a call.
    constructs = refs.filter("relation = 'call' AND language = 'python' AND NOT own").withColumns({"relation": F.lit("new"), "target": F.concat_ws(".", "target", "name")})
    typed = refs.filter("target IS NOT NULL").unionByName(constructs)
    named = store.cut(resolved_types(typed, imports, types))
    found = typed.join(named, ["path", "scope", "target"], "left")
    is_type = F.coalesce(F.col("found_type").isin(*TYPE_KINDS), F.lit(False))

    kinds = nodes.select(F.col("node_id").alias("source_id"), F.col("node_type").alias("source_type"))
    bases = found.filter("relation = 'base'").join(kinds, "source_id").filter("source_type <> 'Enum'")
    interface = F.when(is_type, F.col("found_type") == "Interface").otherwise(F.substring_index("target", ".", -1).rlike("^I[A-Z]"))
    implements = (interface & (F.col("language") != "python")) | F.col("source_type").isin("Struct", "Interface")
    base_edges = bases.select(F.when(implements, "Implements").otherwise("Inherits").alias("edge_type"), "source_id", F.when(is_type, F.col("found")).otherwise(F.col("target")).alias("target_id"))
    uses = found.filter((F.col("relation") == "new") & is_type).select(F.lit("Uses").alias("edge_type"), "source_id", F.col("found").alias("target_id"))

    above = store.cut(ancestors(bases.filter(is_type).select(F.col("source_id").alias("full"), F.col("found").alias("base")), store))
    members = nodes.filter(F.col("node_type") == "Method").select(F.col("owner"), F.col("name").alias("called"), "language", "node_id", "takes", "least", "line")
    calls = refs.filter("relation = 'call'").withColumn("called", F.col("name"))
    candidates = _owners(calls, named, imports, above)
    fits = F.when(F.col("args").between(F.col("least"), F.col("takes")), 0).otherwise(1)
    best = candidates.join(members, ["owner", "called", "language"]).groupBy("rid").agg(F.min(F.struct("rank", fits.alias("fits"), "line", "node_id")).alias("best"))
    receivers = named.select("path", "scope", "target", F.col("found").alias("receiver"))
    built = constructs.join(named.filter(is_type), ["path", "scope", "target"]).select("rid")
    called = calls.join(best, "rid", "left").join(receivers, ["path", "scope", "target"], "left").join(built, "rid", "left_anti")
    outside = F.concat_ws(".", F.coalesce("receiver", "target"), "called")
    call_edges = called.select(F.lit("Calls").alias("edge_type"), "source_id", F.coalesce("best.node_id", outside).alias("target_id"))

    # A method overrides that of its nearest ancestor with its name; in C# only if it says so.
    methods = nodes.filter("node_type = 'Method'").select("node_id", "owner", "name", "language", "modifiers", "takes")
    says = (F.col("language") != "csharp") | F.col("modifiers").contains("override")
    over = methods.filter(says).join(above, F.col("owner") == F.col("full")).select(F.col("node_id").alias("source_id"), F.col("ancestor").alias("owner"), "name", "language", F.col("takes").alias("own_takes"), "up")
    over = over.join(methods, ["owner", "name", "language"]).join(nodes.filter("node_type <> 'Interface'").select(F.col("full_name").alias("owner")).distinct(), "owner", "left_semi")
    override_edges = over.groupBy("source_id").agg(F.min(F.struct((F.col("takes") != F.col("own_takes")).alias("differs"), "up", "node_id")).alias("best")).select(F.lit("Overrides").alias("edge_type"), "source_id", F.col("best.node_id").alias("target_id"))

    project_nodes, project_edges = _projects(files, path_col, text_col)
    declared_edges = split_by_kind(facts, "edge").select("edge_type", "source_id", "target_id")
    edges = store.cut(reduce(DataFrame.unionByName, [declared_edges, base_edges, uses, call_edges, override_edges, project_edges]).distinct())

    none = F.lit(None)
    own = nodes.select(F.col("node_id").alias("id"), "node_type", "name", "full_name", F.col("path").alias("file_path"), F.col("line").alias("line_number"), "signature", "modifiers", F.lit(False).alias("is_external"))
    more = project_nodes.select("id", "node_type", "name", "full_name", "file_path", none.cast("int").alias("line_number"), none.cast("string").alias("signature"), none.cast("string").alias("modifiers"), F.lit(False).alias("is_external"))
    own = own.unionByName(more)
    kind = F.when(F.col("edge_type") == "Calls", "Method").when(F.col("edge_type") == "Implements", "Interface").otherwise("Class")
    ends = edges.filter(F.col("edge_type").isin("Calls", "Implements", "Inherits")).select(F.col("target_id").alias("id"), kind.alias("node_type"))
    lacking = ends.join(own.select("id"), "id", "left_anti").groupBy("id").agg(F.min("node_type").alias("node_type"))
    placeholders = lacking.select(
        "id", "node_type", F.substring_index("id", ".", -1).alias("name"), F.col("id").alias("full_name"), none.cast("string").alias("file_path"), none.cast("int").alias("line_number"),
        none.cast("string").alias("signature"), none.cast("string").alias("modifiers"), F.lit(True).alias("is_external"),
    )
    return own.unionByName(placeholders).select(*NODE), edges, errors
