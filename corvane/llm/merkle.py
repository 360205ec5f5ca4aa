"""Merkle manifest of a table: a digest per row, folded by eights into a root, with a proof for every row.

H is the lowercase hex SHA-256 of its inputs' concatenation. A leaf is H of a row's columns, each `-` if null, else its UTF-8
byte count, `:` and its value. Leaves of a group ascend by id; while there are several nodes, every `FAN` consecutive ones become
their H. Groups' subroots, in the order of the groups' names, are folded likewise into the root. A row's proof is the H of its
siblings, level by level up to the root.

1. Leaves are made by SQL functions, stored, and put in order by one range partitioning; a task numbers what it has, and
   the counts by task and group give the offsets. Of a row only ids and digests move.
2. A block is FAN^`HEIGHT` leaves at an aligned place. One recursive postorder traversal of a block returns its digest, and
   appends to each leaf that it contains the siblings of the subtree on its way while it unwinds.
3. Block roots are the leaves of another traversal, distributed alike, until each group has one node; the groups' subroots are
   one more group. Then the ways of block roots go down again, a traversal a tier, and each row's proof is its way in its block and
   the way of its block.

Null groups come first and null ids before others; rows of equal ids go by their leaves, so repeated rows have a leaf each. Texts of
any length are hashed whole. An empty table has no rows. Columns other than the ones named don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shipping import ship_package
from .support import Stored, hinted, spread, table

FAN = 8
HEIGHT = 4
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPER_EVERY = 3

#: Left and right siblings of a node, level by level: what its ancestors' digests need beside its own.
Way = list[tuple[bytes, bytes]]


def h(*parts: bytes) -> bytes:
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


def leaf(row: DataFrame, columns: tuple[str, ...] = COLUMNS, replaced: dict[str, Column] | None = None) -> Column:
    """The digest of a row's columns."""
    values = [(replaced or {}).get(c, F.col(c)).cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]), 256)


def levels(n: int) -> int:
    """How often n nodes are folded until one is left."""
    k = 0
    while n > 1:
        n, k = -(-n // FAN), k + 1
    return k


def traverse(digests: list[bytes], height: int, ways: list[Way]) -> bytes:
    """The digest of a subtree of so many levels over these leaves; the siblings on the way up are appended to each leaf's way."""
    if height == 0:
        return digests[0]
    size = FAN ** (height - 1)
    cuts = range(0, len(digests), size)
    run = [traverse(digests[a : a + size], height - 1, ways[a : a + size]) for a in cuts]
    for k, a in enumerate(cuts):
        step = b"".join(run[:k]), b"".join(run[k + 1 :])
        for way in ways[a : a + size]:
            way.append(step)
    return h(*run)


def fold(digest: bytes, way: Way) -> bytes:
    """The root that a node with this digest and way would have. A way's steps without siblings are folds of one node."""
    for left, right in way:
        digest = h(left, digest, right)
    return digest


def proof(way: Way) -> bytes:
    return h(*[part for step in way for part in step])


def numbered(nodes: DataFrame, order: list[str], store: Stored) -> DataFrame:
    """Stored nodes with their place `pos` in their group `grp`, ordered so, and the group's size `n`."""
    spark = nodes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = nodes.repartitionByRange(parts, "grp", *order).sortWithinPartitions("grp", *order).withColumn("part", F.spark_partition_id())
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranged.schema)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at = None, 0
        for b in batches:
            seq = []
            for g in b.column("grp").to_pylist():
                at = at + 1 if g == now else 0
                now = g
                seq.append(at)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(seq, pa.int64())], names=[*b.schema.names, "seq"])

    rows = store.cut(ranged.mapInArrow(number, f"{fields}, seq long"))
    # One row for each task and group that it has rows of: a task has a range, so these are no more than tasks and groups together.
    counts = store.cut(rows.groupBy("grp", "part").agg(F.count(F.lit(1)).alias("c")))
    by = Window.partitionBy("grp")
    before = F.sum("c").over(by.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = store.cut(counts.select(F.col("grp").alias("g"), F.col("part").alias("p"), F.coalesce(before, F.lit(0)).alias("before"), F.sum("c").over(by).alias("n")))
    held = rows.join(hinted(offsets, offsets.count()), (F.col("grp") == F.col("g")) & (F.col("part") == F.col("p")))
    return held.withColumn("pos", F.col("before") + F.col("seq")).drop("part", "seq", "g", "p", "before")


def _blocks(nodes: DataFrame, tall: int) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"pos div {FAN**tall}"))


def _ordered(t: pa.Table, tall: int) -> tuple[pa.Table, list[bytes], int]:
    """(rows in order, their digests, levels of the block): the last block of a tree of several has as many as the others."""
    t = t.sort_by("pos")
    return t, [d.encode() for d in t["digest"].to_pylist()], min(tall, levels(t["n"][0].as_py()))


def block_roots(nodes: DataFrame, tall: int, store: Stored) -> DataFrame:
    """The next tier of nodes (grp, pos, n, digest): the digests of blocks, as leaves of their groups' trees."""
    schema = pa.schema([("grp", pa.string()), ("pos", pa.int64()), ("n", pa.int64()), ("digest", pa.string())])

    def run(key: tuple, t: pa.Table) -> pa.Table:
        t, digests, height = _ordered(t, tall)
        found = traverse(digests, height, [[] for _ in digests])
        values = [t["grp"][0].as_py(), t["block"][0].as_py(), -(-t["n"][0].as_py() // FAN**tall), found.decode()]
        return pa.Table.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema)], schema=schema)

    return store.cut(_blocks(nodes.select("grp", "pos", "n", "digest"), tall).groupBy("grp", "block").applyInArrow(run, "grp string, pos long, n long, digest string"))


def _way(packed: list[dict]) -> Way:
    return [(s["l"].encode(), s["r"].encode()) for s in packed]


WAY = pa.list_(pa.struct([("l", pa.string()), ("r", pa.string())]))
WAYS = "grp string, pos long, digest string, way array<struct<l: string, r: string>>"


def ways_down(nodes: DataFrame, above: DataFrame, tall: int, store: Stored) -> DataFrame:
    """(grp, pos, digest, way) of a tier: each node's way in its block, then the way of its block in the tier above."""
    schema = pa.schema([("grp", pa.string()), ("pos", pa.int64()), ("digest", pa.string()), ("way", WAY)])

    def run(key: tuple, t: pa.Table, over: pa.Table) -> pa.Table:
        t, digests, height = _ordered(t, tall)
        ways: list[Way] = [[] for _ in digests]
        traverse(digests, height, ways)
        rest = over["way"][0].as_py()
        packed = [[{"l": a.decode(), "r": b.decode()} for a, b in w] + rest for w in ways]
        return pa.Table.from_arrays([t["grp"].combine_chunks(), t["pos"].combine_chunks(), t["digest"].combine_chunks(), pa.array(packed, WAY)], schema=schema)

    left = _blocks(nodes.select("grp", "pos", "n", "digest"), tall)
    return store.cut(left.groupBy("grp", "block").cogroup(above.withColumnRenamed("pos", "block").groupBy("grp", "block")).applyInArrow(run, WAYS))


def tiers(nodes: DataFrame, tall: int, store: Stored) -> list[DataFrame]:
    """A tier of nodes and those above it, up to one node a group."""
    out = [nodes]
    while (out[-1].agg(F.max("n")).first()[0] or 0) > 1:
        out.append(block_roots(out[-1], tall, store))
    return out


def manifest(leaves: DataFrame, store: Stored, tall: int = HEIGHT) -> DataFrame:
    """(row, leaf, subroot, root, proof, folded) of rows (row, grp, digest, tampered): grp is not null, row orders a group. Blocks are `tall` levels."""
    ship_package(leaves.sparkSession)
    own = numbered(leaves, ["row", "digest"], store)
    up = tiers(own, tall, store)
    # Groups' subroots are one more group, in the order of the groups' names.
    subroots = up[-1].select(F.lit("").alias("grp"), F.col("grp").alias("name"), "digest")
    top = tiers(store.cut(numbered(subroots, ["name"], store)), tall, store)
    root = top[-1].select("digest").first()
    if root is None:
        return leaves.select("row", F.col("digest").alias("leaf"), *[F.lit(None).cast("string").alias(c) for c in ("subroot", "root", "proof", "folded")])
    above = top[-1].select("grp", "pos", "digest", F.array().cast("array<struct<l: string, r: string>>").alias("way"))
    for tier in reversed(top[:-1]):
        above = ways_down(tier, above, tall, store)
    names = top[0].select(F.col("name"), F.col("pos").alias("at"))
    above = above.join(names, F.col("pos") == F.col("at")).select(F.col("name").alias("grp"), F.lit(0).cast("long").alias("pos"), "digest", "way")
    above = subroot = store.cut(above)
    for tier in reversed(up[1:-1]):
        above = ways_down(tier, above, tall, store)
    if len(up) > 2:
        above = above.join(subroot.select("grp", F.col("digest").alias("subroot")), "grp")
    else:
        above = above.withColumn("subroot", F.col("digest"))
    root = root[0]
    names_ = ["row", "leaf", "subroot", "root", "proof", "folded"]
    kind = leaves.schema["row"].dataType.simpleString()

    def run(key: tuple, t: pa.Table, over: pa.Table) -> pa.Table:
        t, digests, height = _ordered(t, tall)
        ways: list[Way] = [[] for _ in digests]
        traverse(digests, height, ways)
        rest = _way(over["way"][0].as_py())
        proofs, folds = [], []
        for way, tampered in zip(ways, t["tampered"].to_pylist()):
            way += rest
            proofs.append(proof(way).decode())
            folds.append(fold(tampered.encode(), way).decode())
        n = len(digests)
        cols = [t["row"].combine_chunks(), t["digest"].combine_chunks(), pa.array([over["subroot"][0].as_py()] * n), pa.array([root] * n), pa.array(proofs), pa.array(folds)]
        return pa.Table.from_arrays(cols, names=names_)

    # With one tier, groups have a single leaf each, and the tier above is the tier itself.
    left = _blocks(own.select("row", "grp", "pos", "n", "digest", "tampered"), tall)
    over = above.select("grp", F.col("pos").alias("block"), "subroot", "way")
    out = left.groupBy("grp", "block").cogroup(over.groupBy("grp", "block")).applyInArrow(run, f"row {kind}, leaf string, subroot string, root string, proof string, folded string")
    return out


def document_manifest(docs: DataFrame, tall: int = HEIGHT) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of documents, some of which are tampered with."""
    spark = docs.sparkSession
    store = Stored(spark, "merkle")
    # Lower-case only A to Z; crc32 of the id in decimal decides which rows are tampered with.
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lowered = F.translate("text", capitals, capitals.lower())
    touched = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER_EVERY == 0, F.lit(False)) & F.col("text").rlike("[A-Z]")
    own = docs.select(*COLUMNS, F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("grp"), leaf(docs).alias("digest"), touched.alias("touched"), lowered.alias("lowered"))
    tampered = F.when(F.col("touched"), leaf(own, COLUMNS, {"text": F.col("lowered")})).otherwise(F.col("digest"))
    leaves = store.cut(own.select(F.col("doc_id").alias("row"), "grp", "digest", tampered.alias("tampered")))
    found = manifest(leaves, store, tall)
    return found.select(F.col("row").alias("doc_id"), "leaf", "subroot", "root", F.col("proof").alias("proof_sha256"), F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_manifest(spread(table(spark, sf_dir, "documents")))


def _sql(deep: int = 6, wide: int = 3) -> str:
    """The same by a join a level, for groups of at most FAN^deep rows and FAN^wide groups; CRC-32 bit by bit, as DuckDB has none."""

    def digest(text: str) -> str:
        return "sha256(" + " || ".join(f"coalesce(strlen({v}::VARCHAR)::VARCHAR || ':' || {v}::VARCHAR, '-')" for v in (c if c != "text" else text for c in COLUMNS)) + ")"

    def tree(name: str, depth: int) -> list[str]:
        """Nodes {name}k of each level, and {name}s_k with their left and right siblings."""
        out = []
        for k in range(depth):
            out.append(f"""{name}{k + 1} AS (SELECT g, pos // {FAN} AS pos, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(d, '' ORDER BY pos)) ELSE any_value(d) END AS d,
                (any_value(n) + {FAN - 1}) // {FAN} AS n FROM {name}{k} GROUP BY g, pos // {FAN})""")
            out.append(f"""{name}s{k} AS (SELECT a.g, a.pos, coalesce(string_agg(b.d, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l, coalesce(string_agg(b.d, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
                FROM {name}{k} AS a JOIN {name}{k} AS b ON a.g = b.g AND a.pos // {FAN} = b.pos // {FAN} WHERE a.n > 1 GROUP BY a.g, a.pos)""")
        return out

    def way(name: str, depth: int, first: str, start: str) -> list[str]:
        """The fold of each leaf's x, and what its siblings are, a level at a time."""
        out = [f"{name}0 AS ({start})"]
        for k in range(depth):
            out.append(f"""{name}{k + 1} AS (SELECT f.* EXCLUDE (x, pr), CASE WHEN s.pos IS NULL THEN x ELSE sha256(s.l || x || s.r) END AS x, pr || coalesce(s.l || s.r, '') AS pr
                FROM {name}{k} AS f LEFT JOIN {first}s{k} AS s ON f.g = s.g AND f.pos // {FAN**k} = s.pos)""")
        return out

    bits = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, i: xor(x // 2, (x % 2) * 3988292384))"
    crc = f"xor(4294967295, list_reduce(list_prepend(4294967295, [ascii(y)::BIGINT for y in string_split(doc_id::VARCHAR, '')]), lambda c, b: {bits}))"
    steps = [
        f"""own AS (SELECT doc_id, coalesce('=' || lang, '') AS g, {digest("text")} AS d,
            CASE WHEN {crc} % {TAMPER_EVERY} = 0 THEN {digest("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS t FROM documents)""",
        "n0 AS (SELECT doc_id, g, d, coalesce(t, d) AS x, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, d) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM own)",
        *tree("n", deep),
        *way("f", deep, "n", "SELECT doc_id, g, pos, d AS leaf, x, '' AS pr FROM n0"),
        f"m0 AS (SELECT '' AS g, g AS name, d, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM n{deep})",
        *tree("m", wide),
        *way("e", wide, "m", f"SELECT f.doc_id, f.leaf, m.g, m.pos, m.d AS subroot, f.x, f.pr FROM f{deep} AS f JOIN m0 AS m ON f.g = m.name"),
    ]
    joined = ",\n".join(steps)
    return f"""WITH {joined}
SELECT e.doc_id, e.leaf, e.subroot, r.d AS root, sha256(e.pr) AS proof_sha256, e.x AS folded_root, e.x = r.d AS verified FROM e{wide} AS e CROSS JOIN m{wide} AS r"""


SQL = _sql()
