"""Near copies by SimHash and word shingles: pairs whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

1. Texts are lowered and cut into words as for fingerprints. Texts of equal shingle sets collapse to one vertex, named by
   the smallest doc_id. A text of fewer words than a shingle is one shingle; null texts and those without words are equal.
2. Each vertex has the SimHash fingerprint of its shingles. Vertices whose fingerprints differ in 4 bits or fewer are candidates, found by
   the cells and pivots of `simhash.links`; none of these is lost.
3. Many texts of a similarity of 0.8 have fingerprints further apart. So each vertex has `BANDS` keys too, each of the minima of `ROWS` hash functions
   over its shingles, and a shared key makes candidates: a pair of similarity s shares one with probability 1 - (1 - s^ROWS)^BANDS, all but 3 in a million at 0.8.
4. Vertices that candidates join, directly or by others, are a group. A group of over `CELL` vertices or `CELL_SHINGLES`
   shingles is dealt into chunks, and each pair of chunks is a cell of its own.
5. In a cell, candidates, by fingerprints first, are compared by their whole shingle sets, in whole numbers. Pairs that links have
   joined already are left out, so a cell of copies costs one comparison each. It returns one row per linked vertex.
6. The components of these rows keep their smallest doc_id. Texts of members, and rows that go, are found where they are read: few
   ids go to every task, of many a filter of bounded size does, so that of all texts only members' are shuffled.

Repeated rows are alike. Rows of null doc_ids stay and are compared with none. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship_package
from . import simhash
from .simhash import LINK_SCHEMA, SEED, components
from .support import Stored, free_name, groups, join_by_key, join_few

SHINGLE = 5
#: The least similarity of near copies, as a fraction.
LEAST = (4, 5)
BANDS = 32
ROWS = 5
CELL = 1024
CELL_SHINGLES = 1 << 21
#: Ids up to which they go to every task themselves, at 28 bytes each; beyond that a filter of them does.
MAX_BROADCAST = 200_000

_RANDOM = np.random.default_rng(SEED)
_FACTORS = _RANDOM.integers(0, 1 << 32, BANDS * ROWS, np.uint64).astype(np.uint32) | np.uint32(1)
_TERMS = _RANDOM.integers(0, 1 << 32, BANDS * ROWS, np.uint64).astype(np.uint32)
_MIXERS = _RANDOM.integers(0, 1 << 63, (BANDS, ROWS + 1), np.uint64) | np.uint64(1)


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The different hashes of a text's shingles, in order."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()  # on bytes, both regard ASCII alone
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) < size:
        return np.array([digest(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - size + 1].tolist()
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist())], np.uint64))


def band_keys(own: np.ndarray) -> np.ndarray:
    """The keys of a shingle set, none of an empty one."""
    if len(own) == 0:
        return np.zeros(0, np.int64)
    low = (own ^ (own >> np.uint64(32))).astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(low), 1024):
        np.minimum(least, (_FACTORS[:, None] * low[None, a : a + 1024] + _TERMS[:, None]).min(1), out=least)
    rows = least.reshape(BANDS, ROWS).astype(np.uint64)
    keys = _MIXERS[:, ROWS].copy()
    for k in range(ROWS):
        keys = (keys ^ rows[:, k]) * _MIXERS[:, k]
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


def _sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_hash, own, n, fp, keys): own is a hash of the shingle set, n its size, fp its fingerprint."""
    fields = [("doc_id", pa.int64()), ("text_hash", pa.int64()), ("own", pa.int64()), ("n", pa.int64()), ("fp", pa.int64()), ("keys", pa.list_(pa.int64()))]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for whole in batches:
            for batch in groups(whole, 1_000_000):
                sets = [shingles(t) for t in batch.column(1).to_pylist()]
                own = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
                keys = pa.array([band_keys(s) for s in sets], pa.list_(pa.int64()))
                fps = np.array([simhash.majority(s) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
                cols = [batch.column(0).cast(pa.int64()), batch.column(2), pa.array(own), pa.array([len(s) for s in sets], pa.int64()), pa.array(fps), keys]
                yield pa.RecordBatch.from_arrays(cols, schema=schema)

    rows = docs.select(F.col(id_col).cast("long"), text_col, F.xxhash64(text_col))
    return rows.mapInArrow(run, "doc_id long, text_hash long, own long, n long, fp long, keys array<long>")


def by_fingerprints(vertices: DataFrame, store: Stored) -> DataFrame:
    """(a, b) with a > b: rows whose components are those of all pairs of vertices (id, n, fp) with near fingerprints; empty sets have none."""
    own = vertices.filter("n > 0").select("id", "fp")
    least = store.cut(simhash.with_table(own.groupBy("fp").agg(F.min("id").alias("id"))))
    same = own.join(least.select("fp", F.col("id").alias("b")), "fp").filter("id > b").select(F.col("id").alias("a"), "b")
    return simhash.links(least, least.count(), store).unionByName(same)


def cell_links(keys: np.ndarray, sets: list[np.ndarray], side: np.ndarray | None, fps: np.ndarray | None = None) -> np.ndarray:
    """For each member, the smallest that links reach: pairs that have near fingerprints or share a key, and are similar. With sides, only between them."""
    n = len(sets)
    at, sizes = np.arange(n), np.array([len(s) for s in sets])
    tested = np.zeros((n, n), bool)

    def link(x: int, others: np.ndarray) -> None:
        """Links x to those of the others that are similar."""
        near = (at[others] != at[x]) & ~tested[x, others]
        if side is not None:
            near &= side[others] != side[x]
        near &= LEAST[1] * np.minimum(sizes[others], sizes[x]) >= LEAST[0] * np.maximum(sizes[others], sizes[x])
        others = others[near]
        for a in range(0, len(others), 64):
            part = others[a : a + 64]
            part = part[at[part] != at[x]]
            if len(part) == 0:
                continue
            tested[x, part] = tested[part, x] = True
            every = np.concatenate([sets[k] for k in part])
            found = np.minimum(np.searchsorted(sets[x], every), sizes[x] - 1)
            starts = np.concatenate([[0], np.cumsum(sizes[part])[:-1]])
            both = np.add.reduceat((sets[x][found] == every).astype(np.int64), starts)
            for k in part[LEAST[1] * both >= LEAST[0] * (sizes[part] + sizes[x] - both)]:
                low, high = sorted((at[x], at[k]))
                at[at == high] = low

    if fps is not None:
        i, j = simhash.cell_links(fps, side)
        order = np.argsort(i, kind="stable")
        i, j = i[order], j[order]
        for run in np.split(np.arange(len(i)), np.flatnonzero(np.diff(i)) + 1):
            if len(run):
                link(i[run[0]], j[run])
    for band in range(keys.shape[1]):
        order = np.argsort(keys[:, band], kind="stable")
        cuts = np.flatnonzero(np.diff(keys[order, band])) + 1
        for run in np.split(order, cuts):
            for x in run:
                if len(run) < 2 or (at[run] == at[run[0]]).all():
                    break
                link(x, run)
    return at


def _verified(cells: DataFrame) -> DataFrame:
    """(a, b) with a > b, from rows (cell, side, id, shingles, keys, fp)."""

    def links(held: list[tuple]) -> list[np.ndarray]:
        held.sort(key=lambda m: m[1])  # so that the smallest index has the smallest id
        side = np.array([m[0] for m in held])
        ids = np.array([m[1] for m in held], np.int64)
        sets = [np.frombuffer(m[2], np.uint64) for m in held]
        fps = np.array([m[4] for m in held], np.int64).view(np.uint64)
        to = cell_links(np.stack([m[3] for m in held]), sets, None if side.min() < 0 else side, fps)
        moved = np.flatnonzero(ids != ids[to])
        return [ids[moved], ids[to[moved]]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now = None
        for batch in batches:
            for cell, side, i, own, keys, fp in zip(*(batch.column(k) for k in range(6))):
                if cell.as_py() != now:
                    if len(held) > 1:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in links(held)], schema=LINK_SCHEMA)
                    held, now = [], cell.as_py()
                held.append((side.as_py(), i.as_py(), own.as_py(), keys.values.to_numpy().copy(), fp.as_py()))  # a view would hold the whole batch
        if len(held) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in links(held)], schema=LINK_SCHEMA)

    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cells.repartition(parts, "cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long").distinct()


def _cells(docs: DataFrame, members: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """Rows (cell, side, id, shingles, keys, fp) of the n stored members (id, text_hash, root, chunks, fp) of groups."""
    schema = pa.schema([("id", pa.int64()), ("root", pa.int64()), ("chunks", pa.int32()), ("fp", pa.int64()), ("shingles", pa.binary()), ("keys", pa.list_(pa.int64()))])
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in groups(whole, 1_000_000):
                sets = [shingles(t) for t in batch.column(1).to_pylist()]
                cols = [batch.column(0), *batch.columns[2:5], pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([band_keys(s) for s in sets], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, schema=schema)

    if n <= MAX_BROADCAST:
        members = F.broadcast(members)
    else:
        texts = join_few(texts, F.col("id"), members.select(F.col("id").alias("member")), "member", n, "left_semi", MAX_BROADCAST)
    rows = texts.join(members, ["id", "text_hash"]).select("id", "text", "root", "chunks", "fp")
    rows = rows.mapInArrow(run, "id long, root long, chunks int, fp long, shingles binary, keys array<long>")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return rows.select(
        F.xxhash64("root", F.least("own", "other"), F.greatest("own", "other")).alias("cell"),
        F.when(F.col("own") == F.col("other"), -1).otherwise((F.col("own") > F.col("other")).cast("int")).cast("byte").alias("side"),
        "id",
        "shingles",
        "keys",
        "fp",
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose id is the smallest of their component; of repeated rows all or none stay. Null ids stay."""
    spark = docs.sparkSession
    ship_package(spark)
    store = Stored(spark, "near_copies")
    one = F.min(F.struct("doc_id", "text_hash"))
    sketches = store.cut(_sketches(docs.filter(F.col(id_col).isNotNull()), id_col, text_col))
    vertices = sketches.groupBy("own").agg(one.alias("one"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys"), F.count(F.lit(1)).alias("rows"))
    vertices = store.cut(vertices.select("own", F.col("one.doc_id").alias("id"), F.col("one.text_hash").alias("text_hash"), "n", "fp", "keys", "rows"))

    rows = vertices.select("id", F.explode("keys").alias("key"))
    least = rows.groupBy("key").agg(F.min("id").alias("b"), F.max("id").alias("most")).filter("b < most").select("key", "b")
    edges = rows.join(least, "key").filter("id > b").select(F.col("id").alias("a"), "b")
    joined = components(edges.unionByName(by_fingerprints(vertices, store)).distinct(), store)
    members = store.cut(vertices.join(joined, "id").select("id", "text_hash", "n", "fp", "root"))
    chunks = F.ceil(F.greatest(F.count(F.lit(1)) / CELL, F.sum("n") / CELL_SHINGLES)).cast("int")
    large = members.groupBy("root").agg(chunks.alias("chunks")).filter("chunks > 1")
    members = store.cut(members.join(large, "root", "left").select("id", "text_hash", "root", "fp", F.coalesce("chunks", F.lit(1)).alias("chunks")))
    labels = components(_verified(_cells(docs, members, members.count(), id_col, text_col)), store)
    # What goes: rows whose shingle set has a vertex of a smaller id, and vertices that aren't the smallest of their component.
    name = free_name(docs, "gone")
    moved = labels.filter("id != root").select("id")
    least = vertices.select("own", "rows", F.col("id").alias("first")).join(moved.select(F.col("id").alias("first"), F.lit(True).alias("goes")), "first", "left")
    total = vertices.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    found = join_by_key(sketches.select("doc_id", "own"), least, ["own"], "rows", total)
    gone = found.filter((F.col("doc_id") != F.col("first")) | F.coalesce("goes", F.lit(False))).select(F.col("doc_id").alias(name)).distinct()
    gone = gone.join(vertices.join(moved, "id", "left_anti").select(F.col("id").alias(name)), name, "left_anti")
    gone = store.cut(gone)
    kept = join_few(docs.filter(F.col(id_col).isNotNull()), F.col(id_col).cast("long"), gone, name, gone.count(), "left_anti", MAX_BROADCAST)
    return kept.unionByName(docs.filter(F.col(id_col).isNull()))
