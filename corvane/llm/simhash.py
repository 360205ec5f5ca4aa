"""SimHash near-dedup: exact links between fingerprints, by pivot distance tables, and their components.

A fingerprint has 64 bits, each set if it is set in over half the XXH64 hashes of a document's shingles.
Two fingerprints link if at most `MAX_BITS` bits differ. A component is what links reach.

1. Equal fingerprints collapse to one vertex, named by its smallest doc_id; counting adds up before the shuffle. Each
   vertex's distances to `PIVOTS` reference fingerprints are computed once, and go with it as 16 bytes: the distance table.
2. Fingerprints are cut into blocks. With r blocks, two that link agree on r - MAX_BITS of them at least, so
   each choice of so many blocks is a key under which both meet. r grows with the number of fingerprints, so
   that unrelated ones seldom meet. No pair that links is lost for any r. Members of one key make up a cell.
3. A key that more than `CELL` fingerprints share is split along the first pivot: in the order of their distance to it, members
   stand in chunks, and only chunks that hold distances within MAX_BITS of each other meet in a cell. No task holds more
   than two chunks of a key.
4. In a cell, pairs whose distances to any pivot differ by more than MAX_BITS are discarded, as they can't link; the
   rest are compared bit by bit. A cell returns one row per linked member, to the smallest member that its links reach
   there; never all pairs.
5. The components of these rows come from repeated contraction to the smallest neighbour. Each round's
   tables are written to the shared folder.

Null texts and texts without words have fingerprint zero and link with each other. A document with fewer
words than a shingle is one shingle. Texts of any length are read whole. Repeated rows share a fingerprint. Null doc_ids get
a fingerprint, but name no component if another row can. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shipping import ship_package
from .support import Stored, documents, free_name, groups, join_few

SHINGLE = 4
SEED = 42
MAX_BITS = 4
PIVOTS = 16
CELL = 1024
#: Members up to which cells are compared many at a time.
SMALL = 48
#: Unrelated fingerprints that one may meet under all its keys, on average, before more blocks are used.
MEETINGS = 2048


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()  # on bytes, both regard ASCII alone
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) < shingle:
        hashes = [digest(joined, SEED)]
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths)[: len(words) - shingle + 1].tolist()
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist())]
    return majority(np.array(hashes, "<u8"))


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of hashes: the bits that over half of them have."""
    octets = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    set_in = np.zeros(64, np.int64)
    for k in range(8):
        set_in[8 * k : 8 * k + 8] = np.bincount(octets[:, k], minlength=256) @ _BITS
    return int(np.packbits(2 * set_in > len(hashes), bitorder="little").view("<u8")[0])


#: The bits of each octet, lowest first.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long."""
    ship_package(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in groups(whole):
                fps = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(fps.view(np.int64))], schema=schema)

    return docs.select(id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: rows of the Walsh matrix of order 64, whose distances tell most about each other's rest."""
    i = np.arange(64)
    rows = [sum(1 << int(j) for j in i if bin(j & k).count("1") & 1) for k in range(1, n + 1)]
    return np.array(rows, np.uint64)


def distance_table(fps: np.ndarray) -> np.ndarray:
    """Distances of fingerprints to the pivots, a row of bytes for each."""
    return np.bitwise_count(fps[:, None] ^ _PIVOTS[None, :]).astype(np.int8)


_PIVOTS = pivots()


def _survivors(i: np.ndarray, j: np.ndarray, fps: np.ndarray, tables: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs, those that no pivot discards and that link."""
    for p in range(tables.shape[1]):
        if len(i) == 0:
            return i, j
        near = np.abs(tables[i, p] - tables[j, p]) <= max_bits
        i, j = i[near], j[near]
    true = np.bitwise_count(fps[i] ^ fps[j]) <= max_bits
    return i[true], j[true]


def cell_links(fps: np.ndarray, side: np.ndarray | None, max_bits: int = MAX_BITS, tables: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs i < j of fingerprints that link. With sides, only those between side 0 and side 1."""
    n = len(fps)
    tables = distance_table(fps) if tables is None else tables
    order = np.argsort(tables[:, 0], kind="stable")
    tables, sorted_fps = tables[order], fps[order]
    sides = None if side is None else side[order]
    first = tables[:, 0]
    found_i, found_j = [], []
    step = max(1, (1 << 20) // n)
    for a in range(0, n, step):
        b = min(n, a + step)
        # In the order of the first pivot's distance, only a window can be near enough.
        last = int(np.searchsorted(first, first[b - 1] + max_bits, "right"))
        i, j = np.nonzero(first[None, a:last] - first[a:b, None] <= max_bits)
        i, j = i + a, j + a
        near = j > i
        if sides is not None:
            near &= sides[i] != sides[j]
        i, j = _survivors(i[near], j[near], sorted_fps, tables, max_bits)
        found_i.append(order[i])
        found_j.append(order[j])
    i, j = np.concatenate(found_i), np.concatenate(found_j)
    return np.minimum(i, j), np.maximum(i, j)


def _linked(cells: np.ndarray, side: np.ndarray, ids: np.ndarray, fps: np.ndarray, tables: np.ndarray) -> list[np.ndarray]:
    """(a, b) for whole cells: each linked member with the smallest one that its links reach in its cell."""
    order = np.lexsort((ids, cells))  # so that the smallest index of a cell has its smallest id
    cells, side, ids, fps, tables = cells[order], side[order], ids[order], fps[order], tables[order]
    starts = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
    sizes = np.diff(np.append(starts, len(cells)))
    left = np.repeat(starts + sizes, sizes) - np.arange(len(cells))  # members of the cell from this one on
    left[np.repeat(sizes > SMALL, sizes)] = 0
    found = []
    for k in range(1, int(left.max(initial=0))):
        i = np.flatnonzero(left > k)
        i = i[(side[i] < 0) | (side[i] != side[i + k])]
        found.append(_survivors(i, i + k, fps, tables, MAX_BITS))
    for a, n in zip(starts[sizes > SMALL], sizes[sizes > SMALL]):
        own = slice(a, a + n)
        i, j = cell_links(fps[own], None if side[a] < 0 else side[own], MAX_BITS, tables[own])
        found.append((i + a, j + a))
    if not found:
        return [ids[:0], ids[:0]]
    to = smallest_reached(len(ids), *(np.concatenate(x) for x in zip(*found)))
    moved = np.flatnonzero(to != np.arange(len(ids)))
    return [ids[moved], ids[to[moved]]]


def smallest_reached(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For members 0 to n-1 with links i, j: the smallest member that each one reaches."""
    at = np.arange(n)
    while True:
        low = np.minimum(at[i], at[j])
        new = at.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, at[i], low)
        np.minimum.at(new, at[j], low)
        new = new[new]
        if np.array_equal(new, at):
            return at
        at = new


def block_bounds(r: int) -> list[tuple[int, int]]:
    cuts = [64 * k // r for k in range(r + 1)]
    return list(zip(cuts, cuts[1:]))


def blocks_for(n: int, max_bits: int = MAX_BITS) -> int:
    """The fewest blocks for which a fingerprint meets no more than MEETINGS unrelated ones among n, on average."""
    for r in range(max_bits + 1, 13):
        choices = len(list(combinations(range(r), r - max_bits)))
        if choices * n / 2.0 ** (64 * (r - max_bits) / r) <= MEETINGS:
            return r
    return 12


def with_table(vertices: DataFrame) -> DataFrame:
    """(id, fp, d0, d1) of vertices (id, fp): the distances to the pivots as bytes of two longs, the first pivot's lowest."""
    ship_package(vertices.sparkSession)
    schema = pa.schema([(c, pa.int64()) for c in ("id", "fp", "d0", "d1")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = distance_table(batch.column(1).to_numpy().view(np.uint64)).view("<i8")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(packed[:, 0]), pa.array(packed[:, 1])], schema=schema)

    return vertices.select("id", "fp").mapInArrow(run, "id long, fp long, d0 long, d1 long")


def _keyed(vertices: DataFrame, r: int) -> DataFrame:
    """One row per fingerprint and choice of blocks: (t, key, first, id, fp, d0, d1); first is the first pivot's distance."""
    bounds = block_bounds(r)
    masks = []
    for choice in combinations(range(r), r - MAX_BITS):
        m = sum(((1 << (bounds[k][1] - bounds[k][0])) - 1) << bounds[k][0] for k in choice)
        masks.append(m - (1 << 64) if m >> 63 else m)
    keys = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key")) for t, m in enumerate(masks)])
    own = vertices.withColumn("first", F.col("d0").bitwiseAND(F.lit(127)).cast("int"))
    return own.select("id", "fp", "d0", "d1", "first", F.explode(keys).alias("k")).select("k.t", "k.key", "first", "id", "fp", "d0", "d1")


def _chunks(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """(t, key, first, low, high, least, most): of the hot keys' chunks in order of the first pivot's distance, those that
    a distance's members stand in, low to high, and those that they must meet, least to most."""
    by = Window.partitionBy("t", "key").orderBy("first")  # no more rows than there are distances
    n = rows.join(hot, ["t", "key"], "left_semi").groupBy("t", "key", "first").agg(F.count(F.lit(1)).alias("n"))
    until = F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, 0))
    places = n.withColumn("until", until).select("t", "key", "first", F.floor((F.col("until") - F.col("n")) / CELL).cast("int").alias("low"), F.floor((F.col("until") - 1) / CELL).cast("int").alias("high"))
    near = by.rangeBetween(-MAX_BITS, MAX_BITS)
    return places.withColumns({"least": F.min("low").over(near), "most": F.max("high").over(near)})


LINK_SCHEMA = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def links(vertices: DataFrame, n: int, store: Stored) -> DataFrame:
    """(a, b) with a > b: rows whose components are those of all links between the vertices of `with_table`."""
    ship_package(vertices.sparkSession)
    rows = _keyed(vertices, blocks_for(n))
    hot = store.cut(rows.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CELL).select("t", "key"))
    one = F.lit(-1)
    if hot.isEmpty():
        cells = rows.select(F.xxhash64("t", "key", one, one).alias("cell"), one.cast("byte").alias("side"), "id", "fp", "d0", "d1")
    else:
        rows = rows.join(_chunks(rows, hot), ["t", "key", "first"], "left")
        own = F.col("low") + F.pmod(F.xxhash64("fp"), F.col("high") - F.col("low") + 1).cast("int")
        rows = rows.withColumn("own", F.coalesce(own, one)).withColumn("other", F.explode(F.sequence(F.coalesce("least", one), F.coalesce("most", one))))
        side = F.when(F.col("own") == F.col("other"), one).otherwise((F.col("own") > F.col("other")).cast("int")).cast("byte")
        cells = rows.select(F.xxhash64("t", "key", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), side.alias("side"), "id", "fp", "d0", "d1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, t) for t in (np.int64, np.int8, np.int64, np.int64, np.int64, np.int64)]

        def linked(cols: list[np.ndarray]) -> pa.RecordBatch:
            tables = np.stack(cols[4:], 1).view(np.int8)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in _linked(*cols[:3], cols[3].view(np.uint64), tables)], schema=LINK_SCHEMA)

        for batch in batches:
            if batch.num_rows == 0:
                continue
            cols = [np.concatenate([h, batch.column(k).to_numpy(zero_copy_only=False)]) for k, h in enumerate(held)]
            whole = int(np.searchsorted(cols[0], cols[0][-1]))  # the last cell may go on
            if whole:
                yield linked([c[:whole] for c in cols])
            held = [c[whole:] for c in cols]
        if len(held[0]):
            yield linked(held)

    parts = int(vertices.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cells.repartition(parts, "cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame, store: Stored) -> DataFrame:
    """(id, root): for each end of an edge (a, b), the smallest id that its edges reach."""
    edges = store.cut(edges)
    live = [store.last]
    labels: DataFrame | None = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = store.cut(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("to")).withColumnRenamed("a", "id"))
        least_at = store.last
        # Two jumps along the smallest neighbours; each keeps what an edge joins joined.
        for _ in range(2):
            jump = least.select(F.col("id").alias("to"), F.col("to").alias("then"))
            least = least.join(jump, "to", "left").select("id", F.coalesce("then", "to").alias("to"))
        least = store.cut(least)
        live += [least_at, store.last]
        if labels is None:
            labels = least.withColumnRenamed("to", "root")
        else:
            labels = store.cut(labels.join(least.withColumnRenamed("id", "root"), "root", "left").select("id", F.coalesce("to", "root").alias("root")))
        kept = store.last
        ends = [least.select(F.col("id").alias(c), F.col("to").alias(f"{c}_to")) for c in "ab"]
        moved = edges.join(ends[0], "a").join(ends[1], "b").filter("a_to != b_to")
        edges = store.cut(moved.select(F.greatest("a_to", "b_to").alias("a"), F.least("a_to", "b_to").alias("b")).distinct())
        for path in live:
            if path != kept:
                store.drop(path)
        live = [store.last] + ([kept] if kept in live else [])
        if edges.isEmpty():
            return labels


def neardup_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs."""
    spark = docs.sparkSession
    store = Stored(spark, "simhash")
    fps = store.cut(fingerprints(docs, id_col, text_col))
    # A fingerprint of null doc_ids only can't be named by one of them; it links nothing by name.
    vertices = store.cut(with_table(fps.groupBy("fp").agg(F.min("doc_id").alias("id")).filter("id IS NOT NULL")))
    labels = components(links(vertices, vertices.count(), store), store)
    named = vertices.join(labels, "id", "left").select("fp", F.coalesce("root", "id").alias("component_id"))
    return fps.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose id is the smallest of their component; of repeated rows all or none stay. Null ids stay."""
    store = Stored(docs.sparkSession, "simhash")
    found = store.cut(neardup_components(docs, id_col, text_col).filter("doc_id IS NOT NULL"))
    name = free_name(docs, "gone")
    leaders = found.filter("doc_id = component_id").select("doc_id")
    gone = store.cut(found.filter("doc_id <> component_id").select("doc_id").distinct().join(leaders, "doc_id", "left_anti").withColumnRenamed("doc_id", name))
    kept = join_few(docs.filter(F.col(id_col).isNotNull()), F.col(id_col).cast("long"), gone, name, gone.count(), "left_anti")
    return kept.unionByName(docs.filter(F.col(id_col).isNull()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup_components(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
