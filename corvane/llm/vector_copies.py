"""Embedding near-dedup: links between vectors of equal labels with a cosine of `LEAST` or more, by product quantisation.

1. Equal vectors of a label collapse to one vertex, named by its smallest id and counted; the counts add up before the shuffle.
2. Coarse centroids and codebooks of residuals are fitted on at most `SAMPLE` vertices, those of the smallest hashes. Every vertex
   is indexed: its unit vector goes to the list of its label's nearest centroid, with a code of `PARTS` bytes for what the centroid leaves,
   and with the length of what the code leaves. A label has as many lists as keep them near `LIST` vertices, at most `LISTS`.
3. A vertex asks its own list, and each list that is not farther than `MARGIN` allows: two vectors that link are at most `RADIUS` apart, and
   one changes sides of the plane between two centroids only if the difference of the squared distances is at most 2 * RADIUS * the
   centroids' distance. At a margin of 1 no link is lost at all. In many dimensions little of a difference points across one
   plane, so that the margin of 0.5 asks far fewer lists; tests measure the recall against brute force.
4. In a list, a table per asking vector gives its distance to every code. A pair is discarded if that distance less what the code leaves
   is over RADIUS, which no link's can be; survivors are compared by exact cosine in double precision.
5. A pair whose ends ask each other's lists counts in the lower one only. A list of over `CELL` vertices, or asked by over `ASKS`, is dealt into
   blocks, and each pair of blocks is a cell of its own. A cell returns a row per linked member: how many vectors it links there, copies included,
   and the smallest member that it reaches; never pairs. Sums give the links, contraction the components.

Vectors that are null, zero or hold null or non-finite components, and rows of null labels, link with nothing and are components of
their own. Vectors of different lengths don't link. Repeated rows are vectors each; rows of different vectors and one id
name one component where it is the smallest. Rows of null ids link and count, but name no component; ids must stay below 2^62. An empty table has no
rows. Labels of any type are only compared. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship_package
from .simhash import components, smallest_reached
from .support import Stored, finite, hinted, join_by_key, spread, table

LEAST = 0.93
#: How far apart unit vectors of such a cosine can be.
RADIUS = float(np.sqrt(2 - 2 * LEAST))
MARGIN = 0.5
SAMPLE = 16_384
CODE_SAMPLE = 8_192
PARTS = 16
ENTRIES = 256
FITS = 6
LIST = 1024
LISTS = 1024
CELL = 2048
ASKS = 8192
#: Asking vectors that are compared at once, and pairs.
AT_ONCE = 64
PAIRS = 32_768
#: More than rounding can change a distance by.
SLACK = 1e-6
#: Ids from here on stand for vectors whose rows have none.
NAMELESS = 1 << 62


def lloyd(x: np.ndarray, n: int) -> np.ndarray:
    """At most n centroids of x, which start at its first rows; those without members stay."""
    c = x[:n].copy()
    for _ in range(FITS):
        at = np.argmin(_squares(x, c), 1)
        counts = np.bincount(at, minlength=len(c))
        sums = np.stack([np.bincount(at, x[:, k], len(c)) for k in range(x.shape[1])], 1) if x.shape[1] else np.zeros_like(c)
        c[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return c


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.square(x).sum(1)[:, None] + np.square(c).sum(1)[None, :] - 2 * x @ c.T


@dataclass(frozen=True)
class Quantiser:
    """Centroids by number of lists, and for each the codebooks of the residuals' parts."""

    width: int
    margin: float
    coarse: dict[int, np.ndarray]
    books: dict[int, list[np.ndarray]]

    @property
    def cuts(self) -> np.ndarray:
        return np.linspace(0, self.width, PARTS + 1).astype(int)

    @staticmethod
    def fit(units: np.ndarray, numbers: list[int], margin: float = MARGIN) -> Quantiser:
        """Fitted on a bounded sample of unit vectors, for these numbers of lists."""
        coarse, books = {}, {}
        cuts = np.linspace(0, units.shape[1], PARTS + 1).astype(int)
        for n in numbers:
            coarse[n] = lloyd(units, n)
            own = units[:CODE_SAMPLE]
            rest = own - coarse[n][np.argmin(_squares(own, coarse[n]), 1)]
            books[n] = [lloyd(rest[:, a:b], ENTRIES) for a, b in zip(cuts, cuts[1:])]
        return Quantiser(units.shape[1], margin, coarse, books)

    def index(self, units: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(home list, codes, what codes leave, which lists to ask) of unit vectors among n lists."""
        c = self.coarse[n]
        d = _squares(units, c)
        home = d.argmin(1)
        apart = np.sqrt(np.maximum(_squares(c, c), 0))[home]
        asks = d - d[np.arange(len(d)), home][:, None] <= 2 * RADIUS * self.margin * apart
        rest = units - c[home]
        codes = np.stack([np.argmin(_squares(rest[:, a:b], k), 1) for (a, b), k in zip(zip(self.cuts, self.cuts[1:]), self.books[n])], 1)
        left = np.sqrt(np.square(units - self.decoded(home, codes, n)).sum(1))
        return home, codes.astype(np.uint8), left, asks

    def decoded(self, home: np.ndarray, codes: np.ndarray, n: int) -> np.ndarray:
        parts = [k[codes[:, p]] for p, k in enumerate(self.books[n])]
        return self.coarse[n][home] + np.concatenate(parts, 1)

    def tables(self, units: np.ndarray, n: int) -> list[np.ndarray]:
        """For each part, the products of asking vectors with all entries."""
        return [units[:, a:b] @ k.T for (a, b), k in zip(zip(self.cuts, self.cuts[1:]), self.books[n])]


def padded(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of one width, filled up with zeros, which changes no cosine."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(column.offsets.to_numpy())
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    starts = np.cumsum(sizes) - sizes
    for k, (a, s) in enumerate(zip(starts, sizes)):
        out[k, :s] = flat[a : a + s]
    return out


def unit(x: np.ndarray) -> np.ndarray:
    """Unit vectors; the largest component is taken out first, as squares of large or small ones leave the range."""
    x = x / np.abs(x).max(1, keepdims=True, initial=np.finfo(float).tiny)
    return x / np.sqrt(np.square(x).sum(1, keepdims=True))


def linked(quantiser: Quantiser, n: int, home: int, base: dict, asking: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, links of asking, links of base): pairs of asking i and base j that link and count in this list."""
    found_i, found_j = [], []
    decoded = quantiser.decoded(np.full(len(base["codes"]), home), base["codes"], n)
    lengths = np.square(decoded).sum(1)
    most = np.square(RADIUS + base["left"] + SLACK)
    for a in range(0, len(asking["x"]), AT_ONCE):
        u = asking["x"][a : a + AT_ONCE]
        product = np.repeat((u @ quantiser.coarse[n][home])[:, None], len(decoded), 1)
        for p, t in enumerate(quantiser.tables(u, n)):
            product += t[:, base["codes"][:, p]]
        i, j = np.nonzero(1 + lengths[None, :] - 2 * product <= most[None, :])
        i += a
        own = asking["home"][i] == home
        # In the own list each pair is met from both ends. Elsewhere the other end may ask this one's list, and the lower one counts.
        counts = own & ((asking["id"][i] < base["id"][j]) | ((asking["id"][i] == base["id"][j]) & (asking["h"][i] < base["h"][j])))
        other = np.flatnonzero(~own)
        higher = asking["home"][i[other]] > home
        counts[other[higher]] = True
        for k in other[~higher]:
            counts[k] = int(asking["home"][i[k]]) not in base["asks"][j[k]]
        counts &= asking["size"][i] == base["size"][j]
        i, j = i[counts], j[counts]
        for b in range(0, len(i), PAIRS):
            x, y = asking["x"][i[b : b + PAIRS]], base["x"][j[b : b + PAIRS]]
            near = np.einsum("ij,ij->i", x, y) >= LEAST
            found_i.append(i[b : b + PAIRS][near])
            found_j.append(j[b : b + PAIRS][near])
    i, j = (np.concatenate(f) if f else np.zeros(0, np.int64) for f in (found_i, found_j))
    return i, j, np.bincount(i, base["n"][j], len(asking["x"])).astype(np.int64), np.bincount(j, asking["n"][i], len(base["x"])).astype(np.int64)


#: Rows of the index: a vertex in its home list (base), or a vertex that asks a list.
INDEX = "label {label}, list int, lists int, base boolean, id long, h long, n long, home int, vector array<{of}>, code binary, left double, asks array<int>"


def indexed(vertices: DataFrame, quantiser: Quantiser) -> DataFrame:
    """Rows INDEX of vertices (label, lists, id, h, n, vector): one for the home list, and one for each list that it asks, home included."""
    label, of = vertices.schema["label"].dataType.simpleString(), vertices.schema["vector"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(at, 4096) for at in range(0, whole.num_rows, 4096)):
                lists = b.column("lists").to_numpy()
                for n in np.unique(lists):
                    rows = np.flatnonzero(lists == n)
                    own = b.take(pa.array(rows))
                    home, codes, left, asks = quantiser.index(unit(padded(own.column("vector"), quantiser.width)), int(n))
                    at, to = np.nonzero(asks)
                    take = pa.array(np.concatenate([np.arange(len(rows)), at]))
                    base = pa.array(np.arange(len(take)) < len(rows))
                    lower = [np.flatnonzero(a[:h]).astype(np.int32) for a, h in zip(asks, home)]
                    nothing = [None] * len(at)
                    columns = [
                        own.column("label").take(take), pa.array(np.concatenate([home, to]), pa.int32()), own.column("lists").take(take), base,
                        *(own.column(c).take(take) for c in ("id", "h", "n")), pa.array(home, pa.int32()).take(take), own.column("vector").take(take),
                        pa.array([c.tobytes() for c in codes] + nothing, pa.binary()), pa.array([*left, *nothing], pa.float64()), pa.array(lower + nothing, pa.list_(pa.int32())),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in INDEX.split(", ")])

    return vertices.select("label", "lists", "id", "h", "n", "vector").mapInArrow(run, INDEX.format(label=label, of=of))


FOUND = pa.schema([("id", pa.int64()), ("h", pa.int64()), ("links", pa.int64()), ("to", pa.int64())])


def cell_rows(quantiser: Quantiser, t: pa.Table) -> pa.Table | None:
    """Rows FOUND of a cell: each linked member's links there and the smallest id that it reaches."""
    t = t.combine_chunks()
    base = t["base"].to_numpy()

    def side(own: pa.Table) -> dict:
        column = own["vector"].combine_chunks()
        numbers = {c: own[c].to_numpy() for c in ("id", "h", "n", "home")}
        return numbers | {"x": unit(padded(column, quantiser.width)), "size": np.diff(column.offsets.to_numpy())}

    b, a = t.filter(pa.array(base)), t.filter(pa.array(~base))
    if b.num_rows == 0 or a.num_rows == 0:
        return None
    left, right = side(a), side(b)
    right |= {"codes": np.frombuffer(b"".join(b["code"].to_pylist()), np.uint8).reshape(-1, PARTS), "left": b["left"].to_numpy(), "asks": [set(x) for x in b["asks"].to_pylist()]}
    i, j, asked, met = linked(quantiser, t["lists"][0].as_py(), t["list"][0].as_py(), right, left)
    if len(i) == 0:
        return None
    ids = np.concatenate([left["id"], right["id"]])
    order = np.argsort(ids, kind="stable")
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    to = smallest_reached(len(ids), place[i], place[j + a.num_rows])
    links = np.concatenate([asked, met])
    some = np.flatnonzero(links)
    columns = [ids[some], np.concatenate([left["h"], right["h"]])[some], links[some], ids[order[to[place[some]]]]]
    return pa.Table.from_arrays([pa.array(c) for c in columns], schema=FOUND)


def cells(rows: DataFrame, store: Stored) -> DataFrame:
    """Rows of the index with the blocks `b` and `a` of base and asking vertices of their list; each side is there for every block of the other."""
    counts = rows.groupBy("label", "list").agg(F.ceil(F.count_if("base") / CELL).cast("int").alias("bs"), F.ceil(F.count_if(~F.col("base")) / ASKS).cast("int").alias("as_"))
    # A list is here for every so many of its rows only, so this is a small share of the index.
    large = store.cut(counts.filter("bs > 1 OR as_ > 1").withColumnsRenamed({"label": "l", "list": "k"}))
    held = rows.join(hinted(large, large.count()), (F.col("label") == F.col("l")) & (F.col("list") == F.col("k")), "left").drop("l", "k")
    held = held.withColumns({"bs": F.coalesce("bs", F.lit(1)), "as_": F.coalesce("as_", F.lit(1))})
    own = F.pmod(F.xxhash64("h"), F.when(F.col("base"), F.col("bs")).otherwise(F.col("as_"))).cast("int")
    held = held.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("base"), F.col("as_")).otherwise(F.col("bs")) - 1)))
    return held.withColumns({"b": F.when(F.col("base"), F.col("own")).otherwise(F.col("other")), "a": F.when(F.col("base"), F.col("other")).otherwise(F.col("own"))}).drop("bs", "as_", "own", "other")


def vertex_links(vertices: DataFrame, n: int, margin: float, store: Stored) -> tuple[DataFrame, DataFrame] | None:
    """((id, h, links), (id, root)) of stored vertices (label, id, h, n, vector) that link with others; None if there are no vertices."""
    if n == 0:
        return None
    sizes = store.cut(vertices.groupBy("label").agg(F.count(F.lit(1)).alias("c"), F.max(F.size("vector")).alias("w")))
    width = sizes.agg(F.max("w")).first()[0]
    # Numbers of lists are powers of four, so that few quantisers serve labels of all sizes.
    lists = F.least(F.lit(LISTS), F.pow(F.lit(4), F.greatest(F.lit(0), F.ceil(F.log(F.col("c") / LIST) / F.log(F.lit(4.0)))))).cast("int")
    large = store.cut(sizes.select(F.col("label").alias("l"), lists.alias("lists")).filter("lists > 1"))
    numbers = [1] + sorted(r[0] for r in large.select("lists").distinct().collect())  # five at most
    sample = vertices.orderBy(F.xxhash64("h"), "h").limit(SAMPLE).select("vector").toArrow()["vector"].combine_chunks()
    quantiser = Quantiser.fit(unit(padded(sample, width)), numbers, margin)
    known = vertices.join(hinted(large, large.count()), F.col("label") == F.col("l"), "left").withColumn("lists", F.coalesce("lists", F.lit(1)))
    rows = cells(store.cut(indexed(known, quantiser)), store)
    keys = ["label", "list", "b", "a"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None

        def done() -> Iterator[pa.RecordBatch]:
            if held and (found := cell_rows(quantiser, pa.Table.from_batches(held))) is not None:
                yield from found.to_batches()
            held.clear()

        for batch in batches:
            if batch.num_rows == 0:
                continue
            rows_ = list(zip(*(batch.column(k).to_pylist() for k in keys)))
            starts = [0] + [k for k in range(1, len(rows_)) if rows_[k] != rows_[k - 1]]
            for a, b in zip(starts, [*starts[1:], len(rows_)]):
                if rows_[a] != now:
                    yield from done()
                    now = rows_[a]
                held.append(batch.slice(a, b - a))
        yield from done()

    parts = int(vertices.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = store.cut(rows.repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(run, "id long, h long, links long, to long"))
    links = found.groupBy("id", "h").agg(F.sum("links").alias("links"))
    return links, components(found.filter("id > to").select(F.col("id").alias("a"), F.col("to").alias("b")).distinct(), store)


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", margin: float = MARGIN) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    spark = vectors.sparkSession
    ship_package(spark)
    store = Stored(spark, "vector_copies")
    v = F.col(vector_col)
    usable = finite(v) & F.exists(v, lambda x: x != 0) & F.col(label_col).isNotNull()
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), v.alias("vector"), F.coalesce(usable, F.lit(False)).alias("usable"))
    alone = own.filter(~F.col("usable")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    # Two hashes of 64 bits stand for a label's vector; no more than these are shuffled with a row.
    hashes = [F.xxhash64(F.lit(k), F.col("label").cast("string"), "vector").alias(h) for k, h in enumerate(("h", "g"))]
    rows = own.filter("usable").select("vec_id", "label", "vector", *hashes)
    groups = rows.groupBy("h", "g").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("label").alias("label"), F.first("vector").alias("vector"))
    nameless = F.col("h").bitwiseAND(F.lit(NAMELESS - 1)).bitwiseOR(F.lit(NAMELESS))
    vertices = store.cut(groups.withColumn("id", F.coalesce("id", nameless)))
    n, total = vertices.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    found = vertex_links(vertices, n, margin, store)
    if found is None:
        return alone.withColumn("kept", F.col("vec_id") == F.col("component_id"))
    links, roots = found
    named = vertices.select("id", "h", "g", "n").join(links, ["id", "h"], "left").join(roots, "id", "left")
    named = store.cut(named.select("h", "g", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "id").alias("component_id")))
    out = join_by_key(store.cut(rows.select("vec_id", "h", "g")), named, ["h", "g"], "n", total)
    out = out.select("vec_id", "n_links", F.when(F.col("component_id") < NAMELESS, F.col("component_id")).alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spread(table(spark, sf_dir, "embeddings")))


SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0 AND len([x for x in embedding if x <> 0]) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a JOIN v AS b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= {LEAST}),
r AS (SELECT vec_id, vec_id AS t FROM embeddings UNION SELECT r.vec_id, p.b FROM r JOIN p ON r.t = p.a),
c AS (SELECT vec_id, min(t) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT c.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, c.vec_id = c.component_id AS kept FROM c LEFT JOIN n ON c.vec_id = n.a
"""
