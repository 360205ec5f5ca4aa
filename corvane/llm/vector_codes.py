"""Vector code compression: vectors as one small integer per part, by Lloyd's rounds with Hamerly's bounds.

A component x becomes the integer floor(256 * x). A vector is cut into `PARTS` equal consecutive parts, and each part
position has a codebook, which starts as that part of the vectors of the `ENTRIES` smallest ids. A round assigns every
part to the nearest entry and moves each entry to the floor of its parts' mean; after `ROUNDS` rounds, parts are assigned again.

1. The first assignment scans all entries in whole numbers. It persists with each part its code, an upper bound of the
   distance to its own entry and one lower bound of the distance to every other, the second nearest.
2. After entries moved, the upper bound grows by how far the own entry moved and the lower bound falls by the farthest move of any
   other. Where the upper bound is below the lower one, or below half the distance from the own entry to the nearest other one,
   the code stays. Else the upper bound is made exact, and where that doesn't help, the part is scanned again. Bounds are
   widened by more than rounding can do and compared strictly, so a tie is always scanned, and goes to the lower index.
3. Sums of an entry's parts are added up in the task, then by entry. Only codebooks, whose size is fixed, are with the driver.

Rows of null vectors and of vectors with null or non-finite components are dropped. Ids order as numbers, null ids last, equal
ids by their integers; repeated rows count each. Fewer vectors than entries make smaller codebooks, an empty table has no rows.
Empty vectors have empty parts. Vectors must be of one length that `PARTS` divides, with integers below 2^28, else an error says so.
Labels of any type are only compared, nulls together. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship_package
from .support import Stored, finite, join_by_key, spread, table

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Magnitude that integers must stay below, so that squared distances fit 64 bits.
LIMIT = 1 << 28
#: More than rounding can change a bound by, as a share of it.
SLACK = 1e-9

STATE = "vec_id long, label {label}, w array<long>, code binary, upper array<double>, lower array<double>"


def integers(batch: pa.Array) -> np.ndarray:
    """The components of a batch of vectors of one length, a row each."""
    flat = batch.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(batch), -1)


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of parts to all entries of a codebook, in whole numbers."""
    out = np.zeros((len(x), len(book)), np.int64)
    for k in range(x.shape[1]):
        out += np.square(x[:, k, None] - book[None, :, k])
    return out


def scan(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, upper, lower) of parts by all entries: the nearest one, the lower of equals, its distance and the second nearest's."""
    d = distances(x, book)
    code = d.argmin(1)
    rows = np.arange(len(x))
    nearest = d[rows, code]
    d[rows, code] = np.iinfo(np.int64).max
    second = np.sqrt(d.min(1).astype(np.float64)) if len(book) > 1 else np.full(len(x), np.inf)
    return code, np.sqrt(nearest.astype(np.float64)), second


def rescan(x: np.ndarray, old: np.ndarray, book: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(code, upper, lower, scanned): bounds carried from an old codebook to a new one; parts whose bounds fail are scanned."""
    moved = np.sqrt(np.square(book - old).sum(1).astype(np.float64))
    most = int(moved.argmax()) if len(book) else 0
    other = np.full(len(book), moved[most] if len(book) else 0.0)
    other[most] = np.delete(moved, most).max(initial=0.0)
    upper = (upper + moved[code]) * (1 + SLACK)
    lower = (lower - other[code]) * (1 - SLACK)
    between = distances(book, book)
    np.fill_diagonal(between, np.iinfo(np.int64).max)
    half = np.sqrt(between.min(1).astype(np.float64)) / 2 * (1 - SLACK) if len(book) > 1 else np.full(len(book), np.inf)
    bound = np.maximum(lower, half[code])
    open_ = np.flatnonzero(~(upper < bound))
    upper[open_] = np.sqrt(np.square(x[open_] - book[code[open_]]).sum(1).astype(np.float64)) * (1 + SLACK)
    open_ = open_[~(upper[open_] < bound[open_])]
    code = code.copy()
    code[open_], upper[open_], lower[open_] = scan(x[open_], book)
    return code, upper, lower, len(open_)


def _parts(w: np.ndarray) -> np.ndarray:
    """(rows, parts, width) of whole vectors."""
    return w.reshape(len(w), PARTS, w.shape[1] // PARTS)


def _doubles(x: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))


def _bytes(codes: np.ndarray) -> pa.Array:
    return pa.array([c.tobytes() for c in codes.astype(np.uint8)], pa.binary())


def _codes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), PARTS).astype(np.int64)


def assigned(rows: DataFrame, books: np.ndarray, old: np.ndarray | None = None) -> DataFrame:
    """Rows with codes and bounds by these codebooks. Given the old ones, rows have bounds already, and those are carried on."""
    label = rows.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                x = _parts(integers(b.column(2)))
                if old is None:
                    found = [scan(x[:, p], books[p]) for p in range(PARTS)]
                else:
                    had = _codes(b.column(3)), integers(b.column(4)), integers(b.column(5))
                    found = [rescan(x[:, p], old[p], books[p], *(h[:, p] for h in had)) for p in range(PARTS)]
                code, upper, lower = (np.stack([f[k] for f in found], 1) for k in range(3))
                yield pa.RecordBatch.from_arrays([*b.columns[:3], _bytes(code), _doubles(upper), _doubles(lower)], names=["vec_id", "label", "w", "code", "upper", "lower"])

    return rows.mapInArrow(run, STATE.format(label=label))


def moved_books(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks with each entry at the floor of its parts' mean; entries without parts stay."""
    n, width = books.shape[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((PARTS * n, width), np.int64), np.zeros(PARTS * n, np.int64)
        first = np.arange(PARTS) * n
        for b in batches:
            if b.num_rows:
                at = (_codes(b.column(1)) + first).ravel()
                np.add.at(sums, at, _parts(integers(b.column(0))).reshape(len(at), width))
                counts += np.bincount(at, minlength=PARTS * n)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used]), pa.array(list(sums[used]), pa.list_(pa.int64()))], names=["at", "n", "sums"])

    part = state.select("w", "code").mapInArrow(run, "at long, n long, sums array<long>")
    every = part.groupBy("at").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(width)])
    out = books.reshape(PARTS * n, width).copy()
    for r in every.collect():  # no more rows than entries
        out[r["at"]] = [r[f"s{k}"] // r["n"] for k in range(width)]
    return out.reshape(books.shape)


def kept(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, w) of the vectors that take part."""
    own = vectors.filter(finite(F.col(vector_col)))
    w = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    return own.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), w.alias("w"))


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """((vec_id, label, code, error) with codes of a byte a part, the final codebooks by part, entry and component)."""
    spark = vectors.sparkSession
    ship_package(spark)
    rows = kept(vectors, id_col, vector_col, label_col)
    size = F.size("w")
    wide = F.max(F.greatest(*[F.aggregate("w", F.lit(0).cast("long"), f) for f in (lambda a, x: F.greatest(a, x), lambda a, x: F.greatest(a, -x))]))
    n, least, most, large = rows.agg(F.count(F.lit(1)), F.min(size), F.max(size), wide).first()
    if n and (least != most or least % PARTS):
        raise ValueError(f"vectors must be of one length that {PARTS} divides; there are lengths from {least} to {most}")
    if n and large >= LIMIT:
        raise ValueError(f"components times {SCALE} must stay below {LIMIT} in magnitude")
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "w").limit(ENTRIES).select("w").collect()
    start = np.array([r[0] for r in first], np.int64).reshape(len(first), -1 if n and most else 0)
    books = np.ascontiguousarray(_parts(start).transpose(1, 0, 2)) if n else np.zeros((PARTS, 0, 0), np.int64)
    store = Stored(spark, "vector_codes")
    state, old = rows, None
    for _ in range(ROUNDS):
        # The bounds of a round are kept with the parts and read by the next one.
        last = store.last if old is not None else None
        state = store.cut(assigned(state, books, old))
        if last:
            store.drop(last)
        old, books = books, moved_books(state, books)
    final = assigned(state, books, old)

    def errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = np.arange(PARTS)
        for b in batches:
            if b.num_rows:
                d = np.square(_parts(integers(b.column(2))) - books[parts[None, :], _codes(b.column(3))]).sum((1, 2))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(d)], names=["vec_id", "label", "code", "error"])

    label = rows.schema["label"].dataType.simpleString()
    return store.cut(final.mapInArrow(errors, f"vec_id long, label {label}, code binary, error long")), books


def codebooks_text(books: np.ndarray) -> str:
    return ",".join(map(str, books.ravel().tolist()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(spread(table(spark, sf_dir, "embeddings")))
    by = Stored(spark, "vector_codes").cut(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")))
    total = by.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    digest = hashlib.sha256(codebooks_text(books).encode()).hexdigest()
    found = join_by_key(coded, by, ["label"], "n", total)
    return found.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql() -> str:
    """The same by plain scans, for vectors of 64 components."""
    width = 64 // PARTS
    d = " + ".join(f"(p.v[{k}] - c.v[{k}]) * (p.v[{k}] - c.v[{k}])" for k in range(1, width + 1))
    mean = ", ".join(f"((sum(p.v[{k}]) - ((sum(p.v[{k}]) % count(*) + count(*)) % count(*))) // count(*))::BIGINT" for k in range(1, width + 1))
    steps = [
        f"""k AS (SELECT vec_id, label, [floor({SCALE} * x::DOUBLE)::BIGINT for x in embedding] AS w, row_number() OVER (ORDER BY vec_id) AS rn FROM embeddings
           WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0)""",
        f"p AS (SELECT rn, g.part, w[(g.part * {width} + 1):(g.part * {width} + {width})] AS v FROM k, (SELECT range AS part FROM range({PARTS})) AS g)",
        f"c0 AS (SELECT part, rn - 1 AS e, v FROM p WHERE rn <= {ENTRIES})",
    ]
    for r in range(ROUNDS + 1):
        steps.append(f"a{r} AS (SELECT p.rn, p.part, min(({d}) * {ENTRIES} + c.e) AS m FROM p JOIN c{r} AS c ON p.part = c.part GROUP BY p.rn, p.part)")
        if r < ROUNDS:
            steps.append(f"u{r} AS (SELECT p.part, a.m % {ENTRIES} AS e, [{mean}] AS v FROM p JOIN a{r} AS a ON p.rn = a.rn AND p.part = a.part GROUP BY p.part, a.m % {ENTRIES})")
            steps.append(f"c{r + 1} AS (SELECT c.part, c.e, coalesce(u.v, c.v) AS v FROM c{r} AS c LEFT JOIN u{r} AS u ON c.part = u.part AND c.e = u.e)")
    steps += [
        f"o AS (SELECT rn, string_agg(printf('%02x', (m % {ENTRIES})::INTEGER), '' ORDER BY part) AS code, sum(m // {ENTRIES})::BIGINT AS error FROM a{ROUNDS} GROUP BY rn)",
        f"b AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM c{ROUNDS})",
    ]
    joined = ",\n".join(steps)
    return f"WITH {joined}\nSELECT k.vec_id, o.code, o.error, (sum(o.error) OVER (PARTITION BY k.label))::BIGINT AS label_error, b.codebooks_sha256 FROM k JOIN o ON k.rn = o.rn CROSS JOIN b"


SQL = _sql()
