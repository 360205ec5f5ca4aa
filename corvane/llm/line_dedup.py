"""Line dedup: hash normalised lines, count documents per hash, drop frequent lines, join what is left by position.

A line's key is the line without blanks at both ends and with A-Z in lower case. A key of at least
`MIN_CHARS` code points that at least `MIN_DOCUMENTS` different doc_ids hold loses all its lines in every row.
A document is its id: rows that repeat an id count once, and rows of a null id count for none, but both lose
the lines. Each row comes back once. Null or empty text is one empty line, whose key is too short to be dropped.
A document whose lines all go keeps its row, with empty text. Texts of any length are read whole; Python holds
a few MB of them at a time. An empty table gives an empty one. Other columns pass through, whatever their names.

1. Rows become the different keys of their lines, by a 128-bit hash. Keys of at least so many rows are
   candidates; counting adds up before the shuffle, so a line in a third of all documents costs each task one row.
2. Of the candidates alone, different ids are counted; ids are dealt by key and id, so no key meets in one task.
3. The lines of frequent keys go. Such keys are few, as each stands for many documents: up to `MAX_BROADCAST`
   they go to every task, lines are looked up where the text is read, and no text moves. Beyond that, the places of
   the lines come from a join with salted keys, and each text moves once to meet its own places.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship_package
from .support import BLANKS, Stored, free_name, groups, spread, table

MIN_DOCUMENTS = 10
MIN_CHARS = 1
#: Keys up to which they go to every task, at 16 bytes each; beyond that they are joined by salted keys.
MAX_BROADCAST = 200_000
SALTS = 32
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_hashes(lines: pa.Array) -> list[bytes | None]:
    """16 bytes for the key of each line; None for keys that are too short to count."""
    import xxhash

    keys = pc.ascii_lower(pc.utf8_trim(lines, characters=BLANKS))
    long = pc.greater_equal(pc.utf8_length(keys), MIN_CHARS).to_pylist()
    digest = xxhash.xxh3_128_digest
    return [digest(k) if ok else None for k, ok in zip(keys.cast(pa.large_binary()).to_pylist(), long)]


def split_lines(texts: pa.Array) -> tuple[pa.Array, np.ndarray, pa.Array, list[bytes | None]]:
    """The texts' lines end to end, where each text's begin, each line's place among the different ones, and their hashes."""
    cut = pc.split_pattern(texts.cast(pa.large_string()).fill_null(""), "\n")
    lines = cut.flatten()
    each = lines.dictionary_encode()
    return lines, cut.offsets.to_numpy(), each.indices.to_numpy(), line_hashes(each.dictionary)


def _pairs(hashes: list[bytes]) -> tuple[pa.Array, pa.Array]:
    halves = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
    return pa.array(halves[:, 0]), pa.array(halves[:, 1])


def _keys(docs: DataFrame, id_col: str, text_col: str, only: Callable[[], set[bytes]] | None = None) -> DataFrame:
    """(id, check, a, b, places): the different keys of each row, in two halves, and the lines that have them; of `only` those."""
    schema = pa.schema([("id", pa.int64()), ("check", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("places", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = only() if only else None
        for whole in batches:
            for batch in groups(whole):
                _, bounds, codes, hashes = split_lines(batch.column(1))
                takes = np.array([h is not None and (wanted is None or h in wanted) for h in hashes], bool)
                rows = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
                at = np.flatnonzero(takes[codes])
                if len(at) == 0:
                    continue
                # Lines of one row and one code stand together, in their order.
                at = at[np.lexsort((at, codes[at], rows[at]))]
                first = np.flatnonzero(np.concatenate([[True], (np.diff(rows[at]) != 0) | (np.diff(codes[at]) != 0)]))
                own, places = rows[at[first]], (at - bounds[rows[at]]).astype(np.int32)
                # Different lines may share a key within a row; counting ids doesn't mind, and places add up.
                a, b = _pairs([hashes[k] for k in codes[at[first]]])
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(at)).astype(np.int32)), pa.array(places))
                own = pa.array(own)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(own).cast(pa.int64()), batch.column(2).take(own), a, b, lists], schema=schema)

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col), F.xxhash64(text_col))
    return rows.mapInArrow(run, "id long, check long, a long, b long, places array<int>")


def frequent_keys(docs: DataFrame, store: Stored, id_col: str = "doc_id", text_col: str = "text", min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """(a, b): the keys that so many different ids hold, as a stored table."""
    named = docs.filter(F.col(id_col).isNotNull())
    rows = _keys(named, id_col, text_col).select("a", "b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    candidates = store.cut(rows.filter(F.col("n") >= min_documents).select("a", "b"))
    found = _occurrences(named, candidates, id_col, text_col).groupBy("a", "b").agg(F.count_distinct("id").alias("n"))
    return store.cut(found.filter(F.col("n") >= min_documents).select("a", "b"))


def _few(keys: DataFrame) -> Callable[[], set[bytes]] | None:
    """The keys as a function that a task calls for their set, if they are no more than `MAX_BROADCAST`."""
    if keys.count() > MAX_BROADCAST:
        return None
    t = keys.toArrow()  # bounded as above
    shared = keys.sparkSession.sparkContext.broadcast(np.stack([t["a"].to_numpy(), t["b"].to_numpy()], 1).astype("<i8").tobytes())
    return lambda: {shared.value[k : k + 16] for k in range(0, len(shared.value), 16)}


def _occurrences(docs: DataFrame, keys: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of `_keys` for these keys only."""
    if few := _few(keys):
        return _keys(docs, id_col, text_col, few)
    salted = keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = _keys(docs, id_col, text_col).withColumn("salt", F.pmod(F.xxhash64("id", "check"), F.lit(SALTS)).cast("int"))
    return rows.join(salted, ["a", "b", "salt"], "left_semi")


def drop_frequent_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """All rows and columns of docs, with text_col as the kept lines; adds a struct (n_lines, n_dropped), see `dropped_column`."""
    from pyspark.sql.functions import arrow_udf

    ship_package(docs.sparkSession)
    hot = frequent_keys(docs, Stored(docs.sparkSession, "lines"), id_col, text_col, min_documents)
    few = _few(hot)
    out = pa.struct([("kept", pa.string()), ("n_lines", pa.int64()), ("n_dropped", pa.int64())])
    ddl = "kept string, n_lines long, n_dropped long"

    def joined(lines: pa.Array, bounds: np.ndarray, stays: np.ndarray) -> pa.Array:
        """What stays of each text, by position, and how many lines it had and lost."""
        kept = lines.filter(pa.array(stays))
        counts = np.concatenate([[0], np.cumsum(stays, dtype=np.int64)])[bounds]
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(counts.astype(np.int32)), kept.cast(pa.string())), "\n")
        n = np.diff(bounds).astype(np.int64)
        return pa.StructArray.from_arrays([texts, pa.array(n), pa.array(n - np.diff(counts))], fields=list(out))

    if few:

        @arrow_udf(ddl)
        def clean(text: pa.Array) -> pa.Array:
            wanted, parts = few(), []
            for part in groups(pa.RecordBatch.from_arrays([text], ["text"]), column=0):
                lines, bounds, codes, hashes = split_lines(part.column(0))
                goes = np.array([h in wanted for h in hashes], bool)
                parts.append(joined(lines, bounds, ~goes[codes]))
            return pa.concat_arrays(parts) if parts else pa.array([], out)

        met = docs.withColumn(own := free_name(docs, "lines"), clean(F.col(text_col)))
    else:

        @arrow_udf(ddl)
        def clean_places(text: pa.Array, places: pa.Array) -> pa.Array:
            parts = []
            for part in groups(pa.RecordBatch.from_arrays([text, places], ["text", "places"]), column=0):
                lines, bounds, _, _ = split_lines(part.column(0))
                stays = np.ones(len(lines), bool)
                gone = part.column(1)
                each = np.diff(gone.offsets.to_numpy()) if len(gone) else np.zeros(0, int)
                stays[np.repeat(bounds[:-1], each) + gone.flatten().to_numpy(zero_copy_only=False)] = False
                parts.append(joined(lines, bounds, stays))
            return pa.concat_arrays(parts) if parts else pa.array([], out)

        v = {k: free_name(docs, k) for k in ("gone", "check", "id")}
        found = _occurrences(docs, hot, id_col, text_col)
        # Rows that share id and text drop the same lines, so one list serves them all.
        gone = found.groupBy(F.col("id").alias(v["id"]), F.col("check").alias(v["check"])).agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias(v["gone"]))
        met = docs.join(gone, F.col(id_col).cast("long").eqNullSafe(F.col(v["id"])) & (F.xxhash64(text_col) == F.col(v["check"])), "left")
        met = met.withColumn(own := free_name(docs, "lines"), clean_places(F.col(text_col), F.coalesce(F.col(v["gone"]), F.array().cast("array<int>"))))
    s = F.col(own)
    others = [s["kept"].alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    return met.select(*others, F.struct(s["n_lines"].alias("n_lines"), s["n_dropped"].alias("n_dropped")).alias(dropped_column(docs)))


def dropped_column(docs: DataFrame) -> str:
    return free_name(docs, "dropped")


def line_dedup(docs: DataFrame, text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """The columns of docs with frequent lines dropped; size_col, if there, is set anew."""
    df = drop_frequent_lines(docs, text_col=text_col)
    if size_col in docs.columns:
        df = df.withColumn(size_col, F.length(F.col(text_col)).cast(docs.schema[size_col].dataType))
    return df.select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    d = F.col(dropped_column(docs))
    return drop_frequent_lines(docs).select(
        "doc_id", d["n_lines"].alias("n_lines"), d["n_dropped"].alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256")
    )


_CHARS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
#: A row is numbered, so that rows that repeat an id come back once each, as they do from the operator.
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, i, ls[i] AS line, translate(trim(ls[i], {_CHARS}), '{_UPPER}', '{_LOWER}') AS k
      FROM d, unnest(range(1, len(ls) + 1)) AS u(i)),
hot AS (SELECT k FROM l WHERE length(k) >= {MIN_CHARS} GROUP BY k HAVING count(DISTINCT doc_id) >= {MIN_DOCUMENTS})
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) - count(*) FILTER (hot.k IS NULL))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (hot.k IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN hot ON l.k = hot.k GROUP BY r, doc_id
"""
