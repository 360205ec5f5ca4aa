"""Exact top-k search by inner product: exhaustive term-at-a-time accumulation.

A vector's component x becomes the integer weight floor(scale * x). The dimensions are terms; a block of
candidates holds a posting list per term, or a full column where most candidates have the term. A query
adds its weight times each term's postings into a dense array of scores, term by term. Partition selection
takes the k best of the block, with ties to smaller ids, and a last step merges the blocks' lists.

Queries and candidates are dealt into blocks of a bounded number of rows, and each pair of blocks is a cell
of its own, so no side is broadcast or collected. Vectors that are null or hold null or non-finite
components take no part; a query without other candidates returns no rows. Vectors of different lengths
lack the terms they don't have. Rows that repeat an id are candidates each; a query skips every row of its
own id. Scores must fit 64 bits. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shipping import ship_package
from .support import table

K = 20
SCALE = 64
QUERY_EVERY = 20
CANDIDATES_PER_BLOCK = 16384
QUERIES_PER_BLOCK = 8192
QUERIES_PER_BATCH = 256  # whose results leave together
FULL_COLUMN = 0.5  # share of candidates with a term from which its postings are a full column


def usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))


def weights(vector: Column, scale: int = SCALE) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


class Postings:
    """Posting lists of a block of candidates that are in order of their ids."""

    def __init__(self, ids: np.ndarray, vectors: list[np.ndarray]):
        self.ids = ids
        width = max((len(v) for v in vectors), default=0)
        lengths = np.array([len(v) for v in vectors], np.int64)
        self.terms: list[tuple[np.ndarray | None, np.ndarray]] = []
        flat = np.concatenate(vectors) if vectors else np.zeros(0, np.int64)
        starts = np.cumsum(lengths) - lengths
        for t in range(width):
            rows = np.flatnonzero(lengths > t)
            w = flat[starts[rows] + t]
            there = w != 0
            if there.sum() >= FULL_COLUMN * len(ids):
                column = np.zeros(len(ids), np.int64)
                column[rows] = w
                self.terms.append((None, column))
            else:
                self.terms.append((rows[there], w[there]))

    def scores(self, query: np.ndarray) -> np.ndarray:
        """Inner product of a query with every candidate, term by term."""
        out = np.zeros(len(self.ids), np.int64)
        for t in np.flatnonzero(query[: len(self.terms)]):
            rows, w = self.terms[t]
            if rows is None:
                out += query[t] * w
            else:
                out[rows] += query[t] * w
        return out

    def best(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best candidates other than the query's own, ties to smaller ids."""
        s = self.scores(query)
        others = np.flatnonzero(self.ids != query_id)
        s = s[others]
        if len(s) > k:
            least = np.partition(s, len(s) - k)[len(s) - k]
            above = np.flatnonzero(s > least)
            at = np.concatenate([above, np.flatnonzero(s == least)[: k - len(above)]])
        else:
            at = np.arange(len(s))
        return self.ids[others[at]], s[at]


OUT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def top_k(vectors: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of vectors for which the column queries is true."""
    spark = vectors.sparkSession
    ship_package(spark)
    own = vectors.filter(usable(F.col(vector_col)) & F.col(id_col).isNotNull())
    own = own.select(F.col(id_col).cast("long").alias("id"), weights(F.col(vector_col), scale).alias("w"), F.coalesce(queries, F.lit(False)).alias("asks"))
    n, asking = own.agg(F.count(F.lit(1)), F.count_if("asks")).first()
    # A candidate is copied once per block of queries, so these are large; smaller ones only where there are fewer cells than cores.
    c_blocks, q_blocks = -(-max(n, 1) // CANDIDATES_PER_BLOCK), -(-max(asking, 1) // QUERIES_PER_BLOCK)
    q_blocks = max(q_blocks, min(-(-2 * spark.sparkContext.defaultParallelism // c_blocks), asking // QUERIES_PER_BATCH))

    def dealt(df: DataFrame, mine: int, mine_name: str, others: int, other_name: str) -> DataFrame:
        df = df.withColumn(mine_name, F.pmod(F.xxhash64("id"), F.lit(mine)).cast("int"))
        return df.withColumn(other_name, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    cells = dealt(own, c_blocks, "c", q_blocks, "q").select("c", "q", F.lit(False).alias("asks"), "id", "w").unionByName(
        dealt(own.filter("asks"), q_blocks, "q", c_blocks, "c").select("c", "q", F.lit(True).alias("asks"), "id", "w")
    )

    def search(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches).sort_by([("asks", "ascending"), ("id", "ascending")])
        asks, ids = t["asks"].to_numpy(), t["id"].to_numpy()
        w = t["w"].combine_chunks()
        flat, cuts = w.values.to_numpy(zero_copy_only=False), w.offsets.to_numpy()
        rows = [flat[a:b] for a, b in zip(cuts, cuts[1:])]
        first = int(np.searchsorted(asks, True))
        block = Postings(ids[:first], rows[:first])
        for a in range(first, len(ids), QUERIES_PER_BATCH):
            part = range(a, min(len(ids), a + QUERIES_PER_BATCH))
            best = [block.best(int(ids[i]), rows[i], k) for i in part]
            asked = np.repeat(ids[a : part.stop], [len(b[0]) for b in best])
            yield pa.RecordBatch.from_arrays([pa.array(asked), *(pa.array(np.concatenate(x)) for x in zip(*best))], schema=OUT)

    found = cells.groupBy("c", "q").applyInArrow(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_EVERY == 0)


SQL = f"""
WITH v AS (SELECT vec_id, [floor({SCALE} * x::DOUBLE)::BIGINT for x in embedding] AS w FROM embeddings
           WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum([q.w[i] * c.w[i] for i in range(1, 1 + least(len(q.w), len(c.w)))])::BIGINT AS score
      FROM v AS q JOIN v AS c ON c.vec_id <> q.vec_id WHERE q.vec_id % {QUERY_EVERY} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, coalesce(score, 0) AS score FROM r WHERE rank <= {K}
"""
