"""What the operators share: table access, stored intermediates and free column names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..batches import groups  # noqa: F401
from ..naming import free_name  # noqa: F401
from ..storage import Stored, shared_folder  # noqa: F401

#: Word characters of the contracts: all but space and the controls 09 to 0D.
WORD = "[^\\x20\\x09-\\x0D]+"
#: The characters that the pattern above excludes.
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Input below which few files are dealt out to all cores, in bytes.
SMALL_INPUT = 64 * 1024 * 1024


def spread(df: DataFrame) -> DataFrame:
    """A small table of fewer files than cores, dealt out to all cores by row; any other as it is.

    A small Parquet file is one row group and so one task, whatever the number of cores.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < SMALL_INPUT and len(df.inputFiles()) < cores else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and texts of all documents."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def finite(vector: Column) -> Column:
    """True for vectors that are not null and hold no null and no non-finite component."""
    return vector.isNotNull() & F.forall(vector, lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))


#: Rows up to which a side whose size was counted goes to every task.
SMALL_SIDE = 200_000


def hinted(side: DataFrame, rows: int) -> DataFrame:
    """A stored side of a join of so many rows: sent to every task up to a bound, shuffled beyond it."""
    return F.broadcast(side) if rows <= SMALL_SIDE else side


#: A key with more than one in so many of all rows is hot, so there are fewer hot keys than this.
HOT = 10_000


def join_by_key(rows: DataFrame, keyed: DataFrame, on: list[str], weight: str, total: int) -> DataFrame:
    """rows with the columns of `keyed`, which has a row per key and, in `weight`, the rows of each key; nulls are equal.

    Fewer than HOT keys can be hot. Those are sent to every task, so that their rows stay where they are; the others' rows
    are shuffled. Both sides should be stored, as they are read twice.
    """
    names = {c: f"__{c}" for c in [*on, weight]}
    keyed = keyed.withColumnsRenamed(names)
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(names[c])) for c in on])
    hot = F.broadcast(keyed.filter(F.col(names[weight]) * HOT > total))
    cold = keyed.filter(F.col(names[weight]) * HOT <= total)
    held = rows.join(hot, same)
    rest = rows.join(hot, same, "left_anti").join(cold, same)
    return held.unionByName(rest).drop(*names.values())


#: The most bits of a filter of ids. With more ids than it suits, more rows pass it that needn't, and none less.
FILTER_BITS = 1 << 28
_PLACES = 4


def _hashes(ids: Column) -> list[Column]:
    return [F.xxhash64(F.lit(k), ids).bitwiseAND(F.lit((1 << 31) - 1)) for k in range(2)]


def passing(rows: DataFrame, ids: Column, side: DataFrame, side_ids: Column, n: int) -> Column:
    """A condition that is true for all rows whose id is among the n of the stored side, and for few others: a Bloom filter.

    It is made by an aggregate, has at most FILTER_BITS bits, and goes to every task. Only two hashes of a row go to Python.
    """
    import numpy as np
    from pyspark.sql.functions import pandas_udf

    spark = rows.sparkSession
    m = 1 << 10
    while m < min(FILTER_BITS, 12 * n):
        m *= 2
    a, b = _hashes(side_ids)
    places = F.array(*[(a + b * k).bitwiseAND(F.lit(m - 1)) for k in range(_PLACES)])
    own = side.select(F.explode(places).alias("p")).select(F.shiftright("p", 6).alias("word"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("bit"))
    found = own.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # no more rows than the filter has words
    words = np.zeros(m // 64, np.int64)
    words[found["word"].to_numpy()] = found["bits"].to_numpy()
    shared = spark.sparkContext.broadcast(words)

    @pandas_udf("boolean")
    def among(a, b):  # noqa: ANN001, ANN202
        import pandas as pd

        x, y, held = a.to_numpy(), b.to_numpy(), shared.value
        out = np.ones(len(x), bool)
        for k in range(_PLACES):
            p = (x + y * k) & (m - 1)
            out &= (held[p >> 6] >> (p & 63)) & 1 == 1
        return pd.Series(out)

    return among(*_hashes(ids))


def join_few(rows: DataFrame, ids: Column, side: DataFrame, side_ids: str, n: int, how: str, small: int = SMALL_SIDE) -> DataFrame:
    """rows joined to a stored side of n rows by an id that isn't null, `left_semi` or `left_anti`, without moving rows that have no partner.

    A small side goes to every task. Of a larger one a filter does, and only the rows that pass it are shuffled.
    """
    same = ids == side[side_ids]
    if n <= small:
        return rows.join(F.broadcast(side), same, how)
    maybe = passing(rows, ids, side, side[side_ids], n)
    met = rows.filter(maybe).join(side, same, how)
    return met if how == "left_semi" else met.unionByName(rows.filter(~maybe))
