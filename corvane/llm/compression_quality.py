"""Quality by compression: Zstandard dictionaries of good and bad labelled text, and what each saves.

A text is cut into blocks of `BLOCK` bytes. Each is compressed with the dictionary of good and with that of
bad text; the difference of the summed sizes, by the text's bytes, tells which it is more like. As a short text
tells little, each is taken with `SHORT` bytes of the typical difference of good text. A logistic
curve in that difference gives the score. Its slope is fitted on labelled text that the dictionaries have
not seen; it is set so that it crosses `CUT` where the two classes part best on that text.

Learning takes at most `SAMPLE` labelled documents of each class of at most `MAX_TRAIN_CHARS` characters, those with the
smallest hashes of their ids, from rows whose crc32(doc_id as text) mod 5 is not 0. Scoring takes whole texts.
The dictionaries take all blocks of their texts, in bytes of any script; scoring reads texts of any length block by block.
Ids that are labelled both ways teach nothing. Without text of both classes each score is the share
of good labels in the sample, or 0.5 without any; so is that of null and empty texts. Repeated rows score alike; other
columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship_package
from .support import documents, groups, table

SAMPLE = 2000
MAX_TRAIN_CHARS = 30_000
DICTIONARY = 64 * 1024
LEVEL = 3
BLOCK = 2048
SHORT = 100  # bytes of typical good text that are added to each text
CUT = 0.3
FOLDS = 5


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    slope: float
    middle: float
    prior: float
    typical: float = 0.0

    def score(self, difference: float | None) -> float:
        """Probability of good for a damped difference; None is an empty text."""
        if difference is None or not self.slope:
            return self.prior
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * (difference - self.middle)))))


def held_out(id_col: Column, folds: int = FOLDS) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % folds == 0, F.lit(False))


class Differ:
    """Difference of compressed sizes, bad dictionary less good, by bytes."""

    def __init__(self, good: bytes, bad: bytes, typical: float = 0.0):
        import zstandard

        self.typical = typical
        self.by = []
        for content in (bad, good):
            d = zstandard.ZstdCompressionDict(content)
            d.precompute_compress(level=LEVEL)
            self.by.append(zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False))

    def difference(self, text: str | None, short: int = SHORT) -> float | None:
        """None for an empty text. short: bytes of typical text that are added."""
        raw = (text or "").encode("utf-8", "replace")
        if not raw:
            return None
        bad, good = self.by
        n = 0
        for k in range(0, len(raw), BLOCK):
            block = raw[k : k + BLOCK]
            n += len(bad.compress(block)) - len(good.compress(block))
        return (n + short * self.typical) / (len(raw) + short)


def _dictionary(texts: list[str]) -> bytes:
    """A trained dictionary; of too few texts, the texts themselves."""
    import zstandard

    blocks = [raw[k : k + BLOCK] for raw in (t.encode("utf-8", "replace") for t in texts) for k in range(0, len(raw), BLOCK)]
    try:
        return zstandard.train_dictionary(DICTIONARY, blocks).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(blocks)[:DICTIONARY].ljust(16, b" ")


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3) -> tuple[float, float]:
    """Slope and middle of a logistic curve, both classes weighing the same; x is scaled by its spread first."""
    spread = float(np.std(x)) or 1.0
    z = np.stack([x / spread, np.ones_like(x)], 1)
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    b = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        g = z.T @ (weight * (p - y)) + penalty * np.array([b[0], 0])
        h = (z * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ z + np.diag([penalty, 1e-9])
        step = np.linalg.solve(h, g)
        b -= step
        if np.abs(step).max() < 1e-8:
            break
    slope = b[0] / spread
    return float(slope), float(-b[1] / slope) if slope else 0.0


def best_cut(x: np.ndarray, y: np.ndarray) -> float:
    """The difference from which on texts count as good, with the highest mean share of both classes right."""
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    bad_below = np.concatenate([[0], np.cumsum(y == 0)])[:-1] / max(1, (y == 0).sum())
    good_above = 1 - np.concatenate([[0], np.cumsum(y == 1)])[:-1] / max(1, (y == 1).sum())
    right = np.where(np.concatenate([[True], np.diff(x) > 0]), bad_below + good_above, -1)
    k = int(np.argmax(right))
    return float((x[k] + x[k - 1]) / 2) if k else float(x[0])


def train(good: list[str], bad: list[str]) -> QualityModel:
    """Dictionaries of every second text of each class; the curve from the others."""
    prior = len(good) / (len(good) + len(bad)) if good or bad else 0.5
    if len(good) < 2 or len(bad) < 2:
        return QualityModel(b"", b"", 0.0, 0.0, prior)
    dicts = _dictionary(good[::2]), _dictionary(bad[::2])
    d = Differ(*dicts)
    d.typical = float(np.median([d.difference(t, 0) for t in good[1::2]]))
    x = np.array([d.difference(t) for t in [*good[1::2], *bad[1::2]]])
    y = np.array([1] * len(good[1::2]) + [0] * len(bad[1::2]))
    slope, middle = fit_logistic(x, y)
    if slope > 0:
        middle = best_cut(x, y) - math.log(CUT / (1 - CUT)) / slope
    return QualityModel(*dicts, slope, middle, prior, d.typical)


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[list[str], list[str]]:
    """Texts of the good and of the bad sample, in order of their ids' hashes."""
    own = labels.filter(~held_out(F.col(id_col)) & F.col(label_col).isin(0, 1))
    own = own.groupBy(id_col).agg(F.min(label_col).alias("label"), F.max(label_col).alias("most")).filter("label = most").select(id_col, "label")
    # Twice as many ids as texts, as some texts are too long or missing.
    ids = [own.filter(F.col("label") == c).orderBy(F.xxhash64(id_col), id_col).limit(2 * SAMPLE) for c in (0, 1)]
    texts = (
        docs.select(id_col, F.col(text_col).alias("t"))
        .filter(F.length("t").between(1, MAX_TRAIN_CHARS))
        .join(F.broadcast(ids[0].unionByName(ids[1])), id_col)  # at most 4 * SAMPLE ids
        .orderBy(F.xxhash64(id_col), id_col, "t")
        .select("label", "t")
    )
    out: tuple[list[str], list[str]] = ([], [])
    for c in (1, 0):
        out[1 - c].extend(r.t for r in texts.filter(F.col("label") == c).limit(SAMPLE).toLocalIterator())
    return out


_differs: dict[QualityModel, Differ] = {}


def differ(model: QualityModel) -> Differ:
    """The worker's dictionaries of a model. Tasks reach them by this function, so that they outlive them."""
    if model not in _differs:
        _differs.clear()
        _differs[model] = Differ(model.good, model.bad, model.typical)
    return _differs[model]


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, difference, score) for every row."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)  # two dictionaries of DICTIONARY bytes
    schema = pa.schema([("doc_id", pa.int64()), ("difference", pa.float64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        own = differ(m) if m.slope else None
        for whole in batches:
            for batch in groups(whole):
                x = [own.difference(t) if own else None for t in batch.column(1).to_pylist()]
                s = [m.score(d) for d in x]
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(x, pa.float64()), pa.array(s, pa.float64())], schema=schema)

    return docs.select(id_col, text_col).mapInArrow(run, "doc_id long, difference double, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(*labelled_sample(docs, table(spark, sf_dir, "labels")))
    s = score(documents(spark, sf_dir), model)
    return s.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "difference")
