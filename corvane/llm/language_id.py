"""Language ID by interpolated Kneser-Ney character models, one per language.

Text is read in words, runs of letters in lower case, each with a mark before and after. A language's model gives
each character of a word, and the mark after it, a probability from up to `ORDER` - 1 characters
before it, down to the mark before the word: the discounted count of that n-gram, and the rest from the
next shorter one, whose counts are numbers of different characters seen before it. Below all stands the
uniform distribution. All n-grams stand in one array of hashes per order, sorted, with a log probability and a
back-off weight per language beside each.

The language with the lowest cross-entropy per character wins. The score is the calibrated probability that
it is right: a logistic curve in the margin to the second, by characters, learned on documents
that the models have not seen. `rejected` marks texts whose cross-entropy is above all but
`REJECT` of the texts of that language there: text in none of the languages.

Learning reads texts with a letter and a language whose crc32(doc_id as text) mod 3 is not 1. Each such language gives
blocks of `BLOCK` characters, chosen by a hash of id and place at a rate that gives about `TRAIN_CHARS` characters over all
languages, `LEAST_CHARS` each at least. Of each language the text of the smallest hash teaches from its first letter on, so none
is lost, however few or long its texts are. One block in `CALIBRATE_SHARE` calibrates instead. Words are counted in the
tasks; the driver gets one row per word of a language and the blocks that calibrate. More than `MAX_LANGUAGES`
values of the language column are refused, as that is no such column.

Prediction takes whole texts of any length. Null texts and texts without a letter are `und` with score 0. Without any language
to learn, all are. Of languages with equal costs the first by name wins. Repeated rows count once each; other columns are not
read; an empty table gives no rows. Workers keep a bounded cache of words.
"""

from __future__ import annotations

import hashlib
import math
import pickle
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship_package
from .compression_quality import fit_logistic
from .support import documents, groups, table

ORDER = 5
TRAIN_CHARS = 6_000_000
LEAST_CHARS = 30_000
BLOCK = 2000
MAX_LANGUAGES = 1000
CALIBRATE_SHARE = 8  # one in so many learning blocks calibrates
REJECT = 0.002
SHORT = 30  # characters that a text lacks to be taken at its word
FOLDS = 3
UNKNOWN = "und"
_START, _END = "\x02", "\x03"
_WORDS = re.compile(r"[^\W\d_]+")
_CACHE_ENTRIES = 400_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % FOLDS == 1, F.lit(False))


def words(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


def ngram_hashes(codes: np.ndarray, place: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 1 to order: the hash of the n-gram that ends at each character; 0 where the word begins within it."""
    out, h = [], np.zeros(len(codes), np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, order + 1):
            back = np.zeros(len(codes), np.uint64)
            if len(codes) >= n:
                back[n - 1 :] = codes[: len(codes) - n + 1]
            # From the end backwards, so that an n-gram's hash builds on that of its last n - 1 characters.
            h = (h ^ back) * _MULTIPLIER
            h ^= h >> np.uint64(29)
            out.append(np.where(place >= n - 1, h | np.uint64(1), np.uint64(0)))
    return out


def _flat(ws: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters of marked words end to end, each one's place in its word, and the words' lengths."""
    marked = "".join([f"{_START}{w}{_END}" for w in ws])
    codes = np.frombuffer(marked.encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    lengths = np.fromiter(map(len, ws), np.int64, len(ws)) + 2
    return codes, np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths), lengths


@dataclass
class LanguageModels:
    """keys[n - 1]: sorted hashes of n-grams. Entries starts[n - 1][k] to starts[n - 1][k + 1] are the k-th key's languages that
    know it, each with its log probability, NaN for what is a context only, and its back-off weight beside it."""

    languages: list[str]
    floor: np.ndarray  # log of the uniform share, by language
    keys: list[np.ndarray]
    starts: list[np.ndarray]
    language: list[np.ndarray]
    logp: list[np.ndarray]
    backoff: list[np.ndarray]
    slope: float = 1.0
    middle: float = 0.0
    limits: np.ndarray | None = None

    def word_costs(self, ws: list[str]) -> np.ndarray:
        """Negative log2 probability of each word, by language."""
        codes, place, lengths = _flat(ws)
        hashes = ngram_hashes(codes, place, len(self.keys))
        width = len(self.languages)
        total = np.tile(self.floor, len(codes))  # by character, then language
        found, at = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for n in range(1, len(self.keys) + 1):
            if n > 1:
                # The context is the shorter n-gram that ends one character earlier, in the same word.
                inside = found + 1 < len(codes)
                inside[inside] = place[found[inside] + 1] >= n - 1
                rows, entries = self._entries(n - 2, found[inside] + 1, at[inside])
                total[rows * width + self.language[n - 2][entries]] += self.backoff[n - 2][entries]
            found, at = self._found(n - 1, hashes[n - 1])
            rows, entries = self._entries(n - 1, found, at)
            seen = self.logp[n - 1][entries]
            known = ~np.isnan(seen)
            total[rows[known] * width + self.language[n - 1][entries[known]]] = seen[known]
        total = total.reshape(len(codes), width)
        total[place == 0] = 0  # the mark before a word is given
        ends = np.cumsum(lengths)
        return -np.add.reduceat(total, ends - lengths, axis=0) / math.log(2)

    def _found(self, k: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are keys of order k + 1, and which keys they are."""
        keys = self.keys[k]
        if len(keys) == 0:  # no word is that long
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        found = np.flatnonzero((keys[at] == hashes) & (hashes != 0))
        return found, at[found]

    def _entries(self, k: int, rows: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row once per entry of its key, and the entry."""
        first = self.starts[k][at]
        n = self.starts[k][at + 1] - first
        return np.repeat(rows, n), np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


def fit(counts: dict[str, tuple[list[str], np.ndarray]], order: int = ORDER) -> LanguageModels:
    """Models from each language's words and their counts."""
    languages = sorted(counts)
    per: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = []
    floors = []
    for lang in languages:
        ws, freq = counts[lang]
        codes, place, lengths = _flat(ws)
        weight = np.repeat(np.asarray(freq, np.float64), lengths)
        hashes = ngram_hashes(codes, place, order)
        after = np.arange(len(codes))
        levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        # Orders from the highest: it has counts, the others numbers of different characters before;
        # n-grams that begin a word have no character before, so they keep their counts.
        used: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for n in range(1, order + 1):
            ok = (place >= n - 1) & (place > 0)
            key = hashes[n - 1][ok]
            uniq, first, inverse = np.unique(key, return_index=True, return_inverse=True)
            c = np.bincount(inverse, weight[ok])
            end = after[ok][first]  # one place where each n-gram ends
            if n < order:
                longer = (place >= n) & (place > 0)
                _, pick = np.unique(hashes[n][longer], return_index=True)
                suffix = hashes[n - 1][longer][pick]
                kinds = np.bincount(np.searchsorted(uniq, suffix), minlength=len(uniq)).astype(np.float64)
                c = np.where(place[end] == n - 1, c, kinds)
            used.append((uniq, c, end))
        alphabet = len(np.unique(codes)) + 1
        floors.append(-math.log(alphabet))
        prev_p = None
        for n, (uniq, c, end) in enumerate(used, 1):
            ones, twos = (c == 1).sum(), (c == 2).sum()
            d = min(0.95, ones / (ones + 2 * twos)) if ones else 0.5
            if n == 1:
                context_of = np.zeros(len(uniq), np.int64)
                n_context = 1
                base = np.full(len(uniq), 1 / alphabet)
            else:
                ctx, context_of = np.unique(hashes[n - 2][end - 1], return_inverse=True)
                n_context = len(ctx)
                lower = used[n - 2][0]
                base = prev_p[np.searchsorted(lower, hashes[n - 2][end])]
            sums = np.bincount(context_of, c, n_context)
            kinds = np.bincount(context_of, minlength=n_context)
            share = np.minimum(1.0, d * kinds / sums)
            p = np.maximum(c - d, 0)[:] / sums[context_of] + share[context_of] * base
            levels.append((uniq, np.log(p), None))
            if n == 1:
                floors[-1] += math.log(share[0])
            else:
                u, lp, _ = levels[n - 2]
                back = np.zeros(len(u))
                # A context may begin with the mark, which is no n-gram that is predicted.
                at = np.searchsorted(u, ctx)
                there = (at < len(u)) & (u[np.minimum(at, len(u) - 1)] == ctx)
                back[at[there]] = np.log(share[there])
                extra, extra_share = ctx[~there], share[~there]
                u2 = np.concatenate([u, extra])
                by = np.argsort(u2, kind="stable")
                levels[n - 2] = (u2[by], np.concatenate([lp, np.full(len(extra), np.nan)])[by], np.concatenate([back, np.log(extra_share)])[by])
            prev_p = p
        u, lp, _ = levels[-1]
        levels[-1] = (u, lp, np.zeros(len(u)))
        per.append(levels)
    columns: list[tuple[np.ndarray, ...]] = []
    for k in range(order):
        key = np.concatenate([lv[k][0] for lv in per] or [np.zeros(0, np.uint64)])
        own = np.repeat(np.arange(len(per)), [len(lv[k][0]) for lv in per])
        by = np.lexsort((own, key))
        union, first = np.unique(key[by], return_index=True)
        values = [np.concatenate([lv[k][i] for lv in per] or [np.zeros(0)]).astype(np.float32)[by] for i in (1, 2)]
        columns.append((union, np.append(first, len(key)), own[by].astype(np.int16), *values))
    return LanguageModels(languages, np.array(floors), *map(list, zip(*columns)))


class Scorer:
    """Costs of whole texts through a cache of words."""

    def __init__(self, models: LanguageModels):
        self.models = models
        self.place: dict[str, int] = {}
        self.costs = np.zeros((1024, len(models.languages)))

    def texts(self, texts: list[str]) -> list[tuple[np.ndarray, int] | None]:
        """Bits by language and number of characters of each text; None without a letter."""
        split = [words(t) for t in texts]
        if len(self.place) > _CACHE_ENTRIES:
            self.place.clear()
        place = self.place
        new = list(set().union(*split) - place.keys())
        if new:
            if len(self.costs) < len(place) + len(new):
                self.costs = np.concatenate([self.costs[: len(place)], np.zeros((len(place) + 2 * len(new), self.costs.shape[1]))])
            step = max(500, 80_000 // max(1, self.costs.shape[1]))  # a task holds a number for each character and language of these
            for k in range(0, len(new), step):
                part = new[k : k + step]
                self.costs[len(place) : len(place) + len(part)] = self.models.word_costs(part)
                place.update(zip(part, range(len(place), len(place) + len(part))))
        out: list[tuple[np.ndarray, int] | None] = []
        for t, ws in zip(texts, split):
            if not ws or not any(c.isalpha() for w in ws for c in w[:1]) and not any(c.isalpha() for w in ws for c in w):
                out.append(None)
                continue
            at = np.fromiter(map(place.__getitem__, ws), np.int64, len(ws))
            out.append((self.costs[at].sum(0), sum(map(len, ws)) + len(ws)))
        return out

    def predict(self, texts: list[str]) -> list[tuple[str, float, float, bool]]:
        """(language, score, bits per character, rejected) of each text."""
        m, out = self.models, []
        for found in self.texts(texts):
            if found is None or not m.languages:
                out.append((UNKNOWN, 0.0, 0.0, True))
                continue
            bits, n = found
            best = int(np.argmin(bits))
            margin = evidence(bits, n)
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, m.slope * (margin - m.middle)))))
            rate = float(bits[best] / n)
            out.append((m.languages[best], p, rate, bool(m.limits is not None and rate > m.limits[best])))
        return out


def evidence(bits: np.ndarray, n: int) -> float:
    """The margin of the best language to the second in bits per character, damped for short texts."""
    if len(bits) < 2:
        return 1.0
    best, second = np.partition(bits, 1)[:2]
    return float(second - best) / (n + SHORT)


def calibrate(models: LanguageModels, docs: list[tuple[str, str]]) -> LanguageModels:
    """Sets the curve and the limits from (language, text) pairs that the models have not seen."""
    scorer = Scorer(models)
    rows = [(lang, r) for (lang, _), r in zip(docs, scorer.texts([t for _, t in docs])) if r is not None]
    if not rows:
        return models
    x = np.array([evidence(b, n) for _, (b, n) in rows])
    y = np.array([models.languages[int(np.argmin(b))] == lang for lang, (b, _) in rows]).astype(int)
    # A text without evidence is right by chance only; that keeps the curve from standing on end.
    x, y = np.concatenate([x, [0.0, 0.0]]), np.concatenate([y, [0, 1]])
    slope, middle = fit_logistic(x, y)
    limits = np.full(len(models.languages), np.inf)
    for j, lang in enumerate(models.languages):
        own = [b[j] / n for lg, (b, n) in rows if lg == lang]
        if own:
            limits[j] = np.quantile(own, 1 - REJECT) * 1.1
    models.slope, models.middle, models.limits = max(slope, 1e-6), middle, limits
    return models


def _from_block(text: str, start: int, size: int) -> list[str]:
    """The words that begin in a block, whole but for very long ones at its end."""
    piece = text[max(0, start - 1) : start + size + 100].lower()
    lead = len(text[max(0, start - 1) : start].lower())  # the character before, which tells whether a word is cut there
    return [m[0] for m in _WORDS.finditer(piece) if lead <= m.start() < lead + size]


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_chars: int = TRAIN_CHARS) -> LanguageModels:
    """Models of the languages in docs. Words are counted in the tasks; what comes to the driver follows from train_chars."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.col(lang_col).alias("lang"))
    rows = rows.filter(~held_out(F.col("id")) & F.col("lang").isNotNull() & F.col("t").rlike(r"\p{L}")).withColumn("h", F.xxhash64("id", "t"))
    found = rows.groupBy("lang").agg(F.sum(F.length("t")).alias("n"), F.min("h").alias("least")).limit(MAX_LANGUAGES + 1).collect()
    if not found:
        return LanguageModels([], np.zeros(0), [], [], [], [], [])
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"{lang_col} holds more than {MAX_LANGUAGES} different values")
    each = max(train_chars / len(found), LEAST_CHARS)
    plan = {r.lang: (min(1.0, each / r.n), r.least) for r in found}
    schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64()), ("held", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for whole in batches:
            for batch in groups(whole):
                counts: dict[tuple[str, str], int] = {}
                held: list[tuple[str, str]] = []
                for h, t, lang in zip(*(c.to_pylist() for c in batch.columns)):
                    rate, least = plan[lang]
                    first = _first_letter(t) if h == least else -1
                    ws = _from_block(t, first, LEAST_CHARS) if first >= 0 else []
                    for start in range(0, len(t), BLOCK):
                        if first <= start < first + LEAST_CHARS + BLOCK and first >= 0:
                            continue  # taught already
                        draw = xxhash.xxh64_intdigest(b"%d/%d" % (h, start))
                        if (draw >> 32) < rate * 2.0**32:
                            if draw % CALIBRATE_SHARE == 0:
                                held.append((lang, t[start : start + BLOCK]))
                            else:
                                ws += _from_block(t, start, BLOCK)
                    for w in ws:
                        counts[lang, w] = counts.get((lang, w), 0) + 1
                out = [(lang, w, n, None) for (lang, w), n in counts.items()] + [(lang, None, 0, t) for lang, t in held]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    sample = rows.select("h", "t", "lang").mapInArrow(run, "lang string, word string, n long, held string")
    counted = sample.groupBy("lang", "word", "held").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("times")).toArrow().to_pylist()
    learned: dict[str, dict[str, int]] = {}
    held = sorted((r["lang"], r["held"]) for r in counted if r["held"] is not None for _ in range(r["times"]))
    for r in counted:
        if r["word"] is not None:
            learned.setdefault(r["lang"], {})[r["word"]] = r["n"]
    models = fit({k: (list(v), np.array(list(v.values()))) for k, v in ((k, dict(sorted(v.items()))) for k, v in learned.items())})
    return calibrate(models, held)


def _first_letter(text: str) -> int:
    m = _WORDS.search(text)
    return m.start() if m else 0


_scorers: dict[str, Scorer] = {}


def scorer(digest: str, models: Callable[[], LanguageModels]) -> Scorer:
    """The worker's scorer of the models of a digest. Tasks reach it by this function, so that it outlives them."""
    if digest not in _scorers:
        _scorers.clear()
        _scorers[digest] = Scorer(models())
    return _scorers[digest]


def digest_of(models: object) -> str:
    """Names models by what they hold."""
    return hashlib.blake2b(pickle.dumps(models), digest_size=16).hexdigest()


def identify(docs: DataFrame, models: LanguageModels, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, bits_per_char, rejected) for every row."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(models)  # bounded by what learning takes
    mark = digest_of(models)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("bits_per_char", pa.float64()), ("rejected", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scorer(mark, lambda: shared.value)
        for whole in batches:
            for batch in groups(whole):
                rows = own.predict([t or "" for t in batch.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(list(x), f.type) for x, f in zip(zip(*rows), list(schema)[1:]))], schema=schema)

    return docs.select(id_col, text_col).mapInArrow(run, "doc_id long, lang_pred string, score double, bits_per_char double, rejected boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identify(documents(spark, sf_dir), learn(table(spark, sf_dir, "documents")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "bits_per_char", "rejected")
