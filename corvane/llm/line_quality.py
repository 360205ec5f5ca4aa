"""Line-first cleaning: rules for each line, then for what is left of the document. DataFrame functions only.

A line with words fails if its words are mostly marked with symbols (punctuation rule), if bars or
arrows separate its words (navigation rule), if it is shouted (capitals with exclamation marks), or
if it is a boilerplate phrase. Failing lines go; a document that loses more than `MAX_LOST` of its
word characters is rejected. Before that, the base rule rejects short and repetitive documents.

Null text counts as no words and is rejected. Empty lines stay and carry no weight. Texts of any length are read whole, as
one row each; a text's work is its words times the logarithm of their number at most. Repeated rows are judged alike; an
empty table gives an empty one; other columns pass through, whatever their names.

Most texts have no mark or phrase that a rule looks for, and no window of words twice; what only the others need is computed for them alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .support import WORD, documents, free_name

MIN_WORDS = 50
MAX_REPEATED = 50  # percent of words in repeated windows of three
SYMBOLS = "[#*$%&|<>]"
MAX_SYMBOLS_PER_WORD = 0.5
MAX_BARS_PER_WORD = 0.2
MIN_SHOUTED_WORDS = 3
MAX_SHOUTS_PER_WORD = 0.5
MAX_LOST = 0.5

#: Phrases that mark a line as boilerplate, lower case.
BOILERPLATE = (
    "enable javascript",
    "javascript is disabled",
    "accept cookies",
    "we use cookies",
    "privacy policy",
    "terms of use",
    "terms of service",
    "subscribe to our newsletter",
    "click here",
    "lorem ipsum",
    "back to top",
    "skip to content",
)


BARS = "[|»›]"
#: Marks of which a line has one at least if any rule but that of phrases fails it.
MARKS = "[#*$%&|<>»›!]"
_BLANKS = " \t\n\x0b\x0c\r"
_SHOUT = "(?:^|[\\x20\\x09-\\x0D])[^\\p{Ll}\\x20\\x09-\\x0D]*\\p{Lu}[^\\p{Ll}\\x20\\x09-\\x0D]*!"
_PHRASES = "|".join(BOILERPLATE)


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")


def has_phrase(text: Column) -> Column:
    """True where a boilerplate phrase occurs at all; spares most documents the search by line."""
    low = F.lower(text)
    found = low.contains(BOILERPLATE[0])
    for p in BOILERPLATE[1:]:
        found = found | low.contains(p)
    return found


def line_fails(line: Column, phrases: Column) -> Column:
    """True if one of the rules removes this line. Null and wordless lines never fail. phrases: `has_phrase` of the text."""
    n = F.regexp_count(line, F.lit(WORD))
    # The capitals are looked for only where there is an exclamation mark.
    shouts = F.when(line.contains("!"), F.regexp_count(line, F.lit(_SHOUT))).otherwise(0)
    return F.coalesce(
        (n > 0)
        & (
            (F.regexp_count(line, F.lit(SYMBOLS)) > MAX_SYMBOLS_PER_WORD * n)
            | (F.regexp_count(line, F.lit(BARS)) > MAX_BARS_PER_WORD * n)
            | ((n >= MIN_SHOUTED_WORDS) & (shouts > MAX_SHOUTS_PER_WORD * n))
            | (phrases & F.lower(line).rlike(_PHRASES))
        ),
        F.lit(False),
    )


def _word_chars(text: Column) -> Column:
    """Code points in words."""
    return F.length(F.translate(text, _BLANKS, ""))


def judge(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and cleaned text.

    The columns are returned in a struct named by the caller's free name, see `judged_column`.
    """
    v = {k: free_name(docs, k) for k in ("text", "words", "lines", "win", "sorted", "pos", "seen", "fail", "lost", "phrases")}
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.withColumn(v["text"], text)
    df = df.withColumn(v["words"], _words(F.col(v["text"]))).withColumn(v["lines"], F.split(F.col(v["text"]), "\n")).withColumn(v["phrases"], has_phrase(F.col(v["text"])))
    w, lines = F.col(v["words"]), F.col(v["lines"])
    n = F.size(w)
    # Three-word windows by hash. Where some are equal, they are sorted with their places, so that equal ones are neighbours.
    df = df.withColumn(v["win"], F.transform(F.slice(w, F.lit(1), F.greatest(n - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))))
    win = F.col(v["win"])
    repeats = F.size(F.array_distinct(win)) < F.size(win)
    df = df.withColumn(v["sorted"], F.when(repeats, F.sort_array(F.transform(win, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    by = F.col(v["sorted"])
    df = df.withColumn(
        v["pos"],
        F.sort_array(
            F.transform(
                F.filter(by, lambda x, k: F.coalesce(x["h"] == F.get(by, k + 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(by, k - 1)["h"], F.lit(False))),
                lambda x: x["i"],
            )
        ),
    )
    pos = F.col(v["pos"])
    # A window covers three words; of two windows that overlap, the first counts only what the second doesn't.
    covered = F.aggregate(
        pos,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("at")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["at"])).alias("n"), p.alias("at")),
        lambda a: a["n"],
    )
    covered = F.coalesce(covered, F.lit(0).cast("long"))
    worded = F.filter(lines, lambda x: x.rlike(WORD))
    # Null where no line can fail.
    odd = F.col(v["phrases"]) | F.col(v["text"]).rlike(MARKS)
    df = df.withColumn(v["fail"], F.when(odd, F.transform(lines, lambda x: line_fails(x, F.col(v["phrases"]))))).withColumn(v["seen"], worded)
    fail, seen = F.col(v["fail"]), F.col(v["seen"])
    failed_lines = F.filter(lines, lambda x, i: fail[i])
    out = {
        "n_words": n.cast("long"),
        "word_chars": _word_chars(F.col(v["text"])).cast("long"),
        "n_symbols": F.regexp_count(F.col(v["text"]), F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": (F.size(seen) - F.size(F.array_distinct(seen))).cast("long"),
        "n_repeat_words": covered,
    }
    lost = F.when(fail.isNull(), 0).otherwise(_word_chars(F.array_join(failed_lines, "")))
    df = df.withColumn(v["lost"], F.struct(*[c.alias(k) for k, c in out.items()], lost.cast("long").alias("lost_chars")))
    s = F.col(v["lost"])
    base = (s["n_words"] < MIN_WORDS) | (F.lit(100) * s["n_repeat_words"] > MAX_REPEATED * s["n_words"])
    kept = ~base & (s["lost_chars"] <= MAX_LOST * s["word_chars"])
    cleaned = F.when(fail.isNull(), F.col(v["text"])).otherwise(F.array_join(F.filter(lines, lambda x, i: ~fail[i]), "\n"))
    return df.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.struct(*[s[k].alias(k) for k in (*out, "lost_chars")], base.alias("base_failed"), kept.alias("kept"), cleaned.alias("cleaned")).alias(judged_column(docs)),
    )


def judged_column(docs: DataFrame) -> str:
    return free_name(docs, "judged")


def line_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its counts and verdict."""
    docs = docs.select(id_col, text_col)
    j = F.col(judged_column(docs))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars")
    return judge(docs, text_col).select(id_col, *[j[k].alias(k) for k in names])


def keep_clean(docs: DataFrame, text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """The documents that pass, with failing lines removed; columns as they were. size_col, if there, is set anew."""
    name = judged_column(docs)
    j = F.col(name)
    # One row or none from each document: a filter would be pushed below the columns that it reads, and repeat their work.
    texts = F.when(j["kept"], F.array(j["cleaned"])).otherwise(F.expr("array()").cast("array<string>"))
    df = judge(docs, text_col).select(*[F.col(f"`{c}`") for c in docs.columns if c != text_col], F.explode(texts).alias(text_col))
    if size_col in docs.columns:
        df = df.withColumn(size_col, F.length(F.col(text_col)).cast(docs.schema[size_col].dataType))
    return df.select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality(documents(spark, sf_dir))


SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
             string_split(t, chr(10)) AS ls FROM d),
win AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS x
        FROM w, unnest(range(1, len(ws) - 1)) AS u(i) WHERE len(ws) >= 3),
dup AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, x) AS c FROM win) WHERE c >= 2),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM dup, unnest([0, 1, 2]) AS u(k) GROUP BY doc_id),
l AS (SELECT doc_id, line, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS n FROM (SELECT doc_id, unnest(ls) AS line FROM w)),
f AS (SELECT doc_id, line, n, n > 0 AND (
        len(regexp_extract_all(line, '{SYMBOLS}')) > {MAX_SYMBOLS_PER_WORD} * n
        OR len(regexp_extract_all(line, '{BARS}')) > {MAX_BARS_PER_WORD} * n
        OR (n >= {MIN_SHOUTED_WORDS} AND len(regexp_extract_all(line, '{_SHOUT}')) > {MAX_SHOUTS_PER_WORD} * n)
        OR regexp_matches(lower(line), '{_PHRASES}')) AS fail FROM l),
g AS (SELECT doc_id, count(*) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0) AS n_dup_lines,
             coalesce(sum(length(regexp_replace(line, '[\\x20\\x09-\\x0D]+', '', 'g'))) FILTER (fail), 0)::BIGINT AS lost_chars
      FROM f GROUP BY doc_id),
b AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
             len(regexp_extract_all(t, '{SYMBOLS}'))::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
             coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, lost_chars
      FROM w JOIN g USING (doc_id) LEFT JOIN rep USING (doc_id))
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words) AND lost_chars <= {MAX_LOST} * word_chars AS kept
FROM b
"""
