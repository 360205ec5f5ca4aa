"""Line rules and line dedup against brute force, with nulls, empties, repeats and clashing columns."""

import re
from collections import Counter

import pytest

from corvane.llm import line_dedup as D
from corvane.llm import line_quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PROSE = "".join(f"Word{k} follows{k * 3} number{k * 7} without{k % 5} end{k}.\n" for k in range(30))
CLEAN = "Some clean words in a line that says one thing and then another.\n"
TEXTS = {
    1: None, 2: "", 3: "   \n\n", 4: CLEAN + PROSE,
    5: "buy### now&&& cheap*** " * 30, 6: "same words again " * 40, 7: "Home | About | News | Contact\n" + PROSE,
    8: "THIS!! IS!! LOUD!! " * 25, 9: "Please enable JavaScript to go on.\n" + PROSE,
    10: "a\x0bb\x0cc d é퟿ x" * 20, 11: "wort " * 5000, 12: "\n".join(["dup line here"] * 5),
}


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    covered = {k + j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, t, "kept", 1) for k, t in TEXTS.items()] + [(4, TEXTS[4], "kept", 1)], "doc_id long, text string, judged string, n_chars long")


def test_counts(docs):
    for r in Q.line_quality(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(TEXTS[r.doc_id]), r.doc_id
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_verdicts(docs):
    kept = {r.doc_id for r in Q.line_quality(docs).collect() if r.kept}
    assert {4, 7, 9} <= kept and not kept & {1, 2, 3, 5, 6, 8, 11, 12}


def test_stage_cleans_and_keeps_columns(docs):
    out = Q.keep_clean(docs)
    assert out.schema == docs.schema or out.dtypes == docs.dtypes
    rows = out.collect()
    assert sum(r.doc_id == 4 for r in rows) == 2 and all(r.judged == "kept" for r in rows)
    by = {r.doc_id: r for r in rows}
    assert by[4].text == TEXTS[4] and "About" not in by[7].text and "JavaScript" not in by[9].text
    assert by[7].n_chars == len(by[7].text)


def test_native(docs):
    plan = Q.keep_clean(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty(spark, docs):
    assert Q.line_quality(docs.limit(0)).count() == 0 and Q.keep_clean(docs.limit(0)).count() == 0
    assert D.line_dedup(docs.limit(0)).count() == 0


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate({k: k + 32 for k in range(65, 91)})


def brute_dedup(rows):
    """Texts after dedup, in order of the rows (id, text); a document is its id, and null ids count for none."""
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders.setdefault(key(line), set()).update([] if i is None else [i])
    return [(str(i), "\n".join(x for x in (t or "").split("\n") if not key(x) or len(holders[key(x)]) < 10)) for i, t in rows]


@pytest.mark.parametrize("broadcast", [200_000, -1])
def test_dedup(spark, monkeypatch, broadcast):
    monkeypatch.setattr(D, "MAX_BROADCAST", broadcast)
    rows = [(k, f"Head {k}\n  COMMON line\t\nown {k % 3}\n\nÉnd", "x", 9) for k in range(12)]
    rows += [(None, "common LINE\nnull id\n common line", "x", 9), (None, None, "x", 9), (100, "", "x", 9), (101, "common line", "x", 9), (0, rows[0][1], "x", 9)]
    rows += [(200, "Ten rows of one id\nkeep this", "x", 9)] * 10 + [(300 + k, f"nine ids\n{k}", "x", 9) for k in range(9)] + [(308, "NINE ids", "x", 9), (None, "nine ids", "x", 9)]
    rows += [(400, "a\r\n" * 30_000 + "É" * 100_000, "x", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lines string, n_chars long")
    out = D.line_dedup(docs)
    assert out.dtypes == docs.dtypes
    got = out.collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted(brute_dedup([r[:2] for r in rows])) and all(r.n_chars == len(r.text) for r in got)
    assert all(r.text == "Ten rows of one id\nkeep this" for r in got if r.doc_id == 200)
    d = D.dropped_column(docs)
    one = D.drop_frequent_lines(docs).select("doc_id", f"{d}.n_lines", f"{d}.n_dropped", "text").filter("doc_id = 1").first()
    assert (one.n_lines, one.n_dropped) == (5, 2)


def test_dedup_query_and_sql_agree_on_repeated_ids(spark, tmp_path):
    import duckdb

    rows = [(7, "Ten rows of one id\nstay")] * 10 + [(k, f"shared line\n{k}\n") for k in range(20, 31)] + [(20, "shared LINE\nagain"), (None, "shared line"), (40, None)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(str, D.query(spark, str(tmp_path)).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()))
    duckdb.sql(f"CREATE OR REPLACE TEMP VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = [dict(zip(("doc_id", "n_lines", "n_dropped", "kept_sha256"), r)) for r in duckdb.sql(D.SQL).fetchall()]
    assert got == sorted("Row(" + ", ".join(f"{k}={v!r}" for k, v in w.items()) + ")" for w in want)


def test_dedup_moves_no_text_where_keys_are_few(spark, docs):
    out = D.line_dedup(docs)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
