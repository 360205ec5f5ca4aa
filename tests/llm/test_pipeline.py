"""The pipeline against a chain worked out by brute force, with nulls, empties, repeats, ties and an empty table."""

import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from corvane.llm import near_copies as N
from corvane.llm import packing as K
from corvane.llm import pii as P

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp int, lines string"
BLANKS = " \t\n\x0b\x0c\r"


def prose(k, words=70):
    rng = np.random.default_rng(k)
    return " ".join("".join(rng.choice(list("abcdefghij"), 6)) for _ in range(words))


def rows():
    bad = "Home | About | News | Contact"
    out = [(k, f"Common line of all.\n{prose(k)}\n{bad}\nMail a{k}@b.acme.com of {k}", "en") for k in range(12)]
    out += [(20, f"{prose(20)}\nown {prose(21, 9)}", "de"), (21, f"{prose(20)}\nown {prose(21, 9)} x", None)]  # near copies
    out += [(22, f"{prose(20)}\nown {prose(21, 9)}", "de"), (22, f"{prose(20)}\nown {prose(21, 9)}", "de")]  # a copy, repeated
    out += [(23, prose(23), "x")] * 2 + [(30, "short", "en"), (31, None, "en"), (32, "", "en"), (33, "same words again " * 40, "en"), (34, "buy### now&&& " * 60, "en")]
    out += [(None, f"Common line of all.\n{prose(40)}", None), (None, None, None), (50, prose(50, 30_000), "en")]
    return [(i, t, lang, "s", len(t or ""), 1, "kept") for i, t, lang in out]


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t)


def rejected(t):
    w = words(t)
    windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    covered = {k + j for k, x in enumerate(windows) if windows.count(x) > 1 for j in range(3)} if len(w) < 1000 else set()
    return len(w) < 50 or 100 * len(covered) > 50 * len(w)


def fails(line):
    n = len(words(line))
    return n > 0 and (len(re.findall("[#*$%&|<>]", line)) > 0.5 * n or len(re.findall("[|»›]", line)) > 0.2 * n)


def chain():
    """(doc_id, text) after the first three stages."""
    docs = []
    for i, t, *_ in rows():
        lines = (t or "").split("\n")
        kept = [x for x in lines if not fails(x)]
        size = lambda ls: sum(len(w) for x in ls for w in words(x))
        if not rejected(t or "") and size(lines) - size(kept) <= 0.5 * size(lines):
            docs.append((i, "\n".join(kept)))
    key = lambda x: x.strip(BLANKS).lower()
    holders = {}
    for i, t in docs:
        for x in t.split("\n"):
            holders.setdefault(key(x), set()).update([] if i is None else [i])
    docs = [(i, "\n".join(x for x in t.split("\n") if not key(x) or len(holders[key(x)]) < 10)) for i, t in docs]
    shingles = lambda w: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    named = [(i, shingles(words(t.lower()))) for i, t in docs if i is not None]
    root = {i: i for i, _ in named}
    for _ in root:
        for i, a in named:
            for j, b in named:
                if 5 * len(a & b) >= 4 * len(a | b):
                    root[i] = min(root[i], root[j])
    return [(i, t) for i, t in docs if i is None or root[i] == i]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def test_chain_against_brute_force(spark, docs):
    spark.conf.set(P.KEY_SETTING, "key of the tests")
    try:
        kept = docs
        for _, stage in corpus_pipeline.STAGES[:3]:
            kept = spark.createDataFrame(stage(spark, kept, "").collect(), kept.schema)
            assert all(r.n_chars == len(r.text) and r.lines == "kept" for r in kept.collect())
        want = chain()
        order = lambda x: (str(x[0]), x[1])
        assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=order) == sorted(want, key=order)
        assert {i for i, _ in want} == {*range(12), 20, 23, None, 50} and sum(i == 23 for i, _ in want) == 2

        hidden = corpus_pipeline.STAGES[3][1](spark, kept, "")
        assert hidden.dtypes == docs.dtypes
        mails = {}
        for r in hidden.collect():
            old = dict(want)[r.doc_id]
            found = re.findall(r"\S+@\S+", r.text)
            assert re.sub(r"\S+@\S+", "@", r.text) == re.sub(r"\S+@\S+", "@", old)
            mails |= dict(zip(re.findall(r"\S+@\S+", old), found))
        assert len(mails) == len(set(mails.values())) == 12 and not set(mails) & set(mails.values())

        hidden = spark.createDataFrame(hidden.collect(), kept.schema)
        tokenizer = Tokenizer.from_file(public_tokenizers.path(K.TOKENIZER))
        pieces = {}
        for r in corpus_pipeline.STAGES[4][1](spark, hidden, "").collect():
            pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32))
        for r in hidden.collect():
            ids = [*tokenizer.encode(r.text, add_special_tokens=False).ids, 1]
            for start in range(0, len(ids), K.SEQUENCE):
                part = ids[start : start + K.SEQUENCE]
                assert (start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())) in pieces[r.doc_id]
    finally:
        spark.conf.unset(P.KEY_SETTING)


def test_run_and_what_it_leaves(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in got.collect()} == {i for i, _ in chain()}


def test_an_empty_table_goes_through(spark, docs, tmp_path):
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_only_nulls(spark, tmp_path):
    spark.createDataFrame([(None,) * 7] * 3, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_shingles_are_five_words():
    assert N.SHINGLE == 5 and N.LEAST == (4, 5)
