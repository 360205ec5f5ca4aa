"""Packing, piece codec and token attribution against the tokenizer libraries."""

import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corvane.llm import packing as K
from corvane.llm import piece_codec as C
from corvane.llm import token_attribution as A

ODD = list("abcdefghijklmnop.,.,!_-'ÀÉÑµß²Σς  \n\t\r▁éñ日本한😀́\x00\x1c\xa0<|>") + ["  ", "   ", "the ", "ing", "<|endoftext|>", ". ", ",\n"]
texts = st.lists(st.sampled_from(ODD), max_size=60).map("".join)


@pytest.fixture(scope="module")
def lib():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(C.MODEL))


@pytest.fixture(scope="module")
def words():
    return Tokenizer.from_file(public_tokenizers.path(K.TOKENIZER))


@settings(max_examples=600, deadline=None)
@given(texts)
def test_piece_codec_is_exact(text):
    lib = test_piece_codec_is_exact.__dict__.setdefault("lib", sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(C.MODEL)))
    c = C.codec(public_tokenizers.path(C.MODEL))
    ids = lib.encode(text, add_eos=True)
    assert c.encode(text) == ids and c.decode(ids) == lib.decode(ids)
    n, h, d = c.digest(text)
    import hashlib

    assert (n, h, d) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest())


@pytest.mark.parametrize("text", ["a" * 3000, " " * 500, "ab" * 2000 + " x", "\n" * 50, "日本" * 300, "x" * 999 + "." + " "])
def test_piece_codec_long(lib, text):
    c = C.codec(public_tokenizers.path(C.MODEL))
    assert c.encode(text) == lib.encode(text, add_eos=True) and c.decode(c.encode(text)) == lib.decode(c.encode(text))


def test_pieces_are_what_merging_gives():
    c = C.codec(public_tokenizers.path(C.MODEL))
    rng = random.Random(3)
    for _ in range(300):
        t = "".join(rng.choice("▁abcdeinrstluo") for _ in range(rng.randint(1, 20))).replace("▁▁", "▁a")
        t = "x" + t if t[0] == "▁" and t[1:2] == "▁" else t
        assert c.backtrack(t) == c.merge(t)


@settings(max_examples=600, deadline=None)
@given(texts)
def test_chunks_are_exact(text):
    lib = test_chunks_are_exact.__dict__.setdefault("lib", Tokenizer.from_file(public_tokenizers.path(K.TOKENIZER)))
    got = K.encoder(public_tokenizers.path(K.TOKENIZER)).encode([text])[0]
    assert np.frombuffer(got, "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids


def check_packing(rows, want, size):
    for doc, ids in want:
        own = sorted((r for r in rows if r.doc_id == doc), key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(ids)
        for r in own:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
            assert r.length == size or r.piece == len(own) - 1
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= size
    return len(bins)


def test_pack(spark, words):
    rng = random.Random(5)
    data = [(k, " ".join(rng.choice(["alpha", "Beta,", "gamma.", "x9"]) for _ in range(rng.randint(0, 120)))) for k in range(300)] + [(1000, None), (1001, "")]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in data], "doc_id long, text string, piece int, sequence_id string").coalesce(1)
    rows = K.pack(docs, size=64, open_bins=8).collect()
    want = [(i, [*words.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in data]
    n = check_packing(rows, want, 64)
    assert n <= 1.08 * sum(len(x) for _, x in want) / 64 + 8
    with_ids = K.pack(docs, size=64, with_ids=True).filter("doc_id = 7").orderBy("piece").collect()
    assert [x for r in with_ids for x in r.ids] == dict(want)[7]
    assert K.pack(docs.limit(0)).count() == 0


def test_repeated_rows_and_batches(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c")], "doc_id long, text string")
    rows = K.pack(docs).collect()
    assert len(rows) == 2 and len({(r.sequence_id, r.offset) for r in rows}) == 2


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=200), st.integers(1, 6))
def test_bins(lengths, open_bins):
    f = K.BoundedBestFit(50, open_bins)
    used = {}
    for n in lengths:
        at, offset = f.place(n)
        assert offset == used.get(at, 0)
        used[at] = offset + n
        assert used[at] <= 50 and f.n_open <= open_bins and f.n_open == sum(map(len, f.bins.values()))
        assert f.bits == sum(1 << k for k in f.bins)


def test_fullest_closes_first():
    f = K.BoundedBestFit(10, 2)
    assert [f.place(n)[0] for n in (6, 8, 5, 4, 2)] == [0, 1, 2, 0, 3] or f.n_open <= 2


def test_codec_rows(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "hello  world", 1), (3, "hello  world", 1)], "doc_id long, text string, n_tokens int")
    rows = {r.doc_id: r for r in C.encode_digests(docs).collect()}
    assert rows[1].n_tokens == rows[2].n_tokens == 1 and rows[1].ids_sha256 == rows[2].ids_sha256
    assert C.encode_texts(docs).filter("doc_id = 3").first().decoded == "hello  world"
    assert C.encode_digests(docs).count() == 4 and C.encode_digests(docs.limit(0)).count() == 0


def test_attribution(spark):
    data = [(1, None), (2, ""), (3, "one\ntwo\n\n\nthree"), (4, "é\n日本語 text\n"), (5, "\n\n\n"), (6, "a" * 5000), (6, "a" * 5000), (7, "x <|endoftext|> y\nz")]
    docs = spark.createDataFrame([(i, t, 0) for i, t in data], "doc_id long, text string, section int")
    rows = A.section_tokens(docs).collect()
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    for i, t in dict(data).items():
        t = t or ""
        own = sorted({(r.section, r.start, r.end, r.n_tokens, r.n_crossing) for r in rows if r.doc_id == i})
        lines = [x for x in t.split("\n")]
        parts = [x + "\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] or len(lines) == 1 else [])
        assert [t[a:b] for _, a, b, _, _ in own] == parts
        enc = tok.encode(t)
        assert sum(x[3] for x in own) == len(enc.ids)
        # By the offsets of another library: a token belongs to the line of its first character.
        bounds = np.cumsum([len(p) for p in parts])
        homes = [int(np.searchsorted(bounds, a, "right")) for a, _ in enc.offsets]
        assert [x[3] for x in own] == [homes.count(k) for k in range(len(parts))]
    assert A.section_tokens(docs.limit(0)).count() == 0


def test_crossing_rule():
    n, crossing = A.attribute(np.array([2, 5, 6]), np.array([0, 3, 6]))
    assert n.tolist() == [2, 1] and crossing.tolist() == [1, 0]


def test_another_tokenizer_is_refused(tmp_path):
    spec = json.load(open(public_tokenizers.path(K.TOKENIZER)))
    spec["normalizer"]["normalizers"] = [n for n in spec["normalizer"]["normalizers"] if n["type"] != "Lowercase"]
    (tmp_path / "t.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="another way"):
        K.ChunkEncoder(str(tmp_path / "t.json"))


def test_a_model_that_changes_texts_is_refused(monkeypatch):
    kept = C.PieceCodec.normalise
    monkeypatch.setattr(C.PieceCodec, "normalise", lambda self, t: kept(self, t.replace("ﬁ", "fi")))
    with pytest.raises(ValueError, match="another way"):
        C.PieceCodec(public_tokenizers.path(C.MODEL))


BLANKS = st.lists(st.sampled_from(["a", "b1", "'s", "#", "é", "\x1c", "\x0b", "\x85", "\xa0", "\u3000", " ", " ", "\n", "\n", "\t", "\r", "   ", "\n\n\n"]), max_size=40).map("".join)


@settings(max_examples=500, deadline=None)
@given(BLANKS, st.integers(2, 6))
def test_long_runs_of_blanks_keep_the_tokens(text, run):
    tok = A.tokens(public_tokenizers.path(A.RANKS))
    kept = A.LONG_RUN
    try:
        A.LONG_RUN = run
        assert tok.ids(text) == tok.lib.encode_ordinary(text)
    finally:
        A.LONG_RUN = kept


@pytest.mark.parametrize("blank", [" ", "\n", "\u3000"])
def test_two_million_blanks(blank):
    tok = A.tokens(public_tokenizers.path(A.RANKS))
    n = 2_000_000
    short = tok.lib.encode_ordinary("one" + blank * 1001 + "two")
    ids = tok.ids("one" + blank * (n + 1) + "two")
    if blank != " ":  # a blank of its own is left before the next word
        assert ids[0] == short[0] and ids[-2:] == short[-2:]
    assert tok.lib.decode(ids) == "one" + blank * (n + 1) + "two"
    # A run of equal blanks merges from the left alike, whatever its length.
    unit = tok.lib.encode_ordinary(blank * 1000)
    assert tok.ids(blank * n) == unit[: len(unit) // 2] * (2 * n // 1000)
    assert int(tok.ends(blank * n)[-1]) == n * len(blank.encode())


def test_attribution_of_very_long_texts(spark):
    docs = spark.createDataFrame([(1, "\n" * 1_500_000 + "x"), (2, "word " * 400_000), (3, "y" * 1_000_000)], "doc_id long, text string")
    got = A.section_tokens(docs).groupBy("doc_id").agg({"n_tokens": "sum", "section": "count", "end": "max"}).collect()
    by = {r.doc_id: r for r in got}
    assert by[1]["count(section)"] == 1_500_001 and by[2]["sum(n_tokens)"] == 400_001 and by[3]["max(end)"] == 1_000_000


@pytest.mark.parametrize("runs,blanks", [(20, 99_999), (3, 100_000), (2, 100_001), (200, 9_000)])
def test_many_runs_of_blanks_take_linear_time(runs, blanks):
    import time

    from corvane.llm import token_attribution as A

    tok = A.tokens(A.tokenizer_path(A.RANKS))
    text = "".join(f"w{k}{' ' * blanks}" for k in range(runs)) + "end"
    began = time.perf_counter()
    got = tok.ids(text)
    assert time.perf_counter() - began < 4
    assert got == tok.lib.encode_ordinary(text)
