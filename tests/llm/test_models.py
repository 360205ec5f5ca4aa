"""Language ID and compression quality: proper probabilities, held-out accuracy, and defined results for odd rows."""

import math
import os
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from corvane.llm import compression_quality as Q
from corvane.llm import language_id as L

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001").replace("sf0.001", "sf0.01")


def test_probabilities_add_up():
    m = L.fit({"x": (["abc", "abd", "bad", "cab"], np.array([3, 2, 1, 1])), "y": (["zzz", "zab"], np.array([1, 5]))})
    letters = {0: "abcd", 1: "zab"}
    for j, own in letters.items():
        for context in ("", "a", "ab", "q", "zz", "abc"):
            # Costs of a word and of its parts differ by the last character's.
            def cost(word):
                codes, place, _ = L._flat([word])
                return _log_probability(m, codes[:-1], place[:-1])[j]

            total = sum(math.exp(cost(context + c)) for c in own)
            end = math.exp(_log_probability(m, *L._flat([context])[:2])[j])
            unseen = math.exp(cost(context + "?"))
            # Letters, the end mark, the start mark and one unknown make up the alphabet.
            start = math.exp(cost(context + "\x02"))
            assert total + end + start + unseen == pytest.approx(1, abs=1e-5)


def _entry(m, n, h, j):
    """Log probability and back-off of an n-gram's hash for the j-th language, None where it isn't known."""
    k = np.searchsorted(m.keys[n - 1], h)
    if k < len(m.keys[n - 1]) and m.keys[n - 1][k] == h:
        for e in range(m.starts[n - 1][k], m.starts[n - 1][k + 1]):
            if m.language[n - 1][e] == j:
                return float(m.logp[n - 1][e]), float(m.backoff[n - 1][e])
    return None


def _log_probability(m, codes, place):
    """Log probability of the last character, straight from the back-off rule."""
    out = []
    hashes = [h[-1] for h in L.ngram_hashes(codes, place, L.ORDER)]
    before = [h[-1] for h in L.ngram_hashes(codes[:-1], place[:-1], L.ORDER)] if len(codes) > 1 else []
    for j in range(len(m.languages)):
        lp = m.floor[j]
        for n in range(1, L.ORDER + 1):
            if n > place[-1] + 1:
                break
            if n > 1 and (e := _entry(m, n - 1, before[n - 2], j)):
                lp += e[1]
            if (e := _entry(m, n, hashes[n - 1], j)) and not np.isnan(e[0]):
                lp = e[0]
        out.append(lp)
    return out


def brute_kneser_ney(freq, order):
    """Bits of a word by interpolated Kneser-Ney, counted by hand from {word: count}."""
    raw = [Counter() for _ in range(order + 1)]
    for w, f in freq.items():
        t = f"\x02{w}\x03"
        for end in range(2, len(t) + 1):
            for n in range(1, min(order, end) + 1):
                raw[n][t[end - n : end]] += f
    counts = [{}]
    for n in range(1, order + 1):
        before = Counter(g[1:] for g in raw[n + 1]) if n < order else None
        counts.append({g: c if n == order or g[0] == "\x02" else before[g] for g, c in raw[n].items()})
    alphabet = len({c for w in freq for c in f"\x02{w}\x03"}) + 1
    context = [{}] + [defaultdict(list) for _ in range(order)]
    d = [0.0]
    for n in range(1, order + 1):
        for g, c in counts[n].items():
            context[n][g[:-1]].append(c)
        ones, twos = sum(c == 1 for c in counts[n].values()), sum(c == 2 for c in counts[n].values())
        d.append(min(0.95, ones / (ones + 2 * twos)) if ones else 0.5)

    def p(g):
        if not g:
            return 1 / alphabet
        n, own = len(g), context[len(g)].get(g[:-1])
        if not own:
            return p(g[1:])
        return max(0, counts[n].get(g, 0) - d[n]) / sum(own) + min(1, d[n] * len(own) / sum(own)) * p(g[1:])

    def bits(w):
        t = f"\x02{w}\x03"
        return -sum(math.log2(p(t[max(0, k + 1 - order) : k + 1])) for k in range(1, len(t)))

    return bits


def test_costs_are_those_of_kneser_ney_counted_by_hand():
    rng = np.random.default_rng(3)
    freqs = {"x": {"abc": 3, "abd": 2, "bad": 1, "cab": 1, "a": 4}, "y": {"zzz": 1, "zab": 5}, "z": {"".join(rng.choice(list("abcdéя"), rng.integers(1, 9))): int(rng.integers(1, 6)) for _ in range(300)}}
    asked = ["abc", "a", "zab", "bacd", "q", "aaaaaaaaaaaa", "zzzz", "éябв", *list(freqs["z"])[:40]]
    m = L.fit({k: (list(v), np.array(list(v.values()))) for k, v in freqs.items()})
    got = m.word_costs(asked)
    for j, lang in enumerate(m.languages):
        bits = brute_kneser_ney(freqs[lang], L.ORDER)
        assert got[:, j] == pytest.approx([bits(w) for w in asked], rel=1e-4)


def test_word_costs_are_sums():
    m = L.fit({"x": (["abc", "abd"], np.array([3, 2])), "y": (["zab"], np.array([5]))})
    codes, place, _ = L._flat(["abd"])
    want = -sum(np.array(_log_probability(m, codes[:k], place[:k])) for k in range(2, len(codes) + 1)) / math.log(2)
    assert m.word_costs(["xyz", "abd"])[1] == pytest.approx(want, abs=1e-4)


def test_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = L.query(spark, SF).collect()
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1}
    assert sum(truth[r.doc_id] == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_rows(spark):
    train = [(k, t, lang) for k in range(60) for t, lang in (("the cat and the dog of this house", "en"), ("der hund und die katze im haus", "de"))]
    odd = [(1, None, None), (2, "", None), (3, "123 !? ²", None), (4, "THE DOG", None), (5, "katze " * 30_000, None), (5, "katze", None), (None, "haus und hund", None)]
    docs = spark.createDataFrame([(k, t, lang, 1.0) for k, t, lang in train], "doc_id long, text string, lang string, score double")
    m = L.learn(docs)
    got = L.identify(spark.createDataFrame([(k, t, 0) for k, t, _ in odd], "doc_id long, text string, lang_pred int"), m).collect()
    by = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert by[1] == by[2] == by[3] == ("und", 0.0)
    assert by[4][0] == "en" and by[5][0] == "de" and by[None][0] == "de" and len(got) == len(odd)
    none = L.learn(docs.limit(0))
    assert {r.lang_pred for r in L.identify(docs, none).collect()} == {"und"}
    assert L.identify(docs.limit(0), m).count() == 0


def test_words_of_one_or_two_letters(spark):
    docs = spark.createDataFrame([(k, t, lang) for k in range(30) for t, lang in (("a b, ab", "x"), ("ы и я", "y"))], "doc_id long, text string, lang string")
    m = L.learn(docs)
    asked = spark.createDataFrame([(1, "b a"), (2, "и ы ящик"), (3, "abab ab a")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in L.identify(asked, m).collect()} == {1: "x", 2: "y", 3: "x"}


def test_few_huge_documents_are_learned(spark):
    ids = [k for k in range(100) if zlib.crc32(str(k).encode()) % 3 != 1]
    rows = [(k, f"the house and the garden number {k} are green and old " * 20, "en") for k in ids[4:]]
    rows += [(k, "слово и дом у реки где живут люди " * 150_000, "ru") for k in ids[:2]] + [(ids[2], "1" * 50_000 + " λόγος και σπίτι στο ποτάμι", "el"), (ids[3], "12 34", "none")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = L.learn(docs, train_chars=60_000)
    assert m.languages == ["el", "en", "ru"]
    asked = spark.createDataFrame([(1, "дом где люди"), (2, "σπίτι και λόγος"), (3, "old garden")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in L.identify(asked, m).collect()} == {1: "ru", 2: "el", 3: "en"}


def test_learning_is_the_same_for_any_partitions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    a, b = (L.learn(docs.repartition(n), train_chars=100_000) for n in (1, 7))
    assert a.slope == b.slope and all((x == y).all() for x, y in zip(a.keys, b.keys)) and all(np.array_equal(x, y, equal_nan=True) for x, y in zip(a.logp, b.logp))


def test_too_many_languages_are_refused(spark, monkeypatch):
    monkeypatch.setattr(L, "MAX_LANGUAGES", 3)
    docs = spark.createDataFrame([(k, "some text", f"l{k}") for k in range(20)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="more than 3"):
        L.learn(docs)


def test_learning_ignores_held_out(spark):
    ids = [k for k in range(200) if zlib.crc32(str(k).encode()) % 3 == 1]
    docs = spark.createDataFrame([(k, "nur text", "xx") for k in ids], "doc_id long, text string, lang string")
    assert L.learn(docs).languages == []


def test_quality(spark):
    rows = Q.query(spark, SF).collect()
    truth = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{SF}/labels.parquet'").fetchall())
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    good = [r.predicted for r in held if truth[r.doc_id] == 1]
    bad = [r.predicted for r in held if truth[r.doc_id] == 0]
    assert np.mean(good) > 0.9 and np.mean(bad) < 0.3
    assert all((r.score >= 0.3) == (r.predicted == 1) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 300_000), (3, "x"), (None, "word")], "doc_id long, text string")
    assert {r.score for r in Q.score(docs, Q.train([], [])).collect()} == {0.5}
    good, bad = [f"Some prose of number {k} which tells of many things." for k in range(40)], [f"BUY{k}!!! ### $$$ NOW {k}" for k in range(40)]
    m = Q.train(good, bad)
    got = Q.score(docs, m).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got) and Q.score(docs.limit(0), m).count() == 0
    both = spark.createDataFrame([(1, good[0]), (2, bad[0])], "doc_id long, text string")
    s = {r.doc_id: r.score for r in Q.score(both, m).collect()}
    assert s[1] > 0.3 > s[2]
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (None, 1), (3, None)], "doc_id long, quality int")
    assert Q.labelled_sample(both, labels) == ([bad[0]], [])


def test_best_cut():
    x, y = np.array([0.1, 0.2, 0.3, 0.4]), np.array([0, 0, 1, 1])
    assert Q.best_cut(x, y) == pytest.approx(0.25)


def test_dictionaries_learn_from_whole_texts(monkeypatch):
    import zstandard

    from corvane.llm import compression_quality

    taken = []

    def refuse(size, blocks):
        taken.extend(blocks)
        raise zstandard.ZstdError

    monkeypatch.setattr(zstandard, "train_dictionary", refuse)
    texts = ["слово" * 2000, "文字" * 1500, "plain " * 700, ""]
    compression_quality._dictionary(texts)
    assert b"".join(taken) == "".join(texts).encode() and all(0 < len(b) <= compression_quality.BLOCK for b in taken)


def test_languages_of_one_document_are_learned(spark):
    from corvane.llm import language_id

    rows = [(k, f"the house and the garden of number {k} are green and old " * 20, "en") for k in range(40)]
    rows += [(1000 + k, f"слово{k} и дом у реки где живут люди " * 300, f"x{k}") for k in range(24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    want = {r.lang for r in docs.filter(~language_id.held_out(docs.doc_id)).collect()}
    assert len(want) > 15 and set(language_id.learn(docs, train_chars=60_000).languages) == want


def test_differences_are_those_of_plain_compression():
    import zstandard

    rng = np.random.default_rng(5)
    words = ["the", "house", "and", "garden", "of", "old", "BUY", "NOW", "!!!", "слово", "文字"]
    text = lambda k, n: " ".join(rng.choice(words[:6] if k else words[6:], n))
    good, bad = [text(1, 300) for _ in range(60)], [text(0, 300) for _ in range(60)]
    m = Q.train(good, bad)
    for t in (text(1, 5), text(0, 50), text(1, 3000), text(0, 6000), "x"):
        raw, n = t.encode(), 0
        for a in range(0, len(raw), Q.BLOCK):
            sizes = []
            for content in (m.bad, m.good):
                c = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content), level=Q.LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
                packed = c.compress(raw[a : a + Q.BLOCK])
                assert zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content)).decompress(packed, max_output_size=Q.BLOCK) == raw[a : a + Q.BLOCK]
                sizes.append(len(packed))
            n += sizes[0] - sizes[1]
        assert Q.Differ(m.good, m.bad, m.typical).difference(t) == pytest.approx((n + Q.SHORT * m.typical) / (len(raw) + Q.SHORT))


def test_models_of_equal_dictionaries_are_kept_apart(spark):
    good, bad = [f"Some prose of number {k} which tells of many things." for k in range(40)], [f"BUY{k}!!! ### $$$ NOW {k}" for k in range(40)]
    m = Q.train(good, bad)
    other = Q.QualityModel(m.good, m.bad, m.slope, m.middle, m.prior, m.typical + 0.5)
    docs = spark.createDataFrame([(1, "a short text")], "doc_id long, text string").coalesce(1)
    a, b = (Q.score(docs, x).first().difference for x in (m, other))
    assert a != b == Q.Differ(other.good, other.bad, other.typical).difference("a short text")


def test_models_of_one_session_give_their_own_answers(spark):
    from corvane.llm import language_id as L

    said = {"aa": "alpha beta gamma delta under over", "bb": "omega sigma kappa lambda hinter vor"}
    names = {"aa": "bb", "bb": "aa"}
    rows = [(k, " ".join([said[lang]] * 60), lang) for k, lang in enumerate(["aa", "bb"] * 30)]
    make = lambda swap: L.learn(spark.createDataFrame([(i, t, names[lang] if swap else lang) for i, t, lang in rows], "doc_id long, text string, lang string"))
    one, other = make(False), make(True)
    assert L.digest_of(one) != L.digest_of(other)
    asked = spark.createDataFrame([(1, said["aa"])], "doc_id long, text string").coalesce(1)
    for models, want in ((one, "aa"), (other, "bb"), (one, "aa"), (other, "bb")):
        assert L.identify(asked, models).first().lang_pred == want
    # A worker keeps its scorer for later tasks: the function is found by its module, not copied with its globals.
    assert L.scorer.__module__ == "corvane.llm.language_id" and L.scorer("x", lambda: one) is L.scorer("x", lambda: other)
