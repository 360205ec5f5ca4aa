"""Near copies against brute force."""

import random

import numpy as np
import pytest

import corpus_pipeline
from corvane.llm import near_copies as N


def brute_sets(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute_kept(rows):
    sets = {i: brute_sets(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in sets:
        for j in sets:
            if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i for i in sets if find(i) == i}


def edited(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


@pytest.mark.parametrize(("cell", "broadcast"), [(1024, 200_000), (8, 200_000), (8, -1)])
def test_stage_drops_what_brute_force_drops(spark, monkeypatch, cell, broadcast):
    monkeypatch.setattr(N, "CELL", cell)
    monkeypatch.setattr(N, "MAX_BROADCAST", broadcast)
    rng = random.Random(3)
    rows = []
    for g in range(12):
        words = [f"g{g}w{rng.randrange(5000)}" for _ in range(rng.choice([3, 40, 200, 600]))]
        rows += [(100 * g + k, edited(rng, words, rng.randrange(0, 1 + len(words) // 25))) for k in rng.sample(range(100), 12)]
    rows += [(5000, None), (5001, ""), (5002, " \n"), (5003, rows[0][1].upper())]
    rng.shuffle(rows)
    kept = brute_kept(rows)
    assert 20 < len(kept) < len(rows) - 20
    docs = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string")
    got = [r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    assert set(got) == kept and len(got) == len(kept) + (rows[0][0] in kept)


def test_null_ids_and_empty(spark):
    docs = spark.createDataFrame([(None, "a b c"), (7, "a b c"), (3, "a B c")], "doc_id int, text string")
    out = N.drop_near_copies(docs)
    assert out.dtypes == docs.dtypes and sorted(str(r.doc_id) for r in out.collect()) == ["3", "None"]
    assert N.drop_near_copies(docs.limit(0)).count() == 0


@pytest.mark.parametrize("most", [200_000, -1])
def test_no_text_is_shuffled_but_members(spark, monkeypatch, most):
    """The plan of what stays has no exchange of texts where few go, and one behind a filter where many do."""
    monkeypatch.setattr(N, "MAX_BROADCAST", most)
    docs = spark.createDataFrame([(k, f"one two three four five six seven {k // 2}") for k in range(40)], "doc_id long, text string").repartition(2)
    out = N.drop_near_copies(docs)
    assert sorted(r.doc_id for r in out.collect()) == list(range(0, 40, 2))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert ("ArrowEvalPython" in plan) == (most < 0)


def test_filters_pass_all_ids_and_few_others(spark):
    from pyspark.sql import functions as F

    from corvane.llm.support import Stored, join_few, passing

    side = Stored(spark, "test").cut(spark.range(0, 20_000, 2).toDF("own"))
    rows = spark.range(0, 40_000).toDF("doc_id")
    among = passing(rows, F.col("doc_id"), side, F.col("own"), 10_000)
    got = {r.doc_id for r in rows.filter(among).collect()}
    assert got >= set(range(0, 20_000, 2)) and len(got) < 10_000 + 0.05 * 30_000
    for small in (0, 20_000):
        assert join_few(rows, F.col("doc_id"), side, "own", 10_000, "left_semi", small).count() == 10_000
        assert join_few(rows, F.col("doc_id"), side, "own", 10_000, "left_anti", small).count() == 30_000


def test_keys_meet_at_the_least_similarity():
    rng = np.random.default_rng(1)
    missed = 0
    for _ in range(500):
        both, one, other = (np.unique(rng.integers(0, 1 << 63, n, np.uint64)) for n in (800, 100, 100))
        missed += not (N.band_keys(np.union1d(both, one)) == N.band_keys(np.union1d(both, other))).any()
    assert missed == 0


def test_fingerprints_give_candidates(spark):
    """Pairs whose fingerprints are near are found without any shared key, and only similar ones link."""
    from corvane.llm import simhash

    text = " ".join(f"w{k}" for k in range(400))
    docs = spark.createDataFrame([(1, text), (2, text + " end"), (3, text.replace("w7 ", "x ")), (4, " ".join(f"v{k}" for k in range(400))), (5, ""), (6, None)], "doc_id long, text string")
    sets = [N.shingles(r.text) for r in docs.orderBy("doc_id").collect()]
    fps = np.array([simhash.majority(s) if len(s) else 0 for s in sets], np.uint64)
    assert [simhash.majority(s) for s in sets[:4]] == [simhash.fingerprint(r.text, N.SHINGLE) for r in docs.orderBy("doc_id").collect()[:4]]
    assert np.bitwise_count(fps[0] ^ fps[1]) <= simhash.MAX_BITS and np.bitwise_count(fps[0] ^ fps[3]) > simhash.MAX_BITS
    near = {1} | {k + 1 for k in (1, 2) if np.bitwise_count(fps[0] ^ fps[k]) <= simhash.MAX_BITS}
    own = N._sketches(docs, "doc_id", "text").select("doc_id", "n", "fp").withColumnRenamed("doc_id", "id")
    pairs = N.components(N.by_fingerprints(own, N.Stored(spark, "t")), N.Stored(spark, "t")).collect()
    assert {r.id for r in pairs} == near and {r.root for r in pairs} == {1}
    # Near fingerprints alone don't link: sets decide.
    apart = [np.arange(k * 1000, k * 1000 + 50, dtype=np.uint64) for k in range(2)]
    assert N.cell_links(np.zeros((2, 0)), apart, None, np.array([5, 5], np.uint64)).tolist() == [0, 1]
    assert N.cell_links(np.zeros((2, 0)), [apart[0]] * 2, None, np.array([5, 5], np.uint64)).tolist() == [0, 0]
