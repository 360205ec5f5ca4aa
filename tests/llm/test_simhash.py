"""Fingerprints, links and components against brute force."""

import random

import numpy as np
import pytest
import xxhash

from corvane.llm import simhash as S
from corvane.llm.support import Stored


def brute_fingerprint(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({k: k + 32 for k in range(65, 91)}))
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", [None, "", " \n", "one", "A b C", "a b c d", "É é A b c d e f", "x " * 100, "The quick brown fox jumps over the lazy dog again and again"])
def test_fingerprint(text):
    assert S.fingerprint(text) == brute_fingerprint(text)


def brute_roots(fps):
    root = list(range(len(fps)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(k) for k in range(len(fps))]


def near(rng, n, hubs):
    out = []
    for _ in range(n):
        x = rng.choice(hubs)
        for _ in range(rng.randint(0, 5)):
            x ^= 1 << rng.randrange(64)
        out.append(x)
    return list(dict.fromkeys(out))


@pytest.mark.parametrize("cell", [1024, 16])
@pytest.mark.parametrize("r", [5, 6, 7])
def test_links_reach_what_brute_force_reaches(spark, monkeypatch, cell, r):
    rng = random.Random(r)
    fps = near(rng, 250, [rng.getrandbits(64) for _ in range(6)] + [0]) + [rng.getrandbits(64) for _ in range(50)]
    monkeypatch.setattr(S, "CELL", cell)
    monkeypatch.setattr(S, "blocks_for", lambda n: r)
    rows = [(k, int(np.array([f], np.uint64).view(np.int64)[0])) for k, f in enumerate(fps)]
    df = spark.createDataFrame(rows, "id long, fp long")
    store = Stored(spark, "t")
    roots = {x.id: x.root for x in S.components(S.links(S.with_table(df), len(rows), store), store).collect()}
    assert [roots.get(k, k) for k in range(len(fps))] == brute_roots(fps)


def test_cell_links():
    rng = random.Random(1)
    fps = np.array(near(rng, 200, [rng.getrandbits(64)]), np.uint64)
    i, j = S.cell_links(fps, None)
    want = {(a, b) for a in range(len(fps)) for b in range(a + 1, len(fps)) if int(np.bitwise_count(fps[a] ^ fps[b])) <= 4}
    assert set(zip(i.tolist(), j.tolist())) == want
    side = np.arange(len(fps)) % 2
    i, j = S.cell_links(fps, side)
    assert set(zip(i.tolist(), j.tolist())) == {(a, b) for a, b in want if (a + b) % 2}


def test_more_blocks_for_more_fingerprints():
    assert S.blocks_for(100) == 5 and S.blocks_for(10**7) == 6 and S.blocks_for(10**9) == 7
    assert all(a[1] == b[0] for r in range(5, 13) for a, b in zip(S.block_bounds(r), S.block_bounds(r)[1:]))


def test_long_chain(spark):
    edges = spark.createDataFrame([(k + 1, k) for k in range(300)], "a long, b long")
    assert {x.root for x in S.components(edges, Stored(spark, "t")).collect()} == {0}


TEXT = " ".join(f"word{k} goes{k % 7} here{k % 11}" for k in range(200))


def test_documents(spark):
    rows = [(5, TEXT, 1), (3, TEXT, 1), (9, TEXT + " end", 1), (1, None, 1), (2, "", 1), (4, "quite another text of a few words", 1), (None, TEXT, 1), (None, "only nulls say this at all", 1), (4, "quite another text of a few words", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = {r.doc_id: r.component_id for r in S.neardup_components(docs).collect() if r.doc_id is not None}
    assert got == {5: 3, 3: 3, 9: 3, 1: 1, 2: 1, 4: 4}
    out = S.drop_near_duplicates(docs)
    assert out.dtypes == docs.dtypes
    assert sorted(str(r.doc_id) for r in out.collect()) == ["1", "3", "4", "4", "None", "None"]


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert S.neardup_components(docs).count() == 0 and S.drop_near_duplicates(docs).count() == 0


def test_a_hot_key_is_split_along_a_pivot(spark, monkeypatch):
    """All fingerprints agree on half their bits, so each key of those blocks is hot; chunks that are far apart don't meet."""
    rng = random.Random(11)
    fps = list(dict.fromkeys(rng.getrandbits(32) for _ in range(400))) + near(rng, 200, [rng.getrandbits(32) for _ in range(4)])
    fps = list(dict.fromkeys(fps))
    monkeypatch.setattr(S, "CELL", 32)
    monkeypatch.setattr(S, "blocks_for", lambda n: 6)
    df = spark.createDataFrame([(k, int(np.array([f], np.uint64).view(np.int64)[0])) for k, f in enumerate(fps)], "id long, fp long")
    store = Stored(spark, "t")
    roots = {x.id: x.root for x in S.components(S.links(S.with_table(df), len(fps), store), store).collect()}
    assert [roots.get(k, k) for k in range(len(fps))] == brute_roots(fps)
    keyed = S._keyed(S.with_table(df), 6)
    plan = S._chunks(keyed, keyed.groupBy("t", "key").count().filter("count > 32")).collect()
    by = {}
    for r in plan:
        by.setdefault((r.t, r.key), []).append(r)
    for rows in by.values():
        top = max(r.high for r in rows)
        for r in rows:
            near_by = [x for x in rows if abs(x["first"] - r["first"]) <= 4]
            assert (r.least, r.most) == (min(x.low for x in near_by), max(x.high for x in near_by))
        assert top < 10 or any(r.most - r.least < top for r in rows)


def test_table_is_what_distances_are():
    fps = np.array([0, 1, (1 << 64) - 1, 0x123456789ABCDEF0], np.uint64)
    assert S.distance_table(fps).tolist() == [[(int(f) ^ int(p)).bit_count() for p in S.pivots()] for f in fps]


@pytest.mark.parametrize("small", [2, 48])
def test_many_cells_at_a_time(monkeypatch, small):
    monkeypatch.setattr(S, "SMALL", small)
    rng = random.Random(2)
    rows = []
    for c in range(40):
        members = near(rng, rng.randint(1, 30), [rng.getrandbits(64)])
        sides = [rng.randint(0, 1) for _ in members] if c % 3 == 0 else [-1] * len(members)
        rows += [(c, s, rng.getrandbits(40), f) for s, f in zip(sides, members)]
    rng.shuffle(rows)
    cells, side, ids, fps = (np.array(x, t) for x, t in zip(zip(*rows), (np.int64, np.int8, np.int64, np.uint64)))
    got = dict(zip(*(x.tolist() for x in S._linked(cells, side, ids, fps, S.distance_table(fps)))))
    for c in range(40):
        own = sorted((i, s, f) for cc, s, i, f in rows if cc == c)
        root = {i: i for i, _, _ in own}
        for _ in own:
            for i, s, f in own:
                for j, s2, f2 in own:
                    if i != j and (s < 0 or s != s2) and (f ^ f2).bit_count() <= 4:
                        root[i] = min(root[i], root[j])
        assert all(got.get(i, i) == r for i, r in root.items())
