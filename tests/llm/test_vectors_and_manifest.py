"""Vector codes, near copies of vectors and the manifest against plain loops."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from corvane.llm import merkle, vector_codes, vector_copies
from corvane.llm.support import Stored, join_by_key

NAN, INF = float("nan"), float("inf")
VECTORS = "vec_id long, embedding array<float>, label int"


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


# ---- vector codes


def plain_codes(rows, parts=16, entries=64, rounds=2):
    own = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows if usable(v)]
    own.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(own[0][1]) // parts
    cut = [[w[p * width : (p + 1) * width] for p in range(parts)] for _, w, _ in own]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(x, book):
        d = [sum((a - b) ** 2 for a, b in zip(x, c)) for c in book]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        for p in range(parts):
            of = [[] for _ in books[p]]
            for c in cut:
                of[nearest(c[p], books[p])[0]].append(c[p])
            books[p] = [[sum(x) // len(m) for x in zip(*m)] if m else old for m, old in zip(of, books[p])]
    found = [[nearest(c[p], books[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for _, d in f) for f in found]
    by = {}
    for (_, _, lab), e in zip(own, errors):
        by[lab] = by.get(lab, 0) + e
    digest = hashlib.sha256(",".join(str(x) for p in books for c in p for x in c).encode()).hexdigest()
    return sorted(((str(i), "".join(f"{e:02x}" for e, _ in f), err, by[lab], digest) for (i, _, lab), f, err in zip(own, found, errors)))


def coded(spark, rows, tmp_path, schema=VECTORS):
    folder = str(tmp_path / "t")
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{folder}/embeddings.parquet")
    got = vector_codes.query(spark, folder)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted((str(r[0]), *r[1:]) for r in got.collect())


def test_codes_equal_plain_rounds(spark, tmp_path):
    rng = random.Random(3)
    centres = [[rng.uniform(-1, 1) for _ in range(32)] for _ in range(9)]
    rows = [(k, [float(np.float32(x + rng.gauss(0, 0.05))) for x in rng.choice(centres)], rng.choice([1, 1, 2, None])) for k in range(300)]
    rows += [(300, None, 1), (301, [None] * 32, 1), (302, [NAN] * 32, 2), (303, [INF] * 32, 2), (None, [0.5] * 32, 1), (7, rows[7][1], 1)]
    assert coded(spark, rows, tmp_path) == plain_codes(rows)


def test_codes_with_ties_and_few_vectors(spark, tmp_path):
    # Components of two values only: entries repeat and distances tie everywhere, so that the lower index must win.
    rng = random.Random(4)
    rows = [(k, [rng.choice([0.0, 1 / 256]) for _ in range(16)], 1) for k in range(200)]
    assert coded(spark, rows, tmp_path) == plain_codes(rows)
    for n in (1, 2):
        few = [(k, [0.25 * k] * 16, None) for k in range(n)]
        assert coded(spark, few, tmp_path) == plain_codes(few)


def test_codes_of_odd_tables(spark, tmp_path):
    assert coded(spark, [], tmp_path) == []
    assert coded(spark, [(1, None, 1)], tmp_path) == []
    assert [r[1:3] for r in coded(spark, [(1, [], 1), (2, [], 1)], tmp_path)] == [("00" * 16, 0)] * 2
    clashing = coded(spark, [(1, [0.5] * 16, 1, "x", b"y")], tmp_path, VECTORS + ", w string, code binary")
    assert clashing == plain_codes([(1, [0.5] * 16, 1)])
    with pytest.raises(ValueError, match="one length"):
        coded(spark, [(1, [0.5] * 16, 1), (2, [0.5] * 32, 1)], tmp_path)
    with pytest.raises(ValueError, match="stay below"):
        coded(spark, [(1, [1e30] * 16, 1)], tmp_path)


def test_bounds_spare_scans_and_never_change_a_code():
    rng = np.random.default_rng(1)
    x = rng.integers(-200, 200, (3000, 4))
    x[::3] = x[0] + rng.integers(-3, 3, (1000, 4))
    old = x[:64].copy()
    code, upper, lower = vector_codes.scan(x, old)
    new = old + rng.integers(-2, 3, old.shape)
    got, up, low, scanned = vector_codes.rescan(x, old, new, code, upper, lower)
    want, d, second = vector_codes.scan(x, new)
    assert (got == want).all() and 0 < scanned < 0.8 * len(x)
    assert (up >= d).all() and (low <= second + 1e-6).all()


# ---- near copies of vectors


def plain_links(rows):
    n = len(rows)
    links, at = [0] * n, list(range(n))

    def find(k):
        while at[k] != k:
            k = at[k]
        return k

    ok = [usable(v) and any(v) and lab is not None for _, v, lab in rows]
    for a in range(n):
        for b in range(a):
            if ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = (np.array(rows[k][1], np.float64) for k in (a, b))
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
                    links[a] += 1
                    links[b] += 1
                    at[find(a)] = find(b)
    least = {}
    for k in range(n):
        least[find(k)] = min(least.get(find(k), rows[k][0]), rows[k][0])
    return sorted((rows[k][0], links[k], least[find(k)], rows[k][0] == least[find(k)]) for k in range(n))


def near(spark, rows, schema=VECTORS, **how):
    got = vector_copies.near_vectors(spark.createDataFrame(rows, schema).repartition(3), **how)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    return sorted(tuple(r) for r in got.collect())


def noisy(rng, v, cosine):
    """A vector at exactly about this cosine to v, in a random direction."""
    v = v / np.linalg.norm(v)
    d = rng.normal(size=len(v))
    d -= d @ v * v
    return cosine * v + math.sqrt(1 - cosine**2) * d / np.linalg.norm(d)


def planted(seed=5, n=400, width=64):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        v = rng.normal(size=width)
        rows.append((len(rows), v, int(rng.integers(3))))
        for c in (0.9305, 0.9295, 0.95, 1.0)[: k % 5]:
            rows.append((len(rows), noisy(rng, v, c) * rng.uniform(0.5, 2), rows[-1][2] if k % 7 else 1))
    rows = [(i, [float(x) for x in v.astype(np.float32)], lab) for i, v, lab in rows]
    rng.shuffle(rows)
    return [(int(i), v, int(lab)) for i, v, lab in rows]


def test_links_equal_brute_force(spark):
    rows = planted()
    copies = [(5000 + k, rows[0][1], rows[0][2]) for k in range(40)]
    odd = [(9000, None, 1), (9001, [0.0] * 64, 1), (9002, [NAN] * 64, 1), (9003, [None] * 64, 1), (9004, rows[1][1], None), (9005, rows[1][1][:32], rows[1][2]), (9006, [], 1), (9007, [1e-30] * 64, 0), (9008, [1e30] * 64, 0)]
    rows = rows + copies + odd
    assert near(spark, rows) == plain_links(rows)


def test_links_over_many_lists_blocks_and_cells(spark, monkeypatch):
    # Small lists and cells, so that vectors of a few hundred meet in many of them.
    rows = planted(6, 500)
    rng = np.random.default_rng(7)
    centre = rng.normal(size=64)
    rows += [(7000 + k, [float(x) for x in noisy(rng, centre, 0.975).astype(np.float32)], 1) for k in range(150)]
    for name, value in (("LIST", 16), ("CELL", 24), ("ASKS", 40)):
        monkeypatch.setattr(vector_copies, name, value)
    want = plain_links(rows)
    got = near(spark, rows)
    found, real = sum(r[1] for r in got), sum(r[1] for r in want)
    print("recall of links", found / real)
    assert [r[0] for r in got] == [r[0] for r in want] and all(a[1] <= b[1] for a, b in zip(got, want)) and found >= 0.99 * real
    assert near(spark, rows, margin=1.0) == want  # at a margin of 1 nothing can be lost


def test_links_of_odd_tables(spark):
    assert near(spark, []) == []
    assert near(spark, [(1, None, 1), (2, [1.0], None)]) == [(1, 0, 1, True), (2, 0, 2, True)]
    assert near(spark, [(3, [1.0, 2.0], 1), (3, [1.0, 2.0], 1), (2, [2.0, 4.0], 1)]) == [(2, 2, 2, True), (3, 2, 2, False), (3, 2, 2, False)]
    clashing = "vec_id long, embedding array<double>, label string, h string, n int, list int"
    assert near(spark, [(1, [0.5, 0.5], "a", "", 1, 1), (2, [0.5, 0.51], "a", "", 1, 1)], clashing) == [(1, 1, 1, True), (2, 1, 1, False)]
    nulls = vector_copies.near_vectors(spark.createDataFrame([(None, [1.0, 0.0], 1), (4, [1.0, 0.01], 1), (None, [0.0, 1.0], 1)], VECTORS)).collect()
    assert sorted(map(str, (tuple(r) for r in nulls))) == sorted(map(str, [(None, 1, 4, None), (4, 1, 4, True), (None, 0, None, None)]))


def test_codes_never_discard_a_link():
    rng = np.random.default_rng(2)
    x = vector_copies.unit(rng.normal(size=(600, 40)))
    q = vector_copies.Quantiser.fit(x, [1, 4])
    for n in (1, 4):
        home, codes, left, asks = q.index(x, n)
        away = np.linalg.norm(x[:, None] - q.decoded(home, codes, n)[None], axis=2)
        assert (away - left[None] <= np.linalg.norm(x[:, None] - x[None], axis=2) + 1e-9).all()
        assert asks[np.arange(600), home].all()


# ---- manifest


def plain_manifest(rows):
    def digest(*parts):
        return hashlib.sha256("".join(parts).encode()).hexdigest()

    def leaf(values):
        return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    def lowered(t):
        return None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)

    def proofs(nodes):
        ways, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
        while len(level) > 1:
            runs = [level[k : k + 8] for k in range(0, len(level), 8)]
            for w, a in zip(ways, at):
                w.append((runs[a // 8][: a % 8], runs[a // 8][a % 8 + 1 :]))
            at, level = [a // 8 for a in at], [digest(*r) for r in runs]
        return level[0], ways

    out, subs = [], []
    for g in sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode())):
        own = sorted(((r, leaf(r)) for r in rows if r[2] == g), key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        sub, ways = proofs([x[1] for x in own])
        subs.append((sub, own, ways))
    if not subs:
        return []
    root, tops = proofs([s for s, _, _ in subs])
    for (sub, own, ways), top in zip(subs, tops):
        for (r, d), way in zip(own, ways):
            touched = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            x = leaf((*r[:4], lowered(r[4]))) if touched else d
            for left, right in way + top:
                x = digest(*left, x, *right)
            out.append((r[0], d, sub, root, digest(*(s for step in way + top for side in step for s in side)), x, x == root))
    return sorted(map(str, out))


def manifest(spark, rows, schema="doc_id long, source string, lang string, n_chars long, text string", wider=lambda r: r, tall=merkle.HEIGHT):
    got = merkle.document_manifest(spark.createDataFrame([wider(r) for r in rows], schema).repartition(3), tall)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(str(tuple(r)) for r in got.collect())


def documents(sizes):
    rng = random.Random(1)
    rows = [(k, "web", g, len(g or ""), rng.choice(["Some Text", "no capitals", "ÄÖ Ü", None, ""])) for g, n in sizes.items() for k in rng.sample(range(10**6), n)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("height", [1, 2, 4])
def test_manifest_equals_plain_folds(spark, height):
    # Blocks of 8 and 64 leaves make several tiers of the same trees.
    rows = documents({"en": 521, "de": 64, "fr": 65, None: 9, "": 1, "=": 8, "ß": 2, "zz": 7, "é": 1, "a": 3})
    rows += [(None, None, "en", None, "A"), (None, None, "en", None, "B"), rows[0], rows[0]]
    assert manifest(spark, rows, tall=height) == plain_manifest(rows)


def test_manifest_of_odd_tables(spark):
    assert manifest(spark, []) == []
    for rows in ([(1, "s", None, None, None)], [(1, "s", "en", 5, "X" * 300_000)], documents({g: 1 for g in "abcdefghij"})):
        assert manifest(spark, rows) == plain_manifest(rows)
    rows = documents({"en": 12})
    wide = "doc_id long, source string, lang string, n_chars long, text string, digest int, grp string, pos int"
    assert manifest(spark, rows, wide, lambda r: (*r, 1, "x", 2)) == plain_manifest(rows)


def test_traversal_gives_ways_that_fold_to_the_root():
    for n in (1, 2, 8, 9, 64, 65, 513):
        leaves = [merkle.h(str(k).encode()) for k in range(n)]
        ways = [[] for _ in leaves]
        root = merkle.traverse(leaves, merkle.levels(n), ways)
        assert all(merkle.fold(d, w) == root for d, w in zip(leaves, ways))
        assert all(merkle.fold(merkle.h(d), w) != root for d, w in zip(leaves, ways))


# ---- shared


def test_join_by_key_sends_hot_keys_and_shuffles_the_others(spark):
    rows = spark.createDataFrame([(k % 3 if k % 3 else None, k) for k in range(300)] + [(50 + k, k) for k in range(40)], "g int, x int")
    keyed = Stored(spark, "test").cut(rows.groupBy("g").count())
    for total in (340, 340 * 10_000 * 100):  # all keys hot, then none
        got = join_by_key(rows, keyed.withColumn("twice", keyed["count"] * 2), ["g"], "count", total)
        assert got.columns == ["g", "x", "twice"] and got.count() == 340
        assert got.filter("twice != IF(g IS NULL OR g < 3, 200, 2)").count() == 0
