from __future__ import annotations

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
import xxhash

from credlens.llm import periodic, simhash, vantage, whitening
from credlens.llm.queries import QUERIES

DOCS = "doc_id long, text string, runs string, fingerprint string, component_id string, words string"


def docs_of(spark, rows):
    return spark.createDataFrame([(*row, *["clash"] * 4) for row in rows], DOCS)


def plain_runs(w, shortest, times):
    """start, length, smallest period, by trying each period."""
    found = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(shortest, times * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


@pytest.mark.parametrize("shortest, times", [(24, 3), (6, 2), (10, 4)])
def test_runs_equal_trying_all_periods(spark, shortest, times):
    rng = random.Random(shortest)
    texts = ["", " \t", None, "one", "a " * 23, "a " * 24, "a b " * 5000, "x " * 30 + "y " * 30, " ".join(f"w{i}" for i in range(40)) * 3]
    for _ in range(300):
        w = []
        while len(w) < rng.choice([5, 40, 150]):
            w += [rng.choice("abcdefgh"[: rng.randint(1, 8)]) for _ in range(rng.randint(1, 15))] * rng.choice([1, 1, 2, 3, 4, 9])
        texts.append(rng.choice([" ", "\n", " \t "]).join(w))
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[6]), (7, texts[5]), (7, texts[5])]
    found = periodic.find_runs(docs_of(spark, rows), shortest, times).collect()
    assert len(found) == len(rows)
    want = []
    for i, t in rows:
        w = (t or "").split()
        runs = plain_runs(w, shortest, times)
        want.append((i if i is not None else -1, len(w), runs, collapsed(w, runs)))
    got = [(r["doc_id"] if r["doc_id"] is not None else -1, r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in found]
    assert sorted(got) == sorted(want)
    assert periodic.find_runs(docs_of(spark, rows).limit(0)).count() == 0


def test_words_outside_repeated_grams_are_masked():
    assert periodic.overlap(24, 3) == 16
    w = [*range(100), *[7, 8, 9] * 10, *range(200, 300)]
    covered = periodic.repeated(np.array(w), np.array([0, len(w)]), 16)
    assert np.flatnonzero(covered).tolist() == list(range(100, 130))
    lefts, rights = periodic.segments(np.array([True] * 60), np.array([0, 30, 60]), 24)
    assert lefts.tolist() == [0, 30] and rights.tolist() == [30, 60]  # runs don't cross documents


def test_thue_morse_words_are_no_runs():
    w = np.array([bin(i).count("1") % 2 for i in range(4096)])
    assert not len(periodic.main_lorentz(w, np.array([0]), np.array([len(w)]), 24, 3))


def test_op13_equals_the_plain_definition(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    want = {}
    for d in docs:
        w = [x.decode() for x in (d["text"] or "").encode().split()]
        h, n = zlib.crc32(str(d["doc_id"]).encode()), len(w)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
        runs = plain_runs(w, 24, 3)
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        want[d["doc_id"]] = (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(lines), sha(collapsed(w, runs)))
    found = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op13_periodic"](spark, small).collect()}
    assert found == want and any(v[0] for v in want.values())


def near(x, r):
    d = np.bitwise_count(x[:, None] ^ x[None, :]) <= r
    return set(zip(*(p.tolist() for p in np.nonzero(np.triu(d, 1))), strict=True))


@pytest.mark.parametrize("seed", range(6))
def test_vantage_trees_lose_no_pair(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, rng.integers(1, 20), dtype=np.uint64)
    x = base[rng.integers(0, len(base), 900)]
    for _ in range(seed):
        x = x ^ (np.uint64(1) << rng.integers(0, 64, len(x)).astype(np.uint64))
    x = np.unique(x)
    tree = vantage.Tree()
    tree.split(0, x[vantage.spread(len(x), 300)], 20, 3)
    if tree.leaves > 1:
        tree.split(1, x, 10, 3)
    found, forest, plain, at_home = [], vantage.Forest(len(x)), vantage.Forest(len(x)), 0
    for _, home, ask in tree.route(x, 3):
        at = np.concatenate([home, ask])
        at_home += len(home)
        for a, b in vantage.pairs(x[at], len(home), 3):
            found += map(tuple, map(sorted, zip(at[a].tolist(), at[b].tolist(), strict=True)))
        a, b = vantage.links(x[at], len(home), 3)
        forest.join(at[a], at[b])
    assert at_home == len(x) and len(found) == len(set(found)) and set(found) == near(x, 3)
    for a, b in found:
        plain.join(np.array([a]), np.array([b]))
    assert np.array_equal(forest.roots(np.arange(len(x))), plain.roots(np.arange(len(x))))


def plain_print(text, words=3):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    """Smallest id that is reachable, for each row of id and fingerprint."""
    at = [p for _, p in rows]
    group = list(range(len(rows)))
    for i, p in enumerate(at):
        for j in range(i):
            if (p ^ at[j]).bit_count() <= 3 and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {}
    for (i, _), g in zip(rows, group, strict=True):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    return [least.get(g) for g in group]


def test_near_duplicates_odd_rows(spark):
    long = " ".join(f"w{i % 700}" for i in range(30_000))
    rows = [(5, None), (4, ""), (6, " \n"), (7, "One two"), (8, "one  TWO"), (9, "a b c d"), (1, long), (2, long + " end"), (None, long), (None, "alone here now"), (3, "É é"), (11, "é é")]
    rows += [(20, "same text of words"), (20, "same text of words"), (20, "another text by the same id")]
    found = simhash.near_duplicates(docs_of(spark, rows)).collect()
    want = [(i, plain_print(t)) for i, t in rows]
    want = sorted((-1 if i is None else i, p, -1 if c is None else c) for (i, p), c in zip(want, plain_components(want), strict=True))
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["fingerprint"] % (1 << 64), -1 if r["component_id"] is None else r["component_id"]) for r in found) == want
    assert simhash.near_duplicates(docs_of(spark, rows).limit(0)).count() == 0


def test_op12_equals_all_pairs(spark, small):
    docs = [(r["doc_id"], plain_print(r["text"])) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    want = {i: (f"{p:016x}", c) for (i, p), c in zip(docs, plain_components(docs), strict=True)}
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op12_simhash"](spark, small).collect()}
    assert found == want
    pairs = simhash.near_pairs(spark.read.parquet(f"{small}/documents.parquet"), shard=64).collect()
    prints = np.unique(np.array([p for _, p in docs], np.uint64))
    got = {tuple(sorted((r["a"] % (1 << 64), r["b"] % (1 << 64)))) for r in pairs}
    assert len(pairs) == len(got) and got == {(int(prints[a]), int(prints[b])) for a, b in near(prints, 3)}


def test_shards_that_turn_out_large_are_split_again(spark):
    rows = spark.range(6000).selectExpr("xxhash64(id) as fingerprint")
    tree = simhash.grow_tree(rows, 3, shard=100)
    sizes = [r["count"] for r in simhash._places(rows, tree, None).groupBy("shard").count().collect()]
    assert sum(sizes) == 6000 and tree.leaves >= 30 and max(sizes) <= 600


def test_lanczos_equals_a_dense_solver():
    rng = np.random.default_rng(5)
    for wide, rank in ((5, 5), (40, 40), (300, 300), (300, 9)):
        a = rng.standard_normal((rank, wide)) * np.linspace(1, 9, rank)[:, None]
        a = a.T @ a
        values, vectors = whitening.lanczos(lambda v, a=a: a @ v, wide, 16, block=8, held=64)
        true = np.linalg.eigh(a)[0][::-1][:16]
        assert np.allclose(values, true, rtol=1e-10, atol=1e-10 * true[0])
        assert np.abs(a @ vectors - vectors * values).max() < 1e-10 * true[0]
        assert np.abs(vectors.T @ vectors - np.eye(vectors.shape[1])).max() < 1e-10


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, 1, "clash") for i, v in rows], "vec_id long, embedding array<double>, n int, x string")


def check_whitening(rows, found):
    """rows: id and whole numbers. Against exact whole numbers and a dense solver."""
    fit = sorted({tuple(x) for _, x in rows})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[j] for x in fit) for j in range(d)]
    centred = np.array([[(n * a - s) / n for a, s in zip(x, sums, strict=True)] for x in fit])
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(16, int((values > 1e-12 * values[0]).sum()))
    assert len(found) == len(rows) * k
    by = {(r["vec_id"], r["component"]): r for r in found}
    signs = {}
    for i, x in rows:
        c = np.array([(n * a - s) / n for a, s in zip(x, sums, strict=True)])
        for j in range(k):
            r = by[i, j + 1]
            deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
            assert r["n"] == n and r["deviation"] == (deviation if deviation < 1 << 63 else None)
            assert abs(r["explained"] - values[j] / np.trace(cov)) <= 1e-9 * r["explained"] and r["identity_error"] <= 1e-7
            w = c @ vectors[:, j] / np.sqrt(values[j])
            if abs(w) > 1e-3:
                signs.setdefault(j, set()).add(np.sign(w * r["whitened"]))
            assert abs(abs(w) - abs(r["whitened"])) < 1e-6
    assert all(len(s) == 1 for s in signs.values())


def test_op11_equals_a_dense_solver(spark, small):
    vectors = spark.read.parquet(f"{small}/embeddings.parquet").collect()
    rows = [(r["vec_id"], [int(np.floor(64 * float(c))) + 1_000_000 for c in r["embedding"]]) for r in vectors]
    check_whitening(rows, QUERIES["op11_whitening"](spark, small).collect())


def test_whitening_small_eigenvalues(spark):
    """Down to 10^-11 of the largest, each is right by itself, not only beside the largest."""
    r = np.random.default_rng(4)
    vectors = [(i, [float(v) for v in r.integers(-64, 65, 3) * (2e4, 5.0, 0.125)]) for i in range(40)]
    rows = [(i, [int(np.floor(64 * c)) + 1_000_000 for c in v]) for i, v in vectors]
    check_whitening(rows, whitening.whiten(vectors_of(spark, vectors)).collect())


def test_whitening_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    good = [(1, [0.5, 1.0, -2.0]), (2, [0.5, 1.0, -2.0]), (3, [3.0, 0.25, 7.0]), (4, [1e4, -3.0, 0.0]), (5, [2.0, 2.0, 2.0]), (6, [0.1, -0.1])]
    bad = [(7, None), (8, [1.0, None, 2.0]), (9, [nan, 0.0, 0.0]), (10, [inf, 0.0, 0.0]), (11, [1e300, 0.0, 0.0])]
    rows = [(i, [int(np.floor(64 * c)) + 1_000_000 for c in v] + [1_000_000] * (3 - len(v))) for i, v in good]
    check_whitening(rows, whitening.whiten(vectors_of(spark, good + bad)).collect())
    twice = whitening.whiten(vectors_of(spark, [*good, (None, [2.0, 2.0, 2.0]), (5, [2.0, 2.0, 2.0])])).collect()
    assert len(twice) == 8 * 3 and sum(r["vec_id"] is None for r in twice) == 3
    far = whitening.whiten(vectors_of(spark, [(1, [1e9]), (2, [0.0]), (3, [5.0])])).collect()
    assert [r["deviation"] for r in far] == [None] * 3 and abs(far[0]["whitened"]) == pytest.approx(2**0.5, rel=1e-6)
    for none in ([], bad, [(1, [1.0, 2.0])], [(1, [1.0]), (2, [1.0])], [(1, []), (2, [])]):
        assert whitening.whiten(vectors_of(spark, none)).count() == 0


def test_deviations_beyond_64_bits_are_exact():
    x = np.array([[1 << 53, 5]])
    d = whitening.deviations(x, 1 << 40, [7, 9])
    assert d.tolist() == [[(1 << 93) - 7, (5 << 40) - 9]] and whitening.squares(d).tolist() == [((1 << 93) - 7) ** 2 + ((5 << 40) - 9) ** 2]
