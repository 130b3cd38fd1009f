"""Near duplicates by MinHash and Bayesian verification, against brute force."""

import random

import numpy as np
import pytest

from gradeloom.llm import minhash_dedup as M


def shingles(text, n=5):
    w = text.encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split()
    return {tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, 1))} if w else set()


def brute(texts):
    sets, root = {d: shingles(t) for d, t in texts.items()}, {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sorted(texts):
        for b in sorted(texts):
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d), d == find(d)) for d in texts}


def family(seed, n_base=10, copies=30, edits=(0, 1, 1, 2, 3, 4, 6)):
    rng, out = random.Random(seed), {}
    for _ in range(n_base):
        base = [f"w{rng.randrange(3_000)}" for _ in range(rng.randrange(6, 200))]
        for _ in range(rng.randrange(1, copies)):
            t = list(base)
            for _ in range(rng.choice(edits)):
                t[rng.randrange(len(t))] = f"e{rng.randrange(10**6)}"
            if rng.random() < 0.3:
                t += "a common passage of twelve words that many of the documents share".split()
            out[len(out)] = (" ".join(t)).upper() if rng.random() < 0.1 else " ".join(t)
    return out


def found(df, **kw):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in M.near_duplicates(df, **kw).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    texts = family(seed)
    assert found(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)) == brute(texts)


@pytest.mark.parametrize("tile", [7, 256])
def test_buckets_of_many_components(spark, monkeypatch, tile):
    """Copies of one text, edited so much that few link with the hub, and edits that some share: open pairs after the hub's."""
    monkeypatch.setattr(M, "TILE", tile)
    texts = family(5, n_base=2, copies=120, edits=(2, 3, 4, 5, 6, 8))
    base, rng = [f"b{i}" for i in range(150)], random.Random(9)
    for twin in range(20):
        t = list(base)
        for i in rng.sample(range(150), 9):
            t[i] = f"shared{twin}x{i}"
        for own in range(3):
            texts[len(texts)] = " ".join([*t, f"own{twin}y{own}"])
    assert found(spark.createDataFrame(list(texts.items()), "doc_id long, text string")) == brute(texts)


def test_chains_link_beyond_the_hub(spark):
    words = [f"w{i}" for i in range(200)]
    texts = {i: " ".join(words[4 * i : 4 * i + 110]) for i in range(20)}
    assert {c for _, c, _ in found(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).values()} == {c for _, c, _ in brute(texts).values()} == {0}


def test_equals_sql(spark, sf, same):
    same(M.op12_minhash_dedup(spark, sf), M.OP12_SQL)


def test_odd_rows(spark, odd, nothing):
    got = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"], r["kept"]) for r in M.near_duplicates(odd).collect())
    assert got == [(-1, 1, None, True), (1, 0, 1, True), (2, 0, 2, True), (3, 1, 3, True), (4, 5, 4, True), (4, 5, 4, True), (5, 19_996, 5, True), (6, 1, 6, True), (7, 1, 7, True)]
    assert M.near_duplicates(nothing).count() == 0
    clash = odd.selectExpr("doc_id", "text", "1 as k", "2 as n", "3 as sig", "4 as bucket", "map('a', 1) as root")
    assert M.near_duplicates(clash).count() == odd.count()


def test_null_ids_and_one_text_many_times(spark):
    rows = [(None, "a b c d e f g"), (9, "a b c d e f g"), (3, "A B C D E F G"), (3, "a b c d e f g"), (5, "z")]
    got = sorted((r["doc_id"] or -1, r["component_id"], r["kept"]) for r in M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(-1, 3, False), (3, 3, True), (3, 3, True), (5, 5, True), (9, 3, False)]


def test_bands_and_looks_keep_the_chosen_miss():
    from math import comb

    b = M.bands_for(0.85)
    assert (1 - 0.85**6) ** b <= 1e-6 < (1 - 0.85**6) ** (b - 1)
    for n, m in M.least_matches(0.85, 180):
        assert sum(comb(n + 1, i) * 0.85**i * 0.15 ** (n + 1 - i) for i in range(m)) < 1e-6


def test_equal_values_estimate_similarity():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2**63, 3_000, dtype=np.uint64)
    y = np.r_[x[:2_400], rng.integers(0, 2**63, 600, dtype=np.uint64)]
    s = M.signatures([np.unique(x), np.unique(y), np.unique(x)], 600)
    assert (s[0] == s[2]).all() and abs((s[0] == s[1]).mean() - 2 / 3) < 0.08
