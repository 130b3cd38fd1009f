"""N-gram join, mixing and sketches against brute force, and the pipeline."""

import random

import pytest
from pyspark.sql import functions as F

from gradeloom.llm import mixing as X
from gradeloom.llm import ngram_join as N
from gradeloom.llm import sketch as S
from gradeloom.llm.components import components


def shingles(text, n=5):
    w = [x for x in text.encode().lower().split()] if text.isascii() else [x for x in text.encode().translate(N._LOWER).split()]
    return {tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, 1))} if w else set()


def brute(texts):
    sets, root = {d: shingles(t) for d, t in texts.items()}, {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in texts}


def family(seed, n_base=12, copies=25):
    rng, out = random.Random(seed), {}
    for _ in range(n_base):
        base = [f"w{rng.randrange(3_000)}" for _ in range(rng.randrange(6, 160))]
        for _ in range(rng.randrange(1, copies)):
            t = list(base)
            for _ in range(rng.choice((0, 1, 1, 2, 3, 5, 8))):
                t[rng.randrange(len(t))] = f"e{rng.randrange(10**6)}"
            if rng.random() < 0.3:
                t = t[: rng.randrange(1, len(t) + 1)]
            if rng.random() < 0.3:
                t += "a common passage of twelve words that many of the documents share".split()
            out[len(out)] = (" ".join(t)).upper() if rng.random() < 0.1 else " ".join(t)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_join_equals_brute_force(spark, seed):
    texts = family(seed)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.ngram_components(df).collect()}
    assert got == brute(texts)


def test_chains_link_beyond_the_hub(spark):
    words = [f"w{i}" for i in range(140)]
    texts = {i: " ".join(words[4 * i : 4 * i + 80]) for i in range(15)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["component_id"] for r in N.ngram_components(df).collect()} == {0} == {c for _, c in brute(texts).values()}


def test_join_equals_sql(spark, sf, same):
    same(N.op7_ngram_join(spark, sf), N.OP7_SQL)


def test_join_of_odd_rows(spark, odd, nothing):
    got = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in N.ngram_components(odd).collect())
    assert got == [(-1, 1, None), (1, 0, 1), (2, 0, 2), (3, 1, 3), (4, 5, 4), (4, 5, 4), (5, 19_996, 5), (6, 1, 6), (7, 1, 7)]
    assert N.ngram_components(nothing).count() == 0


def test_components(spark):
    links = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (9, 8), (None, 1), (7, 7)] + [(i + 1, i) for i in range(100, 140)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(links).collect()}
    assert {got[i] for i in (2, 3, 4, 5)} == {2} and got[9] == 8 and {got[i] for i in range(100, 141)} == {100} and 7 not in got


def test_targets():
    assert X.targets([100, 100, 100], [1, 2, 3]) == [50.0, 100.0, 150.0]
    assert X.targets([10, 10, 980], [3, 3, 1]) == [30.0, 30.0, 940.0]
    assert X.targets([0, 5], [1, 1]) == [0.0, 5.0] and X.targets([], []) == []


def test_shard_quotas_are_exact_and_repeatable():
    q = X.shard_quotas([100, 7, 0, 1], 8, 5)
    assert q.sum(axis=0).tolist() == [100, 7, 0, 1] and (q >= 0).all() and (q == X.shard_quotas([100, 7, 0, 1], 8, 5)).all()
    assert q.sum(axis=1).max() - q.sum(axis=1).min() <= 4


def test_mix(spark):
    rng = random.Random(4)
    rows = [(i, f"s{rng.choice('aaaaaaaabbc')}" if i % 11 else None, " ".join("w" for _ in range(rng.randrange(0, 60)))) for i in range(4_000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    out = X.mixed(df).cache()
    again = sorted((r["doc_id"], r["taken"], str(r["draws"])) for r in X.mixed(df.repartition(3)).collect())
    assert again == sorted((r["doc_id"], r["taken"], str(r["draws"])) for r in out.collect())
    assert out.filter("taken > 3 * size").count() == 0 and out.count() == 4_000
    sums = out.groupBy("source").agg(F.sum("size").alias("size"), F.max("source_size").alias("ss"), F.max("target").alias("target"), F.sum("taken").alias("taken")).collect()
    order = sorted(sums, key=lambda r: (r["source"] is None, r["source"] or ""))
    assert [r["target"] for r in order] == pytest.approx(X.targets([r["size"] for r in order], [1, 2, 3, 1]))
    assert all(r["size"] == r["ss"] and abs(r["taken"] - r["target"]) <= 5 for r in order)
    copies = X.in_shards(out)
    order = [(r["shard"], r["order_key"]) for r in copies.select("shard", "order_key").orderBy("shard", "order_key").collect()]
    assert len({s for s, _ in order}) == 16 and [k for _, k in order[:50]] == sorted(k for _, k in order[:50])
    assert copies.agg(F.sum("size")).first()[0] == sum(r["taken"] for r in sums) and copies.select("doc_id", "pass").distinct().count() == copies.count()


def test_mix_of_odd_rows(spark, odd, nothing):
    out = X.mixed(odd).collect()
    assert len(out) == odd.count() and all(r["taken"] <= 3 * r["size"] for r in out)
    assert X.mixed(nothing).count() == 0


def test_sketches_equal_sql(spark, sf, same):
    same(S.op10_fingerprints(spark, sf), S.OP10_SQL)


def test_sketches_of_odd_rows(spark, odd, nothing):
    out = S.fingerprints(odd).orderBy(F.col("doc_id").asc_nulls_first()).collect()
    assert len(out) == odd.count() and out[1]["fingerprint"] == out[2]["fingerprint"] == ""
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in out)
    twice = [r for r in out if r["doc_id"] == 4]
    assert twice[0]["fingerprint"] == twice[1]["fingerprint"] and twice[0]["near_next"] == 1.0
    assert S.fingerprints(nothing).count() == 0
    alone = S.fingerprints(spark.createDataFrame([(7, "a b c d e f g")], "doc_id long, text string")).first()
    assert alone["near_next"] == 1.0 and alone["n_chars"] == 13


def test_sketches_merge(spark):
    df = spark.createDataFrame([(1, "a b c d e f g h i j k l m n o p q r s t u v w x y z")], "id long, text string")
    df = df.withColumn("one", F.substring("text", 1, 25)).withColumn("two", F.substring("text", 17, 100))
    for c in ("text", "one", "two"):
        df = S.sketch(df, c, f"s_{c}", 2)
    assert df.select((S.merged(F.col("s_one"), F.col("s_two"), 2) == F.col("s_text")).alias("x")).first()["x"]


@pytest.mark.parametrize("rows", [1, 3, 4_000])
def test_next_rows_follow_any_ids(spark, rows):
    rng = random.Random(6)
    ids = [-(2**63), -(2**62) - 5, -5, *range(100), 255, 10_000, 2**62 + 5, 2**63 - 1, *[rng.randrange(-(2**63), 2**63) for _ in range(60)]]
    ids = [None, *sorted(set(ids))]
    frame = spark.createDataFrame([(i, f"t{i}") for i in ids], "id long, t string").repartition(3)
    got = {r["id"]: r["next_t"] for r in S.with_next(frame, "id", ["t"], F.md5("t"), rows).collect()}
    assert got == {i: f"t{j}" for i, j in zip(ids, ids[1:] + ids[:1])}


def test_next_rows_of_repeated_and_null_ids(spark):
    import hashlib

    keys = [None] * 60 + [5] * 80 + list(range(40)) + [2**62]
    rows = [(k, f"r{i}") for i, k in enumerate(keys)]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(r[1].encode()).hexdigest()))
    frame = spark.createDataFrame(rows, "id long, t string").repartition(3)
    out = S.with_next(frame, "id", ["t"], F.md5("t"), 6)
    assert {r["t"]: r["next_t"] for r in out.collect()} == {a[1]: b[1] for a, b in zip(order, order[1:] + order[:1])}
    begins = S._begins(frame, "id", 6)
    place, _ = S._range(F.col("id"), F.md5("t"), begins)
    assert begins.count(5) > 2 and begins.count(None) > 2
    assert frame.groupBy(place).count().agg(F.max("count")).first()[0] <= 40
    far = spark.range(20_000).union(spark.createDataFrame([(2**62,)], "id long"))
    place, told = S._range(F.col("id"), F.lit(""), S._begins(far, "id", 1_000))
    assert far.groupBy(place).count().agg(F.max("count")).first()[0] <= 3_000


def brute_mix(rows, weights=X.WEIGHTS, seed=X.SEED):
    """Taken words by a plain reading of the rules: passes over blocks in hashed order, a cut, a document that fills the rest."""
    import numpy as np

    sources = sorted({r["source"] for r in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(r["w"] for r in rows if r["source"] == s) for s in sources]
    goal = X.targets(sizes, [weights[i % len(weights)] for i in range(len(sources))])
    taken = {}
    for s, size, t in zip(sources, sizes, goal):
        mine = [r for r in rows if r["source"] == s]
        full = int(t / size + 1e-9) if size else 0
        part = max(0.0, t - full * size)
        blocks = {}
        for r in mine:
            blocks.setdefault(r["block"], []).append(r)
        turn = sorted(blocks, key=lambda b: (blocks[b][0]["turn"], b))
        in_part, before, edge = set(), 0, None
        for i, b in enumerate(turn):
            w = sum(r["w"] for r in blocks[b])
            if before >= part:
                break
            if before + w > part:
                edge = i
                break
            in_part |= {r["place"] for r in blocks[b]}
            before += w
        if edge is not None:
            rest, cut = part - before, None
            for r in sorted(blocks[turn[edge]], key=lambda r: r["place"]):
                if r["w"] > rest:
                    break
                rest, cut = rest - r["w"], r["place"]
                in_part.add(r["place"])
            near = [r for b in turn[edge : edge + X.NEAR_BLOCKS + 1] for r in blocks[b] if b != turn[edge] or cut is None or r["place"] > cut]
            near = [(abs(rest - r["w"]), r["place"]) for r in near if abs(rest - r["w"]) < rest]
            if near:
                in_part.add(min(near)[1])
        for r in mine:
            taken[r["doc_id"]] = r["w"] * (full + (r["place"] in in_part))
    assert np.isclose(sum(goal), sum(sizes))
    return taken


def test_mix_equals_brute_force(spark):
    rng = random.Random(9)
    rows = [(i, f"s{rng.choice('aaaaaaaabbcd')}" if i % 13 else None, " ".join("w" for _ in range(rng.choice((0, 1, 5, 5, 40, 300))))) for i in range(1_500)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    table = X._placed(df, "doc_id", "source", "text", X.SEED).withColumn("n_blocks", F.lit(X.LEAST_BLOCKS)).withColumn("block", X._block(F.col("_place")))
    order = {r[0]: i for i, r in enumerate(sorted({(s,) for _, s, _ in rows}, key=lambda s: (s[0] is None, s[0] or "")))}
    number = F.coalesce(*[F.when(F.col("source").eqNullSafe(F.lit(s)), F.lit(i)) for s, i in order.items()]).cast("int")
    sizes = {r["source"]: r["w"] for r in table.groupBy("source").agg(F.sum("_size").alias("w")).collect()}
    goal = X.targets([sizes[s] for s in order], [X.WEIGHTS[i % 3] for i in range(len(order))])
    full = F.coalesce(*[F.when(F.col("source").eqNullSafe(F.lit(s)), F.lit(int(t / sizes[s] + 1e-9))) for (s, t) in zip(order, goal)]).cast("int")
    table = table.withColumn("turn", F.shiftrightunsigned(F.xxhash64(number, F.col("block"), full, F.lit(X.SEED + 1)), 1))
    plain = [dict(doc_id=r["doc_id"], source=r["source"], w=r["_size"], block=r["block"], turn=r["turn"], place=(r["_place"]["h"], r["_place"]["k"])) for r in table.collect()]
    assert {r["doc_id"]: r["taken"] for r in X.mixed(df).collect()} == brute_mix(plain)


def test_pipeline(spark, sf):
    import corpus_pipeline as P

    docs, kept = spark.read.parquet(f"{sf}/documents.parquet"), None
    for k, (_, stage) in enumerate(P.STAGES[:-1]):
        after = stage(spark, docs, sf).cache()
        assert after.columns == docs.columns and after.count() > 0
        if k < 3:
            assert after.count() <= docs.count() and after.select("doc_id").distinct().count() == after.count()
        docs, kept = after, after.count()
    assert P.run(spark, sf).count() == kept and P.ORACLE_SQL is None


HELPERS = "_score _severity _grade _row _whole _size _source _place _kept _s_s _b_s _mine pass shard order_key size source_size target draws taken row n_tokens c0 id k".split()


def test_stages_leave_columns_of_any_name_alone(spark):
    """Columns named like the operators' own, one with a map: each stage keeps the values of the rows that it keeps."""
    import corpus_pipeline as P

    sf = "/root/testdata/sf0.001"
    plain = spark.read.parquet(f"{sf}/documents.parquet")
    docs = plain.select("*", *[F.concat(F.lit(c), F.col("doc_id")).alias(c) for c in HELPERS], F.create_map(F.lit("id"), F.col("doc_id")).alias("a map"))
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        wrong = out.filter(" or ".join([f"`{c}` <> concat('{c}', doc_id)" for c in HELPERS] + ["`a map`['id'] <> doc_id"]))
        assert out.count() > 0 and wrong.count() == 0
        assert sorted(r["doc_id"] for r in out.select("doc_id").collect()) == sorted(r["doc_id"] for r in stage(spark, plain, sf).select("doc_id").collect())
        assert stage(spark, docs.limit(0), sf).count() == 0
    assert P.STAGES[-1][1](spark, docs, sf).count() == docs.count()


def test_near_duplicates_keep_one_row_of_each_group(spark):
    texts = family(3, n_base=5, copies=8)
    want = {c for d, (n, c) in brute(texts).items()}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"] for r in N.one_of_each_component(df).collect()} == want
    long = " ".join(f"w{i}" for i in range(40))
    other = " ".join(f"v{i}" for i in range(40))
    rows = [(None, long, 1), (None, other, 2), (None, long + " end", 3), (7, other + " end", 4), (7, "quite another text of seven words", 5), (7, "quite another text of seven words", 5), (None, None, 6), (None, None, 6), (8, "", 7), (9, " \t", 8)]
    out = N.one_of_each_component(spark.createDataFrame(rows, "doc_id long, text string, n_shingles int"))
    assert sorted(r["n_shingles"] for r in out.collect()) in ([1, 4, 5, 6, 6, 7, 8], [3, 4, 5, 6, 6, 7, 8]) and out.columns == ["doc_id", "text", "n_shingles"]


def test_pipeline_judges_rows_and_not_ids(spark):
    import corpus_pipeline as P

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for stage in (P.drop_toxic, P.drop_poor):
        kept = stage(spark, docs, sf)
        good = [r["text"] for r in kept.orderBy("doc_id").limit(2).collect()]
        bad = docs.join(kept, "doc_id", "left_anti").filter("length(text) > 200").first()["text"]
        rows = [(i, t, "en", "s", len(t)) for t in (*good, bad, bad) for i in (None, 10**12)]
        mine = stage(spark, docs.union(spark.createDataFrame(rows, docs.schema)), sf).filter(f"doc_id is null or doc_id = {10**12}")
        assert sorted((r["doc_id"] or 0, r["text"]) for r in mine.collect()) == sorted((i, t) for i in (0, 10**12) for t in good)
