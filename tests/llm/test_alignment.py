"""Token alignment against a plain reading of the rules with both libraries."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest

from gradeloom.llm import token_alignment as A

PATHS = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def pair():
    return A.Pair(*PATHS)


def aligned_one(pair, text):
    text = text or ""
    a, b = pair.a_ids(" " + text), pair.b_ids(text)
    whole = (" " + text).encode()
    if not text or b"".join(pair.a_bytes[i] for i in a) != whole or b"".join(pair.b_bytes[i] for i in b) != whole:
        return [], [], [], []
    ends = [dict(zip(np.cumsum([len(t[i]) for i in ids]).tolist(), range(len(ids)))) for ids, t in ((a, pair.a_bytes), (b, pair.b_bytes))]
    groups, links, x, y = [], [], 0, 0
    for e in sorted(ends[0].keys() & ends[1].keys()):
        i, j = ends[0][e] + 1, ends[1][e] + 1
        groups.append(f"{','.join(map(str, a[x:i]))}|{','.join(map(str, b[y:j]))}")
        links.append((a[i - 1], b[j - 1]))
        x, y = i, j
    return a, b, groups, links


def brute(pair, rows):
    every = [aligned_one(pair, t) for _, t in rows]
    counts = Counter(x for *_, links in every for x in links)
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = []
    for (i, _), (a, b, groups, links) in zip(rows, every):
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((-1 if i is None else i, len(a), len(b), len(groups), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), sha))
    return sorted(out)


def found(df):
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted(tuple(-1 if r[c] is None else r[c] for c in columns) for r in A.aligned(df, *PATHS).collect())


def texts():
    rng = random.Random(1)
    marks = [" ", " ", " ", "  ", "\n", "\n\n", "\t", " \n ", " ", "　", ". ", ", ", "'s ", "—", "\x1f", "\x85"]
    words = ["the", "alignment", "Größe", "naïve", "don't", "3.1415", "日本語テキスト", "🙂🙃", "ﬁne", "é", "<|endoftext|>", "</s>", "<0x41>", "ꙮ", "x" * 40, "\x00", "under_score", "Москва"]
    out = ["".join(rng.choice(words) + rng.choice(marks) for _ in range(rng.randrange(1, 60))) for _ in range(120)]
    return [*out, None, "", " ", "  ", "\n", " lead", "trail ", "has ▁ in it", "▁", "a", "same text", "same text", "the the the the"]


def test_equals_brute_force(spark, pair):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "no id"), (3, "another row of three")]
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(3)) == brute(pair, rows)


def test_long_texts_are_composed_from_chunks(spark, pair, monkeypatch):
    monkeypatch.setattr(A, "CHUNK", 37)
    monkeypatch.setattr(A, "FAN", 3)
    rows = [(i, t) for i, t in enumerate(texts())]
    rows += [(1_000, "x" * 900), (1_001, "日本語\nテキスト、" * 90), (1_002, "no▁mark but many words here " * 9), (1_003, "word\n" * 300), (1_004, " " * 200), (1_005, "one two  three " * 60)]
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute(pair, rows)


def test_long_texts_have_one_row_each_where_plans_change_as_they_run(spark, pair):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["the", "quite", "unaligned", "3.14", "Größe"]) + str(rng.randrange(99)) for _ in range(9_000))) for i in range(6)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "256k")
    try:
        assert found(spark.createDataFrame(rows, SCHEMA)) == brute(pair, rows)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_pairs_that_are_too_many_to_broadcast_are_joined(spark, pair, monkeypatch):
    monkeypatch.setattr(A, "BROADCAST_PAIRS", 0)
    monkeypatch.setattr(A, "CHUNK", 200)
    rows = [(i, t) for i, t in enumerate(texts())]
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute(pair, rows)


def test_composition_is_associative(pair):
    rng = random.Random(2)
    text = " ".join(t for t in texts() if t and "▁" not in t)
    tokens = pair.tokens(" " + text, text)
    size = int(tokens.a_end[-1])
    for _ in range(40):
        # chunks of A and of B begin at places of their own
        cuts = [sorted([-1, *rng.sample(range(1, size), 5), size]) for _ in range(2)]
        parts = []
        for k in range(6):
            a, b = tokens.between(cuts[0][k], cuts[0][k + 1]), tokens.between(cuts[1][k], cuts[1][k + 1])
            parts.append(A.fragment(A.Tokens(a.a, a.a_end, b.b, b.b_end), k == 0))
        closed = [g for _, g in parts if g]
        line = [f for f, _ in parts]
        while len(line) > 1:
            i = rng.randrange(len(line) - 1)
            f, g = A.compose(line[i], line[i + 1])
            closed += [g] if g else []
            line[i : i + 2] = [f]
        assert ";".join(g.text for g in sorted(closed, key=lambda g: g.at)) == A.groups_of(tokens, tokens.common()).text
        assert all(len(x) == 0 for x in (*line[0].prefix, *line[0].suffix))


def test_table_equals_brute_force(spark, sf, pair):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    got = found(docs)
    assert got == brute(pair, [tuple(r) for r in docs.collect()]) and max(r[3] for r in got) > 0


def test_odd_rows(spark, odd, nothing, pair):
    assert found(odd) == brute(pair, [tuple(r) for r in odd.select("doc_id", "text").collect()])
    assert A.aligned(nothing, *PATHS).count() == 0
    clash = odd.selectExpr("doc_id", "text", "1 as key", "2 as id", "3 as links", "map('a', 1) as sha", "4 as n_a")
    assert found(clash) == found(odd)
