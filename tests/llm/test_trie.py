"""The conversation trie against brute force and SQL."""

import hashlib
import random
import re
import zlib

import pytest

from gradeloom.llm import conversation_trie as C

SCHEMA = "conv_id long, turn long, role string, text string"


def md5(role, text):
    return hashlib.md5(f"{len(role)} {role}{text}".encode()).hexdigest()


def brute(rows, family=C.FAMILY):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, md5(role or "", text or ""), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in convs.items()}
    seqs = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4 if family else 0
        seqs[c] = own.get(c - c % family, [])[:h] + own[c][h:] if family else own[c]
    nodes, ends = {}, {}
    for c, s in seqs.items():
        ends.setdefault(tuple(s), []).append(c)
        for d in range(len(s) + 1):
            nodes.setdefault(tuple(s[:d]), []).append(c)
    children, saved, leaves = {}, {}, {}
    for p, m in nodes.items():
        children[p[:-1]] = children.get(p[:-1], 0) + (len(p) > 0)
    for p, m in nodes.items():
        gain = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] = saved.get(p[:d], 0) + gain
            leaves[p[:d]] = leaves.get(p[:d], 0) + (not children.get(p))
    return sorted((min(m), len(p), min(nodes[p[:-1]]) if p else -1, len(m), children.get(p, 0), leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()) for p, m in nodes.items())


def found(df, family=C.FAMILY):
    out = C.prefix_trie(df, family=family).collect()
    return sorted((r["conv_id"], r["depth"], -1 if r["parent_conv_id"] is None else r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in out)


def sample(seed, n=300):
    rng, rows = random.Random(seed), []
    for c in rng.sample(range(2 * n), n):
        for t in range(rng.randrange(1, 7)):
            text = rng.choice(["hello there", "a b c", "", None, f"own words of {c}"]) if rng.random() < 0.9 else "x " * rng.randrange(9)
            rows.append((c, rng.choice([t, t, t, None, 3]), rng.choice(["user", "user", None]), text))
    return rows


@pytest.mark.parametrize("family", [C.FAMILY, None])
def test_equals_brute_force(spark, family):
    rows = sample(1)
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(3), family) == brute(rows, family)


def test_many_levels_of_shards_and_spilled_queues(spark, monkeypatch):
    rows = sample(2, 400) + [(c, t, "user", f"t{t}") for c in range(1_000, 1_200) for t in range(c % 9)]
    want, df = brute(rows), spark.createDataFrame(rows, SCHEMA)
    for light, fan, held in ((2, 3, 2), (10, 8, 5)):
        for name, value in (("LIGHT", light), ("FAN", fan), ("HELD", held), ("IDS", 16)):
            monkeypatch.setattr(C, name, value)
        assert found(df) == want


def test_long_conversations_are_numbered_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 16)
    rng = random.Random(3)
    rows = [(c, t if rng.random() < 0.95 else None, "user", f"line {t if c < 3 else rng.randrange(9)}") for c in range(6) for t in range(-20, rng.randrange(100, 180))]
    assert found(spark.createDataFrame(rows, SCHEMA), None) == brute(rows, None)


def test_equals_sql(spark, sf, same):
    same(C.op11_conversation_trie(spark, sf), C.OP11_SQL)


def test_odd_rows(spark):
    assert C.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, 1, "user", "lost"), (7, None, None, None), (7, None, None, None), (7, 1, "user", "x " * 60_000), (8, 0, "", ""), (27, 5, "user", "only")]
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
    clash = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as conv", "2 as depth", "3 as words", "map('a', 1) as block", "4 as digest")
    assert found(clash) == brute(rows)


def test_queue_spills_and_keeps_order():
    rng = random.Random(4)
    queue, want, got = C.SpillingQueue(10), [], []
    for i in range(2_000):
        item = (rng.randrange(-50, 50), rng.randrange(3), i)
        queue.push(item)
        want.append(item)
        if i % 7 == 6:
            least = min(want)
            assert queue.least() == least and queue.pop() == least
            want.remove(least)
    while queue.least():
        got.append(queue.pop())
    assert got == sorted(want) and queue.spilled > 20
