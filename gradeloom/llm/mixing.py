"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source's documents are dealt by hash into blocks of a bounded number of documents. A source whose target is r times its size is
mixed in floor(r) whole passes over its blocks and one part of a pass, each pass in a hashed permutation of its own; so a source has an exact quota of block
draws. The part ends inside a block, which is cut at a document, and one document of the next blocks fills up what is left.

How much of each source's quota goes to each output shard is drawn by a tree: the quotas of a node are split between its halves by a multivariate hypergeometric
draw, down to the shards. Each shard takes its share of a source's permuted blocks in turn, disjoint from all others', and a block that no shard reaches is not
in the mix. Inside a shard the documents of its blocks are shuffled by hash. All draws depend on the seed alone, so reruns agree.

The driver sees one row for each source, never documents or blocks.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradeloom.llm._common import hinted_small, read, shared_checkpoint

WEIGHTS = (1, 2, 3)
MOST_TIMES = 3
SEED = 20_240_601
#: Documents that a block has on average at most; blocks that a source has at least.
BLOCK_DOCS, LEAST_BLOCKS = 10_000, 64
#: Blocks after the last one in which the document that best fits the rest is looked for.
NEAR_BLOCKS = 63
#: Output shards are a power of two; one for about so many documents of the input, and so many at least.
SHARD_DOCS, LEAST_SHARDS = 100_000, 16
#: Sources are a dimension, collected as a row each; more than this is an error. Blocks up to the second figure are broadcast.
MOST_SOURCES, BROADCAST_BLOCKS = 100_000, 500_000
#: Runs of a permutation that are ranked by themselves, so that one source's blocks are not all ranked in one task.
RUNS = 256
#: Tasks over which a shard's documents are dealt.
SHARD_TASKS = 8

SPACE = "\t\n\x0b\x0c\r"
_DRAWS = "array<struct<pass:int,shard:int,order:bigint>>"


def word_count(text: Column) -> Column:
    """The number of words between ASCII white space; 0 for null."""
    flat = F.split(F.translate(F.coalesce(text, F.lit("")), SPACE, " " * len(SPACE)), " ")
    return F.size(F.array_remove(flat, "")).cast("long")


def targets(sizes: list[int], weights: list[int], most: float = MOST_TIMES) -> list[float]:
    """Share the sum of sizes by weight; what exceeds ``most`` times a size is shared again among the others."""
    out, open_ = [0.0] * len(sizes), list(range(len(sizes)))
    rest = float(sum(sizes))
    while open_:
        unit = rest / sum(weights[i] for i in open_)
        over = [i for i in open_ if unit * weights[i] > most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = unit * weights[i]
            break
        for i in over:
            out[i] = float(most * sizes[i])
            rest -= out[i]
        capped = set(over)
        open_ = [i for i in open_ if i not in capped]
    return out


def shard_quotas(quotas: list[int], shards: int, seed: int) -> np.ndarray:
    """Split exact quotas of each source among ``shards`` (a power of two): an array of shards by sources."""

    def split(q: np.ndarray, n: int, node: int) -> list[np.ndarray]:
        if n == 1:
            return [q]
        rng = np.random.default_rng([seed, node])
        total = int(q.sum())
        left = rng.multivariate_hypergeometric(q, total // 2 + (total % 2) * int(rng.integers(2)), method="marginals") if total else q.copy()
        return split(left, n // 2, 2 * node) + split(q - left, n // 2, 2 * node + 1)

    return np.array(split(np.array(quotas, dtype=np.int64), shards, 1))


class Plan(NamedTuple):
    sources: DataFrame  # source, s, n_blocks, source_size, target, full, cut, extra, extra_shard
    blocks: DataFrame  # s, block, draws (pass, shard, cut: only up to the source's cut)
    n_sources: int
    n_blocks: int


def _placed(docs: DataFrame, id_col: str, source_col: str, text_col: str, seed: int) -> DataFrame:
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))
    return docs.withColumns({"_size": word_count(F.col(text_col).cast("string")), "_source": F.col(source_col).cast("string"), "_place": F.struct(F.xxhash64(key, F.lit(seed)).alias("h"), key.alias("k"))})


def _block(place: Column, n_blocks: str = "n_blocks") -> Column:
    return F.pmod(F.shiftright(place["h"], 8), F.col(n_blocks)).cast("long")


def _in_turn(blocks: DataFrame, seed: int) -> DataFrame:
    """Add ``rank`` (from 0) and ``before`` (the words of earlier blocks) of each source's blocks in the hashed permutation of each ``pass``.

    Runs of a permutation are ranked by themselves and begin where those before them end.
    """
    runs = Window.partitionBy("s", "pass", "run")
    blocks = blocks.withColumn("turn", F.shiftrightunsigned(F.xxhash64("s", "block", "pass", F.lit(seed + 1)), 1))
    blocks = blocks.withColumn("run", F.shiftright("turn", 63 - (RUNS - 1).bit_length()).cast("int"))
    each = blocks.groupBy("s", "pass", "run").agg(F.count("*").alias("n"), F.sum("w").alias("rw"))
    earlier = Window.partitionBy("s", "pass").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)  # RUNS rows at most
    each = each.select("s", "pass", "run", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"), F.coalesce(F.sum("rw").over(earlier), F.lit(0)).alias("w0"))
    order = runs.orderBy("turn", "block")
    blocks = blocks.withColumn("i", F.row_number().over(order) - 1).withColumn("iw", F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("w"))
    return blocks.join(each, ["s", "pass", "run"]).select("s", "block", "pass", "w", (F.col("n0") + F.col("i")).alias("rank"), (F.col("w0") + F.col("iw")).alias("before"))


def plan_mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = WEIGHTS, most_times: float = MOST_TIMES, seed: int = SEED) -> Plan:
    """Decide which blocks the mix takes, how often, and into which shards."""
    spark = docs.sparkSession
    slim = shared_checkpoint(_placed(docs, id_col, source_col, text_col, seed).select("_source", "_size", "_place"))
    rows = slim.groupBy("_source").agg(F.sum("_size").alias("size"), F.count("*").alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    rows.sort(key=lambda r: (r["_source"] is None, r["_source"] or ""))
    goal = targets([r["size"] for r in rows], [weights[i % len(weights)] for i in range(len(rows))], most_times)
    table = []
    for s, (r, t) in enumerate(zip(rows, goal)):
        full = int((t / r["size"] if r["size"] else 0.0) + 1e-9)
        table.append((r["_source"], s, max(LEAST_BLOCKS, -(-r["n"] // BLOCK_DOCS)), r["size"], t, full, max(0.0, t - full * r["size"])))
    sources = spark.createDataFrame(table, "source string, s int, n_blocks long, source_size long, target double, full int, part double")
    n_blocks = sum(x[2] for x in table)
    parts = hinted_small(sources.select("s", "full", "part"), len(rows), MOST_SOURCES)

    placed = slim.join(F.broadcast(sources), F.col("_source").eqNullSafe(F.col("source")))
    blocks = placed.withColumn("block", _block(F.col("_place"))).groupBy("s", "block", "full").agg(F.sum("_size").alias("w"))
    blocks = _in_turn(blocks.withColumn("pass", F.explode(F.sequence(F.lit(0), "full"))), seed)
    blocks = shared_checkpoint(blocks.join(parts, "s"))

    # in the part of a pass: the block in which it ends, and those after it, in which the document that fits the rest best is looked for
    last = blocks.filter("pass = full")
    edges = last.filter((F.col("before") < F.col("part")) & (F.col("before") + F.col("w") > F.col("part"))).select("s", F.col("rank").alias("edge"), (F.col("part") - F.col("before")).alias("rest"))
    edges = hinted_small(edges, len(rows), MOST_SOURCES)
    near = last.join(edges, "s").filter(F.col("rank").between(F.col("edge"), F.col("edge") + NEAR_BLOCKS)).select("s", "block", "rest", (F.col("rank") == F.col("edge")).alias("at_edge"))
    inside = placed.select("s", _block(F.col("_place")).alias("block"), "_place", "_size").join(hinted_small(near, (NEAR_BLOCKS + 1) * len(rows), BROADCAST_BLOCKS), ["s", "block"])
    along = Window.partitionBy("s").orderBy("_place").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # the documents of one block
    cuts = inside.filter("at_edge").withColumn("upto", F.sum("_size").over(along)).filter(F.col("upto") <= F.col("rest")).groupBy("s").agg(F.max("_place").alias("cut"), F.max("upto").alias("upto"))
    cuts = shared_checkpoint(edges.join(cuts, "s", "left").select("s", "edge", "cut", (F.col("rest") - F.coalesce("upto", F.lit(0))).alias("left")))
    beyond = inside.join(hinted_small(cuts.drop("edge"), len(rows), MOST_SOURCES), "s").filter(~F.col("at_edge") | F.col("cut").isNull() | (F.col("_place") > F.col("cut")))
    beyond = beyond.withColumn("miss", F.abs(F.col("left") - F.col("_size"))).filter(F.col("miss") < F.col("left"))
    extra = beyond.groupBy("s").agg(F.min(F.struct("miss", F.col("_place").alias("place"))).alias("e")).select("s", F.col("e.place").alias("extra"))

    # a source's quota: the draws of whole passes, and those of the part up to where it ends
    drawn = (F.col("pass") < F.col("full")) | (F.col("before") < F.col("part"))
    quotas = {r["s"]: (r["n"], r["each"]) for r in blocks.groupBy("s").agg(F.count_if(drawn).alias("n"), F.count_if(F.col("pass") == 0).alias("each")).collect()}
    docs_in = sum(r["n"] for r in rows)
    shards = max(LEAST_SHARDS, 1 << (max(1, docs_in // SHARD_DOCS) - 1).bit_length())
    split = shard_quotas([quotas.get(s, (0, 0))[0] for s in range(len(rows))], shards, seed)
    bounds = np.cumsum(split, axis=0).T if rows else np.zeros((0, shards), int)
    limits = spark.createDataFrame([(s, quotas.get(s, (0, 0))[1], list(map(int, b))) for s, b in enumerate(bounds)], "s int, each long, bounds array<long>")
    limits = hinted_small(limits, len(rows), MOST_SOURCES)

    # the draws of a source stand in a row, pass by pass; each shard takes the next ones, as many as its share of the quota
    shard = F.size(F.filter("bounds", lambda b: b <= F.col("pass") * F.col("each") + F.col("rank"))).cast("int")
    dealt = blocks.join(limits, "s").withColumn("shard", shard).filter(F.col("shard") < shards).join(edges.select("s", "edge"), "s", "left")
    cut = F.coalesce((F.col("pass") == F.col("full")) & (F.col("rank") == F.col("edge")), F.lit(False)).alias("cut")
    taken = dealt.groupBy("s", "block").agg(F.array_sort(F.collect_list(F.struct("pass", "shard", cut))).alias("draws"))  # MOST_TIMES + 1 entries at most
    at_edge = dealt.filter((F.col("pass") == F.col("full")) & (F.col("rank") == F.col("edge"))).select("s", F.col("shard").alias("extra_shard"))
    ends = shared_checkpoint(cuts.select("s", "cut").join(extra, "s", "left").join(at_edge, "s", "left"))
    return Plan(sources.join(ends, "s", "left"), shared_checkpoint(taken), len(rows), n_blocks)


def mixed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = WEIGHTS, most_times: float = MOST_TIMES, seed: int = SEED) -> DataFrame:
    """Add to every document what the mix takes of it.

    Adds ``size`` (words), ``source_size``, ``target`` (of its source, in words), ``draws`` (an array of the pass, the output shard and the place in the shard's order of each
    copy that the mix takes; empty if none) and ``taken`` (words, repeats counted). Sources weigh ``weights`` in turn, by
    code point, null last. Null texts have size 0; null ids are one key; rows with equal ids are cut off together. Input columns with one of the
    added names are replaced. An empty table gives an empty result.
    """
    plan = plan_mix(docs, id_col, source_col, text_col, weights, most_times, seed)
    kept = [c for c in docs.columns if c not in {"size", "source_size", "target", "draws", "taken"}]
    # the input's columns stay together, whatever their names
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_kept"))
    placed = _placed(own, f"_kept.`{id_col}`", f"_kept.`{source_col}`", f"_kept.`{text_col}`", seed)
    table = plan.sources.select(*[F.col(c).alias(f"_s_{c}") for c in plan.sources.columns])
    out = placed.join(hinted_small(table, plan.n_sources, MOST_SOURCES), F.col("_source").eqNullSafe(F.col("_s_source")))
    blocks = plan.blocks.select(F.col("s").alias("_b_s"), F.col("block").alias("_b_block"), F.col("draws").alias("_draws"))
    out = out.join(hinted_small(blocks, plan.n_blocks, BROADCAST_BLOCKS), (F.col("_b_s") == F.col("_s_s")) & (F.col("_b_block") == _block(F.col("_place"), "_s_n_blocks")), "left")
    order = lambda n: F.xxhash64(F.col("_place"), n, F.lit(seed + 3))
    upto = F.coalesce(F.col("_place") <= F.col("_s_cut"), F.lit(False))
    mine = F.transform(F.filter("_draws", lambda d: ~d["cut"] | upto), lambda d: F.struct(d["pass"].alias("pass"), d["shard"].alias("shard"), order(d["pass"]).alias("order"))).cast(_DRAWS)
    fills = F.when(F.col("_place").eqNullSafe(F.col("_s_extra")), F.array(F.struct(F.col("_s_full").alias("pass"), F.col("_s_extra_shard").alias("shard"), order(F.col("_s_full")).alias("order"))))
    none = F.array().cast(_DRAWS)
    out = out.withColumn("_mine", F.concat(F.coalesce(mine, none), F.coalesce(fills.cast(_DRAWS), none)))
    return out.select(*[F.col(f"_kept.`{c}`").alias(c) for c in kept], F.col("_size").alias("size"), F.col("_s_source_size").alias("source_size"), F.col("_s_target").alias("target"), F.col("_mine").alias("draws"), (F.size("_mine") * F.col("_size")).cast("long").alias("taken"))


def in_shards(mix: DataFrame) -> DataFrame:
    """A row for each copy that the mix takes, with its ``pass``, its ``shard`` and its place ``order_key`` in it: shard by shard, shuffled inside each.

    Columns with one of these names, which the input of the mix may have had, are replaced; ``draws`` goes.
    """
    copies = mix.withColumn("_draw", F.explode("draws")).withColumns({"pass": F.col("_draw.pass"), "shard": F.col("_draw.shard"), "order_key": F.col("_draw.order")}).drop("_draw", "draws")
    return copies.repartition("shard", F.pmod("order_key", F.lit(SHARD_TASKS))).sortWithinPartitions("shard", "order_key")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixed(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    told = lambda field: F.array_join(F.transform("draws", lambda d: d[field].cast("string")), ",")
    return mix.select("doc_id", "size", "source_size", "target", "taken", told("shard").alias("shards"), told("order").alias("orders"))
