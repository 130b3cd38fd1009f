"""The trie of conversation prefixes, with subtree totals by time-forward processing.

A node is a distinct sequence of first turns (role and text). It is known by its depth and 128 bits: the exclusive or of a hash of each
turn with its place, which is a running aggregate that any split of a conversation can be summed up from.

Totals go from the leaves to the root. Nodes are cut into shards: a node is light if its subtree has ``LIGHT`` member turns at most, and the
light nodes whose parents aren't are the roots of shards. Inside a shard, nodes are sorted outside memory in reverse level order; each takes
the totals that its children sent from a priority queue that spills, and sends its own to its parent. Roots of shards are
summed up by parent before they are shuffled, and the nodes above them are cut into shards by a ``FAN`` times larger bound, until the
root is reached. So a first turn that a third of all conversations share is no task of its own: its subtree is many shards.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gradeloom.llm._common import in_arrow, read, salted_join, shared_checkpoint

#: Member turns of a light subtree, how much the bound grows from one level of shards to the next; messages that a queue holds in memory.
LIGHT, FAN, HELD = 20_000, 64, 50_000
#: Turns, and ids, that are ordered or summed up by themselves before the blocks of a conversation, or of a node, are put together.
BLOCK, IDS = 1_024, 4_096
#: Own conversations that share the first turns of one of them in the registered query.
FAMILY = 20

_WORDS = r"[^\x20\x09-\x0D]+"
_KEY = ["depth", "p1", "p2"]


class SpillingQueue:
    """A priority queue of equally long tuples of whole numbers. Beyond ``most`` of them, those held are sorted into a scratch file of Spark's local
    folder, which has no name, and so is gone with the task however that ends."""

    def __init__(self, most: int = HELD):
        self.most, self.heap, self.runs, self.spilled = most, [], [], 0

    def push(self, item: tuple[int, ...]) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.most:
            self._spill()

    def _spill(self) -> None:
        # Spark names its folders for spills to its workers
        file = tempfile.TemporaryFile(dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None)
        rows = np.array(sorted(self.heap), np.int64)
        file.write(rows.tobytes())
        file.seek(0)
        self.heap, self.spilled = [], self.spilled + 1
        self._next(self._read(file, rows.shape[1]), self.spilled)

    def _read(self, file, width: int) -> Iterator[tuple[int, ...]]:
        with file:
            while data := file.read(width * 8 * 4_096):
                yield from map(tuple, np.frombuffer(data, np.int64).reshape(-1, width).tolist())

    def _next(self, run: Iterator[tuple[int, ...]], number: int) -> None:
        if (item := next(run, None)) is not None:
            heapq.heappush(self.runs, (item, number, run))

    def least(self) -> tuple[int, ...] | None:
        """The least item, which stays."""
        heads = [x for x in (self.heap[:1], [r[0] for r in self.runs[:1]]) if x]
        return min(heads)[0] if heads else None

    def pop(self) -> tuple[int, ...]:
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            item, number, run = heapq.heappop(self.runs)
            self._next(run, number)
            return item
        return heapq.heappop(self.heap)


def numbered_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv``, ``k`` (the turn's place from 1, by turn, null first, then by ``digest``), ``digest`` (MD5 of role and text) and ``words`` for each turn.

    Turns are numbered in blocks of ``BLOCK`` values of the turn, so one very long conversation is spread over tasks.
    """
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    turn = F.col(f"`{turn_col}`").cast("long")
    slim = conversations.select(
        F.col(f"`{conv_col}`").cast("long").alias("conv"), turn.alias("turn"), F.coalesce(F.floor(turn / BLOCK), F.lit(-(2**63))).cast("long").alias("block"),
        F.md5(F.concat(F.char_length(role).cast("string"), F.lit(" "), role, text)).alias("digest"), F.regexp_count(text, F.lit(_WORDS)).cast("long").alias("words"),
    ).filter("conv is not null")
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = slim.groupBy("conv", "block").count().select("conv", "block", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("conv", "block").orderBy(F.col("turn").asc_nulls_first(), "digest"))
    return slim.join(before, ["conv", "block"]).select("conv", (place + F.col("before")).cast("long").alias("k"), "digest", "words")


def whole(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as they are: ``conv``, ``len`` of each, and ``conv``, ``len``, ``depth``, ``digest``, ``words`` of each turn."""
    convs = turns.groupBy("conv").agg(F.count("*").alias("len"))
    return convs, turns.join(convs, "conv").select("conv", "len", F.col("k").alias("depth"), "digest", "words")


def with_heads(turns: DataFrame, family: int = FAMILY) -> tuple[DataFrame, DataFrame]:
    """Conversation c begins with the first h turns of c - c % ``family`` instead of its own first h, h being crc32 of its decimal id modulo 4."""
    own = turns.groupBy("conv").agg(F.count("*").alias("n"))
    first = F.col("conv") - F.col("conv") % family
    own = own.select("conv", "n", first.alias("first"), (F.crc32(F.col("conv").cast("string").cast("binary")) % 4).alias("h"))
    own = own.join(own.select(F.col("conv").alias("first"), F.col("n").alias("n_first")), "first", "left")
    head = F.least("h", F.coalesce("n_first", F.lit(0)))
    convs = shared_checkpoint(own.select("conv", "first", "h", head.alias("head"), (head + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len")))
    rest = turns.join(convs, "conv").filter("k > h").select("conv", "len", (F.col("k") - F.col("h") + F.col("head")).alias("depth"), "digest", "words")
    lent = turns.filter("k < 4").withColumnRenamed("conv", "first")
    lent = convs.join(lent, "first").filter("k <= h").select("conv", "len", F.col("k").alias("depth"), "digest", "words")
    return convs.select("conv", "len"), rest.unionByName(lent)


def _running(members: DataFrame) -> DataFrame:
    """With ``p1``, ``p2`` of each prefix and ``q1``, ``q2`` of the one before it. Long conversations are summed up in blocks."""
    z = [F.xxhash64(F.lit(seed), "depth", "digest") for seed in (1, 2)]
    rows = members.select("conv", "len", "depth", "words", z[0].alias("z1"), z[1].alias("z2"), F.floor((F.col("depth") - 1) / BLOCK).alias("block"))
    inside = Window.partitionBy("conv", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    out = []
    for long in (False, True):
        part = rows.filter(F.col("len") > BLOCK) if long else rows.filter(F.col("len") <= BLOCK)
        begun = (F.lit(0), F.lit(0))
        if long:
            sums = part.groupBy("conv", "block").agg(*[F.bit_xor(f"z{i}").alias(f"s{i}") for i in (1, 2)])
            sums = sums.select("conv", "block", *[F.coalesce(F.bit_xor(f"s{i}").over(earlier), F.lit(0)).alias(f"b{i}") for i in (1, 2)])
            part, begun = part.join(sums, ["conv", "block"]), (F.col("b1"), F.col("b2"))
        part = part.withColumns({f"p{i}": F.bit_xor(f"z{i}").over(inside).bitwiseXOR(begun[i - 1]) for i in (1, 2)})
        out.append(part.select("conv", "len", "depth", "words", "p1", "p2", *[F.col(f"p{i}").bitwiseXOR(F.col(f"z{i}")).alias(f"q{i}") for i in (1, 2)]))
    return out[0].unionAll(out[1])


def _nodes(convs: DataFrame, members: DataFrame) -> DataFrame:
    size = F.sum(F.col("len") - F.col("depth") + 1).alias("size")
    below = members.groupBy(*_KEY).agg(F.min("conv").alias("conv"), F.count("*").alias("n"), size, F.max("words").alias("words"), F.max("q1").alias("q1"), F.max("q2").alias("q2"))
    none = F.lit(0).cast("long")
    root = convs.agg(F.min("conv").alias("conv"), F.count("*").alias("n"), F.sum(F.col("len") + 1).alias("size")).filter("n > 0")
    return below.withColumn("depth", F.col("depth").cast("long")).unionByName(root.select(*[none.alias(c) for c in (*_KEY, "words", "q1", "q2")], "conv", "n", "size"))


_SENT = ["depth", "p1", "p2", "conv", "n", "children", "leaves", "saved"]
_DONE = ", ".join(f"{c} long" for c in (*_SENT, "q1", "q2", "parent"))


def _passed_up(nodes: DataFrame) -> DataFrame:
    """The nodes of shards with the totals of their subtrees and the ``parent``'s conversation, which the roots of shards lack.

    ``nodes`` come with what was already sent to them (``c``, ``l``, ``s``) and ``top``, whether they are a shard's root.
    """

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue, out = SpillingQueue(HELD), []
        for batch in batches:
            for depth, p1, p2, conv, n, own, q1, q2, children, leaves, saved, top in zip(*[c.to_pylist() for c in batch.columns]):
                here, saved = (-depth, p1, p2), saved + own
                while (sent := queue.least()) and sent[:3] == here:
                    child = queue.pop()[3:]
                    children, leaves, saved = children + 1, leaves + child[6], saved + child[7]
                    out.append((*child, p1, p2, conv))
                done = (depth, p1, p2, conv, n, children, leaves or 1, saved)
                if top:
                    out.append((*done, q1, q2, None))
                else:
                    queue.push((1 - depth, q1, q2, *done))
                if len(out) >= 8_192:
                    yield rows(out)
                    out = []
        if queue.least():
            raise ValueError("a node's parent is not in its shard")
        yield rows(out)

    def rows(out: list[tuple]) -> pa.RecordBatch:
        names = [x.split(" ")[0] for x in _DONE.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(len(names))], names)

    order = [F.col("depth").desc(), "p1", "p2"]
    dealt = nodes.repartition(F.xxhash64("s0", "s1", "s2")).sortWithinPartitions(*order)
    saved = ((F.col("n") - 1) * F.col("words")).alias("own")
    return in_arrow(dealt.select(*_KEY, "conv", "n", saved, "q1", "q2", "c", "l", "s", "top"), forward, _DONE)


def _ends(convs: DataFrame, members: DataFrame) -> DataFrame:
    """For each node that ends conversations, the digest of their ids. Ids are joined in blocks first, so the one stream of a node reads few rows."""
    none = [F.lit(0).cast("long").alias(c) for c in _KEY]
    last = members.filter("depth = len").select(*_KEY, "conv").unionAll(convs.filter("len = 0").select(*none, "conv"))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda x: x.cast("string")), ",")  # IDS different ids at most
    blocks = last.groupBy(*_KEY, F.floor(F.col("conv") / IDS).alias("block")).agg(ids.alias("ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha, out = None, None, []
        for batch in batches:
            for *at, ids in zip(*[c.to_pylist() for c in batch.columns]):
                if at != node:
                    if sha:
                        out.append((*node, sha.hexdigest()))
                    node, sha = at, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield rows(out)
            out = []
        yield rows([(*node, sha.hexdigest())] if sha else [])

    def rows(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*[pa.array([r[i] for r in out], pa.int64()) for i in range(3)], pa.array([r[3] for r in out], pa.string())], [*_KEY, "ends"])

    dealt = blocks.repartition(F.xxhash64(*_KEY)).sortWithinPartitions(*_KEY, "block").select(*[F.col(c).cast("long") for c in _KEY], "ids")
    return in_arrow(dealt, digest, "depth long, p1 long, p2 long, ends string")


def _shards(nodes: DataFrame, members: DataFrame, levels: int) -> DataFrame:
    """Nodes with the key of their shard's root: the first node, on the way to them, whose subtree is under the bound of their level."""
    nodes = nodes.withColumn("level", sum((F.when(F.col("size") > LIGHT * FAN**k, 1).otherwise(0) for k in range(levels)), F.lit(0)))
    nodes = shared_checkpoint(nodes)
    if not levels:
        return nodes.withColumns({"s0": F.lit(0), "s1": F.lit(0), "s2": F.lit(0), "top": F.col("depth") == 0})
    key = F.struct(*_KEY).alias("key")
    heavy = nodes.filter("level > 0").select(key, "level")
    placed = salted_join(members.select("conv", key), heavy, "key", "left").withColumn("level", F.coalesce("level", F.lit(0)))
    first = placed.groupBy("conv").agg(*[F.min(F.when(F.col("level") <= k, F.col("key"))).alias(f"shard{k}") for k in range(levels)])
    shard = F.coalesce(*[F.when(F.col("level") == k, F.col(f"shard{k}")) for k in range(levels)])
    found = nodes.filter("depth > 0").join(first, "conv").withColumn("shard", shard)
    zero = F.struct(*[F.lit(0).cast("long").alias(c) for c in _KEY])
    found = found.select(*nodes.columns, "shard").unionByName(nodes.filter("depth = 0").withColumn("shard", zero)).withColumn("shard", F.coalesce("shard", zero))
    return shared_checkpoint(found.select(*nodes.columns, *[F.col(f"shard.{c}").alias(f"s{i}") for i, c in enumerate(_KEY)], (F.struct(*_KEY) == F.col("shard")).alias("top")))


def _together(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for more in frames[1:]:
        out = out.unionAll(more)
    return out


def _trie(convs: DataFrame, members: DataFrame) -> DataFrame:
    members = shared_checkpoint(_running(members).withColumn("depth", F.col("depth").cast("long")))
    nodes = shared_checkpoint(_nodes(convs, members))
    largest, levels = nodes.agg(F.max("size")).first()[0] or 0, 0
    while largest > LIGHT * FAN**levels:
        levels += 1
    nodes = _shards(nodes, members, levels)
    done, roots = [], []
    for k in range(levels + 1):
        mine = nodes.filter(F.col("level") == k)
        if roots:
            sums = [F.count("*").alias("c"), F.sum("leaves").alias("l"), F.sum("saved").alias("s")]
            sent = _together(roots).filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(*sums)
            mine = mine.join(sent, _KEY, "left")
        else:
            mine = mine.withColumns({c: F.lit(0) for c in "cls"})
        mine = mine.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in "cls"})
        out = shared_checkpoint(_passed_up(mine))
        done.append(out.filter("parent is not null"))
        roots.append(out.filter("parent is null"))
    above = nodes.filter("level > 0").select(F.struct(*_KEY).alias("above"), F.col("conv").alias("found"))
    top = _together(roots).withColumn("above", F.when(F.col("depth") > 0, F.struct((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2"))))
    out = salted_join(top, above, "above", "left").select(*_SENT, F.col("found").alias("parent"))
    out = _together([out, *[part.select(*_SENT, "parent") for part in done]])
    ends = _ends(convs, members)
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return out.join(ends, _KEY, "left").select(F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends", none).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", family: int | None = None) -> DataFrame:
    """A row for each distinct sequence of first turns of the conversations, the empty one (the root) included.

    ``conv_id`` is the smallest conversation that begins with it, ``depth`` its turns, ``parent_conv_id`` its parent's ``conv_id`` (root: null),
    ``n_convs`` the conversations that begin with it, ``n_children``, ``n_leaves`` the childless nodes of its subtree, ``saved_tokens`` the sum over
    its subtree of (``n_convs`` - 1) times the words of a node's last text, ``ends_sha256`` the digest of the sorted ids of those that end with it.
    With ``family``, a conversation takes its first turns from the first of its family (``with_heads``).

    Turns are ordered by ``turn_col``, null first; equal ones by MD5 of role and text, so repeated rows are repeated turns. Null roles and
    texts are empty, as are texts without words; they are turns like others. Rows without a conversation's id are left out. Other columns,
    whatever their names, are not read. An empty table gives no rows. A conversation's chain of nodes that many conversations share is
    handed on by one task, a message at a time.
    """
    turns = shared_checkpoint(numbered_turns(conversations, conv_col, turn_col, role_col, text_col))
    return _trie(*(with_heads(turns, family) if family else whole(turns)))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(read(spark, sf_dir, "conversations"), family=FAMILY)


OP11_SQL = r"""
with recursive turns as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, md5(length(coalesce(role, '')) || ' ' || coalesce(role, '') || coalesce(text, ''))) as k
  from conversations where conv_id is not null),
ids as (select conv_id, count(*) as n from turns group by 1),
crc as (
  select conv_id, 0 as i, 4294967295::bigint as c from ids union all
  select conv_id, i + 1, case when (x & 1) = 1 then xor(x >> 1, 3988292384) else x >> 1 end
  from (select conv_id, i, case when i % 8 = 0 then xor(c, ascii(substr(conv_id::varchar, (i // 8 + 1)::int, 1))::bigint) else c end as x from crc where i < 8 * length(conv_id::varchar))),
heads as (select conv_id, xor(c, 4294967295) % 4 as h from crc where i = 8 * length(conv_id::varchar)),
rebuilt as (
  select h.conv_id, t.k, t.role, t.text from heads h join turns t on t.conv_id = h.conv_id - h.conv_id % 20 and t.k <= h.h union all
  select h.conv_id, t.k, t.role, t.text from heads h join turns t on t.conv_id = h.conv_id and t.k > h.h),
members as (select conv_id, row_number() over (partition by conv_id order by k) as depth, role, text from rebuilt),
keyed as (
  select conv_id, 0 as depth, 'root' as key, 0 as words from ids union all
  select conv_id, depth, md5(string_agg(md5(length(role) || ' ' || role || text), ' ') over (partition by conv_id order by depth)) as key,
    len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as words from members),
tails as (select conv_id, max(depth) as len from keyed group by 1),
nodes as (select key, min(depth) as depth, min(conv_id) as conv_id, count(*) as n, max(words) as words from keyed group by 1),
ends as (select k.key, string_agg(k.conv_id::varchar, ',' order by k.conv_id) as ids from keyed k join tails t on t.conv_id = k.conv_id and t.len = k.depth group by 1),
parents as (select n.key, p.key as parent from nodes n join keyed p on p.conv_id = n.conv_id and p.depth = n.depth - 1),
children as (select parent as key, count(*) as n_children from parents group by 1),
below as (select a.key, sum((n.n - 1) * n.words) as saved, count(*) filter (where c.key is null) as leaves
  from nodes n join keyed a on a.conv_id = n.conv_id and a.depth <= n.depth left join children c on c.key = n.key group by 1)
select n.conv_id, n.depth::bigint as depth, q.conv_id as parent_conv_id, n.n as n_convs, coalesce(c.n_children, 0) as n_children, b.leaves as n_leaves,
  b.saved::bigint as saved_tokens, sha256(coalesce(e.ids, '')) as ends_sha256
from nodes n join below b using (key) left join parents p using (key) left join nodes q on q.key = p.parent left join children c on c.key = n.key left join ends e on e.key = n.key
"""
