"""Alignment of two tokenizers over whole texts, by an associative monoid of fragments.

The tokens of a byte-level BPE (A) and of a sentencepiece model (B) cut the same bytes; where a token of each ends, a group ends. A
fragment stands for a range of bytes: an open prefix (tokens up to the first common end), closed groups and an open suffix (tokens after
the last one). Two neighbours compose: the suffix of the left and the prefix of the right are put together and what common ends
are there close groups. This is associative, so a very long text is cut into chunks that are encoded in different tasks, and
its fragments are composed in a tree over Spark tasks. Only open parts go up the tree; closed groups stay where they were closed, as pieces
with their place, and are read in order for the digest. Each tokenizer is cut at its own safe places, so chunks need not agree.

Shorter texts are one fragment, composed of units (runs between single spaces, where both tokenizers can be cut) that a task keeps.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.llm._common import in_arrow, read, salted_join, shared_checkpoint, slices

#: Characters of a chunk; fragments that are composed together; units that a task keeps, and the longest of them in characters.
CHUNK, FAN, CACHE_UNITS, CACHE_CHARS = 1 << 16, 16, 150_000, 64
#: Id pairs whose counts are broadcast at most (13 bytes each), by their counted number; beyond it they are joined.
BROADCAST_PAIRS = 4_000_000
#: Ids of B are below this, which makes one number of a pair.
_B = 1 << 16

#: Safe places: both tokenizers begin anew at a single space; A at any white space after other text, B at a run of spaces.
_UNITS, _A_CUT, _B_CUT = re.compile(r"(?<=[^\s▁]) (?=[^\s▁])"), re.compile(r"(?<=\S)[ \n]"), re.compile("(?<=[^ ▁]) ")


class Tokens(NamedTuple):
    """Tokens of both kinds, in order: ids and the byte offsets where they end."""

    a: np.ndarray
    a_end: np.ndarray
    b: np.ndarray
    b_end: np.ndarray

    def plus(self, other: Tokens) -> Tokens:
        return Tokens(*map(np.concatenate, zip(self, other)))

    def common(self) -> np.ndarray:
        return np.intersect1d(self.a_end, self.b_end, assume_unique=True)

    def between(self, low: int, high: int) -> Tokens:
        """The tokens that end after ``low`` and not after ``high``."""
        i, j = np.searchsorted(self.a_end, (low, high), "right")
        k, m = np.searchsorted(self.b_end, (low, high), "right")
        return Tokens(self.a[i:j], self.a_end[i:j], self.b[k:m], self.b_end[k:m])


_NONE = Tokens(*[np.zeros(0, np.int64)] * 4)
_END = 1 << 62


class Groups(NamedTuple):
    """Closed groups: where they begin, how many, as text, and the id pairs that end them."""

    at: int
    n: int
    text: str
    links: np.ndarray


def groups_of(tokens: Tokens, ends: np.ndarray) -> Groups:
    """The groups that ``ends``, common ends up to the last token, cut the tokens into."""
    i, j = np.searchsorted(tokens.a_end, ends), np.searchsorted(tokens.b_end, ends)
    a, b = list(map(str, tokens.a.tolist())), list(map(str, tokens.b.tolist()))
    parts, x, y = [], 0, 0
    for p, q in zip((i + 1).tolist(), (j + 1).tolist()):
        parts.append(f"{','.join(a[x:p])}|{','.join(b[y:q])}")
        x, y = p, q
    return Groups(int(ends[0]), len(parts), ";".join(parts), tokens.a[i] * _B + tokens.b[j])


class Fragment(NamedTuple):
    """A range of bytes: ``prefix`` up to the first common end; ``suffix`` after the last one. Without a common end (``cut`` false) all is prefix."""

    cut: bool
    prefix: Tokens
    suffix: Tokens


def fragment(tokens: Tokens, begins: bool) -> tuple[Fragment, Groups | None]:
    """A chunk's fragment and its closed groups. Where the text begins, a group does too."""
    ends = tokens.common()
    if not begins and not len(ends):
        return Fragment(False, tokens, _NONE), None
    low = -1 if begins else int(ends[0])
    prefix = _NONE if begins else tokens.between(-1, low)
    closed = ends if begins else ends[1:]
    last = int(ends[-1]) if len(ends) else low
    return Fragment(True, prefix, tokens.between(last, _END)), groups_of(tokens.between(low, last), closed) if len(closed) else None


def compose(left: Fragment, right: Fragment) -> tuple[Fragment, Groups | None]:
    """The fragment of two neighbours and the groups that close between them."""
    middle, closed = fragment((left.suffix if left.cut else left.prefix).plus(right.prefix), left.cut)
    suffix = right.suffix if right.cut else middle.suffix
    return Fragment(middle.cut, left.prefix if left.cut else middle.prefix, suffix), closed


def _byte_of() -> dict[str, int]:
    """Byte-level characters: printable Latin-1 ones stand for themselves, the others for 256 and up."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pair:
    """Both tokenizers, with the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte_of = _byte_of()
        words = self.a.get_vocab()
        self.a_bytes: list[bytes] = [b""] * (max(words.values()) + 1)
        for word, i in words.items():
            self.a_bytes[i] = bytes(byte_of[c] for c in word) if all(c in byte_of for c in word) else word.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if max(len(pieces), len(self.a_bytes)) > _B:
            raise ValueError("the ids of a pair don't fit into 32 bits")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        # ids as text, with what follows one in its group and at the end of it
        self.a_text, self.b_text = ([np.array([f"{i}{mark}" for i in range(len(t))], object) for mark in marks] for t, marks in ((self.a_bytes, ",|"), (self.b_bytes, ",;")))
        self.a_len, self.b_len = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))

    def a_ids(self, text: str) -> list[int]:
        return self.a.encode(text, add_special_tokens=False).ids

    def b_ids(self, text: str) -> list[int]:
        return self.b.encode(text, num_threads=1)

    def tokens(self, a_text: str | None, b_text: str | None, a_at: int = 0, b_at: int = 0) -> Tokens | None:
        """A's tokens of ``a_text`` and B's of space + ``b_text``, which begin at these offsets; None if their bytes aren't these texts'."""
        a, b = self.a_ids(a_text) if a_text else [], self.b_ids(b_text) if b_text is not None else []
        if b"".join(map(self.a_bytes.__getitem__, a)) != (a_text or "").encode() or b"".join(map(self.b_bytes.__getitem__, b)) != (" " + b_text if b_text is not None else "").encode():
            return None
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        return Tokens(a, a_at + np.cumsum(self.a_len[a]), b, b_at + np.cumsum(self.b_len[b]))


    def texts(self, tokens: Tokens, ends: np.ndarray, upto: np.ndarray) -> list[str]:
        """The groups that ``ends`` cut the tokens into, as text, for each run of groups; ``upto`` is how many tokens stand before its end."""
        at, pieces = [], []
        for ids, end, words in ((tokens.a, tokens.a_end, self.a_text), (tokens.b, tokens.b_end, self.b_text)):
            group = np.searchsorted(ends, end)
            last = np.r_[group[1:] != group[:-1], True]
            pieces.append(np.where(last, words[1][ids], words[0][ids]))
            at.append(2 * group + len(at))
        words = np.concatenate(pieces)[np.argsort(np.concatenate(at), kind="stable")].tolist()
        text, cuts = "".join(words), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))[upto - 1].tolist()
        return [text[i : j - 1] for i, j in zip([0, *cuts], cuts)]


@lru_cache(maxsize=2)
def _pair(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


class Units(dict):
    """Groups (as text), links (as bytes) and numbers of tokens (A's, and B's times 2**32) of units; None where bytes differ."""

    def __init__(self, pair: Pair):
        self.pair = pair

    def learn(self, units: set[str]) -> None:
        """Encode what isn't known, all units that have no white space at an edge in one call of each library."""
        if len(self) > CACHE_UNITS:
            self.clear()
        new = [u for u in units if u not in self]
        plain = [u for u in new if u and "▁" not in u and not u[0].isspace() and not u[-1].isspace()]
        for at in range(0, len(plain), 4_096):
            self._all(plain[at : at + 4_096])
        for u in new:
            if u not in self:
                self[u] = self._one(u)

    def _one(self, unit: str) -> tuple[str, bytes, int] | None:
        tokens = self.pair.tokens(" " + unit, unit)
        if tokens is None:
            return None
        found = groups_of(tokens, tokens.common())
        return found.text, found.links.astype(np.uint32).tobytes(), len(tokens.a) + (len(tokens.b) << 32)

    def _all(self, units: list[str]) -> None:
        text = " ".join(units)
        tokens = self.pair.tokens(" " + text, text)
        if tokens is None:
            return
        ends = np.cumsum([len(u.encode()) + 1 for u in units])
        common = tokens.common()
        if not np.isin(ends, common).all():
            return
        i, p, q = np.searchsorted(common, ends) + 1, np.searchsorted(tokens.a_end, ends) + 1, np.searchsorted(tokens.b_end, ends) + 1
        texts = self.pair.texts(tokens, common, p + q)
        pairs = tokens.a[np.searchsorted(tokens.a_end, common)] * _B + tokens.b[np.searchsorted(tokens.b_end, common)]
        links, many = pairs.astype(np.uint32).tobytes(), np.diff(np.r_[0, p]) + (np.diff(np.r_[0, q]) << 32)
        low = 0
        for u, text_, high, n in zip(units, texts, (4 * i).tolist(), many.tolist()):
            self[u] = (text_, links[low:high], n)
            low = high

    def forget_long(self, units: set[str]) -> None:
        for u in units:
            if len(u) > CACHE_CHARS:
                self.pop(u, None)


_PART = "key long, id long, n_a long, n_b long, n_groups long, sha string, links binary, j int, m int, a string, b string, a_at long, b_at long"
_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split(" ") for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], _TYPES[kind]) for i, (_, kind) in enumerate(fields)], [name for name, _ in fields])


def chunks_of(text: str) -> list[tuple[str | None, str | None, int, int]]:
    """Texts of A and of B (less its first space) for each chunk, and the bytes of space + text before them."""
    m = -(-len(text) // CHUNK)
    cuts = []
    for pattern in (_A_CUT, _B_CUT):
        at = [0]
        for i in range(1, m):
            found = at[-1] if at[-1] >= i * CHUNK else (x.start() if (x := pattern.search(text, i * CHUNK)) else len(text))
            at.append(found)
        cuts.append([*at, len(text)])
    out, before = [], [0, 0]
    for i in range(m):
        (a0, a1), (b0, b1) = ((c[i], c[i + 1]) for c in cuts)
        a = (" " + text[:a1] if i == 0 else text[a0:a1]) if a1 > a0 else None
        b = (text[:b1] if i == 0 else text[b0 + 1 : b1]) if b1 > b0 else None
        out.append((a, b, *before))
        before[0] += len((a or "").encode())
        before[1] += len(b.encode()) + 1 if b is not None else 0
    return out


def _parts(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """A row for each text of ``CHUNK`` characters at most, with its result but for counts; a row for each chunk of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, press = Units(_pair(a_path, b_path)), zstandard.ZstdCompressor(1)
        key = TaskContext.get().partitionId() << 33
        for part in slices(batches, 128):
            rows, texts = [], [(i, t.as_py() or "") for i, t in zip(part.column(0).to_pylist(), part.column(1))]
            split = [_UNITS.split(t) if 0 < len(t) <= CHUNK else [] for _, t in texts]
            used = set().union(*split)
            units.learn(used)
            for (i, text), own in zip(texts, split):
                key += 1
                if len(text) > CHUNK:
                    cut = chunks_of(text)
                    for j, (a, b, a_at, b_at) in enumerate(cut):
                        rows.append((key, i, None, None, None, None, None, j, len(cut), a, b, a_at, b_at))
                        if len(rows) >= 32:
                            yield _batch(rows, _PART)
                            rows = []
                    continue
                known = list(map(units.__getitem__, own))
                if not known or None in known:
                    rows.append((key, i, 0, 0, 0, "", None, *[None] * 6))
                    continue
                groups, links, many = zip(*known)
                n, data = sum(many), b"".join(links)
                rows.append((key, i, n & 0xFFFFFFFF, n >> 32, len(data) // 4, hashlib.sha256(";".join(groups).encode()).hexdigest(), press.compress(data), *[None] * 6))
            yield _batch(rows, _PART)
            units.forget_long(used)

    return in_arrow(docs, run, _PART)


_OPEN = ["a", "a_end", "b", "b_end"]
_FRAGMENT = "key long, id long, j int, ok boolean, n_a long, n_b long, cut boolean, " + ", ".join(f"{side}_{c} array<long>" for side in ("p", "s") for c in _OPEN) + ", at long, n_groups long, groups string, links binary"


def _row(key, i, j, ok, n_a, n_b, f: Fragment | None, g: Groups | None) -> tuple:
    open_ = [x.tolist() for t in (f.prefix, f.suffix) for x in t] if f else [None] * 8
    closed = (g.at, g.n, g.text, zstandard.ZstdCompressor(1).compress(g.links.astype(np.uint32).tobytes())) if g else (None, None, None, None)
    return (key, i, j, ok, n_a, n_b, f.cut if f else None, *open_, *closed)


def _encoded(chunks: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Each chunk's fragment, with its closed groups in the same row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(a_path, b_path)
        for part in slices(batches, 8):
            rows = []
            for key, i, j, a, b, a_at, b_at in zip(*[c.to_pylist() for c in part.columns]):
                tokens = pair.tokens(a, b, a_at, b_at)
                f, g = fragment(tokens or _NONE, j == 0)
                rows.append(_row(key, i, j, tokens is not None, len((tokens or _NONE).a), len((tokens or _NONE).b), f, g))
            yield _batch(rows, _FRAGMENT)

    return in_arrow(chunks.select("key", "id", "j", "a", "b", "a_at", "b_at").repartition("key", "j"), run, _FRAGMENT)


def _composed(fragments: DataFrame) -> DataFrame:
    """One fragment for ``FAN`` neighbours; rows of ``j`` -1 are the groups that close between them."""

    def together(group: pa.Table) -> pa.Table:
        parts = sorted(group.to_pylist(), key=lambda r: r["j"])
        out, done = [], None
        for r in parts:
            f = Fragment(r["cut"], *[Tokens(*[np.array(r[f"{side}_{c}"], np.int64) for c in _OPEN]) for side in ("p", "s")])
            done, closed = (f, None) if done is None else compose(done, f)
            if closed:
                out.append(_row(r["key"], r["id"], -1, None, None, None, None, closed))
        total = [sum(r[c] for r in parts) for c in ("n_a", "n_b")]
        out.append(_row(parts[0]["key"], parts[0]["id"], parts[0]["j"] // FAN, all(r["ok"] for r in parts), *total, done, None))
        return pa.Table.from_batches([_batch(out, _FRAGMENT)])

    return fragments.groupBy("key", F.floor(F.col("j") / FAN)).applyInArrow(together, _FRAGMENT)


_DIGEST = "key long, n_groups long, sha string"


def _digests(pieces: DataFrame) -> DataFrame:
    """The number of groups and the digest of each long text, from its pieces in order, a piece at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, sha, out = None, 0, None, []
        for batch in batches:
            for here, many, text in zip(*[c.to_pylist() for c in batch.columns]):
                if here != key:
                    if sha:
                        out.append((key, n, sha.hexdigest()))
                    key, n, sha = here, 0, hashlib.sha256()
                sha.update((";" + text if n else text).encode())
                n += many
            yield _batch(out, _DIGEST)
            out = []
        yield _batch([(key, n, sha.hexdigest())] if sha else [], _DIGEST)

    # by a hash of the key: a plan that is dealt by the key already, but may yet change as it runs, would stand for a shuffle by the key itself
    dealt = pieces.select("key", "at", "n_groups", "groups").repartition(F.xxhash64("key")).sortWithinPartitions("key", "at")
    return in_arrow(dealt.select("key", "n_groups", "groups"), run, _DIGEST)


def _long_texts(parts: DataFrame, a_path: str, b_path: str) -> tuple[DataFrame, DataFrame]:
    """``key``, ``id`` and results of the texts that were cut into chunks, and ``key``, ``at``, ``links`` of their pieces."""
    chunks = parts.filter("m is not null")
    most = chunks.agg(F.max("m")).first()[0] or 0
    fragments = shared_checkpoint(_encoded(chunks, a_path, b_path))
    pieces, left = fragments, 1
    while left < most:
        composed = shared_checkpoint(_composed(fragments))
        pieces, fragments, left = pieces.unionAll(composed), composed.filter("j >= 0"), left * FAN
    pieces = pieces.filter("groups is not null")
    whole = fragments.select("key", "id", "n_a", "n_b", (F.col("ok") & (F.size("p_a") + F.size("s_a") + F.size("p_b") + F.size("s_b") == 0)).alias("ok"))
    whole = shared_checkpoint(whole)
    good = whole.filter("ok").select("key")
    done = whole.join(_digests(pieces.join(good, "key", "left_semi")), "key", "left")
    zero = [F.when(F.col("ok"), F.col(c)).otherwise(0).alias(c) for c in ("n_a", "n_b", "n_groups")]
    return done.select("key", "id", *zero, F.when(F.col("ok"), F.col("sha")).otherwise("").alias("sha")), pieces.join(good, "key", "left_semi").select("key", "at", "links")


def _unpacked(links: pa.Array, press: zstandard.ZstdDecompressor) -> list[np.ndarray]:
    return [np.frombuffer(press.decompress(x) if x else b"", np.uint32) for x in links.to_pylist()]


def pair_counts(links: DataFrame) -> DataFrame:
    """``pair``, ``n`` and ``best`` (no pair with the same id of B has more) over all links. Tasks count their own first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, held = zstandard.ZstdDecompressor(), np.zeros((2, 0), np.int64)
        waiting: list[np.ndarray] = []

        def merged() -> np.ndarray:
            new, n = np.unique(np.concatenate(waiting), return_counts=True) if waiting else held
            pairs, at = np.unique(np.concatenate([held[0], new.astype(np.int64)]), return_inverse=True)
            return np.stack([pairs, np.bincount(at, np.concatenate([held[1], n]), len(pairs)).astype(np.int64)])

        size = 0
        for part in slices(batches, 1_024):
            waiting += _unpacked(part.column(0), press)
            size += sum(map(len, waiting[-part.num_rows :]))
            if size > 1_000_000:
                held, waiting, size = merged(), [], 0
            if held.shape[1] > 1_000_000:
                yield from sent(held)
                held = held[:, :0]
        if waiting:
            held = merged()
        yield from sent(held)

    def sent(held: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, held.shape[1], 65_536):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[:, at : at + 65_536]], ["pair", "n"])

    counts = shared_checkpoint(in_arrow(links.select("links"), count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")))
    most = counts.groupBy((F.col("pair") % _B).alias("b")).agg(F.max("n").alias("most"))  # a row for each id of B
    return counts.withColumn("b", F.col("pair") % _B).join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _with_sums(rows: DataFrame, kept: str, counts: DataFrame, many: int) -> DataFrame:
    """The columns ``kept`` (names and types, the first of them ``key``) with ``count_sum`` and ``n_best`` of each row's ``links``."""
    names = [x.split(" ")[0] for x in kept.split(", ")]
    if many <= BROADCAST_PAIRS:
        table = counts.toArrow() if many else pa.table({"pair": [], "n": [], "best": []})
        pair, n, best = (table.column(c).to_numpy().astype(t) for c, t in (("pair", np.uint32), ("n", np.int64), ("best", np.int64)))
        order = np.argsort(pair)
        known = rows.sparkSession.sparkContext.broadcast((pair[order], n[order], best[order].astype(np.bool_)))

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pair, n, best = known.value
            press = zstandard.ZstdDecompressor()
            for part in slices(batches):
                own = _unpacked(part.column(len(names)), press)
                at = np.searchsorted(pair, np.concatenate(own))
                sizes = np.array([len(x) for x in own])
                begin = np.r_[0, np.cumsum(sizes[:-1])].astype(np.int64)
                sums = [np.where(sizes > 0, np.add.reduceat(np.r_[x, 0], begin), 0) for x in (n[at], best[at].astype(np.int64))]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], *map(pa.array, sums)], [*names, "count_sum", "n_best"])

        return in_arrow(rows.select(*names, "links"), look, f"{kept}, count_sum long, n_best long")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for part in slices(batches, 64):
            own = [np.unique(x, return_counts=True) for x in _unpacked(part.column(1), press)]
            keys = np.repeat(part.column(0).to_numpy(), [len(p) for p, _ in own])
            yield pa.RecordBatch.from_arrays([pa.array(keys), *[pa.array(np.concatenate([x[i] for x in own]).astype(np.int64)) for i in (0, 1)]], ["key", "pair", "times"])

    found = salted_join(in_arrow(rows.select("key", "links"), spread, "key long, pair long, times long"), counts, "pair", "inner")
    sums = found.groupBy("key").agg(F.sum(F.col("n") * F.col("times")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"))
    return rows.select(names).dropDuplicates(["key"]).join(sums, "key", "left")  # the sums of all rows of a key are in one


def aligned(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each text: ``id_col``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum`` and ``groups_sha256``.

    A (a tokenizers file, byte-level) encodes space + text, B (a sentencepiece model, which adds the space) the text. A link is an A and a B
    token that end at the same byte; ``count_sum`` sums, over a text's links, how many links of all texts have the same ids; ``n_best`` counts
    the links of which no other A id is linked more often with their B id, ties included. Null and empty texts, and those whose bytes a tokenizer
    changes, have zeros, an empty digest, and no part in counts. Null ids and repeated rows are kept as rows. Other columns, whatever
    their names, are not read. An empty table gives no rows. A text without any safe place for a tokenizer is encoded by it in one task.
    """
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    parts = shared_checkpoint(_parts(slim, a_path, b_path))
    short = parts.filter("m is null")
    long, pieces = _long_texts(parts, a_path, b_path)
    counts = pair_counts(short.filter("links is not null").select("links").unionAll(pieces.select("links")))
    counts = shared_checkpoint(counts)
    many = counts.count()
    results = "key long, id long, n_a long, n_b long, n_groups long, sha string"
    # a long text's pieces have a row each
    sums = _with_sums(pieces, "key long, at long", counts, many).groupBy("key").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    out = _with_sums(short, results, counts, many).unionByName(long.join(sums, "key", "left"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")]
    return out.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), *zero, F.coalesce("sha", F.lit("")).alias("groups_sha256"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return aligned(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
