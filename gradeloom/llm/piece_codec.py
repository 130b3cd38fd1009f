"""Encoding and decoding with merge-type sentencepiece vocabularies.

A pre-token is encoded by a score-ordered agenda of adjacent symbol pairs: the pair whose joined piece has
the best score is joined first, the leftmost on ties, and the two pairs that this makes are put on the
agenda, until no pair is a piece. The agendas of many short pre-tokens are worked off together, as rows of a matrix; a
long one has a heap. What is no piece at the end falls back to bytes. Every distinct pre-token that a task's cache doesn't hold
is also given whole to the library, to be encoded and decoded, all of a slice in one call; where the two differ the library's result stands
and the row says so.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.llm._common import in_arrow, read, slices
from gradeloom.llm._pretokens import MARK, library_ids, pretokens, processor

#: Pre-tokens that a task keeps (with 250 bytes each, some 40 MB), and the longest, in characters, that it keeps.
CACHE_TOKENS, CACHE_CHARS = 150_000, 64
#: Symbols up to which pre-tokens are encoded together, in bands of these widths; rows of a matrix; the rank of a pair that is no piece.
BANDS, ROWS, NEVER = (8, 10, 12, 16, 24, 48), 8_192, np.int32(1 << 30)
#: Bytes of text handled at once, but for a longer one alone.
SLICE_BYTES = 3 << 19


class _Points(dict):
    """Codes of characters; those beyond the vocabulary's own stand for code points."""

    def __missing__(self, code: int) -> str:
        return chr(code - (1 << 24))


class PieceCodec:
    """A vocabulary as tables for the agenda; holds no state between calls."""

    def __init__(self, model_path: str):
        self.model = m = processor(model_path)
        kinds = range(m.get_piece_size())
        self.bytes = {m.id_to_piece(i): i for i in kinds if m.is_byte(i)}
        self.ids = {m.id_to_piece(i): i for i in kinds if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i))}
        self.order = {p: k for k, p in enumerate(sorted(self.ids, key=lambda p: (-m.get_score(self.ids[p]), self.ids[p])))}
        self.pieces = [b"" if m.is_control(i) else bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace(MARK, " ").encode() for i in kinds]
        self.pieces[m.unk_id()] = " ⁇ ".encode()
        # codes: ids, and beyond them the characters that are no piece; pairs of codes that make a piece, in order, with its rank
        self.code = dict(self.ids)
        for c in sorted({c for p in self.ids for c in p} - self.ids.keys()):
            self.code[c] = len(kinds) + len(self.code)
        pairs = [((self.code[p[:k]] << 32) | self.code[p[k:]], r) for p, r in self.order.items() for k in range(1, len(p)) if p[:k] in self.code and p[k:] in self.code]
        self._store(np.array([k for k, _ in pairs], dtype=np.int64), np.array([r for _, r in pairs], dtype=np.int32))
        self.by_rank = np.array([self.ids[p] for p in self.order], dtype=np.int64)
        self.by_point = np.arange(0x110000, dtype=np.int32) + (1 << 24)
        for c, code in self.code.items():
            if len(c) == 1:
                self.by_point[ord(c)] = code
        self.point = _Points({code: c for c, code in self.code.items() if len(c) == 1})
        self.names = [str(i) for i in kinds]
        self.end = m.eos_id()

    def _store(self, keys: np.ndarray, ranks: np.ndarray) -> None:
        """Keep pairs in a table of four to eight times as many places, each at the first free one from its own."""
        self.bits = max(4, int(len(keys)).bit_length() + 2)
        self.pair, self.rank = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NEVER)
        at = self._place(keys)
        while len(keys):
            _, first = np.unique(np.where(self.pair[at] == -1, at, -1), return_index=True)
            first = first[self.pair[at[first]] == -1]
            self.pair[at[first]], self.rank[at[first]] = keys[first], ranks[first]
            left = np.ones(len(keys), bool)
            left[first] = False
            keys, ranks, at = keys[left], ranks[left], (at[left] + 1) & ((1 << self.bits) - 1)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def encode(self, symbols: str) -> list[int]:
        """The ids of a string in which marks stand for spaces."""
        out: list[int] = []
        for part in self._joined(symbols):
            if (i := self.ids.get(part)) is not None:
                out.append(i)
            else:
                out += [self.bytes[f"<0x{b:02X}>"] for b in part.encode()] if self.bytes else [self.model.unk_id()]
        return out

    def _joined(self, symbols: str) -> list[str]:
        """The agenda as a heap of ranks and places."""
        parts: list[str | None] = list(symbols)
        n, order = len(parts), self.order
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [order[p] * n + i for i in range(n - 1) if (p := parts[i] + parts[i + 1]) in order]
        heapq.heapify(agenda)
        while agenda:
            rank, left = divmod(heapq.heappop(agenda), n)
            if parts[left] is None or (right := after[left]) >= n or order.get(piece := parts[left] + parts[right]) != rank:
                continue  # one of the two has been joined meanwhile
            parts[left], parts[right] = piece, None
            after[left] = far = after[right]
            if far < n:
                before[far] = left
                if (k := order.get(piece + parts[far])) is not None:
                    heapq.heappush(agenda, k * n + left)
            if (near := before[left]) >= 0 and (k := order.get(parts[near] + piece)) is not None:
                heapq.heappush(agenda, k * n + near)
        return [p for p in parts if p is not None]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs of codes; -1 stands for no symbol."""
        key = (left.astype(np.int64) << 32) | right
        at = self._place(key)
        seen = self.pair[at]
        out = np.where(seen == key, self.rank[at], NEVER)
        todo = np.nonzero((seen != key) & (seen != -1))  # another pair has the place
        while len(todo[0]):
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            seen = self.pair[at[todo]]
            out[todo] = np.where(seen == key[todo], self.rank[at[todo]], NEVER)
            more = (seen != key[todo]) & (seen != -1)
            todo = tuple(t[more] for t in todo)
        return out

    def _matrix(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of many short strings, flat, and how many each has: their agendas are rows of a matrix, and each step joins the best pair of every row."""
        n, width = len(parts), max(map(len, parts))
        lengths = np.fromiter(map(len, parts), np.int64, n)
        codes = np.full((n, width + 1), -1, dtype=np.int32)
        codes[:, :width][np.arange(width) < lengths[:, None]] = self.by_point[np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), "<u4")]
        agenda = self._ranks(codes[:, :-1], codes[:, 1:])
        rows, cols = np.arange(n), np.arange(width)
        done = []
        while len(rows):
            at = agenda.argmin(axis=1)
            k = np.arange(len(rows))
            best = agenda[k, at]
            go = best != NEVER
            if not go.all():
                done.append((rows[~go], codes[~go]))
                rows, at, best, codes, agenda = rows[go], at[go], best[go], codes[go], agenda[go]
                k = k[: len(rows)]
            if not len(rows):
                break
            after = cols > at[:, None]
            codes[k, at] = self.by_rank[best]
            codes[:, :width] = np.where(after, codes[:, 1:], codes[:, :width])
            codes[:, width] = -1
            agenda[:, :-1] = np.where(after[:, :-1] | after[:, 1:], agenda[:, 1:], agenda[:, :-1])
            agenda[:, -1] = NEVER
            left = np.maximum(at - 1, 0)
            both = self._ranks(np.concatenate([codes[k, at], codes[k, left]]), np.concatenate([codes[k, at + 1], codes[k, at]]))
            agenda[k, at] = both[: len(k)]
            has = at > 0
            agenda[k[has], left[has]] = both[len(k) :][has]
        out = np.full((n, width + 1), -1, dtype=np.int32)
        for rows, codes in done:
            out[rows] = codes
        return self._spelt(out[out >= 0], np.repeat(np.arange(n), (out >= 0).sum(axis=1)), n)

    def _spelt(self, codes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Codes with the bytes of characters that are no piece in their place, and how many each row has."""
        odd, which = np.unique(codes[codes >= len(self.names)], return_inverse=True)
        if not len(odd):
            return codes, np.bincount(rows, minlength=n)
        spelt = [[self.bytes[f"<0x{b:02X}>"] for b in self.point[c].encode("utf-8", "surrogatepass")] if self.bytes else [self.model.unk_id()] for c in odd.tolist()]
        long = np.ones(len(codes), np.int64)
        at = np.flatnonzero(codes >= len(self.names))
        long[at] = np.fromiter(map(len, spelt), np.int64)[which]
        starts = np.cumsum(long) - long
        out = np.repeat(codes, long)
        for k in range(max(map(len, spelt))):
            more = long[at] > k
            out[starts[at[more]] + k] = np.array([s[min(k, len(s) - 1)] for s in spelt], np.int32)[which[more]]
        return out, np.bincount(rows, long, minlength=n).astype(np.int64)

    def encode_all(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of strings in order of length, flat, and how many each has: short ones together, long ones one by one."""
        flat, counts, at, top = [], [], 0, len(self.names)
        for high in BANDS:
            while at < len(parts) and len(parts[at]) <= high:
                some = parts[at : min(at + ROWS, len(parts))]
                while len(some[-1]) > high:
                    some.pop()
                codes, many = self._matrix(some)
                flat.append(codes)
                counts.append(many)
                at += len(some)
        for p in parts[at:]:
            ids = self.encode(p)
            flat.append(np.array(ids, np.int32))
            counts.append(np.array([len(ids)]))
        return np.concatenate([np.zeros(0, np.int32), *flat]), np.concatenate([np.zeros(0, np.int64), *counts])

    def decode(self, ids: list[int]) -> str:
        """The text of ids, with the white space that stands for the mark before the text still in front."""
        return b"".join(map(self.pieces.__getitem__, ids)).decode("utf-8", "replace")

    def checked(self, tokens: list[str]) -> dict[str, str]:
        """Each pre-token's ids, joined by a space; after a tab what they decode to, where that isn't the pre-token after a space, and after one more tab where the library had to correct it."""
        if not tokens:
            return {}
        tokens = sorted(tokens, key=len)
        flat, counts = self.encode_all([MARK + t.replace(" ", MARK) for t in tokens])
        theirs = library_ids(self.model, tokens)
        texts = self.model.decode(theirs, num_threads=1)
        lengths = np.fromiter(map(len, theirs), np.int64, len(theirs))
        ids = np.fromiter(chain.from_iterable(theirs), np.int64)
        parted = np.insert(ids, np.cumsum(lengths), len(self.names))  # with a sign after each pre-token
        coded = " ".join(map([*self.names, "|"].__getitem__, parted.tolist())).split(" |")[:-1]
        mine = b"".join(map([*self.pieces, b"\xff"].__getitem__, parted.tolist())).split(b"\xff")
        wrong = set() if np.array_equal(counts, lengths) and np.array_equal(flat, ids) else self._differing(flat, counts, theirs)
        out = {}
        for k, (t, joined, text, own) in enumerate(zip(tokens, coded, texts, mine)):
            if k in wrong or own.decode("utf-8", "replace") != f" {text}":
                out[t] = f"{joined.lstrip()}\t {text}\t"
            else:
                out[t] = joined.lstrip() if text == t else f"{joined.lstrip()}\t {text}"
        return out

    @staticmethod
    def _differing(flat: np.ndarray, counts: np.ndarray, theirs: list[list[int]]) -> set[int]:
        return {k for k, (e, n) in enumerate(zip(np.cumsum(counts), counts)) if flat[e - n : e].tolist() != theirs[k]}


@lru_cache(maxsize=4)
def codec(model_path: str) -> PieceCodec:
    return PieceCodec(model_path)


class _Known(dict):
    """What a task has found for pre-tokens; it starts anew when it is full."""

    def __init__(self, codec: PieceCodec, most: int):
        self.codec, self.most = codec, most

    def look_up(self, tokens: set[str]) -> dict[str, str]:
        """The codes of all of ``tokens``."""
        if len(self) + len(tokens) > self.most:
            self.clear()
        found = self.codec.checked(list(tokens - self.keys()))
        long = {t: x for t, x in found.items() if len(t) > CACHE_CHARS}
        self.update(found if not long else {t: x for t, x in found.items() if len(t) <= CACHE_CHARS})
        return {**self, **long} if long else self


def _by_bytes(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``most`` bytes of text in column 1."""
    for part in slices(batches, 4_096):
        sizes = np.cumsum([0, *(x.as_buffer().size for x in part.column(1))])
        at = 0
        while at < part.num_rows:
            end = max(at + 1, int(np.searchsorted(sizes, sizes[at] + most, "right")) - 1)
            yield part.slice(at, end - at)
            at = end


def piece_codes(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, with_text: bool = False) -> DataFrame:
    """Encode every whole text with an end id only, then decode the ids.

    Returns ``id_col``, ``n_tokens``, ``ids_sha256`` (of the decimal ids joined by a space), ``decoded_sha256``
    (of the decoded text) and ``agrees`` (false if the agenda or the tables gave anything else than the library, whose result is the one returned);
    on demand also ``ids`` and ``decoded_text``. Null and empty texts have the end
    id alone and decode to an empty text. Null ids and repeated rows are kept; columns other than the two are not
    read; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        known = _Known(c, CACHE_TOKENS)
        for part in _by_bytes(batches, SLICE_BYTES):
            texts = [pretokens(t) for t in part.column(1).to_pylist()]
            look = known.look_up(set().union(*texts))
            n, shas, texts_out, shas_out, ids_out, agree = [], [], [], [], [], []
            for tokens in texts:
                codes = list(map(look.__getitem__, tokens))
                ids = " ".join([*codes, c.names[c.end]])
                good = True
                if "\t" in ids:
                    split = [x.split("\t") for x in codes]
                    good = all(len(x) < 3 for x in split)
                    decoded = "".join([x[1] if len(x) > 1 else f" {t}" for t, x in zip(tokens, split)])[1:]
                    ids = " ".join([*[x[0] for x in split], c.names[c.end]])
                else:
                    decoded = " ".join(tokens)  # the space of the mark in front goes
                n.append(ids.count(" ") + 1)
                shas.append(hashlib.sha256(ids.encode()).hexdigest())
                shas_out.append(hashlib.sha256(decoded.encode()).hexdigest())
                agree.append(good)
                ids_out.append(list(map(int, ids.split(" "))) if with_ids else None)
                texts_out.append(decoded if with_text else None)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(n, pa.int64()), pa.array(shas, pa.string()), pa.array(shas_out, pa.string()), pa.array(agree), pa.array(ids_out, pa.list_(pa.int32())), pa.array(texts_out, pa.string())],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256", "agrees", "ids", "decoded_text"],
            )

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    coded = in_arrow(slim, run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string, agrees boolean, ids array<int>, decoded_text string")
    return coded.select(F.col("id").alias(id_col), "n_tokens", "ids_sha256", "decoded_sha256", "agrees", *["ids"] * with_ids, *["decoded_text"] * with_text)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return piece_codes(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
