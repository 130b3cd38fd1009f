"""Token counts and the piece codec equal the library on whole texts."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa

from gradeloom.llm import piece_codec as C
from gradeloom.llm import token_counts as K
from gradeloom.llm._pretokens import MARK, library_ids, processor

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_counts_and_codes_of_odd_rows(spark, odd, nothing):
    model = processor(MODEL)
    texts = sorted((r["doc_id"] or -1, r["text"] or "") for r in odd.collect())
    ids = [model.encode(t, add_eos=True) for _, t in texts]
    counts = sorted((r["doc_id"] or -1, r["n_tokens"], r["n_bytes"], r["over_limit"]) for r in K.token_counts(odd, MODEL).collect())
    assert counts == sorted((d, len(x) - 1, len(t.encode()), len(x) - 1 > 4096) for (d, t), x in zip(texts, ids))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    codes = sorted((r["doc_id"] or -1, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in C.piece_codes(odd, MODEL).collect())
    assert codes == sorted((d, len(x), sha(" ".join(map(str, x))), sha(model.decode(x))) for (d, _), x in zip(texts, ids))
    assert K.token_counts(nothing, MODEL).count() == 0 and C.piece_codes(nothing, MODEL).count() == 0


def test_real_ids_and_texts(spark, odd):
    rows = C.piece_codes(odd, MODEL, with_ids=True, with_text=True).filter("doc_id = 4").collect()
    assert len(rows) == 2 and rows[0]["ids"] == processor(MODEL).encode("Alpha beta\tgamma  delta\n epsilon zeta. 日本語 ꙮ ▁x", add_eos=True)
    assert rows[0]["decoded_text"] == processor(MODEL).decode(rows[0]["ids"])


def test_agendas_agree_with_the_library_on_random_strings():
    rng, codec, model = random.Random(3), C.codec(MODEL), processor(MODEL)
    texts = sorted(("".join(rng.choice("abcdeth éü日本1#.\n<ꙮs>") for _ in range(rng.randint(0, 130))) for _ in range(400)), key=len)
    marked = [MARK + t.replace(" ", MARK) for t in texts]
    flat, counts = codec.encode_all(marked)
    theirs = library_ids(model, texts)
    assert flat.tolist() == [i for ids in theirs for i in ids] and counts.tolist() == list(map(len, theirs))
    assert all(codec.encode(m) == ids for m, ids in zip(marked, theirs))
    assert all(codec.decode(ids)[1:] == model.decode(ids) for ids in theirs)


def test_where_agenda_and_library_differ_the_library_stands(spark, odd, monkeypatch):
    good = {r["doc_id"]: r for r in C.piece_codes(odd, MODEL).collect()}
    assert all(r["agrees"] for r in good.values())
    codec = C.PieceCodec(MODEL)
    codec.rank = np.where(codec.rank == C.NEVER, C.NEVER, len(codec.order) - codec.rank).astype(np.int32)  # the worst pair first
    found = codec.checked(["Alpha", ""])
    assert found["Alpha"].split("\t")[0] == " ".join(map(str, processor(MODEL).encode("Alpha"))) and found["Alpha"].endswith("\t") and "\t" not in found[""]


def test_slices_by_bytes_keep_all_rows():
    part = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(["", "x" * 50, "y", "z" * 9, "", "w" * 200, "v"])], ["id", "text"])
    got = [b.column(0).to_pylist() for b in C._by_bytes(iter([part, part.slice(0, 0)]), 20)]
    assert sum(got, []) == list(range(7)) and [5] in got


def test_a_small_table_and_cache_change_nothing(spark, odd, monkeypatch):
    full = sorted(map(str, K.token_counts(odd, MODEL).collect()))
    assert sorted(map(str, K.token_counts(odd, MODEL, table_size=2).collect())) == full
