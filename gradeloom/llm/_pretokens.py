"""Pre-tokens of merge-type sentencepiece vocabularies.

In these vocabularies white space is written as U+2581 and no piece has that mark after another
character. So no merge crosses from a character to a following mark, and a text can be cut before each
run of marks into pre-tokens that are encoded on their own. A pre-token is kept without its first mark,
with marks as spaces: exactly the string for which the library, which puts a mark before each string,
gives the pre-token's pieces. The one exception is a mark alone, kept as the empty string.
"""

from __future__ import annotations

import re
from functools import lru_cache

import sentencepiece

MARK = "▁"
_RUNS = re.compile(f"{MARK}+[^{MARK}]*")


def pretokens(text: str) -> list[str]:
    """The pre-tokens of a whole text, in order; empty for an empty text."""
    if not text:
        return []
    if MARK in text:
        text = text.replace(MARK, " ")
    if text[0] != " " and "  " not in text:
        return text.split(" ")
    return [x[1:].replace(MARK, " ") for x in _RUNS.findall(MARK + text.replace(" ", MARK))]


@lru_cache(maxsize=4)
def processor(model_path: str) -> sentencepiece.SentencePieceProcessor:
    """The library's processor, loaded once for each Python worker. Refuses vocabularies that can't be cut."""
    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    cut = re.compile(f"[^{MARK}]{MARK}")
    for i in range(model.get_piece_size()):
        if cut.search(model.id_to_piece(i)) and not model.is_control(i):
            raise ValueError(f"piece {i} has a white space mark inside; its vocabulary can't be cut at white space")
    return model


def library_ids(model: sentencepiece.SentencePieceProcessor, tokens: list[str]) -> list[list[int]]:
    """The library's ids of pre-tokens, in one call."""
    alone = [model.piece_to_id(MARK)]
    return [ids if t else alone for t, ids in zip(tokens, model.encode(tokens, num_threads=1))]
