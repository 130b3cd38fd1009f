"""The registered queries of this subpackage and the SQL that gives their rows where SQL can."""

from __future__ import annotations

from gradeloom.llm.conversation_trie import OP11_SQL, op11_conversation_trie
from gradeloom.llm.html_consensus import op5_html_text
from gradeloom.llm.license_scan import op2_license_scan
from gradeloom.llm.media import op4_media
from gradeloom.llm.minhash_dedup import OP12_SQL, op12_minhash_dedup
from gradeloom.llm.mixing import op9_mixing
from gradeloom.llm.ngram_join import OP7_SQL, op7_ngram_join
from gradeloom.llm.piece_codec import op6_sentencepiece
from gradeloom.llm.quality import op3_quality
from gradeloom.llm.sketch import OP10_SQL, op10_fingerprints
from gradeloom.llm.token_alignment import op13_token_alignment
from gradeloom.llm.token_counts import op1_token_counts
from gradeloom.llm.toxicity import op8_toxicity

QUERIES = {f.__name__: f for f in (op1_token_counts, op2_license_scan, op3_quality, op4_media, op5_html_text, op6_sentencepiece, op7_ngram_join, op8_toxicity, op9_mixing, op10_fingerprints, op11_conversation_trie, op12_minhash_dedup, op13_token_alignment)}

SQL: dict[str, str] = {"op7_ngram_join": OP7_SQL, "op10_fingerprints": OP10_SQL, "op11_conversation_trie": OP11_SQL, "op12_minhash_dedup": OP12_SQL}
