"""The queries of this subpackage and, where SQL can express one, its SQL for DuckDB."""

from __future__ import annotations

from framesift.llm.bpe import op10_bpe_encoding
from framesift.llm.chat import OP2_SQL, op2_chat_perspectives
from framesift.llm.hardneg import OP13_SQL, op13_hard_negatives
from framesift.llm.langid import op6_language_id
from framesift.llm.leaks import op8_benchmark_leaks
from framesift.llm.licenses import OP7_SQL, op7_license_scan
from framesift.llm.neardup import op9_near_duplicates
from framesift.llm.phrases import OP12_SQL, op12_collocations
from framesift.llm.setjoin import OP11_SQL, op11_jaccard_join
from framesift.llm.simhash import op3_simhash_fingerprints
from framesift.llm.suffixes import op4_suffix_dedup
from framesift.llm.toxicity import op1_toxicity_crf
from framesift.llm.urls import op5_url_filter

QUERIES = {f.__name__: f for f in (op1_toxicity_crf, op2_chat_perspectives, op3_simhash_fingerprints, op4_suffix_dedup, op5_url_filter, op6_language_id, op7_license_scan, op8_benchmark_leaks, op9_near_duplicates, op10_bpe_encoding, op11_jaccard_join, op12_collocations, op13_hard_negatives)}
ORACLE_SQL: dict[str, str] = {"op2_chat_perspectives": OP2_SQL, "op7_license_scan": OP7_SQL, "op11_jaccard_join": OP11_SQL, "op12_collocations": OP12_SQL, "op13_hard_negatives": OP13_SQL}
