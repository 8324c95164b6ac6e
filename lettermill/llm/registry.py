"""The queries of this package by name, and the SQL that gives the same rows where SQL can express them."""

from __future__ import annotations

from .bpe import op7_byte_bpe
from .conversation_repair import OP13_SQL, op13_conversation_repair
from .fingerprint import op6_fingerprints
from .fm_index import OP9_SQL, op9_benchmark_phrases
from .html_density import op5_page_texts
from .language_crf import op1_language
from .line_spread import OP8_SQL, op8_spread_lines
from .ngram_join import op2_jaccard_join
from .spelling import OP11_SQL, op11_spelling_variants
from .token_counts import op3_token_counts
from .toxicity import op4_toxicity
from .tree_bpe import op12_tree_bpe
from .wavelet import op10_token_files

QUERIES = {
    "op1_language": op1_language,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_token_counts": op3_token_counts,
    "op4_toxicity": op4_toxicity,
    "op5_page_texts": op5_page_texts,
    "op6_fingerprints": op6_fingerprints,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_spread_lines": op8_spread_lines,
    "op9_benchmark_phrases": op9_benchmark_phrases,
    "op10_token_files": op10_token_files,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_tree_bpe": op12_tree_bpe,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLE_SQL: dict[str, str] = {
    "op8_spread_lines": OP8_SQL,
    "op9_benchmark_phrases": OP9_SQL,
    "op11_spelling_variants": OP11_SQL,
    "op13_conversation_repair": OP13_SQL,
}
