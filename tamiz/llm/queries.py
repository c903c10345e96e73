"""Registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from .byte_bpe import op11_byte_bpe
from .centroids import OP12_SQL, op12_centroids
from .exact_dedup import OP7_SQL, op7_exact_dedup
from .fill_in_middle import OP13_SQL, op13_fill_in_middle
from .language_id import op8_language_id, page_languages
from .mixing import op2_cube_mix
from .near_vectors import op9_near_vectors
from .ngram_join import op4_jaccard_join
from .packing import op10_pack
from .secrets import op3_secret_scan
from .substring_dedup import op6_substring_dedup
from .suffix_array import op1_suffix_array
from .toxicity import op5_toxicity

QUERIES = {f.__name__: f for f in (op1_suffix_array, op2_cube_mix, op3_secret_scan, op4_jaccard_join, op5_toxicity, op6_substring_dedup, op7_exact_dedup, op8_language_id, op9_near_vectors, op10_pack, op11_byte_bpe, op12_centroids, op13_fill_in_middle)}
QUERIES["llm_page_languages"] = page_languages
SQL = {"op7_exact_dedup": OP7_SQL, "op12_centroids": OP12_SQL, "op13_fill_in_middle": OP13_SQL}
