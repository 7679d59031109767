"""The queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from .bpe import op8
from .fingerprint import op3
from .html import OP4_SQL, op4
from .language import op6
from .lines import OP5_SQL, op5
from .packing import op2
from .simhash import op10
from .suffixes import OP7_SQL, op7
from .topk import OP1_SQL, op1
from .urls import OP9_SQL, op9

QUERIES = {
    "op1_topk_segments": op1,
    "op2_pattern_packing": op2,
    "op3_fingerprints": op3,
    "op4_wrapper_text": op4,
    "op5_line_deletions": op5,
    "op6_language_id": op6,
    "op7_prefix_free_repeats": op7,
    "op8_byte_bpe": op8,
    "op9_url_trust": op9,
    "op10_simhash_golay": op10,
}

ORACLE_SQL: dict[str, str] = {
    "op1_topk_segments": OP1_SQL,
    "op4_wrapper_text": OP4_SQL,
    "op5_line_deletions": OP5_SQL,
    "op7_prefix_free_repeats": OP7_SQL,
    "op9_url_trust": OP9_SQL,
}
