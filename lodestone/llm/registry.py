"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from . import op6_topk as topk
from .op1_packing import op1_packing
from .op2_quality import op2_quality
from .op3_simhash import op3_simhash
from .op4_substring import op4_substring
from .op5_chat import op5_chat
from .op7_lattice import op7_lattice
from .op8_counts import op8_token_counts
from .op9_bpe import op9_bpe
from .op10_pii import op10_pii

QUERIES = {
    "op1_packing": op1_packing,
    "op2_quality": op2_quality,
    "op3_simhash": op3_simhash,
    "op4_substring": op4_substring,
    "op5_chat": op5_chat,
    "op6_topk": topk.op6_topk,
    "op7_lattice": op7_lattice,
    "op8_token_counts": op8_token_counts,
    "op9_bpe": op9_bpe,
    "op10_pii": op10_pii,
}

ORACLE_SQL = {"op6_topk": topk.ORACLE}
