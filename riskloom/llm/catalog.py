"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from .alignment import op12_tokenizer_alignment
from .decontam import op5_decontamination
from .langid import op4_language_id
from .lines import OP10_SQL, op10_line_dedup
from .lm import op9_lm_scoring
from .mixing import op2_mixing
from .pii import op3_pii
from .quality import op7_quality
from .simhash import op1_simhash_near_dedup
from .spelling import op11_spelling_variants
from .tokenfile import op6_token_output
from .topk import OP8_SQL, op8_exact_top_k
from .toxicity import op13_toxicity

QUERIES = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_mixing": op2_mixing,
    "op3_pii": op3_pii,
    "op4_language_id": op4_language_id,
    "op5_decontamination": op5_decontamination,
    "op6_token_output": op6_token_output,
    "op7_quality": op7_quality,
    "op8_exact_top_k": op8_exact_top_k,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_line_dedup": op10_line_dedup,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_tokenizer_alignment": op12_tokenizer_alignment,
    "op13_toxicity": op13_toxicity,
}

ORACLES = {
    "op8_exact_top_k": OP8_SQL,
    "op10_line_dedup": OP10_SQL,
}
