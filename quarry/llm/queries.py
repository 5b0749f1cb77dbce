"""Registered queries of the llm operators and their SQL twins."""

from __future__ import annotations

from quarry.llm.chat import op10_chat_formatting
from quarry.llm.decontaminate import op5_decontamination
from quarry.llm.jaccard_join import op1_jaccard_join
from quarry.llm.line_dedup import op8_line_dedup
from quarry.llm.maxscore import op6_maxscore_topk
from quarry.llm.mixing import op9_mixing
from quarry.llm.oracles import ORACLES
from quarry.llm.pii import op4_pii
from quarry.llm.sharding import op2_sharding
from quarry.llm.spelling import op12_spelling_variants
from quarry.llm.substring_dedup import op7_substring_dedup
from quarry.llm.token_counts import op13_token_counts
from quarry.llm.toxicity import op3_toxicity
from quarry.llm.vector_codes import op11_vector_codes


def queries():
    found = [op1_jaccard_join, op2_sharding, op3_toxicity, op4_pii, op5_decontamination, op6_maxscore_topk,
             op7_substring_dedup, op8_line_dedup, op9_mixing, op10_chat_formatting,
             op11_vector_codes, op12_spelling_variants, op13_token_counts]
    return {f.__name__: f for f in found}


def oracle_sql():
    return dict(ORACLES)
