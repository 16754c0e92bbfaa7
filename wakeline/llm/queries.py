"""Registered queries of this subpackage and their DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from wakeline.llm.bpe import op4_bpe
from wakeline.llm.decontamination import op9_decontamination
from wakeline.llm.fixity import OP1_SQL, op1_fixity
from wakeline.llm.knn import OP2_SQL, op2_knn
from wakeline.llm.line_dedup import OP8_SQL, op8_line_dedup
from wakeline.llm.near_dup import op7_near_dup
from wakeline.llm.resampling import op3_resampling
from wakeline.llm.suffix_dedup import op10_suffix_dedup
from wakeline.llm.toxicity import op5_toxicity
from wakeline.llm.url_filter import OP6_SQL, op6_url_filters

QUERIES = {
    "op10_suffix_dedup": op10_suffix_dedup,
    "op7_near_dup": op7_near_dup,
    "op9_decontamination": op9_decontamination,
    "op8_line_dedup": op8_line_dedup,
    "op1_fixity": op1_fixity,
    "op3_resampling": op3_resampling,
    "op5_toxicity": op5_toxicity,
    "op2_knn": op2_knn,
    "op4_bpe": op4_bpe,
    "op6_url_filters": op6_url_filters,
}

ORACLE_SQL = {
    "op8_line_dedup": OP8_SQL,
    "op1_fixity": OP1_SQL,
    "op2_knn": OP2_SQL,
    "op6_url_filters": OP6_SQL,
}
