"""The queries opN_<name> of this subpackage and, where SQL can express one, its DuckDB SQL."""

from __future__ import annotations

from . import decontamination, topk_search
from .chat_format import op9_chat_formatting
from .decontamination import op7_benchmark_decontamination
from .line_dedup import op4_line_dedup
from .minhash_dedup import op10_minhash_near_dedup
from .packing import op3_best_fit_packing
from .pii import op1_pii
from .substring_dedup import op8_substring_dedup
from .suffix_dedup import op5_suffix_array_dedup
from .topk_search import op6_exact_topk_search
from .toxicity import op2_toxicity

QUERIES = {
    "op1_pii": op1_pii,
    "op2_toxicity": op2_toxicity,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_line_dedup": op4_line_dedup,
    "op5_suffix_array_dedup": op5_suffix_array_dedup,
    "op6_exact_topk_search": op6_exact_topk_search,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
}

ORACLES: dict[str, str] = {
    "op6_exact_topk_search": topk_search.ORACLE,
    "op7_benchmark_decontamination": decontamination.ORACLE,
}
