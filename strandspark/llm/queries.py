"""The queries of this subpackage and their oracle SQL, by name."""

from __future__ import annotations

from .ann import op10_ann
from .decontaminate import OP5_SQL, op5_decontaminate
from .html_extract import op7_html_extract
from .jaccard_join import op4_jaccard_join
from .lm_score import op3_lm_score
from .mixing import OP1_SQL, op1_mixing
from .sharding import op6_sharding
from .suffix_dedup import op8_suffix_dedup
from .toxicity import op9_toxicity
from .url_filter import OP2_SQL, op2_url_filter

QUERIES = {"op1_mixing": op1_mixing, "op2_url_filter": op2_url_filter, "op3_lm_score": op3_lm_score, "op4_jaccard_join": op4_jaccard_join, "op5_decontaminate": op5_decontaminate, "op6_sharding": op6_sharding, "op7_html_extract": op7_html_extract, "op8_suffix_dedup": op8_suffix_dedup, "op9_toxicity": op9_toxicity, "op10_ann": op10_ann}
ORACLE_SQL = {"op1_mixing": OP1_SQL, "op2_url_filter": OP2_SQL, "op5_decontaminate": OP5_SQL}
