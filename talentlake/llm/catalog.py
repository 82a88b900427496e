"""Queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from .alignment import op11_token_alignment
from .decontaminate import OP5_SQL, op5_decontaminate
from .divergence import OP13_SQL, op13_source_divergence
from .exact_dedup import OP6_SQL, op6_exact_dedup
from .html_text import op9_html_text
from .lm_score import op4_lm_score
from .mixing import OP7_SQL, op7_mixing
from .personal_data import op3_personal_data
from .secret_scan import OP12_SQL, op12_secret_scan
from .simhash import op2_simhash
from .tool_calls import OP10_SQL, op10_tool_calls
from .toxicity import op8_toxicity
from .warc import OP1_SQL, op1_warc

QUERIES = {
    "op1_warc": op1_warc,
    "op2_simhash": op2_simhash,
    "op3_personal_data": op3_personal_data,
    "op4_lm_score": op4_lm_score,
    "op5_decontaminate": op5_decontaminate,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_mixing": op7_mixing,
    "op8_toxicity": op8_toxicity,
    "op9_html_text": op9_html_text,
    "op10_tool_calls": op10_tool_calls,
    "op11_token_alignment": op11_token_alignment,
    "op12_secret_scan": op12_secret_scan,
    "op13_source_divergence": op13_source_divergence,
}

SQL = {
    "op1_warc": OP1_SQL,
    "op5_decontaminate": OP5_SQL,
    "op6_exact_dedup": OP6_SQL,
    "op7_mixing": OP7_SQL,
    "op10_tool_calls": OP10_SQL,
    "op12_secret_scan": OP12_SQL,
    "op13_source_divergence": OP13_SQL,
}
