"""Registered queries of this subpackage and their DuckDB statements."""

from __future__ import annotations

from jobmargin.llm import chat_format, collocations, lines, mixing
from jobmargin.llm.best_fit import op7_best_fit_packing
from jobmargin.llm.maxent import op10_maxent_scores
from jobmargin.llm.periodic import op13_periodic_runs
from jobmargin.llm.pivots import op6_pivot_top_k
from jobmargin.llm.projections import op8_projection_near_dedup
from jobmargin.llm.quality import op2_quality
from jobmargin.llm.simhash import op5_simhash_near_dedup
from jobmargin.llm.token_counts import op9_token_counts
from jobmargin.llm.toxicity import op4_toxicity

QUERIES = {function.__name__: function for function in (
    lines.op1_line_dedup, op2_quality, mixing.op3_source_mixing, op4_toxicity, op5_simhash_near_dedup, op6_pivot_top_k, op7_best_fit_packing, op8_projection_near_dedup, op9_token_counts,
    op10_maxent_scores, chat_format.op11_chat_formatting, collocations.op12_phrase_collocations, op13_periodic_runs,
)}

STATEMENTS = {"op1_line_dedup": lines.ORACLE, "op3_source_mixing": mixing.ORACLE, "op11_chat_formatting": chat_format.ORACLE, "op12_phrase_collocations": collocations.ORACLE}
