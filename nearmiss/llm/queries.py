"""Registered queries of the training-data operators and their DuckDB checks."""

from __future__ import annotations

from nearmiss.llm.bpe_pairs import op10_bpe_pairs
from nearmiss.llm.divergence_audit import OP13_SQL, op13_divergence_audit
from nearmiss.llm.exact_dedup import OP6_SQL, op6_exact_dedup
from nearmiss.llm.filter_audit import OP12_SQL, op12_filter_audit
from nearmiss.llm.jaccard_join import OP7_SQL, op7_jaccard_join
from nearmiss.llm.language_id import op5_language_id
from nearmiss.llm.license_scan import OP1_SQL, op1_license_scan
from nearmiss.llm.packing import op9_best_fit_packing
from nearmiss.llm.quality_rules import op3_quality_rules
from nearmiss.llm.secret_scan import OP11_SQL, op11_secret_scan
from nearmiss.llm.token_counts import op2_token_counts
from nearmiss.llm.toxicity import op4_toxicity
from nearmiss.llm.training_order import op8_training_order

QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_token_counts": op2_token_counts,
    "op3_quality_rules": op3_quality_rules,
    "op4_toxicity": op4_toxicity,
    "op5_language_id": op5_language_id,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_training_order": op8_training_order,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_bpe_pairs": op10_bpe_pairs,
    "op11_secret_scan": op11_secret_scan,
    "op12_filter_audit": op12_filter_audit,
    "op13_divergence_audit": op13_divergence_audit,
}

SQL = {"op1_license_scan": OP1_SQL, "op6_exact_dedup": OP6_SQL, "op7_jaccard_join": OP7_SQL,
       "op11_secret_scan": OP11_SQL, "op12_filter_audit": OP12_SQL, "op13_divergence_audit": OP13_SQL}
