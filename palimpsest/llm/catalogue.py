"""Queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, decontaminate, divergence, licenses, mixing, neighbours, periodic, repeats, simhash, token_counts, token_files, toxicity, url_rules

QUERIES = {
    "op1_token_files": token_files.op1_token_files,
    "op2_simhash": simhash.op2_simhash,
    "op3_repeats": repeats.op3_repeats,
    "op4_licenses": licenses.op4_licenses,
    "op5_url_filters": url_rules.op5_url_filters,
    "op6_bpe": bpe.op6_bpe,
    "op7_neighbours": neighbours.op7_neighbours,
    "op8_decontamination": decontaminate.op8_decontamination,
    "op9_token_counts": token_counts.op9_token_counts,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_periodic_runs": periodic.op11_periodic_runs,
    "op12_divergence": divergence.op12_divergence,
    "op13_lm_scores": mixing.op13_lm_scores,
}

#: The others hash, encode or learn in ways that SQL has no functions for; they are tested against brute force.
ORACLE_SQL: dict[str, str] = {"op5_url_filters": url_rules.ORACLE_SQL, "op12_divergence": divergence.ORACLE_SQL}
