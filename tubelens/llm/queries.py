"""One query per operator, and SQL where SQL can express it."""
from __future__ import annotations

from tubelens.llm import bpe, bytedup, decontaminate, exact, filter_audit, langid, licenses, lm, minhash, negatives, shards, substring, toxicity

QUERIES = {f.__name__: f for f in (
    exact.op1_exact_dedup, minhash.op2_minhash, licenses.op3_license_scan, shards.op4_sharding, substring.op5_substring_dedup, decontaminate.op6_decontaminate, langid.op7_langid, bpe.op8_bpe, bytedup.op9_suffix_dedup, toxicity.op10_toxicity,
    negatives.op11_hard_negatives, lm.op12_lm_score, filter_audit.op13_filter_audit)}
SQL = {"op1_exact_dedup": exact.SQL, "op5_substring_dedup": substring.SQL, "op11_hard_negatives": negatives.SQL, "op13_filter_audit": filter_audit.SQL}
