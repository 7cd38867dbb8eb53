"""The subpackage's queries and their SQL, for the entry module."""

from __future__ import annotations

from . import bpe, exact_dedup, licenses, lm, near_dedup, packing, pii, quality, secrets_scan, suffix_dedup

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_bpe": bpe.op2_bpe,
    "op3_pii": pii.op3_pii,
    "op4_best_fit_packing": packing.op4_best_fit_packing,
    "op5_minhash_near_dedup": near_dedup.op5_minhash_near_dedup,
    "op6_secret_scan": secrets_scan.op6_secret_scan,
    "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
    "op8_license_scan": licenses.op8_license_scan,
    "op9_lm_scoring": lm.op9_lm_scoring,
    "op10_quality_rules": quality.op10_quality_rules,
}
#: Where SQL can express the whole result and stays fast on whole tables.
ORACLES = {"op1_exact_dedup": exact_dedup.OP1_SQL}
