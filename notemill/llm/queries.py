"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

import corpus_pipeline
from notemill.llm import decontaminate, license_scan, line_dedup, mixing, packing, pii, prefix_trie, quality, secret_scan, sharding, simhash_dedup, url_filter, whitening

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_license_scan": license_scan.op2_license_scan,
    "op3_simhash_dedup": simhash_dedup.op3_simhash_dedup,
    "op4_packing": packing.op4_packing,
    "op5_secret_scan": secret_scan.op5_secret_scan,
    "op6_decontamination": decontaminate.op6_decontamination,
    "op7_url_filter": url_filter.op7_url_filter,
    "op8_quality_rules": quality.op8_quality_rules,
    "op9_pii": pii.op9_pii,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op11_mixing": mixing.op11_mixing,
    "op12_whitening": whitening.op12_whitening,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {"op1_sharding": sharding.OP1_SQL, "op2_license_scan": license_scan.OP2_SQL, "op5_secret_scan": secret_scan.OP5_SQL, "op10_line_dedup": line_dedup.OP10_SQL, "op13_prefix_trie": prefix_trie.OP13_SQL}
