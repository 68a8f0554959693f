"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from .decontaminate import OP6_SQL, op6_benchmark_decontamination
from .embedding import op5_embedding_near_dedup
from .langid import op9_language_id
from .licenses import op3_license_scan
from .merkle import OP13_SQL, op13_merkle_manifest
from .negatives import OP12_SQL, op12_hard_negatives
from .packing import op10_best_fit_packing
from .quality import op2_quality_classifier
from .secrets import OP11_SQL, op11_secret_scan
from .simhash import op7_simhash_near_dedup
from .sstable import op8_token_shards
from .substring import OP4_SQL, op4_substring_dedup
from .toxicity import op1_toxicity

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_license_scan": op3_license_scan,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_embedding_near_dedup": op5_embedding_near_dedup,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_token_shards": op8_token_shards,
    "op9_language_id": op9_language_id,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_secret_scan": op11_secret_scan,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_merkle_manifest": op13_merkle_manifest,
}

#: The others rest on trained models, XXH64, tokenizers or files; tests hold them against brute force, held-out labels and round trips.
ORACLES = {"op4_substring_dedup": OP4_SQL, "op6_benchmark_decontamination": OP6_SQL, "op11_secret_scan": OP11_SQL, "op12_hard_negatives": OP12_SQL, "op13_merkle_manifest": OP13_SQL}
