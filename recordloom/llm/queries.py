"""The corpus operators' queries by name, and their SQL where there is one."""

from __future__ import annotations

from . import bitpack, bpe, fingerprints, licenses, ngram_join, packing, quality, secrets, substring_dedup, toxicity

QUERIES = {
    "op1_retrieval_packing": packing.op1_retrieval_packing,
    "op2_weighted_sampling": fingerprints.op2_weighted_sampling,
    "op3_bit_packing": bitpack.op3_bit_packing,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_ngram_join": ngram_join.op5_ngram_join,
    "op6_secrets": secrets.op6_secrets,
    "op7_licenses": licenses.op7_licenses,
    "op8_substring_dedup": substring_dedup.op8_substring_dedup,
    "op9_quality": quality.op9_quality,
    "op10_bpe": bpe.op10_bpe,
}

SQL = {
    "op5_ngram_join": ngram_join.OP5_SQL,
    "op8_substring_dedup": substring_dedup.OP8_SQL,
}
