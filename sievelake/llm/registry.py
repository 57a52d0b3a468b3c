"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import ann, chat, manifest, mixing, ngram_join, packing, passages, pii, repetition, resampling, sharding, token_files, toxicity

QUERIES = {
    "op1_repair_ids": token_files.op1_repair_ids,
    "op2_suffix_repetition": repetition.op2_suffix_repetition,
    "op3_histogram_shards": sharding.op3_histogram_shards,
    "op4_boosted_pii": pii.op4_boosted_pii,
    "op5_offset_masks": chat.op5_offset_masks,
    "op6_rtree_jaccard": ngram_join.op6_rtree_jaccard,
    "op7_systematic_mix": mixing.op7_systematic_mix,
    "op8_length_buckets": packing.op8_length_buckets,
    "op9_chained_passages": passages.op9_chained_passages,
    "op10_one_bit_search": ann.op10_one_bit_search,
    "op11_merkle_manifest": manifest.op11_merkle_manifest,
    "op12_subsequence_toxicity": toxicity.op12_subsequence_toxicity,
    "op13_target_resampling": resampling.op13_target_resampling,
}

ORACLE_SQL = {
    "op5_offset_masks": chat.OP5_SQL,
    "op6_rtree_jaccard": ngram_join.OP6_SQL,
    "op7_systematic_mix": mixing.OP7_SQL,
    "op10_one_bit_search": ann.OP10_SQL,
    "op11_merkle_manifest": manifest.OP11_SQL,
    "op13_target_resampling": resampling.OP13_SQL,
}
