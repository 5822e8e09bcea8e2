"""The queries of this package, with their SQL where SQL can express them."""

from __future__ import annotations

from . import ann, bpe, hard_negatives, jaccard, line_dedup, minhash, mixing, prefix_trie, quality, sharding, sstable, suffix_dedup, toxicity

QUERIES = {
    "op1_mix_sources": mixing.op1,
    "op2_sorted_string_tables": sstable.op2,
    "op3_sampled_splitters": sharding.op3,
    "op4_line_suffix_array": line_dedup.op4,
    "op5_line_frequency": quality.op5,
    "op6_byte_bpe": bpe.op6,
    "op7_factorization_machine": toxicity.op7,
    "op8_induced_suffix_array": suffix_dedup.op8,
    "op9_projection_forest": ann.op9,
    "op10_token_group_matrix": jaccard.op10,
    "op11_minhash": minhash.op11,
    "op12_prefix_trie": prefix_trie.op12,
    "op13_hard_negatives": hard_negatives.op13,
}

ORACLES = {
    "op1_mix_sources": mixing.OP1_SQL,
    "op4_line_suffix_array": line_dedup.OP4_SQL,
    "op5_line_frequency": quality.OP5_SQL,
    "op12_prefix_trie": prefix_trie.OP12_SQL,
    "op13_hard_negatives": hard_negatives.OP13_SQL,
}
