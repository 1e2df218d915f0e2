"""The registered queries of this subpackage, one per operator, and SQL where it can express them."""

from wordloom.llm import ann, chat, mixing, ngram_join, oracles, quality, sharding, spm, tiff, token_lengths, toxicity

QUERIES = {
    "op1_tiff": tiff.op1_tiff,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_chat_masks": chat.op3_chat_masks,
    "op4_length_histogram": token_lengths.op4_length_histogram,
    "op5_quality": quality.op5_quality,
    "op6_sentencepiece": spm.op6_sentencepiece,
    "op7_consistent_ring": sharding.op7_consistent_ring,
    "op8_source_mix": mixing.op8_source_mix,
    "op9_signature_tree_join": ngram_join.op9_signature_tree_join,
    "op10_balanced_lists": ann.op10_balanced_lists,
}

ORACLE_SQL: dict[str, str] = oracles.ORACLE_SQL
