"""Queries of this subpackage, with SQL where SQL can say the same."""

from quillspark.llm import alignment, exact_dedup, jaccard_join, language_id, line_dedup, mixing, one_bit_search, packing, prefix_trie, quality, token_store, vector_dedup, warc

QUERIES = {
    "op1_kneser_ney_quality": quality.query,
    "op2_partition_jaccard_join": jaccard_join.query,
    "op3_elias_fano_tokens": token_store.query,
    "op4_subword_language_id": language_id.query,
    "op5_bin_completion_packing": packing.query,
    "op6_pivotal_mixing": mixing.query,
    "mixing_targets": mixing.query_targets,
    "op7_dictionary_warc": warc.query,
    "op8_projection_forest_dedup": vector_dedup.query,
    "op9_streaming_exact_dedup": exact_dedup.query,
    "op10_bloom_line_dedup": line_dedup.query,
    "op11_cross_alignment": alignment.query,
    "op12_prefix_trie": prefix_trie.query,
    "op13_one_bit_search": one_bit_search.query,
}

SQL = {
    "mixing_targets": mixing.TARGETS_SQL,
    "op7_dictionary_warc": warc.SQL,
    "op9_streaming_exact_dedup": exact_dedup.SQL,
    "op10_bloom_line_dedup": line_dedup.SQL,
    "op12_prefix_trie": prefix_trie.SQL,
    "op13_one_bit_search": one_bit_search.SQL,
}
