"""The queries of this package and their SQL."""

from sensorloom.llm import ctw, divergence, exact_dedup, fingerprints, licenses, mixing, near_dup, packing, shards, topk, toxicity, url_lists, whitening

QUERIES = {
    "op1_min_slack_packing": (packing.op1_min_slack_packing, None),
    "op2_exact_top_k": (topk.op2_exact_top_k, topk.SQL),
    "op3_exact_dedup": (exact_dedup.op3_exact_dedup, exact_dedup.SQL),
    "op4_toxicity_field": (toxicity.op4_toxicity_field, None),
    "op5_two_pass_shards": (shards.op5_two_pass_shards, None),
    "op6_context_tree_weighting": (ctw.op6_context_tree_weighting, None),
    "op7_temporal_url_filter": (url_lists.op7_temporal_url_filter, url_lists.SQL),
    "op8_license_scan": (licenses.op8_license_scan, None),
    "op9_ngram_jaccard_join": (near_dup.op9_ngram_jaccard_join, None),
    "op10_source_mix": (mixing.op10_source_mix, None),
    "op11_source_divergence": (divergence.op11_source_divergence, divergence.SQL),
    "op12_document_fingerprints": (fingerprints.op12_document_fingerprints, None),
    "op13_whitened_embeddings": (whitening.op13_whitened_embeddings, None),
}
