"""The queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

from . import jaccard, language, mixing, packing, passages, pii, quality, spelling, token_counts, token_output, vectors, whitening

QUERIES = {
    "op1_token_shards": token_output.op1_token_shards,
    "op2_jaccard_components": jaccard.op2_jaccard_components,
    "op3_mix_sources": mixing.op3_mix_sources,
    "op4_repeated_passages": passages.op4_repeated_passages,
    "op5_near_duplicate_vectors": vectors.op5_near_duplicate_vectors,
    "op6_quality": quality.op6_quality,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_nearest_vectors": vectors.op8_nearest_vectors,
    "op9_pii": pii.op9_pii,
    "op10_pack_documents": packing.op10_pack_documents,
    "op11_spelling_variants": spelling.op11_spelling_variants,
    "op12_languages": language.op12_languages,
    "op13_whitened_vectors": whitening.op13_whitened_vectors,
}
SQL = {"op3_mix_sources": mixing.OP3_SQL}
