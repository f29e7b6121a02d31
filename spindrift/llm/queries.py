"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, embeddings, langid, neighbours, packing, periods, pii, quality, secrets, simhash, spellings, tokens, topk


QUERIES = {
    "op1_token_files": tokens.query,
    "op2_language_id": langid.query,
    "op3_quality": quality.query,
    "op4_byte_bpe": bpe.query,
    "op5_embedding_near_dedup": embeddings.query,
    "op6_top_k": topk.query,
    "op7_secrets": secrets.query,
    "op8_packing": packing.query,
    "op9_pii": pii.query,
    "op10_simhash_near_dedup": simhash.query,
    "op11_periodic_runs": periods.query,
    "op12_nearest_neighbours": neighbours.query,
    "op13_spelling_variants": spellings.query,
}
ORACLES = {"op5_embedding_near_dedup": embeddings.ORACLE, "op6_top_k": topk.ORACLE}
