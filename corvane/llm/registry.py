"""Queries of this subpackage, and the SQL that gives the same rows where there is any."""

from __future__ import annotations

from . import compression_quality, exact_topk, language_id, line_dedup, line_quality, merkle, packing, piece_codec, pii, simhash, token_attribution, vector_codes, vector_copies

_QUERIES = {
    "op1_language_id": language_id,
    "op2_bestfit_packing": packing,
    "op3_simhash_neardup": simhash,
    "op4_pii_surrogates": pii,
    "op5_line_quality": line_quality,
    "op6_exact_topk": exact_topk,
    "op7_line_dedup": line_dedup,
    "op8_token_attribution": token_attribution,
    "op9_piece_codec": piece_codec,
    "op10_compression_quality": compression_quality,
    "op11_vector_copies": vector_copies,
    "op12_vector_codes": vector_codes,
    "op13_merkle_manifest": merkle,
}


def queries():
    import corpus_pipeline

    return {name: m.query for name, m in _QUERIES.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql():
    import corpus_pipeline

    found = {name: m.SQL for name, m in _QUERIES.items() if getattr(m, "SQL", None)}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
