"""Queries and DuckDB texts of this folder, by name."""

from __future__ import annotations

from stepfree.llm import codes, compression, html, jaccard, lines, markov, mixing, packing, quality, search, simhash, toxicity, whitening

_QUERIES = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_line_dedup": lines.op2_line_dedup,
    "op3_quality_rules": quality.op3_quality_rules,
    "op4_extract_text": html.op4_extract_text,
    "op5_jaccard_join": jaccard.op5_jaccard_join,
    "op6_top_k": search.op6_top_k,
    "op7_pack_documents": packing.op7_pack_documents,
    "op8_score_language": markov.op8_score_language,
    "op9_score_quality": compression.op9_score_quality,
    "op10_score_toxicity": toxicity.op10_score_toxicity,
    "op11_whiten": whitening.op11_whiten,
    "op12_code_vectors": codes.op12_code_vectors,
    "op13_simhash": simhash.op13_simhash,
}

_SQL = {
    "op1_mix_sources": mixing.OP1_SQL,
    "op2_line_dedup": lines.OP2_SQL,
    "op6_top_k": search.OP6_SQL,
}


def queries() -> dict:
    import corpus_pipeline

    return _QUERIES | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    return _SQL | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
