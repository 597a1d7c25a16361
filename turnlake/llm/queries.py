"""The registered queries of this subpackage, and SQL for those that it can express."""

from __future__ import annotations

from turnlake.llm import fingerprints, language_id, line_dedup, neighbours, packing, quality, sentencepieces, simhash, toxicity, warc

QUERIES = {
    "op1_document_fingerprints": fingerprints.op1_document_fingerprints,
    "op2_language_id": language_id.op2_language_id,
    "op3_sentencepiece": sentencepieces.op3_sentencepiece,
    "op4_nearest_neighbours": neighbours.op4_nearest_neighbours,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_warc": warc.op6_warc,
    "op7_best_fit_packing": packing.op7_best_fit_packing,
    "op8_simhash_near_dedup": simhash.op8_simhash_near_dedup,
    "op9_quality_classifier": quality.op9_quality_classifier,
    "op10_line_dedup": line_dedup.op10_line_dedup,
}

ORACLE = {"op6_warc": warc.ORACLE, "op10_line_dedup": line_dedup.ORACLE}
