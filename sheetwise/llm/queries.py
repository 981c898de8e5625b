"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from sheetwise.llm import bpe, class_lm, fingerprints, importance, infilling, mixing, ngram_jaccard, packing, pii, quality_classifier, quality_rules, token_counts, toxicity

QUERIES = {
    "op1_ngram_jaccard": ngram_jaccard.op1_ngram_jaccard,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_class_lm": class_lm.op3_class_lm,
    "op4_fingerprints": fingerprints.op4_fingerprints,
    "op5_bpe": bpe.op5_bpe,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_pii": pii.op7_pii,
    "op8_packing": packing.op8_packing,
    "op9_quality_classifier": quality_classifier.op9_quality_classifier,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_importance": importance.op11_importance,
    "op12_infilling": infilling.op12_infilling,
    "op13_mixing": mixing.op13_mixing,
}
ORACLE_SQL = {
    "op2_quality_rules": quality_rules.ORACLE_SQL,
    "op11_importance": importance.ORACLE_SQL,
    "op12_infilling": infilling.ORACLE_SQL,
    "op13_mixing": mixing.ORACLE_SQL,
}
