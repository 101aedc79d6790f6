"""The queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from . import bpe, fingerprints, importance, licenses, mixing, near_duplicates, negatives, quality_classifier, quality_rules, secrets, sharding, simhash_duplicates, warc


def queries() -> dict:
    return {
        "op1_bpe": bpe.query,
        "op2_fingerprints": fingerprints.query,
        "op3_secrets": secrets.query,
        "op4_warc": warc.query,
        "op5_quality_classifier": quality_classifier.query,
        "op6_mixing": mixing.query,
        "op7_sharding": sharding.query,
        "op8_licenses": licenses.query,
        "op9_quality_rules": quality_rules.query,
        "op10_near_duplicates": near_duplicates.query,
        "op11_importance": importance.query,
        "op12_hard_negatives": negatives.query,
        "op13_simhash_duplicates": simhash_duplicates.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_warc": warc.ORACLE, "op11_importance": importance.ORACLE, "op12_hard_negatives": negatives.ORACLE}
