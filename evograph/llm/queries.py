"""Queries of the subpackage and their SQL, by name."""

from __future__ import annotations

from . import classifier, imatch, linededup, mixing, packing, pii, rules, sharding, simhash, warc


def queries() -> dict:
    return {
        "op1_packing": packing.query,
        "op2_line_dedup": linededup.query,
        "op3_rules": rules.query,
        "op4_simhash": simhash.query,
        "op5_imatch": imatch.query,
        "op6_mixing": mixing.query,
        "op7_sharding": sharding.query,
        "op8_classifier": classifier.query,
        "op9_pii": pii.query,
        "op10_warc": warc.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_mixing": mixing.SQL, "op10_warc": warc.SQL}
