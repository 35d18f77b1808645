"""Queries of the training-data operators and their SQL equivalents."""

from __future__ import annotations

from . import ann, bpe, class_lm, language, mixing, near_dedup, order_minhash, suffix_dedup, toxicity, warc


def queries():
    return {
        "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
        "op2_bpe": bpe.op2_bpe,
        "op3_language": language.op3_language,
        "op4_warc": warc.op4_warc,
        "op5_ann": ann.op5_ann,
        "op6_mixing": mixing.op6_mixing,
        "op7_order_minhash": order_minhash.op7_order_minhash,
        "op8_near_dedup": near_dedup.op8_near_dedup,
        "op9_class_lm": class_lm.op9_class_lm,
        "op10_toxicity": toxicity.op10_toxicity,
    }


def oracle_sql():
    return {"op1_suffix_dedup": suffix_dedup.ORACLE, "op4_warc": warc.ORACLE, "op6_mixing": mixing.ORACLE, "op8_near_dedup": near_dedup.ORACLE}
