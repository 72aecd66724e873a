"""The queries of the training-data operators, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, brown_lm, cotrain, decontam, html_extract, minhash, packing, pii, rlindex, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc": warc.op1_warc,
        "op2_brown": brown_lm.op2_brown,
        "op3_quality": cotrain.op3_quality,
        "op4_pii": pii.op4_pii,
        "op5_decontamination": decontam.op5_decontamination,
        "op6_html": html_extract.op6_html,
        "op7_minhash": minhash.op7_minhash,
        "op8_ann": ann.op8_ann,
        "op9_packing": packing.op9_packing,
        "op10_repeats": rlindex.op10_repeats,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": warc.OP1_SQL, "op5_decontamination": decontam.OP5_SQL, "op7_minhash": minhash.OP7_SQL, "op8_ann": ann.OP8_SQL}
