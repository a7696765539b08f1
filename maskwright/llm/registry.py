"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from maskwright.llm import bpe, chat, ctw, decontaminate, language, negatives, packing, quality, resample, search, simhash, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_maxscore": search.op1_maxscore,
        "op2_quality": quality.op2_quality,
        "op3_decontaminate": decontaminate.op3_decontaminate,
        "op4_bpe": bpe.op4_bpe,
        "op5_warc": warc.op5_warc,
        "op6_packing": packing.op6_packing,
        "op7_ctw": ctw.op7_ctw,
        "op8_language": language.op8_language,
        "op9_chat": chat.op9_chat,
        "op10_simhash": simhash.op10_simhash,
        "op11_resample": resample.op11_resample,
        "op12_toxicity": toxicity.op12_toxicity,
        "op13_negatives": negatives.op13_negatives,
    }


def oracles() -> dict[str, str]:
    return {"op1_maxscore": search.OP1_SQL, "op5_warc": warc.OP5_SQL, "op11_resample": resample.OP11_SQL, "op13_negatives": negatives.OP13_SQL}
