"""The registered queries of the operators and their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, classifier, collocations, exact_dedup, language_id, mixing, quality, sharding, simhash, spelling, token_files, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": sharding.op1,
    "op2_exact_dedup": exact_dedup.op2,
    "op3_token_files": token_files.op3,
    "op4_simhash": simhash.op4,
    "op5_language_id": language_id.op5,
    "op6_warc": warc.op6,
    "op7_preferences": chat.op7,
    "op8_bpe": bpe.op8,
    "op9_mixing": mixing.op9,
    "op10_quality": quality.op10,
    "op11_spelling": spelling.op11,
    "op12_quality_classifier": classifier.op12,
    "op13_collocations": collocations.op13,
}

ORACLES: dict[str, str] = {
    "op1_sharding": sharding.OP1_SQL,
    "op2_exact_dedup": exact_dedup.OP2_SQL,
    "op6_warc": warc.OP6_SQL,
    "op7_preferences": chat.OP7_SQL,
    "op9_mixing": mixing.OP9_SQL,
    "op11_spelling": spelling.OP11_SQL,
    "op13_collocations": collocations.OP13_SQL,
}
