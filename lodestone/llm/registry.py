"""Queries of this subpackage and, where SQL can express one, the equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import chat, classifier, classlm, convtrie, decontam, linededup, mixing, neardup, quality, runs, suffixdedup, urlfilter, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": warc.op1_warc,
    "op2_line_dedup": linededup.op2_line_dedup,
    "op3_quality_rules": quality.op3_quality_rules,
    "op4_chat_formatting": chat.op4_chat_formatting,
    "op5_decontamination": decontam.op5_decontamination,
    "op6_lm_scoring": classlm.op6_lm_scoring,
    "op7_mixing": mixing.op7_mixing,
    "op10_minhash": neardup.op10_minhash,
    "op8_suffix_dedup": suffixdedup.op8_suffix_dedup,
    "op9_quality_classifier": classifier.op9_quality_classifier,
    "op11_runs": runs.op11_runs,
    "op12_url_filters": urlfilter.op12_url_filters,
    "op13_prefix_trie": convtrie.op13_prefix_trie,
}

ORACLE_SQL: dict[str, str] = {
    "op1_warc": warc.OP1_SQL,
    "op2_line_dedup": linededup.OP2_SQL,
    "op4_chat_formatting": chat.OP4_SQL,
    "op5_decontamination": decontam.OP5_SQL,
    "op7_mixing": mixing.OP7_SQL,
    "op11_runs": runs.OP11_SQL,
    "op12_url_filters": urlfilter.OP12_SQL,
    "op13_prefix_trie": convtrie.OP13_SQL,
}
