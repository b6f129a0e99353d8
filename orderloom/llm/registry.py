"""Queries of the corpus operators, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orderloom.llm import conversations, decontaminate, line_dedup, minhash, mixing, vector_codes
from orderloom.llm.byte_bpe import op10_byte_bpe
from orderloom.llm.fingerprint import op9_fingerprint
from orderloom.llm.lattice_lm import op1_lattice_lm
from orderloom.llm.quality import op5_quality
from orderloom.llm.sanitise import op3_pii
from orderloom.llm.suffix_dedup import op4_suffix_dedup
from orderloom.llm.urls import op8_url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_lattice_lm": op1_lattice_lm,
        "op2_decontaminate": decontaminate.op2_decontaminate,
        "op3_pii": op3_pii,
        "op4_suffix_dedup": op4_suffix_dedup,
        "op5_quality": op5_quality,
        "op6_minhash": minhash.op6_minhash,
        "op7_line_dedup": line_dedup.op7_line_dedup,
        "op8_url_filter": op8_url_filter,
        "op9_fingerprint": op9_fingerprint,
        "op10_byte_bpe": op10_byte_bpe,
        "op11_conversation_repair": conversations.op11_conversation_repair,
        "op12_mixing": mixing.op12_mixing,
        "op13_vector_codes": vector_codes.op13_vector_codes,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_decontaminate": decontaminate.ORACLE,
        "op6_minhash": minhash.ORACLE,
        "op7_line_dedup": line_dedup.ORACLE,
        "op11_conversation_repair": conversations.ORACLE,
        "op12_mixing": mixing.ORACLE,
        "op13_vector_codes": vector_codes.ORACLE,
    }
