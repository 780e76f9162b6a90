"""The operators' queries, one for each number, and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import op1_packing, op2_gif, op3_backoff, op4_secrets, op5_crosspolytope, op6_bpe, op7_minhash, op8_langid, op9_lines, op10_wavelet


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": op1_packing.query,
        "op2_gif": op2_gif.query,
        "op3_backoff": op3_backoff.query,
        "op4_secrets": op4_secrets.query,
        "op5_crosspolytope": op5_crosspolytope.query,
        "op6_bpe": op6_bpe.query,
        "op7_minhash": op7_minhash.query,
        "op8_langid": op8_langid.query,
        "op9_lines": op9_lines.query,
        "op10_wavelet": op10_wavelet.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_secrets": op4_secrets.ORACLE, "op5_crosspolytope": op5_crosspolytope.ORACLE, "op7_minhash": op7_minhash.ORACLE, "op9_lines": op9_lines.ORACLE}
