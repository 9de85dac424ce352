"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, extraction, line_chunks, minhash, packing, periodic, quality, resampling, sharding, substring, suffixes, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": packing.op1_packing,
    "op2_minhash": minhash.op2_minhash,
    "op3_suffix_dedup": suffixes.op3_suffix_dedup,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_line_dedup": substring.op5_line_dedup,
    "op6_sharding": sharding.op6_sharding,
    "op7_warc": warc.op7_warc,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_quality_rules": quality.op9_quality_rules,
    "op10_line_chunk_dedup": line_chunks.op10_line_chunk_dedup,
    "op11_html_extraction": extraction.op11_html_extraction,
    "op12_importance_resampling": resampling.op12_importance_resampling,
    "op13_periodic_runs": periodic.op13_periodic_runs,
}

ORACLE_SQL: dict[str, str] = {
    "op2_minhash": minhash.ORACLE,
    "op3_suffix_dedup": suffixes.ORACLE,
    "op4_decontaminate": decontaminate.ORACLE,
    "op5_line_dedup": substring.ORACLE,
    "op6_sharding": sharding.ORACLE,
    "op7_warc": warc.ORACLE,
    "op11_html_extraction": extraction.ORACLE,
    "op12_importance_resampling": resampling.ORACLE,
    "op13_periodic_runs": periodic.ORACLE,
}
