"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from . import bpe, exact_dedup, line_dedup, mixing, quality, secret_scan, sharding, simhash, token_output, warc

QUERIES: dict[str, Callable] = {
    "op1_simhash": simhash.op1_simhash,
    "op2_sharding": sharding.op2_sharding,
    "op3_secret_scan": secret_scan.op3_secret_scan,
    "op4_byte_bpe": bpe.op4_byte_bpe,
    "op5_token_output": token_output.op5_token_output,
    "op6_warc": warc.op6_warc,
    "op7_quality_rules": quality.op7_quality_rules,
    "op8_mixing": mixing.op8_mixing,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op6_warc": warc.ORACLE_SQL,
    "op7_quality_rules": quality.ORACLE_SQL,
    "op9_line_dedup": line_dedup.ORACLE_SQL,
    "op10_exact_dedup": exact_dedup.ORACLE_SQL,
}
