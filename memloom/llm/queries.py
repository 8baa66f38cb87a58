"""The registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from . import ann, bpe, langid, license_scan, line_dedup, packing, pii, quality, secret_scan, simhash


def queries() -> dict[str, Callable]:
    return {
        "op1_langid": langid.op1_langid,
        "op2_quality": quality.op2_quality,
        "op3_ann": ann.op3_ann,
        "op4_packing": packing.op4_packing,
        "op5_bpe": bpe.op5_bpe,
        "op6_pii": pii.op6_pii,
        "op7_simhash": simhash.op7_simhash,
        "op8_secrets": secret_scan.op8_secrets,
        "op9_licenses": license_scan.op9_licenses,
        "op10_line_dedup": line_dedup.op10_line_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_pii": pii.ORACLE_SQL, "op10_line_dedup": line_dedup.ORACLE_SQL}
