"""Names for SQL: temporary functions over the same definitions, with no Python at run time."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .atoms import SECRET_KEYWORDS, TYPES

_PATTERN = "^v1\\\\.(" + "|".join(TYPES) + ")\\\\.([^\\\\n\\\\r\\\\x{2028}\\\\x{2029}]+)\\\\z"

FUNCTIONS = {
    "atom_type": ("a STRING", "STRING", f"nullif(regexp_extract(a, '{_PATTERN}', 1), '')"),
    "atom_value": ("a STRING", "STRING", f"nullif(trim(regexp_extract(a, '{_PATTERN}', 2)), '')"),
    "atom_hash": ("a STRING", "STRING", "sha2(a, 256)"),
    "estimate_tokens": ("t STRING", "BIGINT", "greatest(1, ceil(length(t) / 4))"),
    "atom_tokens": ("t STRING", "ARRAY<STRING>", "filter(split(lower(t), '[^a-z0-9]+'), x -> x <> '')"),
    "has_secret": ("t STRING", "BOOLEAN", "regexp_replace(lower(t), '[\\\\s_-]+', '') rlike '" + "|".join(SECRET_KEYWORDS) + "'"),
    "decayed": ("w DOUBLE, elapsed DOUBLE, half DOUBLE", "DOUBLE", "if(half is null or half <= 0 or elapsed is null, w, w * pow(0.5D, greatest(0D, elapsed) / half))"),
    "node_hash": ("l STRING, r STRING", "STRING", "sha2(concat(unhex(l), unhex(r)), 256)"),
    "hybrid_score": ("b DOUBLE, e DOUBLE", "DOUBLE", "greatest(b, 0.8D * e) + 0.1D * least(b, 0.8D * e)"),
}


def register(spark: SparkSession, prefix: str = "") -> list[str]:
    """Makes the functions known to the session; returns their names."""
    for name, (args, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({args}) RETURNS {kind} RETURN {body}")
    return [prefix + n for n in FUNCTIONS]
