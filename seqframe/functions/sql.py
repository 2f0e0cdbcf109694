"""The column functions as temporary SQL functions. Bodies are SQL expressions, which Catalyst inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: name -> (arguments, result, body)
SCALARS = {
    "seq_canonical": ("s STRING", "STRING", "regexp_replace(translate(s, 'acgtuU.', 'ACGTTT-'), '[^ACGT-]', 'N')"),
    "seq_type": ("s STRING", "STRING", "CASE WHEN s RLIKE '[EFILPQefilpq*]' THEN 'protein' ELSE 'nucleotide' END"),
    "seq_revcomp": ("s STRING", "STRING", "reverse(translate(s, 'ACGT', 'TGCA'))"),
    "seq_gc": ("s STRING", "DOUBLE", "CASE WHEN length(s) = 0 THEN 0D ELSE (length(s) - length(translate(s, 'GC', ''))) / length(s) END"),
    "seq_mean_quality": ("q STRING", "DOUBLE", "CASE WHEN length(q) = 0 THEN 0D ELSE aggregate(sequence(1, greatest(length(q), 1)), 0L, (t, i) -> t + least(greatest(ascii(substr(q, i, 1)) - 33, 0), 93)) / length(q) END"),
    "seq_orf": ("s STRING", "INT", "locate('ATG', s) - 1"),
    "seq_packed_size": ("n INT", "INT", "(n * 5 + 7) div 8"),
}
TABLES = {
    "seq_kmers": ("s STRING, k INT", "place INT, kmer STRING", "SELECT i - 1, substr(s, i, k) FROM (SELECT explode(CASE WHEN length(s) >= k THEN sequence(1, length(s) - k + 1) END) AS i) WHERE substr(s, i, k) RLIKE '^[ACGT]+$'"),
}


def register(spark: SparkSession) -> list[str]:
    """Creates the functions in the session; their names."""
    for name, (args, result, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {result} RETURN {body}")
    for name, (args, result, body) in TABLES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS TABLE({result}) RETURN {body}")
    return [*SCALARS, *TABLES]
