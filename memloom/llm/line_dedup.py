"""Line deduplication by overlapping three-line windows.

Every three consecutive lines of a document are a window, known by 128 bits of hashes. A window
that occurs before, in the order of document id, row and line, over all documents, is a later
occurrence; the lines that later occurrences cover are merged and removed. The earliest copy of
any line is never removed, since a removed line equals one in an earlier window.

The first occurrence of each window comes from a map-side minimum, so a window that half of the
corpus shares is one row a task before the shuffle; the repeated windows alone are written and
joined back, with plain exchanges on both sides that can be split where a window is very common.
Texts move once, to meet the places of their own removed lines. Both joins are merge joins at every
size: the tables of repeated windows and of removed lines grow with the corpus, so neither is
broadcast, and the cost grows evenly.

Defined cases: lines end at ``\\n``; a null text stays null, with no lines; fewer than three lines
make no window; windows whose lines are all blank are ignored; a text all of whose lines are
removed becomes empty; repeated rows are later occurrences of one another, the earlier row of an
id counting first; null ids come first; other columns are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, let, read_table, with_row_id

WINDOW = 3
_ROW, _LINES, _GONE = "__row", "__lines", "__gone"


def _windows(lines: Column) -> Column:
    """An array of (h, g, line): two hashes of each window that is not blank, and its first line."""

    def of(a: Column) -> Column:
        n = F.size(a) - (WINDOW - 1)
        at = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))

        def one(i: Column) -> Column:
            parts = [F.element_at(a, i + k) for k in range(WINDOW)]
            return F.struct(F.xxhash64(*[p["h"] for p in parts]).alias("h"), F.xxhash64(F.lit("g"), *[p["g"] for p in parts]).alias("g"), i.alias("line"), F.array_max(F.array(*[p["seen"] for p in parts])).alias("seen"))

        return F.filter(F.transform(at, one), lambda w: w["seen"])

    hashed = F.transform(lines, lambda s: F.struct(F.xxhash64(s).alias("h"), F.xxhash64(F.lit("\n"), s).alias("g"), (F.trim(F.translate(s, "\t\r\x0b\x0c", "    ")) != "").alias("seen")))
    return let(hashed, of)


def mark_repeated_lines(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with __row, __lines and __gone: the sorted numbers, from 1, of the lines to remove (null: none)."""
    rows = with_row_id(docs, _ROW)
    at = F.struct(F.col(key).alias("k"), F.col(_ROW).alias("row"), F.col("w.line").alias("line"))
    windows = rows.select(key, _ROW, F.explode(_windows(F.split(F.col(text), "\n", -1))).alias("w")).select(F.col("w.h").alias("h"), F.col("w.g").alias("g"), at.alias("at"))
    windows = cut(windows)
    first = cut(windows.groupBy("h", "g").agg(F.min("at").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    later = windows.join(first.hint("merge"), ["h", "g"]).filter(F.col("at") > F.col("first"))
    covered = later.select(F.col("at.row").alias(_ROW), F.explode(F.sequence(F.col("at.line"), F.col("at.line") + (WINDOW - 1))).alias("line"))
    gone = cut(covered.groupBy(_ROW).agg(F.sort_array(F.collect_set("line")).alias(_GONE)))
    return rows.join(gone.hint("merge"), _ROW, "left").withColumn(_LINES, F.split(F.col(text), "\n", -1))


def _kept_text() -> Column:
    left = F.array_except(F.sequence(F.lit(1), F.size(F.col(_LINES))), F.col(_GONE))
    return F.array_join(F.transform(left, lambda i: F.element_at(F.col(_LINES), i)), "\n")


def deduplicate_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", counts: bool = False) -> DataFrame:
    """docs with the repeated lines gone from text; with counts, n_lines and n_removed (longs) too."""
    marked = mark_repeated_lines(docs, text, key)
    new = F.when(F.col(_GONE).isNull(), F.col(text)).otherwise(_kept_text())
    kept = [new.alias(c) if c == text else F.col(c) for c in docs.columns]
    if counts:
        lines = F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size(F.col(_LINES)))
        gone = F.when(F.col(_GONE).isNull(), F.lit(0)).otherwise(F.size(F.col(_GONE)))
        kept += [lines.cast("long").alias("n_lines"), gone.cast("long").alias("n_removed")]
    return marked.select(*kept)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True).select("doc_id", "n_lines", "n_removed", "text")


ORACLE_SQL = r"""
WITH lines AS (
  SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents
), win AS (
  SELECT doc_id, i, ls[i] || chr(10) || ls[i + 1] || chr(10) || ls[i + 2] AS w
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) - 1)) AS i FROM lines)
), ranked AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS n
  FROM win WHERE regexp_matches(w, '[^ \t\r\n\x0b\x0c]')
), gone AS (
  SELECT DISTINCT doc_id, i + k AS i FROM ranked, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1
), numbered AS (
  SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM lines
), kept AS (
  SELECT n.doc_id, string_agg(n.line, chr(10) ORDER BY n.i) FILTER (WHERE g.i IS NULL) AS text,
         count(*) AS n_lines, count(g.i) AS n_removed
  FROM numbered n LEFT JOIN gone g ON n.doc_id = g.doc_id AND n.i = g.i GROUP BY n.doc_id
)
SELECT doc_id, n_lines, n_removed, coalesce(text, '') AS text FROM kept
"""
