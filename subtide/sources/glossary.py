"""Glossaries as tab-separated lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rules(lines: DataFrame) -> DataFrame:
    """pattern, replacement and position from lines(line_no, value).

    Blank lines, comments and lines without a tab are skipped; a repeated pattern keeps its first place and last value.
    """
    line = F.regexp_replace("value", r"^\s+|\s+$", "")
    kept = lines.select("line_no", line.alias("line")).where((F.col("line") != "") & ~F.col("line").startswith("#") & F.col("line").contains("\t"))
    parts = F.split("line", "\t", 2)
    cut = kept.select("line_no", F.trim(parts[0]).alias("pattern"), F.trim(parts[1]).alias("replacement"))
    return cut.groupBy("pattern").agg(F.max_by("replacement", "line_no").alias("replacement"), F.min("line_no").alias("position"))
