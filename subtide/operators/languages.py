"""Languages and pairs: which targets a source may have, and which requests a model can answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normal_code(code: Column, known: list[str], fallback: str) -> Column:
    """The trimmed lower-case code if it is known, else the fallback."""
    plain = F.lower(F.trim(F.coalesce(code, F.lit(""))))
    return F.when(plain.isin(known), plain).otherwise(F.lit(fallback))


def allowed_targets(sources: DataFrame, known: list[str], pairs: DataFrame | None = None) -> DataFrame:
    """source, target for each of sources(source): all other languages of a multilingual model (``pairs`` is None), else those of
    pairs(source, target), else English. Unknown sources count as Dutch."""
    own = sources.select(normal_code(F.col("source"), known, "nl").alias("source")).distinct()
    if pairs is None:
        return own.select("source", F.explode(F.array_remove(F.array(*map(F.lit, known)), F.col("source"))).alias("target"))
    return own.join(pairs.select("source", "target").distinct(), "source", "left").select("source", F.coalesce("target", F.lit("en")).alias("target"))


def validated(requests: DataFrame, known: list[str], fixed: tuple[str, str] | None = None) -> DataFrame:
    """requests(source, target) with ``problem``: null, ``unsupported_language`` or, for a model of one fixed pair, ``unsupported_language_pair``.

    Codes are trimmed and lower-cased; a request from a language to itself needs no model.
    """
    codes = {c: F.lower(F.trim(F.coalesce(F.col(c), F.lit("")))) for c in ("source", "target")}
    rows = requests.withColumns(codes)
    unknown = ~F.col("source").isin(known) | ~F.col("target").isin(known)
    other = F.lit(False) if fixed is None else (F.col("source") != F.col("target")) & ~((F.col("source") == fixed[0]) & (F.col("target") == fixed[1]))
    return rows.withColumn("problem", F.when(unknown, "unsupported_language").when(other, "unsupported_language_pair"))
