"""Roll-ups of evaluated recognisers and translators: macro means over items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subtide.functions import arrays


def letter_error_rate(reference: Column, hypothesis: Column) -> Column:
    a, b = F.replace(reference, F.lit(" "), F.lit("")), F.replace(hypothesis, F.lit(" "), F.lit(""))
    return arrays.error_rate(F.levenshtein(a, b), F.length(a), F.length(b))


def word_error_rate(reference: Column, hypothesis: Column) -> Column:
    a, b = arrays.tokens(reference), arrays.tokens(hypothesis)
    return arrays.error_rate(arrays.word_distance(a, b), F.size(a), F.size(b))


def asr_rollup(runs: DataFrame, keys: list[str]) -> DataFrame:
    """runs(keys, reference, hypothesis (evaluation texts), latency_ms, seconds): number of items and their mean error rates, realtime factor and latency."""
    rtf = arrays.real_time_factor(F.col("latency_ms"), F.col("seconds"))
    scored = runs.select(*keys, word_error_rate(F.col("reference"), F.col("hypothesis")).alias("wer"), letter_error_rate(F.col("reference"), F.col("hypothesis")).alias("cer"), rtf.alias("rtf"), "latency_ms")
    means = (("wer", 4), ("cer", 4), ("rtf", 3), ("latency_ms", 1))
    return scored.groupBy(*keys).agg(F.count("*").alias("n"), *[F.round(F.avg(c), places).alias(f"{c}_mean") for c, places in means])


def translation_rollup(wanted: DataFrame, runs: DataFrame, key: str) -> DataFrame:
    """wanted(key, failed) with the items of runs(key, reference, hypothesis, chrf, latency_ms): status ok, skipped (no run) or failed, and the means."""
    scored = runs.withColumn("cer", letter_error_rate(F.col("reference"), F.col("hypothesis")))
    done = scored.groupBy(key).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in ("chrf", "cer", "latency_ms")])
    met = wanted.join(done, key, "left")
    status = F.when(F.col("failed"), "failed").when(F.col("n").isNull(), "skipped").otherwise("ok")
    return met.select(key, F.coalesce("n", F.lit(0)).alias("n"), status.alias("status"), F.round("chrf", 4).alias("chrf_mean"), F.round("cer", 4).alias("cer_mean"), F.round("latency_ms", 1).alias("latency_ms_mean"))
