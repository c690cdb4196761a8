"""Sample arrays, words and numbers as Column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType


def rms(samples: Column) -> Column:
    total = F.aggregate(samples, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return F.when(F.size(samples) > 0, F.sqrt(total / F.size(samples))).otherwise(F.lit(0.0))


def level_meter(samples: Column) -> Column:
    return F.least(F.lit(1.0), rms(samples) * 4)


def real_time_factor(latency_ms: Column, audio_seconds: Column) -> Column:
    return F.when(audio_seconds > 0, latency_ms / 1000 / audio_seconds).otherwise(F.lit(0.0))


def buffered_ms(n_bytes: Column) -> Column:
    return F.when(n_bytes > 0, n_bytes / 32_000 * 1000).otherwise(F.lit(0.0))


def partial_interval_ms(base: int, most: int, rtf: Column) -> Column:
    return F.greatest(F.lit(float(base)), F.least(F.lit(float(most)), base * (1 + F.least(F.lit(1.5), 1.5 * rtf))))


def clean_words(words: Column) -> Column:
    """Trimmed words that are not blank, with end >= start."""
    cut = F.transform(words, lambda w: F.struct(F.trim(w["text"]).alias("text"), w["start"].alias("start"), F.greatest(w["start"], w["end"]).alias("end"), w["probability"].alias("probability")))
    return F.filter(cut, lambda w: w["text"] != "")


def ngrams(text: Column, n: int) -> Column:
    """Character n-grams; none where the text is shorter."""
    at = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.substring(text, i, F.lit(n)))


def tokens(text: Column) -> Column:
    """The words between single spaces; none in an empty text."""
    return F.filter(F.split(text, " "), lambda w: w != "")


@F.pandas_udf(LongType())
def _word_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else edit_distance(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype="Int64")


def edit_distance(a: list, b: list) -> int:
    """Levenshtein distance of two lists, a column of the table at a time as the bits of two whole numbers: len(a) * len(b) / 64 machine words, any number of distinct items."""
    begin = 0
    while begin < min(len(a), len(b)) and a[begin] == b[begin]:
        begin += 1
    end = 0
    while end < min(len(a), len(b)) - begin and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[begin : len(a) - end], b[begin : len(b) - end]
    if not a or not b:
        return len(a) + len(b)
    places: dict = {}
    for i, item in enumerate(a):
        places.setdefault(item, []).append(i)
    full, top, distance = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    rises, falls = full, 0  # where the column steps up or down by one
    for item in b:
        equal = 0
        for i in places.get(item, ()):
            equal |= 1 << i
        down = equal | falls
        same = (((equal & rises) + rises) ^ rises) | equal
        up_row, down_row = falls | (full & ~(same | rises)), rises & same
        distance += bool(up_row & top) - bool(down_row & top)
        up_row, down_row = (up_row << 1 | 1) & full, down_row << 1 & full
        rises, falls = down_row | (full & ~(down | up_row)), up_row & down
    return distance


def word_distance(a: Column, b: Column) -> Column:
    """Edit distance over tokens, in Arrow batches."""
    return _word_distance(a, b)


def error_rate(distance: Column, reference_size: Column, hypothesis_size: Column) -> Column:
    return F.when(reference_size > 0, distance / reference_size).otherwise(F.when(hypothesis_size > 0, 1.0).otherwise(0.0))


def segment_text(text: Column, words: Column) -> Column:
    """The trimmed text; where it is blank, its clean words."""
    return F.coalesce(F.nullif(F.trim(text), F.lit("")), F.array_join(F.transform(words, lambda w: w["text"]), " "))
