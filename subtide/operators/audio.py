"""Channel mix and resampling of recordings kept as chunks of samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

TAPS = 15


def loudest_mix(channels: Column) -> Column:
    """One channel: at each place the sample with the largest magnitude, the earlier channel on ties; missing samples lose."""
    longest = F.coalesce(F.array_max(F.transform(channels, F.size)), F.lit(0))
    at = F.when(longest > 0, F.sequence(F.lit(1), longest)).otherwise(F.array().cast("array<int>"))

    def pick(i: Column) -> Column:
        seen = F.transform(channels, lambda c, k: F.struct(F.abs(F.try_element_at(c, i)).alias("size"), (-k).alias("order"), F.try_element_at(c, i).alias("sample")))
        return F.coalesce(F.array_max(F.filter(seen, lambda s: s["sample"].isNotNull()))["sample"], F.lit(0.0))

    return F.transform(at, pick)


def lowpass_taps(source_rate: int, target_rate: int, taps: int = TAPS) -> np.ndarray:
    """Hamming-windowed sinc of unit sum, cut a little below the target's Nyquist frequency."""
    cut = np.clip(min(0.45, 0.9 * (target_rate / 2) / source_rate), 0.01, 0.49)
    kernel = 2 * cut * np.sinc(2 * cut * (np.arange(taps) - taps // 2)) * np.hamming(taps)
    return (kernel / kernel.sum()).astype(np.float32)


def resampled(halo: np.ndarray, samples: np.ndarray, offset: int, source_rate: int, target_rate: int) -> np.ndarray:
    """16-bit output whose source place lies in this chunk: from the sample before it to the one before its last."""
    ratio, n = source_rate / target_rate, len(samples)
    if n == 0:
        return np.zeros(0, np.int16)
    behind = np.zeros(TAPS, np.float32)
    if len(halo):
        behind[-min(TAPS, len(halo)) :] = halo[-TAPS:]
    line = np.concatenate([behind, samples.astype(np.float32)])
    if target_rate < source_rate:
        line = np.convolve(line, lowpass_taps(source_rate, target_rate))[TAPS - 1 : len(line)].astype(np.float32)
    else:
        line = line[TAPS - 1 :]
    # line[k] is the filtered sample at place offset - 1 + k
    first = int(np.ceil(max(0, offset - 1) / ratio))
    last = int(np.ceil((offset + n - 1) / ratio))
    place = np.arange(first, max(first, last)) * ratio - (offset - 1)
    whole = np.floor(place).astype(np.int64)
    a, b = line[whole].astype(np.float64), line[np.minimum(whole + 1, n)].astype(np.float64)
    out = np.clip(a + (b - a) * (place - whole), -1, 1)
    return np.floor(np.where(out < 0, out * 32768, out * 32767) + 0.5).astype(np.int16)


def resample(chunks: DataFrame, source_rate: int, target_rate: int = 16_000) -> DataFrame:
    """chunks(recording, seq, samples) to (recording, seq, n_samples, pcm), continuous over chunks.

    Each chunk takes the last samples before it as a halo and its place in the recording as an offset, so
    chunks are filtered apart from each other; null and empty chunks give empty output.
    """
    order = W.partitionBy("recording").orderBy("seq")
    size = F.coalesce(F.array_size("samples"), F.lit(0)).cast("long")
    before = F.flatten(F.collect_list(F.slice(F.coalesce("samples", F.array().cast("array<float>")), F.greatest(size.cast("int") - TAPS + 1, F.lit(1)), F.lit(TAPS))).over(order.rowsBetween(-TAPS, -1)))
    placed = chunks.select("recording", "seq", "samples", (F.sum(size).over(order.rowsBetween(W.unboundedPreceding, 0)) - size).alias("offset"), before.alias("halo"))
    kinds = ", ".join(f"{c} {chunks.schema[c].dataType.simpleString()}" for c in ("recording", "seq"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pcm = [resampled(np.asarray(h or [], np.float32), np.asarray(s or [], np.float32), o, source_rate, target_rate) for h, s, o in zip(batch["halo"].to_pylist(), batch["samples"].to_pylist(), batch["offset"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["recording"], batch["seq"], pa.array([len(p) for p in pcm], pa.int64()), pa.array([p.astype("<i2").tobytes() for p in pcm], pa.binary())], ["recording", "seq", "n_samples", "pcm"])

    return placed.mapInArrow(run, f"{kinds}, n_samples long, pcm binary")
