"""WAV files to rows of samples and back, as Arrow batches."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

DECODED = pa.schema([("path", pa.string()), ("chunk", pa.int64()), ("sample_rate", pa.int32()), ("samples", pa.list_(pa.float32())), ("error", pa.string())])


def _decoded(path: str, content: bytes, chunk_samples: int) -> Iterator[dict]:
    try:
        with wave.open(io.BytesIO(content or b"")) as f:
            if f.getsampwidth() != 2:
                raise ValueError("only 16-bit PCM is supported")
            rate, channels, k = f.getframerate(), f.getnchannels(), 0
            while True:
                raw = f.readframes(chunk_samples)
                if not raw and k:
                    return
                pcm = np.frombuffer(raw, "<i2").reshape(-1, channels).astype(np.float32) * np.float32(1 / 32768)
                yield {"path": path, "chunk": k, "sample_rate": rate, "samples": pcm.mean(1, dtype=np.float32) if channels > 1 else pcm[:, 0], "error": None}
                k += 1
                if not raw:
                    return
    except (wave.Error, EOFError, ValueError) as error:
        yield {"path": path, "chunk": 0, "sample_rate": None, "samples": None, "error": str(error) or "empty"}


def decode(files: DataFrame, chunk_samples: int = 160_000) -> DataFrame:
    """files(path, content), as of ``spark.read.format("binaryFile")``, to chunks of at most ``chunk_samples`` mono samples.

    Channels are averaged; a file that is no 16-bit PCM WAV gives one row with its error and no samples; an empty recording one row without samples.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch["path"].to_pylist(), batch["content"], strict=True):
                for row in _decoded(path, content.as_py(), chunk_samples):
                    yield pa.RecordBatch.from_pylist([row], DECODED)

    return files.select("path", "content").mapInArrow(run, "path string, chunk long, sample_rate int, samples array<float>, error string")


def encode(recordings: DataFrame, sample_rate: int = 16_000) -> DataFrame:
    """recordings(path, samples) to files(path, content) in 16-bit mono WAV."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents = []
            for samples in batch["samples"].to_pylist():
                out = io.BytesIO()
                with wave.open(out, "wb") as f:
                    f.setnchannels(1)
                    f.setsampwidth(2)
                    f.setframerate(sample_rate)
                    f.writeframes(np.clip(np.rint(np.asarray(samples or [], np.float64) * 32768), -32768, 32767).astype("<i2").tobytes())
                contents.append(out.getvalue())
            yield pa.RecordBatch.from_arrays([batch["path"].cast(pa.string()), pa.array(contents, pa.binary())], ["path", "content"])

    return recordings.select("path", "samples").mapInArrow(run, "path string, content binary")
