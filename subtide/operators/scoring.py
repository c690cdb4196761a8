"""Surfaces for the user's translator and recogniser: a factory called once per task, then batches of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

Translator = Callable[[list[str], str, str], list[str]]
Recogniser = Callable[[list[float]], dict]


def translate_many(requests: DataFrame, factory: Callable[[], Translator], max_requests: int = 8, max_chars: int = 2400) -> DataFrame:
    """requests(request_id, text, source, target) with translation; each call gets texts of one language pair within both bounds.

    One text longer than ``max_chars`` goes alone; null texts count as empty. A call also ends where an Arrow batch does.
    """
    kind = requests.schema["request_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        translator = factory()
        for batch in batches:
            rows = batch.to_pylist()
            out, call, size = [], [], 0
            for row in [*rows, None]:
                full = call and (row is None or len(call) >= max_requests or size + len(row["text"]) > max_chars or (row["source"], row["target"]) != (call[0]["source"], call[0]["target"]))
                if full:
                    out += translator([r["text"] for r in call], call[0]["source"], call[0]["target"])
                    call, size = [], 0
                if row is not None:
                    call.append(row)
                    size += len(row["text"])
            yield pa.RecordBatch.from_arrays([batch["request_id"], pa.array(out, pa.string())], ["request_id", "translation"])

    asked = requests.select("request_id", F.coalesce("text", F.lit("")).alias("text"), "source", "target")
    return asked.sortWithinPartitions("source", "target").mapInArrow(run, f"request_id {kind}, translation string")


def recognise(segments: DataFrame, factory: Callable[[], Recogniser], result: str, least_samples: int = 1600) -> DataFrame:
    """segments(segment_id, samples) with the recogniser's result; shorter ones get nulls and the reason ``too_short``."""
    kind = segments.schema["segment_id"].dataType.simpleString()
    schema = StructType.fromDDL(f"segment_id {kind}, {result}, reason string")
    names = [f.name for f in schema]

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        recogniser = factory()
        for frame in batches:
            rows = []
            for segment_id, samples in zip(frame["segment_id"], frame["samples"], strict=True):
                short = samples is None or len(samples) < least_samples
                rows.append({"segment_id": segment_id, "reason": "too_short"} if short else {"segment_id": segment_id, **recogniser(list(samples))})
            yield pd.DataFrame(rows, columns=names)

    return segments.select("segment_id", "samples").mapInPandas(run, schema)
