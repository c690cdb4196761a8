"""Timed words to subtitle cues, and cues to files."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import StructType

from subtide.functions.text import timestamp

STRONG, WEAK = (".", "!", "?", "…"), (",", ";", ":")
MAX_CHARS, MAX_MS, GAP_MS, LEAST_MS, WEAK_CHARS = 84, 6000, 500, 800, 42


def islands(words: DataFrame) -> DataFrame:
    """words(client_id, pos, word, start_ms, end_ms) with island: cut at gaps and after strong punctuation."""
    order = W.partitionBy("client_id").orderBy("pos")
    gap = F.col("start_ms") - F.lag("end_ms").over(order) >= GAP_MS
    strong = F.right(F.lag("word").over(order), F.lit(1)).isin(*STRONG)
    cut = F.when(gap | strong, 1).otherwise(0)
    return words.withColumn("cut", F.coalesce(cut, F.lit(0))).withColumn("island", F.sum("cut").over(order.rowsBetween(W.unboundedPreceding, 0))).drop("cut")


@dataclass
class CueBuilder:
    """Words (pos, word, start_ms, end_ms) of an island to cues: broken at 84 characters, 6 s, or weak punctuation after 42 characters."""

    schema: str = "cue int, start_ms long, end_ms long, text string"

    def start(self) -> dict:
        return {"cue": 0, "words": [], "chars": 0, "since": 0, "until": 0}

    def step(self, state: dict, row: dict) -> list[tuple]:
        size, out = len(row["word"]), []
        weak = state["chars"] >= WEAK_CHARS and state["words"][-1].endswith(WEAK)
        if state["words"] and (state["chars"] + 1 + size > MAX_CHARS or row["end_ms"] - state["since"] > MAX_MS or weak):
            out = self.close(state)
        if state["words"]:
            state["words"].append(row["word"])
            state.update(chars=state["chars"] + 1 + size, until=max(state["until"], row["end_ms"]))
        else:
            state.update(words=[row["word"]], chars=size, since=row["start_ms"], until=row["end_ms"])
        return out

    def close(self, state: dict) -> list[tuple]:
        done = [(state["cue"], state["since"], state["until"], " ".join(state["words"]))] if state["words"] else []
        state.update(words=[], cue=state["cue"] + 1)
        return done


def build(words: DataFrame) -> DataFrame:
    """Greedy cues(client_id, island, cue, start_ms, end_ms, text), as ``CueBuilder`` cuts the islands.

    Words are dealt and sorted once and read as a stream; a task holds one batch and the words of one open cue.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = StructType.fromDDL(f"client_id {words.schema['client_id'].dataType.simpleString()}, island long, cue int, start_ms long, end_ms long, text string")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, island, cue = None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            own = pa.table(batch) if held is None else pa.concat_tables([held, pa.table(batch)])
            done, held, island, cue = _cut(own.combine_chunks(), island, cue, arrow)
            yield from done.to_batches()
        if held is not None:
            yield from _cut(held.combine_chunks(), island, cue, arrow, ended=True)[0].to_batches()

    dealt = words.select("client_id", "pos", "word", F.col("start_ms").cast("long"), F.col("end_ms").cast("long")).repartition("client_id").sortWithinPartitions("client_id", "pos", "word", "start_ms", "end_ms")
    return dealt.select("client_id", "word", "start_ms", "end_ms").mapInArrow(run, schema)


def _cut(words: pa.Table, island: int, cue: int, schema: pa.Schema, ended: bool = False) -> tuple[pa.Table, pa.Table, int, int]:
    """Cues of words in order, the first of which begins cue ``cue`` of ``island``; the words of the last cue, which may go on, and its numbers."""
    client, word, start, end = (words[c].combine_chunks() if isinstance(words[c], pa.ChunkedArray) else words[c] for c in ("client_id", "word", "start_ms", "end_ms"))
    start, end, n = start.to_numpy(), end.to_numpy(), words.num_rows
    last = pc.utf8_slice_codeunits(word, -1)
    strong, weak = (pc.is_in(last, pa.array(marks, last.type)).to_numpy(zero_copy_only=False) for marks in (STRONG, WEAK))
    left, right = client.slice(0, n - 1), client.slice(1)
    same = pc.or_(pc.fill_null(pc.equal(left, right), False), pc.and_(pc.is_null(left), pc.is_null(right))).to_numpy(zero_copy_only=False)
    other = np.concatenate([[False], ~same])
    cut = other.copy()
    cut[1:] |= (start[1:] - end[:-1] >= GAP_MS) | strong[:-1]

    # For each word the first one that is not in the cue that begins with it; a cue has 85 words at most.
    upto = np.concatenate([[0], np.cumsum(pc.utf8_length(word).to_numpy() + 1)])
    following, at, k = np.full(n, n), np.arange(n), 1
    while len(at := at[at + k < n]):
        j = at + k
        stop = cut[j] | (upto[j + 1] - upto[at] - 1 > MAX_CHARS) | (end[j] - start[at] > MAX_MS) | (weak[j - 1] & (upto[j] - upto[at] - 1 >= WEAK_CHARS))
        following[at[stop]] = j[stop]
        at, k = at[~stop], k + 1
    following, begins, here = following.tolist(), [], 0
    while here < n:
        begins.append(here)
        here = following[here]
    begins = np.array(begins)

    islands, cues = np.cumsum(cut), np.arange(len(begins))
    since = np.maximum.accumulate(np.where(other, np.arange(n), -1))
    islands = np.where(since >= 0, islands - islands[since], islands + island)[begins]
    first = np.maximum.accumulate(np.where(cut[begins], cues, -1))
    cues = np.where(first >= 0, cues - first, cues + cue)

    size = len(begins) if ended else len(begins) - 1
    bounds = np.append(begins, n)[: size + 1]
    done = begins[:size]
    texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), word), " ")
    until = np.maximum.reduceat(end[: bounds[-1]], done) if size else end[:0]
    columns = [client.take(pa.array(done)), pa.array(islands[:size]), pa.array(cues[:size]), pa.array(start[done]), pa.array(until), texts]
    return pa.table([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema), words.slice(int(begins[-1])), int(islands[-1]), int(cues[-1])


def normalized(cues: DataFrame, key: str = "client_id", order: tuple[str, ...] = ("start_ms",)) -> DataFrame:
    """Cues with text, none overlapping the one before and none under 800 ms; running maxima instead of a loop."""
    kept = cues.where(F.trim("text") != "")
    by = W.partitionBy(key).orderBy(*order)
    i = F.row_number().over(by).cast("bigint")
    s = F.greatest(F.col("start_ms"), F.lit(0))
    kept = kept.withColumns({"i": i, "s": s}).withColumn("v", F.greatest(F.col("s") + LEAST_MS, F.col("end_ms")) - LEAST_MS * F.col("i"))
    kept = kept.withColumn("end_ms", LEAST_MS * F.col("i") + F.max("v").over(by.rowsBetween(W.unboundedPreceding, 0)))
    return kept.withColumn("start_ms", F.greatest("s", F.coalesce(F.lag("end_ms").over(by), F.lit(0)))).drop("i", "s", "v")


def as_srt(cues: DataFrame, key: str = "client_id") -> DataFrame:
    """One SubRip text per key from cues(key, start_ms, end_ms, text)."""
    number = F.row_number().over(W.partitionBy(key).orderBy("start_ms", "end_ms", "text"))
    block = F.concat_ws("\n", F.col("n").cast("string"), F.concat(timestamp(F.col("start_ms")), F.lit(" --> "), timestamp(F.col("end_ms"))), "text", F.lit(""))
    return _joined(cues.withColumn("n", number), block, key, "srt", "")


def as_vtt(cues: DataFrame, key: str = "client_id") -> DataFrame:
    number = F.row_number().over(W.partitionBy(key).orderBy("start_ms", "end_ms", "text"))
    block = F.concat_ws("\n", F.concat(timestamp(F.col("start_ms"), "."), F.lit(" --> "), timestamp(F.col("end_ms"), ".")), "text", F.lit(""))
    return _joined(cues.withColumn("n", number), block, key, "vtt", "WEBVTT\n\n")


def _joined(cues: DataFrame, block: Column, key: str, name: str, head: str) -> DataFrame:
    blocks = F.array_sort(F.collect_list(F.struct("n", block.alias("block"))))
    return cues.groupBy(key).agg(F.concat(F.lit(head), F.array_join(F.transform(blocks, lambda b: b["block"]), "\n")).alias(name))


def provisional_ends(items: DataFrame) -> DataFrame:
    """items(client_id, id, start_ms, end_ms, pending): a pending item ends 120 ms before the next, after 800 ms at least, 3.5 s by default."""
    following = F.lead("start_ms").over(W.partitionBy("client_id").orderBy("start_ms", "id"))
    end = F.when(following.isNull(), F.col("start_ms") + 3500).otherwise(F.greatest(F.col("start_ms") + 800, following - 120))
    return items.withColumn("end_ms", F.when(F.col("pending"), end).otherwise(F.col("end_ms")))
