"""Sequential rules cut into pieces that run side by side: sessions at long silences, greedy batches block by block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from subtide.sources.reports import working_folder
from subtide.streaming.fold import fold
from subtide.streaming.machines import RequestBatches, Segmenter


def silent_islands(chunks: DataFrame, key: str, order: list[str], machine: Segmenter) -> DataFrame:
    """chunks with ``island``: a session is cut where silence has lasted so long that the segmenter is idle and its pre-roll is silent too.

    After ``end_silence`` no segment is open (one that waits for ``least`` is closed by then as well, as silence
    counts for it), and the chunks of another ``pre_roll`` are all that a later segment can begin with; those are
    repeated at the head of the next island, so each island can be read alone. Empty chunks are left out.
    """
    loud = F.coalesce(F.col("level"), F.lit(0.0)) >= machine.threshold
    by = W.partitionBy(key).orderBy(*order)
    needed, before = machine.samples(max(machine.end_silence, machine.least)) + machine.samples(machine.pre_roll), machine.samples(machine.pre_roll)
    rows = chunks.where(F.coalesce("n_samples", F.lit(0)) > 0).withColumn("run", F.count_if(loud).over(by.rowsBetween(W.unboundedPreceding, 0)))
    quiet = F.when(loud, 0).otherwise(F.col("n_samples"))
    in_run = W.partitionBy(key, "run").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.sum(quiet).over(in_run)).withColumn("since", F.col("upto") - quiet)
    # The first chunk of a run that follows enough silence begins an island.
    at = F.min(F.when(~loud & (F.col("since") >= needed), F.col("since"))).over(W.partitionBy(key, "run"))
    rows = rows.withColumn("at", at).withColumn("cut", (~loud & (F.col("since") == F.col("at"))).cast("int"))
    rows = rows.withColumn("island", F.sum(F.coalesce("cut", F.lit(0))).over(by.rowsBetween(W.unboundedPreceding, 0)))
    repeated = ~loud & (F.col("since") < F.col("at")) & (F.col("at") - F.col("since") <= before)
    islands = F.when(repeated, F.array("island", F.col("island") + 1)).otherwise(F.array("island"))
    return rows.select(*chunks.columns, F.explode(islands).alias("island"))


def segments(chunks: DataFrame, key: str, order: list[str], machine: Segmenter) -> DataFrame:
    """The machine's segments; the islands of a session are folded side by side."""
    cut = silent_islands(chunks.where(F.col(key).isNotNull()), key, order, machine)
    own = cut.select(F.struct(key, "island").alias("piece"), *[c for c in chunks.columns if c != key])
    found = fold(own, "piece", order, machine)
    return found.select(F.col(f"piece.{key}").alias(key), *[c for c in found.columns if c != "piece"])


BLOCK = 1024


def _next(chars: np.ndarray, machine: RequestBatches) -> np.ndarray:
    """For each place the first place that is not in the batch that begins there."""
    n, upto = len(chars), np.concatenate([[0], np.cumsum(chars)])
    at = np.arange(n)
    within = np.searchsorted(upto, upto[:-1] + machine.most_chars, "right") - 1
    return np.maximum(np.minimum(np.minimum(within, at + machine.most_requests), n), at + 1)


def request_batches(rows: DataFrame, key: str, order: str, size: str, machine: RequestBatches | None = None, block: int = BLOCK) -> DataFrame:
    """rows(key, order, size) with ``batch``: greedy batches of each key, at most so many requests and characters, one request at least.

    A block of consecutive requests tells for each place at which a batch may begin in it, one of the first
    ``most_requests``, where the first batch beyond it begins and how many begin within. These maps are chained in
    order, a row for each block, and every block then numbers its own batches. Rows without key or order are left
    out; the order within a key has no ties; a null size counts as 0. The rows are written once with the partition
    they were dealt to, in a working folder: a second run of the deal could cut the ranges elsewhere.
    """
    machine = machine or RequestBatches()
    most = machine.most_requests
    known = rows.where(F.col(key).isNotNull() & F.col(order).isNotNull()).select(F.col(key).alias("pair"), F.col(order).alias("seq"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("size"))
    dealt, folder = known.repartitionByRange("pair", "seq").withColumn("part", F.spark_partition_id()), working_folder(rows.sparkSession)
    dealt.write.parquet(folder)
    dealt = rows.sparkSession.read.schema(dealt.schema).parquet(folder)
    local = dealt.withColumn("local", F.row_number().over(W.partitionBy("part", "pair").orderBy("seq")) - 1)
    counts = local.groupBy("pair", "part").agg(F.count("*").alias("n"))  # a row for each partition and key
    starts = counts.select("pair", "part", (F.sum("n").over(W.partitionBy("pair").orderBy("part")) - F.col("n")).alias("before"))
    placed = local.join(starts, ["pair", "part"]).withColumn("place", F.col("local") + F.col("before")).withColumn("block", F.floor(F.col("place") / block))
    # A batch that begins in a block ends in it or among the first places of the next one.
    ahead = F.when((F.col("block") > 0) & (F.col("place") % block < most), F.array(F.col("block"), F.col("block") - 1)).otherwise(F.array("block"))
    seen = placed.select("pair", "seq", "size", "place", F.explode(ahead).alias("block"))

    def chains(table: pa.Table) -> pa.Table:
        place, chars, n, following = _block_of(table, block, machine)
        exits, counts = [], []
        for at in range(most):
            k = 0
            while at < n:
                at, k = int(following[at]), k + 1
            exits.append(at - block)
            counts.append(k)
        return pa.table({"pair": table["pair"][:1], "block": table["block"][:1], "exits": [exits], "counts": [counts]})

    kind = known.schema["pair"].dataType.simpleString()
    maps = seen.groupBy("pair", "block").applyInArrow(chains, f"pair {kind}, block long, exits array<long>, counts array<long>")
    entries = fold(maps, "pair", ["block"], _Chained())

    def number(left: pa.Table, right: pa.Table) -> pa.Table:
        if not right.num_rows or not left.num_rows:
            return pa.table({c: left[c][:0] for c in ("pair", "seq", "size")} | {"batch": pa.array([], pa.int64())})
        left = left.sort_by("place")
        place, chars, n, following = _block_of(left, block, machine)
        at, batch, k = right["entry"][0].as_py(), np.full(n, right["base"][0].as_py() - 1, np.int64), 0
        while at < n:
            batch[at:] += 1
            at = int(following[at])
        own = left.slice(0, n)
        return pa.table({c: own[c] for c in ("pair", "seq", "size")} | {"batch": pa.array(batch)})

    done = seen.groupBy("pair", "block").cogroup(entries.groupBy("pair", "block")).applyInArrow(number, f"pair {kind}, seq {known.schema['seq'].dataType.simpleString()}, size long, batch long")
    return done.select(F.col("pair").alias(key), F.col("seq").alias(order), F.col("size").alias(size), "batch")


def _block_of(table: pa.Table, block: int, machine: RequestBatches) -> tuple[np.ndarray, np.ndarray, int, np.ndarray]:
    """Places and sizes of a block with what lies ahead of it, its own length and the batch ends."""
    place, chars = table["place"].to_numpy(), table["size"].to_numpy()
    order = np.argsort(place, kind="stable")
    place, chars = place[order], chars[order]
    n = int((place // block == place[0] // block).sum())
    return place, chars, n, _next(chars, machine)


class _Chained:
    """Rows (block, exits, counts) to the place at which the first batch begins in each block, and the batches before it."""

    schema = "block long, entry long, base long"

    def start(self) -> dict:
        return {"entry": 0, "base": 0}

    def step(self, state: dict, row: dict) -> Iterator[tuple] | list[tuple]:
        out = [(row["block"], state["entry"], state["base"])]
        state["base"] += row["counts"][state["entry"]]
        state["entry"] = max(0, row["exits"][state["entry"]])
        return out

    def close(self, state: dict) -> list[tuple]:
        return []
