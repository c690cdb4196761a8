"""Keyed streams with typed state, event-time timers and state that expires.

``timed_stream`` runs a machine of ``machines.py`` over a stream in event order: rows wait in the key's state until
the watermark has passed them, so rows that arrive out of order within the watermark's delay change nothing, and a
timer wakes the key where its machine has a deadline, though no row arrives. ``fold`` with ``until`` gives the same
rows from a table. ``transcript_stream`` keeps pending subtitles by id and gives every change of an item.

Both need the RocksDB state store; ``with_state_store`` sets it where the session has another.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from subtide.operators.transcripts import DEFAULTS, ITEM_NAMES, ITEM_SCHEMA, PENDING_MS
from subtide.streaming.fold import Machine, drained

#: So many waiting rows lie in one value of the state, which is read and written value by value.
_ROWS_PER_VALUE = 500
#: A stream's watermark begins at 0, and a row at the watermark counts as late: clocks that begin at 0 are moved on by a millisecond.
_SHIFT = 1
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def with_state_store(spark: SparkSession) -> None:
    """State with several variables and timers needs the RocksDB store."""
    if "RocksDB" not in spark.conf.get(_PROVIDER):
        spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _values(rows: list[dict]) -> list[tuple[str]]:
    return [(json.dumps(rows[k : k + _ROWS_PER_VALUE]),) for k in range(0, len(rows), _ROWS_PER_VALUE)]


class _InOrder(StatefulProcessor):
    """A machine whose rows wait for the watermark. State: the rows that wait, and the machine's own."""

    def __init__(self, machine: Machine, at: str, order: list[str], names: list[str]):
        self.machine, self.at, self.order, self.names = machine, at, order, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows string")
        self.state = handle.getValueState("state", "state string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [r.asDict() for r in rows]
        self.waiting.appendList(_values([{c: v for c, v in r.items() if c != "event_time"} for r in new]))
        self._wake_at(min(int(r[self.at]) for r in new))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() - _SHIFT
        rows = [r for x in self.waiting.get() for r in json.loads(x[0])]
        ready = sorted((r for r in rows if r[self.at] <= now), key=lambda r: [r[c] for c in self.order])
        rest = [r for r in rows if r[self.at] > now]
        state = json.loads(self.state.get()[0]) if self.state.exists() else None
        out, state = drained(self.machine, state, ready, self.at, now)
        if rest:
            self.waiting.put(_values(rest))
        else:
            self.waiting.clear()
        if state is None:
            self.state.clear()
        else:
            self.state.update((json.dumps(state),))
        due = [r[self.at] for r in rest] + ([d] if state is not None and (d := self.machine.deadline(state)) is not None else [])
        if due:
            self._wake_at(min(due), now)
        for row in out:
            yield Row(**dict(zip(self.names, (key[0], *row), strict=True)))

    def _wake_at(self, at: int, now: int = -1) -> None:
        """One timer is enough: when it fires, the next one is set. Timers up to ``now`` are those that fire just now."""
        timers = [t for t in self.handle.listTimers() if t > now + _SHIFT]
        if not timers or at + _SHIFT < min(timers):
            self.handle.registerTimer(at + _SHIFT)

    def close(self) -> None:
        pass


def timed_stream(rows: DataFrame, key: str, at: str, order: list[str], machine: Machine, delay: str = "0 seconds") -> DataFrame:
    """The machine's rows over a streaming DataFrame, in the order of ``at`` (milliseconds), then ``order``; final once given."""
    with_state_store(rows.sparkSession)
    schema = StructType.fromDDL(f"{key} {rows.schema[key].dataType.simpleString()}, {machine.schema}")
    marked = rows.where(F.col(key).isNotNull() & F.col(at).isNotNull()).withColumn("event_time", F.timestamp_millis(F.col(at) + _SHIFT)).withWatermark("event_time", delay)
    return marked.groupBy(key).transformWithState(_InOrder(machine, at, [at, *order], [f.name for f in schema]), schema, "append", "eventTime")


class _Transcript(StatefulProcessor):
    """Subtitles by id: a pending one waits in a map, a final one completes it or stands alone. Items that nothing changed for a time are forgotten."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.items = handle.getMapState("items", "id long", f"touched long, {ITEM_SCHEMA}")
        self.last = handle.getValueState("last", "id long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        """State is read once for each id of the micro-batch and written once; the rows between work on what was read."""
        held, touched, out = {}, set(), []
        last = first = self.last.get()[0] if self.last.exists() else None

        def item_of(at: int, now: int) -> dict | None:
            if at not in held:
                value = self.items.getValue((at,)) if self.items.containsKey((at,)) else None
                held[at] = None if value is None else dict(zip(("touched", *ITEM_NAMES), value, strict=True))
            item = held[at]
            return item if item is not None and now < item["touched"] + self.ttl_ms else None

        def keep(at: int, row: dict, item: dict) -> None:
            held[at] = item | {"touched": row["at_ms"]}
            touched.add(at)
            out.append(Row(client_id=key[0], id=at, version=row["seq"], **{c: item[c] for c in ITEM_NAMES}))

        for row in sorted((r.asDict() for r in rows), key=lambda r: r["seq"]):
            at, item = row["id"], item_of(row["id"], row["at_ms"])
            if row["kind"] == "pending" or item is None:
                # A pending item ends where the next one begins.
                before = item_of(last, row["at_ms"]) if last is not None else None
                if before is not None and before["pending"]:
                    keep(last, row, before | {"end_ms": max(before["start_ms"] + 800, row["at_ms"] - 120)})
                number = (item["item"] if item else 0) + (row["kind"] == "pending")
                item = {"item": number, "start_ms": row["at_ms"], "end_ms": row["at_ms"] + PENDING_MS, "source_text": "", "translation": "", "pending": True} | {c: row[c] or d for c, d in DEFAULTS.items()}
                last = at
            item = dict(item)
            for c in ("source_text", *DEFAULTS):
                item[c] = row[c] or item[c]
            if row["kind"] != "pending":
                item["translation"] = row["translation"] or item["translation"] or "Translation unavailable"
                item["pending"] = False
                item |= {c: row[c] for c in ("start_ms", "end_ms") if row[c] is not None}
            keep(at, row, item)

        for at in touched:
            self.items.updateValue((at,), (held[at]["touched"], *(held[at][c] for c in ITEM_NAMES)))
        if last != first:
            self.last.update((last,))
        if touched and not any(True for _ in self.handle.listTimers()):
            self.handle.registerTimer(min(held[at]["touched"] for at in touched) + self.ttl_ms)
        yield from out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now, left = timerValues.getCurrentWatermarkInMs(), []
        for at, value in list(self.items.iterator()):
            if value[0] + self.ttl_ms <= now:
                self.items.removeKey(at)
            else:
                left.append(value[0] + self.ttl_ms)
        if left:
            self.handle.registerTimer(min(left))
        else:
            self.last.clear()
        yield from ()

    def close(self) -> None:
        pass


def transcript_stream(messages: DataFrame, ttl_ms: int = 3_600_000, delay: str = "1 minute") -> DataFrame:
    """Every change of an item, from a stream of messages (see ``transcripts.merged``); the last ``version`` of an item is its row.

    An item that no message changed for ``ttl_ms`` (of ``at_ms``) is forgotten, and its state dropped once the
    watermark has passed that time; a final message after it stands alone, as one that never had a pending one.
    """
    with_state_store(messages.sparkSession)
    schema = f"client_id {messages.schema['client_id'].dataType.simpleString()}, id long, version long, {ITEM_SCHEMA}"
    known = messages.where("client_id IS NOT NULL AND id IS NOT NULL").withColumn("event_time", F.timestamp_millis(F.col("at_ms") + _SHIFT)).withWatermark("event_time", delay)
    return known.groupBy("client_id").transformWithState(_Transcript(ttl_ms), StructType.fromDDL(schema), "append", "eventTime")
