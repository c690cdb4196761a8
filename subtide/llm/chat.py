"""Chat formatting: roles of transcript lines by a hidden Markov model, then canonical turns.

States are a role's first line or a later line of its turn. A line emits its speaker marker, a length
class and whether it ends in a question; tables of transitions and emissions are counted from lines
with known roles, over the whole table. Viterbi runs over blocks of a conversation: each block gives
its max-plus matrix (best score from any state before it to any state at its end), the matrices of a
conversation are chained, and each block is decoded between its two known states. So a conversation
of any length is spread over many tasks, with the result of one pass.

Defined results: null and empty lines are lines without marker; lines with equal numbers go by a hash
of their text; an empty table gives no turns; a conversation's first line always begins a turn; extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from subtide.llm.common import fan_out

ROLES = ["system", "user", "assistant"]
# Speaker names in transcripts, by role.
NAMES = {"system": ["system", "instructions", "context"], "user": ["user", "human", "q", "customer"], "assistant": ["assistant", "bot", "ai", "a", "agent"]}
STATES = len(ROLES) * 2  # role * 2 + (0 for the first line of a turn, 1 for a later one)
MARKERS, LENGTHS = len(ROLES) + 1, 10
LINES_PER_TASK = 200_000
BLOCK_BITS = 12
_MARK = r"^\s*(?:#+\s*|\*\*|<\|)?([A-Za-z]+)(?:\*\*)?\s*(?:\|>|[:>.]|\s-)(?:\*\*)?\s*"


def observed(text: Column) -> dict[str, Column]:
    """marker (0 for none, else 1 + role), size (length class), asks (0 or 1) and body (the line without its marker)."""
    text = F.coalesce(text, F.lit(""))
    name = F.lower(F.regexp_extract(text, _MARK, 1))
    marker = F.lit(0)
    for i, role in enumerate(ROLES):
        marker = F.when(name.isin(NAMES[role]), i + 1).otherwise(marker)
    size = F.least(F.floor(F.log2(F.length(text) + 1)), F.lit(LENGTHS - 1)).cast("int")
    body = F.when(marker > 0, F.regexp_replace(text, _MARK, "")).otherwise(text)
    return {"marker": marker.cast("int"), "size": size, "asks": F.endswith(F.rtrim(text), F.lit("?")).cast("int"), "body": body}


def fit(lines: DataFrame, block_bits: int = BLOCK_BITS) -> dict[str, np.ndarray]:
    """Log tables from lines(conv_id, line_no, text, role, begins); counts with add-one smoothing."""
    state = F.lit(0)
    for i, role in enumerate(ROLES):
        state = F.when(F.col("role") == role, 2 * i).otherwise(state)
    seen = lines.select("conv_id", "line_no", (state + F.when(F.col("begins"), 0).otherwise(1)).cast("int").alias("state"), *[c.alias(n) for n, c in observed(F.col("text")).items() if n != "body"])
    # Transitions inside blocks only: a block's first line has none.
    step = W.partitionBy("conv_id", F.shiftright("line_no", block_bits)).orderBy("line_no")
    seen = seen.withColumn("was", F.lag("state").over(step))
    got = seen.groupBy("was", "state", "marker", "size", "asks").agg(F.count("*").alias("n")).collect()  # at most 7 * 6 * 4 * 10 * 2 rows
    tables = {"move": np.ones((STATES, STATES)), "marker": np.ones((STATES, MARKERS)), "size": np.ones((STATES, LENGTHS)), "asks": np.ones((STATES, 2))}
    for r in got:
        if r["was"] is not None:
            tables["move"][r["was"], r["state"]] += r["n"]
        for k in ("marker", "size", "asks"):
            tables[k][r["state"], r[k]] += r["n"]
    tables = {k: np.log(t / t.sum(1, keepdims=True)) for k, t in tables.items()}
    # A later line can only follow a line of its own turn.
    for r in range(len(ROLES)):
        for s in range(STATES):
            if s // 2 != r:
                tables["move"][s, 2 * r + 1] = -1e9
    return tables


def _emissions(model: dict[str, np.ndarray], table: pa.Table) -> np.ndarray:
    return sum(model[k][:, table[k].to_numpy()] for k in ("marker", "size", "asks")).T


def _blocks(table: pa.Table) -> list[np.ndarray]:
    conv, block = table["conv"].to_numpy(), table["block"].to_numpy()
    order = np.lexsort((table["rank"].to_numpy(), table["line_no"].to_numpy(), block, conv))
    if not len(order):
        return []
    return np.split(order, np.flatnonzero(np.diff(conv[order]) | np.diff(block[order])) + 1)


def _chain(rows: list[dict]) -> list[tuple[int, int]]:
    """Entry and exit state of each block of a conversation, by Viterbi over the blocks' matrices."""
    score, back = None, []
    for k, r in enumerate(rows):
        m = np.asarray(r["matrix"]).reshape(STATES + 1, STATES)
        if k == 0:
            score = m[STATES]
            back.append(np.full(STATES, -1))
        else:
            total = score[:, None] + m[:STATES]
            back.append(total.argmax(0))
            score = total.max(0)
    state, out = int(score.argmax()), []
    for b in reversed(back):
        out.append((int(b[state]), state))
        state = int(b[state])
    return out[::-1]


_START = np.full(STATES, -1e12)
_START[0::2] = -np.log(len(ROLES))


def _path(model: dict[str, np.ndarray], emit: np.ndarray, entry: int, leave: int) -> np.ndarray:
    """The best states of a block's lines between the state before it (-1: none) and the one at its end."""
    score, back = (_START if entry < 0 else model["move"][entry]) + emit[0], []
    for e in emit[1:]:
        total = score[:, None] + model["move"]
        back.append(total.argmax(0))
        score = total.max(0) + e
    found, state = np.zeros(len(emit), np.int64), leave
    for i in range(len(emit) - 1, 0, -1):
        found[i] = state
        state = int(back[i - 1][state])
    found[0] = state
    return found


def _with_states(lines: DataFrame, model: dict[str, np.ndarray], block_bits: int, rows_of, schema: str) -> DataFrame:
    """``rows_of(table, places, states, alone, last)`` for every block of lines(conv_id, line_no, text).

    Texts are shuffled once, by block; the matrices and their chains hold numbers only.
    """
    seen = lines.select("conv_id", "line_no", *[c.alias(n) for n, c in observed(F.col("text")).items()])
    seen = seen.select("*", F.xxhash64("conv_id").alias("conv"), F.shiftright("line_no", block_bits).alias("block"), F.xxhash64("body").alias("rank"))
    tasks = max(fan_out(lines.sparkSession), lines.count() // LINES_PER_TASK + 1)
    task = F.pmod(F.xxhash64("conv", "block"), F.lit(tasks)).alias("task")

    def matrices(table: pa.Table) -> pa.Table:
        emit, out = _emissions(model, table), []
        for rows in _blocks(table):
            best = np.vstack([np.where(np.eye(STATES, dtype=bool), 0.0, -1e12)[:, :, None] + model["move"][None], _START[None, None].repeat(STATES, 1)]).max(1) + emit[rows[0]]
            for i in rows[1:]:
                best = (best[:, :, None] + model["move"][None]).max(1) + emit[i]
            out.append({"conv": table["conv"][int(rows[0])].as_py(), "block": table["block"][int(rows[0])].as_py(), "matrix": best.ravel().tolist()})
        return pa.Table.from_pylist(out, pa.schema([("conv", pa.int64()), ("block", pa.int64()), ("matrix", pa.list_(pa.float64()))]))

    def chained(table: pa.Table) -> pa.Table:
        rows = table.sort_by([("conv", "ascending"), ("block", "ascending")]).to_pylist()
        out, at = [], 0
        while at < len(rows):
            end = at
            while end < len(rows) and rows[end]["conv"] == rows[at]["conv"]:
                end += 1
            out += [{"conv": r["conv"], "block": r["block"], "entry": a, "leave": b, "alone": end - at == 1, "last": r is rows[end - 1]} for r, (a, b) in zip(rows[at:end], _chain(rows[at:end]), strict=True)]
            at = end
        return pa.Table.from_pylist(out, pa.schema([("conv", pa.int64()), ("block", pa.int64()), ("entry", pa.int32()), ("leave", pa.int32()), ("alone", pa.bool_()), ("last", pa.bool_())]))

    def states(left: pa.Table, right: pa.Table) -> pa.Table:
        ends = {(r["conv"], r["block"]): r for r in right.to_pylist()}
        emit = _emissions(model, left)

        def found():
            for rows in _blocks(left):
                end = ends[left["conv"][int(rows[0])].as_py(), left["block"][int(rows[0])].as_py()]
                yield rows, lambda rows=rows, end=end: _path(model, emit[rows], end["entry"], end["leave"]), end["alone"], end["last"]

        return rows_of(left, found())

    parts = seen.select(task, "conv", "block", "line_no", "rank", "marker", "size", "asks").groupBy("task").applyInArrow(matrices, "conv long, block long, matrix array<double>")
    ends = parts.groupBy(F.pmod("conv", F.lit(tasks)).alias("task")).applyInArrow(chained, "conv long, block long, entry int, leave int, alone boolean, last boolean")
    both = seen.select(task, "*").groupBy("task").cogroup(ends.select(task, "*").groupBy("task"))
    kind = lines.schema["conv_id"].dataType.simpleString()
    return both.applyInArrow(states, f"conv_id {kind}, {schema}")


def decode(lines: DataFrame, model: dict[str, np.ndarray], block_bits: int = BLOCK_BITS) -> DataFrame:
    """lines(conv_id, line_no, text) with role, begins and body."""

    def rows_of(left: pa.Table, blocks) -> pa.Table:
        states = np.zeros(left.num_rows, np.int64)
        for rows, path, _, _ in blocks:
            states[rows] = path()
        return pa.table({"conv_id": left["conv_id"], "line_no": left["line_no"], "body": left["body"], "role": pa.array([ROLES[s // 2] for s in states], pa.string()), "begins": pa.array(states % 2 == 0)})

    return _with_states(lines, model, block_bits, rows_of, "line_no long, body string, role string, begins boolean")


def turns(lines: DataFrame, model: dict[str, np.ndarray], block_bits: int = BLOCK_BITS) -> DataFrame:
    """conv_id, first_line, role, n_lines, text and rendered, a row for each turn of lines(conv_id, line_no, text).

    Turns within a block are joined where the block is decoded; only the pieces of turns that cross a block's
    edge are shuffled again.
    """

    def pieces(crossing: bool):
        def rows_of(left: pa.Table, blocks) -> pa.Table:
            number, body = left["line_no"].to_numpy(), left["body"]
            at, first, role, size, text = [], [], [], [], []
            for rows, path, alone, last in blocks:
                if crossing and alone:
                    continue
                states = path()
                begins = states % 2 == 0
                cuts = [0, *(k for k in np.flatnonzero(begins).tolist() if k), len(rows)]
                whole = body.take(pa.array(rows)).to_pylist()
                for a, b in zip(cuts, cuts[1:], strict=False):
                    if crossing == (not begins[a] or (b == len(rows) and not last)):
                        at.append(int(rows[a]))
                        first.append(int(number[rows[a]]) if begins[a] else None)
                        role.append(ROLES[states[a] // 2])
                        size.append(b - a)
                        text.append("\n".join(whole[a:b]))
            taken = left.select(["conv_id", "line_no"]).take(pa.array(at, pa.int64()))
            return pa.table({"conv_id": taken["conv_id"], "line_no": taken["line_no"], "first_line": pa.array(first, pa.int64()), "role": pa.array(role, pa.string()), "n_lines": pa.array(size, pa.int64()), "text": pa.array(text, pa.string())})

        return _with_states(lines, model, block_bits, rows_of, "line_no long, first_line long, role string, n_lines long, text string")

    order = W.partitionBy("conv_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    crossing = pieces(True).withColumn("first_line", F.last("first_line", ignorenulls=True).over(order))
    parts = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    joined = crossing.groupBy("conv_id", "first_line").agg(F.min_by("role", "line_no").alias("role"), F.sum("n_lines").alias("n_lines"), F.array_join(F.transform(parts, lambda x: x["text"]), "\n").alias("text"))
    whole = pieces(False).drop("line_no").unionByName(joined)
    return whole.select("conv_id", "first_line", "role", "n_lines", "text", F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("\n<|end|>")).alias("rendered"))


TURN_BITS = 24


def as_transcript(conversations: DataFrame) -> DataFrame:
    """Conversations as the lines of raw transcripts: markers in one of four styles, absent from a fifth of the turns after the first."""
    h = F.xxhash64("conv_id")
    role = F.coalesce("role", F.lit("user"))
    names = [("User: ", "Assistant: ", "System: "), ("**Human** - ", "**Bot** - ", "**System** - "), ("### Q. ", "### A. ", "### Context: "), ("customer> ", "agent> ", "instructions> ")]
    marker = F.lit("")
    for k, (u, a, s) in enumerate(names):
        marker = F.when(F.pmod(h, F.lit(4)) == k, F.when(role == "user", u).when(role == "assistant", a).otherwise(s)).otherwise(marker)
    bare = (F.col("turn") > 0) & (F.pmod(F.xxhash64("conv_id", "turn"), F.lit(5)) == 0)
    lines = conversations.select("conv_id", "turn", role.alias("role"), F.when(bare, "").otherwise(marker).alias("marker"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("i", "line"))
    line_no = F.shiftleft(F.coalesce(F.col("turn"), F.lit(0)).cast("long"), TURN_BITS) + F.col("i")
    return lines.select("conv_id", line_no.alias("line_no"), F.when(F.col("i") == 0, F.concat("marker", "line")).otherwise(F.col("line")).alias("text"), "role", (F.col("i") == 0).alias("begins"))


def op2_chat(spark, sf_dir) -> DataFrame:
    lines = as_transcript(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    bits = TURN_BITS + 6  # blocks of 64 turns
    found = turns(lines, fit(lines, bits), bits)
    return found.select("conv_id", F.shiftright("first_line", TURN_BITS).alias("turn"), F.expr(f"first_line & {(1 << TURN_BITS) - 1}").alias("line"), "role", "n_lines", "rendered")
