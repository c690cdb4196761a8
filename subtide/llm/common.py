"""Helpers shared by the training-data operators: table access, checkpoints and byte-level NumPy kernels."""

from __future__ import annotations

import ctypes
import inspect
import re
import secrets
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Space and the control characters 0x09 to 0x0D; everything else belongs to a word.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
PIECE_BYTES = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared checkpoint folder, which is set here only where the session has none."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def tabled(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again. For loops: a checkpoint hands on its plan's estimated size, which joins square."""
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. Only a local session may have none: it gets a temporary one; on a cluster that is an error."""
    context = spark.sparkContext
    if (folder := context.getCheckpointDir()) is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
        folder = context.getCheckpointDir()
    return folder


def lean(f: Callable) -> Callable:
    """``f``, a function of Arrow tables or of an iterator of batches, that hands unused memory back to the system when it ends.

    Python workers live on between tasks; what one task had at its peak would stay with each of them.
    """

    def over(it):
        try:
            yield from f(it)
        finally:
            _hand_back()

    def of_one(table):
        try:
            return f(table)
        finally:
            _hand_back()

    def of_two(left, right):
        try:
            return f(left, right)
        finally:
            _hand_back()

    return over if inspect.isgeneratorfunction(f) else of_one if len(inspect.signature(f).parameters) == 1 else of_two


def _hand_back() -> None:
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:  # glibc
        trim(0)


def fan_out(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its offsets; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, ends, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(data: np.ndarray, offsets: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole documents of about ``limit`` bytes: first row, last row (exclusive), bytes, offsets."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: A prime below 2**31: products of two residues fit 62 bits.
PRIME = (1 << 31) - 1
#: Bytes whose weighted sum stays below 2**62.
_SUMMED = 1 << 22


def _powers_of(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint32)
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more].astype(np.int64) * pow(base, done, PRIME) % PRIME
        done += more
    return out


_tables: dict[tuple[int, ...], list[tuple[np.ndarray, np.ndarray]]] = {}


class SpanHasher:
    """Hashes of byte spans that stand for the bytes themselves.

    Two polynomials modulo a prime with bases that are drawn anew for each run, so no pair of texts is known
    to collide: two given spans of n bytes are equal by chance with a probability under (n / 2**31)**2, and for
    texts written without knowledge of the bases about 2**-62. The bases travel with the object to the tasks.
    """

    def __init__(self, bases: tuple[int, int] | None = None):
        self.bases = bases or (1 << 16 | secrets.randbelow(PRIME - (1 << 17)), 1 << 16 | secrets.randbelow(PRIME - (1 << 17)))

    def _powers(self, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each base its powers and those of its inverse; kept for the process."""
        found = _tables.get(self.bases)
        if found is None or len(found[0][0]) < n:
            if len(_tables) > 1:
                _tables.clear()
            n = max(n, PIECE_BYTES + 1024)
            found = _tables[self.bases] = [(_powers_of(b, n), _powers_of(pow(b, -1, PRIME), n)) for b in self.bases]
        return found

    def sums(self, data: np.ndarray) -> list[np.ndarray]:
        """For each base the prefix sums of (byte + 1) * base**place, congruent modulo the prime."""
        n, out = len(data), []
        for power, _ in self._powers(n + 1):
            sums = np.zeros(n + 1, np.int64)
            carry = 0
            for a in range(0, n, _SUMMED):
                b = min(a + _SUMMED, n)
                part = sums[a + 1 : b + 1]
                np.multiply(power[a:b], data[a:b], out=part, dtype=np.int64)
                part += power[a:b]
                np.cumsum(part, out=part)
                part += carry
                carry = int(part[-1]) % PRIME
            out.append(sums)
        return out

    def spans(self, sums: list[np.ndarray], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of data[start:end]; the length is part of the hash."""
        halves = [(s[ends] - s[starts]) % PRIME * inverse[starts] % PRIME for s, (_, inverse) in zip(sums, self._powers(len(sums[0])), strict=True)]
        return mix(mix((halves[0] << 31 | halves[1]).view(np.uint64)) + (ends - starts).astype(np.uint64))


_ROLLING = 0x9E3779B97F4A7C15
_rolled: list[np.ndarray] = []


def _rolling(n: int) -> list[np.ndarray]:
    if not _rolled or len(_rolled[0]) < n:
        n = max(n, PIECE_BYTES + 1024)
        steps = [np.full(n, base, np.uint64) for base in (_ROLLING, pow(_ROLLING, -1, 1 << 64))]
        for power in steps:
            power[0] = 1
        _rolled[:] = [np.cumprod(power, dtype=np.uint64) for power in steps]
    return _rolled


def rolling_sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums modulo 2**64, for ``rolling_hashes``."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _rolling(len(data) + 1)[0][: len(data)], out=out[1:])
    return out


def rolling_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Cheap hashes of spans, the same in every run. Long spans can be made to collide: for features and routing only, never as identity."""
    return mix((sums[ends] - sums[starts]) * _rolling(len(sums))[1][starts] + (ends - starts).astype(np.uint64))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_spans(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each document the index of its first word (one entry more). ``space``: for each byte whether it parts words."""
    n = len(data)
    inside = ~space[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)
