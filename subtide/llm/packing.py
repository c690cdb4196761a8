"""Best-fit packing: hierarchical residual packing of token pieces into sequences.

Each partition packs its own pieces best-fit, longest first. Nearly full bins are done; underfull bins
are items of the next round, dealt to as many tasks as hold ``ITEMS_PER_TASK`` of them, and packed
best-fit again. Rounds go on until one task held all items, or a round merged under 1 % of them.
No bin is dropped or capped; whatever is left underfull is a sequence as it is.

Defined results: a null or empty text is one piece of length 1 (the end id); documents longer than the
capacity are cut into pieces of the capacity; ties of equal lengths go by order in the partition;
repeated rows are packed as rows of their own.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subtide.llm.common import SpanHasher, checkpointed, flat, lean, lowered, pieces, word_spans

CAPACITY, END_ID, ITEMS_PER_TASK, CACHED_WORDS, ENCODED_BYTES = 4096, 1, 50_000, 400_000, 1 << 19


class WordIds:
    """Token ids of white-space separated words, each encoded once; right for tokenizers that ignore case and never join words."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads would each keep memory of their own
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.hasher = SpanHasher()  # of this process alone: hashes of words are never sent
        self._clear()

    def _clear(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.starts = self.counts = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _encoded(self, words: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words and their counts. Words of letters only are encoded many at a time: each ends with its first ending id."""
        found: list[list[int]] = [[]] * len(words)
        whole = np.flatnonzero(letters).tolist()
        lines = [whole[i : i + 256] for i in range(0, len(whole), 256)]
        rest = np.flatnonzero(~letters).tolist()
        for line, e in self._each(lines, lambda line: " ".join([words[i] for i in line]), 32):
            ids = e.ids
            stops = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(stops) != len(line):
                rest += line
                continue
            for i, a, b in zip(line, [0, *stops[:-1]], stops, strict=True):
                found[i] = ids[a:b]
        for i, e in self._each(rest, words.__getitem__, 4096):
            found[i] = e.ids
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for ids in found for i in ids), np.uint32, int(counts.sum())), counts

    def _each(self, items: list, text_of, at_once: int) -> Iterator[tuple]:
        """Items with their encodings, which are large and so not kept."""
        for k in range(0, len(items), at_once):
            part = items[k : k + at_once]
            yield from zip(part, self.tokenizer.encode_batch_fast([text_of(x) for x in part], add_special_tokens=False), strict=True)

    def _learn(self, hashes: np.ndarray, words: list[str], letters: np.ndarray) -> None:
        new, counts = self._encoded(words, letters)
        starts = np.cumsum(counts) - counts + len(self.ids)
        hashes, self.starts, self.counts, self.ids = np.concatenate([self.hashes, hashes]), np.concatenate([self.starts, starts]), np.concatenate([self.counts, counts]), np.concatenate([self.ids, new])
        order = np.argsort(hashes)
        self.hashes, self.starts, self.counts = hashes[order], self.starts[order], self.counts[order]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents, each followed by the end id, and the offsets of the documents."""
        raw = data.tobytes()
        if b"<|" not in raw:  # else capitals could turn into a special token
            data = lowered(data)
            raw = data.tobytes()
        starts, ends, first = _parts(data, *word_spans(data, offsets))
        words, at, inverse = np.unique(self.hasher.spans(self.hasher.sums(data), starts, ends), return_index=True, return_inverse=True)
        if len(self.hashes) > CACHED_WORDS:
            self._clear()
        place = np.searchsorted(self.hashes, words)
        known = np.zeros(len(words), bool)
        inside = place < len(self.hashes)
        known[inside] = self.hashes[place[inside]] == words[inside]
        if not known.all():
            new = at[~known]
            other = np.append(0, np.cumsum(~_letters(data)))
            texts = [raw[s:e].decode("utf-8", "replace") for s, e in zip(starts[new].tolist(), ends[new].tolist(), strict=True)]
            self._learn(words[~known], texts, other[starts[new]] == other[ends[new]])
            place = np.searchsorted(self.hashes, words)
        place = place[inverse]
        counts, origin = self.counts[place], self.starts[place]
        upto = np.concatenate([[0], np.cumsum(counts)])
        docs = np.arange(len(offsets))
        bounds = upto[first] + docs  # an end id more for each document before
        ids = np.full(int(bounds[-1]), END_ID, np.uint32)
        owner = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        target = np.repeat(upto[:-1] + owner - np.concatenate([[0], np.cumsum(counts)])[:-1], counts) + np.arange(int(upto[-1]))
        source = np.repeat(origin - upto[:-1], counts) + np.arange(int(upto[-1]))
        ids[target] = self.ids[source]
        return ids, bounds


_PLAIN = np.zeros(256, bool)
_PLAIN[[*range(48, 58), *range(97, 123)]] = True


def _letters(data: np.ndarray) -> np.ndarray:
    """Bytes of a to z and of the two-byte letters U+00C0 to U+00FF."""
    lead = data == 0xC3
    second = np.append(False, lead[:-1]) & (data >= 0x80) & (data <= 0xBF) & (data != 0x97) & (data != 0xB7)
    return (data >= 97) & (data <= 122) | second | lead & np.append(second[1:], False)


def _parts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word spans with a last full stop or comma after a plain letter or digit as a span of its own: always its own token."""
    if not len(starts):
        return starts, ends, first
    last = data[ends - 1]
    cut = (ends - starts > 1) & ((last == 44) | (last == 46)) & _PLAIN[data[ends - 2]]
    which = np.repeat(np.arange(len(starts)), 1 + cut)
    second = np.append(False, which[1:] == which[:-1])
    before = np.append(second[1:], False)
    return np.where(second, ends[which] - 1, starts[which]), np.where(before, ends[which] - 1, ends[which]), np.append(0, np.cumsum(1 + cut))[first]


_encoders: dict[str, WordIds] = {}


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of the pieces of each text."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get(tokenizer) or _encoders.setdefault(tokenizer, WordIds(tokenizer))
        for batch in it:
            names = batch.column(0)
            data, offsets = flat(batch.column(1))
            for i, j, part, own in pieces(data, offsets, ENCODED_BYTES):
                ids, bounds = encoder.encode(part, own)
                sizes = np.diff(bounds)
                n = -(-sizes // capacity)
                owner = np.repeat(np.arange(j - i), n)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(sizes[owner] - start, capacity)
                at = bounds[owner] + start
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
                columns = [names.slice(i, j - i).take(pa.array(owner)), *(pa.array(x, pa.int64()) for x in (piece, start, length, crc))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lean(batches), f"doc_id {kind}, piece long, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, longest first into the fullest bin that still takes it."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by room left
    rooms, count = 0, 0  # rooms: a bit for each room that has bins
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = rooms >> size
        if fits:
            room = (fits & -fits).bit_length() - 1 + size
            b = open_bins[room].pop()
            if not open_bins[room]:
                rooms ^= 1 << room
        else:
            b, room = count, capacity
            count += 1
        bins[i], offsets[i] = b, capacity - room
        left = room - size
        if left:
            if not open_bins[left]:
                rooms |= 1 << left
            open_bins[left].append(b)
    return bins, offsets


def _packed(items: DataFrame, capacity: int, level: int) -> DataFrame:
    """``items`` with bin and place: each partition packed by itself."""

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [x for x in it if len(x)]
        if rows:
            rows = pd.concat(rows, ignore_index=True)
            bins, places = best_fit(rows["length"].to_numpy(), capacity)
            yield rows.assign(bin=bins + (level << 56 | TaskContext.get().partitionId() << 32), place=places)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema)
    return items.mapInPandas(lean(batches), f"{fields}, bin long, place long")


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``items`` (with a column length, at most the capacity) with sequence_id and offset.

    The input should be a table or a checkpoint: bins are numbered by its partitions.
    """
    slack = capacity // 64
    pieces_in_bins = checkpointed(_packed(items, capacity, 0))
    moved = None  # bin -> next, shift
    under = pieces_in_bins.groupBy("bin").agg(F.sum("length").alias("length")).where(F.col("length") < capacity - slack)
    for level in range(1, 64):
        under = checkpointed(under)
        n = under.count()
        tasks = -(-n // ITEMS_PER_TASK)
        if n < 2:
            break
        dealt = under.withColumnRenamed("bin", "item").repartition(tasks, F.xxhash64("item", F.lit(level)))
        step = checkpointed(_packed(dealt, capacity, level)).select("item", F.col("bin").alias("next"), F.col("place").alias("shift"), "length")
        if moved is None:
            moved = step.select(F.col("item").alias("bin"), "next", "shift")
        else:
            later = step.select(F.col("item").alias("next"), F.col("next").alias("after"), F.col("shift").alias("more"))
            moved = moved.join(later, "next", "left").select("bin", F.coalesce("after", "next").alias("next"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift"))
        moved = checkpointed(moved)
        under = step.groupBy(F.col("next").alias("bin")).agg(F.sum("length").alias("length")).where(F.col("length") < capacity - slack)
        if tasks == 1 or step.select("next").distinct().count() > 0.99 * n:
            break
    if moved is None:
        return pieces_in_bins.withColumnsRenamed({"bin": "sequence_id", "place": "offset"})
    joined = pieces_in_bins.join(moved, "bin", "left")
    return joined.select(*items.columns, F.coalesce("next", "bin").alias("sequence_id"), (F.col("place") + F.coalesce("shift", F.lit(0))).alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return pack(checkpointed(token_pieces(docs, str(tokenizer), capacity)), capacity)


def op8_packing(spark, sf_dir) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
