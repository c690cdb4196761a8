"""Suffix-array de-duplication over a run-length index.

Every byte covered by a ``LENGTH``-byte string that also starts in a document with a smaller id is
marked. The index is a run-compressed Burrows-Wheeler transform with sampled run ends; matching
statistics of the strings are streamed through it right to left, and matches of full length whose
suffix interval holds a smaller document are marked.

The corpus is cut so that all places where a string could match meet in one task: every window of
``LENGTH`` bytes has a minimizer (the smallest hash of its ``SEED``-byte strings), neighbouring windows
with the same minimizer form one item, and items are dealt by minimizer. A first round finds the
minimizers that occur in two documents at all (8 bytes each, one per chunk of documents); only their
items are sent. A minimizer that occurs in very many chunks is dealt by the hash of each single
window instead, so that a common passage does not gather in one task. Equal items are sent once per
chunk and indexed once.

Exact copies are decided by the SHA-256 of the whole text, equal items by a hash whose bases are drawn for
each run (``SpanHasher``). The index holds a sample per run of the transform; the distinct items' bytes stay
beside it, for the extensions at sampled run ends.

Defined results: null is empty; texts shorter than ``LENGTH`` lose nothing; matches never cross documents;
a row is known by its id and text, and rows that repeat an id, with equal or different texts, do not
remove each other; rows without id lose nothing and remove nothing; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subtide.llm.common import SpanHasher, checkpointed, fan_out, flat, mix, pieces, rolling_hashes, rolling_sums

LENGTH, SEED, HOT_CHUNKS, LONGEST_RUN, CHUNK_BYTES = 50, 24, 64, 1024, 4 << 20


class RunLengthIndex:
    """Run-compressed BWT of items (bytes, each with a document), with sampled run ends.

    For the suffixes that share their first ``LENGTH`` bytes it also has the smallest document.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, docs: np.ndarray):
        items = len(offsets) - 1
        lengths = np.diff(offsets)
        n = len(data) + items
        text = np.zeros(n, np.int64)  # 0 ends an item, 1 to 256 are bytes
        item = np.repeat(np.arange(items), lengths + 1)
        place = np.arange(len(data)) + np.repeat(np.arange(items), lengths)
        text[place] = data.astype(np.int64) + 1
        stop = np.cumsum(lengths + 1) - 1
        left = stop[item] - np.arange(n)  # bytes before the end of the item
        present = np.unique(text)
        code = np.searchsorted(present, text)
        bits = int(len(present)).bit_length()
        step = min(63 // bits, LENGTH // 2)
        rank = np.zeros(n, np.int64)
        for j in range(step):
            rank <<= bits
            rank[: n - j] += np.where(left[: n - j] >= j, code[j:], 0)
        # Prefix doubling; a rank is the number of smaller suffixes, and only suffixes that still tie are sorted again.
        key, tied = rank, np.arange(n)
        rank = np.zeros(n, np.int64)
        early, width = None, 0
        while True:
            order = np.argsort(key)
            key, tied = key[order], tied[order]
            old = rank[tied]
            at = np.arange(len(tied))
            head = np.append(True, key[1:] != key[:-1])[: len(tied)]
            first = np.maximum.accumulate(np.where(head, at, 0))
            group = np.maximum.accumulate(np.where(np.append(True, old[1:] != old[:-1])[: len(tied)], at, 0))
            rank[tied] = old + first - group
            if early is None and 2 * step >= LENGTH:
                early, width = rank.copy(), step
            tied = tied[~(head & np.append(head[1:], True))[: len(tied)]]
            if not len(tied) and early is not None:
                break
            ahead = rank[np.minimum(tied + step, n - 1)]
            key = rank[tied] * (n + 1) + np.where(left[tied] < step, item[tied], ahead)
            step *= 2
        self.text, self.n = text, n
        sa = np.empty(n, np.int64)
        sa[rank] = np.arange(n)
        rest = LENGTH - width
        whole = left[sa] >= LENGTH
        second = early[np.minimum(sa + rest, n - 1)]
        same = whole[1:] & whole[:-1] & (early[sa[1:]] == early[sa[:-1]]) & (second[1:] == second[:-1])
        head = np.append(True, ~same)
        self.group = (np.cumsum(head) - 1).astype(np.int32)
        self.least_doc = np.minimum.reduceat(docs[item[sa]], np.flatnonzero(head))
        bwt = text[sa - 1]
        self.starts = np.flatnonzero(np.append(True, bwt[1:] != bwt[:-1]))
        self.chars = bwt[self.starts]
        sizes = np.diff(np.append(self.starts, n))
        self.first_sample, self.last_sample = sa[self.starts], sa[self.starts + sizes - 1]
        self.ends = self.starts + sizes - 1
        order = np.argsort(self.chars, kind="stable")
        upto = np.cumsum(sizes[order]) - sizes[order]  # smaller characters, then earlier runs of this one: C[c] + rank
        self.jump = np.empty(len(order), np.int64)
        self.jump[order] = upto
        self.by_char = self.chars[order] * len(order) + order

    def _common(self, at: np.ndarray, pattern: np.ndarray, start: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Symbols shared by the text from ``at`` and the pattern from ``start``, ``most`` at most."""
        out = np.zeros(len(at), np.int64)
        alive = np.flatnonzero(most > 0)
        for j in range(LENGTH):
            ahead = np.minimum(at[alive] + j, self.n - 1)
            alive = alive[(self.text[ahead] == pattern[np.minimum(start[alive] + j, len(pattern) - 1)])]
            out[alive] = j + 1
            alive = alive[most[alive] > j + 1]
            if not len(alive):
                break
        return out

    def matches(self, data: np.ndarray, offsets: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pattern and position of each full-length match that has a smaller document."""
        pattern = data.astype(np.int64) + 1
        runs = len(self.starts)
        active = np.argsort(-np.diff(offsets), kind="stable")
        lengths = np.diff(offsets)[active]
        at = offsets[1:][active] - 1
        row, length = np.zeros(len(active), np.int64), np.zeros(len(active), np.int64)
        which, where = [], []
        for t in range(int(lengths.max(initial=0))):
            live = int(np.searchsorted(-lengths, -t, "left"))  # lengths > t
            r, place = row[:live], at[:live] - t
            c = pattern[place]
            run = np.searchsorted(self.starts, r, "right") - 1
            miss = np.flatnonzero(self.chars[run] != c)
            if len(miss):
                key = np.searchsorted(self.by_char, c[miss] * runs + run[miss])
                options = []
                for k, samples in ((np.minimum(key, runs - 1), self.first_sample), (np.maximum(key - 1, 0), self.last_sample)):
                    other = self.by_char[k] % runs
                    good = self.by_char[k] // runs == c[miss]
                    options.append((other, np.where(good, self._common(samples[other], pattern, place[miss] + 1, np.where(good, np.minimum(length[miss], LENGTH), 0)), -1)))
                (a, x), (b, y) = options
                take = x >= y
                run[miss] = np.where(take, a, b)
                r[miss] = np.where(take, self.starts[a], self.ends[b])
                length[miss] = np.minimum(length[miss], np.maximum(x, y))  # -1: the character does not occur
            row[:live] = self.jump[run] + r - self.starts[run]
            length[:live] += 1
            full = np.flatnonzero(length[:live] >= LENGTH)
            hit = full[self.least_doc[self.group[row[full]]] < docs[active[full]]]
            which.append(active[hit])
            where.append(place[hit] - offsets[active[hit]])
        return (np.concatenate(which), np.concatenate(where)) if which else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows with the same minimizer: minimizer, document row, first and last window."""
    width = LENGTH - SEED + 1
    if len(data) < LENGTH:
        return (np.zeros(0, np.uint64),) + (np.zeros(0, np.int64),) * 3
    starts = np.arange(len(data) - SEED + 1)
    low = rolling_hashes(rolling_sums(data), starts, starts + SEED)
    size = 1
    while 2 * size <= width:
        low, size = np.minimum(low[:-size], low[size:]), 2 * size
    low = np.minimum(low[: len(low) - (width - size)], low[width - size :])
    window = np.arange(len(low))
    owner = np.searchsorted(offsets, window, "right") - 1
    inside = np.flatnonzero(window + LENGTH <= offsets[owner + 1])
    if not len(inside):
        return (np.zeros(0, np.uint64),) + (np.zeros(0, np.int64),) * 3
    low, owner = low[inside], owner[inside]
    head = np.append(True, (low[1:] != low[:-1]) | (inside[1:] != inside[:-1] + 1) | (owner[1:] != owner[:-1]))
    first = np.flatnonzero(head)
    last = np.append(first[1:], len(inside)) - 1
    long = np.flatnonzero(last - first >= LONGEST_RUN)
    if len(long):  # very repetitive texts: runs of at most LONGEST_RUN windows
        more = np.concatenate([np.arange(first[i] + LONGEST_RUN, last[i] + 1, LONGEST_RUN) for i in long])
        first = np.union1d(first, more)
        last = np.append(first[1:], len(inside)) - 1
    return low[first], owner[first], inside[first], inside[last]


def _chosen(left: pa.Table, right: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """The documents of a chunk that are the first with their text, once each, and their ties."""
    ties = _ties(right)
    seen: dict[tuple[int, int], int] = {}
    for i, name in enumerate(zip(left["doc_id"].to_pylist(), left["key"].to_pylist(), strict=True)):
        if name in ties:
            seen.setdefault(name, i)
    return left.take(pa.array(list(seen.values()), pa.int64())), np.array([ties[x] for x in seen], np.int64)


def _ties(right: pa.Table) -> dict[tuple[int, int], int]:
    """Id and text key of the first documents, each with a number that tells texts of one id apart."""
    own = right.filter(pa.compute.is_valid(right["rep"])) if right.num_rows else right
    return {(rep, key): tie for rep, key, tie in zip(own["rep"].to_pylist(), own["key"].to_pylist(), own["tie"].to_pylist(), strict=True)}


def _bytes(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    return flat(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column)


def _blob_rows(key: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, list[list[np.ndarray]]]:
    """Columns grouped by key."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    cuts = np.flatnonzero(np.diff(key)) + 1
    return key[np.append(0, cuts).astype(int)] if len(key) else key, [np.split(c[order], cuts) if len(key) else [] for c in columns]


def mark_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (start, end) of the removed bytes of each text."""
    spark, hasher = docs.sparkSession, SpanHasher()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    digest = F.sha2("text", 256)
    docs = docs.select("doc_id", "text", F.conv(F.left(digest, F.lit(15)), 16, 10).cast("long").alias("key"))
    firsts = docs.groupBy(digest.alias("text_sha")).agg(F.min("doc_id").alias("rep"), F.first("key").alias("key"), F.first(F.octet_length("text")).alias("n_bytes")).where("rep IS NOT NULL")
    firsts = checkpointed(firsts.select("rep", "key", "n_bytes"))
    total = firsts.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    chunks = max(fan_out(spark), total // CHUNK_BYTES + 1)
    lowest = firsts.groupBy(F.col("rep").alias("id")).agg(F.min("key").alias("lowest"))
    firsts = firsts.join(lowest, F.col("rep") == F.col("id")).select("rep", "key", F.when(F.col("key") == F.col("lowest"), F.lit(0)).otherwise(F.col("key")).cast("long").alias("tie"))

    def chunk(column: str):
        return F.pmod(F.xxhash64(column, "key"), F.lit(chunks))

    dealt = docs.select(chunk("doc_id").alias("chunk"), "doc_id", "key", "text").repartition(int(chunks), "chunk").groupBy("chunk")
    reps = firsts.select(chunk("rep").alias("chunk"), "rep", "key", "tie", F.lit(None).cast("binary").alias("blob"))

    def returned(keys: np.ndarray, blobs: list[bytes]) -> pa.Table:
        """Rows that go back to their chunks, beside those of ``reps``."""
        none = pa.nulls(len(keys), pa.int64())
        return pa.table({"chunk": pa.array(keys, pa.int64()), "rep": none, "key": none, "tie": none, "blob": pa.array(blobs, pa.binary())})

    def minimizers(left: pa.Table, right: pa.Table) -> pa.Table:
        left, _ = _chosen(left, right)
        names, found = left["doc_id"].to_numpy(), []
        data, offsets = _bytes(left["text"])
        for i, _, part, own in pieces(data, offsets):
            low, row, _, _ = _runs(part, own)
            found.append((low, names[i + row]))
        low, doc = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        low = low >> np.uint64(1)
        order = np.argsort(low, kind="stable")
        low, doc = low[order], doc[order]
        head = np.flatnonzero(np.append(True, low[1:] != low[:-1])) if len(low) else np.zeros(0, np.int64)
        several = np.minimum.reduceat(doc, head) != np.maximum.reduceat(doc, head) if len(head) else np.zeros(0, bool)
        low = low[head] << np.uint64(1) | several.astype(np.uint64)
        keys, (groups,) = _blob_rows(((low >> np.uint64(8)) % np.uint64(chunks)).astype(np.int64), [low])
        own = left["chunk"][0].as_py() if left.num_rows else 0
        return pa.table({"bucket": pa.array(keys, pa.int64()), "chunk": pa.array([own] * len(keys), pa.int64()), "blob": pa.array([g.tobytes() for g in groups], pa.binary())})

    def shared(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["blob"]]
        source = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        low = np.concatenate(parts)
        order = np.argsort(low >> np.uint64(1), kind="stable")
        low, source = low[order], source[order]
        head = np.append(True, low[1:] >> np.uint64(1) != low[:-1] >> np.uint64(1))
        group = np.cumsum(head) - 1
        count = np.bincount(group)
        several = np.bincount(group, (low & np.uint64(1)).astype(float)) > 0
        kept = (several | (count > 1))[group]
        low = low >> np.uint64(1) << np.uint64(1) | (count >= HOT_CHUNKS)[group].astype(np.uint64)
        keys, (groups,) = _blob_rows(table["chunk"].to_numpy()[source[kept]], [low[kept]])
        return returned(keys, [g.tobytes() for g in groups])

    def items(left: pa.Table, right: pa.Table) -> pa.Table:
        left, ties = _chosen(left, right)
        blobs = [np.frombuffer(x.as_buffer(), np.uint64) for x in right["blob"] if x.is_valid]
        wanted = np.sort(np.concatenate(blobs)) if blobs else np.zeros(0, np.uint64)
        names = left["doc_id"].to_numpy()
        data, offsets = _bytes(left["text"])
        found = []
        for i, _, part, own in pieces(data, offsets) if len(wanted) else []:
            low, row, first, last = _runs(part, own)
            low = low >> np.uint64(1) << np.uint64(1)
            place = np.minimum(np.searchsorted(wanted, low), len(wanted) - 1)
            take = wanted[place] >> np.uint64(1) == low >> np.uint64(1)
            hot = (wanted[place] & np.uint64(1) == 1)[take]
            low, row, first, last = low[take], row[take], first[take], last[take]
            n = (last - first + 1)[hot]
            single = np.repeat(first[hot], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            row = np.concatenate([row[~hot], np.repeat(row[hot], n)])
            start = np.concatenate([first[~hot], single])
            stop = np.concatenate([last[~hot], single]) + LENGTH
            content = hasher.spans(hasher.sums(part), start, stop)
            route = np.concatenate([mix(low[~hot]), content[len(low) - int(hot.sum()) :]])
            kind = np.concatenate([np.zeros(int((~hot).sum()), np.int64), np.ones(len(single), np.int64)])
            found.append((content, route, names[i + row], ties[i + row], start - own[row], stop - start, start + offsets[i], kind))
        if not found:
            return pa.table({"bucket": pa.array([], pa.int64()), "chunk": pa.array([], pa.int64()), "rows": pa.array([], pa.binary()), "text": pa.array([], pa.binary())})
        content, route, doc, tie, start, size, source, kind = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((doc, content))
        content, route, doc, tie, start, size, source, kind = (x[order] for x in (content, route, doc, tie, start, size, source, kind))
        head = np.append(True, content[1:] != content[:-1]) if len(content) else np.zeros(0, bool)
        least = doc[head][np.cumsum(head) - 1] if len(doc) else doc
        kind[doc != least] = 2  # decided here: a smaller document of this chunk has the same item
        route[kind == 2] = mix(np.flatnonzero(kind == 2).astype(np.uint64))
        table = np.stack([doc, tie, start, size, kind, content.view(np.int64), source], 1)
        keys, (groups,) = _blob_rows((route % np.uint64(chunks)).astype(np.int64), [table])
        raw, squeeze = data.tobytes(), zstandard.ZstdCompressor(level=1)
        texts = [squeeze.compress(b"".join(raw[s : s + z] for s, z in zip(g[g[:, 4] < 1, 6].tolist(), g[g[:, 4] < 1, 3].tolist(), strict=True))) for g in groups]
        own = left["chunk"][0].as_py()
        rows = [squeeze.compress(np.ascontiguousarray(g[:, :6].T).tobytes()) for g in groups]
        return pa.table({"bucket": pa.array(keys, pa.int64()), "chunk": pa.array([own] * len(keys), pa.int64()), "rows": pa.array(rows, pa.binary()), "text": pa.array(texts, pa.binary())})

    def matched(table: pa.Table) -> pa.Table:
        open_ = zstandard.ZstdDecompressor()
        rows = [np.frombuffer(open_.decompress(x.as_py()), np.int64).reshape(6, -1) for x in table["rows"]]
        source = np.repeat(table["chunk"].to_numpy(), [r.shape[1] for r in rows])
        doc, tie, start, size, kind, content = np.concatenate(rows, 1)
        text = np.frombuffer(b"".join(open_.decompress(x.as_py()) for x in table["text"]), np.uint8)
        at = np.cumsum(np.where(kind < 1, size, 0)) - np.where(kind < 1, size, 0)  # of the items whose text was sent
        whole = np.stack([source, doc, tie, start, start + size], 1)
        marks = [whole[kind == 2]]
        for own in (np.flatnonzero(kind == 1), np.flatnonzero(kind == 0)):
            own = own[np.lexsort((doc[own], content[own]))]
            if not len(own):
                continue
            head = np.append(True, content[own][1:] != content[own][:-1])
            group = np.cumsum(head) - 1
            later = doc[own] != doc[own][head][group]
            marks.append(whole[own[later]])
        if (kind == 0).any():
            distinct = own[head]
            sizes = size[distinct]
            offsets = np.append(0, np.cumsum(sizes))
            joined = text[np.repeat(at[distinct] - offsets[:-1], sizes) + np.arange(int(offsets[-1]))]
            which, where = RunLengthIndex(joined, offsets, doc[distinct]).matches(joined, offsets, doc[distinct])
            # positions found, for every place of the item in its first document
            order = np.argsort(which, kind="stable")
            which, where = which[order], where[order]
            left_, right_ = np.searchsorted(which, group), np.searchsorted(which, group, "right")
            n = np.where(later, 0, right_ - left_)
            place = np.repeat(own, n)
            pick = np.repeat(left_, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            first = start[place] + where[pick]
            marks.append(np.stack([source[place], doc[place], tie[place], first, first + LENGTH], 1))
        marks = np.concatenate(marks)
        keys, (groups,) = _blob_rows(marks[:, 0], [marks[:, 1:]])
        squeeze = zstandard.ZstdCompressor(level=1)
        return returned(keys, [squeeze.compress(np.ascontiguousarray(_merged(g).T).tobytes()) for g in groups])

    def result(left: pa.Table, right: pa.Table) -> pa.Table:
        ties = _ties(right)
        open_ = zstandard.ZstdDecompressor()
        marks = [np.frombuffer(open_.decompress(x.as_py()), np.int64).reshape(4, -1).T for x in right["blob"] if x.is_valid]
        marks = _merged(np.concatenate(marks) if marks else np.zeros((0, 4), np.int64))
        cuts = np.append(np.flatnonzero(np.append(True, (marks[1:, :2] != marks[:-1, :2]).any(1))), len(marks)) if len(marks) else np.zeros(1, np.int64)
        places = {tuple(marks[a, :2].tolist()): (a, b) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)}
        names, text_keys = left["doc_id"].to_pylist(), left["key"].to_pylist()
        data, offsets = _bytes(left["text"])
        view, out = memoryview(data.tobytes()), []
        for i, name in enumerate(names):
            own = view[offsets[i] : offsets[i + 1]]
            if name is None:
                spans = []
            elif (name, text_keys[i]) not in ties:  # a copy of a smaller document
                spans = [(0, len(own))] if len(own) >= LENGTH else []
            else:
                a, b = places.get((name, ties[name, text_keys[i]]), (0, 0))
                spans = [(s, e) for s, e in marks[a:b, 2:].tolist()]
            digest, at = hashlib.sha256(), 0
            for s, e in spans:
                digest.update(own[at:s])
                at = e
            digest.update(own[at:])
            out.append((name, len(own), sum(e - s for s, e in spans), len(spans), digest.hexdigest(), [{"start": s, "end": e} for s, e in spans]))
        columns = list(zip(*out, strict=True)) or [[]] * 6
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    back = "chunk long, rep long, key long, tie long, blob binary"
    sent = dealt.cogroup(reps.groupBy("chunk")).applyInArrow(minimizers, "bucket long, chunk long, blob binary")
    common = sent.groupBy("bucket").applyInArrow(shared, back)
    cut = dealt.cogroup(reps.unionByName(common).groupBy("chunk")).applyInArrow(items, "bucket long, chunk long, rows binary, text binary")
    marks = cut.groupBy("bucket").applyInArrow(matched, back)
    return dealt.cogroup(reps.unionByName(marks).groupBy("chunk")).applyInArrow(result, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:bigint,end:bigint>>")


def _merged(marks: np.ndarray) -> np.ndarray:
    """Rows (document, tie, start, end) in order, with touching or overlapping spans of a document joined."""
    if not len(marks):
        return marks
    marks = marks[np.lexsort((marks[:, 2], marks[:, 1], marks[:, 0]))]
    shift = marks[:, 3].max() + 2
    rank = np.cumsum(np.append(0, (marks[1:, :2] != marks[:-1, :2]).any(1))) * shift
    reach = np.maximum.accumulate(marks[:, 3] + rank)
    head = np.append(True, marks[1:, 2] + rank[1:] > reach[:-1])
    first = np.flatnonzero(head)
    last = np.append(first[1:], len(marks)) - 1
    return np.stack([marks[first, 0], marks[first, 1], marks[first, 2], reach[last] - rank[last]], 1)


def op10_suffix_dedup(spark, sf_dir) -> DataFrame:
    return mark_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")
