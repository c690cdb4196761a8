"""Phrase collocations from count streams in prefix and suffix order.

Counts of all phrases up to ``most_words`` words that occur ``least`` times or more are kept as two streams of one
table. In prefix order a phrase directly follows what it begins with, so a single pass with a stack gives it the
counts of all its beginnings, and gives those the count of their commonest extension to the right. In suffix
order (words reversed) the same pass gives the counts of its ends and the extension to the left. No stream is
looked up in another by hash: sorted neighbours meet in lockstep.

Only frequent phrases reach the streams. A phrase is never more frequent than its parts, so words and pairs are
counted first by a 40-bit hash (combined in blocks of text before the shuffle), then longer phrases both of whose
parts of one word less are frequent. What is frequent by hash is marked in a bitmap of ``FILTER_BITS`` bits, 8 MB at
any size of the corpus. A shared hash or bit can only let more phrases through; those are then counted exactly, by
their words, so the filter changes the cost and never the result. Where a corpus fills the bitmap, more rows are
counted exactly.

A phrase lies inside a longer one of nearly its count exactly if one of its extensions by one word has nearly its
count, as counts fall with length; so the two extension counts decide which phrases are dropped.

Defined results: a null language is ``und``; null and empty texts have no words; words are lower-cased in A-Z only and
never join across pieces or documents; ties go by count, then by the phrase's bytes; an empty table has no rows;
other columns and repeated rows are no special case: every row counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from subtide.llm.common import SpanHasher, fan_out, flat, lean, lowered, mix, pieces, tabled, word_spans

LEAST, MOST_WORDS, TOP, SHARE, SALTS = 30, 4, 2000, (80, 100), 16
BLOCK_BYTES, FILTER_BITS, KEY_BITS = 4 << 20, 26, 40
_C = mix(np.arange(201, 265, dtype=np.uint64)) | np.uint64(1)
_BREAK, _BLANK = np.zeros(256, bool), np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_BLANK[[0x20, 0x09, *np.flatnonzero(_BREAK)]] = True


class Tokens:
    """Words of a block of texts: start, end, hash, lang (row of ``langs``) and whether the next word is in the same piece."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lang: np.ndarray, hasher: SpanHasher):
        starts, ends, hashes, owners, breaks = [], [], [], [], []
        for i, _, part, own in pieces(data, offsets):
            low = lowered(part)
            start, end, first = word_spans(low, own, _BLANK)
            breaks.append(np.cumsum(_BREAK[low])[start] if len(start) else start)
            hashes.append(hasher.spans(hasher.sums(low), start, end))
            owners.append(np.repeat(np.arange(i, i + len(own) - 1), np.diff(first)))
            starts.append(start + offsets[i])
            ends.append(end + offsets[i])
        none = np.zeros(0, np.int64)
        self.data = data
        self.start, self.end, owner, at = (np.concatenate([none, *x]) for x in (starts, ends, owners, breaks))
        self.hash, self.lang = np.concatenate([none.view(np.uint64), *hashes]), lang[owner]
        self.next = (owner[1:] == owner[:-1]) & (at[1:] == at[:-1])

    def grams(self, n: int, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where phrases of n words begin, and a hash of each."""
        m = len(self.hash) - n + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        valid, key = np.ones(m, bool), salt[self.lang[:m]] + _C[40:41] * np.uint64(n)
        for j in range(n):
            key += self.hash[j : j + m] * _C[j]
            if j:
                valid &= self.next[j - 1 : j - 1 + m]
        at = np.flatnonzero(valid)
        return at, mix(key[at])

    def words(self, at: np.ndarray, n: int) -> pa.ListArray:
        """The words of the phrases that begin there."""
        every = (at[:, None] + np.arange(n)).ravel()
        low = lowered(self.data)
        flat_words = pa.array([low[a:b].tobytes() for a, b in zip(self.start[every].tolist(), self.end[every].tolist(), strict=True)], pa.binary()).cast(pa.string())
        return pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * n, pa.int32()), flat_words)


def _blocks(batch: pa.RecordBatch, hasher: SpanHasher) -> Iterator[tuple[Tokens, pa.Array, np.ndarray]]:
    """Tokens of blocks of whole documents, the languages and a hash of each."""
    coded = batch.column("lang").dictionary_encode()
    names = coded.dictionary
    salt = np.array([int.from_bytes(hashlib.md5(x.encode()).digest()[:8], "little") for x in names.to_pylist()], np.uint64)
    lang = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    data, offsets = flat(batch.column("text"))
    for i, j, part, own in pieces(data, offsets, BLOCK_BYTES):
        yield Tokens(part, own, lang[i:j], hasher), names, salt


class Marks:
    """The bitmap of frequent hashes, as it is read in a task."""

    def __init__(self, shared: Broadcast):
        self.bits = np.frombuffer(shared.value, np.uint8)
        self.shift = np.uint64(65 - (8 * len(self.bits)).bit_length())

    def has(self, key: np.ndarray) -> np.ndarray:
        cell = key >> self.shift
        return (self.bits[(cell >> np.uint64(3)).astype(np.int64)] >> (cell & np.uint64(7)).astype(np.uint8) & 1).astype(bool)

    def parts_pass(self, tokens: Tokens, n: int, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of n words whose two parts of n - 1 words are marked (all of them for n = 1)."""
        at, key = tokens.grams(n, salt)
        if n > 1 and len(at):
            inner, part = tokens.grams(n - 1, salt)
            good = np.zeros(len(tokens.hash) + 1, bool)
            good[inner] = self.has(part)
            kept = good[at] & good[at + 1]
            at, key = at[kept], key[kept]
        return at, key


def _marked(docs: DataFrame, sizes: tuple[int, ...], least: int, hasher: SpanHasher, known: bytearray) -> bytearray:
    """``known`` with the bits of phrases of these sizes that are frequent by hash; at most 2**FILTER_BITS bits come to the driver."""
    shared = docs.sparkSession.sparkContext.broadcast(bytes(known))

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = Marks(shared)
        for batch in it:
            for tokens, _, salt in _blocks(batch, hasher):
                keys = [tokens.grams(n, salt)[1] if n <= 2 else marks.parts_pass(tokens, n, salt)[1] for n in sizes]
                found, times = np.unique(np.concatenate(keys) >> np.uint64(64 - KEY_BITS), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(times, pa.int64())], names=["gram", "n"])

    counted = docs.mapInArrow(lean(count), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    cell = F.shiftright("gram", KEY_BITS - FILTER_BITS) + 1
    bits = counted.groupBy(F.bitmap_bucket_number(cell).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(cell)).alias("bits"))
    out, own = np.frombuffer(bytes(known), np.uint8).copy(), (1 << 15) // 8
    for bucket, part in bits.collect():  # at most 2**(FILTER_BITS - 15) rows of 4 KB
        out[(bucket - 1) * own : bucket * own] |= np.frombuffer(part, np.uint8)
    return bytearray(out.tobytes())


def phrase_counts(docs: DataFrame, least: int = LEAST, most_words: int = MOST_WORDS) -> DataFrame:
    """lang, words, f: the exact counts of all phrases of up to ``most_words`` words with f >= ``least``; an empty phrase counts the words of the language."""
    docs, hasher = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text"), SpanHasher()
    bits = _marked(docs, (1, 2), least, hasher, bytearray((1 << FILTER_BITS) // 8))
    for n in range(3, most_words):
        bits = _marked(docs, (n,), least, hasher, bits)
    shared = docs.sparkSession.sparkContext.broadcast(bytes(bits))

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = Marks(shared)
        for batch in it:
            for tokens, names, salt in _blocks(batch, hasher):
                total = np.bincount(tokens.lang, minlength=len(names))
                yield pa.RecordBatch.from_arrays([names, pa.array([[]] * len(names), pa.list_(pa.string())), pa.array(total, pa.int64())], names=["lang", "words", "f"])
                for n in range(1, most_words + 1):
                    at, key = marks.parts_pass(tokens, n, salt)
                    if n < max(most_words, 3) and len(at):
                        kept = marks.has(key)
                        at, key = at[kept], key[kept]
                    _, first, times = np.unique(key, return_index=True, return_counts=True)
                    at = at[first]
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(tokens.lang[at])), tokens.words(at, n), pa.array(times, pa.int64())], names=["lang", "words", "f"])

    counted = docs.mapInArrow(lean(count), "lang string, words array<string>, f long").groupBy("lang", "words").agg(F.sum("f").alias("f"))
    return tabled(counted.where((F.col("f") >= least) | (F.size("words") == 0)))


def lockstep(stream: DataFrame, key: Column, inner: str, longest: str) -> DataFrame:
    """``stream`` of lang, words, f and others, for phrases of two words or more: with ``inner``, the counts of the beginnings of
    ``key`` from one word on, and ``longest``, the largest count of an extension of ``key`` by one word.

    A task gets all keys with one first word, or with one part of their second words; the counts of single words are repeated
    for each part, so a word that begins a third of all phrases is ``SALTS`` tasks.
    """
    others = [c for c in stream.columns if c not in ("lang", "words", "f")]
    salts = F.when(F.size("words") == 1, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.pmod(F.xxhash64(F.get("key", F.lit(1))), F.lit(SALTS)).cast("int")))
    rows = stream.withColumn("key", key).withColumn("salt", F.explode(salts)).withColumn("first", F.get("key", F.lit(0)))
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}
    shape = ", ".join([f"{c} {kinds[c]}" for c in stream.columns] + [f"{inner} array<long>", f"{longest} long"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list[list] = []  # key, f, largest extension, row, counts of the beginnings
        task = None
        for batch in it:
            done: list[list] = []
            for row in batch.to_pylist():
                own, at = row["key"], (row["lang"], row["salt"])
                while open_ and (at != task or open_[-1][0] != own[: len(open_[-1][0])]):
                    done.append(open_.pop())
                task = at
                if open_ and len(open_[-1][0]) + 1 == len(own):
                    open_[-1][2] = max(open_[-1][2], row["f"])
                open_.append([own, row["f"], 0, row, [x[1] for x in open_]])
            yield rows_of(done)
        yield rows_of(open_)

    def rows_of(done: list[list]) -> pa.RecordBatch:
        done = [x for x in done if len(x[0]) > 1]
        columns = {c: pa.array([x[3][c] for x in done], schema[c]) for c in ("lang", "words", "f", *others)}
        return pa.RecordBatch.from_pydict(columns | {inner: pa.array([x[4] for x in done], pa.list_(pa.int64())), longest: pa.array([x[2] for x in done], pa.int64())})

    schema = {"lang": pa.string(), "words": pa.list_(pa.string()), "f": pa.int64()} | {c: pa.list_(pa.int64()) if kinds[c].startswith("array") else pa.int64() for c in others}
    dealt = rows.repartition(fan_out(stream.sparkSession), "lang", "first", "salt").sortWithinPartitions("lang", "salt", "key")
    return dealt.select("lang", "salt", "key", "words", "f", *others).mapInArrow(lean(run), shape)


def collocations(docs: DataFrame, least: int = LEAST, most_words: int = MOST_WORDS, share: tuple[int, int] = SHARE, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language by the score of their worst cut."""
    counts = phrase_counts(docs, least, most_words)
    totals = counts.where(F.size("words") == 0).select("lang", F.col("f").alias("n"))
    begun = lockstep(counts.where(F.size("words") > 0), F.col("words"), "heads", "right")
    # Phrases of one word carry no counts of their own beginnings, but the stream in suffix order needs them.
    singles = counts.where(F.size("words") == 1).withColumns({"heads": F.lit(None).cast("array<long>"), "right": F.lit(0).cast("long")})
    both = lockstep(begun.unionByName(singles), F.reverse("words"), "tails", "left")
    parts = F.transform(
        F.sequence(F.lit(1), F.size("words") - 1),
        lambda k: F.struct(_score(F.col("f"), F.get("heads", k - 1), F.get("tails", F.size("words") - k - 1)).alias("score"), k.alias("k"), F.get("heads", k - 1).alias("l"), F.get("tails", F.size("words") - k - 1).alias("r")),
    )
    kept = both.where(F.greatest("left", "right") * share[1] < F.col("f") * share[0])
    scored = kept.select("lang", F.array_join("words", " ").alias("phrase"), F.col("f").alias("a"), F.array_min(parts).alias("cut"))
    flat_rows = scored.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    ranked = flat_rows.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _score(a: Column, first: Column, rest: Column) -> Column:
    """floor(2000000 * a / (first + rest)), in decimals: the product may pass 64 bits."""
    wide = [c.cast("decimal(19,0)") for c in (a, first, rest)]
    return F.call_function("div", wide[0] * F.lit(2000000).cast("decimal(7,0)"), wide[1] + wide[2])


def op13_collocations(spark, sf_dir) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
worded AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM worded GROUP BY lang),
sizes AS (SELECT unnest(range(1, 5)) AS size),
grams AS (SELECT lang, size, w[i:i + size - 1] AS words FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM worded, sizes WHERE len(w) >= size)),
counts AS (SELECT lang, size, words, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
cuts AS (SELECT lang, words, f AS a, unnest(range(1, size)) AS k FROM counts WHERE size > 1),
scored AS (SELECT c.*, l.f AS l, r.f AS r, CAST(c.a::HUGEINT * 2000000 // (l.f + r.f) AS BIGINT) AS score
           FROM cuts c JOIN counts l ON l.lang = c.lang AND l.words = c.words[1:k] JOIN counts r ON r.lang = c.lang AND r.words = c.words[k + 1:]),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, k) = 1),
inner_parts AS (SELECT lang, f, unnest(list_transform(range(1, size - len + 2), lambda i: words[i:i + len - 1])) AS words FROM counts, (SELECT unnest(range(2, 4)) AS len) WHERE size > len),
dropped AS (SELECT DISTINCT w.lang, w.words FROM worst w JOIN inner_parts p ON p.lang = w.lang AND p.words = w.words WHERE 100 * p.f >= 80 * w.a),
kept AS (SELECT w.*, array_to_string(w.words, ' ') AS phrase FROM worst w ANTI JOIN dropped d ON d.lang = w.lang AND d.words = w.words),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
