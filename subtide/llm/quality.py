"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade > k) = sigmoid(w . x - threshold_k) with one weight vector w for all grades and ordered
thresholds. x holds the presence of hashed lower-cased words and word endings, and dense shape shares.
The model is fitted on at most ``FIT_ROWS`` labelled documents, those with the smallest hash of their
id; everything is scored. Scores are the expected grade and the tail probabilities.

Defined results: a null text is empty and has only the bias; unlabelled documents are scored alike;
with one grade among the labels, every document is kept with that grade, with none with grade 0. ``score``
replaces columns named like its own; ``kept`` adds none. Extra columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subtide.llm.common import flat, lean, lowered, pieces, rolling_hashes, rolling_sums, word_spans

FIT_ROWS, BUCKETS, LEAST_DOCS, STEPS = 12_000, 1 << 17, 6, 250
DENSE = 9
_MARK = np.isin(np.arange(256), np.frombuffer(b".,;:!?\"')", np.uint8))


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashed features of each document: owners, buckets; and dense shares (rows x DENSE)."""
    low = lowered(data)
    starts, ends, first = word_spans(low, offsets)
    n = len(offsets) - 1
    counts = np.diff(first)
    owner = np.repeat(np.arange(n), counts)
    sums = rolling_sums(low)
    word = rolling_hashes(sums, starts, ends)
    bare = ends.copy()  # without marks after the word
    for _ in range(3):
        bare -= (bare > starts + 1) & _MARK[low[bare - 1]]
    tail = rolling_hashes(sums, np.maximum(starts, bare - 3), bare) ^ np.uint64(0x5851F42D4C957F2D)
    keys = np.concatenate([owner, owner]).astype(np.uint64) << np.uint64(20) | np.concatenate([rolling_hashes(sums, starts, bare), tail]) % np.uint64(BUCKETS)
    keys = np.unique(keys)
    size = np.maximum(counts, 1).astype(float)
    per = lambda mask: np.bincount(owner, mask, n) / size
    same = np.zeros(len(word), bool)
    same[1:] = (word[1:] == word[:-1]) & (owner[1:] == owner[:-1])
    two = np.zeros(len(word), bool)
    two[2:] = (word[2:] == word[:-2]) & (owner[2:] == owner[:-2])
    last = low[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    symbol = ~(((last >= 97) & (last <= 122)) | ((last >= 48) & (last <= 57)) | (last >= 128) | _MARK[last])
    distinct = np.bincount(np.unique(owner.astype(np.uint64) << np.uint64(40) | word >> np.uint64(24)).astype(np.uint64) >> np.uint64(40), minlength=n)[:n] / size
    lengths = (ends - starts).astype(float)
    dense = np.stack([per(same), per(two), per(symbol), per(lengths == 1), distinct, per(lengths) / 10, np.minimum(per(lengths > 20) * 5, 1), np.log1p(counts) / 10, np.bincount(owner, low[starts] == 124 if len(starts) else None, n) / size], 1)
    return (keys >> np.uint64(20)).astype(np.int64), (keys & np.uint64((1 << 20) - 1)).astype(np.int64), dense


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Ordinal:
    """Shared weights and ordered thresholds, fitted by Adam on the cumulative-link likelihood."""

    def fit(self, owner: np.ndarray, bucket: np.ndarray, dense: np.ndarray, grade: np.ndarray, l2: float = 2e-4) -> Ordinal:
        n, self.grades = len(grade), int(grade.max(initial=0)) + 1
        seen = np.bincount(bucket, minlength=BUCKETS)
        kept = (seen >= LEAST_DOCS)[bucket]
        owner, bucket = owner[kept], bucket[kept]
        self.mean, self.scale = dense.mean(0), dense.std(0) + 1e-6
        dense = (dense - self.mean) / self.scale
        cuts = self.grades - 1
        w, v = np.zeros(BUCKETS), np.zeros(DENSE)
        # thresholds: the first, then logs of the gaps, so that they stay in order
        t = np.zeros(cuts)
        share = np.bincount(grade, minlength=self.grades) / max(n, 1)
        balance = (1 / np.maximum(share, 1e-3))[grade] ** 0.5
        balance /= balance.mean() if n else 1
        moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (w, v, t)]
        for step in range(1, STEPS + 1):
            z = np.bincount(owner, w[bucket], n) + dense @ v
            theta = t[0] + np.concatenate([[0], np.cumsum(np.exp(t[1:]))])
            above = np.stack([np.ones(n), *(_sigmoid(z - x) for x in theta), np.zeros(n)])
            i = np.arange(n)
            p = np.maximum(above[grade, i] - above[grade + 1, i], 1e-9)
            slope = above * (1 - above)
            dz = -(slope[grade, i] - slope[grade + 1, i]) / p * balance / n
            dtheta = np.zeros(cuts)
            for k in range(cuts):
                dtheta[k] = (((grade == k + 1) * slope[k + 1] - (grade == k) * slope[k + 1]) / p * balance).sum() / n
            gt = np.concatenate([[dtheta.sum()], [dtheta[k:].sum() * np.exp(t[k]) for k in range(1, cuts)]])
            for x, g, m in zip((w, v, t), (np.bincount(bucket, dz[owner], BUCKETS) + l2 * w, dense.T @ dz, gt), moments, strict=True):
                m[0] = 0.9 * m[0] + 0.1 * g
                m[1] = 0.99 * m[1] + 0.01 * g * g
                x -= 0.05 * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8)
        self.w, self.v, self.theta = w.astype(np.float32), v, t[0] + np.concatenate([[0], np.cumsum(np.exp(t[1:]))])
        return self

    def tails(self, owner: np.ndarray, bucket: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """P(grade > k), a row for each k."""
        z = np.bincount(owner, self.w[bucket], len(dense)) + (dense - self.mean) / self.scale @ self.v
        return np.stack([_sigmoid(z - x) for x in self.theta])


def graded(labels: DataFrame) -> DataFrame:
    """doc_id and grade: 0 low quality, 1 good but toxic, 2 good and clean; null labels count as 0."""
    quality, toxic = F.coalesce("quality", F.lit(0)), F.coalesce("toxic", F.lit(0))
    return labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.when(quality < 1, 0).when(toxic > 0, 1).otherwise(2)).alias("grade"))


def fit(docs: DataFrame, ratings: DataFrame, rows: int = FIT_ROWS) -> Ordinal | int:
    """A model of the ratings(doc_id, grade), from at most ``rows`` documents; the grade itself where there are fewer than two."""
    chosen = ratings.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            data, offsets = flat(batch.column("text"))
            for i, j, part, own in pieces(data, offsets):
                owner, bucket, dense = features(part, own)
                at = np.searchsorted(owner, np.arange(j - i + 1))
                rows = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(bucket, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("grade").slice(i, j - i), rows, pa.array(list(dense), pa.list_(pa.float64()))], names=["grade", "buckets", "dense"])

    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("grade", "text")  # at most ``rows`` ids
    got = found.mapInArrow(lean(batches), "grade int, buckets array<int>, dense array<double>").toArrow()
    grade = got["grade"].to_numpy().astype(np.int64)
    if len(np.unique(grade)) < 2:
        return int(grade.max(initial=0))
    buckets = got["buckets"].combine_chunks()
    owner = np.repeat(np.arange(len(grade)), np.asarray(buckets.value_lengths()))
    dense = np.asarray(got["dense"].combine_chunks().flatten()).reshape(-1, DENSE)
    return Ordinal().fit(owner, np.asarray(buckets.flatten()).astype(np.int64), dense, grade)


def score(docs: DataFrame, model: Ordinal | int, text: str = "text") -> DataFrame:
    """``docs`` with expected_grade, p_top (of the highest grade), p_above_low and keep; those columns are replaced."""
    added = ["expected_grade", "p_top", "p_above_low", "keep"]
    names = [c for c in docs.columns if c not in added]
    if isinstance(model, int):
        return docs.select(*names, F.lit(float(model)).alias("expected_grade"), F.lit(1.0).alias("p_top"), F.lit(1.0).alias("p_above_low"), F.lit(True).alias("keep"))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for i, j, tails in _tails(model, batch.column(0)):
                columns = [tails.sum(0), tails[-1], tails[0], tails[-1] >= 0.5]
                yield pa.RecordBatch.from_arrays([*[c.slice(i, j - i) for c in batch.columns[1:]], *map(pa.array, columns)], names=[*names, *added])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return docs.select(docs[text], *[docs[c] for c in names]).mapInArrow(lean(batches), f"{fields}, expected_grade double, p_top double, p_above_low double, keep boolean")


def kept(docs: DataFrame, model: Ordinal | int, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose top grade is at least as likely as not."""
    if isinstance(model, int):
        return docs

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for i, j, tails in _tails(model, batch.column(place)):
                yield batch.slice(i, j - i).filter(pa.array(tails[-1] >= 0.5))

    place = docs.columns.index(text)
    return docs.mapInArrow(lean(batches), docs.schema)


def _tails(model: Ordinal, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    data, offsets = flat(texts)
    for i, j, part, own in pieces(data, offsets):
        yield i, j, model.tails(*features(part, own))


def op7_quality(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, graded(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.drop("text")
