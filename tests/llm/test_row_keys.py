"""Rows without an id or with a repeated one in the n-gram join."""

import hashlib

import numpy as np

from subtide.llm import ngram_join, suffix_dedup

DOCS = "doc_id long, text string, lang string"
A, B, C = ("alpha beta gamma delta epsilon zeta", "one two three four five six seven", "uno dos tres cuatro cinco seis siete")
LONG = " ".join(f"w{i}" for i in range(60))


def test_rows_with_different_texts_stay(spark):
    rows = [(None, A, "x"), (None, B, "x"), (None, B, "a"), (None, None, "x"), (None, "", "x"), (3, LONG, "x"), (5, C, "x"), (5, LONG + " end", "x"), (5, "", "x"), (9, A, "x")]
    got = ngram_join.drop_near_duplicates(spark.createDataFrame(rows, DOCS))
    assert got.columns == ["doc_id", "text", "lang"]
    want = {(9, A, "x"), (None, B, "a"), (None, None, "x"), (None, "", "x"), (3, LONG, "x"), (5, C, "x"), (5, "", "x")}
    kept = [tuple(r) for r in got.collect()]
    assert len(kept) == len(want) and set(kept) == want


def test_sets_without_ids_are_verified(spark):
    rows = [(None, LONG, "x"), (None, LONG + " end", "x"), (7, LONG + " other", "x")]
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, DOCS), 5, 8, 10).collect()
    assert [r.component_id for r in got] == [7, 7, 7]
    alone = ngram_join.drop_near_duplicates(spark.createDataFrame(rows[:2], DOCS)).collect()
    assert len(alone) == 1


def test_nested_sets_of_unlike_sizes(spark):
    words = [f"w{i}" for i in range(181)]
    rows = [(0, " ".join(words), "x"), (1, " ".join(words[:101]), "x")]
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(spark.createDataFrame(rows, DOCS), 2, 1, 2).collect()}
    assert got == {0: 0, 1: 0}
    bands = ngram_join.Bands(1, 2)
    for a in range(1, 400):
        low, high = bands.of(np.array([a, 2 * a]))
        assert high - low <= 1 and 2 * a < bands.low[low + 2]


def brute_repeats(rows):
    """Removed bytes of each row: covered by a 50-byte string that also starts in a row with a smaller id."""
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49) if i is not None else ():
            first[b[k : k + 50]] = min(i, first.get(b[k : k + 50], i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49) if i is not None else ():
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = True
        out.append((i, len(b), int(gone.sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return sorted(out, key=str)


def test_repeats_by_row(spark):
    """Unrelated texts under one id, repeated rows, rows without id, empty and very long texts."""
    rng = np.random.default_rng(2)
    a, u, v = (" ".join(f"{x:x}" for x in rng.integers(0, 1 << 30, 40)) for _ in range(3))
    long = " ".join(f"{x:x}" for x in rng.integers(0, 1 << 40, 60_000))
    rows = [(1, a), (5, a), (5, u), (5, u), (6, u[:120] + v), (None, v), (None, a), (None, None), (7, None), (7, ""), (7, v), (7, a + v), (8, long), (9, "x" + long[300_000:300_400] + "y"), (9, long), (-3, v[:60])]
    got = suffix_dedup.mark_repeats(spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, key string")).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in got), key=str) == brute_repeats(rows)
