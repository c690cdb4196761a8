"""Collocations against plain Python: counts, cuts, contained phrases, and a bitmap that is too small."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from subtide.llm import collocations

DOCS = "doc_id long, text string, lang string, words string, f long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, most, top=2000):
    counts, totals = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        own = counts.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            w = re.findall(r"[^ \t]+", piece)
            totals[lang] += len(w)
            own.update(tuple(w[i : i + n]) for n in range(1, most + 1) for i in range(len(w) - n + 1))
    out = []
    for lang, own in counts.items():
        frequent, kept = {p: a for p, a in own.items() if a >= least}, []
        for p, a in frequent.items():
            inside = any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in frequent.items())
            if len(p) > 1 and not inside:
                score, k = min((2000000 * a // (own[p[:k]] + own[p[k:]]), k) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, totals[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(kept)[:top])]
    return sorted(out)


def texts():
    rng = np.random.default_rng(4)
    vocab = ["the", "of", "New", "york", "É", "a\x01", "a", "x" * 300, "ça", "b"]
    out = []
    for i in range(60):
        w = rng.choice(vocab, int(rng.integers(0, 60)), p=[0.3, 0.2, 0.1, 0.1, 0.05, 0.05, 0.05, 0.05, 0.05, 0.05])
        out.append(("".join(x + rng.choice([" ", "  ", "\t", ", ", ".", "\n", "\r\n"], p=[0.6, 0.1, 0.1, 0.05, 0.05, 0.05, 0.05]) for x in w), ["en", "en", None, "de", "und"][i % 5]))
    passage = "one two three four five six seven"
    return [*out, *[(passage, "en")] * 9, (None, "en"), ("", None), ("...", "fr"), ("lone", ""), ("the the the the the the " * 400, "en")]


@pytest.mark.parametrize(("least", "most", "bits", "salts"), [(3, 4, 26, 16), (2, 3, 15, 2), (4, 5, 26, 1), (3, 2, 16, 3)])
def test_collocations(spark, monkeypatch, least, most, bits, salts):
    monkeypatch.setattr(collocations, "FILTER_BITS", bits)
    monkeypatch.setattr(collocations, "SALTS", salts)
    rows = texts()
    docs = spark.createDataFrame([(i, *r, "clash", 1) for i, r in enumerate(rows)], DOCS)
    got = collocations.collocations(docs, least, most)
    assert sorted(map(tuple, got.collect())) == brute(rows, least, most)
    assert dict(got.dtypes)["score"] == dict(got.dtypes)["rank"] == "bigint"


def test_a_full_bitmap_changes_nothing(spark, monkeypatch):
    rows = texts()
    docs = spark.createDataFrame(rows, "text string, lang string")
    monkeypatch.setattr(collocations, "_marked", lambda docs, sizes, least, hasher, known: bytearray(b"\xff" * len(known)))
    assert sorted(map(tuple, collocations.collocations(docs, 3, top=20).collect())) == brute(rows, 3, 4, 20)


def test_scores_past_64_bits(spark):
    a, l, r = 9 * 10**18, 9 * 10**18, 2 * 10**12 + 1
    row = spark.range(1).select(collocations._score(F.lit(a), F.lit(l), F.lit(r)).alias("s")).first()
    assert row.s == 2000000 * a // (l + r)


def test_no_rows(spark):
    assert collocations.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0
