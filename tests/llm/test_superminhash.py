"""SuperMinHash: signatures against a plain loop, components against all pairs, nulls, ties and large lists."""

import numpy as np
import pytest

from subtide.llm import superminhash
from subtide.llm.common import SpanHasher, mix
from subtide.llm.ngram_join import shingle_sets

DOCS = "doc_id long, text string, set_id string, component string"


def plain_signature(elements, m):
    """The same draws, one element at a time with a whole permutation each."""
    out = [(1 << 64) - 1] * m
    for x in elements:
        order = list(range(m))
        for j in range(m):
            drawn = int(mix(np.array([(int(x) + 0x9E3779B97F4A7C15 * (j + 1)) % (1 << 64)], np.uint64))[0])
            k = j + ((drawn & 0xFFFFFFFF) * (m - j) >> 32)
            order[j], order[k] = order[k], order[j]
            out[order[j]] = min(out[order[j]], j << 32 | drawn >> 32)
    return out


def test_signatures_are_those_of_the_whole_permutations():
    rng = np.random.default_rng(2)
    sizes = [0, 1, 2, 5, 40, 300, 0, 7]
    sets = rng.integers(0, 1 << 63, sum(sizes), dtype=np.int64).astype(np.uint64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    got = superminhash.signatures(sets, bounds, 32)
    for i in range(len(sizes)):
        assert got[i].tolist() == plain_signature(sets[bounds[i] : bounds[i + 1]], 32)


def test_equal_places_estimate_similarity_with_less_variance_than_independent_places():
    rng = np.random.default_rng(3)
    shares = []
    for _ in range(400):
        x = rng.integers(0, 1 << 63, 30, dtype=np.int64).astype(np.uint64)
        both = np.concatenate([np.sort(x[:24]), np.sort(x[6:])])  # 18 of 30 in common
        s = superminhash.signatures(both, np.array([0, 24, 48]), 64)
        shares.append((s[0] == s[1]).mean())
    assert abs(np.mean(shares) - 0.6) < 0.015
    assert np.var(shares) < 0.8 * 0.6 * 0.4 / 64


RNG = np.random.default_rng(8)
VOCAB = ["".join(RNG.choice(list("abcdefghij"), 5)) for _ in range(90)]


def edited(words, n, rng):
    words = list(words)
    for at in rng.choice(len(words), n, replace=False):
        words[at] = f"x{rng.integers(1 << 40)}"
    return " ".join(words)


def texts():
    rng = np.random.default_rng(9)
    base = [list(rng.choice(VOCAB, int(n))) for n in rng.integers(1, 160, 25)]
    out = [" ".join(b) for b in base]
    out += [edited(b, k, rng) for b in base if len(b) > 60 for k in (1, 2, 3, 3, 4, 6, 9)]  # on both sides of the threshold
    chain = list(rng.choice(VOCAB, 120))
    for i in range(0, 60, 2):  # each links with the next, the ends do not
        chain[i * 2 % 120] = f"y{i}"
        out.append(" ".join(chain))
    return [*out, *out[:6], None, "", " \t", "a", "A", "a b c", "a  B c", "word " * 500, "word " * 400, "é" * 90]


def brute(texts, words, num, den):
    sets = []
    for t in texts:
        w = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split()
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and den * len(a & sets[j]) >= num * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: (len(s), find(i), find(i) == i) for i, s in enumerate(sets)}


@pytest.mark.parametrize(("words", "num", "den", "most"), [(4, 80, 100, 256), (5, 8, 10, 2), (3, 8, 10, 4)])
def test_components(spark, monkeypatch, words, num, den, most):
    monkeypatch.setattr(superminhash, "RUN_SETS", most)
    monkeypatch.setattr(superminhash, "TILE_SETS", most)
    monkeypatch.setattr(superminhash, "REST_SETS", max(2, most // 4))
    monkeypatch.setattr(superminhash, "REST_SHINGLES", most * 40)
    monkeypatch.setattr(superminhash, "TILE_SHINGLES", most * 100)
    found = texts()
    docs = spark.createDataFrame([(i, t, "clash", "clash") for i, t in enumerate(found)], DOCS)
    got = superminhash.near_duplicates(docs, words, num, den).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute(found, words, num, den)


def test_lists_of_several_components_are_compared_inside(spark):
    """One band of one place: every list is a chance meeting, and links must come from the comparison within."""
    found = texts()
    docs = spark.createDataFrame(list(enumerate(found)), "doc_id long, text string")
    members = superminhash.tabled(docs.where("length(trim(text)) > 1").selectExpr("0L AS list", "doc_id AS set_id", "length(text) AS size"))
    tiles = superminhash.open_tiles(members, spark.createDataFrame([], "node long, root long")).join(docs.withColumnRenamed("doc_id", "set_id"), "set_id")
    links = superminhash.tile_links(tiles, 4, 8, 10, SpanHasher())
    root = {r.node: r.root for r in superminhash.components(links).collect()}
    want = brute(found, 4, 8, 10)
    for i, t in enumerate(found):
        if len((t or "").strip()) > 1:
            assert root.get(i, i) == want[i][1]


def test_rows_without_or_with_repeated_ids(spark):
    long = " ".join(VOCAB[:40])
    rows = [(None, long), (None, long), (3, long + " end"), (5, "other text of five words"), (5, long), (None, None), (None, "alone and without any id")]
    got = superminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in got) == sorted(
        [("None", "3", False), ("None", "3", False), ("3", "3", True), ("5", "5", True), ("5", "3", False), ("None", "None", True), ("None", "None", True)]
    )
    assert superminhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_shingle_sets_stay_whole_for_long_texts():
    text = " ".join(f"w{i}" for i in range(60_000)).encode()
    sets, bounds = shingle_sets(np.frombuffer(text, np.uint8), np.array([0, len(text)]), 4, SpanHasher())
    assert len(sets) == 59_997 and superminhash.signatures(sets, bounds, 160).max() < 1 << 32  # done in the first step
