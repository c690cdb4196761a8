"""Words that collide under a polynomial hash modulo 2**64 stay different."""

import zlib

import numpy as np
import pytest

from subtide.llm import common, ngram_join, packing, suffix_dedup

DOCS = "doc_id long, text string"


def two_letter_words(n: int) -> tuple[str, str]:
    """The sequence of the parity of bit counts and its complement: equal under any odd base modulo 2**64 from 1,024 letters on."""
    bits = [k.bit_count() % 2 for k in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [1024, 2048])
def test_two_letter_words_stay_apart(spark, n):
    import public_tokenizers
    from tokenizers import Tokenizer

    a, b = two_letter_words(n)
    data = np.frombuffer((a + b).encode(), np.uint8)
    starts, ends = np.array([0, n]), np.array([n, 2 * n])
    x, y = common.rolling_hashes(common.rolling_sums(data), starts, ends)
    assert x == y
    hasher = common.SpanHasher()
    x, y = hasher.spans(hasher.sums(data), starts, ends)
    assert x != y

    docs = spark.createDataFrame([(0, a), (1, b), (2, f"{a} {b} x y"), (3, f"{b} {a} x y")], DOCS)
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(docs, 4, 85, 100).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3}

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in packing.pack_documents(docs.where("doc_id < 2")).collect():
        ids = [*tokenizer.encode((a, b)[r.doc_id], add_special_tokens=False).ids, 1][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())

    # every 50-byte string of both words, by brute force
    first: dict[bytes, int] = {}
    for i, t in enumerate((a, b)):
        for k in range(n - 49):
            first.setdefault(t[k : k + 50].encode(), i)
    gone = np.zeros(n, bool)
    for k in range(n - 49):
        if first[b[k : k + 50].encode()] == 0:
            gone[k : k + 50] = True
    got = {r.doc_id: r.n_removed for r in suffix_dedup.mark_repeats(docs.where("doc_id < 2")).collect()}
    assert got == {0: 0, 1: int(gone.sum())}


def test_hashes_do_not_depend_on_place_or_batch():
    rng = np.random.default_rng(3)
    hasher, word = common.SpanHasher(), rng.integers(0, 256, 37).astype(np.uint8)
    seen = set()
    for before in (0, 1, 5, (1 << 22) - 10, (1 << 22) + 3):
        data = np.concatenate([rng.integers(0, 256, before).astype(np.uint8), word, word[:3]])
        seen.add(int(hasher.spans(hasher.sums(data), np.array([before]), np.array([before + len(word)]))[0]))
    assert len(seen) == 1
