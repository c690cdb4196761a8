"""Brute-force versions, round trips and edge cases of the training-data operators."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from subtide.llm import chat, imatch, matroska, mixing, ngram_join, packing, quality, secrets, suffix_dedup, url_filters

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, source="s"):
    return spark.createDataFrame([(i, t, "en", source if i % 3 else None, len(t or "")) for i, t in enumerate(texts)], DOCS)


RNG = np.random.default_rng(5)
VOCAB = ["".join(RNG.choice(list("abcdefghij"), 5)) for _ in range(80)]
LINE = " ".join(VOCAB[:14])
BASE = [" ".join(RNG.choice(VOCAB, int(n))) for n in RNG.integers(1, 120, 30)]
TEXTS = [*BASE, *BASE[:5], *(b + " changed end" for b in BASE[:12]), LINE + " one", "two " + LINE, LINE * 3, None, "", " ", "a", "Le " * 90, "Le " * 70, "é" * 80, "x" * 49, "x" * 50]
TEXTS = [*TEXTS, *[" ".join([*VOCAB[:60], f"n{i}"]) for i in range(40)]]


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=5000), st.sampled_from([None, "xiph", "ebml"]))
def test_matroska_round_trip(payload, lacing):
    media = matroska.mux(payload, lacing)
    packets, cues, error = matroska.demux(media)
    assert error is None and b"".join(media[p[6] : p[6] + p[7]] for p in packets) == payload
    assert len(cues) == -(-len(packets) // (matroska.FRAMES_PER_BLOCK * matroska.BLOCKS_PER_CLUSTER))
    _, _, cut = matroska.demux(media[:-3])
    assert cut is not None


def test_matroska_query(spark):
    stored = matroska.store(docs_of(spark, TEXTS).select("doc_id", "text"), "text").drop("text")
    for r in matroska.payload_digests(matroska.packet_table(stored)).collect():
        text = (TEXTS[r.doc_id] or "").encode()
        payload = text + b"\0" * ((-len(text)) % 64 or (0 if text else 64))
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


def brute_components(texts, words, num, den):
    sets = []
    for t in texts:
        w = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split()
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    root = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j in range(i):
                if a and sets[j] and den * len(a & sets[j]) >= num * len(a | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
    return [(len(s), r) for s, r in zip(sets, root, strict=True)]


@pytest.mark.parametrize(("words", "num", "den"), [(4, 85, 100), (5, 8, 10), (2, 1, 2)])
@pytest.mark.parametrize("most", [256, 4])
def test_ngram_join(spark, monkeypatch, words, num, den, most):
    monkeypatch.setattr(ngram_join, "BUNDLE_SETS", most)
    monkeypatch.setattr(ngram_join, "TILE_SETS", 8)
    monkeypatch.setattr(ngram_join, "REST_SETS", 4)
    monkeypatch.setattr(ngram_join, "LIST_SETS", most)
    got = ngram_join.jaccard_components(docs_of(spark, TEXTS), words, num, den).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == dict(enumerate(brute_components(TEXTS, words, num, den)))


def test_empty_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    assert ngram_join.jaccard_components(empty, 4, 85, 100).count() == 0
    assert suffix_dedup.mark_repeats(empty).count() == 0
    assert mixing.mix_sources(empty).count() == 0
    assert imatch.fingerprint_edits(empty).count() == 0
    assert packing.pack_documents(empty).count() == 0
    assert secrets.scan_documents(empty).count() == 0


def test_suffix_dedup(spark, monkeypatch):
    for hot in (64, 2):
        monkeypatch.setattr(suffix_dedup, "HOT_CHUNKS", hot)
        got = {r.doc_id: r for r in suffix_dedup.mark_repeats(docs_of(spark, TEXTS)).collect()}
        first = {}
        for i, t in enumerate(TEXTS):
            b = (t or "").encode()
            for k in range(len(b) - 49):
                first.setdefault(b[k : k + 50], i)
        for i, t in enumerate(TEXTS):
            b = (t or "").encode()
            gone = np.zeros(len(b) + 1, bool)
            for k in range(len(b) - 49):
                if first[b[k : k + 50]] < i:
                    gone[k : k + 50] = True
            kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
            spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
            assert (got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()), i


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = [*TEXTS, "Don't, U.S.A., 12.5. <|endoftext|> <|ENDOFTEXT|>", "ÀÉ,.. q", "lang " * 9000]
    rows = packing.pack_documents(docs_of(spark, texts)).collect()
    for r in rows:
        ids = [*tokenizer.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 1][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes()) and len(ids) == r.length
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert b[0][0] == 0 and all(x[0] + x[1] == y[0] for x, y in zip(b, b[1:], strict=False)) and sum(b[-1]) <= 4096
    assert len(bins) <= -(-sum(r.length for r in rows) // 4096) + 1


def test_mixing(spark):
    rows = mixing.mix_sources(docs_of(spark, TEXTS)).collect()
    for source in ("s", None):
        own = [r for r in rows if r.source == source]
        assert sum(r.taken for r in own) == int(own[0].target + 0.5) and all(0 <= r.taken <= 2 * r.size for r in own)


def test_url_rules(spark):
    urls = [(0, "http://a.example.com/en/7x?q"), (1, "http://a.example.com/en/6"), (2, "https://x.org/es/"), (3, "https://xcom/en/"), (4, None), (5, "no scheme"), (6, "http://COM/en/#f"), (7, "http://b.example.net/de/81")]
    rules = spark.createDataFrame(url_filters.RULES, "verdict string, host string, path string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filters.filter_urls(spark.createDataFrame(urls, "page_id long, url string"), rules).collect()}
    assert got == {0: ("example.com/en/7", "allow"), 1: ("com/en/", "block"), 2: ("org/es/", "block"), 3: (None, "allow"), 4: (None, "allow"), 5: (None, "allow"), 6: ("com/en/", "block"), 7: ("example.net/de/8", "block")}


def test_fingerprints(spark):
    got = {r.doc_id: r for r in imatch.fingerprint_edits(docs_of(spark, TEXTS)).collect()}
    n = len(TEXTS)
    for i, r in got.items():
        own, nxt = TEXTS[i] or "", TEXTS[i - 1 if i else n - 1] or ""
        half = len(own) // 2
        assert r.edited_sha256 == hashlib.sha256((own[: len(own) - half] + nxt[:half]).encode()).hexdigest() and r.n_chars == len(own)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert all(got[i].fingerprint == got[30 + i].fingerprint for i in range(5))


def test_quality_held_out(spark):
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(VOCAB, 60)) for _ in range(600)]
    grade = rng.integers(0, 3, 600)
    texts = [t if g == 2 else t + " horrid scum" if g == 1 else " ".join([t.split()[0]] * 40) for t, g in zip(texts, grade, strict=True)]
    frame = docs_of(spark, texts)
    ratings = spark.createDataFrame([(i, int(g)) for i, g in enumerate(grade) if i < 300], "doc_id long, grade int")
    scored = {r.doc_id: r.keep for r in quality.score(frame, quality.fit(frame, ratings)).collect()}
    assert np.mean([scored[i] == (grade[i] == 2) for i in range(300, 600)]) > 0.95


def test_secrets(spark):
    texts = [f"{b} password={'%018x' % (i * 7919 + 10**18)} and more {'ab' * 12}" for i, b in enumerate(BASE)] + [f"{b} AKIA{'%016d' % (i * 7 + 3)}" for i, b in enumerate(BASE)]
    frame = docs_of(spark, [*texts, None, "clean words only"])
    found = secrets.scan_documents(frame).collect()
    assert {r.doc_id for r in found if r.is_secret} == set(range(60)) and not any(r.is_secret for r in found if r.digits == 0)
    clean = {r.doc_id: r.text for r in secrets.redact(frame).collect()}
    assert clean[60] is None and clean[61] == "clean words only" and all("[SECRET]" in clean[i] and "password=1" not in clean[i] for i in range(30)) and "ab" * 12 in clean[0]


def test_chat_blocks_agree(spark):
    turns = [(c, t, ["user", "assistant"][t % 2], f"Is it {t}?" if t % 2 == 0 else " ".join(BASE[t % 30].split()[:40]) + " end of it\nsecond line") for c in range(40) for t in range(12)]
    lines = chat.as_transcript(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).cache()
    model = chat.fit(lines, 40)
    results = []
    for bits in (0, 24, 26, 40):
        results.append(sorted((r.conv_id, r.first_line, r.role, r.n_lines, r.rendered) for r in chat.turns(lines, model, bits).collect()))
    assert results[0] == results[1] == results[2]
    truth = {(r.conv_id, r.line_no): r.role for r in lines.collect()}
    got = {(r.conv_id, r.line_no): r.role for r in chat.decode(lines, model, 40).collect()}
    assert np.mean([got[k] == v for k, v in truth.items()]) > 0.95
