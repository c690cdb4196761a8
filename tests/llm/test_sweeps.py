"""URL rules, fingerprints and roles beside plain Python."""

import math
import random

import numpy as np
import pytest
import xxhash

from subtide.llm import chat, imatch, url_filters

RULES = "verdict string, host string, path string"


def brute_verdict(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    ends = [k for k, c in enumerate(rest) if c in "/?#"]
    host = rest[: ends[0]] if ends else rest
    host = "".join(c.lower() if c.isascii() else c for c in host)
    path = rest[len(host) :].split("?")[0].split("#")[0]
    fits = {}
    for verdict, h, p in rules:
        if h:
            h, p = h.lower(), p or ""
            if (host == h or host.endswith("." + h)) and path.startswith(p):
                fits[len(h + p), len(h), h + p] = max(verdict, fits.get((len(h + p), len(h), h + p), ""))
    best = max(fits, default=None)
    return (host, path, best[2] if best else None, fits[best] if best else "allow")


@pytest.mark.parametrize("per_cell", [3, 100_000])
def test_url_sweep(spark, monkeypatch, per_cell):
    monkeypatch.setattr(url_filters, "ROWS_PER_CELL", per_cell)
    rng = random.Random(4)
    labels, parts = ["a", "B", "com", "x-y", "é", ""], ["/", "a", "/a", "b", "7", "é", "\U0001f600", "~"]

    def host():
        return ".".join(rng.choice(labels) for _ in range(rng.randint(1, 4)))

    def path():
        return "/" + "".join(rng.choice(parts) for _ in range(rng.randint(0, 4)))

    rules = [(rng.choice(["block", "allow"]), host(), path() if rng.random() < 0.8 else "") for _ in range(150)] + [("block", None, "/"), ("allow", "com", None), ("block", "com", ""), ("block", "com", "")]
    urls = [f"http://{host()}{path()}{rng.choice(['', '?q/a', '#f'])}" for _ in range(600)] + ["http://a.com/a/b"] * 40 + [None, "", "://", "com/a", "http://" + "a." * 90 + "com/" + "a" * 9000]
    frame = spark.createDataFrame([(i % 500, u, "own", "taken") for i, u in enumerate(urls)], "page_id long, url string, rule string, best string")
    got = url_filters.filter_urls(frame, spark.createDataFrame(rules, RULES))
    assert got.columns == ["page_id", "url", "best", "host", "path", "rule", "verdict"]
    want = [(i % 500, u, "taken", *brute_verdict(u, rules)) for i, u in enumerate(urls)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_url_rules_are_those_of_the_contract(spark, tmp_path):
    urls = ["http://a.net/de/", "http://example.net/de/7", "http://example.net/de/8", "http://a.com/en/7", "http://example.com/en/7", "http://a.org/es/"]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filters.op5_url_filters(spark, str(tmp_path)).collect()}
    assert got == {0: ("net/de/", "allow"), 1: ("net/de/", "allow"), 2: ("example.net/de/8", "block"), 3: ("com/en/", "block"), 4: ("example.com/en/7", "allow"), 5: ("org/es/", "block")}


def test_url_empty_sides(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string")
    none = spark.createDataFrame([], RULES)
    assert [tuple(r) for r in url_filters.filter_urls(pages, none).collect()] == [(1, "http://a.com/x", "a.com", "/x", None, "allow")]
    assert url_filters.filter_urls(pages.limit(0), spark.createDataFrame([("block", "com", "")], RULES)).count() == 0


def brute_fingerprints(texts):
    """Twelve subset hashes of each text's sorted terms of the band, by sets and the xxhash library."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    sets = [{xxhash.xxh64_intdigest(w.encode(), 42) for w in (t or "").lower().replace("\t", " ").replace("\n", " ").split(" ") if w} for t in texts]
    df = {}
    for s in sets:
        for t in s:
            df[t] = df.get(t, 0) + 1
    least, most = (max(2, f(len(texts) * math.exp(-b))) for f, b in ((math.ceil, imatch.BAND[1]), (math.floor, imatch.BAND[0])))
    out = []
    for s in sets:
        kept = sorted(({t for t in s if least <= df[t] <= most} or s), key=signed)
        parts = []
        for at, zeros in imatch.SUBSETS:
            chosen = [t for t in kept if (t >> at) % (1 << zeros) == 0]
            h = 42
            for t in chosen:
                h = xxhash.xxh64_intdigest(t.to_bytes(8, "little"), h)
            parts.append(f"{h:016x}" if chosen else imatch.EMPTY)
        out.append(".".join(parts))
    return out


def brute_likeness(a, b):
    pairs = [(x, y) for x, y in zip(a.split("."), b.split("."), strict=True) if (x, y) != (imatch.EMPTY, imatch.EMPTY)]
    return sum(x == y for x, y in pairs) / len(pairs) if pairs else 1.0


@pytest.mark.parametrize("ids", [lambda i: i, lambda i: -(1 << 63) if i == 0 else (1 << 63) - 1 if i == 119 else i * i - 50])
def test_fingerprints_by_sets(spark, ids):
    rng = np.random.default_rng(8)
    words = [f"W{i}é" for i in range(300)]
    texts = [" ".join(rng.choice(words, int(n))) for n in rng.integers(1, 90, 114)] + [None, "", " \t\n", "Alone", "x\ty\nz", "long " * 30_000 + words[3]]
    frame = spark.createDataFrame([(ids(i), t, "own") for i, t in enumerate(texts)], "doc_id long, text string, fingerprint string")
    got = {r.doc_id: r for r in imatch.fingerprint_edits(frame.repartition(5)).collect()}
    want = brute_fingerprints(texts)
    for i in range(len(texts)):
        r, nxt = got[ids(i)], want[i - 1 if i else len(texts) - 1]
        assert r.fingerprint == want[i] and r.near_next == pytest.approx(brute_likeness(want[i], nxt)), i


def test_next_of_equal_ids(spark):
    rows = [(5, "b"), (5, "a"), (7, "c"), (1, "d")]
    got = imatch.with_next(spark.createDataFrame(rows, "doc_id long, text string"), ["text"]).collect()
    assert sorted((r.doc_id, r.text, r.next_text) for r in got) == [(1, "d", "c"), (5, "a", "d"), (5, "b", "a"), (7, "c", "b")]


def test_roles_are_the_best_path(spark):
    """Blocks joined by matrices reach the score of plain Viterbi over whole conversations."""
    rng = np.random.default_rng(6)
    starts = ["User: ", "Bot> ", "### Context: ", "", ""]
    rows = [(c, k, None if k == 3 else starts[rng.integers(5)] + " ".join(["word"] * int(rng.integers(0, 60))) + ("?" if rng.random() < 0.3 else ""), ["user", "assistant", "system"][int(rng.integers(3))], bool(rng.random() < 0.5)) for c in range(12) for k in range(int(rng.integers(1, 50)))]
    rows += [(99, 0, "", "user", True), (None, 0, "Human: hi", "user", True), (None, 1, "x" * 200_000, "user", False)]
    lines = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, line_no long, text string, role string, begins boolean, block string").cache()
    model = chat.fit(lines, 2)
    seen = lines.select("conv_id", "line_no", *[c.alias(n) for n, c in chat.observed(lines["text"]).items()]).collect()
    decoded = {bits: {(r.conv_id, r.line_no): 2 * chat.ROLES.index(r.role) + (not r.begins) for r in chat.decode(lines, model, bits).collect()} for bits in (0, 2, 12)}
    for conv in {r.conv_id for r in seen}:
        own = sorted((r for r in seen if r.conv_id == conv), key=lambda r: r.line_no)
        emit = [[model["marker"][s, r.marker] + model["size"][s, r["size"]] + model["asks"][s, r.asks] for s in range(chat.STATES)] for r in own]
        score = [e + (-math.log(len(chat.ROLES)) if s % 2 == 0 else -1e12) for s, e in enumerate(emit[0])]
        for e in emit[1:]:
            score = [max(score[a] + model["move"][a, s] for a in range(chat.STATES)) + e[s] for s in range(chat.STATES)]
        for path in decoded.values():
            states = [path[conv, r.line_no] for r in own]
            total = emit[0][states[0]] - math.log(len(chat.ROLES)) + sum(model["move"][a, b] + e[b] for a, b, e in zip(states, states[1:], emit[1:], strict=False))
            assert states[0] % 2 == 0 and total == pytest.approx(max(score))
    assert chat.turns(lines.limit(0), model, 2).count() == 0
