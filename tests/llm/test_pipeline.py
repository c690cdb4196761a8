"""The five stages and the whole run against plain Python, on a table with hostile columns and rows."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from subtide.llm import mixing, quality, secrets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep boolean, pass int, copies int, taken_id long, numbers array<int>, text_hash long, hit_id long, row_key string, slot long, p_top double, __text string, bin long"
RNG = np.random.default_rng(11)
WORDS = ["".join(RNG.choice(list("abcdefghijklmnop"), int(n))) for n in RNG.integers(3, 9, 300)]


def prose(n):
    return " ".join(RNG.choice(WORDS, n))


def tables(spark, path):
    good = [prose(int(n)) for n in RNG.integers(20, 200, 140)]
    bad = [" ".join([str(RNG.choice(WORDS))] * 40) for _ in range(60)]
    rows = []
    for i, t in enumerate([*good, *bad]):
        rows.append((i, t, f"s{i % 3}" if i % 7 else None))
    rows += [(500 + i, good[i] + " tail", "s1") for i in range(10)]  # near copies
    rows += [(600 + i, good[20 + i], "s2") for i in range(10)]  # exact copies
    rows += [(700, prose(80) + f' token = "{"9f8e7d6c5b4a39281706f5e4d3c2b1a0"}" and more', "s0"), (701, prose(9000), "s1"), (702, None, "s0"), (703, "", None), (None, good[40] + " x", "s0"), (None, prose(50), "s0"), (5, prose(60), "s1"), (6, good[6], "s0")]
    full = [(i, t, "en", s, len(t or ""), True, 1, 2, 3, [1], 4, 5, "r", 6, 0.5, "t", 7) for i, t, s in rows]
    spark.createDataFrame(full, SCHEMA).write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(i < 140), 0) for i in range(200)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return rows


def shingles(t, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def groups(texts):
    """Component number of each different text."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        return x if root[x] == x else find(root[x])

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 10 * len(a & sets[j]) >= 8 * len(a | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))]


def read(df):
    return [tuple(r) for r in df.select("doc_id", "text", "source").collect()]


def size(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def check_stages(spark, rows, path):
    docs = spark.read.parquet(f"{path}/documents.parquet")
    out, base = docs, f"{path}/stages"
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = read(out)
        out = stage(spark, out, path)
        if k < 4:
            assert out.columns == docs.columns, name
            assert [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        out.write.parquet(f"{base}/{k}")
        out = spark.read.parquet(f"{base}/{k}")
        yield k, before, out


def test_stages(spark, tmp_path):
    path = str(tmp_path)
    rows = tables(spark, path)
    for k, before, out in check_stages(spark, rows, path):
        if k == 0:
            model = quality.fit(spark.read.parquet(f"{path}/documents.parquet"), quality.graded(spark.read.parquet(f"{path}/labels.parquet")))
            owner, bucket, dense = quality.features(*quality.flat(__import__("pyarrow").array([t for _, t, _ in before], "string")))
            want = [r for r, p in zip(before, model.tails(owner, bucket, dense)[-1], strict=True) if p >= 0.5]
            got = read(out)
            assert Counter(got) == Counter(want)
            assert {r[0] for r in got} >= set(range(140)) and not {r[0] for r in got} & set(range(140, 200))
        elif k == 1:
            got, distinct = read(out), list(dict.fromkeys((i, t) for i, t, _ in before))
            names = groups([t for _, t in distinct])
            members = defaultdict(list)
            for (i, t), g in zip(distinct, names, strict=True):
                members[g if shingles(t) else (i, t)].append((i is None, i, t))
            assert sum(1 for m in members.values()) == len(got)
            smallest = {min(m, key=lambda x: (x[0], x[1] or 0))[1] for m in members.values()}
            assert {i for i, _, _ in got} == smallest
            assert all(len(set(got) & {(i, t, s) for i, t, s in before if (i is None, i, t) in m}) == 1 for m in members.values())
        elif k == 2:
            clean = {i: t for i, t, _ in read(out) if i is not None}
            assert len(read(out)) == len(before) and "9f8e7d6c" not in clean[700] and f'token = "{secrets.REDACTED}" and more' in clean[700]
            assert Counter(r for r in read(out) if r[0] != 700) == Counter(r for r in before if r[0] != 700)
        elif k == 3:
            check_mix(before, read(out))
        else:
            check_packing(before, out.collect())


def check_mix(before, after, ordered=False):
    """Passes over whole documents in the order of the schedule, from the same points and shuffles. ordered: ``after`` was not written and read."""
    import hashlib

    stream = defaultdict(list)
    for i, t, s in before:
        name = "".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (i, s, t))
        stream[s].append((hashlib.md5(name.encode()).hexdigest(), i, t, s))
    keys = sorted(stream, key=lambda s: (s is None, s))
    sizes = {s: sum(size(t) for _, _, t, _ in stream[s]) for s in keys}
    weight, open_, left, target = {s: (3, 1, 2)[k % 3] for k, s in enumerate(keys)}, set(keys), 1.5 * sum(sizes.values()), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2.0 * sizes[s] for s in full)
        open_ -= full
    order = sorted(keys, key=lambda s: "0" if s is None else "1" + s)
    words = {s: math.floor(target[s] + 0.5) for s in keys}
    slots = {s: words[s] // sizes[s] * -(-sizes[s] // 128) + -(-(words[s] % sizes[s]) // 128) for s in keys}
    n = sum(slots.values())
    step = next(a for k in range(n) for a in (round(n * mixing.GOLDEN) - k, round(n * mixing.GOLDEN) + k) if 0 < a <= n and math.gcd(a, n) == 1)
    owner = [s for s in order for _ in range(slots[s])]
    rank, took = Counter(), {}
    for slot in range(n):
        s = owner[slot * step % n]
        block, turn = rank[s] % -(-sizes[s] // 128), rank[s] // -(-sizes[s] // 128)
        rank[s] += 1
        stop = min(block * 128 + 128, sizes[s] if turn < words[s] // sizes[s] else words[s] % sizes[s])
        at = 0
        for name, i, t, _ in sorted(stream[s], key=lambda x: x[0]):
            if max(at, block * 128) < min(at + size(t), stop):
                took.setdefault((name, at, turn), (slot, at, (i, t, s)))
            at += size(t)
    want = [x[2] for x in sorted(took.values(), key=lambda x: (x[0], x[1]))]  # a global order by slot, then place
    assert after == want if ordered else Counter(after) == Counter(want)
    share = {s: slots[s] / n for s in keys}
    seen = Counter()
    for slot in range(n):
        seen[owner[slot * step % n]] += 1
        assert all(abs(seen[s] - share[s] * (slot + 1)) < 4 for s in keys)


def test_the_mix_keeps_rows_apart_and_in_the_order_of_the_schedule(spark):
    """Rows whose id, source and text run together to the same string, null and empty sources, and real repeats."""
    c = "c " * 40
    rows = [(1, c, "a:b"), (1, f"b:{c}", "a"), (11, c, "x"), (1, f"{c}", "1x"), (7, prose(30), None), (7, prose(30), ""), (8, c, None), (8, c, ""), (9, c, "a"), (9, c, "a"), (None, c, "a"), (None, f"-{c}", "a")]
    rows += [(20 + i, prose(int(n)), f"s{i % 3}") for i, n in enumerate(RNG.integers(1, 400, 60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    after = read(mixing.mixed_documents(docs))
    check_mix(rows, after, ordered=True)
    seen = {(i, t, s) for i, t, s in after}
    assert {(1, c, "a:b"), (1, f"b:{c}", "a"), (8, c, None), (8, c, "")} <= seen <= set(rows)
    spans = mixing.mix_sources(docs).collect()
    assert all((r.first_slot is None) == (r.taken == 0) == (r.slots == 0) for r in spans)


def check_packing(before, pieces):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, bins = Counter(), defaultdict(list)
    for i, t, _ in before:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            want[i, k // 4096, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in pieces) == want
    for r in pieces:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert b[0][0] == 0 and all(x[0] + x[1] == y[0] for x, y in zip(b, b[1:], strict=False)) and sum(b[-1]) <= 4096


def test_run(spark, tmp_path):
    """The run is its stages, one after the other: the same pieces of the same documents."""
    path = str(tmp_path)
    rows = tables(spark, path)
    *_, (_, _, last) = check_stages(spark, rows, path)
    want, got = (Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in df.collect()) for df in (last, corpus_pipeline.run(spark, path)))
    assert want == got and sum(want.values()) > 100


@pytest.mark.parametrize("n", [0, 1])
def test_small_tables(spark, tmp_path, n):
    """Empty tables, and a table with one document without text and no usable label."""
    spark.createDataFrame([(None, None, None, None, None)][:n], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, None, 1)][:n], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_secrets_held_out(spark):
    """Planted findings of documents that the forest has not seen; figures in the README."""
    docs = spark.createDataFrame([(i, prose(120), f"s{i % 4}") for i in range(120)], "doc_id long, text string, source string")
    tables_ = secrets.language(docs)
    planted = secrets.planted_findings(docs, tables_, 120).withColumn("half", F.pmod(F.xxhash64(F.split("doc_id", ":")[0]), F.lit(2))).cache()
    seen = secrets.score(planted.where("half = 1"), secrets.fit(planted.where("half = 0"))).collect()
    secret, found = {(r.doc_id, r.number) for r in seen if r.label == 1}, {(r.doc_id, r.number) for r in seen if r.is_secret}
    assert len(secret) > 200 and len(secret & found) >= 0.97 * len(secret) and len(secret & found) >= 0.97 * len(found)
    texts = [(0, 'a "9f8e7d6c5b4a39281706f5e4d3c2b1a0" b'), (1, None), (2, ""), (3, "x" * 200_000 + " commit " + "0123456789abcdef" * 2), (3, "nothing")]
    rows = secrets.candidates(spark.createDataFrame([(*t, None) for t in texts], "doc_id long, text string, source string"), tables_).collect()
    assert sorted((r.doc_id, r.number, r.size) for r in rows) == [(0, 0, 32), (3, 0, 200_000), (3, 1, 32)]
    assert {(r.number, r.digest) for r in rows if r.doc_id == 3} == {(0, 0.0), (1, 1.0)}
