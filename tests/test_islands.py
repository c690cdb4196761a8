"""Sequential rules in pieces against the whole, logs, languages, order statistics, edit distances."""

import random

import pytest
from pyspark.sql import functions as F

from subtide.functions import arrays, text
from subtide.operators import evaluation, islands, languages, logs, sessions
from subtide.streaming.fold import fold
from subtide.streaming.machines import RequestBatches, Segmenter


@pytest.mark.parametrize("machine", [Segmenter(), Segmenter(rate=1000, end_silence=0.35, longest=2.0), Segmenter(rate=1000, end_silence=0.1, least=0.9, pre_roll=0.3)])
def test_islands_give_the_segments_of_the_whole_session(spark, machine):
    rng, rows = random.Random(6), []
    for client in range(4):
        talk = False
        for seq in range(600):
            talk = rng.random() < (0.85 if talk else 0.08)
            rows.append((client, seq, seq * 100, rng.choice([0, int(0.02 * machine.rate), int(0.1 * machine.rate), None]) if seq % 9 == 0 else int(0.1 * machine.rate), None if seq % 50 == 7 else 0.5 if talk else 0.001))
    rows += [(None, 0, 0, 100, 0.5)]
    chunks = spark.createDataFrame(rows, "client_id long, seq long, at_ms long, n_samples int, level double")
    want = sorted(map(tuple, fold(chunks, "client_id", ["at_ms", "seq"], machine).collect()))
    got = islands.segments(chunks, "client_id", ["at_ms", "seq"], machine)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 30
    if machine.least < 0.9:
        assert islands.silent_islands(chunks.where("client_id IS NOT NULL"), "client_id", ["at_ms", "seq"], machine).groupBy("client_id").agg(F.max("island").alias("n")).agg(F.min("n")).first()[0] > 3


@pytest.mark.parametrize("block", [8, 16, 1024])
def test_batches_block_by_block_are_those_of_the_sequence(spark, block):
    rng = random.Random(2)
    rows = [(rng.choice("abc") if rng.random() < 0.5 else "hot", i, rng.choice([0, 10, 290, 310, 900, 2400, 5000, None])) for i in range(700)]
    frame = spark.createDataFrame([*rows, (None, 1, 1)], "pair string, seq long, n long")
    want = []
    for pair in {r[0] for r in rows}:
        machine = RequestBatches()
        state = machine.start()
        for _, seq, n in sorted(r for r in rows if r[0] == pair):
            want += [(pair, *x) for x in machine.step(state, {"seq": seq, "n_chars": n})]
    got = islands.request_batches(frame, "pair", "seq", "n", block=block).select("pair", "seq", "batch", "n")
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert islands.request_batches(frame.limit(0), "pair", "seq", "n").count() == 0


def test_batches_when_ranges_are_dealt_anew(spark):
    """Many range partitions, whose bounds are sampled and which adaptive plans join by their size."""
    settings = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "4kb", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "true"}
    before = {k: spark.conf.get(k) for k in settings}
    rows = spark.range(0, 60_000, 1, 16).select((F.col("id") % 2).alias("pair"), F.xxhash64("id").alias("seq"), (F.col("id") * 7919 % 900).alias("n"))
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = {tuple(r) for r in islands.request_batches(rows, "pair", "seq", "n").select("pair", "seq", "batch", "n").collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = set()
    for pair in (0, 1):
        machine = RequestBatches()
        state = machine.start()
        for seq, n in sorted((r.seq, r.n) for r in rows.where(F.col("pair") == pair).collect()):
            want |= {(pair, *x) for x in machine.step(state, {"seq": seq, "n_chars": n})}
    assert len(got) == 60_000 and got == want


def test_order_statistics_equal_the_exact_percentiles(spark):
    rng = random.Random(9)
    rows = [("hot", rng.choice([rng.gauss(0, 1), rng.gauss(0, 1e6), 7.5, 0.0, -0.0])) for _ in range(3000)] + [("one", 5.0), ("two", -1.0), ("two", None), ("none", None), (None, 3.0), (None, 4.0), ("same", 2.0), ("same", 2.0)]
    frame = spark.createDataFrame(rows, "k string, value double")
    got = {r.k: r for r in sessions.order_statistics(frame, ["k"], shares=(0.0, 0.25, 0.5, 0.95, 1.0)).collect()}
    want = {r.k: r for r in frame.groupBy("k").agg(F.count("value").alias("n"), F.percentile("value", F.array(*[F.lit(p) for p in (0.0, 0.25, 0.5, 0.95, 1.0)])).alias("p"), F.max("value").alias("most")).collect()}
    for k, r in want.items():
        assert (got[k].n, got[k].most) == (r.n, r.most)
        assert [got[k][f"p{p}"] for p in (0, 25, 50, 95, 100)] == (pytest.approx(r.p) if r.p else [None] * 5)
    assert {tuple(r) for r in sessions.summary_of_any_size(frame, ["k"]).collect()} == {tuple(r) for r in sessions.summary(frame, ["k"]).collect()}


def test_edit_distance_against_the_table():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            before, row[0] = row[0], i + 1
            for j, y in enumerate(b):
                before, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, before + (x != y))
        return row[-1]

    rng = random.Random(1)
    for _ in range(800):
        k = rng.choice([1, 2, 5, 90])
        a, b = ([rng.randrange(k) for _ in range(rng.randrange(80))] for _ in range(2))
        assert arrays.edit_distance(a, b) == plain(a, b)
    assert arrays.edit_distance(list(range(50_000)), list(range(25_000, 75_000))) == 50_000  # 75,000 distinct tokens


def test_words_have_a_letter_digit_or_underscore(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    for said, n in (("Yes - no", 2), ("-- ' ×", 0), ("l'été 't's o'", 3), ("a-b c_d", 2), ("", 0)):
        assert one(text.word_count(F.lit(said))) == n
    assert one(text.should_drop(F.lit("Yes - no"))) is True
    assert one(text.sentences(F.lit("One. Two. \x85  "))) == ["One.", "Two."]
    assert one(text.ends_with_connector(F.lit("dat is 'en'"))) is True
    assert one(text.join_overlap(F.lit("dit is  een"), F.lit("een\ttest"))) == "dit is een test"
    assert one(text.cache_key(F.lit(" a b "), F.lit("nl"), F.lit("en"))) == one(text.cache_key(F.lit("a b"), F.lit("nl"), F.lit("en")))


def test_paths_are_reduced_to_names(spark):
    said = ["no  such file: /opt/models/asr.bin", "a/b/ ./c/. / //", r"C:\\x\\y plain", "", "../.. ok"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(said)], "i int, t string").orderBy("i").select(text.without_paths(F.col("t"))).collect()]
    assert got == ["no such file: asr.bin", "b c <path> <path>", r"C:\\x\\y plain", "", ".. ok"]


def test_logs(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    fields = F.create_map(*[F.lit(x) for x in ("dutch", "geheim", "KEY", "v", "n", "1")])
    assert one(logs.without_transcripts(fields)) == {"KEY": "v", "n": "1"}
    assert one(logs.redacted(F.map_concat(fields, F.create_map(F.lit("EMPTY"), F.lit(""))), ("KEY", "EMPTY"))) == {"dutch": "geheim", "KEY": "<redacted>", "n": "1", "EMPTY": ""}
    assert one(logs.preview(F.lit(" a \n b" + "x" * 300), F.lit(True))) == "a b" + "x" * 177 + "…" and one(logs.preview(F.lit("a"), F.lit(False))) == logs.HIDDEN
    nested = F.to_json(F.struct(F.lit(1).alias("a"), F.array(F.lit("é\n")).alias("b")))
    assert one(logs.line(F.lit("event"), [("x", F.lit("1\r2\n3")), ("y", nested), ("z", F.lit(None).cast("string")), ("w", F.lit("w" * 601))])) == 'event | x=1 2 3 | y={"a":1,"b":["é\\n"]} | z=None | w=' + "w" * 600 + "…"
    lines = spark.range(6000).select(F.col("id").alias("no"))
    assert [r.no for r in logs.tail(lines, "no", 3).collect()] == [5997, 5998, 5999]
    assert [logs.tail(lines, "no", n).count() for n in (None, 0, -4, 9999)] == [200, 200, 1, 5000]


def test_transitions_take_a_table_of_pairs(spark):
    log = spark.createDataFrame([(1, 0, "idle"), (1, 1, "up"), (1, 2, "up"), (1, 3, "idle"), (2, 0, "down")], "client_id int, i int, state string")
    allowed = spark.createDataFrame([("idle", "up"), ("up", "idle"), ("up", "idle")], "previous string, state string")
    got = logs.transitions(log, allowed, "client_id", ["i"]).collect()
    assert sorted((r.client_id, r.i, r.valid) for r in got) == [(1, 0, True), (1, 1, True), (1, 2, False), (1, 3, True), (2, 0, True)]


def test_targets_and_pairs(spark):
    sources = spark.createDataFrame([(" NL ",), ("en",), ("xx",), (None,)], "source string")
    pairs = spark.createDataFrame([("nl", "en"), ("nl", "de"), ("de", "nl")], "source string, target string")
    assert sorted(map(tuple, languages.allowed_targets(sources, ["nl", "en", "de"], pairs).collect())) == [("en", "en"), ("nl", "de"), ("nl", "en")]
    assert sorted(map(tuple, languages.allowed_targets(sources, ["nl", "en", "de"]).collect())) == [("en", "de"), ("en", "nl"), ("nl", "de"), ("nl", "en")]
    asked = spark.createDataFrame([("nl", " EN"), ("nl", "nl"), ("de", "en"), ("nl", "xx"), (None, "en")], "source string, target string")
    problem = lambda fixed: [r.problem for r in languages.validated(asked, ["nl", "en", "de"], fixed).collect()]
    assert problem(None) == [None, None, None, "unsupported_language", "unsupported_language"]
    assert problem(("nl", "en"))[:3] == [None, None, "unsupported_language_pair"]


def test_rollups(spark):
    runs = spark.createDataFrame([(0, "a b c", "a x c", 100, 2.0), (0, "", "", 300, 0.0), (1, "", "z", 50, 1.0)], "model int, reference string, hypothesis string, latency_ms int, seconds double")
    got = {r.model: tuple(r)[1:] for r in evaluation.asr_rollup(runs, ["model"]).collect()}
    assert got == {0: (2, round(1 / 6, 4), round(1 / 6, 4), 0.025, 200.0), 1: (1, 1.0, 1.0, 0.05, 50.0)}
    wanted = spark.createDataFrame([(0, False), (2, False), (3, True)], "model int, failed boolean")
    rolled = evaluation.translation_rollup(wanted, runs.withColumn("chrf", F.lit(0.5)), "model").collect()
    assert {r.model: (r.n, r.status, r.chrf_mean) for r in rolled} == {0: (2, "ok", 0.5), 2: (0, "skipped", None), 3: (0, "failed", None)}


def test_cues_equal_a_greedy_loop(spark):
    from subtide.operators import cues

    rng, rows, want = random.Random(4), [], []
    for client in range(3):
        at, own = 0, []
        for pos in range(400):
            word = "".join(rng.choice("abcé") for _ in range(rng.choice([1, 3, 7, 12, 90]))) + rng.choice(["", "", "", ",", ";", ".", "?"])
            end = at + rng.choice([100, 300, 2500])
            own.append((client, pos, word, at, end))
            at = end + rng.choice([0, 50, 499, 500])
        rows += own
        line: list = []
        for row in own:
            text_ = " ".join(r[2] for r in line)
            island = line and (row[3] - line[-1][4] >= 500 or line[-1][2][-1] in ".!?…")
            full = line and (len(text_) + 1 + len(row[2]) > 84 or row[4] - line[0][3] > 6000 or (text_[-1] in ",;:" and len(text_) >= 42))
            if island or full:
                want.append((client, line[0][3], max(r[4] for r in line), text_))
                line = []
            line.append(row)
        want.append((client, line[0][3], max(r[4] for r in line), " ".join(r[2] for r in line)))
    got = cues.build(spark.createDataFrame(rows, "client_id long, pos long, word string, start_ms long, end_ms long")).select("client_id", "start_ms", "end_ms", "text")
    assert sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("size", [1, 7, 10_000])
def test_cues_are_those_of_the_machine_whatever_the_batches(spark, size):
    """Words read in batches of any size, several clients and none, ends that go back, empty words; no plan sorts words twice."""
    from subtide.operators import cues

    rng, rows = random.Random(8), []
    for client in (None, *range(5)):
        at = 0
        for pos in range(150):
            word = "".join(rng.choice("aé😀") for _ in range(rng.choice([0, 1, 1, 4, 50]))) + rng.choice(["", "", ",", ";", "…", ":"])
            rows.append((client, pos, word, at, at + rng.choice([100, 900, 9000])))
            at += rng.choice([0, 100, 700])
    words = spark.createDataFrame(rows, "client_id int, pos long, word string, start_ms long, end_ms long")
    pieces = cues.islands(words).select(F.struct("client_id", "island").alias("piece"), "pos", "word", "start_ms", "end_ms")
    want = fold(pieces, "piece", ["pos"], cues.CueBuilder()).select("piece.client_id", "piece.island", "cue", "start_ms", "end_ms", "text").collect()
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(size))
        built = cues.build(words)
        assert sorted(map(str, built.collect())) == sorted(map(str, want)) and len(want) > 300
        assert built._jdf.queryExecution().optimizedPlan().toString().count("Sort [") == 1 and "Window" not in built._jdf.queryExecution().optimizedPlan().toString()
        assert cues.build(words.limit(0)).count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
