"""State machines over tables and streams, sources and audio: literal cases, brute force, round trips."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from subtide.operators import audio, scoring, sessions
from subtide.sources import glossary, json_columns, recordings
from subtide.streaming import machines
from subtide.streaming.fold import fold, stream_fold


def run(machine, rows):
    state, out = machine.start(), []
    for row in rows:
        out += machine.step(state, row)
    return out + machine.close(state)


def chunks(*pairs):
    return [{"seq": i, "n_samples": n, "level": level, "at_ms": i * 100} for i, (n, level) in enumerate(pairs)]


def test_segment_ends_in_silence_or_at_the_longest():
    s = machines.Segmenter(rate=1000, end_silence=0.4, longest=5, least=0.25)
    assert run(s, chunks((400, 0.5), (400, 0.0))) == [(0, 1, 800, "silence")]
    s = machines.Segmenter(rate=16_000, longest=0.01, least=0.25)
    assert run(s, chunks((160, 0.5), (1, 0.5))) == [(0, 1, 161, "max")]


def test_segment_pre_roll_is_bounded_and_the_rest_is_flushed():
    s = machines.Segmenter(rate=1000, pre_roll=0.12)
    assert run(s, chunks((60, 0), (60, 0), (60, 0), (100, 0.9))) == [(1, 3, 220, "flush")]
    assert run(s, []) == [] and run(s, chunks((0, 0.9), (10, 0))) == []


def test_snapshots_name_the_first_reason():
    rows = [r | {"asr_busy": i == 1, "rtf": 0.9 if i == 2 else 0} for i, r in enumerate(chunks((1600, 0.5), (1600, 0.5), (1600, 0.5), (1600, 0.5)))]
    got = run(machines.Snapshots(every_ms=300), rows)
    assert got == [(0, 1600, None), (1, None, "asr_busy"), (2, None, "realtime_factor"), (3, 6400, None)]


def fragments(*texts, lang="nl", forced=()):
    return [{"seq": i, "text": t, "forced": i in forced, "source_lang": lang} for i, t in enumerate(texts)]


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        (fragments("Dit is een test", forced=(0,)), [(0, "Dit is een test.")]),
        (fragments("Dit is een", "lange zin."), [(1, "Dit is een lange zin.")]),
        (fragments("ehm", None, ""), []),
        (fragments("Een twee drie. Vier vijf zes"), [(0, "Een twee drie."), (0, "Vier vijf zes.")]),
        (fragments("Ik kom morgen", lang="nl") + [{"seq": 1, "text": "We learn together and", "forced": True, "source_lang": "en"}], [(1, "We learn together and.")]),
    ],
)
def test_sentences(rows, want):
    assert run(machines.SentenceAssembler(), rows) == want


def test_a_connector_holds_the_sentence():
    m = machines.SentenceAssembler()
    state = m.start()
    assert m.step(state, fragments("Ik kom morgen en", forced=(0,))[0]) == []
    assert state["waiting"] == "Ik kom morgen en"


def backlog_rows(*levels):
    return [{"seq": i, "at_ms": i * 10, "buffered_ms": b, "gap_sent": False} for i, b in enumerate(levels)]


def test_backlog_states():
    got = run(machines.Backlog(), backlog_rows(500, 700, 500, 300, 1300, 300))
    assert [r[1] for r in got] == ["normal", "congested", "congested", "normal", "dropping", "recovery"]
    assert got[-1][3:] == (2, 20, 1, 0)
    state = [*backlog_rows(1300, 300), {"seq": 2, "at_ms": 50, "buffered_ms": 0, "gap_sent": True}]
    assert run(machines.Backlog(), state)[-1] == (2, "normal", "sent", 1, 50, 1, 1)


def test_segments_merge_up_to_the_longest():
    row = lambda i, n, epoch=0: {"seq": i, "kind": "final", "config": "c", "epoch": epoch, "n_samples": n, "created_ms": 10 - i}
    got = run(machines.MergedSegments(most_samples=5), [row(0, 2), row(1, 3), row(2, 1), row(3, 1, epoch=1)])
    assert got == [(0, 1, 2, 5, 9), (2, 2, 1, 1, 8), (3, 3, 1, 1, 7)]


def test_request_batches_keep_both_bounds():
    rows = [{"seq": i, "n_chars": n} for i, n in enumerate([2000, 500, 5000, *[1] * 9])]
    got = run(machines.RequestBatches(), rows)
    assert [b for _, b, _ in got] == [0, 1, 2, *[3] * 8, 4]


def backlog_frame(spark, n=400):
    return spark.range(n).select((F.col("id") % 3).alias("client_id"), F.col("id").alias("seq"), (F.col("id") * 10).alias("at_ms"), (F.col("id") * 7919 % 1500).cast("double").alias("buffered_ms"), (F.col("id") % 5 == 0).alias("gap_sent"))


def test_fold_equals_a_loop_and_leaves_out_null_keys(spark):
    rows = backlog_frame(spark)
    got = sorted(map(tuple, fold(rows.unionByName(rows.limit(2).withColumn("client_id", F.lit(None).cast("long"))), "client_id", ["at_ms"], machines.Backlog()).collect()))
    want = []
    for key in range(3):
        want += [(key, *r) for r in run(machines.Backlog(), [r.asDict() for r in rows.where(F.col("client_id") == key).orderBy("at_ms").collect()])]
    assert got == sorted(want)
    assert fold(rows.limit(0), "client_id", ["at_ms"], machines.Backlog()).count() == 0


def test_stream_over_several_files_equals_the_fold(spark, tmp_path):
    rows = backlog_frame(spark)
    for k in range(4):
        rows.where(f"seq >= {k * 100} and seq < {k * 100 + 100}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = stream_fold(stream, "client_id", ["at_ms"], machines.Backlog())
    q = out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    q.awaitTermination()
    want = fold(rows, "client_id", ["at_ms"], machines.Backlog())
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, want.collect()))


def test_wav_round_trip_and_bad_files(spark):
    rows = spark.createDataFrame([("a", [0.5, -0.25, 0.0]), ("b", []), ("c", None)], "path string, samples array<float>")
    files = recordings.encode(rows)
    bad = spark.createDataFrame([("d", b"RIFF"), ("e", None)], "path string, content binary")
    got = {r.path: r for r in recordings.decode(files.unionByName(bad)).collect()}
    assert got["a"].samples == [0.5, -0.25, 0.0] and got["b"].samples == [] and got["c"].samples == []
    assert got["d"].error and got["e"].error and got["d"].samples is None
    assert recordings.decode(files.where("path = 'a'"), 2).count() == 2


def test_resample_is_the_same_in_one_chunk_and_in_many(spark):
    signal = np.sin(np.arange(1000) * 0.05).astype(np.float32)
    whole = audio.resampled(np.zeros(0), signal, 0, 44_100, 16_000)
    cut = [signal[a:b].tolist() for a, b in ((0, 7), (7, 8), (8, 8), (8, 400), (400, 1000))]
    rows = spark.createDataFrame([("r", i, c) for i, c in enumerate(cut)], "recording string, seq int, samples array<float>")
    got = b"".join(bytes(r.pcm) for r in audio.resample(rows, 44_100).orderBy("seq").collect())
    assert np.array_equal(np.frombuffer(got, "<i2"), whole)
    assert len(whole) == int(np.ceil(999 / (44_100 / 16_000)))


def test_loudest_mix(spark):
    mixed = audio.loudest_mix(F.array(F.array(F.lit(0.1), F.lit(-0.5)), F.array(F.lit(-0.2), F.lit(0.5), F.lit(0.3))))
    assert spark.range(1).select(mixed).first()[0] == [-0.2, -0.5, 0.3]


def test_glossary_keeps_first_place_and_last_value(spark):
    lines = ["a\tx", "# b\ty", "", "no tab", "c\tz\tw", " a \t v "]
    rows = spark.createDataFrame(list(enumerate(lines)), "line_no int, value string")
    assert sorted(map(tuple, glossary.rules(rows).collect())) == [("a", "v", 0), ("c", "z\tw", 4)]


def test_json_defaults(spark):
    rows = spark.createDataFrame([('{"k": 3}',), ("[1]",), ("{bro",), (None,), ("{}",)], "raw string")
    assert [r[0] for r in rows.select(json_columns.field(F.col("raw"), "k", "int", -1)).collect()] == [3, -1, -1, -1, -1]


def test_translate_many_bounds_each_call(spark):
    rows = spark.createDataFrame([(i, "x" * n, "nl", "en") for i, n in enumerate([3, 4, 9, 1, 1, 1])] + [(9, None, "de", "en")], "request_id int, text string, source string, target string").coalesce(1)
    got = scoring.translate_many(rows, lambda: lambda texts, a, b: [f"{a}{len(texts)}:{sum(map(len, texts))}" for _ in texts], 3, 8)
    assert {r.request_id: r.translation for r in got.collect()} == {0: "nl2:7", 1: "nl2:7", 2: "nl1:9", 3: "nl3:3", 4: "nl3:3", 5: "nl3:3", 9: "de1:0"}


def test_ranked_numbers_a_total_order(spark):
    rows = spark.range(500).select((F.col("id") * 37 % 500).alias("v"))
    assert all(r.v == r.place - 1 for r in sessions.ranked(rows, [F.asc("v")], "place").collect())


def test_context_prompt(spark):
    rows = spark.createDataFrame([(0, 0, "a"), (0, 1, "b")], "k int, i int, s string")
    got = rows.select("i", sessions.context_prompt("", "s", ["k"], ["i"], most=1).alias("p")).orderBy("i").collect()
    assert [r.p for r in got] == [None, "a"]
