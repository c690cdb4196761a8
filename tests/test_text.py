"""The literal cases of the reference's behaviour."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from subtide.functions import arrays, text
from subtide.operators import cues, sessions


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(("raw", "want"), [("Hallo   ,\nwereld  !", "Hallo, wereld!"), ("", ""), ("a  b", "a b"), ("¿ que ?", "¿que?")])
def test_normalize(spark, raw, want):
    assert one(spark, text.normalize(F.lit(raw))) == want


def test_glossary(spark):
    assert one(spark, text.correct(F.lit("Ajaaks speelt"), [("Ajaaks", "Ajax")])) == "Ajax speelt"


def test_sentences_and_finish(spark):
    assert one(spark, text.sentences(F.lit('Een. "Twee!" Drie'))) == ["Een.", '"Twee!"', "Drie"]
    assert one(spark, text.finish(F.lit("Dit is een test"))) == "Dit is een test."


def test_predicates(spark):
    assert one(spark, text.ends_with_connector(F.lit("Ik kom morgen en"))) is True
    assert one(spark, text.ends_with_connector(F.lit("..."))) is False
    assert one(spark, text.filler_only(F.lit("Ehm..."))) is True
    assert one(spark, text.should_drop(F.lit("Nee, nee."))) is True
    assert one(spark, text.should_drop(F.lit("Echt waar?"))) is False


def test_texts_at_a_seam_are_split_once(spark):
    """Lambdas evaluate what they hold for every element, so what they share is bound before."""
    rows = spark.createDataFrame([("a b C", "c b"), ("x", None), (None, "x"), ("", ""), ("a " * 20, "a " * 30)], "p string, n string")
    for function, want in ((text.join_overlap, ["a b C b", "x", "x", "", ("a " * 42).strip()]), (text.merge_overlap, ["a b C b", "x", None, "", ("a " * 40).strip()]), (text.stabilize, ["a b C", "x", "x", "", ("a " * 30).strip()])):
        found = rows.select(function(F.col("p"), F.col("n")).alias("x"))
        assert [r.x for r in found.collect()] == want
        plan = found._jdf.queryExecution().analyzed().toString()
        assert plan.count("split(") == 2 and plan.count("regexp_replace(") <= 2


def test_overlap_and_stabilize(spark):
    assert one(spark, text.join_overlap(F.lit("dit is een"), F.lit("een test"))) == "dit is een test"
    assert one(spark, text.merge_overlap(F.lit("dit is een"), F.lit("een test"))) == "dit is een test"
    assert one(spark, text.stabilize(F.lit("a long partial text here"), F.lit("a long"))) == "a long partial text here"
    assert one(spark, text.stabilize(F.lit(None).cast("string"), F.lit("new"))) == "new"


def test_runs(spark):
    assert one(spark, text.runs(F.lit("Hallo, wereld!"))) == ["Hallo", ", ", "wereld", "!"]


def test_timestamps(spark):
    assert one(spark, text.timestamp(F.lit(1230).cast("bigint"))) == "00:00:01,230"
    assert one(spark, text.timestamp(F.lit(4567).cast("bigint"), ".")) == "00:00:04.567"


def test_error_rates(spark):
    a, b = F.split(F.lit("een korte test"), " "), F.split(F.lit("een lange test"), " ")
    assert one(spark, arrays.error_rate(arrays.word_distance(a, b), F.size(a), F.size(b))) == pytest.approx(1 / 3)
    assert one(spark, arrays.rms(F.array().cast("array<float>"))) == 0


def test_non_overlap(spark):
    rows = spark.createDataFrame([("c", 0, 2000, "a"), ("c", 1500, 3000, "b"), ("c", 2000, 2500, " ")], "client_id string, start_ms long, end_ms long, text string")
    got = cues.normalized(rows).orderBy("start_ms").collect()
    assert [(r.start_ms, r.end_ms) for r in got] == [(0, 2000), (2000, 3000)]


def test_gap_makes_two_cues(spark):
    rows = spark.createDataFrame([("c", 0, "een", 0, 900), ("c", 1, "twee", 2000, 2400)], "client_id string, pos long, word string, start_ms long, end_ms long")
    assert cues.build(rows).count() == 2


def test_provisional_end(spark):
    rows = spark.createDataFrame([("c", 1, 1000, 0, True), ("c", 2, 5000, 9000, False)], "client_id string, id long, start_ms long, end_ms long, pending boolean")
    assert [r.end_ms for r in cues.provisional_ends(rows).orderBy("id").collect()] == [4880, 9000]


def test_summary(spark):
    rows = spark.createDataFrame([("c", float(v)) for v in (1, 2, 3, 4)], "k string, value double")
    r = sessions.summary(rows, ["k"]).first()
    assert (r.n, r.median, r.p95, r.most) == (4, 2.5, 3.85, 4.0)


def test_upsert_keeps_old(spark):
    schema = "k long, started long, updated long"
    old, new = spark.createDataFrame([(1, 10, 10)], schema), spark.createDataFrame([(1, 20, 20), (2, 5, 5)], schema)
    assert sorted(map(tuple, sessions.upsert(old, new, ["k"], ("started",)).collect())) == [(1, 10, 20), (2, 5, 5)]


def test_chrf_and_error_rates_on_empty_and_short_sides(spark, tmp_path):
    from subtide.plans import records, registry

    texts = ["", "!!", "ab", "abcdefgh", "abcdefgx", None, "Canción", "cancion"]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def grams(t, n):
        return Counter(t[i : i + n] for i in range(len(t) - n + 1))

    def chrf(r, h):
        if not r or not h:
            return 1.0 if r == h else 0.0
        common = [sum((grams(r, n) & grams(h, n)).values()) for n in range(1, 7)]
        p, q = (sum(c / max(1, len(x) - n + 1) for n, c in zip(range(1, 7), common, strict=True)) / 6 for x in (h, r))
        return 5 * p * q / (4 * p + q) if p + q else 0.0

    plain = ["", "", "ab", "abcdefgh", "abcdefgx", "", "canción", "cancion"]
    want = {i: round(chrf(plain[i], plain[i + 1]), 6) for i in range(7)}
    assert {r.item_id: r.chrf for r in registry.mth8_chrf(spark, str(tmp_path)).collect()} == want
    assert {r.item_id: r.cer for r in registry.mth7_cer(spark, str(tmp_path)).collect()} == {0: 0.0, 1: 1.0, 2: 3.0, 3: 0.125, 4: 1.0, 5: 1.0, 6: round(1 / 7, 6)}
    assert {r.model: r.n for r in registry.agg8_evaluation(spark, str(tmp_path)).collect()} == {0: 3, 1: 2, 2: 2}
    assert {r.model: (r.n, r.status) for r in records.agg9_translation_rollup(spark, str(tmp_path)).collect()} == {0: (3, "ok"), 1: (2, "ok"), 2: (2, "ok"), 3: (0, "skipped"), 4: (0, "failed")}


def test_connectors_by_language(spark):
    from subtide.streaming.machines import SentenceAssembler

    rows = [("Please do come in.", "en"), ("Dit is de plug-in.", "nl"), ("Dit is mooi maar", "nl")]
    frame = spark.createDataFrame(rows, "text string, lang string")
    got = [r[0] for r in frame.select(text.ends_with_connector(F.col("text"), F.col("lang"))).collect()]
    assert got == [False, False, True]
    for spoken, lang, held in (("Please do come in.", "en", False), ("Wij gaan er zo in.", "nl", True)):
        machine = SentenceAssembler()
        said = machine.step(machine.start(), {"seq": 1, "text": spoken, "forced": False, "source_lang": lang})
        assert (said == []) is held
