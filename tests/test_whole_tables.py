"""Queries without SQL see every row of their tables."""

from pyspark.sql import functions as F

from subtide.functions import text
from subtide.plans import records, registry, stateful


def test_sentences_of_every_language(spark, tmp_path):
    rows = [(1, "One two. Two three.", "en"), (2, "Eins zwei. Zwei drei.", "de"), (3, "Un deux. Deux trois.", "fr"), (4, "Uno dos. Dos tres.", "es"), (5, "Een. Twee.", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    joined = {r.doc_id: r.joined for r in registry.strf6_join_overlap(spark, str(tmp_path)).collect()}
    assert joined == {1: "One two. Two three.", 2: "Eins zwei. Zwei drei.", 3: "Un deux. Deux trois.", 4: "Uno dos. Dos tres.", 5: "Een. Twee."}
    assert {(r.doc_id, r.i) for r in registry.strf8_stabilize(spark, str(tmp_path)).collect()} == {(k, i) for k in range(1, 6) for i in (0, 1)}
    assert {r.doc_id for r in records.strf7_merge_overlap(spark, str(tmp_path)).collect()} == {1, 2, 3, 4, 5}


def test_evaluation_texts_of_every_script(spark, tmp_path):
    texts = ["La Canción’s ﬁn, x²!", "la cancion's fin x2", "Привет, мир", "привет мир", None, "one two"]
    frame = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    frame.write.parquet(f"{tmp_path}/benchmark.parquet")
    normal = {r.item_id: r.t for r in frame.select("item_id", text.evaluation_text(F.col("text")).alias("t")).collect()}
    assert normal == {0: "la canción's fin x2", 1: "la cancion's fin x2", 2: "привет мир", 3: "привет мир", 4: None, 5: "one two"}
    wer = {r.item_id: r.wer for r in registry.mth6_wer(spark, str(tmp_path)).collect()}
    assert wer == {0: 0.25, 1: 1.0, 2: 0.0, 3: 1.0, 4: 1.0}
    words = {r.item_id: r.words for r in records.mth5_word_distance(spark, str(tmp_path)).collect()}
    assert words == {0: 1, 1: 4, 2: 0, 3: 2, 4: 2}


def test_metrics_stream_gives_the_last_hours_too(spark, tmp_path):
    at = ["2024-01-01 00:10:00", "2024-01-01 00:50:00", "2024-01-01 05:00:00", "2024-01-01 05:59:59", "2023-12-31 01:00:00"]
    rows = spark.createDataFrame([(i, t, i % 2, 1.25 * i) for i, t in enumerate(at)] + [(9, None, 1, 2.0)], "event_id long, ts string, user_id long, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    whole = sorted(map(str, registry.str13_hourly_metrics(spark, str(tmp_path)).collect()))
    assert len(whole) == 6 and sorted(map(str, stateful.str13_metrics_stream(spark, str(tmp_path)).collect())) == whole
