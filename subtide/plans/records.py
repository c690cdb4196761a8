"""Queries of scans, validations, projections, sorts, sets and evaluation tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from subtide.functions import arrays, text
from subtide.operators import evaluation, scoring, sessions
from subtide.plans.registry import _CER, _CHRF, _CODED, _DISTANCE, _LANG_ROWS, _MERGED_SQL, _PAIRS, _REQUESTS, _SENTENCES, _SESSIONS, _SQL, _SUBTITLES, _normal_sql, _overlap_sql, _words_sql, _t, cache_of, chrf_of, cues_of, pairs_of, query, requests_of, sentences_of, sessions_of, subtitles_of
from subtide.sources import glossary, json_columns, recordings, reports

# Scans


@query("SELECT event_id, coalesce(CASE WHEN event_id % 10 <> 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) END, -1) AS k FROM events")
def src2_history(spark, d):
    raw = F.when(F.col("event_id") % 10 == 0, F.lit("{broken")).otherwise(F.col("props"))
    return _t(spark, d, "events").select("event_id", json_columns.field(raw, "k", "bigint", -1).alias("k"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN -1 WHEN 1 THEN -1 ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events")
def jsn1_default(spark, d):
    raw = F.when(F.col("event_id") % 3 == 0, F.lit("[1, 2]")).when(F.col("event_id") % 3 == 1, F.lit(None)).otherwise(F.col("props"))
    return _t(spark, d, "events").select("event_id", json_columns.field(raw, "k", "bigint", -1).alias("k"))


@query("SELECT vec_id, 16000 AS sample_rate, CAST(len(embedding) AS BIGINT) AS n_samples, vec_id % 9 = 0 AS failed FROM embeddings WHERE vec_id % 9 <> 0 UNION ALL SELECT vec_id, NULL, NULL, true FROM embeddings WHERE vec_id % 9 = 0")
def src3_wav(spark, d):
    files = recordings.encode(_t(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("path"), F.col("embedding").alias("samples")))
    cut = F.when(F.col("path").cast("long") % 9 == 0, F.substring("content", 1, 20)).otherwise(F.col("content"))
    got = recordings.decode(files.select("path", cut.alias("content")))
    return got.groupBy(F.col("path").cast("long").alias("vec_id")).agg(F.max("sample_rate").alias("sample_rate"), F.sum(F.array_size("samples")).alias("n_samples"), F.bool_or(F.col("error").isNotNull()).alias("failed"))


@query("""WITH l AS (SELECT doc_id AS line_no, string_split(text, ' ') AS w FROM documents), r AS (SELECT line_no, trim(w[1], ' ') AS pattern, trim(w[2], ' ') AS replacement FROM l
WHERE line_no % 11 <> 0 AND len(w) > 1 AND NOT regexp_matches(w[1] || w[2], '[\\s#\\x0B]') AND w[1] <> '' AND w[2] <> '')
SELECT pattern, arg_max(replacement, line_no) AS replacement, min(line_no) AS position FROM r GROUP BY pattern""")
def src5_glossary(spark, d):
    w = F.split("text", " ")
    plain = _t(spark, d, "documents").select(F.col("doc_id").alias("line_no"), F.get(w, 0).alias("a"), F.get(w, 1).alias("b")).where("b IS NOT NULL AND a <> '' AND b <> ''").where(~F.concat("a", "b").rlike("[\\s#\\x0B]"))
    line = F.concat(F.when(F.col("line_no") % 11 == 0, "# ").otherwise(" "), "a", F.lit("\t"), "b", F.lit(" "))
    return glossary.rules(plain.select("line_no", line.alias("value")))


@query("SELECT conv_id, turn, role, length(text) AS n FROM conversations")
def src6_evaluation_items(spark, d):
    corpora = _t(spark, d, "conversations").groupBy("conv_id").agg(F.to_json(F.struct(F.collect_list(F.struct("turn", "role", "text")).alias("items"))).alias("raw"))
    return json_columns.evaluation_items(corpora, "raw", "struct<turn:bigint,role:string,text:string>").select("conv_id", "turn", "role", F.length("text").cast("bigint").alias("n"))


@query("SELECT conv_id, CAST(turn AS VARCHAR) AS id, role, length(text) AS n FROM conversations WHERE conv_id % 10 <> 0")
def src7_saved_sessions(spark, d):
    item = F.struct("role", "text")
    raw = F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("turn").cast("string"), item))))
    stored = _t(spark, d, "conversations").groupBy("conv_id").agg(raw.alias("raw")).withColumn("raw", F.when(F.col("conv_id") % 10 == 0, "{broken").otherwise(F.col("raw")))
    return json_columns.saved_sessions(stored, "raw", "struct<role:string,text:string>").select("conv_id", "id", "snapshot.role", F.length("snapshot.text").cast("bigint").alias("n"))


# Client log levels and their names.
LEVELS = {"debug": "DEBUG", "info": "INFO", "warn": "WARNING", "warning": "WARNING", "error": "ERROR"}
# Info events that are forwarded.
FORWARDED = ["capture_started", "capture_stopped", "websocket_recovered", "backend_restart"]
_LOG = """log AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'info' WHEN 'error' THEN 'error' WHEN 'view' THEN 'debug' WHEN 'purchase' THEN 'warn' ELSE 'loud' END AS level,
CASE event_id % 4 WHEN 0 THEN 'capture_started' WHEN 1 THEN 'backend_restart' ELSE 'tick' END AS message FROM events)"""


def log_of(spark, d):
    names = F.create_map(*[F.lit(x) for pair in (("click", "info"), ("error", "error"), ("view", "debug"), ("purchase", "warn")) for x in pair])
    level = F.coalesce(F.try_element_at(names, F.col("event_type")), F.lit("loud"))
    which = F.col("event_id") % 4
    return _t(spark, d, "events").select("event_id", level.alias("level"), F.when(which == 0, "capture_started").when(which == 1, "backend_restart").otherwise("tick").alias("message"))


@query(f"WITH {_LOG} SELECT event_id, CASE level WHEN 'warn' THEN 'WARNING' ELSE upper(level) END AS level, message FROM log WHERE level <> 'loud'")
def src9_client_log(spark, d):
    names = F.create_map(*[F.lit(x) for pair in LEVELS.items() for x in pair])
    return log_of(spark, d).withColumn("level", F.try_element_at(names, F.col("level"))).where("level IS NOT NULL")


@query(f"WITH {_LOG} SELECT event_id, level FROM log WHERE level IN ('error', 'warn') OR (level = 'info' AND message IN ('capture_started', 'backend_restart'))")
def flt12_log_routing(spark, d):
    level, message = F.col("level"), F.col("message")
    return log_of(spark, d).where(level.isin("error", "warn") | ((level == "info") & message.isin(FORWARDED))).select("event_id", "level")


# Filters and validations


@query("SELECT conv_id, turn FROM conversations WHERE trim(coalesce(text, '')) <> '' OR turn % 3 = 0")
def flt2_exportable(spark, d):
    translation = F.when(F.col("turn") % 3 == 0, "x").otherwise("")
    return _t(spark, d, "conversations").where((F.trim(F.coalesce("text", F.lit(""))) != "") | (translation != "")).select("conv_id", "turn")


@query("SELECT event_id, CAST(floor(value * 100) AS BIGINT) AS n_samples, CASE WHEN floor(value * 100) < 1600 THEN 'too_short' END AS reason FROM events")
def flt3_too_short(spark, d):
    n = F.floor(F.col("value") * 100)
    return _t(spark, d, "events").select("event_id", n.alias("n_samples"), F.when(n < 1600, "too_short").alias("reason"))


_CODES = "(" + ", ".join(f"'{c}'" for c, _, _ in _LANG_ROWS) + ")"


@query(rf"""WITH c AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 44100 ELSE 16000 END AS rate, CASE doc_id % 4 WHEN 0 THEN 'fast' WHEN 1 THEN 'balanced' WHEN 2 THEN 'quality' ELSE 'slow' END AS mode,
CASE WHEN doc_id % 5 = 0 THEN 'xx' ELSE lang END AS lang, text FROM documents)
SELECT doc_id, concat_ws(',', CASE WHEN rate <> 16000 THEN 'sample_rate' END, CASE WHEN mode = 'slow' THEN 'mode' END, CASE WHEN length(text) > 600 THEN 'context_prompt' END, CASE WHEN lang NOT IN {_CODES} THEN 'source_lang' END) AS errors,
trim(regexp_replace(left(text, 600), '[ \t\n\r]+', ' ', 'g'), ' ') AS prompt FROM c""")
def flt5_config(spark, d):
    by4 = F.col("doc_id") % 4
    c = _t(spark, d, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 7 == 0, 44100).otherwise(16000).alias("rate"), F.when(by4 == 0, "fast").when(by4 == 1, "balanced").when(by4 == 2, "quality").otherwise("slow").alias("mode"), F.when(F.col("doc_id") % 5 == 0, "xx").otherwise(F.col("lang")).alias("lang"))
    wrong = {"sample_rate": F.col("rate") != 16000, "mode": ~F.col("mode").isin("fast", "balanced", "quality"), "context_prompt": F.length("text") > 600, "source_lang": ~F.col("lang").isin([r[0] for r in _LANG_ROWS])}
    prompt = F.trim(F.regexp_replace(F.left("text", F.lit(600)), "[ \t\n\r]+", " "))
    return c.select("doc_id", F.concat_ws(",", *[F.when(w, F.lit(n)) for n, w in wrong.items()]).alias("errors"), prompt.alias("prompt"))


# Projections


@query("""SELECT event_id, '{"start":' || printf('%.3f', event_id / 10.0) || ',"end":' || printf('%.3f', event_id / 10.0 + 2) || ',"source_text":"' || event_type || '"' || CASE WHEN event_id % 2 = 0 THEN ',"probability":0.5' ELSE '' END || '}' AS event FROM events""")
def prj1_cue_event(spark, d):
    start = (F.col("event_id") / F.lit(10)).cast("decimal(20,3)")
    payload = F.struct(start.alias("start"), (start + 2).cast("decimal(20,3)").alias("end"), F.col("event_type").alias("source_text"), F.when(F.col("event_id") % 2 == 0, F.lit(0.5)).alias("probability"))
    return _t(spark, d, "events").select("event_id", F.to_json(payload, {"ignoreNullFields": "true"}).alias("event"))


@query("""WITH m AS (SELECT event_id, CAST(floor(value) AS BIGINT) AS queue_ms, CAST(json_extract(props, '$.k') AS BIGINT) AS asr_ms, CASE WHEN event_id % 2 = 0 THEN CAST(floor(value * 2) AS BIGINT) END AS mt_ms, CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END AS t FROM events)
SELECT event_id, CASE WHEN mt_ms IS NULL THEN 'final_pending' ELSE 'final' END AS type, queue_ms + asr_ms + coalesce(mt_ms, 0) AS latency_ms, CASE WHEN mt_ms IS NULL THEN 'Translating...' WHEN t = '' THEN 'Translation unavailable' ELSE t END AS translation FROM m""")
def prj2_payload(spark, d):
    mt = F.when(F.col("event_id") % 2 == 0, F.floor(F.col("value") * 2))
    t = F.when(F.col("event_id") % 3 == 0, "").otherwise(F.col("event_type"))
    latency = F.floor("value") + json_columns.field(F.col("props"), "k", "bigint", 0) + F.coalesce(mt, F.lit(0))
    shown = F.when(mt.isNull(), "Translating...").otherwise(F.coalesce(F.nullif(t, F.lit("")), F.lit("Translation unavailable")))
    return _t(spark, d, "events").select("event_id", F.when(mt.isNull(), "final_pending").otherwise("final").alias("type"), latency.alias("latency_ms"), shown.alias("translation"))


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang ELSE 'nl' END AS source_lang, 'en' AS target_lang, CASE WHEN doc_id % 3 = 0 THEN 'quality' ELSE 'fast' END AS mode, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE n_chars END AS latency_ms FROM documents""")
def prj3_subtitle_defaults(spark, d):
    raw = _t(spark, d, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise("").alias("source_lang"), F.lit(None).cast("string").alias("target_lang"), F.when(F.col("doc_id") % 3 == 0, "quality").alias("mode"), F.when(F.col("doc_id") % 5 != 0, F.col("n_chars")).alias("latency_ms")
    )
    return sessions.with_defaults(raw, {"source_lang": "nl", "target_lang": "en", "mode": "fast", "latency_ms": 0})


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN 'error' WHEN event_id % 3 <> 0 THEN CASE WHEN event_id % 2 = 0 THEN 'low' ELSE 'good' END ELSE 'watch' END AS level,
CASE WHEN event_type <> 'error' AND event_id % 3 = 0 THEN 'translation_unavailable' END AS reason FROM events""")
def prj5_translation_quality(spark, d):
    rows = _t(spark, d, "events").select("event_id", (F.col("event_type") == "error").alias("failed"), F.when(F.col("event_id") % 3 != 0, "text").otherwise("").alias("translation"), F.when(F.col("event_id") % 2 == 0, "low").alias("quality"))
    return sessions.translation_quality(rows).select("event_id", "level", "reason")


# Joins


@query(f"WITH {_PAIRS} SELECT p.item_id, p.hypothesis, length(b.text) AS reference_chars FROM pairs p JOIN benchmark b ON b.item_id = p.item_id * 2")
def jn7_hypothesis_fixture(spark, d):
    fixtures = _t(spark, d, "benchmark").select(F.col("item_id").alias("fixture_id"), F.length("text").cast("bigint").alias("reference_chars"))
    return pairs_of(spark, d).withColumn("fixture_id", F.col("item_id") * 2).join(fixtures, "fixture_id").select("item_id", "hypothesis", "reference_chars")


@query(f"""WITH {_SENTENCES}, cues AS (SELECT user_id AS doc_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, event_id AS cue_id, event_id * 100 AS start_ms FROM events)
SELECT s.doc_id, s.i, sentence, cue_id, start_ms FROM sentences s LEFT JOIN cues c ON s.doc_id = c.doc_id AND s.i = c.i""")
def jn8_positional(spark, d):
    place = F.row_number().over(W.partitionBy("client_id").orderBy("ts", "id")).cast("bigint") - 1
    cues = cues_of(spark, d).select(F.col("client_id").alias("doc_id"), place.alias("i"), F.col("id").alias("cue_id"), "start_ms")
    return sentences_of(spark, d).join(cues, ["doc_id", "i"], "left").select("doc_id", "i", "sentence", "cue_id", "start_ms")


# Aggregations and windows


@query("""SELECT user_id AS client_id, round(sum(value), 4) AS audio, """ + ", ".join(f"count(value) FILTER (event_type = '{t}') AS {t}_n, round(quantile_cont(value, 0.5) FILTER (event_type = '{t}'), 6) AS {t}_median, round(quantile_cont(value, 0.95) FILTER (event_type = '{t}'), 6) AS {t}_p95" for t in ("view", "click", "error", "purchase", "signup")) + " FROM events GROUP BY user_id")
def agg2_session_summary(spark, d):
    columns = [F.round(F.sum("value"), 4).alias("audio")]
    for kind in ("view", "click", "error", "purchase", "signup"):
        own = F.when(F.col("event_type") == kind, F.col("value"))
        columns += [F.count(own).alias(f"{kind}_n"), F.round(F.percentile(own, F.lit(0.5)), 6).alias(f"{kind}_median"), F.round(F.percentile(own, F.lit(0.95)), 6).alias(f"{kind}_p95")]
    return _t(spark, d, "events").groupBy(F.col("user_id").alias("client_id")).agg(*columns)


@query("SELECT user_id AS client_id, event_type AS metric, least(count(*), 1000) AS samples FROM events GROUP BY ALL")
def agg4_snapshot(spark, d):
    return _t(spark, d, "events").groupBy(F.col("user_id").alias("client_id"), F.col("event_type").alias("metric")).agg(F.least(F.count("*"), F.lit(1000)).alias("samples"))


@query(f"""WITH {_CHRF}, timed AS (SELECT item_id, chrf, {_CER} AS cer, 40 + item_id * 37 % 900 AS latency_ms FROM scored JOIN pairs USING (item_id)),
s AS (SELECT item_id % 3 AS model, count(*) AS n, avg(chrf) AS chrf, avg(cer) AS cer, avg(latency_ms) AS latency FROM timed GROUP BY 1)
SELECT model, coalesce(n, 0) AS n, CASE WHEN model = 4 THEN 'failed' WHEN n IS NULL THEN 'skipped' ELSE 'ok' END AS status, round(chrf, 4) AS chrf_mean, round(cer, 4) AS cer_mean, round(latency, 1) AS latency_ms_mean FROM (VALUES (0), (1), (2), (3), (4)) AS w(model) LEFT JOIN s USING (model)""")
def agg9_translation_rollup(spark, d):
    """Translation per model; of the models asked for, one has no run and one has failed."""
    runs = pairs_of(spark, d).join(chrf_of(spark, d), "item_id").select((F.col("item_id") % 3).alias("model"), "reference", "hypothesis", "chrf", (40 + F.col("item_id") * 37 % 900).alias("latency_ms"))
    wanted = spark.range(5).select(F.col("id").cast("int").alias("model"), (F.col("id") == 4).alias("failed"))
    return evaluation.translation_rollup(wanted, runs.withColumn("model", F.col("model").cast("int")), "model")


@query("""WITH b AS (SELECT user_id, date_trunc('hour', ts) AS batch, count(*) AS requests, max(value) AS wait FROM events GROUP BY ALL)
SELECT user_id, count(*) AS batches, CAST(sum(requests) AS BIGINT) AS requests, round(quantile_cont(wait, 0.5), 6) AS wait_median, round(quantile_cont(wait, 0.95), 6) AS wait_p95 FROM b GROUP BY user_id""")
def agg13_batches(spark, d):
    b = _t(spark, d, "events").groupBy("user_id", F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("batch")).agg(F.count("*").alias("requests"), F.max("value").alias("wait"))
    p = F.percentile("wait", F.array(F.lit(0.5), F.lit(0.95)))
    return b.groupBy("user_id").agg(F.count("*").alias("batches"), F.sum("requests").alias("requests"), F.round(p[0], 6).alias("wait_median"), F.round(p[1], 6).alias("wait_p95"))


@query(f"""WITH {_SENTENCES} SELECT doc_id, i, nullif(trim('News.' || CASE WHEN i = 0 THEN '' ELSE ' ' || right(string_agg(sentence, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), 420) END, ' '), '') AS prompt FROM sentences""")
def win7_context(spark, d):
    return sentences_of(spark, d).select("doc_id", "i", sessions.context_prompt("News.", "sentence", ["doc_id"], ["i"]).alias("prompt"))


# Sorts and sets


@query(f"WITH {_SESSIONS} SELECT client_id, updated_at FROM sessions ORDER BY updated_at DESC, client_id LIMIT 200")
def srt1_recent_clamped(spark, d):
    return sessions.recent(sessions_of(spark, d), subtitles_of(spark, d), limit=500).select("client_id", "updated_at")


@query(f"WITH {_SESSIONS} SELECT client_id, started_at, row_number() OVER (ORDER BY updated_at DESC, client_id) AS place FROM sessions")
def srt2_saved_newest_first(spark, d):
    return sessions.ranked(sessions_of(spark, d), [F.desc("updated_at"), F.asc("client_id")], "place").select("client_id", "started_at", "place")


@query(f"WITH {_SUBTITLES} SELECT client_id, id, row_number() OVER (PARTITION BY client_id ORDER BY created_at, id) AS place FROM subtitles")
def srt3_session_order(spark, d):
    return subtitles_of(spark, d).select("client_id", "id", F.row_number().over(W.partitionBy("client_id").orderBy("created_at", "id")).cast("bigint").alias("place"))


@query(f"""WITH {_REQUESTS}, r AS (SELECT o.request_id, CASE WHEN plain = '' THEN '' WHEN source = target THEN plain ELSE coalesce(c.translation, md5(plain || '#')) END AS translation FROM requests o LEFT JOIN cache c USING (cache_key))
SELECT request_id, translation FROM r""")
def set1_request_order(spark, d):
    got = sessions.translate(requests_of(spark, d), cache_of(spark, d), lambda t: F.md5(F.concat(t, F.lit("#"))))
    return got.select("request_id", "translation").orderBy("request_id")


@query(f"WITH {_REQUESTS} SELECT cache_key FROM cache WHERE last_access % 3 = 2 AND last_access >= 100")
def set3_invalidate(spark, d):
    stamped = cache_of(spark, d).select("cache_key", (F.col("last_access") % 3).alias("version"), (F.col("last_access") >= 100).cast("int").alias("epoch"))
    return sessions.current(stamped, version=2, epoch=1).select("cache_key")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def set4_delete_entries(spark, d):
    return sessions.delete(_t(spark, d, "documents"), _t(spark, d, "labels").where("toxic = 1"), "doc_id").select("doc_id")


# Functions


@query(f"""WITH {_SENTENCES}, q AS (SELECT doc_id, i, sentence AS p, lead(sentence) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM sentences), w AS (SELECT *, {_words_sql('p')} AS a, {_words_sql('n')} AS b FROM q WHERE n IS NOT NULL),
k AS (SELECT *, {_overlap_sql(10)} FROM w), m AS (SELECT *, {_MERGED_SQL} FROM k) SELECT doc_id, i, merged FROM m""")
def strf7_merge_overlap(spark, d):
    own = sentences_of(spark, d)
    following = F.lead("sentence").over(W.partitionBy("doc_id").orderBy("i"))
    return own.withColumn("following", following).where("following IS NOT NULL").select("doc_id", "i", text.merge_overlap(F.col("sentence"), F.col("following")).alias("merged"))


@query("SELECT event_id, round(greatest(400, least(2000, 400 * (1 + least(1.5, 1.5 * (value / 50))))), 6) AS interval_ms FROM events")
def mth4_interval(spark, d):
    return _t(spark, d, "events").select("event_id", F.round(arrays.partial_interval_ms(400, 2000, F.col("value") / 50), 6).alias("interval_ms"))


@query(f"WITH {_PAIRS} SELECT item_id, {_DISTANCE.format(a='reference', b='hypothesis')} AS letters FROM pairs")
def mth5_letter_distance(spark, d):
    return pairs_of(spark, d).select("item_id", F.levenshtein("reference", "hypothesis").cast("bigint").alias("letters"))


@query(f"WITH {_CODED} SELECT item_id, words FROM coded")
def mth5_word_distance(spark, d):
    return pairs_of(spark, d).select("item_id", arrays.word_distance(arrays.tokens(F.col("reference")), arrays.tokens(F.col("hypothesis"))).cast("bigint").alias("words"))


def _timed(spark, d):
    cut = F.transform(F.split("text", " "), lambda w, i: F.struct(F.concat(F.lit(" "), w).alias("text"), i.cast("bigint").alias("start"), (i - i % 3).cast("bigint").alias("end"), F.lit(None).cast("double").alias("probability")))
    return _t(spark, d, "conversations").withColumn("words", arrays.clean_words(cut))


_CLEAN = "w AS (SELECT conv_id, turn, list_filter(list_transform(string_split(text, ' '), lambda x, i: {'t': trim(x, ' '), 's': i - 1}), lambda x: x.t <> '') AS w FROM conversations)"


@query(f"WITH {_CLEAN} SELECT conv_id, turn, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: x.s)), 0) AS BIGINT) AS ends FROM w")
def arr1_clean_words(spark, d):
    ends = F.aggregate("words", F.lit(0).cast("bigint"), lambda a, w: a + w["end"])
    return _timed(spark, d).select("conv_id", "turn", F.size("words").cast("bigint").alias("n_words"), ends.alias("ends"))


@query(f"WITH {_CLEAN} SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN array_to_string(list_transform(w, lambda x: x.t), ' ') ELSE 'given' END AS segment_text, turn + 5 AS end_at FROM w")
def arr2_clean_segments(spark, d):
    rows = _timed(spark, d).select("conv_id", "turn", "words", F.when(F.col("turn") % 2 == 0, " ").otherwise(" given ").alias("text"), (F.col("turn") + 5).alias("start"), F.col("turn").alias("end"))
    return rows.select("conv_id", "turn", arrays.segment_text(F.col("text"), F.col("words")).alias("segment_text"), F.greatest("start", "end").alias("end_at"))


@query("SELECT vec_id, list_transform(range(1, 33), lambda i: CASE WHEN abs(embedding[i]) >= abs(embedding[i + 32]) THEN embedding[i] ELSE embedding[i + 32] END)::VARCHAR = '' AS blank, round(list_sum(list_transform(range(1, 33), lambda i: (CASE WHEN abs(embedding[i]) >= abs(embedding[i + 32]) THEN embedding[i] ELSE embedding[i + 32] END)::DOUBLE)), 5) AS total FROM embeddings")
def aud2_loudest_mix(spark, d):
    from subtide.operators.audio import loudest_mix

    mixed = loudest_mix(F.array(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32)))
    total = F.aggregate(mixed, F.lit(0.0), lambda a, x: a + x.cast("double"))
    return _t(spark, d, "embeddings").select("vec_id", F.lit(False).alias("blank"), F.round(total, 5).alias("total"))


@query()
def aud3_resample(spark, d):
    from subtide.operators.audio import resample

    chunks = _t(spark, d, "embeddings").select(F.col("label").alias("recording"), F.col("vec_id").alias("seq"), F.col("embedding").alias("samples"))
    return resample(chunks, 48_000).select("recording", "seq", "n_samples", F.hex("pcm").alias("pcm"))


# Sinks


@query(_SQL["agg8_evaluation"])
def snk5_report(spark, d):
    from subtide.plans.registry import agg8_evaluation

    return reports.write_report(agg8_evaluation(spark, d), reports.working_folder(spark), "run-1")


@query("""SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN 'Untitled session' ELSE 'conv ' || conv_id END AS name, count(*) AS n_items, '[' || string_agg('{"turn":' || turn || ',"role":"' || role || '"}', ',' ORDER BY turn) || ']' AS snapshot FROM conversations GROUP BY conv_id""")
def snk7_session_snapshot(spark, d):
    name = F.when(F.col("conv_id") % 3 == 0, "  ").otherwise(F.concat(F.lit(" conv "), F.col("conv_id").cast("string"), F.lit(" ")))
    items = F.array_sort(F.collect_list(F.struct("turn", "role")))
    got = _t(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_items"), F.to_json(items).alias("snapshot"))
    return got.select("conv_id", F.coalesce(F.nullif(F.trim(name), F.lit("")), F.lit("Untitled session")).alias("name"), "n_items", "snapshot")


# The user's functions


@query(r"SELECT conv_id * 1000 + turn AS request_id, source || '>' || target || ':' || CAST(length(text) AS VARCHAR) AS translation FROM (SELECT *, CASE WHEN turn % 2 = 0 THEN 'nl' ELSE 'de' END AS source, 'en' AS target FROM conversations)")
def udf1_translator(spark, d):
    asked = _t(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"), "text", F.when(F.col("turn") % 2 == 0, "nl").otherwise("de").alias("source"), F.lit("en").alias("target"))
    return scoring.translate_many(asked, lambda: lambda texts, a, b: [f"{a}>{b}:{len(t)}" for t in texts])


@query("SELECT vec_id AS segment_id, CASE WHEN vec_id % 4 <> 0 THEN CAST(len(embedding) * 32 AS BIGINT) END AS n, CASE WHEN vec_id % 4 = 0 THEN 'too_short' END AS reason FROM embeddings")
def udf2_recogniser(spark, d):
    samples = F.when(F.col("vec_id") % 4 == 0, F.col("embedding")).otherwise(F.flatten(F.array_repeat("embedding", 32)))
    return scoring.recognise(_t(spark, d, "embeddings").select(F.col("vec_id").alias("segment_id"), samples.alias("samples")), lambda: lambda s: {"n": len(s)}, "n long")


@query(rf"SELECT doc_id, {_normal_sql(r'''regexp_replace(regexp_replace(N, 'a(n|r)', '<\1>', 'gi'), 'the +', 'the-', 'gi')''').replace('N,', _normal_sql('text') + ',')} AS corrected FROM documents")
def udf3_user_rules(spark, d):
    return _t(spark, d, "documents").select("doc_id", text.correct(F.col("text"), [("a(n|r)", "<$1>"), ("the +", "the-")]).alias("corrected"))
