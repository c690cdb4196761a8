"""Queries of the session state machines, as folds over tables and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from subtide.functions import text
from subtide.operators import islands, transcripts
from subtide.plans.registry import _MERGED, _MESSAGES, _SQL, _t, messages_of, query, transcript_of
from subtide.sources.history import History
from subtide.sources.reports import working_folder
from subtide.streaming import keyed, live, machines
from subtide.streaming.fold import fold, stream_fold


def backlog_of(events: DataFrame) -> DataFrame:
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    return events.select(F.col("user_id").alias("client_id"), F.col("event_id").alias("seq"), at.alias("at_ms"), (F.floor(F.col("value") * 1000) / 32).alias("buffered_ms"), (F.col("event_type") == "error").alias("gap_sent"))


def chunks_of(events: DataFrame) -> DataFrame:
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    return events.select(F.col("user_id").alias("client_id"), F.col("event_id").alias("seq"), at.alias("at_ms"), F.lit(3200).alias("n_samples"), (F.col("value") / 1000).alias("level"), (F.col("event_type") == "error").alias("asr_busy"))


def streamed(rows: DataFrame, spark, mode: str = "append") -> DataFrame:
    """What the stream gives until its input ends, as a table in the shared folder; each micro-batch replaces its own part, so a retried one adds nothing.

    In the mode ``update`` the table has the number of the micro-batch as ``batch``.
    """
    base = working_folder(spark)

    def write(frame: DataFrame, k: int) -> None:
        frame.write.mode("overwrite").parquet(f"{base}/table/batch={k}")

    running = rows.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    running.awaitTermination()
    table = spark.read.parquet(f"{base}/table")
    return table if mode == "update" else table.drop("batch")


def _stream(spark, d: str, name: str) -> DataFrame:
    # A pattern, since a stream takes a plain path for a folder and the table may be one file.
    return spark.readStream.schema(_t(spark, d, name).schema).parquet(f"{d}/{name}.parquet*")


@query("""WITH RECURSIVE r AS (SELECT user_id AS client_id, event_id AS seq, value / 1000 >= 0.010::DOUBLE AS loud, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
f AS (SELECT DISTINCT client_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS BIGINT) AS first_seq, CAST(0 AS BIGINT) AS speech, CAST(0 AS BIGINT) AS silence, CAST(NULL AS VARCHAR) AS reason, CAST(NULL AS BIGINT) AS began, CAST(0 AS BIGINT) AS total, n FROM r
UNION ALL SELECT client_id, i, seq, CASE WHEN reason IS NULL AND open THEN first_seq END, CASE WHEN reason IS NULL AND open THEN speech ELSE 0 END, CASE WHEN reason IS NULL AND open THEN silence ELSE 0 END, CASE WHEN reason IS NULL AND open AND i = n THEN 'flush' ELSE reason END, first_seq, speech, n
 FROM (SELECT *, CASE WHEN NOT going THEN NULL WHEN speech >= 72000 THEN 'max' WHEN speech >= 4000 AND silence >= 8000 THEN 'silence' END AS reason
  FROM (SELECT r.client_id, r.i, r.seq, r.n, f.first_seq IS NOT NULL AS going, f.first_seq IS NOT NULL OR r.loud AS open, coalesce(f.first_seq, r.seq) AS first_seq, f.speech + 3200 AS speech, CASE WHEN r.loud OR f.first_seq IS NULL THEN 0 ELSE f.silence + 3200 END AS silence
   FROM f JOIN r ON r.client_id = f.client_id AND r.i = f.i + 1)))
SELECT client_id, began AS first_seq, seq AS last_seq, total AS n_samples, reason FROM f WHERE reason IS NOT NULL""")
def str1_segments(spark, d):
    return islands.segments(chunks_of(_t(spark, d, "events")), "client_id", ["at_ms", "seq"], machines.Segmenter())


@query()
def str2_snapshots(spark, d):
    return fold(chunks_of(_t(spark, d, "events")), "client_id", ["at_ms", "seq"], machines.Snapshots())


@query()
def str3_sentences(spark, d):
    rows = _t(spark, d, "conversations").select("conv_id", F.col("turn").alias("seq"), "text", (F.col("turn") % 3 == 2).alias("forced"), F.lit("nl").alias("source_lang"))
    return fold(rows, "conv_id", ["seq"], machines.SentenceAssembler())


@query()
def str5_stabilized(spark, d):
    """What is shown of an utterance after its partials; a final (here: an assistant's turn) ends one."""
    order = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    rows = _t(spark, d, "conversations").withColumn("utterance", F.coalesce(F.count_if(F.col("role") == "assistant").over(order), F.lit(0)))
    partials = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    grouped = rows.groupBy("conv_id", "utterance").agg(partials.alias("partials"))
    return grouped.select("conv_id", "utterance", F.aggregate("partials", F.lit(""), lambda shown, x: text.stabilize(shown, x)).alias("shown"))


@query(f"""WITH {_MESSAGES} SELECT client_id, k AS id, min(seq) AS first_seq, count(*) FILTER (type = 'final') = 0 AS pending, coalesce(arg_max(value, seq) FILTER (type = 'final'), arg_max(value, seq)) AS value
FROM messages WHERE type IN ('partial', 'final') GROUP BY ALL""")
def str6_pending_final(spark, d):
    rows = messages_of(spark, d).where(F.col("type").isin("partial", "final"))
    final = F.col("type") == "final"
    return rows.groupBy("client_id", F.col("k").alias("id")).agg(F.min("seq").alias("first_seq"), (F.count_if(final) == 0).alias("pending"), F.max_by("value", F.struct(final, "seq")).alias("value"))


_BACKLOG = """WITH RECURSIVE r AS (SELECT user_id AS client_id, event_id AS seq, (epoch_us(ts) // 1000) AS tm, floor(value * 1000) / 32 AS level, event_type = 'error' AS gap, row_number() OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000), event_id) AS i FROM events),
f AS (SELECT DISTINCT client_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS seq, 'normal' AS state, CAST(NULL AS BIGINT) AS since, CAST(0 AS BIGINT) AS episodes, CAST(0 AS BIGINT) AS longest_ms, CAST(0 AS BIGINT) AS dropped, CAST(0 AS BIGINT) AS gaps FROM r
UNION ALL SELECT client_id, i, seq, new, CASE WHEN new = 'normal' THEN NULL WHEN new IN ('congested', 'dropping') THEN coalesce(kept, tm) ELSE kept END, episodes + CASE WHEN new IN ('congested', 'dropping') AND kept IS NULL THEN 1 ELSE 0 END,
 greatest(longest_ms, CASE WHEN before <> 'normal' AND new = 'normal' AND since IS NOT NULL OR ended THEN tm - since ELSE 0 END), dropped + CASE WHEN new = 'dropping' THEN 1 ELSE 0 END, gaps + CASE WHEN ended THEN 1 ELSE 0 END
 FROM (SELECT *, CASE WHEN ended THEN NULL ELSE since END AS kept, CASE state WHEN 'normal' THEN CASE WHEN level >= 1200 THEN 'dropping' WHEN level >= 600 THEN 'congested' ELSE 'normal' END WHEN 'congested' THEN CASE WHEN level >= 1200 THEN 'dropping' WHEN level <= 350 THEN 'normal' ELSE state END
   WHEN 'dropping' THEN CASE WHEN level <= 400 THEN 'recovery' ELSE state END ELSE CASE WHEN level >= 1200 THEN 'dropping' ELSE state END END AS new
  FROM (SELECT r.client_id, r.i, r.seq, r.tm, r.level, f.state AS before, r.gap AND f.state = 'recovery' AS ended, CASE WHEN r.gap AND f.state = 'recovery' THEN 'normal' ELSE f.state END AS state, f.since, f.episodes, f.longest_ms, f.dropped, f.gaps
   FROM f JOIN r ON r.client_id = f.client_id AND r.i = f.i + 1)))
SELECT client_id, seq, state, CASE state WHEN 'normal' THEN 'sent' WHEN 'dropping' THEN 'drop' ELSE 'warn' END AS action, episodes, longest_ms, dropped, gaps FROM f WHERE i > 0"""


@query(_BACKLOG)
def str8_backlog(spark, d):
    return fold(backlog_of(_t(spark, d, "events")), "client_id", ["at_ms", "seq"], machines.Backlog())


@query(_BACKLOG)
def str8_backlog_stream(spark, d):
    return streamed(stream_fold(backlog_of(_stream(spark, d, "events")), "client_id", ["at_ms", "seq"], machines.Backlog()), spark)


@query("""WITH RECURSIVE r AS (SELECT lang AS pair, doc_id AS seq, coalesce(length(text), 0) AS n_chars, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS i FROM documents),
f AS (SELECT DISTINCT pair, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS seq, CAST(0 AS BIGINT) AS batch, CAST(0 AS BIGINT) AS n_chars, CAST(0 AS BIGINT) AS requests, CAST(0 AS BIGINT) AS chars FROM r
UNION ALL SELECT pair, i, seq, batch + CASE WHEN is_full THEN 1 ELSE 0 END, n, CASE WHEN is_full THEN 1 ELSE requests + 1 END, CASE WHEN is_full THEN n ELSE chars + n END
 FROM (SELECT r.pair, r.i, r.seq, r.n_chars AS n, f.batch, f.requests, f.chars, f.requests > 0 AND (f.requests >= 8 OR f.chars + r.n_chars > 2400) AS is_full FROM f JOIN r ON r.pair = f.pair AND r.i = f.i + 1))
SELECT pair, seq, batch, n_chars FROM f WHERE i > 0""")
def str11_request_batches(spark, d):
    """Batches of all requests of a language, in the order of their ids."""
    rows = _t(spark, d, "documents").select(F.col("lang").alias("pair"), F.col("doc_id").alias("seq"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"))
    return islands.request_batches(rows, "pair", "seq", "n_chars")


@query(f"""WITH RECURSIVE {_MESSAGES}, r AS (SELECT client_id, seq, type AS kind, seq // 2000 AS epoch, CAST(floor(value * 1000) AS BIGINT) AS n, row_number() OVER (PARTITION BY client_id ORDER BY seq) AS i FROM messages WHERE type IN ('partial', 'final')),
f AS (SELECT DISTINCT client_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS number, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS kind, CAST(NULL AS BIGINT) AS epoch, CAST(0 AS BIGINT) AS total, CAST(0 AS BIGINT) AS n FROM r
UNION ALL SELECT client_id, i, number + CASE WHEN joins THEN 0 ELSE 1 END, seq, kind, epoch, CASE WHEN joins THEN total + n ELSE n END, n
 FROM (SELECT r.client_id, r.i, f.number, r.seq, r.kind, r.epoch, f.total, r.n, coalesce(r.kind = 'final' AND f.kind = 'final' AND f.epoch = r.epoch AND f.total + r.n <= 192000, false) AS joins FROM f JOIN r ON r.client_id = f.client_id AND r.i = f.i + 1))
SELECT client_id, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS n_segments, CAST(sum(n) AS BIGINT) AS n_samples, min(seq) * 100 AS created_ms FROM f WHERE i > 0 GROUP BY client_id, number""")
def str12_merged_segments(spark, d):
    rows = messages_of(spark, d).where(F.col("type").isin("partial", "final")).select("client_id", "seq", F.col("type").alias("kind"), F.lit("c").alias("config"), (F.floor(F.col("seq") / 2000)).alias("epoch"), F.floor(F.col("value") * 1000).alias("n_samples"), (F.col("seq") * 100).alias("created_ms"))
    return fold(rows, "client_id", ["seq"], machines.MergedSegments())


@query(_SQL["str13_hourly_metrics"])
def str13_metrics_stream(spark, d):
    """Every hour of the input. A micro-batch gives the hours that it changed, as they stand then; the last of each is its row."""
    keyed.with_state_store(spark)
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("hour")
    hourly = _stream(spark, d, "events").groupBy(F.col("user_id").alias("client_id"), hour).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    changes = streamed(hourly, spark, "update")
    last = changes.groupBy("client_id", "hour").agg(F.max_by(F.struct("n", "total"), "batch").alias("m"))
    return last.select("client_id", "hour", "m.n", F.round("m.total", 4).alias("total"))


# Whole sessions. On their clock an hour of the events is a second.

_CLOCK = "(epoch_us(ts) // 1000) // 3600"


def watched_of(events: DataFrame) -> DataFrame:
    at = F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ)) div 3600")
    kind = F.when(F.col("event_type") == "view", "queued").when(F.col("event_type") == "click", "done").when((F.col("event_type") == "error") & (F.col("value") > 100), "close").otherwise("other")
    return events.select(F.col("user_id").alias("client_id"), F.col("event_id").alias("seq"), at.alias("at_ms"), (F.col("value") / 1000).alias("level"), kind.alias("kind"))


def _end(rows: DataFrame) -> int:
    return rows.agg(F.coalesce(F.max("at_ms"), F.lit(0))).first()[0]


_SILENCE = f"""WITH r AS (SELECT user_id AS client_id, event_id AS seq, {_CLOCK} AS tm, value / 1000 > 0.005 AS loud FROM events), until AS (SELECT max(tm) AS until FROM r),
begun AS (SELECT client_id, min(tm) AS began, min(tm) FILTER (loud) AS first FROM r GROUP BY client_id), heard AS (SELECT client_id, tm, lag(tm) OVER o AS was, lead(tm) OVER o AS next FROM r WHERE loud WINDOW o AS (PARTITION BY client_id ORDER BY tm, seq))
SELECT client_id, began + 8000 AS at_ms, 'initial_silence' AS event, 8000 AS silent_ms FROM begun, until WHERE coalesce(first >= began + 8000, true) AND began + 8000 <= until
UNION ALL SELECT client_id, tm + 60000, 'capture_loss', 60000 FROM heard, until WHERE coalesce(next >= tm + 60000, true) AND tm + 60000 <= until
UNION ALL SELECT client_id, tm, 'restored', tm - was FROM heard WHERE tm >= was + 60000
UNION ALL SELECT client_id, first, 'restored', NULL FROM begun WHERE first >= began + 8000"""


@query(_SILENCE)
def str9_silence_watch(spark, d):
    rows = watched_of(_t(spark, d, "events"))
    return fold(rows, "client_id", ["at_ms", "seq"], live.SilenceWatch(), until=_end(rows))


@query(_SILENCE)
def str9_silence_stream(spark, d):
    return streamed(keyed.timed_stream(watched_of(_stream(spark, d, "events")), "client_id", "at_ms", ["seq"], live.SilenceWatch()), spark)


_CLOSED = f"""WITH r AS (SELECT user_id AS client_id, event_id AS seq, {_CLOCK} AS tm, CASE WHEN event_type = 'view' THEN 'queued' WHEN event_type = 'click' THEN 'done' WHEN event_type = 'error' AND value > 100 THEN 'close' ELSE 'other' END AS kind FROM events),
c AS (SELECT *, CASE WHEN tm - lag(tm) OVER o >= 6000 OR lag(kind) OVER o = 'close' THEN 1 ELSE 0 END AS cut FROM r WINDOW o AS (PARTITION BY client_id ORDER BY tm, seq)), s AS (SELECT *, sum(cut) OVER (PARTITION BY client_id ORDER BY tm, seq) AS session FROM c),
g AS (SELECT client_id, session, min(tm) AS opened_ms, max(tm) AS last, count(*) AS events, greatest(0, count(*) FILTER (kind = 'queued') - count(*) FILTER (kind = 'done')) AS cancelled, bool_or(kind = 'close') AS told FROM s GROUP BY client_id, session)
SELECT client_id, opened_ms, CASE WHEN told THEN last ELSE last + 6000 END AS closed_ms, events, cancelled, CASE WHEN told THEN 'close' ELSE 'idle' END AS reason FROM g WHERE told OR last + 6000 <= (SELECT max(tm) FROM r)"""


@query(_CLOSED)
def str14_session_close(spark, d):
    rows = watched_of(_t(spark, d, "events"))
    return fold(rows, "client_id", ["at_ms", "seq"], live.SessionClose(idle_ms=6000), until=_end(rows))


@query(_CLOSED)
def str14_sessions_stream(spark, d):
    """Sessions that ended: each is given once, by its close or by a timer, and its state dropped."""
    return streamed(keyed.timed_stream(watched_of(_stream(spark, d, "events")), "client_id", "at_ms", ["seq"], live.SessionClose(idle_ms=6000)), spark)


@query(_MERGED)
def str6_upsert_stream(spark, d):
    events = _stream(spark, d, "events")
    return transcripts.latest_version(streamed(keyed.transcript_stream(transcript_of(messages_of(spark, d, events)), ttl_ms=30 * 86_400_000), spark))


@query()
def str7_live_sessions(spark, d):
    """Segments, sentences and clock of sessions with gaps and changes of settings in mid-utterance."""
    m = messages_of(spark, d)
    seq, k, audio = F.col("seq"), F.col("k"), F.col("type").isin("partial", "final") | ((F.col("type") == "flush") & (F.col("seq") % 50 != 0))
    said = F.when(k % 4 == 0, F.concat(F.lit("and that is "), k, F.lit("."))).otherwise(F.concat(F.lit("word number "), k))
    rows = m.select(
        "client_id", "seq", F.when(audio, "audio").otherwise(F.col("type")).alias("kind"), F.when(audio, 8000).alias("n_samples"), (F.col("value") / 1000).alias("level"), said.alias("text"), (F.col("value") / 40).alias("rtf"), (k * 10).alias("gap_ms"),
        F.when(k % 3 == 0, "fast").when(k % 3 == 1, "quality").otherwise("balanced").alias("mode"), "source_lang", "target_lang", "prompt",
    )
    return fold(rows, "client_id", ["seq"], live.LiveSession())


@query(f"""WITH RECURSIVE {_MESSAGES}, r AS (SELECT client_id, seq, row_number() OVER (PARTITION BY client_id ORDER BY seq) AS i, CASE WHEN type = 'config' THEN CASE k % 3 WHEN 0 THEN 'fast' WHEN 1 THEN 'quality' ELSE 'balanced' END END AS told, value / 40 AS rtf FROM messages WHERE type IN ('final', 'config')),
modes(m, s, l, fs, fl) AS (VALUES ('fast', 0.35::DOUBLE, 3.0::DOUBLE, 0.25::DOUBLE, 1.8::DOUBLE), ('balanced', 0.5::DOUBLE, 4.5::DOUBLE, 0.35::DOUBLE, 2.5::DOUBLE), ('quality', 0.7::DOUBLE, 5.8::DOUBLE, 0::DOUBLE, 0::DOUBLE)),
f AS (SELECT DISTINCT client_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS seq, 'balanced' AS mode, 0.5::DOUBLE AS silence, 4.5::DOUBLE AS longest FROM r
UNION ALL SELECT r.client_id, r.i, r.seq, CASE WHEN told IS NOT NULL THEN told WHEN f.mode = 'balanced' AND rtf > 1.2 THEN 'fast' ELSE f.mode END,
 CASE WHEN told IS NOT NULL THEN t.s WHEN f.mode = 'balanced' AND rtf > 1.2 THEN 0.35::DOUBLE WHEN f.mode = 'quality' OR rtf <= 0 THEN silence WHEN rtf > 1 THEN greatest(o.fs, silence * 0.9::DOUBLE) WHEN rtf < 0.45 THEN o.s ELSE silence END,
 CASE WHEN told IS NOT NULL THEN t.l WHEN f.mode = 'balanced' AND rtf > 1.2 THEN 3.0::DOUBLE WHEN f.mode = 'quality' OR rtf <= 0 THEN longest WHEN rtf > 1 THEN greatest(o.fl, longest * 0.85::DOUBLE) WHEN rtf < 0.45 THEN least(o.l, longest * 1.05::DOUBLE) ELSE longest END
 FROM f JOIN r ON r.client_id = f.client_id AND r.i = f.i + 1 JOIN modes o ON o.m = f.mode LEFT JOIN modes t ON t.m = told)
SELECT client_id, seq, mode, round(silence, 9) AS silence, round(longest, 9) AS longest FROM f WHERE i > 0""")
def str10_adaptive_limits(spark, d):
    """The limits after every recognised segment and change of mode."""
    m = messages_of(spark, d).where("type IN ('final', 'config')")
    mode = F.when(F.col("type") == "config", F.when(F.col("k") % 3 == 0, "fast").when(F.col("k") % 3 == 1, "quality").otherwise("balanced"))
    found = fold(m.select("client_id", "seq", mode.alias("mode"), (F.col("value") / 40).alias("rtf")), "client_id", ["seq"], live.AdaptiveLimits())
    return found.select("client_id", "seq", "mode", F.round("silence", 9).alias("silence"), F.round("longest", 9).alias("longest"))


def history_jobs_of(events: DataFrame) -> DataFrame:
    """A session job for every event, then a subtitle or, for loud errors, the session's deletion."""
    k = F.from_json("props", "k int")["k"].cast("string")
    session = F.struct((F.col("event_id") * 2).alias("seq"), F.lit("session").alias("kind"), F.lit(None).cast("string").alias("id"))
    kind = F.when(F.col("event_type").isin("view", "click"), "subtitle").when((F.col("event_type") == "error") & (F.col("value") > 100), "delete")
    second = F.struct((F.col("event_id") * 2 + 1).alias("seq"), kind.alias("kind"), F.when(kind == "subtitle", k).alias("id"))
    rows = events.select("event_id", F.col("user_id").alias("client_id"), F.col("ts").alias("at"), F.col("event_type").alias("mode"), F.explode(F.array(session, second)).alias("job"))
    return rows.where("job.kind IS NOT NULL").select("job.seq", "job.kind", "client_id", "job.id", F.col("at").alias("started_at"), "at", "mode", F.concat(F.lit("text "), F.col("event_id")).alias("text"))


@query("""WITH jobs AS (SELECT 2 * event_id AS seq, 'session' AS kind, user_id AS client_id, NULL AS id, ts, event_type AS mode, event_id FROM events
UNION ALL SELECT 2 * event_id + 1, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'subtitle' END, user_id, CASE WHEN event_type <> 'error' THEN CAST(json_extract(props, '$.k') AS VARCHAR) END, ts, event_type, event_id FROM events WHERE event_type IN ('view', 'click') OR (event_type = 'error' AND value > 100)),
gone AS (SELECT client_id, max(seq) AS deleted FROM jobs WHERE kind = 'delete' GROUP BY 1)
SELECT 'session' AS kind, j.client_id, NULL AS id, arg_min(ts, seq) AS started_at, arg_max(ts, seq) AS at, arg_max(mode, seq) AS text FROM jobs j LEFT JOIN gone g ON j.client_id = g.client_id WHERE kind = 'session' AND coalesce(seq > deleted, true) GROUP BY j.client_id
UNION ALL SELECT 'subtitle', s.client_id, s.id, NULL, s.ts, s.text FROM (SELECT id, arg_max(client_id, seq) AS client_id, arg_max(ts, seq) AS ts, 'text ' || arg_max(event_id, seq) AS text, max(seq) AS seq FROM jobs WHERE kind = 'subtitle' GROUP BY id) s
LEFT JOIN gone g ON s.client_id = g.client_id WHERE coalesce(s.seq > deleted, true)""")
def snk1_history_batches(spark, d):
    """A history written in batches of ten days, one of them twice, with a snapshot between; sessions and subtitles as they stand at the end."""
    store, jobs = History(spark, working_folder(spark)), history_jobs_of(_t(spark, d, "events"))
    days = F.datediff("at", F.to_date(F.lit("2024-01-01")))
    for number, part in enumerate((days < 10, (days >= 10) & (days < 20), days >= 20)):
        store.apply(jobs.where(part), number)
        if number == 1:
            store.apply(jobs.where(part), number)
            store.compact()
    none = F.lit(None)
    held = store.sessions().select(F.lit("session").alias("kind"), "client_id", none.cast("string").alias("id"), "started_at", F.col("updated_at").alias("at"), F.col("mode").alias("text"))
    return held.unionByName(store.subtitles().select(F.lit("subtitle").alias("kind"), "client_id", "id", none.cast("timestamp_ntz").alias("started_at"), F.col("created_at").alias("at"), "text"))
