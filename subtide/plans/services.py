"""Queries of raw messages, logs, state logs, language pairs, and counts of caches and stages."""

from __future__ import annotations

from pyspark.sql import functions as F

from subtide.functions import text
from subtide.operators import languages, logs
from subtide.plans.registry import _LANG_ROWS, _REQUESTS, _plain_sql, _t, cache_of, query, requests_of
from subtide.sources import json_columns

_KNOWN = [code for code, _, _ in _LANG_ROWS]
_KNOWN_SQL = "(" + ", ".join(f"'{c}'" for c in _KNOWN) + ")"
# The steps that the states of the client may take.
STEPS = [
    ("idle", "starting-backend"), ("starting-backend", "connecting"), ("starting-backend", "stopping"), ("starting-backend", "error"), ("connecting", "capturing"), ("connecting", "reconnecting"), ("connecting", "stopping"),
    ("connecting", "error"), ("capturing", "paused"), ("capturing", "reconnecting"), ("capturing", "stopping"), ("capturing", "error"), ("paused", "capturing"), ("paused", "reconnecting"), ("paused", "stopping"), ("paused", "error"),
    ("reconnecting", "capturing"), ("reconnecting", "paused"), ("reconnecting", "stopping"), ("reconnecting", "error"), ("stopping", "idle"), ("stopping", "error"), ("error", "starting-backend"), ("error", "idle"),
]
_STATES = ["idle", "starting-backend", "connecting", "capturing", "paused", "reconnecting", "stopping", "error"]


@query("""WITH raw AS (SELECT event_id, user_id, CASE event_id % 5 WHEN 0 THEN '{"type": "broken"' WHEN 1 THEN '["' || event_type || '"]' WHEN 2 THEN '{"type": "flush"}' WHEN 3 THEN '{"type": "audio_gap", "gap_seconds": ' || CAST(json_extract(props, '$.k') AS VARCHAR) || '}' ELSE '{"type": "' || event_type || '", "text": "' || user_id || '"}' END AS raw FROM events)
SELECT event_id, user_id AS client_id, json_extract_string(raw, '$.type') AS type, CAST(json_extract(raw, '$.gap_seconds') AS DOUBLE) AS gap_seconds, json_extract_string(raw, '$.text') AS text FROM raw WHERE event_id % 5 > 1""")
def src1_raw_messages(spark, d):
    """Messages as they come: text that is no JSON object is ignored, the others are told apart by their type."""
    which, k = F.col("event_id") % 5, F.from_json("props", "k int")["k"]
    raw = (
        F.when(which == 0, '{"type": "broken"').when(which == 1, F.to_json(F.array("event_type"))).when(which == 2, '{"type": "flush"}').when(which == 3, F.to_json(F.struct(F.lit("audio_gap").alias("type"), k.alias("gap_seconds"))))
        .otherwise(F.to_json(F.struct(F.col("event_type").alias("type"), F.col("user_id").cast("string").alias("text"))))
    )
    rows = _t(spark, d, "events").select("event_id", F.col("user_id").alias("client_id"), raw.alias("raw"))
    return json_columns.messages(rows, "raw", "type string, gap_seconds double, text string").select("event_id", "client_id", "message.type", "message.gap_seconds", "message.text")


@query("SELECT event_id, event_type || ' ' || user_id AS line FROM (SELECT * FROM events ORDER BY event_id DESC LIMIT 5000)")
def src8_log_lines(spark, d):
    """The last lines of the log; more than 5,000 are asked for."""
    lines = _t(spark, d, "events").select("event_id", F.concat_ws(" ", "event_type", F.col("user_id").cast("string")).alias("line"))
    return logs.tail(lines, "event_id", 9999)


@query(r"""SELECT event_id, event_type || ' | user=' || user_id || ' | props=' || replace(props, ' ', '') || ' | note=' || CASE WHEN event_id % 3 = 0 THEN repeat('x', 600) || '…' ELSE 'two lines' END || ' | missing=None' AS line FROM events""")
def snk6_nested_line(spark, d):
    note = F.when(F.col("event_id") % 3 == 0, F.repeat(F.lit("x"), F.lit(601))).otherwise(F.lit("two\nlines"))
    fields = [("user", F.col("user_id").cast("string")), ("props", F.to_json(F.from_json("props", "k int"))), ("note", note), ("missing", F.lit(None).cast("string"))]
    return _t(spark, d, "events").select("event_id", logs.line(F.col("event_type"), fields).alias("line"))


@query(f"""SELECT conv_id, turn, 'role,turn,TOKEN' AS fields, CASE WHEN role = 'user' THEN '{logs.REDACTED}' ELSE '' END AS token,
CASE WHEN turn % 2 = 0 THEN '{logs.HIDDEN}' WHEN length(p) > 180 THEN left(p, 180) || '…' ELSE p END AS preview
FROM (SELECT *, trim(regexp_replace(coalesce(text, ''), '[WHITE]+', ' ', 'g'), ' ') AS p FROM conversations)""".replace("WHITE", text.WHITE))
def prj4_log_context(spark, d):
    """What of a turn may be logged: no transcript, no secret, a preview where texts may be shown."""
    rows = _t(spark, d, "conversations")
    context = F.map_from_arrays(F.array(*map(F.lit, ["dutch", "role", "turn", "TOKEN", "transcript"])), F.array("text", "role", F.col("turn").cast("string"), F.when(F.col("role") == "user", "t").otherwise(""), "text"))
    safe = logs.redacted(logs.without_transcripts(context), ("TOKEN",))
    return rows.select("conv_id", "turn", F.array_join(F.map_keys(safe), ",").alias("fields"), safe["TOKEN"].alias("token"), logs.preview(F.col("text"), F.col("turn") % 2 != 0).alias("preview"))


_STATE_SQL = "CASE (user_id + CAST(json_extract(props, '$.k') AS BIGINT)) % 8 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(_STATES)) + " END"
_STEPS_SQL = ", ".join(f"('{a}', '{b}')" for a, b in STEPS)


@query(f"""WITH log AS (SELECT user_id AS client_id, event_id AS seq, {_STATE_SQL} AS state FROM events), steps(previous, state) AS (VALUES {_STEPS_SQL}), b AS (SELECT *, lag(state) OVER (PARTITION BY client_id ORDER BY seq) AS previous FROM log)
SELECT client_id, seq, b.state, b.previous, b.previous IS NULL OR s.state IS NOT NULL AS valid FROM b LEFT JOIN steps s ON s.previous = b.previous AND s.state = b.state""")
def win11_state_log(spark, d):
    """The steps of the client's states, judged by the table of steps."""
    number = (F.col("user_id") + F.from_json("props", "k int")["k"]) % 8
    log = _t(spark, d, "events").select(F.col("user_id").alias("client_id"), F.col("event_id").alias("seq"), F.get(F.array(*map(F.lit, _STATES)), number.cast("int")).alias("state"))
    return logs.transitions(log, spark.sql(f"SELECT * FROM VALUES {_STEPS_SQL} AS t(previous, state)"), "client_id", ["seq"])


@query("""WITH pairs AS (SELECT DISTINCT lang AS source, CASE doc_id % 3 WHEN 0 THEN 'nl' WHEN 1 THEN 'sv' ELSE 'en' END AS target FROM documents WHERE lang IN ('de', 'fr') AND length(text) > 200), s AS (SELECT DISTINCT lang AS source FROM documents)
SELECT s.source, coalesce(target, 'en') AS target FROM s LEFT JOIN pairs USING (source)""")
def flt14_listed_pairs(spark, d):
    """Targets of a model with listed pairs (those of the long German and French documents)."""
    docs = _t(spark, d, "documents")
    which = F.col("doc_id") % 3
    listed = docs.where(F.col("lang").isin("de", "fr") & (F.length("text") > 200)).select(F.col("lang").alias("source"), F.when(which == 0, "nl").when(which == 1, "sv").otherwise("en").alias("target"))
    return languages.allowed_targets(docs.select(F.col("lang").alias("source")), _KNOWN, listed)


@query(f"""WITH r AS (SELECT doc_id AS request_id, lang AS source, CASE doc_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'nl' WHEN 2 THEN lang ELSE 'xx' END AS target FROM documents)
SELECT request_id, source, target, CASE WHEN source NOT IN {_KNOWN_SQL} OR target NOT IN {_KNOWN_SQL} THEN 'unsupported_language' WHEN source <> target AND NOT (source = 'de' AND target = 'en') THEN 'unsupported_language_pair' END AS problem FROM r""")
def jn4_validated(spark, d):
    """Requests to a model of one pair, German to English, with what is wrong with each."""
    which = F.col("doc_id") % 4
    target = F.when(which == 0, " EN").when(which == 1, "nl").when(which == 2, F.col("lang")).otherwise("xx")
    asked = _t(spark, d, "documents").select(F.col("doc_id").alias("request_id"), F.col("lang").alias("source"), target.alias("target"))
    return languages.validated(asked, _KNOWN, ("de", "en"))


@query(f"""WITH {_REQUESTS}, l AS (SELECT count(*) AS lookups, count(c.cache_key) AS hits, count(DISTINCT CASE WHEN c.cache_key IS NULL THEN o.cache_key END) AS sets FROM requests o LEFT JOIN cache c USING (cache_key)), held AS (SELECT count(*) AS held FROM cache)
SELECT hits, lookups - hits AS misses, round(CASE WHEN lookups > 0 THEN hits / lookups ELSE 0 END, 6) AS hit_ratio, sets, least(100, held + sets) AS size, greatest(0, held + sets - 100) AS evictions FROM l, held""")
def agg7_cache_counts(spark, d):
    """Hits, misses, what the misses add, and what a bound of 100 entries leaves."""
    cache, bound = cache_of(spark, d), 100
    met = requests_of(spark, d).join(cache.select("cache_key", F.lit(1).alias("hit")), "cache_key", "left")
    by_key = met.groupBy("cache_key").agg(F.count("*").alias("n"), F.count("hit").alias("hits"))
    counts = by_key.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("lookups"), F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"), F.count_if(F.col("hits") == 0).alias("sets"))
    held = F.col("held") + F.col("sets")
    known = counts.withColumn("held", cache.agg(F.count("*")).scalar())
    return known.select("hits", (F.col("lookups") - F.col("hits")).alias("misses"), F.round(F.coalesce(F.try_divide("hits", "lookups"), F.lit(0.0)), 6).alias("hit_ratio"), "sets", F.least(F.lit(bound), held).alias("size"), F.greatest(F.lit(0), held - bound).alias("evictions"))


@query("""SELECT user_id AS client_id, count(*) FILTER (event_type = 'click') AS finals, count(*) FILTER (event_type = 'click' AND value < 20) AS empty_finals, round(coalesce(sum(value) FILTER (event_type = 'click'), 0), 4) AS asr_ms, round(coalesce(sum(value) FILTER (event_type = 'purchase'), 0), 4) AS translation_ms,
min(ts) FILTER (event_type = 'view') AS first_partial_at, min(ts) FILTER (event_type = 'click') AS first_final_at, round(count(*) FILTER (event_type = 'click') / greatest(epoch_us(max(ts)) - epoch_us(min(ts)), 1) * 1000000 * 3600, 6) AS finals_per_hour,
round(count(*) FILTER (event_type = 'view') / greatest(epoch_us(max(ts)) - epoch_us(min(ts)), 1) * 1000000 * 60, 6) AS partials_per_minute FROM events GROUP BY user_id""")
def agg11_stage_totals(spark, d):
    """Throughput, sums per stage, finals without text and the first results of each session."""
    kind = lambda k: F.col("event_type") == k
    span = F.greatest(F.expr("timestampdiff(MICROSECOND, CAST(min(ts) AS TIMESTAMP_NTZ), CAST(max(ts) AS TIMESTAMP_NTZ))"), F.lit(1))
    total = lambda k: F.round(F.coalesce(F.sum(F.when(kind(k), F.col("value"))), F.lit(0.0)), 4)
    return _t(spark, d, "events").groupBy(F.col("user_id").alias("client_id")).agg(
        F.count_if(kind("click")).alias("finals"), F.count_if(kind("click") & (F.col("value") < 20)).alias("empty_finals"), total("click").alias("asr_ms"), total("purchase").alias("translation_ms"),
        F.min(F.when(kind("view"), F.col("ts"))).alias("first_partial_at"), F.min(F.when(kind("click"), F.col("ts"))).alias("first_final_at"),
        F.round(F.count_if(kind("click")) / span * 1000000 * 3600, 6).alias("finals_per_hour"), F.round(F.count_if(kind("view")) / span * 1000000 * 60, 6).alias("partials_per_minute"),
    )


@query(f"""WITH m AS (SELECT page_id, {_plain_sql("'failed at  ' || coalesce(url, '') || ' in /opt/models/ and /'")} AS plain FROM pages)
SELECT page_id, array_to_string(list_transform(string_split(plain, ' '), lambda t: CASE WHEN contains(t, '/') THEN coalesce(list_filter(string_split(t, '/'), lambda c: c <> '' AND c <> '.')[-1], '<path>') ELSE t END), ' ') AS debug FROM m""")
def strf14_debug_text(spark, d):
    """Messages with addresses and folders, as they may be shown."""
    message = F.concat(F.lit("failed at  "), F.coalesce("url", F.lit("")), F.lit(" in /opt/models/ and /"))
    return _t(spark, d, "pages").select("page_id", text.without_paths(message).alias("debug"))
