"""Queries of the transcript operators over the driver's tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from subtide.functions import arrays, text
from subtide.operators import cues, evaluation, sessions, transcripts

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _t(spark, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# Relations: the driver's tables as inputs of the operators. Each has the same name in SQL.


def words_of(spark, d) -> DataFrame:
    plain = F.trim(F.regexp_replace("text", "[ \t\n]+", " "))
    tokens = _t(spark, d, "documents").select(F.col("doc_id").alias("client_id"), F.posexplode(F.split(plain, " ")).alias("pos", "word")).where("word <> ''")
    pos = F.col("pos").cast("bigint")
    start = pos * 450 + F.floor(pos / 17) * 900
    return tokens.select("client_id", pos.alias("pos"), "word", start.alias("start_ms"), (start + 350).alias("end_ms"))


_WORDS = r"""tokens AS (SELECT doc_id AS client_id, string_split(trim(regexp_replace(text, '[ \t\n]+', ' ', 'g'), ' '), ' ') AS w FROM documents),
words AS (SELECT client_id, pos, word, pos * 450 + (pos // 17) * 900 AS start_ms, pos * 450 + (pos // 17) * 900 + 350 AS end_ms
          FROM (SELECT client_id, unnest(w) AS word, CAST(unnest(range(len(w))) AS BIGINT) AS pos FROM tokens) WHERE word <> '')"""


def cues_of(spark, d) -> DataFrame:
    start = F.col("event_id") * 100
    return _t(spark, d, "events").select(F.col("user_id").alias("client_id"), F.col("event_id").alias("id"), "ts", start.alias("start_ms"), (start + F.floor(F.col("value") * 40)).alias("end_ms"), F.col("event_type").alias("text"))


_CUES = "cues AS (SELECT user_id AS client_id, event_id AS id, ts, event_id * 100 AS start_ms, event_id * 100 + CAST(floor(value * 40) AS BIGINT) AS end_ms, event_type AS text FROM events)"


def sessions_of(spark, d) -> DataFrame:
    return _t(spark, d, "events").groupBy(F.col("user_id").alias("client_id")).agg(F.min("ts").alias("started_at"), F.max("ts").alias("updated_at"))


def subtitles_of(spark, d) -> DataFrame:
    return _t(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("client_id"), F.col("ts").alias("created_at"), F.col("event_type").alias("source"), F.floor(F.col("value") * 10).cast("bigint").alias("latency_ms"))


_SESSIONS = "sessions AS (SELECT user_id AS client_id, min(ts) AS started_at, max(ts) AS updated_at FROM events GROUP BY 1)"
_SUBTITLES = "subtitles AS (SELECT event_id AS id, user_id AS client_id, ts AS created_at, event_type AS source, CAST(floor(value * 10) AS BIGINT) AS latency_ms FROM events)"


def requests_of(spark, d) -> DataFrame:
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("request_id"), "text", F.col("lang").alias("source"), F.lit("en").alias("target"))
    return docs.withColumn("cache_key", text.cache_key(F.col("text"), F.col("source"), F.col("target")))


def cache_of(spark, d) -> DataFrame:
    """Translations of the longer documents, from 300 characters on."""
    plain = text.collapsed(F.col("text"))
    stored = requests_of(spark, d).where(F.length("text") >= 300)
    return stored.groupBy("cache_key").agg(F.md5(F.concat(F.min(plain), F.lit("#"))).alias("translation"), F.max("request_id").alias("last_access"), F.count("*").alias("hit_count"))


_REQUESTS = r"""requests AS (SELECT doc_id AS request_id, text, lang AS source, 'en' AS target, trim(regexp_replace(text, '[WHITE]+', ' ', 'g'), ' ') AS plain,
              sha256(concat_ws(chr(31), trim(regexp_replace(text, '[WHITE]+', ' ', 'g'), ' '), lang, 'en', 'v1')) AS cache_key FROM documents),
cache AS (SELECT cache_key, md5(min(plain) || '#') AS translation, max(request_id) AS last_access, count(*) AS hit_count FROM requests WHERE length(text) >= 300 GROUP BY cache_key)""".replace("WHITE", text.WHITE)


def messages_of(spark, d, events: DataFrame | None = None) -> DataFrame:
    kind = F.try_element_at(F.map_from_arrays(F.array(*map(F.lit, ["click", "error", "view"])), F.array(*map(F.lit, ["final", "audio_gap", "partial"]))), F.col("event_type"))
    k = F.from_json("props", "k int")["k"].cast("bigint")
    config = F.col("event_type") == "purchase"
    settings = {"source_lang": F.when(config, F.when(k % 3 == 0, "en").otherwise("nl")), "target_lang": F.when(config, "en"), "prompt": F.when(config, F.when(k % 10 == 0, "names").otherwise(""))}
    events = _t(spark, d, "events") if events is None else events
    return events.select(F.col("user_id").alias("client_id"), F.col("event_id").alias("seq"), F.coalesce(kind, F.when(config, "config").otherwise("flush")).alias("type"), k.alias("k"), "value", *[v.alias(c) for c, v in settings.items()])


_MESSAGES = """messages AS (SELECT user_id AS client_id, event_id AS seq, CASE event_type WHEN 'click' THEN 'final' WHEN 'error' THEN 'audio_gap' WHEN 'view' THEN 'partial' WHEN 'purchase' THEN 'config' ELSE 'flush' END AS type,
               CAST(json_extract(props, '$.k') AS BIGINT) AS k, value, CASE WHEN event_type = 'purchase' THEN CASE WHEN CAST(json_extract(props, '$.k') AS BIGINT) % 3 = 0 THEN 'en' ELSE 'nl' END END AS source_lang,
               CASE WHEN event_type = 'purchase' THEN CASE WHEN CAST(json_extract(props, '$.k') AS BIGINT) % 10 = 0 THEN 'names' ELSE '' END END AS prompt FROM events)"""


def pairs_of(spark, d) -> DataFrame:
    """Pairs of whole evaluation texts; a null text is empty."""
    items = _t(spark, d, "benchmark").select("item_id", text.evaluation_text(F.coalesce("text", F.lit(""))).alias("t"))
    nxt = items.select((F.col("item_id") - 1).alias("item_id"), F.col("t").alias("hypothesis"))
    return items.withColumnRenamed("t", "reference").join(nxt, "item_id")


# DuckDB has NFC only (the same for texts without compatibility characters), and an edit distance over bytes: letters
# of two bytes become capitals, which lower-cased texts do not have.
_EVALUATED = r"trim(regexp_replace(replace(lower(nfc_normalize(coalesce(text, ''))), '’', ''''), '[^\p{L}\p{N}_'']+', ' ', 'g'), ' ')"
_PAIRS = f"""items AS (SELECT item_id, {_EVALUATED} AS t FROM benchmark),
pairs AS (SELECT a.item_id, a.t AS reference, b.t AS hypothesis FROM items a JOIN items b ON b.item_id = a.item_id + 1)"""
_DISTANCE = "levenshtein(" + ", ".join(f"translate({{{side}}}, 'ßäçèéêíñóöüáàâëîïôùûú', 'ABCDEFGHIJKLMNOPQRSTU')" for side in "ab") + ")"
_BARE = {"a": "replace(reference, ' ', '')", "b": "replace(hypothesis, ' ', '')"}
_CER = f"CASE WHEN reference <> '' THEN {_DISTANCE.format(**_BARE)} / length({_BARE['a']}) WHEN hypothesis <> '' THEN 1 ELSE 0 END"


# Cues


def flagship(spark, d: str) -> DataFrame:
    return cues.as_srt(cues.normalized(cues.build(words_of(spark, d))))


@query()
def str4_build_cues(spark, d):
    return cues.normalized(cues.build(words_of(spark, d)))


@query()
def snk2_srt_of_words(spark, d):
    return flagship(spark, d)


@query(f"""WITH {_WORDS}, cut AS (SELECT *, CASE WHEN start_ms - lag(end_ms) OVER o >= 500 OR right(lag(word) OVER o, 1) IN ('.', '!', '?', '…') THEN 1 ELSE 0 END AS c FROM words WINDOW o AS (PARTITION BY client_id ORDER BY pos)),
numbered AS (SELECT client_id, sum(c) OVER (PARTITION BY client_id ORDER BY pos) AS island, start_ms, end_ms FROM cut)
SELECT client_id, CAST(island AS BIGINT) AS island, count(*) AS n, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM numbered GROUP BY ALL""")
def win9_islands(spark, d):
    found = cues.islands(words_of(spark, d)).groupBy("client_id", F.col("island").cast("bigint").alias("island"))
    return found.agg(F.count("*").alias("n"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))


_NORMAL = f"""WITH {_CUES}, numbered AS (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY ts, id) AS i, greatest(start_ms, 0) AS s FROM cues WHERE trim(text) <> ''),
ends AS (SELECT *, CAST(800 * i + max(greatest(s + 800, end_ms) - 800 * i) OVER (PARTITION BY client_id ORDER BY i) AS BIGINT) AS e FROM numbered),
normal AS (SELECT client_id, id, text, i, greatest(s, coalesce(lag(e) OVER (PARTITION BY client_id ORDER BY i), 0)) AS start_ms, e AS end_ms FROM ends)"""


def _normal(spark, d):
    return cues.normalized(cues_of(spark, d), order=("ts", "id"))


@query(f"{_NORMAL} SELECT client_id, id, start_ms, end_ms FROM normal")
def win4_non_overlap(spark, d):
    return _normal(spark, d).select("client_id", "id", "start_ms", "end_ms")


def _stamp(ms: str, sep: str) -> str:
    return f"printf('%02d:%02d:%02d{sep}%03d', {ms} // 3600000, ({ms} // 60000) % 60, ({ms} // 1000) % 60, {ms} % 1000)"


@query(f"""{_NORMAL} SELECT client_id, string_agg(i || chr(10) || {_stamp('start_ms', ',')} || ' --> ' || {_stamp('end_ms', ',')} || chr(10) || text || chr(10), chr(10) ORDER BY start_ms, i) AS srt FROM normal GROUP BY client_id""")
def snk2_srt(spark, d):
    return cues.as_srt(_normal(spark, d))


@query(f"""{_NORMAL} SELECT client_id, 'WEBVTT' || chr(10) || chr(10) || string_agg({_stamp('start_ms', '.')} || ' --> ' || {_stamp('end_ms', '.')} || chr(10) || text || chr(10), chr(10) ORDER BY start_ms, i) AS vtt FROM normal GROUP BY client_id""")
def snk3_vtt(spark, d):
    return cues.as_vtt(_normal(spark, d))


@query(f"""WITH {_CUES} SELECT client_id, string_agg('[' || printf('%02d:%02d.%03d', (start_ms // 60000) % 60, (start_ms // 1000) % 60, start_ms % 1000) || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY start_ms, id) AS txt FROM cues GROUP BY client_id""")
def snk4_txt(spark, d):
    block = F.concat(F.lit("["), text.short_timestamp(F.col("start_ms")), F.lit("]\n"), "text")
    blocks = F.array_sort(F.collect_list(F.struct("start_ms", "id", block.alias("block"))))
    return cues_of(spark, d).groupBy("client_id").agg(F.array_join(F.transform(blocks, lambda b: b["block"]), "\n\n").alias("txt"))


@query(f"""WITH {_CUES}, n AS (SELECT *, lead(start_ms) OVER (PARTITION BY client_id ORDER BY start_ms, id) AS nx FROM cues)
SELECT client_id, id, start_ms, CASE WHEN id % 2 = 0 THEN CASE WHEN nx IS NULL THEN start_ms + 3500 ELSE greatest(start_ms + 800, nx - 120) END ELSE end_ms END AS end_ms FROM n""")
def win3_provisional_end(spark, d):
    return cues.provisional_ends(cues_of(spark, d).withColumn("pending", F.col("id") % 2 == 0)).select("client_id", "id", "start_ms", "end_ms")


@query(f"WITH {_CUES} SELECT client_id, id, greatest(0, start_ms - 5000) AS start_ms, greatest(greatest(0, start_ms - 5000) + 1, end_ms - 5000) AS end_ms FROM cues WHERE trim(text) <> ''")
def flt1_valid_cues(spark, d):
    start = F.greatest(F.lit(0), F.col("start_ms") - 5000)
    return cues_of(spark, d).where(F.trim("text") != "").select("client_id", "id", start.alias("start_ms"), F.greatest(start + 1, F.col("end_ms") - 5000).alias("end_ms"))


@query(f"WITH {_CUES} SELECT client_id, id, row_number() OVER (PARTITION BY client_id ORDER BY start_ms, id) AS number FROM cues")
def win8_cue_index(spark, d):
    return cues_of(spark, d).select("client_id", "id", F.row_number().over(W.partitionBy("client_id").orderBy("start_ms", "id")).cast("bigint").alias("number"))


@query(f"WITH {_CUES}, r AS (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY start_ms DESC, id DESC) AS n FROM cues) SELECT client_id, id, n FROM r WHERE n <= 80")
def win10_visible_history(spark, d):
    ranked = cues_of(spark, d).withColumn("n", F.row_number().over(W.partitionBy("client_id").orderBy(F.desc("start_ms"), F.desc("id"))).cast("bigint"))
    return ranked.where("n <= 80").select("client_id", "id", "n")


@query("""WITH n AS (SELECT conv_id, turn, greatest(1, length(text)) * 60 AS ms FROM conversations), s AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS c, sum(ms) OVER (PARTITION BY conv_id) AS total, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM n)
SELECT conv_id, turn, CAST(i * greatest(800, total // c) AS BIGINT) AS start_ms, CAST((i + 1) * greatest(800, total // c) AS BIGINT) AS end_ms FROM s""")
def arr3_even_split(spark, d):
    by = W.partitionBy("conv_id")
    cut = _t(spark, d, "conversations").select("conv_id", "turn", (F.greatest(F.lit(1), F.length("text")).cast("bigint") * 60).alias("ms"))
    cut = cut.select("*", F.greatest(F.lit(800), F.floor(F.sum("ms").over(by) / F.count("*").over(by))).alias("slice"), (F.row_number().over(by.orderBy("turn")) - 1).cast("bigint").alias("i"))
    return cut.select("conv_id", "turn", (F.col("i") * F.col("slice")).alias("start_ms"), ((F.col("i") + 1) * F.col("slice")).alias("end_ms"))


# Text


def _normal_sql(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(regexp_replace({x}, '[\s\x0B\p{{Z}}]+', ' ', 'g'), ' +([,.;:!?])', '\1', 'g'), '([¿¡]) +', '\1', 'g'), ' ')"


@query(f"SELECT doc_id, {_normal_sql('text')} AS normal FROM documents")
def strf1_normalize(spark, d):
    return _t(spark, d, "documents").select("doc_id", text.normalize(F.col("text")).alias("normal"))


@query(rf"SELECT doc_id, {_normal_sql(r'''regexp_replace(regexp_replace(N, 'the', 'THE', 'gi'), 'on(ti|th)', '\1on', 'gi')''').replace('N,', _normal_sql('text') + ',')} AS corrected FROM documents")
def strf2_glossary(spark, d):
    return _t(spark, d, "documents").select("doc_id", text.correct(F.col("text"), [("the", "THE"), ("on(ti|th)", "$1on")]).alias("corrected"))


_WORD_SQL, _MARKS_SQL = text.WORD.replace("'", "''"), text.MARKS.replace("'", "''")


@query(f"SELECT doc_id, CAST(len(regexp_extract_all(text, '{_WORD_SQL}')) AS BIGINT) AS n FROM documents")
def strf3_word_count(spark, d):
    return _t(spark, d, "documents").select("doc_id", text.word_count(F.col("text")).cast("bigint").alias("n"))


_SENTENCES = r"""split AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?…]["”’)\]]*)[WHITE]+', '\1' || chr(1), 'g'), chr(1)) AS s FROM documents),
sentences AS (SELECT doc_id, CAST(i AS BIGINT) AS i, s[i + 1] AS sentence FROM (SELECT doc_id, list_filter(s, lambda x: regexp_matches(x, '[^WHITE]')) AS s, unnest(range(len(list_filter(s, lambda x: regexp_matches(x, '[^WHITE]'))))) AS i FROM split))""".replace("WHITE", text.WHITE)


def sentences_of(spark, d) -> DataFrame:
    """The sentences of every document."""
    return _t(spark, d, "documents").select("doc_id", F.posexplode(text.sentences(F.col("text"))).alias("i", "sentence")).withColumn("i", F.col("i").cast("bigint"))


@query(f"WITH {_SENTENCES} SELECT * FROM sentences")
def strf4_sentences(spark, d):
    return sentences_of(spark, d)


@query(f"WITH {_SENTENCES} SELECT doc_id, i, CASE WHEN right(sentence, 1) IN ('.', '!', '?', '…') THEN sentence ELSE sentence || '.' END AS finished FROM sentences")
def strf5_finish(spark, d):
    return sentences_of(spark, d).select("doc_id", "i", text.finish(F.col("sentence")).alias("finished"))


_FILL = "(" + ", ".join(f"'{w}'" for w in text.FILLERS) + ")"
_CONN = "(" + ", ".join(f"'{w}'" for w in text.CONNECTORS) + ")"
_IS_FILLER = rf"trim(regexp_replace(lower({_normal_sql('sentence')}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' ') IN {_FILL}"


@query(f"WITH {_SENTENCES} SELECT doc_id, i, {_IS_FILLER} AS filler FROM sentences")
def flt6_filler_only(spark, d):
    return sentences_of(spark, d).select("doc_id", "i", text.filler_only(F.col("sentence")).alias("filler"))


@query(rf"""WITH {_SENTENCES} SELECT doc_id, i, sentence FROM sentences WHERE NOT (trim(sentence, ' ') = '' OR {_IS_FILLER}
OR (len(regexp_extract_all(sentence, '{_WORD_SQL}')) < 3 AND right(trim(sentence, ' '), 1) NOT IN ('?', '!')))""")
def flt7_should_drop(spark, d):
    return sentences_of(spark, d).where(~text.should_drop(F.col("sentence")))


@query(rf"WITH {_SENTENCES} SELECT doc_id, i, coalesce(regexp_replace(regexp_extract_all(lower(sentence), '{_WORD_SQL}')[-1], '^[{_MARKS_SQL}]+|[{_MARKS_SQL}]+$', '', 'g') IN {_CONN}, false) AS waits FROM sentences")
def flt8_connector(spark, d):
    return sentences_of(spark, d).select("doc_id", "i", text.ends_with_connector(F.col("sentence")).alias("waits"))


def _overlap_sql(most: int) -> str:
    """k: the longest end of list a that list b begins with, in lower case."""
    low = {x: f"list_transform({x}, lambda w: lower(w))" for x in "ab"}
    return f"list_max(list_filter(range(0, least(len(a), len(b), {most}) + 1), lambda k: k = 0 OR ({low['a']})[len(a) - k + 1:] = ({low['b']})[:k])) AS k"


def _plain_sql(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{text.WHITE}]+', ' ', 'g'), ' ')"


_MERGED_SQL = "CASE WHEN k > 0 THEN array_to_string(list_concat(a, b[k + 1:]), ' ') WHEN length(n) > length(p) THEN n ELSE p END AS merged"


def _words_sql(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> '')"


@query(f"""WITH {_SENTENCES}, n AS (SELECT a.doc_id, a.i, {_plain_sql('a.sentence')} AS l, {_plain_sql('b.sentence')} AS r FROM sentences a JOIN sentences b ON a.doc_id = b.doc_id AND b.i = a.i + 1),
w AS (SELECT *, string_split(l, ' ') AS a, string_split(r, ' ') AS b FROM n), k AS (SELECT *, {_overlap_sql(8)} FROM w)
SELECT doc_id, i, CASE WHEN ends_with(l, r) THEN l ELSE trim(concat_ws(' ', l, array_to_string(b[k + 1:], ' ')), ' ') END AS joined FROM k""")
def strf6_join_overlap(spark, d):
    own = sentences_of(spark, d)
    nxt = own.select("doc_id", (F.col("i") - 1).alias("i"), F.col("sentence").alias("following"))
    return own.join(nxt, ["doc_id", "i"]).select("doc_id", "i", text.join_overlap(F.col("sentence"), F.col("following")).alias("joined"))


@query(f"""WITH {_SENTENCES}, q AS (SELECT doc_id, i, trim(regexp_replace(coalesce(lag(sentence) OVER (PARTITION BY doc_id ORDER BY i), ''), '\\s+', ' ', 'g'), ' ') AS p, trim(regexp_replace(sentence, '\\s+', ' ', 'g'), ' ') AS n FROM sentences),
w AS (SELECT *, {_words_sql('p')} AS a, {_words_sql('n')} AS b FROM q), k AS (SELECT *, {_overlap_sql(10)} FROM w), m AS (SELECT *, {_MERGED_SQL} FROM k)
SELECT doc_id, i, CASE WHEN n = '' THEN p WHEN p = '' THEN n WHEN lower(n) = lower(p) THEN p WHEN starts_with(lower(n), lower(p)) THEN n WHEN contains(lower(p), lower(n)) AND length(n) + 10 < length(p) THEN p
WHEN length(n) < length(p) * 0.72::DOUBLE AND right(p, 1) NOT IN ('.', '?', '!') THEN p WHEN length(merged) >= greatest(length(p), length(n)) - 4 THEN merged ELSE n END AS shown FROM m""")
def strf8_stabilize(spark, d):
    before = F.lag("sentence").over(W.partitionBy("doc_id").orderBy("i"))
    return sentences_of(spark, d).select("doc_id", "i", text.stabilize(before, F.col("sentence")).alias("shown"))


@query(r"SELECT doc_id, CAST(len(r) AS BIGINT) AS n_runs, array_to_string(r, '') = text AS lossless FROM (SELECT doc_id, text, regexp_extract_all(text, '[\p{L}\p{N}''’-]+|[^\p{L}\p{N}''’-]+') AS r FROM documents)")
def strf9_runs(spark, d):
    return _t(spark, d, "documents").withColumn("r", text.runs(F.col("text"))).select("doc_id", F.size("r").cast("bigint").alias("n_runs"), (F.array_join("r", "") == F.col("text")).alias("lossless"))


@query(f"SELECT item_id, {_EVALUATED} AS normal FROM benchmark")
def strf10_evaluation_text(spark, d):
    return _t(spark, d, "benchmark").select("item_id", text.evaluation_text(F.coalesce("text", F.lit(""))).alias("normal"))


@query(f"WITH {_CUES} SELECT id, {_stamp('start_ms', ',')} AS srt, {_stamp('start_ms', '.')} AS vtt FROM cues")
def strf11_timestamp(spark, d):
    return cues_of(spark, d).select("id", text.timestamp(F.col("start_ms")).alias("srt"), text.timestamp(F.col("start_ms"), ".").alias("vtt"))


_LANG_ROWS = text.LANGUAGES
_LANG_VALUES = ", ".join(f"('{c}', '{n}', '{f}')" for c, n, f in _LANG_ROWS)
_LANGS = f"languages(code, name, flores) AS (VALUES {_LANG_VALUES})"


def languages_of(spark) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {_LANG_VALUES} AS t(code, name, flores)")


@query(f"WITH {_LANGS} SELECT doc_id, coalesce(name, upper(lang)) AS language, flores FROM documents LEFT JOIN languages ON lower(trim(lang)) = code")
def jn9_language_names(spark, d):
    docs = _t(spark, d, "documents").withColumn("code", F.lower(F.trim("lang")))
    return docs.join(F.broadcast(languages_of(spark)), "code", "left").select("doc_id", F.coalesce("name", F.upper("lang")).alias("language"), "flores")  # a fixed list of 20


@query(f"WITH {_LANGS} SELECT code, name, flores, count(doc_id) AS n_documents FROM languages LEFT JOIN documents ON lang = code GROUP BY ALL")
def src10_language_catalog(spark, d):
    counts = _t(spark, d, "documents").groupBy(F.col("lang").alias("code")).agg(F.count("doc_id").alias("n_documents"))
    return languages_of(spark).join(counts, "code", "left").select("code", "name", "flores", F.coalesce("n_documents", F.lit(0)).alias("n_documents"))


@query(f"WITH {_LANGS} SELECT DISTINCT lang AS source, code AS target FROM documents JOIN languages ON code <> lang")
def flt14_allowed_targets(spark, d):
    codes = F.array(*[F.lit(c) for c, _, _ in _LANG_ROWS])
    return _t(spark, d, "documents").select(F.col("lang").alias("source")).distinct().select("source", F.explode(F.array_remove(codes, F.col("source"))).alias("target"))


@query("SELECT doc_id, CASE WHEN lower(trim(lang)) IN ('en', 'de') THEN lower(trim(lang)) ELSE 'nl' END AS language FROM documents")
def strf12_language(spark, d):
    code = F.lower(F.trim("lang"))
    return _t(spark, d, "documents").select("doc_id", F.when(code.isin("en", "de"), code).otherwise("nl").alias("language"))


@query(f"WITH {_REQUESTS} SELECT request_id, cache_key FROM requests")
def strf13_cache_key(spark, d):
    return requests_of(spark, d).select("request_id", "cache_key")


@query("""SELECT item_id, CASE WHEN l LIKE '%model not found%' OR l LIKE '%no such file%' THEN 'model_missing' WHEN l LIKE '%cuda%' OR l LIKE '%cudnn%' OR l LIKE '%cublas%' THEN 'cuda_unavailable'
WHEN l LIKE '%ctranslate2%' OR l LIKE '%translation%' THEN 'translation_runtime_error' WHEN l LIKE '%whisper%' OR l LIKE '%asr%' OR l LIKE '%transcrib%' THEN 'asr_runtime_error' ELSE 'runtime_error' END AS class FROM (SELECT doc_id AS item_id, lower(text) AS l FROM documents)""")
def strf14_error_class(spark, d):
    return _t(spark, d, "documents").select(F.col("doc_id").alias("item_id"), text.error_class(F.col("text")).alias("class"))


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN trim(text, ' ') ELSE trim(text, ' ') || chr(10) || upper(role) END AS body FROM conversations")
def strf15_cue_body(spark, d):
    return _t(spark, d, "conversations").select("conv_id", "turn", text.cue_body(F.col("text"), F.when(F.col("turn") % 3 == 0, "").otherwise(F.upper("role"))).alias("body"))


@query("SELECT doc_id FROM documents WHERE contains(lower(concat_ws(' ', text, source)), 'the')")
def flt11_search(spark, d):
    return _t(spark, d, "documents").where(F.lower(F.concat_ws(" ", "text", "source")).contains("the")).select("doc_id")


@query("SELECT doc_id, CASE WHEN length(text) > 180 THEN left(text, 180) || '…' ELSE text END AS preview FROM documents")
def prj4_preview(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.when(F.length("text") > 180, F.concat(F.left("text", F.lit(180)), F.lit("…"))).otherwise(F.col("text")).alias("preview"))


@query("SELECT event_id, left(event_type || ' | user=' || user_id || ' | k=' || CAST(json_extract(props, '$.k') AS VARCHAR), 600) AS line FROM events")
def snk6_log_line(spark, d):
    k = F.from_json("props", "k int")["k"].cast("string")
    return _t(spark, d, "events").select("event_id", F.left(F.concat_ws(" | ", "event_type", F.concat(F.lit("user="), F.col("user_id").cast("string")), F.concat(F.lit("k="), k)), F.lit(600)).alias("line"))


# Messages and state numbers


@query(f"WITH {_MESSAGES} SELECT client_id, seq, type, k FROM messages")
def src1_messages(spark, d):
    return messages_of(spark, d).select("client_id", "seq", "type", "k")


_EPOCHS = f"""WITH {_MESSAGES}, judged AS (SELECT *, source_lang || '|' || prompt <> coalesce(last_value(source_lang || '|' || prompt IGNORE NULLS) OVER (PARTITION BY client_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'nl|') AS changed FROM messages),
numbered AS (SELECT *, count(*) FILTER (type = 'audio_gap' OR (type = 'config' AND changed)) OVER o AS epoch, count(*) FILTER (type IN ('final', 'audio_gap', 'flush')) OVER o AS generation FROM judged WINDOW o AS (PARTITION BY client_id ORDER BY seq))"""


@query(f"{_EPOCHS} SELECT client_id, seq, epoch, generation FROM numbered")
def win6_epochs(spark, d):
    return sessions.epochs(messages_of(spark, d), ["seq"]).select("client_id", "seq", "epoch", "generation")


def jobs_of(spark, d, kind: str) -> DataFrame:
    """Jobs of one kind: their epoch and generation when they begin, and those of the session when they complete, 20 k messages later."""
    states = sessions.epochs(messages_of(spark, d), ["seq"])
    jobs = states.where(F.col("type") == kind).select("client_id", F.col("seq").alias("begun"), "k", "epoch", "generation", (F.col("seq") + F.col("k") * 20).alias("at"))
    return transcripts.as_of(jobs, states.select("client_id", F.col("seq").alias("at"), "epoch", "generation"), "client_id", "at", ["epoch", "generation"])


_JOBS = f"""{_EPOCHS}, jobs AS (SELECT client_id, seq AS begun, type, k, epoch, generation, seq + k * 20 AS at FROM numbered),
completed AS (SELECT j.*, n.epoch AS state_epoch, n.generation AS state_generation FROM jobs j ASOF JOIN numbered n ON j.client_id = n.client_id AND j.at >= n.seq)"""


@query(f"{_JOBS} SELECT client_id, begun AS seq, epoch FROM completed WHERE type = 'final' AND epoch = state_epoch")
def flt9_stale_epoch(spark, d):
    """Final results whose epoch is still the session's when they complete."""
    return jobs_of(spark, d, "final").where("epoch = state_epoch").select("client_id", F.col("begun").alias("seq"), "epoch")


@query(f"{_JOBS} SELECT client_id, begun AS seq, generation FROM completed WHERE type = 'partial' AND k % 10 <> 0 AND generation = state_generation")
def flt10_stale_partial(spark, d):
    """Partial results with a text (here: one in ten has none) and of the generation that is current when they complete."""
    return jobs_of(spark, d, "partial").where("k % 10 <> 0 AND generation = state_generation").select("client_id", F.col("begun").alias("seq"), "generation")


@query(f"""{_EPOCHS} SELECT client_id, epoch, count(*) AS n, max(generation) AS generation, CAST(sum(CASE WHEN type = 'audio_gap' THEN greatest(0, k) ELSE 0 END) AS BIGINT) AS gap FROM numbered GROUP BY ALL""")
def str7_epoch_reset(spark, d):
    return sessions.epochs(messages_of(spark, d), ["seq"]).groupBy("client_id", "epoch").agg(F.count("*").alias("n"), F.max("generation").alias("generation"), F.sum(F.when(F.col("type") == "audio_gap", F.greatest(F.lit(0), F.col("k"))).otherwise(0)).alias("gap"))


@query(f"""WITH {_MESSAGES}, c AS (SELECT *, sum(k) OVER o AS captured, sum(CASE WHEN type = 'final' THEN k ELSE 0 END) OVER o AS done FROM messages WINDOW o AS (PARTITION BY client_id ORDER BY seq)),
s AS (SELECT *, done + greatest(0, max(CASE WHEN type IN ('final', 'audio_gap') THEN captured - done END) OVER (PARTITION BY client_id ORDER BY seq)) AS clock FROM c)
SELECT client_id, seq, CAST(clock - k AS BIGINT) AS start_at FROM s WHERE type = 'final'""")
def win5_capture_timeline(spark, d):
    by = W.partitionBy("client_id").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    m = messages_of(spark, d).withColumns({"captured": F.sum("k").over(by), "done": F.sum(F.when(F.col("type") == "final", F.col("k")).otherwise(0)).over(by)})
    ahead = F.max(F.when(F.col("type").isin("final", "audio_gap"), F.col("captured") - F.col("done"))).over(by)
    return m.withColumn("clock", F.col("done") + F.greatest(F.lit(0), ahead)).where("type = 'final'").select("client_id", "seq", (F.col("clock") - F.col("k")).alias("start_at"))


@query(f"""WITH {_MESSAGES} SELECT client_id, seq, type, coalesce(lag(type) OVER (PARTITION BY client_id ORDER BY seq) || '>' || type IN ('partial>final', 'final>partial', 'flush>partial', 'config>partial'), true) AS valid FROM messages""")
def win11_transitions(spark, d):
    was = F.lag("type").over(W.partitionBy("client_id").orderBy("seq"))
    return messages_of(spark, d).select("client_id", "seq", "type", F.coalesce(F.concat(was, F.lit(">"), "type").isin("partial>final", "final>partial", "flush>partial", "config>partial"), F.lit(True)).alias("valid"))


@query(f"""WITH {_MESSAGES} SELECT client_id, seq, max(CASE WHEN value / 10 > 1.2 THEN 1 ELSE 0 END) OVER (PARTITION BY client_id ORDER BY seq) = 1 AS degraded FROM messages""")
def str10_degrade(spark, d):
    by = W.partitionBy("client_id").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    return messages_of(spark, d).select("client_id", "seq", F.max(F.col("value") / 10 > 1.2).over(by).alias("degraded"))


@query("""WITH g AS (SELECT user_id AS client_id, event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events WHERE value >= 15)
SELECT client_id, event_id, was IS NULL AS initial FROM g WHERE was IS NULL OR ts - was > INTERVAL 6 HOUR""")
def str9_silence(spark, d):
    loud = _t(spark, d, "events").where("value >= 15").withColumn("was", F.lag("ts").over(W.partitionBy("user_id").orderBy("ts", "event_id")))
    return loud.where("was IS NULL OR ts - was > INTERVAL 6 HOURS").select(F.col("user_id").alias("client_id"), "event_id", F.col("was").isNull().alias("initial"))


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS c FROM events), s AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM g)
SELECT user_id AS client_id, CAST(n AS BIGINT) AS session, count(*) AS events, min(event_id) AS first_event FROM s GROUP BY ALL""")
def str14_gap_sessions(spark, d):
    by = W.partitionBy("user_id").orderBy("ts", "event_id")
    cut = F.coalesce((F.col("ts") - F.lag("ts").over(by) > F.expr("INTERVAL 6 HOURS")).cast("int"), F.lit(0))
    numbered = _t(spark, d, "events").withColumn("cut", cut).withColumn("session", F.sum("cut").over(by.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(F.col("user_id").alias("client_id"), F.col("session").cast("bigint").alias("session")).agg(F.count("*").alias("events"), F.min("event_id").alias("first_event"))


@query(f"""WITH {_MESSAGES} SELECT client_id, count(*) AS messages, count(*) FILTER (type = 'final') AS finals, count(*) FILTER (type = 'partial') AS partials, count(*) FILTER (type = 'audio_gap') AS gaps, max(k) AS most FROM messages GROUP BY client_id""")
def agg3_counters(spark, d):
    m = messages_of(spark, d)
    return m.groupBy("client_id").agg(F.count("*").alias("messages"), *[F.count_if(F.col("type") == t).alias(n) for t, n in (("final", "finals"), ("partial", "partials"), ("audio_gap", "gaps"))], F.max("k").alias("most"))


@query("SELECT user_id AS client_id, date_trunc('hour', ts) AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def str13_hourly_metrics(spark, d):
    return _t(spark, d, "events").groupBy(F.col("user_id").alias("client_id"), F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(f"""WITH {_MESSAGES}, p AS (SELECT * FROM messages WHERE type = 'partial'), f AS (SELECT * FROM messages WHERE type = 'final')
SELECT coalesce(f.client_id, p.client_id) AS client_id, coalesce(f.k, p.k) AS k, count(*) AS n, count(p.seq) AS pending, count(f.seq) AS final FROM p FULL JOIN f ON p.client_id = f.client_id AND p.k = f.k GROUP BY 1, 2""")
def jn5_reconcile(spark, d):
    """The numbers of pairs of a pending and a final message with one id, without making the pairs."""
    m = messages_of(spark, d).where("type IN ('partial', 'final')")
    counts = m.groupBy("client_id", "k").agg(F.count_if(F.col("type") == "partial").alias("p"), F.count_if(F.col("type") == "final").alias("f"))
    pairs = F.greatest("p", F.lit(1)) * F.greatest("f", F.lit(1))
    return counts.select("client_id", "k", pairs.alias("n"), F.when(F.col("p") > 0, pairs).otherwise(0).alias("pending"), F.when(F.col("f") > 0, pairs).otherwise(0).alias("final"))


def transcript_of(messages: DataFrame) -> DataFrame:
    """Partial and final messages as transcript messages with gaps in what they tell."""
    seq, final = F.col("seq"), F.col("type") == "final"
    told = F.when(final & (seq % 2 == 0), seq * 100)
    return messages.where("type IN ('partial', 'final')").select(
        "client_id", "seq", F.when(final, "final").otherwise("pending").alias("kind"), F.col("k").alias("id"), (seq * 100).alias("at_ms"),
        F.when(~final, F.concat(F.lit("said "), seq)).when(seq % 3 == 1, "").when(seq % 3 == 2, F.concat(F.lit("heard "), seq)).alias("source_text"), F.when(final & (seq % 4 != 0), F.concat(F.lit("t"), seq)).alias("translation"),
        F.when(seq % 5 == 0, "en").alias("source_lang"), F.when(seq % 7 == 0, "de").alias("target_lang"), F.when(seq % 6 == 0, "fast").alias("mode"), (told - 50).alias("start_ms"), (told + 1000).alias("end_ms"),
    )


def _last_sql(column: str, more: str = "true") -> str:
    return f"arg_max({column}, seq) FILTER (nullif({column}, '') IS NOT NULL AND {more})"


_MERGED = f"""WITH {_MESSAGES}, m AS (SELECT client_id, seq, type = 'final' AS final, k AS id, seq * 100 AS at_ms, CASE WHEN type = 'partial' THEN 'said ' || seq WHEN seq % 3 = 1 THEN '' WHEN seq % 3 = 2 THEN 'heard ' || seq END AS source_text,
  CASE WHEN type = 'final' AND seq % 4 <> 0 THEN 't' || seq END AS translation, CASE WHEN seq % 5 = 0 THEN 'en' END AS source_lang, CASE WHEN seq % 7 = 0 THEN 'de' END AS target_lang, CASE WHEN seq % 6 = 0 THEN 'fast' END AS mode,
  CASE WHEN type = 'final' AND seq % 2 = 0 THEN seq * 100 - 50 END AS start_ms, CASE WHEN type = 'final' AND seq % 2 = 0 THEN seq * 100 + 1000 END AS end_ms FROM messages WHERE type IN ('partial', 'final')),
n AS (SELECT *, count(*) FILTER (NOT final) OVER (PARTITION BY client_id, id ORDER BY seq) AS item FROM m),
i AS (SELECT client_id, id, item, min(seq) AS opened, arg_min(at_ms, seq) AS at_ms, min(seq) FILTER (final) AS first_final, arg_max(start_ms, seq) FILTER (start_ms IS NOT NULL) AS told_start, arg_max(end_ms, seq) FILTER (end_ms IS NOT NULL) AS told_end,
  {_last_sql('source_text')} AS source_text, {_last_sql('translation', 'final')} AS translation, {_last_sql('source_lang')} AS source_lang, {_last_sql('target_lang')} AS target_lang, {_last_sql('mode')} AS mode FROM n GROUP BY client_id, id, item),
s AS (SELECT *, lead(at_ms) OVER o AS following, lead(opened) OVER o AS opens FROM i WINDOW o AS (PARTITION BY client_id ORDER BY opened))
SELECT client_id, id, item, coalesce(told_start, at_ms) AS start_ms, coalesce(told_end, CASE WHEN opens IS NOT NULL AND coalesce(first_final > opens, true) THEN greatest(at_ms + 800, following - 120) ELSE at_ms + 3500 END) AS end_ms, coalesce(source_text, '') AS source_text,
  CASE WHEN first_final IS NULL THEN '' ELSE coalesce(translation, 'Translation unavailable') END AS translation, coalesce(source_lang, 'nl') AS source_lang, coalesce(target_lang, 'en') AS target_lang, coalesce(mode, 'balanced') AS mode, first_final IS NULL AS pending FROM s"""


@query(_MERGED)
def jn5_merged_rows(spark, d):
    return transcripts.merged(transcript_of(messages_of(spark, d)))


# Histories


@query(f"""WITH {_SESSIONS}, {_SUBTITLES}, latest AS (SELECT * FROM sessions ORDER BY updated_at DESC, client_id LIMIT 50)
SELECT client_id, started_at, updated_at, (SELECT count(*) FROM subtitles s WHERE s.client_id = latest.client_id) AS n_subtitles FROM latest""")
def jn1_recent_sessions(spark, d):
    return sessions.recent(sessions_of(spark, d), subtitles_of(spark, d))


@query(f"WITH {_SUBTITLES} SELECT client_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY created_at, id) AS ids, count(*) AS n FROM subtitles GROUP BY client_id")
def jn2_session_detail(spark, d):
    ordered = F.array_sort(F.collect_list(F.struct("created_at", "id")))
    joined = sessions_of(spark, d).join(subtitles_of(spark, d), "client_id")
    return joined.groupBy("client_id").agg(F.array_join(F.transform(ordered, lambda x: x["id"].cast("string")), ",").alias("ids"), F.count("*").alias("n"))


@query(f"WITH {_SUBTITLES} SELECT id, client_id FROM subtitles WHERE client_id NOT IN (SELECT client_id FROM subtitles WHERE latency_ms > 1500)")
def jn3_cascade_delete(spark, d):
    subs = subtitles_of(spark, d)
    return sessions.delete(subs, subs.where("latency_ms > 1500").select("client_id").distinct(), "client_id").select("id", "client_id")


@query(f"""WITH {_SESSIONS}, new AS (SELECT user_id AS client_id, max(ts) AS started_at, max(ts) + INTERVAL 1 DAY AS updated_at FROM events WHERE event_type = 'click' GROUP BY 1)
SELECT coalesce(s.client_id, n.client_id) AS client_id, coalesce(s.started_at, n.started_at) AS started_at, coalesce(n.updated_at, s.updated_at) AS updated_at FROM sessions s FULL JOIN new n USING (client_id)""")
def jn6_upsert(spark, d):
    clicks = _t(spark, d, "events").where("event_type = 'click'")
    new = clicks.groupBy(F.col("user_id").alias("client_id")).agg(F.max("ts").alias("started_at"), (F.max("ts") + F.expr("INTERVAL 1 DAY")).alias("updated_at"))
    return sessions.upsert(sessions_of(spark, d), new, ["client_id"], keep_old=("started_at",))


@query(f"WITH {_SUBTITLES} SELECT client_id, source, id FROM (SELECT *, row_number() OVER (PARTITION BY client_id, source ORDER BY created_at DESC, id DESC) AS n FROM subtitles) WHERE n = 1")
def snk1_latest_wins(spark, d):
    return sessions.latest(subtitles_of(spark, d), ["client_id", "source"], [F.desc("created_at"), F.desc("id")]).select("client_id", "source", "id")


@query("SELECT doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM documents e WHERE e.doc_id < d.doc_id AND lower(trim(e.text, ' ')) = lower(trim(d.text, ' ')) AND e.lang = d.lang)")
def jn10_duplicates(spark, d):
    docs = _t(spark, d, "documents").withColumn("key", F.lower(F.trim("text")))
    first = docs.groupBy("key", "lang").agg(F.min("doc_id").alias("first"))
    return docs.join(first, ["key", "lang"]).where("doc_id > first").select("doc_id")


@query(f"WITH {_SESSIONS} SELECT client_id, updated_at FROM sessions ORDER BY updated_at DESC, client_id LIMIT 50")
def srt4_recent_50(spark, d):
    return sessions_of(spark, d).select("client_id", "updated_at").orderBy(F.desc("updated_at"), "client_id").limit(50)


@query("SELECT event_id, event_type FROM (SELECT * FROM events ORDER BY event_id DESC LIMIT 200)")
def src8_log_tail(spark, d):
    return _t(spark, d, "events").orderBy(F.desc("event_id")).limit(200).select("event_id", "event_type")


# Translation reuse


@query(f"""WITH {_REQUESTS}
SELECT request_id, o.cache_key, CASE WHEN plain = '' THEN '' WHEN source = target THEN plain ELSE coalesce(c.translation, md5(plain || '#')) END AS translation,
CASE WHEN plain = '' THEN 'blank' WHEN source = target THEN 'identity' WHEN c.cache_key IS NULL THEN 'scored' ELSE 'cache' END AS origin FROM requests o LEFT JOIN cache c USING (cache_key)""")
def jn4_translate(spark, d):
    return sessions.translate(requests_of(spark, d), cache_of(spark, d), lambda t: F.md5(F.concat(t, F.lit("#"))))


@query(f"WITH {_REQUESTS} SELECT count(*) AS lookups, count(c.cache_key) AS hits, round(count(c.cache_key) / count(*), 6) AS ratio FROM requests o LEFT JOIN cache c USING (cache_key)")
def agg7_cache_stats(spark, d):
    got = requests_of(spark, d).join(cache_of(spark, d).select("cache_key", F.lit(1).alias("hit")), "cache_key", "left")
    return got.agg(F.count("*").alias("lookups"), F.count("hit").alias("hits"), F.round(F.count("hit") / F.count("*"), 6).alias("ratio"))


@query(f"WITH {_REQUESTS} SELECT count(*) AS requests, count(DISTINCT cache_key) AS keys FROM requests")
def agg15_distinct_keys(spark, d):
    return requests_of(spark, d).agg(F.count("*").alias("requests"), F.countDistinct("cache_key").alias("keys"))


@query(f"WITH {_REQUESTS} SELECT cache_key FROM cache WHERE (SELECT max(last_access) FROM cache) - last_access < 500")
def set2_ttl(spark, d):
    cache = cache_of(spark, d)
    now = cache.agg(F.max("last_access")).scalar()
    return cache.where(now - F.col("last_access") < 500).select("cache_key")


@query(f"WITH {_REQUESTS} SELECT cache_key FROM cache ORDER BY last_access DESC, cache_key DESC LIMIT 300")
def win2_lru(spark, d):
    return cache_of(spark, d).orderBy(F.desc("last_access"), F.desc("cache_key")).limit(300).select("cache_key")


@query(f"""WITH {_REQUESTS}, h AS (SELECT cache_key, max(request_id) AS latest, count(*) AS n FROM requests GROUP BY 1)
SELECT c.cache_key, greatest(last_access, coalesce(latest, last_access)) AS last_access, hit_count + coalesce(n, 0) AS hit_count FROM cache c LEFT JOIN h USING (cache_key)""")
def jn11_access_stats(spark, d):
    hits = requests_of(spark, d).groupBy("cache_key").agg(F.max("request_id").alias("at"), F.count("*").alias("n"))
    joined = cache_of(spark, d).join(hits, "cache_key", "left")
    return joined.select("cache_key", F.greatest("last_access", F.coalesce("at", "last_access")).alias("last_access"), (F.col("hit_count") + F.coalesce("n", F.lit(0))).alias("hit_count"))


# Metrics


@query("SELECT user_id, event_type, count(value) AS n, CAST(round(CAST(quantile_cont(value, 0.5) AS DECIMAL(18, 9)), 3) AS DOUBLE) AS median, CAST(round(CAST(quantile_cont(value, 0.95) AS DECIMAL(18, 9)), 3) AS DOUBLE) AS p95, CAST(round(CAST(max(value) AS DECIMAL(18, 9)), 3) AS DOUBLE) AS most FROM events GROUP BY ALL")
def agg1_summary(spark, d):
    return sessions.summary_of_any_size(_t(spark, d, "events"), ["user_id", "event_type"])


@query("SELECT 'all' AS series, count(value) AS n, CAST(round(CAST(quantile_cont(value, 0.5) AS DECIMAL(18, 9)), 3) AS DOUBLE) AS median, CAST(round(CAST(quantile_cont(value, 0.95) AS DECIMAL(18, 9)), 3) AS DOUBLE) AS p95, CAST(round(CAST(max(value) AS DECIMAL(18, 9)), 3) AS DOUBLE) AS most FROM events")
def agg1_hot_series(spark, d):
    """One series with all rows."""
    return sessions.summary_of_any_size(_t(spark, d, "events").withColumn("series", F.lit("all")), ["series"])


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS i FROM events)
SELECT user_id, count(value) AS n, CAST(round(CAST(quantile_cont(value, 0.5) AS DECIMAL(18, 9)), 3) AS DOUBLE) AS median, CAST(round(CAST(quantile_cont(value, 0.95) AS DECIMAL(18, 9)), 3) AS DOUBLE) AS p95, CAST(round(CAST(max(value) AS DECIMAL(18, 9)), 3) AS DOUBLE) AS most FROM r WHERE i <= 20 GROUP BY ALL""")
def win1_recent_samples(spark, d):
    return sessions.summary(sessions.recent_samples(_t(spark, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 20), ["user_id"])


@query("SELECT user_id, max(value) < 90 AS accepted FROM events GROUP BY user_id")
def flt13_threshold(spark, d):
    return _t(spark, d, "events").groupBy("user_id").agg((F.max("value") < 90).alias("accepted"))


@query("""WITH s AS (SELECT user_id, CAST(ts AS DATE) AS day, max(CAST(json_extract(props, '$.k') AS INTEGER) / 100.0::DOUBLE) AS a, avg(-value / 100) AS b, max(value / 20) AS c FROM events GROUP BY 1, 2)
SELECT user_id, day, CASE WHEN a >= 0.75 OR b <= -1.2 OR c >= 2.4 THEN 'low' WHEN a >= 0.55 OR b <= -0.85 THEN 'watch' ELSE 'good' END AS level FROM s""")
def agg5_quality(spark, d):
    k = F.from_json("props", "k int")["k"]
    seg = _t(spark, d, "events").select("user_id", F.to_date("ts").alias("day"), (k / F.lit(100.0)).alias("no_speech"), (-F.col("value") / 100).alias("avg_logprob"), (F.col("value") / 20).alias("compression"))
    return sessions.quality_level(seg, ["user_id", "day"]).select("user_id", "day", "level")


@query("SELECT conv_id, string_agg(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g'), ' '), ' ' ORDER BY turn) AS whole FROM conversations WHERE trim(text) <> '' GROUP BY conv_id")
def agg6_reconstruct(spark, d):
    plain = F.trim(F.regexp_replace("text", "[ \t\n\r]+", " "))
    ordered = F.array_sort(F.collect_list(F.struct("turn", plain.alias("plain"))))
    return _t(spark, d, "conversations").where(F.trim("text") != "").groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x["plain"]), " ").alias("whole"))


@query("SELECT event_type AS reason, count(*) AS n FROM events GROUP BY 1")
def agg10_reasons(spark, d):
    return _t(spark, d, "events").groupBy(F.col("event_type").alias("reason")).agg(F.count("*").alias("n"))


@query("""SELECT user_id, count(*) AS jobs, round(count(*) / greatest(1, date_diff('second', min(ts), max(ts))) * 60, 6) AS per_minute, round(sum(value), 4) AS total FROM events GROUP BY 1""")
def agg11_throughput(spark, d):
    seconds = F.unix_timestamp(F.date_trunc("second", F.max("ts").cast("timestamp"))) - F.unix_timestamp(F.date_trunc("second", F.min("ts").cast("timestamp")))
    return _t(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("jobs"), F.round(F.count("*") / F.greatest(F.lit(1), seconds) * 60, 6).alias("per_minute"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM benchmark) AS pairs")
def agg14_corpus_counts(spark, d):
    return _t(spark, d, "documents").agg(F.count("*").alias("documents")).withColumn("pairs", _t(spark, d, "benchmark").agg(F.count("*")).scalar())


# Evaluation


@query(f"WITH {_PAIRS} SELECT item_id, {_DISTANCE.format(**_BARE)} AS distance, round({_CER}, 6) AS cer FROM pairs")
def mth7_cer(spark, d):
    a, b = F.replace("reference", F.lit(" "), F.lit("")), F.replace("hypothesis", F.lit(" "), F.lit(""))
    p = pairs_of(spark, d).withColumn("distance", F.levenshtein(a, b).cast("bigint"))
    return p.select("item_id", "distance", F.round(arrays.error_rate(F.col("distance"), F.length(a), F.length(b)), 6).alias("cer"))


# Words as single bytes: for pairs of up to 127 distinct words, which all pairs of the tables are.
_CODED = f"""{_PAIRS}, named AS (SELECT *, list_filter(string_split(reference, ' '), lambda t: t <> '') AS a, list_filter(string_split(hypothesis, ' '), lambda t: t <> '') AS b FROM pairs),
distinct_names AS (SELECT *, list_distinct(list_concat(a, b)) AS names FROM named),
coded AS (SELECT *, levenshtein(array_to_string(list_transform(a, lambda t: chr(CAST(list_position(names, t) AS INTEGER))), ''), array_to_string(list_transform(b, lambda t: chr(CAST(list_position(names, t) AS INTEGER))), '')) AS words FROM distinct_names)"""
_WER = "CASE WHEN len(a) > 0 THEN words / len(a) WHEN len(b) > 0 THEN 1 ELSE 0 END"


@query(f"WITH {_CODED} SELECT item_id, round({_WER}, 6) AS wer FROM coded")
def mth6_wer(spark, d):
    a, b = arrays.tokens(F.col("reference")), arrays.tokens(F.col("hypothesis"))
    return pairs_of(spark, d).select("item_id", F.round(arrays.error_rate(arrays.word_distance(a, b), F.size(a), F.size(b)), 6).alias("wer"))


_GRAMS = f"""{_PAIRS}, n(n) AS (VALUES (1), (2), (3), (4), (5), (6)), grams AS (
SELECT item_id, n, side, substr(t, CAST(i AS BIGINT), n) AS g FROM (SELECT item_id, n, side, t, unnest(range(1, length(t) - n + 2)) AS i FROM n, (SELECT item_id, 0 AS side, replace(reference, ' ', '') AS t FROM pairs UNION ALL SELECT item_id, 1, replace(hypothesis, ' ', '') FROM pairs)))"""


def _grams(spark, d) -> DataFrame:
    p = pairs_of(spark, d)
    sides = p.select("item_id", F.posexplode(F.array(F.replace("reference", F.lit(" "), F.lit("")), F.replace("hypothesis", F.lit(" "), F.lit("")))).alias("side", "t"))
    orders = sides.select("item_id", "side", F.explode(F.array(*[F.struct(F.lit(n).alias("n"), arrays.ngrams(F.col("t"), n).alias("g")) for n in range(1, 7)])).alias("x"))
    return orders.select("item_id", "side", "x.n", F.explode("x.g").alias("g"))


@query(f"WITH {_GRAMS} SELECT item_id, CAST(n AS INTEGER) AS n, g, count(*) AS c FROM grams WHERE side = 0 GROUP BY ALL")
def agg12_ngrams(spark, d):
    return _grams(spark, d).where("side = 0").groupBy("item_id", "n", "g").agg(F.count("*").alias("c"))


_CHRF = f"""{_GRAMS}, c AS (SELECT item_id, n, g, count(*) FILTER (side = 0) AS r, count(*) FILTER (side = 1) AS h FROM grams GROUP BY ALL),
o AS (SELECT item_id, n, sum(least(r, h)) / greatest(sum(h), 1) AS p, sum(least(r, h)) / greatest(sum(r), 1) AS q FROM c GROUP BY ALL), m AS (SELECT item_id, sum(p) / 6 AS p, sum(q) / 6 AS q FROM o GROUP BY 1),
scored AS (SELECT item_id, CASE WHEN reference = '' AND hypothesis = '' THEN 1 WHEN coalesce(p + q, 0) = 0 THEN 0 ELSE 5 * p * q / (4 * p + q) END AS chrf FROM pairs LEFT JOIN m USING (item_id))"""


def chrf_of(spark, d) -> DataFrame:
    """chrF of every pair: 1 for two empty sides, 0 for one; an order that a side is too short for counts as 0."""
    c = _grams(spark, d).groupBy("item_id", "n", "g").agg(F.count_if(F.col("side") == 0).alias("r"), F.count_if(F.col("side") == 1).alias("h"))
    o = c.groupBy("item_id", "n").agg((F.sum(F.least("r", "h")) / F.greatest(F.sum("h"), F.lit(1))).alias("p"), (F.sum(F.least("r", "h")) / F.greatest(F.sum("r"), F.lit(1))).alias("q"))
    m = o.groupBy("item_id").agg((F.sum("p") / 6).alias("p"), (F.sum("q") / 6).alias("q"))
    score = F.when((F.col("reference") == "") & (F.col("hypothesis") == ""), 1.0).when(F.coalesce(F.col("p") + F.col("q"), F.lit(0.0)) == 0, 0.0).otherwise(5 * F.col("p") * F.col("q") / (4 * F.col("p") + F.col("q")))
    return pairs_of(spark, d).join(m, "item_id", "left").select("item_id", score.alias("chrf"))


@query(f"WITH {_CHRF} SELECT item_id, round(chrf, 6) AS chrf FROM scored")
def mth8_chrf(spark, d):
    return chrf_of(spark, d).select("item_id", F.round("chrf", 6).alias("chrf"))


@query(f"""WITH {_CODED}, timed AS (SELECT *, 40 + item_id * 37 % 900 AS latency_ms, length(reference) / 15.0::DOUBLE AS seconds FROM coded)
SELECT item_id % 3 AS model, count(*) AS n, round(avg({_WER}), 4) AS wer_mean, round(avg({_CER}), 4) AS cer_mean, round(avg(CASE WHEN seconds > 0 THEN latency_ms / 1000.0::DOUBLE / seconds ELSE 0 END), 3) AS rtf_mean, round(avg(latency_ms), 1) AS latency_ms_mean FROM timed GROUP BY 1""")
def agg8_evaluation(spark, d):
    """Recognition per model: macro means of word and letter error rates, realtime factor and latency."""
    latency = (40 + F.col("item_id") * 37 % 900).alias("latency_ms")
    runs = pairs_of(spark, d).select((F.col("item_id") % 3).alias("model"), "reference", "hypothesis", latency, (F.length("reference") / F.lit(15.0)).alias("seconds"))
    return evaluation.asr_rollup(runs, ["model"])


# Samples and numbers


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) / len(embedding)), 6) AS rms FROM embeddings")
def mth1_rms(spark, d):
    return _t(spark, d, "embeddings").select("vec_id", F.round(arrays.rms(F.col("embedding")), 6).alias("rms"))


@query("SELECT vec_id, round(least(1, 4 * sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) / len(embedding))), 6) AS level FROM embeddings")
def mth9_level(spark, d):
    return _t(spark, d, "embeddings").select("vec_id", F.round(arrays.level_meter(F.col("embedding")), 6).alias("level"))


@query("SELECT vec_id, CAST(len(embedding) AS BIGINT) AS n_samples, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) / len(embedding)) >= 0.12 AS is_speech FROM embeddings")
def aud4_levels(spark, d):
    return _t(spark, d, "embeddings").select("vec_id", F.size("embedding").cast("bigint").alias("n_samples"), (arrays.rms(F.col("embedding")) >= 0.12).alias("is_speech"))


@query("SELECT label, arg_min(vec_id, (-e, vec_id)) AS loudest FROM (SELECT label, vec_id, round(list_sum(list_transform(embedding[1:64:8], lambda x: x::DOUBLE * x::DOUBLE)), 9) AS e FROM embeddings) GROUP BY label")
def aud1_channel_choice(spark, d):
    eighth = F.filter("embedding", lambda x, i: i % 8 == 0)
    energy = F.round(F.aggregate(eighth, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")), 9)
    return _t(spark, d, "embeddings").withColumn("e", energy).groupBy("label").agg(F.min_by("vec_id", F.struct(-F.col("e"), "vec_id")).alias("loudest"))


@query("SELECT vec_id, CAST(i // 20 AS BIGINT) AS chunk, CAST(least(20, len(embedding) - i) AS BIGINT) AS n_samples FROM (SELECT vec_id, embedding, unnest(range(0, len(embedding), 20)) AS i FROM embeddings)")
def src4_split_audio(spark, d):
    cut = _t(spark, d, "embeddings").select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.size("embedding") - 1, F.lit(20))).alias("i"))
    return cut.select("vec_id", F.floor(F.col("i") / 20).alias("chunk"), F.size(F.slice("embedding", F.col("i") + 1, F.lit(20))).cast("bigint").alias("n_samples"))


@query("SELECT event_id, CASE WHEN value > 0 THEN round(CAST(json_extract(props, '$.k') AS INTEGER) / 1000 / value, 9) ELSE 0 END AS rtf, round(greatest(400, least(2000, 400 * (1 + least(1.5, 1.5 * (value / 100))))), 6) AS interval_ms FROM events")
def mth2_rtf(spark, d):
    k = F.from_json("props", "k int")["k"]
    return _t(spark, d, "events").select("event_id", F.round(arrays.real_time_factor(k, F.col("value")), 9).alias("rtf"), F.round(arrays.partial_interval_ms(400, 2000, F.col("value") / 100), 6).alias("interval_ms"))


@query("SELECT event_id, CASE WHEN floor(value * 1000) > 0 THEN floor(value * 1000) / 32000 * 1000 ELSE 0 END AS buffered_ms FROM events")
def mth3_buffered(spark, d):
    return _t(spark, d, "events").select("event_id", arrays.buffered_ms(F.floor(F.col("value") * 1000)).alias("buffered_ms"))


@query("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'odd' WHEN value * 1000 > 64000 THEN 'long' WHEN value <= 0 THEN 'empty' ELSE 'ok' END AS status FROM events")
def flt4_frame_status(spark, d):
    return _t(spark, d, "events").select("event_id", F.when(F.col("event_id") % 7 == 0, "odd").when(F.col("value") * 1000 > 64000, "long").when(F.col("value") <= 0, "empty").otherwise("ok").alias("status"))
