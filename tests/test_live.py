"""Timed machines over tables and streams, transcripts by id, histories in batches, states as of a time: literal cases and brute force."""

import random

import pytest
from pyspark.sql import functions as F

from subtide.operators import sessions, transcripts
from subtide.sources.history import JOB, History
from subtide.streaming import keyed, live
from subtide.streaming.fold import drained, fold
from subtide.streaming.machines import MODES


def watch(rows, until, **kw):
    machine = live.SilenceWatch(**kw)
    return drained(machine, None, [{"at_ms": at, "level": level, "paused": None, **more} for at, level, more in rows], "at_ms", until)[0]


def test_silence_at_first_and_later_each_warned_once():
    quiet = [(0, 0.0, {}), (7_999, 0.0, {}), (20_000, 0.001, {})]
    assert watch(quiet[:2], 7_999) == [] and watch(quiet, 100_000) == [(8_000, "initial_silence", 8_000)]
    back = [*quiet, (21_000, 0.5, {}), (22_000, 0.5, {})]
    assert watch(back, 82_000) == [(8_000, "initial_silence", 8_000), (21_000, "restored", None), (82_000, "capture_loss", 60_000)]
    assert watch([(0, 0.5, {}), (59_999, 0.5, {}), (119_999, 0.5, {})], 130_000) == [(119_999, "capture_loss", 60_000), (119_999, "restored", 60_000)]
    assert watch([(0, 0.005, {}), (1, None, {})], 9_000) == [(8_000, "initial_silence", 8_000)]


def test_a_pause_stops_the_watch():
    assert watch([(0, 0.5, {}), (1_000, 0, {"paused": True})], 200_000) == []
    assert watch([(0, 0.5, {}), (1_000, 0, {"paused": True}), (100_000, 0, {"paused": False})], 200_000) == [(160_000, "capture_loss", 160_000)]
    assert watch([(0, 0, {"paused": True})], 200_000) == []


def test_a_session_closes_once():
    machine = live.SessionClose(idle_ms=100)
    rows = [{"at_ms": at, "kind": kind} for at, kind in ((0, "queued"), (50, "queued"), (60, "done"), (160, "done"), (170, "close"), (171, "other"))]
    assert drained(machine, None, rows, "at_ms", 300)[0] == [(0, 160, 3, 1, "idle"), (160, 170, 2, 0, "close"), (171, 271, 1, 0, "idle")]
    assert drained(machine, None, rows, "at_ms", 270) == ([(0, 160, 3, 1, "idle"), (160, 170, 2, 0, "close")], {"opened": 171, "last": 171, "events": 1, "open": 0, "ended": False})


def timed_rows(n=240):
    rng = random.Random(3)
    at, rows = 0, []
    for i in range(n):
        at += rng.choice([0, 500, 2_000, 9_000, 61_000])
        rows.append((i % 3, i, at, rng.choice([0.0, 0.0, 0.5]), rng.choice(["queued", "done", "close", "other", "other"])))
    return rows


@pytest.mark.parametrize("machine", [live.SilenceWatch(), live.SessionClose(idle_ms=30_000)])
def test_stream_of_shuffled_files_equals_the_fold_and_forgets(spark, tmp_path, machine):
    """Rows out of order within the delay, over six micro-batches."""
    rows, schema = timed_rows(), "client_id long, seq long, at_ms long, level double, kind string"
    rng = random.Random(5)
    parts = [rows[i : i + 40] for i in range(0, 240, 40)]
    for a, b in zip(parts, parts[1:], strict=False):  # some rows come a file later
        for _ in range(4):
            b.append(a.pop(rng.randrange(20, len(a))))
    for part in parts:
        rng.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = keyed.timed_stream(stream, "client_id", "at_ms", ["seq"], machine, delay="5000 seconds")
    q = out.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
    q.awaitTermination()
    until = max(r[2] for r in rows) - 5_000_000
    want = fold(spark.createDataFrame(rows, schema).where(F.col("at_ms") <= until), "client_id", ["at_ms", "seq"], machine, until=until)
    got = sorted(map(repr, spark.read.schema(out.schema).parquet(f"{tmp_path}/out").collect()))
    assert got == sorted(map(repr, want.collect()))


def test_the_state_is_empty_after_the_watermark(spark, tmp_path):
    schema = "client_id long, seq long, at_ms long, kind string"
    for k, part in enumerate(([(1, 0, 5, "queued"), (2, 1, 10, "other")], [(9, 2, 1_000_000, "close")])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    out = keyed.timed_stream(stream, "client_id", "at_ms", ["seq"], live.SessionClose(idle_ms=1_000))
    q = out.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == [(1, 5, 1_005, 1, 1, "idle"), (2, 10, 1_010, 1, 0, "idle"), (9, 1_000_000, 1_000_000, 1, 0, "close")]
    assert q.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] == 0


# Transcripts


MESSAGE = "client_id long, seq long, kind string, id long, at_ms long, source_text string, translation string, source_lang string, target_lang string, mode string, start_ms long, end_ms long"


def said(seq, kind, ident, at, client=1, **more):
    return (client, seq, kind, ident, at, *[more.get(c) for c in ("source_text", "translation", "source_lang", "target_lang", "mode", "start_ms", "end_ms")])


def store_of(rows):
    """The items of a session as a list that messages change one by one."""
    items, by_id = [], {}
    for client, seq, kind, ident, at, text, translation, source, target, mode, start, end in sorted(rows, key=lambda r: r[1]):
        if client is None or ident is None:
            continue
        own = [x for x in items if x["client"] == client]
        item = by_id.get((client, ident))
        if kind == "pending" or item is None:
            if own and own[-1]["pending"]:
                own[-1]["end"] = max(own[-1]["start"] + 800, at - 120)
            number = sum(x["id"] == ident and x["number"] > 0 for x in own) + (kind == "pending")
            item = {"client": client, "id": ident, "number": number, "start": at, "end": at + 3500, "text": text or "", "translation": "", "source": source or "nl", "target": target or "en", "mode": mode or "balanced", "pending": kind == "pending"}
            items.append(item)
            by_id[client, ident] = item
        if kind != "pending":
            item |= {"text": text or item["text"], "translation": translation or item["translation"] or "Translation unavailable", "source": source or item["source"], "target": target or item["target"], "mode": mode or item["mode"], "pending": False}
            item |= {k: v for k, v in (("start", start), ("end", end)) if v is not None}
    return sorted(tuple(x.values()) for x in items)


def test_transcripts_of_literal_cases(spark):
    rows = [said(0, "final", 1, 0, source_text="Eerste zin.", translation="First.", start_ms=0, end_ms=2000), said(1, "pending", 2, 8000, source_text="Tweede."), said(2, "pending", 3, 8100), said(3, "pending", 4, 20_000), said(4, "final", 4, 21_000), said(5, "final", None, 1)]
    got = {r.id: r for r in transcripts.merged(spark.createDataFrame(rows, MESSAGE)).collect()}
    assert (got[1].end_ms, got[1].pending) == (2000, False) and (got[2].end_ms, got[3].end_ms) == (8800, 19_880)
    assert got[4].translation == "Translation unavailable" and not got[4].pending and len(got) == 4


def random_messages():
    rng, rows = random.Random(7), []
    for seq in range(400):
        more = {c: rng.choice([None, None, "", f"{c}{seq}"]) for c in ("source_text", "translation", "source_lang", "target_lang", "mode")}
        more |= {c: rng.choice([None, seq * 100]) for c in ("start_ms", "end_ms")} if seq % 2 else {}
        rows.append(said(seq, rng.choice(["pending", "final"]), rng.randrange(12), seq * 100, client=rng.randrange(4), **more))
    return rows


def test_transcripts_in_batch_and_over_several_files(spark, tmp_path):
    rows = random_messages()
    want = store_of(rows)
    batch = transcripts.merged(spark.createDataFrame(rows, MESSAGE))
    assert sorted(map(tuple, batch.collect())) == want
    for k in range(0, 400, 100):
        spark.createDataFrame(rows[k : k + 100], MESSAGE).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    changes = keyed.transcript_stream(stream)
    changes.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").option("path", f"{tmp_path}/out").trigger(availableNow=True).start().awaitTermination()
    got = transcripts.latest_version(spark.read.schema(changes.schema).parquet(f"{tmp_path}/out")).select(*batch.columns)
    assert sorted(map(tuple, got.collect())) == want


def test_a_final_after_the_item_was_forgotten_stands_alone(spark, tmp_path):
    for k, part in enumerate(([said(0, "pending", 1, 1, source_text="a")], [said(1, "pending", 2, 500_000, client=2)], [said(2, "final", 1, 500_001, translation="b")])):
        spark.createDataFrame(part, MESSAGE).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    changes = keyed.transcript_stream(stream, ttl_ms=60_000, delay="0 seconds")
    changes.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").option("path", f"{tmp_path}/out").trigger(availableNow=True).start().awaitTermination()
    got = transcripts.latest_version(spark.read.schema(changes.schema).parquet(f"{tmp_path}/out")).where("client_id = 1").orderBy("item").collect()
    assert [(r.item, r.source_text, r.translation, r.pending) for r in got] == [(0, "", "b", False), (1, "a", "", True)]


# States, settings, limits


def test_as_of_takes_the_last_state_and_makes_no_pairs(spark):
    rng = random.Random(1)
    states = sorted({(rng.randrange(3), rng.randrange(100)) for _ in range(60)})
    jobs = [(rng.randrange(4), rng.choice([None, rng.randrange(100)]), i) for i in range(80)] + [(None, 5, 99)]
    got = transcripts.as_of(spark.createDataFrame(jobs, "k long, at long, j long"), spark.createDataFrame([(k, at, at * 10) for k, at in states], "k long, at long, v long"), "k", "at", ["v"]).collect()
    want = {(k, at, j): max((s * 10 for kk, s in states if kk == k and at is not None and s <= at), default=None) for k, at, j in jobs}
    assert {(r.k, r.at, r.j): r.state_v for r in got} == want and len(got) == len(jobs)


def test_epochs_rise_on_changed_settings_only(spark):
    kinds = [("config", "nl", "en", ""), ("config", None, None, None), ("config", "en", "en", ""), ("partial", None, None, None), ("config", "en", "en", ""), ("audio_gap", None, None, None), ("config", "en", "en", "names")]
    rows = spark.createDataFrame([(1, i, *k) for i, k in enumerate(kinds)], "client_id long, seq long, type string, source_lang string, target_lang string, prompt string")
    assert [r.epoch for r in sessions.epochs(rows, ["seq"]).orderBy("seq").collect()] == [0, 0, 1, 1, 1, 2, 3]


def test_limits_follow_the_load():
    machine = live.AdaptiveLimits()
    state = machine.start()
    tight = [machine.step(state, {"seq": i, "rtf": 1.1})[0][2:] for i in range(9)]
    assert tight[0] == (0.5 * 0.90, 4.5 * 0.85) and tight[-1] == (0.35, 2.5)
    assert machine.step(state, {"seq": 9, "rtf": 0.6})[0][2:] == (0.35, 2.5)
    assert machine.step(state, {"seq": 10, "rtf": 0.4})[0][2:] == (0.5, 2.5 * 1.05)
    assert machine.step(state, {"seq": 11, "rtf": 1.3})[0][1:] == ("fast", 0.35, 3.0)
    assert machine.step(state, {"seq": 12, "rtf": 9.0})[0][1:] == ("fast", 0.35 * 0.90, 3.0 * 0.85)
    assert machine.step(state, {"seq": 13, "rtf": None, "mode": "quality"})[0][1:] == ("quality", *MODES["quality"])
    assert machine.step(state, {"seq": 14, "rtf": 2.0})[0][1:] == ("quality", *MODES["quality"])


def live_rows(*rows):
    return [{"seq": i, "n_samples": 8000, "level": 0.0, "text": None, "rtf": 0.0, "gap_ms": None, **r} for i, r in enumerate(rows)]


def run(machine, rows):
    state, out = machine.start(), []
    for r in rows:
        out += machine.step(state, r)
    return out, state


LOUD, QUIET = {"kind": "audio", "level": 0.5}, {"kind": "audio"}


def test_a_gap_cuts_audio_and_sentence():
    rows = live_rows(LOUD | {"text": "Dit gaat"}, {"kind": "audio_gap", "gap_ms": 2000}, QUIET, LOUD | {"text": "hier verder nu."}, QUIET)
    out, state = run(live.LiveSession(), rows)
    assert [(r[1], r[2], r[3], r[4], r[5], r[8]) for r in out] == [("silence", 1, 2, 3000, 4000, "hier verder nu."), ("sentence", 1, 2, 3000, 4000, "hier verder nu.")]
    words = live_rows(LOUD | {"text": "een half"}, QUIET, {"kind": "audio_gap", "gap_ms": -5}, LOUD | {"text": "en een heel verhaal."}, QUIET)
    assert [r[8] for r in run(live.LiveSession(), words)[0]][-1] == "en een heel verhaal."


def test_settings_raise_the_epoch_and_another_language_drops_what_waits():
    rows = live_rows(LOUD | {"text": "ik kom morgen en"}, QUIET, {"kind": "config", "source_lang": "en", "mode": "fast"}, LOUD | {"text": "we all go home"}, QUIET, {"kind": "config", "source_lang": "en", "mode": "fast"}, {"kind": "flush"}, LOUD)
    out, state = run(live.LiveSession(), rows)
    assert [r[8] for r in out if r[1] == "sentence"] == ["we all go home."] and state["epoch"] == 1 and state["generation"] == 3
    assert (state["silence"], state["longest"]) == MODES["fast"] and state["clock"] == 4 * 8000  # what comes after the flush is not heard


def plain_session(rows):
    """Another way to the same: samples as lists, times as seconds, text joined where a segment ends."""
    from subtide.streaming.machines import SentenceAssembler

    rate, asm = 16_000, SentenceAssembler()
    waiting, lang, target, prompt, epoch, gen, heard, cursor, done = asm.start() | {"lang": "nl"}, "nl", "en", "", 0, 0, 0.0, 0.0, False
    mode, (sil, longest) = "balanced", MODES["balanced"]
    talk, before, out = None, [], []

    def final(row, reason, forced):
        nonlocal gen, cursor, talk, mode, sil, longest
        gen += 1
        length = sum(n for n, _, _ in talk) / rate
        begin = max(0.0, heard - length, cursor)
        cursor = max(cursor, begin + length)
        text = " ".join(t for _, _, t in talk if t)
        talk = None
        found = asm.step(waiting, {"seq": row["seq"], "text": text, "forced": forced, "source_lang": lang})
        rtf = row["rtf"] or 0
        if mode != "quality" and rtf > 0:
            if rtf > 1:
                sil, longest = max(0.25 if mode == "fast" else 0.35, sil * 0.90), max(1.8 if mode == "fast" else 2.5, longest * 0.85)
            elif rtf < 0.45:
                sil, longest = MODES[mode][0], min(MODES[mode][1], longest * 1.05)
        if mode == "balanced" and rtf > 1.2:
            mode, (sil, longest) = "fast", MODES["fast"]
        for event, said in [(reason, text), *[("sentence", s) for _, s in found]]:
            out.append((row["seq"], event, epoch, gen, round(begin * 1000), round((begin + length) * 1000), round(sil, 9), round(longest, 9), said))

    for row in rows:
        if row["kind"] == "audio" and not done:
            n, loud = row["n_samples"], row["level"] >= 0.010
            heard += n / rate
            if talk is None and not loud:
                before.append((n, False, None))
                while before and sum(x[0] for x in before) > int(0.12 * rate):
                    before.pop(0)
            elif talk is None:
                talk, before = [*before, (n, True, row["text"])], []
            else:
                talk.append((n, loud, row["text"]))
                quiet = 0
                for m, was_loud, _ in reversed(talk):
                    if was_loud:
                        break
                    quiet += m
                total = sum(x[0] for x in talk)
                if total >= int(longest * rate):
                    final(row, "max", False)
                elif total >= int(0.25 * rate) and quiet >= int(sil * rate):
                    final(row, "silence", True)
        elif row["kind"] == "audio_gap":
            talk, before, epoch, gen = None, [], epoch + 1, gen + 1
            waiting["waiting"] = ""
            heard += max(0, row["gap_ms"] or 0) / 1000
            cursor = max(cursor, heard)
        elif row["kind"] == "config":
            new = (row.get("source_lang") or "nl", row.get("target_lang") or "en", row.get("prompt") or "")
            epoch += new != (lang, target, prompt)
            if new[0] != lang:
                waiting.update(waiting="", lang=new[0])
            lang, target, prompt = new
            mode = row.get("mode") or "balanced"
            sil, longest = MODES[mode]
        elif row["kind"] == "flush":
            done = True
            if talk:
                final(row, "flush", True)
            else:
                gen += 1
            before = []
            out += [(row["seq"], "sentence", epoch, gen, round(cursor * 1000), round(cursor * 1000), round(sil, 9), round(longest, 9), s) for _, s in asm.close(waiting)]
    return out


def test_random_sessions_equal_a_plain_one(spark):
    rng = random.Random(11)
    for _ in range(30):
        rows = []
        for _ in range(120):
            kind = rng.choices(["audio", "audio_gap", "config", "flush"], [90, 4, 5, 0.3])[0]
            rows.append({"kind": kind, "n_samples": rng.choice([1600, 3200, 8000]), "level": rng.choice([0.0, 0.0, 0.5, 0.5, 0.5]), "text": rng.choice([None, "en dan", "dat is zo.", "woord nummer drie"]), "rtf": rng.choice([0.0, 0.3, 0.7, 1.1, 1.5]), "gap_ms": rng.choice([None, -5, 0, 500]), "mode": rng.choice([None, "fast", "quality"]), "source_lang": rng.choice(["nl", "nl", "en"]), "prompt": rng.choice(["", "namen"])})
        rows = live_rows(*rows)
        got = [(*r[:6], round(r[6], 9), round(r[7], 9), r[8]) for r in run(live.LiveSession(), rows)[0]]
        assert got == plain_session(rows)


# Histories


def job(seq, kind, client, ident=None, day=1, text=None):
    import datetime

    at = datetime.datetime(2024, 1, day)
    return (seq, kind, client, ident, at, at, kind, text)


def test_history_batches(spark, tmp_path):
    store = History(spark, str(tmp_path))
    frame = lambda *rows: spark.createDataFrame(list(rows), JOB)
    assert store.sessions().count() == 0
    first = frame(job(0, "session", 1), job(1, "subtitle", 1, "a", text="old"), job(2, "session", 2), job(3, "subtitle", 2, "b", text="b"), job(4, "subtitle", 1, None, text="no id"))
    assert store.apply(first, 0) == "written" and store.apply(first, 0) == "known"
    assert store.apply(frame(job(0, "session", 1, day=3), job(1, "subtitle", 1, "a", day=3, text="new"), job(2, "delete", 2, day=3)), 1) == "written"
    assert store.apply(frame(job(0, "session", 3), job(1, "subtitle", 2, "c")), 2) == "rejected"  # session 2 is gone: nothing of the batch is kept
    assert store.apply(frame(job(0, "subtitle", None, "d")), 3) == "rejected"

    def state():
        return sorted((r.client_id, r.started_at.day, r.updated_at.day) for r in store.sessions().collect()), sorted((r.id, r.client_id, r.text) for r in store.subtitles().collect())

    want = ([(1, 1, 3)], [("a", 1, "new"), ("subtitle-0-4", 1, "no id")])
    assert state() == want
    store.compact()
    assert state() == want and store.apply(first, 0) == "known"
    assert store.apply(frame(job(0, "delete", 1), job(1, "session", 1, day=9), job(2, "session", 4), job(3, "subtitle", 4, "a", text="moved")), 4) == "written"
    assert state() == ([(1, 9, 9), (4, 1, 1)], [("a", 4, "moved")])
    assert History(spark, str(tmp_path)).sessions().count() == 2


def test_history_follows_a_stream(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([job(0, "session", k, day=k + 1), job(1, "subtitle", k, "x", text=str(k)), job(2, "session", 7, day=k + 1)], JOB).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    store = History(spark, f"{tmp_path}/history")
    for _ in range(2):  # the second run finds nothing new
        store.follow(spark.readStream.schema(JOB).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), f"{tmp_path}/c")
    assert len(store.commits()) == 3 and store.subtitles().count() == 1
    days = store.sessions().where("client_id = 7").first()
    assert store.sessions().count() == 4 and days.started_at != days.updated_at


class _Calls:
    """State of one key that counts its calls."""

    def __init__(self):
        self.n, self.held, self.timers = 0, {}, []

    def getMapState(self, *_):
        return self

    getListState = getMapState

    def getValueState(self, *_):
        return _Calls()

    def exists(self):
        return bool(self.held)

    def containsKey(self, key):
        self.n += 1
        return key in self.held

    def getValue(self, key):
        self.n += 1
        return self.held[key]

    def updateValue(self, key, value):
        self.n += 1
        self.held[key] = value

    def update(self, value):
        self.held[0] = value

    def appendList(self, values):
        self.n += len(values)

    def listTimers(self):
        return iter(self.timers)

    def registerTimer(self, at):
        self.timers.append(at)


def test_state_is_read_once_for_an_id_and_written_in_few_values():
    from pyspark.sql import Row

    message = {"kind": "pending", "id": 1, "at_ms": 0, "start_ms": None, "end_ms": None, "source_text": "s", "translation": None} | {c: None for c in transcripts.DEFAULTS}
    calls, machine = _Calls(), keyed._Transcript(1_000_000)
    machine.init(calls)
    found = list(machine.handleInputRows((7,), iter([Row(**(message | {"seq": k, "id": k % 2, "at_ms": 1_000 * k})) for k in range(100)]), None))
    assert len(found) == 199 and found[-1].id == 1 and found[-2].end_ms == 99_000 - 120 and calls.n <= 6
    calls = _Calls()
    waits = keyed._InOrder(live.SilenceWatch(), "at_ms", ["at_ms"], ["client_id", "at_ms", "event", "silent_ms"])
    waits.init(calls)
    list(waits.handleInputRows((7,), iter([Row(at_ms=k, level=0.5) for k in range(1_200)]), None))
    assert calls.n == 3
