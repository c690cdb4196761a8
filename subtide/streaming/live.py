"""Machines of a whole session: audio, gaps and settings on one ordered stream; limits that follow the load; silence; the end."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from subtide.streaming.machines import MODES, Segmenter, SentenceAssembler

# How limits follow the realtime factor, and their floors (end silence, longest segment) by mode.
TIGHTEN_OVER, RELAX_UNDER, DEGRADE_OVER = 1.0, 0.45, 1.2
TIGHTER_SEGMENT, TIGHTER_SILENCE, LOOSER_SEGMENT = 0.85, 0.90, 1.05
FLOORS = {"fast": (0.25, 1.8), "balanced": (0.35, 2.5)}
# Milliseconds of silence before a warning, and the level that counts as heard.
INITIAL_SILENCE_MS, CAPTURE_LOSS_MS, HEARD_OVER = 8_000, 60_000, 0.005


def adapted(mode: str, silence: float, longest: float, rtf: float) -> tuple[str, float, float]:
    """Mode, end silence and longest segment after a segment was recognised at this realtime factor."""
    if mode != "quality" and rtf > 0:
        least_silence, least_segment = FLOORS["fast" if mode == "fast" else "balanced"]
        if rtf > TIGHTEN_OVER:
            silence, longest = max(least_silence, silence * TIGHTER_SILENCE), max(least_segment, longest * TIGHTER_SEGMENT)
        elif rtf < RELAX_UNDER:
            silence, longest = MODES[mode][0], min(MODES[mode][1], longest * LOOSER_SEGMENT)
    if mode == "balanced" and rtf > DEGRADE_OVER:
        return "fast", *MODES["fast"]
    return mode, silence, longest


@dataclass
class AdaptiveLimits:
    """Rows (seq, rtf and, at a change of settings, mode) to the limits after each: measured load tightens, relaxes and degrades."""

    mode: str = "balanced"
    schema: str = "seq long, mode string, silence double, longest double"

    def start(self) -> dict:
        return {"mode": self.mode, "silence": MODES[self.mode][0], "longest": MODES[self.mode][1]}

    def step(self, state: dict, row: dict) -> list[tuple]:
        if row.get("mode") in MODES:
            state.update(mode=row["mode"], silence=MODES[row["mode"]][0], longest=MODES[row["mode"]][1])
        else:
            state["mode"], state["silence"], state["longest"] = adapted(state["mode"], state["silence"], state["longest"], row["rtf"] or 0.0)
        return [(row["seq"], state["mode"], state["silence"], state["longest"])]

    def close(self, state: dict) -> list[tuple]:
        return []


@dataclass
class LiveSession:
    """Segmenter, sentence assembler and clock on one stream of rows (seq, kind, n_samples, level, text, rtf, gap_ms, mode, source_lang, target_lang, prompt).

    kind ``audio``: a chunk, with the words said in it and, where it ends a segment, the realtime factor of its
    recognition. ``audio_gap``: the running segment and the waiting words are lost, the epoch and the generation
    rise and the clock moves on by the gap. ``config``: a change of language or prompt raises the epoch, another
    source language drops the waiting words, a mode sets the limits. ``flush``: both machines give what they hold,
    and later audio is not heard. Any other kind is left out.

    Gives a row for each segment and sentence, with the limits in force after it.
    """

    segmenter: Segmenter = field(default_factory=Segmenter)
    assembler: SentenceAssembler = field(default_factory=SentenceAssembler)
    schema: str = "seq long, event string, epoch long, generation long, start_ms long, end_ms long, silence double, longest double, text string"

    def start(self) -> dict:
        limits = {"mode": "balanced", "silence": MODES["balanced"][0], "longest": MODES["balanced"][1]}
        settings = {"source_lang": "nl", "target_lang": "en", "prompt": ""}
        return {"segment": self.segmenter.start(), "sentence": self.assembler.start() | {"lang": "nl"}, "words": [], "clock": 0, "cursor": 0, "epoch": 0, "generation": 0, "flushed": False} | limits | settings

    def _ms(self, samples: int) -> int:
        return samples * 1000 // self.segmenter.rate

    def _row(self, state: dict, seq: int, event: str, span: tuple[int, int], text: str) -> tuple:
        return (seq, event, state["epoch"], state["generation"], self._ms(span[0]), self._ms(span[1]), state["silence"], state["longest"], text)

    def _final(self, state: dict, row: dict, ended: tuple, forced: bool) -> list[tuple]:
        _, _, n, reason = ended
        state["generation"] += 1
        begin = max(0, state["clock"] - n, state["cursor"])
        state["cursor"] = max(state["cursor"], begin + n)
        said, state["words"] = " ".join(state["words"]), []
        found = self.assembler.step(state["sentence"], {"seq": row["seq"], "text": said, "forced": forced, "source_lang": state["source_lang"]})
        state["mode"], state["silence"], state["longest"] = adapted(state["mode"], state["silence"], state["longest"], row.get("rtf") or 0.0)
        span = (begin, begin + n)
        return [self._row(state, row["seq"], reason, span, said), *[self._row(state, row["seq"], "sentence", span, s) for _, s in found]]

    def step(self, state: dict, row: dict) -> list[tuple]:
        own = replace(self.segmenter, end_silence=state["silence"], longest=state["longest"])
        if row["kind"] == "audio" and not state["flushed"]:
            n = int(row["n_samples"] or 0)
            state["clock"] += n
            ended = own.step(state["segment"], row)
            if (ended or state["segment"]["first"] is not None) and n and row.get("text"):
                state["words"].append(row["text"])
            return self._final(state, row, ended[0], ended[0][3] == "silence") if ended else []
        if row["kind"] == "audio_gap":
            state.update(segment=own.start(), words=[], epoch=state["epoch"] + 1, generation=state["generation"] + 1)
            state["sentence"]["waiting"] = ""
            state["clock"] += max(0, int(row.get("gap_ms") or 0)) * self.segmenter.rate // 1000
            state["cursor"] = max(state["cursor"], state["clock"])
        elif row["kind"] == "config":
            new = {"source_lang": row.get("source_lang") or "nl", "target_lang": row.get("target_lang") or "en", "prompt": row.get("prompt") or ""}
            if any(state[c] != v for c, v in new.items()):
                state["epoch"] += 1
            if state["source_lang"] != new["source_lang"]:
                state["sentence"].update(waiting="", lang=new["source_lang"])
            mode = row.get("mode") if row.get("mode") in MODES else "balanced"
            state.update(new, mode=mode, silence=MODES[mode][0], longest=MODES[mode][1])
        elif row["kind"] == "flush":
            state["flushed"] = True
            ended = own.close(state["segment"])
            out = self._final(state, row, ended[0], True) if ended else []
            state["generation"] += not ended
            rest = self.assembler.close(state["sentence"])
            return [*out, *[self._row(state, row["seq"], "sentence", (state["cursor"], state["cursor"]), s) for _, s in rest]]
        return []

    def close(self, state: dict) -> list[tuple]:
        return []


@dataclass
class SilenceWatch:
    """Rows (at_ms, level and optional paused) to warnings: nothing heard at first, nothing heard any more, and heard again.

    ``paused`` true stops the watch, false resumes it; null leaves it. A level at the very deadline comes after the warning.
    """

    initial_ms: int = INITIAL_SILENCE_MS
    loss_ms: int = CAPTURE_LOSS_MS
    heard_over: float = HEARD_OVER
    schema: str = "at_ms long, event string, silent_ms long"

    def start(self) -> dict:
        return {"began": False, "heard": False, "warned": False, "paused": False, "last": None, "due": None}

    def deadline(self, state: dict) -> int | None:
        return state["due"]

    def expire(self, state: dict, at: int) -> list[tuple]:
        state["due"] = None
        if state["paused"] or state["warned"]:
            return []
        state["warned"] = True
        return [(at, "capture_loss", max(self.loss_ms, at - state["last"])) if state["heard"] else (at, "initial_silence", self.initial_ms)]

    def step(self, state: dict, row: dict) -> list[tuple]:
        at, out = int(row["at_ms"]), []
        if not state["began"]:
            state.update(began=True, due=at + self.initial_ms)
        if row.get("paused") is not None:
            state["paused"] = bool(row["paused"])
            if state["heard"]:
                state["due"] = None if state["paused"] else at + self.loss_ms
        if (row["level"] or 0.0) > self.heard_over:
            if state["warned"]:
                out.append((at, "restored", at - state["last"] if state["last"] is not None else None))
            state.update(heard=True, warned=False, last=at, due=None if state["paused"] else at + self.loss_ms)
        return out

    def close(self, state: dict) -> list[tuple]:
        return []


@dataclass
class SessionClose:
    """Rows (at_ms, seq, kind) to one row for each session: it closes at a ``close``, or when nothing came for ``idle_ms``.

    kind ``queued`` and ``done``: work that begins and ends; what is open at the close is cancelled.
    """

    idle_ms: int = 6 * 3_600_000
    schema: str = "opened_ms long, closed_ms long, events long, cancelled long, reason string"

    def start(self) -> dict:
        return {"opened": None, "last": None, "events": 0, "open": 0, "ended": False}

    def deadline(self, state: dict) -> int | None:
        return None if state["last"] is None else state["last"] + self.idle_ms

    def _closed(self, state: dict, at: int, reason: str) -> list[tuple]:
        state["ended"] = True
        return [(state["opened"], at, state["events"], max(0, state["open"]), reason)]

    def expire(self, state: dict, at: int) -> list[tuple]:
        return self._closed(state, at, "idle")

    def step(self, state: dict, row: dict) -> list[tuple]:
        at = int(row["at_ms"])
        state.update(opened=at if state["opened"] is None else state["opened"], last=at, events=state["events"] + 1)
        state["open"] += {"queued": 1, "done": -1}.get(row["kind"], 0)
        return self._closed(state, at, "close") if row["kind"] == "close" else []

    def close(self, state: dict) -> list[tuple]:
        return []
