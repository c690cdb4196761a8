"""State machines of a live session: speech segments, snapshots, sentences, backlog, merged segments, request batches."""

from __future__ import annotations

import operator
import re
from dataclasses import dataclass, field

from subtide.functions.text import CONNECTORS, FILLERS

# End silence and longest segment of each mode, in seconds.
MODES = {"fast": (0.35, 3.0), "balanced": (0.50, 4.5), "quality": (0.70, 5.8)}
# Milliseconds of backlog at which the sender changes state.
BACKLOG = {
    "normal": [(operator.ge, 1200, "dropping"), (operator.ge, 600, "congested")],
    "congested": [(operator.ge, 1200, "dropping"), (operator.le, 350, "normal")],
    "dropping": [(operator.le, 400, "recovery")],
    "recovery": [(operator.ge, 1200, "dropping")],
}


@dataclass
class Segmenter:
    """Rows (seq, n_samples, level) to speech segments: the range of chunks, its samples and why it ended."""

    rate: int = 16_000
    end_silence: float = MODES["balanced"][0]
    longest: float = MODES["balanced"][1]
    least: float = 0.25
    pre_roll: float = 0.12
    threshold: float = 0.010
    schema: str = "first_seq long, last_seq long, n_samples long, reason string"

    def start(self) -> dict:
        return {"before": [], "speech": 0, "silence": 0, "first": None, "last": None}

    def samples(self, seconds: float) -> int:
        return int(seconds * self.rate)

    def step(self, state: dict, row: dict) -> list[tuple]:
        n, loud = int(row["n_samples"] or 0), (row["level"] or 0.0) >= self.threshold
        if n == 0:
            return []
        if state["first"] is None:
            before = [*state["before"], [row["seq"], n]]
            if loud:
                state.update(before=[], first=before[0][0], last=row["seq"], speech=sum(k for _, k in before), silence=0)
            else:
                while before and sum(k for _, k in before) > self.samples(self.pre_roll):
                    before.pop(0)
                state["before"] = before
            return []
        state.update(last=row["seq"], speech=state["speech"] + n, silence=0 if loud else state["silence"] + n)
        if state["speech"] >= self.samples(self.longest):
            return self._ended(state, "max")
        if state["speech"] >= self.samples(self.least) and state["silence"] >= self.samples(self.end_silence):
            return self._ended(state, "silence")
        return []

    def _ended(self, state: dict, reason: str) -> list[tuple]:
        out = (state["first"], state["last"], state["speech"], reason)
        state.update(self.start())
        return [out]

    def close(self, state: dict) -> list[tuple]:
        return self._ended(state, "flush") if state["first"] is not None else []


@dataclass
class Snapshots:
    """Rows (seq, at_ms, n_samples, level and optional flags) to partials of the running utterance, or why there is none.

    ``flags`` name boolean columns in the order in which they suppress a partial; rows between two partials give nothing.
    """

    segmenter: Segmenter = field(default_factory=Segmenter)
    flags: tuple[str, ...] = ("flush_requested", "final_queued", "asr_busy", "backpressure")
    every_ms: int = 400
    longest: float = 1.8
    margin: float = 0.35
    most_rtf: float = 0.8
    schema: str = "seq long, n_samples long, suppressed string"

    def start(self) -> dict:
        return {"segment": self.segmenter.start(), "at": None}

    def step(self, state: dict, row: dict) -> list[tuple]:
        segment, s = state["segment"], self.segmenter
        s.step(segment, row)
        margin = max(1, s.samples(self.margin))
        near_end = segment["first"] is not None and (
            s.samples(s.longest) - segment["speech"] <= margin or (segment["silence"] > 0 and s.samples(s.end_silence) - segment["silence"] <= margin)
        )
        why = next((f for f in self.flags if row.get(f)), None)
        why = why or ("realtime_factor" if (row.get("rtf") or 0) >= self.most_rtf else "close_to_final" if near_end else None)
        if why:
            return [(row["seq"], None, why)]
        if segment["first"] is None or (state["at"] is not None and row["at_ms"] - state["at"] < self.every_ms):
            return []
        state["at"] = row["at_ms"]
        return [(row["seq"], min(segment["speech"], s.samples(self.longest)), None)]

    def close(self, state: dict) -> list[tuple]:
        return []


_WORD = re.compile(r"\b[\wÀ-ÿ'-]+\b")
_END = re.compile(r"[.!?…][\"”’)\]]*(?=\s|$)")


def tidy(text: str | None) -> str:
    text = re.sub(r" +([,.;:!?])", r"\1", " ".join((text or "").split()))
    return re.sub(r"([¿¡]) +", r"\1", text)


def joined(left: str, right: str, most: int = 8) -> str:
    """Both texts, with words at the seam that they share kept once."""
    if left.endswith(right):
        return left
    a, b = left.split(), right.split()
    low_a, low_b = [w.lower() for w in a], [w.lower() for w in b]
    shared = next((k for k in range(min(most, len(a), len(b)), 0, -1) if low_a[-k:] == low_b[:k]), 0)
    return tidy(" ".join(a + b[shared:]))


@dataclass
class SentenceAssembler:
    """Rows (seq, text, forced, source_lang) to whole sentences; what is unfinished waits for the next fragment.

    A change of language drops what waits. Null texts count as empty.
    """

    most_words: int = 32
    most_chars: int = 240
    least_words: int = 3
    schema: str = "seq long, sentence string"

    def start(self) -> dict:
        return {"waiting": "", "lang": None, "seq": None}

    def _dropped(self, text: str) -> bool:
        short = len(_WORD.findall(text)) < self.least_words and not text.endswith(("?", "!"))
        return not text or short or self._filler(text)

    @staticmethod
    def _filler(text: str) -> bool:
        return re.sub(r"[\W_]+", " ", text.lower()).strip() in FILLERS

    @staticmethod
    def _goes_on(text: str, lang: str | None) -> bool:
        """Whether a Dutch text ends in a word that announces a continuation."""
        return lang == "nl" and (_WORD.findall(text.lower()) or [""])[-1] in CONNECTORS

    def _whole(self, text: str) -> list[str]:
        done = text if text.endswith((".", "!", "?", "…")) else f"{text}."
        return [] if self._dropped(done) else [done]

    def _cut(self, text: str, forced: bool, lang: str | None) -> tuple[list[str], str]:
        if forced:
            waits = self._goes_on(text, lang) and len(_WORD.findall(text)) < self.most_words
            return ([], text) if waits else (self._whole(text), "")
        ends = [m.end() for m in _END.finditer(text)]
        found = [p for p in (tidy(text[a:b]) for a, b in zip([0, *ends], ends, strict=False)) if not self._dropped(p)]
        held = any(self._goes_on(x, lang) for x in found)
        found, rest = ([], text) if held else (found, tidy(text[ends[-1] :]) if ends else text)
        full = len(_WORD.findall(rest)) >= self.most_words or len(rest) >= self.most_chars
        if not found and full and not self._goes_on(rest, lang):
            return [rest if rest.endswith((".", "!", "?", "…")) else f"{rest}."], ""
        return found, rest

    def step(self, state: dict, row: dict) -> list[tuple]:
        if row.get("source_lang") != state["lang"]:
            state.update(waiting="", lang=row.get("source_lang"))
        fragment = tidy(row["text"])
        state["seq"] = row["seq"]
        if not fragment or self._filler(fragment):
            return []
        text = joined(state["waiting"], fragment) if state["waiting"] else fragment
        found, state["waiting"] = self._cut(text, bool(row.get("forced")), state["lang"])
        return [(row["seq"], s) for s in found]

    def close(self, state: dict) -> list[tuple]:
        found, state["waiting"] = self._cut(state["waiting"], True, state["lang"]) if state["waiting"] else ([], "")
        return [(state["seq"], s) for s in found]


@dataclass
class Backlog:
    """Rows (seq, at_ms, buffered_ms, gap_sent) to the sender's state with its episodes of congestion so far.

    A gap notice ends recovery before its own row is judged.
    """

    schema: str = "seq long, state string, action string, episodes long, longest_ms long, dropped long, gaps long"

    def start(self) -> dict:
        return {"state": "normal", "since": None, "episodes": 0, "longest": 0, "dropped": 0, "gaps": 0}

    @staticmethod
    def _enter(state: dict, name: str, at: int) -> None:
        state["state"] = name
        if name in ("congested", "dropping") and state["since"] is None:
            state.update(since=at, episodes=state["episodes"] + 1)
        if name == "normal" and state["since"] is not None:
            state.update(longest=max(state["longest"], at - state["since"]), since=None)

    def step(self, state: dict, row: dict) -> list[tuple]:
        at, level = int(row["at_ms"]), row["buffered_ms"] or 0
        if row.get("gap_sent") and state["state"] == "recovery":
            state["gaps"] += 1
            self._enter(state, "normal", at)
        for holds, bound, following in BACKLOG[state["state"]]:
            if holds(level, bound):
                self._enter(state, following, at)
                break
        name = state["state"]
        state["dropped"] += name == "dropping"
        action = {"normal": "sent", "dropping": "drop"}.get(name, "warn")
        return [(row["seq"], name, action, state["episodes"], state["longest"], state["dropped"], state["gaps"])]

    def close(self, state: dict) -> list[tuple]:
        return []


@dataclass
class MergedSegments:
    """Rows (seq, kind, config, epoch, n_samples, created_ms): final segments joined to the one before of equal config and epoch, up to a length."""

    most_samples: int = 12 * 16_000
    schema: str = "first_seq long, last_seq long, n_segments long, n_samples long, created_ms long"

    def start(self) -> dict:
        return {"open": None, "of": None}

    def step(self, state: dict, row: dict) -> list[tuple]:
        of, n = [row["kind"], row["config"], row["epoch"]], int(row["n_samples"] or 0)
        last = state["open"]
        if last and row["kind"] == "final" and state["of"] == of and last[3] + n <= self.most_samples:
            state["open"] = [last[0], row["seq"], last[2] + 1, last[3] + n, min(last[4], row["created_ms"])]
            return []
        done = self.close(state)
        state.update(open=[row["seq"], row["seq"], 1, n, row["created_ms"]], of=of)
        return done

    def close(self, state: dict) -> list[tuple]:
        return [tuple(state["open"])] if state["open"] else []


@dataclass
class RequestBatches:
    """Rows (seq, n_chars) to batch numbers: at most so many requests and characters, but one request is always taken."""

    most_requests: int = 8
    most_chars: int = 2400
    schema: str = "seq long, batch long, n_chars long"

    def start(self) -> dict:
        return {"batch": 0, "requests": 0, "chars": 0}

    def step(self, state: dict, row: dict) -> list[tuple]:
        n = int(row["n_chars"] or 0)
        if state["requests"] and (state["requests"] >= self.most_requests or state["chars"] + n > self.most_chars):
            state.update(batch=state["batch"] + 1, requests=0, chars=0)
        state.update(requests=state["requests"] + 1, chars=state["chars"] + n)
        return [(row["seq"], state["batch"], n)]

    def close(self, state: dict) -> list[tuple]:
        return []
