"""Takes: segments of a live transcript collected until the end mark of each take, or until it falls silent."""

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.schemas import EVENT
from ..sources.transcripts import parse_messages

HELD = "next bigint, text string, start_ms bigint, end_ms bigint, speaker int"
WORD = "word string, start_ms bigint, end_ms bigint"
WAITING = "seq bigint, last boolean, is_final boolean, text string, start_ms bigint, end_ms bigint, speaker int, words string"
WHOLE = ["seq", "start_ms", "end_ms", "speaker"]
FIELDS = ["seq", "last", "is_final", "text", "start_ms", "end_ms", "speaker", "words"]
COLUMNS = ["seq", "type", "text", "start_ms", "end_ms", "speaker", "interim", "words"]
FRESH = {"next": 0, "text": "", "start_ms": None, "end_ms": None, "speaker": None}
DTYPES = {"seq": "Int64", "start_ms": "Int64", "end_ms": "Int64", "speaker": "Int32"}
SILENCE_MS = 300_000


def whole(x: float | None) -> int | None:
    """A column with nulls comes as floats: silent rows have no clock."""
    return None if x is None or x != x else int(x)


def finished(held: dict, kind: str, seq: int) -> dict:
    """The event that ends a take; it clears the interim text."""
    start = held["start_ms"] or 0
    return {
        "type": kind, "text": held["text"], "start_ms": start, "end_ms": held["end_ms"] or start, "speaker": held["speaker"],
        "interim": "", "seq": seq,
    }


def apply_message(held: dict, m: dict) -> tuple[dict, list[dict], list[tuple]]:
    """One message in order: the new state, the events it causes, the words it adds to the take."""
    events, live, words = [], held["text"], []
    if m["is_final"]:
        if m["text"]:
            live = f"{held['text']} {m['text']}".strip()
            new = {"text": live}
            if m["start_ms"] is not None:
                if held["start_ms"] is None:
                    new |= {"start_ms": m["start_ms"], "speaker": m["speaker"]}
                new["end_ms"] = m["end_ms"]
            held = held | new
            words = [(w["word"], w["start_ms"], w["end_ms"]) for w in json.loads(m["words"] or "[]")]
        events.append({"type": "partial", "text": live, "interim": live, "seq": m["seq"]})
    elif m["text"]:
        live = f"{held['text']} {m['text']}".strip()
        events.append({"type": "partial", "text": live, "interim": live, "seq": m["seq"]})
    held = held | {"next": m["seq"] + 1}
    if m["last"] and held["text"]:
        events.append(finished(held, "utterance", m["seq"]))
    return held, events, words


class TakeCollector(StatefulProcessor):
    """Keeps a take's text, its words, and any message that came before its predecessor.

    A timer, set anew by every message, ends a take that gets no message for `silence_ms` of event
    time: what it holds is sent as an event of type expired, and its state is freed.
    """

    def __init__(self, silence_ms: int = SILENCE_MS):
        self.silence_ms = silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", HELD)
        self.waiting = handle.getListState("waiting", WAITING)
        self.words = handle.getListState("words", WORD)

    def _clear(self) -> None:
        for state in (self.held, self.waiting, self.words):
            state.clear()
        self._set_timer(None)

    def _set_timer(self, at: int | None, known: bool = True) -> None:
        for t in list(self.handle.listTimers()) if known else []:
            self.handle.deleteTimer(t)
        if at is not None:
            self.handle.registerTimer(at)

    def _whole_words(self) -> list[dict]:
        return [dict(zip(("word", "start_ms", "end_ms"), w)) for w in self.words.get()] if self.words.exists() else []

    @staticmethod
    def _frame(key, events: list[dict]) -> pd.DataFrame:
        column = lambda c: pd.Series([e.get(c) for e in events], dtype=DTYPES.get(c, object))
        return pd.DataFrame({"take": pd.Series([key[0]] * len(events), dtype=object)} | {c: column(c) for c in COLUMNS})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # every call to the state is a round trip: a take that ends in the batch in which it begins makes one
        known = self.held.exists()
        state = dict(zip(FRESH, self.held.get())) if known else FRESH
        pending = [dict(zip(FIELDS, w)) for w in self.waiting.get()] if known and self.waiting.exists() else []
        latest = 0
        for part in rows:
            columns = [[whole(x) for x in part[f].tolist()] if f in WHOLE else [None if x is None or x != x else x for x in part[f].tolist()] for f in FIELDS]
            pending += [dict(zip(FIELDS, m)) for m in zip(*columns)]
            latest = max(latest, int(part["at"].max().timestamp() * 1000))
        pending.sort(key=lambda m: m["seq"])
        out, said, done, at = [], [], False, 0
        while at < len(pending) and pending[at]["seq"] <= state["next"]:
            m = pending[at]
            at += 1
            if m["seq"] == state["next"]:
                state, events, words = apply_message(state, m)
                said += words
                if m["last"]:
                    done = True
                    whole_words = (self._whole_words() if known else []) + [dict(zip(("word", "start_ms", "end_ms"), w)) for w in said]
                    events = [e | {"words": whole_words} if e["type"] == "utterance" else e for e in events]
                out += events
        pending = pending[at:]
        if done and known:
            self._clear()
        elif not done:
            self.held.update(tuple(state.values()))
            if known:
                self.waiting.clear()
            if pending:
                self.waiting.put([tuple(m[f] for f in FIELDS) for m in pending])
            if said:
                self.words.appendList(said)
            self._set_timer(latest + self.silence_ms, known)
        yield self._frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = dict(zip(FRESH, self.held.get())) if self.held.exists() else FRESH
        out = [finished(state, "expired", state["next"] - 1) | {"words": self._whole_words()}] if state["text"] else []
        self._clear()
        yield self._frame(key, out)

    def close(self) -> None:
        pass


def take_events(messages: DataFrame, delay: str = "1 hour", silence_ms: int = SILENCE_MS) -> DataFrame:
    """Streaming: partial, utterance and expired events per take, in message order.

    `at` is the event time of a message; messages later than `delay` behind the newest are dropped. `interim` is the live text after the event: what a listener
    shows until the utterance lands, which clears it.
    """
    parsed = parse_messages(messages, keep_other=True).withColumn("words", F.to_json("words"))
    return parsed.withWatermark("at", delay).groupBy("take").transformWithStateInPandas(
        TakeCollector(silence_ms), outputStructType=EVENT, outputMode="Append", timeMode="EventTime"
    )


def takes_batch(messages: DataFrame) -> DataFrame:
    """Batch twin: one utterance per take that has text and an end mark."""
    rows = parse_messages(messages)
    spoken = F.col("is_final") & (F.col("text") != "")
    timed = spoken & F.col("start_ms").isNotNull()
    order = F.struct("seq", "text", "words")
    agg = rows.groupBy("take").agg(
        F.array_sort(F.collect_list(F.when(spoken, order))).alias("parts"),
        F.coalesce(F.min_by(F.when(timed, F.col("start_ms")), F.when(timed, F.col("seq"))), F.lit(0)).alias("start_ms"),
        F.max_by(F.when(timed, F.col("end_ms")), F.when(timed, F.col("seq"))).alias("last_end"),
        F.min_by(F.when(timed, F.col("speaker")), F.when(timed, F.col("seq"))).alias("speaker"),
        F.bool_or("last").alias("closed"),
    )
    agg = agg.withColumn("text", F.array_join(F.transform("parts", lambda x: x["text"]), " "))
    words = F.flatten(F.transform("parts", lambda x: F.coalesce(x["words"], F.array().cast(rows.schema["words"].dataType))))
    end = F.when(F.coalesce("last_end", F.lit(0)) == 0, F.col("start_ms")).otherwise(F.col("last_end"))
    return agg.filter("closed and text <> ''").select("take", "text", "start_ms", end.alias("end_ms"), "speaker", words.alias("words"))


def only(events: DataFrame, kind: str) -> DataFrame:
    return events.filter(F.col("type") == kind)
