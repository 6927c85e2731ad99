"""Citations of unverified quotes taken out of answers, as tokens come or afterwards."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from .jobs import with_large_state

MARK = re.compile(r"\[[^\]]*\]")


def passed(text: str, verified: set[str], last: bool = False) -> tuple[str, str]:
    """What of a text can be shown, and what must wait: an open bracket. At the end what waits is dropped."""
    cut = text.rfind("[")
    open_ = text.find("[", max(0, text.rfind("]") + 1)) if cut > text.rfind("]") else -1
    done, rest = (text[:open_], text[open_:]) if open_ >= 0 else (text, "")

    def keep(m: re.Match) -> str:
        inner = m[0][1:-1]
        return "" if re.fullmatch(r"Q[0-9]+", inner) and inner not in verified else m[0]

    return MARK.sub(keep, done), "" if last else rest


def filtered_text(text: Column, verified: Column) -> Column:
    """A whole answer without citations of quotes that are not in `verified`, and without an unclosed bracket at its end."""
    closed = F.regexp_replace(text, r"\[[^\]]*$", "")
    pieces = F.regexp_extract_all(closed, F.lit(r"\[[^\]]*\]|[^\[]+"), F.lit(0))
    bad = lambda p: p.rlike(r"^\[Q[0-9]+\]$") & ~F.array_contains(verified, F.regexp_extract(p, r"^\[(Q[0-9]+)\]$", 1))
    return F.array_join(F.filter(pieces, lambda p: ~bad(p)), "")


def answers(tokens: DataFrame, idle: int | None = None) -> DataFrame:
    """Filtered pieces (message_id, seq, text) of streamed tokens (message_id, seq, token, verified array, last).

    The text that waits is the state of a message; it goes with the last token. Give `idle` (seconds) to streams that never end,
    so that it also goes once no token came for so long: the answer was stopped, what was passed on stays, and its unclosed
    bracket is never shown. Streams with the trigger availableNow have none: a timeout keeps them running.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held, ended = state.get[0] if state.exists else "", False
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for seq, token, verified, last in zip(rows.seq, rows.token, rows.verified, rows["last"], strict=True):
            text, held = passed(held + (token or ""), set(verified) if verified is not None else set(), bool(last))
            out.append((key[0], seq, text))
            ended = bool(last)
        if not ended:
            state.update((held,))
            if idle:
                state.setTimeoutDuration(idle * 1000)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["message_id", "seq", "text"])

    return tokens.groupBy("message_id").applyInPandasWithState(run, "message_id long, seq long, text string", "held string", "append", GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout)


MESSAGES = "message_id long, seq long, text string, status string, content string"


class Lane(StatefulProcessor):
    """The answers of a lane. One value lists the known ids, until when each is known and whether it has ended. Only answers that are still open
    when a batch ends have a row of their own (what waits, what was shown, the newest token), so that one that is whole asks for no state.
    """

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.listed = handle.getValueState("listed", "ids binary, until binary, ended binary, timer long")
        self.open = handle.getMapState("open", "message_id long", "held string, content string, seq long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        found, out = pd.concat(list(rows)).sort_values(["message_id", "seq"], kind="stable"), []
        known, timer = self._load()
        tokens = zip(*(found[c].tolist() for c in ("message_id", "seq", "micros", "token", "verified", "last", "stop")), strict=True)
        for message, own in groupby(tokens, lambda t: t[0]):
            _, ended = known.get(message, (0, False))
            waits = message in known and not ended
            held, content, seq = self.open.getValue((message,)) if waits else ("", "", -1)
            shown, newest = [content], None
            for _, n, micros, token, verified, last, stop in own:
                newest = micros if newest is None else max(newest, micros)
                if ended:
                    continue  # nothing of a stopped answer is read any more
                seq = n
                if not stop:
                    text, held = passed(held + (token or ""), set(verified) if verified is not None else set(), last)
                    shown.append(text)
                    out.append((message, seq, text, "STREAMING", None))
                if stop or last:
                    ended = True
                    out.append((message, seq, None, "STOPPED" if stop else "COMPLETE", "".join(shown)))
            known[message] = (newest // 1000 + self.idle_ms, ended)
            if not ended:
                self.open.updateValue((message,), (held, "".join(shown), seq))
            elif waits:
                self.open.removeKey((message,))
        self._store(known, timer)
        yield self._frame(out)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, out = timerValues.getCurrentWatermarkInMs(), []
        known, timer = self._load()
        for message, (until, ended) in list(known.items()):
            if until > now:
                continue
            if ended:
                del known[message]
                continue
            _, content, seq = self.open.getValue((message,))
            self.open.removeKey((message,))
            out.append((message, seq, None, "STOPPED", content))
            # Tokens that come late still find a stopped answer, for once more the idle time.
            known[message] = (until + self.idle_ms, True)
        self._store(known, timer)
        yield self._frame(out)

    def _load(self) -> tuple[dict[int, tuple[int, bool]], int]:
        """Until when each message is known and whether it has ended, and the lane's timer (0: none)."""
        if not self.listed.exists():
            return {}, 0
        ids, until, ended, timer = self.listed.get()
        columns = (np.frombuffer(x, t).tolist() for x, t in ((ids, np.int64), (until, np.int64), (ended, np.bool_)))
        return {message: (at, gone) for message, at, gone in zip(*columns, strict=True)}, timer

    def _store(self, known: dict[int, tuple[int, bool]], timer: int) -> None:
        """The lane has one timer, at the time when its first message runs out."""
        first = min((until for until, _ in known.values()), default=0)
        if first != timer:
            if timer:
                self.handle.deleteTimer(timer)
            if first:
                self.handle.registerTimer(first)
        if known:
            columns = (list(known), np.int64), ([until for until, _ in known.values()], np.int64), ([ended for _, ended in known.values()], np.bool_)
            self.listed.update((*(np.array(x, t).tobytes() for x, t in columns), first))
        else:
            self.listed.clear()

    @staticmethod
    def _frame(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=[f.split()[0] for f in MESSAGES.split(", ")]).astype({"message_id": "int64", "seq": "int64"})


def messages(tokens: DataFrame, idle_seconds: int = 60, late: str = "0 seconds", lanes: int = 1024) -> DataFrame:
    """Answers as they are made, from streamed tokens (message_id, seq, at, token, verified array, last, stop).

    Each token gives a row (message_id, seq, text, STREAMING, null) with what of it can be shown, each answer one row more with all
    that was shown as content: COMPLETE with its last token, STOPPED where a row says stop (its own token is not read) or where the
    watermark has passed its newest token by the idle time. What was shown stays; an open bracket at the end never was.
    Tokens after the end are dropped. Nulls: a token counts as empty, last and stop as false; rows without an id or time are left out.
    Messages are dealt to so many lanes, and a Python call serves a lane's tokens of a batch: they must fit in its memory.
    """
    with_large_state(tokens.sparkSession)
    timed = tokens.where("message_id is not null and at is not null").withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", late)
    no = F.lit(False)
    rows = timed.select(F.pmod(F.xxhash64("message_id"), F.lit(lanes)).cast("int").alias("lane"), F.col("message_id").cast("long").alias("message_id"), F.coalesce("seq", F.lit(0)).cast("long").alias("seq"), "at", F.unix_micros("at").alias("micros"), "token", "verified", F.coalesce("last", no).alias("last"), F.coalesce("stop", no).alias("stop"))
    return rows.groupBy("lane").transformWithStateInPandas(Lane(idle_seconds * 1000), MESSAGES, "append", "EventTime")
