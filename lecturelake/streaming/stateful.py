"""Streaming forms of the state machines, with the same transition functions as the batch forms.

Rows of a key are put in order inside a micro-batch; a row that is older than the key's last one comes out as late
and changes nothing. State is a few numbers and one signature or line a key. The stores need the RocksDB provider:
spark.sql.streaming.stateStore.providerClass =
org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from lecturelake.functions.text import casefold_key, trimmed
from lecturelake.operators.frames import keep_step, new_keyframe_state
from lecturelake.params import KeyframeParams, SpeechParams


#: Keys are dealt over so many buckets by a hash, and a bucket's states are one value, so that a micro-batch calls Python and the store once a bucket and not once a key.
BUCKETS = 1024


def _bucketed(rows: DataFrame, *names: str, buckets: int = BUCKETS) -> DataFrame:
    """Adds bucket, and state_key: the key columns as one text."""
    return rows.withColumn("bucket", F.pmod(F.xxhash64(*names), F.lit(buckets)).cast("int")).withColumn("state_key", F.col(names[0]).cast("string"))


class _JsonState(StatefulProcessor):
    """Keeps a small dictionary a key, those of a bucket together; subclasses give its first value and what a row does to it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "body string")

    def first(self) -> dict:
        raise NotImplementedError

    def row(self, state: dict, r) -> tuple | None:
        """Applies one row; gives an output row (without the key) or None."""
        raise NotImplementedError

    def rest(self, state: dict) -> tuple | None:
        """What would come out if the stream ended here."""
        raise NotImplementedError

    def late(self, r) -> tuple | None:
        """The output row (without the key) that reports a late row, or None."""
        return None

    position: str
    columns: list[str]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.state.get() if self.state.exists() else None
        states = json.loads(held[0]) if held else {}
        out = []
        many = pd.concat(list(rows)).sort_values(self.position, kind="stable")
        for name, mine in many.groupby(many["state_key"].fillna(""), sort=False):
            name, number = str(name), int(name) if name != "" else None
            state = states.setdefault(name, {**self.first(), "at": None})
            for r in mine.itertuples(index=False):
                at = int(getattr(r, self.position))
                if state["at"] is not None and at <= state["at"]:
                    made = self.late(r)
                else:
                    state["at"] = at
                    made = self.row(state, r)
                if made is not None:
                    out.append((number, *made))
            rest = self.rest(state)
            if rest is not None:
                out.append((number, *rest))
        self.state.update((json.dumps(states),))
        self.settle(states)
        yield pd.DataFrame(out, columns=self.columns)

    def settle(self, states: dict) -> None:
        """Called when a micro-batch of a bucket is done."""

    def close(self) -> None:
        pass


class _Keyframes(_JsonState):
    position, columns = "frame_index", ["lesson_id", "frame_index", "change", "kept", "late"]

    def __init__(self, p: KeyframeParams):
        self.p = p

    def first(self) -> dict:
        return new_keyframe_state()

    def row(self, state: dict, r) -> tuple | None:
        change = keep_step(state, int(r.frame_index), float(r.score), [int(x) for x in r.signature], self.p)
        return None if change is None else (int(r.frame_index), change, True, False)

    def rest(self, state: dict) -> tuple | None:
        return (state["best"][1], 1.0, False, False) if not state["kept"] and state["best"] else None

    def late(self, r) -> tuple | None:
        return int(r.frame_index), None, False, True


def stream_keyframes(frames: DataFrame, p: KeyframeParams | None = None) -> DataFrame:
    """lesson_id, frame_index, change, kept, late: kept frames, the best frame so far (kept false) of a lesson that kept none, and each frame that came after a later one of its lesson (late)."""
    return _bucketed(frames, "lesson_id").select("bucket", "state_key", "frame_index", "score", "signature").groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=_Keyframes(p or KeyframeParams()), outputStructType="lesson_id long, frame_index long, change double, kept boolean, late boolean", outputMode="Append", timeMode="None"
    )


def settled_keyframes(rows: DataFrame) -> DataFrame:
    """What the stream's output says once it has ended: kept frames, else the last best one of a lesson."""
    kept = rows.filter("kept").select("lesson_id", "frame_index", "change")
    last = rows.filter("not kept and not late").groupBy("lesson_id").agg(F.max_by(F.struct("frame_index", "change"), "frame_index").alias("b")).select("lesson_id", "b.*")
    return kept.unionByName(last.join(kept.select("lesson_id").distinct(), "lesson_id", "left_anti"))


def late_frames(rows: DataFrame) -> DataFrame:
    """lesson_id, late: frames that came too late to be judged, of the lessons that have any."""
    return rows.filter("late").groupBy("lesson_id").agg(F.count("*").alias("late"))


class _Silence(_JsonState):
    position, columns = "window_no", ["clip_id", "first", "last", "n", "sum_sq", "open"]

    def __init__(self, p: SpeechParams, rate: float):
        self.p, self.rate = p, rate
        window = max(0.01, p.window_sec)
        self.silent_needed = max(1, int(p.silence_sec / window))
        self.least = max(0.0, p.min_segment_sec)
        self.most = max(self.least if self.least > 0 else 0.1, p.max_segment_sec)

    def first(self) -> dict:
        return {"first": None, "last": None, "n": 0, "sum_sq": 0.0, "units": 0.0, "silent": 0, "speech": False}

    def row(self, state: dict, r) -> tuple | None:
        n, sum_sq = int(r.n), float(r.sum_sq)
        if state["n"] == 0:
            state["first"] = int(r.window_no)
        state["last"] = int(r.window_no)
        state["n"] += n
        state["sum_sq"] += sum_sq
        state["units"] += n / self.rate
        if (math.sqrt(sum_sq / n) if n else 0.0) >= self.p.threshold:
            state["silent"], state["speech"] = 0, True
        else:
            state["silent"] += 1
        flush = (state["speech"] and state["silent"] >= self.silent_needed and state["units"] >= self.least) or state["units"] >= self.most
        out = (state["first"], state["last"], state["n"], state["sum_sq"], False) if flush else None
        if flush or (not state["speech"] and state["units"] > self.p.drop_silence_sec):
            state.update(self.first())
        return out

    def rest_of(self, state: dict) -> tuple:
        return state["first"], state["last"], state["n"], state["sum_sq"]

    def rest(self, state: dict) -> tuple | None:
        return (*self.rest_of(state), True) if state["n"] else None


class _TimedSilence(_Silence):
    """Gives closed segments only: the last buffer of a clip is flushed by a timer, once the watermark has passed the clip's last window by a pause."""

    columns = ["clip_id", "first", "last", "n", "sum_sq", "late"]

    def __init__(self, p: SpeechParams, rate: float, pause_ms: int):
        super().__init__(p, rate)
        self.pause_ms = pause_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.handle = handle

    def first(self) -> dict:
        return super().first() | {"seen": 0}

    def row(self, state: dict, r) -> tuple | None:
        seen = max(state["seen"], int(r.ts_ms))
        out = super().row(state, r)
        state["seen"] = seen
        return out

    def late(self, r) -> tuple | None:
        return int(r.window_no), int(r.window_no), int(r.n), float(r.sum_sq), True

    def rest(self, state: dict) -> tuple | None:
        return None

    def settle(self, states: dict) -> None:
        """One timer a bucket, for the clip that is due first."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        due = [state["seen"] + self.pause_ms for state in states.values() if state["n"]]
        if due:
            self.handle.registerTimer(min(due))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        states, out = json.loads(self.state.get()[0]), []
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        for name, state in states.items():
            if state["n"] and state["seen"] + self.pause_ms <= now:
                out.append((int(name) if name else None, *self.rest_of(state), False))
                # the place is kept: a window that comes after the flush begins a segment, one from before it is late
                state.update(self.first())
        self.state.update((json.dumps(states),))
        self.settle(states)
        yield pd.DataFrame(out, columns=self.columns)


def stream_silence_segments(windows: DataFrame, p: SpeechParams | None = None, rate: float = 16_000, event_time: str | None = None, delay: str = "10 seconds", pause_sec: float = 5.0) -> DataFrame:
    """clip_id, first, last, n, sum_sq and a flag, for windows (clip_id, window_no, n, sum_sq).

    Without ``event_time`` the flag is open: such a row is the buffer after a micro-batch, flushed if the clip ends there.
    With it, only closed segments come out: a clip's last one once the watermark (``delay`` behind the newest window of
    any clip) is ``pause_sec`` past the clip's last window. The flag then is late: a window that came after a later one.
    """
    p = p or SpeechParams()
    if event_time is None:
        return _bucketed(windows, "clip_id").select("bucket", "state_key", "window_no", "n", "sum_sq").groupBy("bucket").transformWithStateInPandas(
            statefulProcessor=_Silence(p, rate), outputStructType="clip_id long, first long, last long, n long, sum_sq double, open boolean", outputMode="Append", timeMode="None"
        )
    timed = _bucketed(windows.withWatermark(event_time, delay), "clip_id").select("bucket", "state_key", "window_no", "n", "sum_sq", event_time, F.unix_millis(event_time).alias("ts_ms"))
    return timed.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=_TimedSilence(p, rate, int(pause_sec * 1000)), outputStructType="clip_id long, first long, last long, n long, sum_sq double, late boolean", outputMode="Append", timeMode="EventTime"
    )


def settled_segments(rows: DataFrame) -> DataFrame:
    """clip_id, seg_no, first, last, n, sum_sq once the stream has ended: closed segments and, of the form without event time, each clip's last buffer."""
    if "late" in rows.columns:
        every = rows.filter("not late").drop("late")
    else:
        closed = rows.filter("not open")
        ends = closed.groupBy("clip_id").agg(F.max("last").alias("closed_at"))
        tail = rows.filter("open").groupBy("clip_id").agg(F.max_by(F.struct("first", "last", "n", "sum_sq"), "last").alias("t")).select("clip_id", "t.*")
        every = closed.drop("open").unionByName(tail.join(ends, "clip_id", "left").filter("closed_at is null or last > closed_at").drop("closed_at"))
    return every.withColumn("seg_no", (F.row_number().over(Window.partitionBy("clip_id").orderBy("last")) - 1).cast("long"))


class _FirstPlace(StatefulProcessor):
    """Keeps the smallest place of each line of a bucket; a row comes out whenever it falls."""

    def __init__(self, memory: timedelta | None):
        self.memory = None if memory is None else int(memory.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        more = {} if self.memory is None else {"ttlDurationMs": self.memory}
        self.state = handle.getValueState("places", "body string", **more)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.state.get() if self.state.exists() else None
        now = 0 if self.memory is None else timerValues.getCurrentProcessingTimeInMs()
        # a line's place, its version, and when it changed
        places = {(x[0], x[1]): x[2:] for x in json.loads(held[0])} if held else {}
        if self.memory is not None:
            places = {k: v for k, v in places.items() if v[3] + self.memory > now}
        out, parts = [], None
        for part in rows:
            part = part if parts is None else pd.concat([parts, part])
            parts = part.sort_values(["frame_index", "line_no"], kind="stable").drop_duplicates(["state_key", "key"])
        for r in parts.itertuples(index=False):
            here, name = (int(r.frame_index), int(r.line_no)), (None if pd.isna(r.state_key) else r.state_key, r.key)
            was = places.get(name)
            if was is None or here < (was[0], was[1]):
                version = 0 if was is None else was[2] + 1
                places[name] = [*here, version, now]
                out.append((r.lesson_id, r.key, *here, r.line, version))
        if out:
            self.state.update((json.dumps([[*k, *v] for k, v in places.items()]),))
            yield pd.DataFrame(out, columns=["lesson_id", "key", "frame_index", "line_no", "line", "version"])

    def close(self) -> None:
        pass


#: Buckets of lines, of which there are more than there are lessons or clips.
LINE_BUCKETS = 4096


def stream_line_union(lines: DataFrame, memory: timedelta | None = None, buckets: int = LINE_BUCKETS) -> DataFrame:
    """lesson_id, key, frame_index, line_no, line, version: each line of a lesson at its smallest place so far, while frames arrive.

    A line's first sight has version 0; each later row of it is a correction, as an earlier place came in. State is one
    place a line, those of a bucket together (``buckets`` can't change between runs of one stream); with ``memory`` a line
    is forgotten after so long without a change (one seen again then starts anew).
    Such a stream goes by the clock, so run it with a processing-time trigger: with availableNow it doesn't end.
    """
    keyed = lines.withColumn("line", trimmed(F.col("line"))).withColumn("key", casefold_key(F.col("line"))).filter("key <> ''")
    kind = keyed.schema["lesson_id"].dataType.simpleString()
    dealt = _bucketed(keyed, "lesson_id", "key", buckets=buckets).select("bucket", "state_key", "lesson_id", "key", "frame_index", "line_no", "line")
    return dealt.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=_FirstPlace(memory), outputStructType=f"lesson_id {kind}, key string, frame_index long, line_no long, line string, version long", outputMode="Append", timeMode="None" if memory is None else "ProcessingTime"
    )


def settled_lines(rows: DataFrame) -> DataFrame:
    """lesson_id, frame_index, line_no, line once the stream has ended: the last correction of each line."""
    return rows.groupBy("lesson_id", "key").agg(F.min_by(F.struct("frame_index", "line_no", "line"), F.struct("frame_index", "line_no")).alias("l")).select("lesson_id", "l.*")
