"""Keyed streaming state: turns, conversations and frames.

Each processor holds a few numbers per key and reuses the batch rule, so a
stream and a batch over the same rows agree. Hot keys are bounded by what a
key is: one device's frames, one conversation, one turn.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from whofor.operators.conversation import FACTS, VERDICT_TYPE, VerdictChain
from whofor.operators.frames import (FLOOR_FRAMES, FLOOR_LEAST, FLOOR_MIN_SEEN, FLOOR_PERCENTILE,
                                     FLOOR_START, SEGMENT_TYPE, SENSITIVITY, SegmentSettings,
                                     SegmentState, advance)
from whofor.operators.signals import SignalSettings

TURN_TYPE = "turn string, would_skip boolean, latency_ms double, feature_ms double, verdict string, late boolean"
TURN_TIMEOUT_MS = 60_000


def _rows(batches: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    pdf = pd.concat(list(batches), ignore_index=True)
    return pdf.sort_values(order, kind="stable")


class TurnState(StatefulProcessor):
    """Assembles a turn from its events; emits it when the log has moved a minute past it.

    Each kept field carries the time and place of the event it came from and gives way only to a
    later one, so the order in which micro-batches bring events does not matter. What comes after a
    turn was emitted is emitted by itself, marked ``late``.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turn = handle.getValueState(
            "turn", "would_skip boolean, latency_ms double, feature_ms double, gate_ts long, "
                    "gate_ord long, said string, said_ts long, said_ord long, rejected boolean")

    def handleInputRows(self, key, rows, timerValues):
        known = self.turn.get()
        would, lat, feat, gts, gord, said, sts, sord, rejected = known if known is not None \
            else (None, None, None, None, None, None, None, None, False)
        for pdf in rows:
            for r in pdf.to_dict("records"):
                e, at = r["event"], (r["ts"].value, int(r["ord"]))
                if e == "gate_scored" and (gts is None or at >= (gts, gord)):
                    would, lat, feat, (gts, gord) = r["would_skip"], r["latency_ms"], r["feature_ms"], at
                elif e == "transcript_rejected":
                    rejected = True
                verdict = e.split("_", 1)[1] if e in ("intent_accepted", "intent_ignored") else \
                    "skipped" if e == "segment_dropped" and r["reason"] == "gate" else None
                if verdict and (sts is None or at >= (sts, sord)):
                    said, (sts, sord) = verdict, at
        self.turn.update((None if would is None else bool(would), lat, feat, gts, gord, said, sts, sord,
                          bool(rejected)))
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        self.handle.registerTimer(timerValues.getCurrentWatermarkInMs() + TURN_TIMEOUT_MS)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        would, lat, feat, gts, _, said, _, _, rejected = self.turn.get()
        self.turn.clear()
        verdict = said or ("no_transcript" if rejected else "unknown")
        if gts is not None or said or rejected:
            yield pd.DataFrame([(key[0], would, lat, feat, verdict, gts is None)],
                               columns=[c.split()[0] for c in TURN_TYPE.split(", ")])

    def close(self) -> None:
        pass


def stream_turn_parts(events: DataFrame, late: str = "60 seconds") -> DataFrame:
    """Turns and, marked ``late``, verdicts without their gate row, from an event stream
    ``turn, ts, ord, event, would_skip, latency_ms, ...``."""
    return (events.withWatermark("ts", late).groupBy("turn")
            .transformWithStateInPandas(TurnState(), TURN_TYPE, "Append", "EventTime"))


def stream_gate_turns(events: DataFrame, late: str = "60 seconds") -> DataFrame:
    """The turns that the gate scored."""
    return stream_turn_parts(events, late).where("not late").drop("late")


def stream_late_verdicts(events: DataFrame, late: str = "60 seconds") -> DataFrame:
    """The side table: verdicts of turns emitted before, or that the gate never scored."""
    return stream_turn_parts(events, late).where("late").select("turn", "verdict")


class Reordered(StatefulProcessor):
    """Rows of a key held back until the watermark passes them, then taken in event-time order.

    Rows wait in a list of their own fields, so what waits is bounded by what arrives within the
    watermark's delay. A timer stands at the earliest waiting row; once nothing waits, one stands
    ``idle_ms`` after the last row taken, and the key leaves the state when it goes off.
    """

    idle_ms = 25_000

    def __init__(self, fields: list[tuple[str, str]], place: str):
        self.fields, self.place = fields, place

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", ", ".join(f"`{n}` {t}" for n, t in [("__ms", "long"), *self.fields]))
        self.last = handle.getValueState("last", "ms long")
        self.begin(handle)

    def begin(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def take(self, key, rows: list[dict]):
        """Frames of results for rows that come in order."""
        raise NotImplementedError

    def forget(self) -> None:
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues):
        kept = []
        for pdf in rows:
            at = pdf["ts"].astype("int64") // (1000 if pdf["ts"].dtype == "datetime64[us]" else 1_000_000)
            names = [n for n, _ in self.fields]
            plain = pdf[names].astype(object).where(pdf[names].notna(), None)
            kept += [(int(ms), *map(_plain, row)) for ms, row in zip(at, plain.itertuples(index=False, name=None))]
        if kept:
            self.waiting.appendList(kept)
            self.alarm(min(r[0] for r in kept))
        yield from ()

    def alarm(self, ms: int) -> None:
        """One timer: the earliest of what waits."""
        known = list(self.handle.listTimers())
        if known and min(known) <= ms and self.waiting.exists():
            return
        for t in known:
            self.handle.deleteTimer(t)
        self.handle.registerTimer(ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs()
        rows = list(self.waiting.get()) if self.waiting.exists() else []
        ready = sorted((r for r in rows if r[0] <= passed), key=lambda r: (r[0], r[1 + self.at]))
        later = [r for r in rows if r[0] > passed]
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.waiting.clear()
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(min(r[0] for r in later))
        if ready:
            self.last.update((ready[-1][0],))
            names = [n for n, _ in self.fields]
            yield from self.take(key, [dict(zip(names, r[1:])) for r in ready])
        if not later:
            gone = (self.last.get() or (passed,))[0] + self.idle_ms
            if gone > passed:
                self.handle.registerTimer(gone)
            else:
                self.forget()
                self.last.clear()

    @property
    def at(self) -> int:
        return [n for n, _ in self.fields].index(self.place)

    def close(self) -> None:
        pass


def _plain(v):
    """A cell as state keeps it: lists for arrays, Python numbers for NumPy's."""
    if hasattr(v, "tolist"):
        v = v.tolist()
    return v


class OrderedConversation(Reordered):
    """Verdicts in event-time order; a verdict matters for 25 seconds, then the key is forgotten."""

    def __init__(self, fields, settings: SignalSettings = SignalSettings()):
        super().__init__(fields, "upos")
        self.settings = settings

    def begin(self, handle):
        self.recent = handle.getValueState("recent", "verdicts string")

    def forget(self):
        self.recent.clear()

    def take(self, key, rows):
        known = self.recent.get()
        chain = VerdictChain(self.settings, json.loads(known[0]) if known is not None else ())
        out = [(r["conv_id"], r["upos"], *chain.next(r)) for r in rows]
        self.recent.update((json.dumps(list(chain.recent)),))
        yield pd.DataFrame(out, columns=["conv_id", "upos", *[c.split()[0] for c in VERDICT_TYPE.split(", ")]])


class ConversationState(StatefulProcessor):
    """The last four verdicts of a conversation, and when the last was."""

    def __init__(self, settings: SignalSettings = SignalSettings()):
        self.settings = settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getValueState("recent", "verdicts string")

    def handleInputRows(self, key, rows, timerValues):
        known = self.recent.get()
        chain = VerdictChain(self.settings, json.loads(known[0]) if known is not None else ())
        pdf = _rows(rows, ["upos"])
        out = []
        for f in pdf[FACTS].to_dict("records"):
            out.append(chain.next(f))
        self.recent.update((json.dumps(list(chain.recent)),))
        verdicts = pd.DataFrame(out, columns=[c.split()[0] for c in VERDICT_TYPE.split(", ")])
        yield pd.concat([pdf[["conv_id", "upos"]].reset_index(drop=True), verdicts], axis=1)

    def close(self) -> None:
        pass


def stream_verdicts(prepared: DataFrame, settings: SignalSettings = SignalSettings(),
                    late: str | None = None) -> DataFrame:
    """Verdicts for a stream of prepared utterances (``conversation.prepare`` columns).

    With ``late`` rows carry an event time ``ts`` and may come out of order by so much; without,
    each micro-batch is taken as it comes.
    """
    out = f"conv_id long, upos long, {VERDICT_TYPE}"
    if late is None:
        return prepared.groupBy("conv_id").transformWithStateInPandas(ConversationState(settings), out, "Append", "None")
    fields = [(n, prepared.schema[n].dataType.simpleString()) for n in ["conv_id", "upos", *FACTS]]
    return prepared.select("ts", "conv_id", "upos", *FACTS).withWatermark("ts", late).groupBy("conv_id") \
        .transformWithStateInPandas(OrderedConversation(fields, settings), out, "Append", "EventTime")


class FrameState(StatefulProcessor):
    """Noise floor and open segment of one stream of frames."""

    def __init__(self, cfg: SegmentSettings = SegmentSettings()):
        self.cfg = cfg

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "levels string, segment string")

    def handleInputRows(self, key, rows, timerValues):
        pdf = _rows(rows, ["frame_idx"])[["at_s", "rms"]]
        yield from frame_steps(self.state, self.cfg, key, pdf["at_s"].to_numpy(), pdf["rms"].to_numpy())

    def close(self) -> None:
        pass


class OrderedFrames(Reordered):
    """Frames in event-time order; a stream that ended is forgotten after the longest silence."""

    def __init__(self, fields, cfg: SegmentSettings = SegmentSettings()):
        super().__init__(fields, "frame_idx")
        self.cfg, self.idle_ms = cfg, int(cfg.max_segment_ms)

    def begin(self, handle):
        self.state = handle.getValueState("state", "levels string, segment string")

    def forget(self):
        self.state.clear()

    def take(self, key, rows):
        yield from frame_steps(self.state, self.cfg, key, np.array([r["at_s"] for r in rows], dtype=float),
                               np.array([r["rms"] for r in rows], dtype=float))


def noise_floors(levels: np.ndarray, before: int, seen: int) -> np.ndarray:
    """The noise floor at each level after the first ``before``, over the last 100 levels up to it.

    ``seen`` levels of the stream came before ``levels``; the windows are taken in one array.
    """
    n = len(levels) - before
    padded = np.concatenate((np.full(FLOOR_FRAMES - 1, np.nan), levels))
    windows = np.lib.stride_tricks.sliding_window_view(padded, FLOOR_FRAMES)[before:]
    quiet = np.nanquantile(windows, FLOOR_PERCENTILE, axis=1) if n else np.zeros(0)
    return np.where(seen + before + np.arange(n) + 1 < FLOOR_MIN_SEEN, FLOOR_START, np.maximum(quiet, FLOOR_LEAST))


def frame_steps(state, cfg: SegmentSettings, key, at: np.ndarray, rms: np.ndarray):
    """Take frames in order: the levels kept and the open segment live in ``state``."""
    known = state.get()
    kept = json.loads(known[0]) if known is not None else []
    seg = SegmentState(**json.loads(known[1])) if known is not None else SegmentState()
    levels = np.concatenate((np.array(kept, dtype=float), rms.astype(float) + 1e-9))
    noise = noise_floors(levels, len(kept), 0)
    p = (np.log10(levels[len(kept):] / (noise * SENSITIVITY) + 1e-9) + 0.5) / 1.2
    done = [(key[0], *out) for out in (advance(seg, cfg, a, x) for a, x in zip(
        at.astype(float).tolist(), np.clip(p, 0.0, 1.0).tolist())) if out is not None]
    state.update((json.dumps(levels[-(FLOOR_FRAMES - 1):].tolist()), json.dumps(vars(seg))))
    if done:
        yield pd.DataFrame(done, columns=[c.split()[0] for c in SEGMENT_TYPE.split(", ")])


def stream_segments(frames: DataFrame, cfg: SegmentSettings = SegmentSettings(),
                    late: str | None = None) -> DataFrame:
    """Energy activity and segments from ``stream_id, frame_idx, at_s, rms`` as frames arrive.

    With ``late`` frames carry an event time ``ts`` and may come out of order by so much.
    """
    if late is None:
        return frames.groupBy("stream_id").transformWithStateInPandas(FrameState(cfg), SEGMENT_TYPE, "Append", "None")
    fields = [(n, frames.schema[n].dataType.simpleString()) for n in ("frame_idx", "at_s", "rms")]
    return frames.select("ts", "stream_id", "frame_idx", "at_s", "rms").withWatermark("ts", late).groupBy("stream_id") \
        .transformWithStateInPandas(OrderedFrames(fields, cfg), SEGMENT_TYPE, "Append", "EventTime")


class NewestLatencies(StatefulProcessor):
    """The ``n`` newest rows of a lane (``at, row_id, ms``), in any order of arrival."""

    def __init__(self, n: int, out: str):
        self.n, self.out = n, out

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getListState("ring", "at long, row_id long, ms double")

    def newest(self, rows) -> tuple[list, list]:
        """What the ring holds now, and what of it is new."""
        held = list(self.ring.get()) if self.ring.exists() else []
        came = [t for pdf in rows for t in pdf[["at", "row_id", "ms"]].dropna().itertuples(index=False, name=None)]
        came = [(int(a), int(r), float(m)) for a, r, m in came]
        now = sorted({(t[1], tuple(t)) for t in [*map(tuple, held), *came]}, key=lambda x: x[1], reverse=True)[:self.n]
        now = [t for _, t in now]
        self.ring.put(now)
        return now, sorted(set(now).intersection(came))

    def handleInputRows(self, key, rows, timerValues):
        now, new = self.newest(rows)
        if self.out == "rows":
            if new:
                yield pd.DataFrame(new, columns=["at", "row_id", "ms"])
        elif now:
            yield pd.DataFrame([(len(now), now[0][0], float(np.round(np.quantile([t[2] for t in now], 0.5), 1)))],
                               columns=["n", "newest_at", "p50_ms"])

    def close(self) -> None:
        pass


def stream_recent_latency(decisions: DataFrame, n: int = 200, lanes: int = 32) -> DataFrame:
    """The median of the newest ``n`` latencies after every micro-batch: ``n, newest_at, p50_ms``.

    ``decisions`` are ``at, row_id, ms`` (at orders, row_id tells rows apart). Each lane keeps its
    ``n`` newest and passes on what is new among them; one key merges at most ``lanes * n`` of those.
    State is ``n`` rows a lane, however long the stream runs.
    """
    kept = "at long, row_id long, ms double"
    lane = F.pmod(F.xxhash64("row_id"), F.lit(lanes)).cast("int").alias("lane")
    rings = decisions.select(lane, F.col("at").cast("long").alias("at"), F.col("row_id").cast("long").alias("row_id"),
                             F.col("ms").cast("double").alias("ms")).groupBy("lane") \
        .transformWithStateInPandas(NewestLatencies(n, "rows"), kept, "Append", "None")
    return rings.withColumn("all", F.lit(0)).groupBy("all").transformWithStateInPandas(
        NewestLatencies(n, "summary"), "n long, newest_at long, p50_ms double", "Append", "None")


def stream_live_stats(decisions: DataFrame, sink) -> object:
    """Running totals after every batch, handed to ``sink(batch_frame, batch_id)``."""
    from whofor.operators.shadow import live_totals
    totals = live_totals(decisions)
    return totals.writeStream.outputMode("complete").foreachBatch(sink)
