"""Rules in which a row's outcome depends on the outcomes just before it, read in parallel.

A verdict depends on the last four verdicts of its episode, each yes, no or undecided. What a row
does to them is a map over those 81 states, and maps compose: pieces of an episode are composed
apart, one scan over the pieces' maps gives the state each begins in, and every piece is then read
from its own beginning. No task holds more than a piece and no row is stepped through in Python:
NumPy takes one row of every piece at a time.

A verdict that never came counts as yes: neither rule that looks back is set off by a yes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, IntegerType, StructField, StructType

DEPTH = 4
STATES = 3 ** DEPTH
YES, NO, OPEN = 0, 1, 2
PIECE = 256
_PAST = np.stack([np.arange(STATES) // 3 ** (DEPTH - 1 - k) % 3 for k in range(DEPTH)])
_LAST_NO = _PAST[0] == NO
_NOT_YES = _PAST != YES
_POWER = 3 ** np.arange(8)


def flags(state: np.ndarray, rows: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether, in these states, an exchange goes on and the whole or the tail was not answered."""
    exchange = _LAST_NO[state] & rows["near"]
    whole, tail = np.zeros(state.shape, dtype=bool), np.zeros(state.shape, dtype=bool)
    for k in range(DEPTH):
        open_ = _NOT_YES[k][state]
        whole |= open_ & (rows["whole"] >> k & 1).astype(bool)
        tail |= open_ & (rows["tail"] >> k & 1).astype(bool)
    return exchange, whole, tail


def after(state: np.ndarray, rows: dict[str, np.ndarray]) -> np.ndarray:
    """The states that follow; ``outcomes`` holds a row's verdict for each of the eight flag settings."""
    exchange, whole, tail = flags(state, rows)
    verdict = rows["outcomes"] // _POWER[4 * exchange + 2 * whole + tail] % 3
    return verdict * 3 ** (DEPTH - 1) + state // 3


def runs(columns: list) -> np.ndarray:
    """Where runs of equal keys begin in a batch, and its end."""
    turn = np.zeros(max(len(columns[0]) - 1, 0), dtype=bool)
    for c in columns:
        turn |= ~pc.fill_null(pc.equal(c[1:], c[:-1]), True).to_numpy(zero_copy_only=False) \
            if len(c) > 1 else turn
    return np.concatenate(([0], np.flatnonzero(turn) + 1, [len(columns[0])]))


def _rows(batch: pa.RecordBatch, fields: list[str]) -> dict[str, np.ndarray]:
    return {f: batch.column(f).to_numpy(zero_copy_only=False) for f in fields}


def _same(a: pa.RecordBatch | None, b: pa.RecordBatch) -> bool:
    return a is not None and a.equals(b)


FIELDS = ["near", "whole", "tail", "outcomes"]
FLAGS = ["human_exchange", "again_whole", "again_tail"]


def _lockstep(starts: np.ndarray, facts: dict[str, np.ndarray], state: np.ndarray, seen) -> np.ndarray:
    """Take the i-th row of every run, for all runs at once; ``seen(rows, states before, facts)``."""
    size = np.diff(starts)
    for i in range(int(size.max(initial=0))):
        live = np.flatnonzero(size > i)
        at = starts[live] + i
        rows = {f: x[at] if state.ndim == 1 else x[at][:, None] for f, x in facts.items()}
        seen(at, state[live], rows)
        state[live] = after(state[live], rows)
    return state


def piece_maps(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, piece, map``: what each piece does to each of the states."""
    group = [*keys, "piece"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            starts = runs([batch.column(k) for k in group])
            first = batch.select(group).take(pa.array(starts[:-1]))
            state = np.tile(np.arange(STATES), (len(starts) - 1, 1))
            if _same(last, first.slice(0, 1)):
                state[0] = held
            elif last is not None:
                yield out(last, held[None])
            state = _lockstep(starts, _rows(batch, FIELDS), state, lambda *_: None)
            if len(state) > 1:
                yield out(first.slice(0, len(state) - 1), state[:-1])
            last, held = first.slice(len(state) - 1), state[-1]
        if last is not None:
            yield out(last, held[None])

    def out(found: pa.RecordBatch, maps: np.ndarray) -> pa.RecordBatch:
        packed = pa.array([m.astype(np.uint8).tobytes() for m in maps], pa.binary())
        return pa.RecordBatch.from_arrays([*found.columns, packed], [*group, "map"])
    return rows.select(*group, "place", *FIELDS).repartition(*group).sortWithinPartitions(*group, "place") \
        .mapInArrow(run, StructType([*[rows.schema[k] for k in group], StructField("map", BinaryType())]))


def piece_starts(maps: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, piece, start``: the state each piece begins in, by one scan over the pieces' maps.

    Only keys of several pieces are scanned; the first piece of a key begins in state 0.
    """
    several = maps.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, now = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            starts = runs([batch.column(k) for k in keys])
            maps, out = batch.column("map").to_pylist(), np.zeros(batch.num_rows, dtype=np.int32)
            for lo, hi in zip(starts.tolist(), starts[1:].tolist()):
                key = batch.select(keys).slice(lo, 1)
                now = now if _same(last, key) else 0
                for i in range(lo, hi):
                    out[i], now = now, maps[i][now]
                last = key
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k) for k in [*keys, "piece"]], pa.array(out)], [*keys, "piece", "start"])
    return maps.join(several, keys, "left_semi").repartition(*keys).sortWithinPartitions(*keys, "piece") \
        .mapInArrow(run, StructType([*[maps.schema[k] for k in [*keys, "piece"]], StructField("start", IntegerType())]))


def settled_flags(rows: DataFrame, starts: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the flags that held at each: ``human_exchange``, ``again_whole``, ``again_tail``.

    The beginnings travel as rows of their own in front of their pieces, so rows move once.
    """
    group = [*keys, "piece"]
    keep = [c for c in rows.columns if c not in ("place", *FIELDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            begin = runs([batch.column(k) for k in group])
            first = batch.select(group).take(pa.array(begin[:-1]))
            state = pc.fill_null(batch.column("start"), 0).to_numpy()[begin[:-1]].astype(np.int64)
            if _same(last, first.slice(0, 1)):
                state[0] = held
            real = batch.column("start").is_null()
            batch = batch.filter(real)
            begin = np.concatenate(([0], np.cumsum(real.to_numpy(zero_copy_only=False))))[begin]
            found = np.zeros((3, batch.num_rows), dtype=bool)

            def seen(at, before, facts):
                found[:, at] = flags(before, facts)
            state = _lockstep(begin, _rows(batch, FIELDS), state, seen)
            last, held = first.slice(len(state) - 1), state[-1]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in keep], *map(pa.array, found)],
                                             [*keep, *FLAGS])
    marks = starts.withColumn("place", F.lit(-1).cast(rows.schema["place"].dataType))
    full = rows.unionByName(marks, allowMissingColumns=True)
    return full.repartition(*group).sortWithinPartitions(*group, "place").mapInArrow(
        run, StructType([*[full.schema[c] for c in keep], *[StructField(n, BooleanType()) for n in FLAGS]]))
