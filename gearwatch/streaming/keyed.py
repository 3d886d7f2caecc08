"""Row-exact state per key: readings wait until the watermark has passed them, then each key goes on in the order of time.

Keys are dealt to ``BUCKETS`` groups by hash, and the state belongs to the group, as blocks of rows: a micro-batch reads and writes
the groups that it has rows or due timers for, and a call of the state store serves all their keys. Rows that are older than
the watermark are late and dropped by Spark; all others give the same result as the batch operators, in whatever order they
came. What is left ahead of the watermark is emitted once later rows move it.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from gearwatch import schemas as S
from gearwatch.operators import series
from gearwatch.streaming.jobs import STATE_STORE

#: Groups of keys that share one state.
BUCKETS = 1024
#: Rows of output that leave a task at once, and rows of one value of the state.
OUT_ROWS, STATE_ROWS = 4096, 16_384


def packed(rows: pd.DataFrame) -> list[tuple[bytes]]:
    """Rows as values of a list state, in blocks of at most ``STATE_ROWS``."""
    out = []
    for at in range(0, len(rows), STATE_ROWS):
        block = pa.Table.from_pandas(rows.iloc[at : at + STATE_ROWS], preserve_index=False)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, block.schema) as writer:
            writer.write_table(block)
        out.append((sink.getvalue().to_pybytes(),))
    return out


def unpacked(blocks: Iterable[tuple[bytes]], columns: Sequence[str]) -> pd.DataFrame:
    parts = [pa.ipc.open_stream(b[0]).read_all().to_pandas(integer_object_nulls=True) for b in blocks]
    return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=list(columns))


def key_codes(rows: pd.DataFrame, key: str) -> np.ndarray:
    """A number per key; null is a key like others."""
    return pd.factorize(rows[key], use_na_sentinel=False)[0]


class InOrder(StatefulProcessor):
    """Keeps rows (key, microseconds ``t``, then what breaks ties) until they are final and hands them to ``advance``.

    A row is final when the watermark has passed its millisecond. One timer per group of keys stands at the next such moment or
    at the next end of ``keep_micros`` of silence of a key, after which the key is forgotten.
    """

    def __init__(self, columns: Sequence[str], n_order: int, keep_micros: int | None):
        self.columns, self.key, self.n_order, self.keep_micros = list(columns), columns[0], n_order, keep_micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "rows binary")
        self.due = handle.getValueState("due", "due long")
        self.past = handle.getListState("past", "rows binary")

    def advance(self, past: pd.DataFrame, rows: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
        """Output for final rows, which come in order key by key, and what the next ones need of the past; both begin with key and ``t``."""
        raise NotImplementedError

    def wake(self, moment: int) -> None:
        """The timer of the group, moved forward to ``moment`` (milliseconds) if it stands later."""
        now = self.due.get()
        if now is None or moment < now[0]:
            if now is not None:
                self.handle.deleteTimer(now[0])
            self.handle.registerTimer(moment)
            self.due.update((moment,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            part = frame[self.columns]
            self.pending.appendList(packed(part))
            low = int(part["t"].min())
            first = low if first is None else min(first, low)
        if first is not None:
            self.wake(max(first // 1000 + 1, timerValues.getCurrentWatermarkInMs() + 1))
        return iter(())

    def sorted_by_key(self, rows: pd.DataFrame) -> pd.DataFrame:
        order = self.columns[1 : 1 + self.n_order]
        return rows.assign(_code=key_codes(rows, self.key)).sort_values(["_code", *order], kind="stable").drop(columns="_code").reset_index(drop=True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark, moments = timerValues.getCurrentWatermarkInMs(), []
        rows, past = unpacked(self.pending.get(), self.columns), unpacked(self.past.get(), self.columns)
        final = rows["t"].to_numpy("int64") // 1000 < mark
        ready, rest, known = rows[final], rows[~final], len(past)
        if len(rest):
            if len(ready):
                self.pending.put(packed(rest))
            moments.append(int(rest["t"].min()) // 1000 + 1)
        elif len(rows):
            self.pending.clear()
        out = ready
        if len(ready):
            out, past = self.advance(past, self.sorted_by_key(ready))
        if len(past) and self.keep_micros is not None:
            last = past.groupby(key_codes(past, self.key))["t"].transform("max").to_numpy("int64")
            ends = (last + self.keep_micros) // 1000 + 1
            past = past[ends > mark]  # the others were silent for long enough
            moments += [int(ends[ends > mark].min())] if len(past) else []
        if len(ready) or len(past) < known:
            if len(past):
                self.past.put(packed(past))
            else:
                self.past.clear()
        if moments:
            moment = max(min(moments), mark + 1)
            self.handle.registerTimer(moment)
            self.due.update((moment,))
        else:
            self.due.clear()
        for at in range(0, len(out), OUT_ROWS):
            yield out.iloc[at : at + OUT_ROWS]

    def close(self) -> None:
        pass


class RateLimit(InOrder):
    """At most ``max_calls`` accepted calls in the last ``period_micros``; the state holds the times of accepted ones.

    ``wait`` is how long a denied call had to wait for the next free place, in microseconds.
    """

    def __init__(self, columns, n_order, max_calls: int, period_micros: int):
        super().__init__(columns, n_order, period_micros)
        self.max_calls, self.period = max_calls, period_micros

    def advance(self, past: pd.DataFrame, rows: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
        times = [self.key, "t"]
        both = pd.concat([past[times], rows[times]], ignore_index=True) if len(past) else rows[times]
        codes, known = key_codes(both, self.key).tolist(), len(past)
        accepted: dict[int, deque] = {}
        for code, t in zip(codes[:known], past["t"].tolist()):
            accepted.setdefault(code, deque()).append(t)
        allowed, wait, period = [], [], self.period
        for code, t in zip(codes[known:], rows["t"].tolist()):
            own = accepted.setdefault(code, deque())
            while own and t - own[0] >= period:
                own.popleft()
            free = len(own) < self.max_calls
            allowed.append(free)
            wait.append(0 if free else own[0] + period - t)
            if free:
                own.append(t)
        names = dict(zip(codes, both[self.key].tolist()))
        kept = [(names[code], t) for code, own in accepted.items() for t in own]
        return rows.assign(allowed=allowed, wait=wait), pd.DataFrame(kept, columns=times)


class RowFeatures(InOrder):
    """E1-E4 of new readings; the state holds as many last readings of a machine as the widest feature reaches back."""

    def __init__(self, columns, n_order, sensors: Sequence[str], sizes: dict, keep_micros: int | None):
        super().__init__(columns, n_order, keep_micros)
        self.sensors, self.sizes = list(sensors), sizes
        self.depth = series.max_depth(**sizes)

    def advance(self, past: pd.DataFrame, rows: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
        both = pd.concat([past, rows], ignore_index=True) if len(past) else rows
        codes = key_codes(both, self.key)
        order = np.argsort(codes, kind="stable")  # a machine's past comes before its new readings
        both, codes, new = both.iloc[order].reset_index(drop=True), codes[order], order >= len(past)
        t, other = both["t"].to_numpy("int64"), np.diff(codes) != 0
        # A silence ends the series of a machine, whether its state was there when the next reading came or gone.
        cut = other if self.keep_micros is None else other | (np.diff(t) > self.keep_micros)
        heads = np.concatenate([[0], np.flatnonzero(cut) + 1])
        ends = np.concatenate([heads[1:], [len(both)]])
        at = np.arange(len(both))
        place, left = at - np.repeat(heads, ends - heads), np.repeat(ends, ends - heads) - at - 1
        last = np.repeat(np.concatenate([other, [True]])[ends - 1], ends - heads)  # whether a series is the last of its machine
        made = {}
        for s in self.sensors:
            made |= row_features(both[s].astype(float).to_numpy(), s, place=place, **self.sizes)
        return both[new].assign(**{c: v[new] for c, v in made.items()}), both[last & (left < max(self.depth, 1))]


def row_features(x: np.ndarray, sensor: str, lags=S.LAGS, means=S.ROLL_MEANS, stds=S.ROLL_STDS, slopes=S.SLOPES,
                 place: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """E1-E4 of series that follow each other, ``place`` being that of a value in its own one; undefined values are NaN."""
    place = np.arange(len(x)) if place is None else place

    def ago(k: int) -> np.ndarray:
        moved = np.concatenate([np.full(min(k, len(x)), np.nan), x[: max(len(x) - k, 0)]])
        return np.where(place >= k, moved, np.nan)

    def windows(k: int, f: str) -> np.ndarray:
        padded = np.concatenate([np.full(k - 1, np.nan), x])
        return np.where(place >= k - 1, getattr(np.lib.stride_tricks.sliding_window_view(padded, k), f)(1), np.nan)

    out = {f"{sensor}_lag_{k}h": ago(k) for k in lags}
    out |= {f"{sensor}_mean_{k}h": windows(k, "mean") for k in means}
    out |= {f"{sensor}_std_{k}h": windows(k, "std") for k in stds}
    out |= {f"{sensor}_slope_{k}h": (x - ago(k)) / k for k in slopes}
    return out


def _timed(stream: DataFrame, key: str, ts: str, tie: Sequence[str], keep: Sequence[str], late: str) -> tuple[DataFrame, list[str], str]:
    """The stream with its watermark and the group of its key, the columns of the state and their types."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")
    rows = stream.withWatermark(ts, late).withColumns({"t": F.unix_micros(ts), "_bucket": bucket})
    columns = list(dict.fromkeys([key, "t", *tie, *keep]))
    kinds = dict(rows.dtypes)
    return rows, columns, ", ".join(f"`{c}` {kinds[c]}" for c in columns)


def rate_limit(calls: DataFrame, max_calls: int = 30, period: float = 60.0, key: str = "key", ts: str = "datetime",
               tie: Sequence[str] = (), keep: Sequence[str] = (), late: str = "1 minute") -> DataFrame:
    """J7 as keyed state: (key, tie and ``keep`` columns, allowed, wait in seconds) of every call behind the watermark."""
    rows, columns, schema = _timed(calls, key, ts, tie, keep, late)
    out = rows.groupBy("_bucket").transformWithStateInPandas(
        statefulProcessor=RateLimit(columns, 1 + len(tie), max_calls, int(period * 1_000_000)),
        outputStructType=f"{schema}, allowed boolean, wait long", outputMode="Append", timeMode="EventTime")
    return out.select(key, *columns[2:], "allowed", (F.col("wait") / 1e6).alias("wait"))


def row_feature_stream(readings: DataFrame, sensors: Sequence[str], key: str = "machineID", ts: str = "datetime", tie: Sequence[str] = (),
                       late: str = "1 hour", forget_after: float | None = None, **sizes: Sequence[int]) -> DataFrame:
    """J4 as keyed state: (key, microseconds ``t``, tie, sensors, features) of every reading behind the watermark.

    A machine that is silent for ``forget_after`` hours starts anew.
    """
    rows, columns, schema = _timed(readings, key, ts, tie, sensors, late)
    names = row_features(np.zeros(1), "x", **sizes)
    made = ", ".join(f"`{s}{n[1:]}` double" for s in sensors for n in names)
    keep = None if forget_after is None else int(forget_after * series.HOUR)
    out = rows.groupBy("_bucket").transformWithStateInPandas(
        statefulProcessor=RowFeatures(columns, 1 + len(tie), sensors, sizes, keep),
        outputStructType=f"{schema}, {made}", outputMode="Append", timeMode="EventTime")
    doubles = {f"{s}{n[1:]}": F.when(~F.isnan(f"{s}{n[1:]}"), F.col(f"{s}{n[1:]}")) for s in sensors for n in names}
    return out.withColumns(doubles)
