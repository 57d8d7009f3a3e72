"""Tick semantics on Structured Streaming.

Raw rows are reduced per tick by a watermarked window first (with a map-side
combine); only then do keyed processors see them. A processor therefore gets at
most one row per tick and key, however hot the key is. Rows later than the
watermark are dropped by the window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tickweave.functions.quotes import zscore


#: The column that carries the watermark from a window to a keyed processor.
EVENT_TIME = "event_time"
DAY_MS = 86_400_000
#: Rows of a frame that a processor hands on at once.
CHUNK = 65_536


def _width(grid_ms: int) -> str:
    return f"{grid_ms} milliseconds"


def trade_flow(trades: DataFrame, grid_ms: int, late: str = "10 minutes", by=("symbol", "day"), ts: str = "ts") -> DataFrame:
    """Tumbling flow; the label of a window is its end."""
    w = F.window(ts, _width(grid_ms))
    agg = trades.withWatermark(ts, late).groupBy(*by, w.alias("w")).agg(
        F.sum("signed_qty").alias("signed_volume"), F.sum("quantity").alias("abs_volume"), F.count(F.lit(1)).alias("trade_count")
    )
    return agg.select(*by, F.unix_millis("w.end").alias("tick"), "signed_volume", "abs_volume", "trade_count")


def last_quotes(quotes: DataFrame, grid_ms: int, cols, late: str = "10 minutes", by=("symbol", "day"), ts: str = "ts", seq="seq") -> DataFrame:
    """Newest row per tick by ``(ts, seq)``; a row on a tick belongs to that tick.

    The window is closed on its right side by moving time one millisecond back. ``EVENT_TIME``
    carries the watermark on, so that later operators can set timers.
    """
    shifted = quotes.withColumn("_t", F.col(ts) - F.expr("INTERVAL 1 MILLISECOND"))
    order = F.struct(F.col("ts_ms"), F.col(seq))
    agg = shifted.withWatermark("_t", late).groupBy(*by, F.window("_t", _width(grid_ms)).alias("w")).agg(
        F.max("ts_ms").alias("seen_ms"), *[F.max_by(c, order).alias(c) for c in cols]
    )
    return agg.select(*by, F.unix_millis("w.end").alias("tick"), "seen_ms", *cols, F.window_time("w").alias(EVENT_TIME))


class _FillTicks(StatefulProcessor):
    """Repeats the last row of a key for every tick up to the next one.

    State is the newest row: its tick, the last tick already given out, its values. A timer
    at the end of the key's day drops it. With ``silent_ms`` a key that sends no rows is
    filled by timers: each time the watermark has passed so much more time, and at the end
    of the day, up to the watermark.
    """

    def __init__(self, grid_ms: int, cols: list[str], keys: list[str], silent_ms: int | None):
        self.grid_ms, self.cols, self.keys, self.silent_ms = grid_ms, cols, keys, silent_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        fields = [T.StructField("tick", T.LongType()), T.StructField("done", T.LongType())]
        fields += [T.StructField(c, T.DoubleType()) for c in self.cols]
        self.last = handle.getValueState("last", T.StructType(fields))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        g = self.grid_ms
        new = _sorted(rows)
        tick, values = new["tick"].to_numpy(np.int64), new[self.cols].to_numpy(float)
        # a row exactly on its tick is final for that tick
        done = np.where(new["seen_ms"].to_numpy(np.int64) == tick, tick, tick - g)
        start = tick
        if self.last.exists():
            held = self.last.get()
            tick, start = np.insert(tick, 0, held[0]), np.insert(tick, 0, held[1] + g)
            done, values = np.insert(done, 0, held[1]), np.vstack([np.array(held[2:], float), values])
        stop = np.append(tick[1:] - g, done[-1])
        n = np.maximum((stop - start) // g + 1, 0)
        at = np.repeat(np.arange(len(tick)), n)
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        given = int(max(done[-1], start[-1] - g))
        self.last.update((int(tick[-1]), given, *_values(values[-1])))
        self._schedule(int(tick[-1]), given)
        yield from self._out(key, start[at] + step * g, values[at])

    def _schedule(self, tick: int, given: int) -> None:
        """One timer per key: the end of its day, or sooner the next filling of a silent key."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        end = _day_end(tick)
        self.handle.registerTimer(end if self.silent_ms is None else min(end, max(given, tick) + self.silent_ms))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.last.exists():
            return
        held, g = self.last.get(), self.grid_ms
        seen, end = timerValues.getCurrentWatermarkInMs(), _day_end(held[0])
        upto = min(seen, end - 1) // g * g if self.silent_ms is not None else held[1]
        values = np.array(held[2:], float)
        if seen >= end:
            yield from self._out(key, np.arange(held[1] + g, upto + 1, g), values, last=True)
            self._drop()
            return
        given = max(upto, held[1])
        ticks = np.arange(held[1] + g, given + 1, g)
        self.last.update((held[0], int(given), *_values(values)))
        self._schedule(held[0], given)
        yield from self._out(key, ticks, values)

    def _out(self, key, ts_ms: np.ndarray, values: np.ndarray, last: bool = False) -> Iterator[pd.DataFrame]:
        """Dense ticks with one row of values each, or the same row for all."""
        for i in range(0, len(ts_ms), CHUNK):
            part = ts_ms[i : i + CHUNK]
            own = values[i : i + CHUNK] if values.ndim == 2 else np.broadcast_to(values, (len(part), len(values)))
            yield _keyed(self.keys, key, {"ts_ms": part, **dict(zip(self.cols, own.T))})

    def _drop(self) -> None:
        self.last.clear()

    def close(self) -> None:
        pass


def _values(row) -> list[float | None]:
    return [None if v != v else float(v) for v in row]


def _day_end(tick: int) -> int:
    """The first tick after the day of ``tick``; a tick at midnight closes the day before."""
    return (tick - 1) // DAY_MS * DAY_MS + DAY_MS + 1


def _sorted(rows: Iterator[pd.DataFrame], by="tick") -> pd.DataFrame:
    """The rows of one key in one micro-batch: one per tick, by tick."""
    return pd.concat(list(rows), ignore_index=True).sort_values(by, ignore_index=True)


def _keyed(names, key, columns: dict) -> pd.DataFrame:
    out = pd.DataFrame(columns)
    for i, (n, k) in enumerate(zip(names, key)):
        out.insert(i, n, [k] * len(out))
    return out


def fill_ticks(ticks: DataFrame, grid_ms: int, cols, by=("symbol", "day"), silent_ms: int | None = None) -> DataFrame:
    """Dense ticks per key up to the newest complete one; a key ends with its last row.

    With ``silent_ms`` a silent key goes on to the end of its day, at least that often once the
    watermark has passed. Either way the state of a key goes when the watermark leaves its day.
    """
    by = list(by)
    schema = T.StructType(
        [ticks.schema[k] for k in by] + [T.StructField("ts_ms", T.LongType())] + [T.StructField(c, T.DoubleType()) for c in cols]
    )
    return _processed(ticks, by, _FillTicks(grid_ms, list(cols), by, silent_ms), schema)


def _processed(ticks: DataFrame, by: list[str], processor: StatefulProcessor, schema: T.StructType) -> DataFrame:
    return ticks.groupBy(*by).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime"
    )


def window_sums(x: np.ndarray, n: int) -> np.ndarray:
    """Sums of the last ``n`` values at every place, NaN where fewer stand before it or one is missing.

    A window spans at most two blocks of ``n``: the end of one and the start of the next, each
    summed on its own as in a queue of two stacks. Nothing is taken off a running total, so
    what has left a window leaves no rest in its sum.
    """
    blocks = np.pad(np.asarray(x, float), (0, -len(x) % n)).reshape(-1, n)
    head = blocks.cumsum(1).ravel()
    tail = blocks[:, ::-1].cumsum(1)[:, ::-1].ravel()
    out = np.full(len(x), np.nan)
    at = np.arange(n - 1, len(x))
    whole = (at + 1) % n == 0
    out[at] = np.where(whole, head[at], tail[at - n + 1] + head[at])
    return out


class _FilledFeatures(_FillTicks):
    """Log return and realised volatility of the filled price; state is also the last prices and squared returns."""

    def __init__(self, grid_ms: int, price: str, keys: list[str], silent_ms: int | None, ticks: int, windows: dict[str, int]):
        super().__init__(grid_ms, [price], keys, silent_ms)
        self.ticks, self.windows = ticks, windows

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        pair = [T.StructField("price", T.DoubleType()), T.StructField("square", T.DoubleType())]
        self.ring = handle.getListState("ring", T.StructType(pair))

    def _out(self, key, ts_ms: np.ndarray, values: np.ndarray, last: bool = False) -> Iterator[pd.DataFrame]:
        longest = max(self.ticks, 1, *self.windows.values())
        old = np.array([tuple(x) for x in self.ring.get()] if self.ring.exists() else [], float).reshape(-1, 2)
        for i in range(0, len(ts_ms), CHUNK):
            part = ts_ms[i : i + CHUNK]
            raw = values[i : i + CHUNK, 0] if values.ndim == 2 else np.full(len(part), values[0])
            price = np.append(old[:, 0], np.where(raw > 0, raw, np.nan))
            square = np.append(old[:, 1], np.log(price[len(old) :] / _lagged(price, 1)[len(old) :]) ** 2)
            out = {"ts_ms": part, self.cols[0]: raw, f"{self.cols[0]}_log_ret": np.log(price / _lagged(price, self.ticks))[len(old) :]}
            out |= {f"realized_vol_{k}": np.sqrt(window_sums(square, n)[len(old) :]) for k, n in self.windows.items()}
            old = np.column_stack([price, square])[-longest:]
            yield _nulls(_keyed(self.keys, key, out))
        if len(ts_ms) and not last:
            self.ring.put([(float(p), float(s)) for p, s in old])

    def _drop(self) -> None:
        super()._drop()
        self.ring.clear()


def _lagged(x: np.ndarray, n: int) -> np.ndarray:
    return np.append(np.full(min(n, len(x)), np.nan), x[: max(len(x) - n, 0)])


def _nulls(frame: pd.DataFrame) -> pd.DataFrame:
    """NaN to null; ticks stay whole numbers."""
    return frame.astype(object).where(frame.notna(), None).astype({"ts_ms": "int64"})


def price_features(
    ticks: DataFrame, grid_ms: int, windows: dict[str, int], return_ticks: int, price: str = "micro_price", by=("symbol", "day"),
    silent_ms: int | None = None,
) -> DataFrame:
    """Log return over ``return_ticks`` and realised volatility over ``windows``, on the dense ticks of :func:`fill_ticks`.

    A price that is missing or not positive has no return; a window needs all its returns.
    """
    by, names = list(by), [price, f"{price}_log_ret", *[f"realized_vol_{k}" for k in windows]]
    schema = T.StructType(
        [ticks.schema[k] for k in by] + [T.StructField("ts_ms", T.LongType())] + [T.StructField(c, T.DoubleType()) for c in names]
    )
    return _processed(ticks, by, _FilledFeatures(grid_ms, price, by, silent_ms, return_ticks, dict(windows)), schema)


class _RollingFlow(StatefulProcessor):
    """Sums over the last N ticks; state is the non-empty ticks of the longest window."""

    def __init__(self, grid_ms: int, windows: dict[str, int], keys: list[str]):
        self.grid_ms, self.windows, self.keys = grid_ms, windows, keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        bucket = [T.StructField("tick", T.LongType()), T.StructField("signed", T.DoubleType()), T.StructField("total", T.DoubleType())]
        self.ring = handle.getListState("ring", T.StructType(bucket))
        self.span = handle.getValueState("span", T.StructType([T.StructField("first", T.LongType()), T.StructField("next", T.LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        g, longest = self.grid_ms, max(self.windows.values())
        new = _sorted(rows)
        old = [tuple(x) for x in self.ring.get()] if self.ring.exists() else []
        tick = np.concatenate([np.array([b[0] for b in old], np.int64), new["tick"].to_numpy(np.int64)])
        signed = np.concatenate([[b[1] for b in old], new["signed_volume"].to_numpy(float)])
        total = np.concatenate([[b[2] for b in old], new["abs_volume"].to_numpy(float)])
        first, begin = tuple(self.span.get()) if self.span.exists() else (int(tick[0]), int(tick[0]))
        # ticks before the newest bucket are final now
        t = np.arange(begin, tick[-1], g, dtype=np.int64)
        run_signed, run_total = np.append(0.0, signed.cumsum()), np.append(0.0, total.cumsum())
        hi = np.searchsorted(tick, t, side="right")
        out = {"ts_ms": t}
        for name, n in self.windows.items():
            lo = np.searchsorted(tick, t - n * g, side="right")
            full = (t - first) // g + 1 >= n
            s, a = run_signed[hi] - run_signed[lo], run_total[hi] - run_total[lo]
            busy = (hi > lo) & (a > 0)
            out[f"ofi_{name}"] = np.where(full, s, np.nan)
            out[f"trade_flow_imb_{name}"] = np.where(full, np.divide(s, a, out=np.zeros_like(s), where=busy), np.nan)
        keep = tick > tick[-1] - longest * g
        self.ring.put(list(zip(tick[keep].tolist(), signed[keep].tolist(), total[keep].tolist())))
        self.span.update((first, int(tick[-1])))
        frame = _keyed(self.keys, key, out)
        yield frame.astype(object).where(frame.notna(), None).astype({"ts_ms": "int64"})

    def close(self) -> None:
        pass


def rolling_flow(flow: DataFrame, grid_ms: int, windows: dict[str, int], by=("symbol", "day")) -> DataFrame:
    """Rolling order flow and imbalance on dense ticks, from the tumbling flow."""
    by = list(by)
    fields = [flow.schema[k] for k in by] + [T.StructField("ts_ms", T.LongType())]
    for name in windows:
        fields += [T.StructField(f"ofi_{name}", T.DoubleType()), T.StructField(f"trade_flow_imb_{name}", T.DoubleType())]
    return flow.groupBy(*by).transformWithStateInPandas(
        statefulProcessor=_RollingFlow(grid_ms, dict(windows), by), outputStructType=T.StructType(fields), outputMode="Append",
        timeMode="None",
    )


class _PriceAlerts(StatefulProcessor):
    """Jumps, crashes and the pause after a crash on the filled price of a symbol, over all its days.

    State is the newest row, the last prices as far as the longer move looks back, and the
    tick of the last crash, which holds its pause. With ``forget_ms`` a timer drops the state of
    a symbol that has been silent for so long.
    """

    def __init__(self, grid_ms: int, price: str, keys: list[str], moves: tuple, cooldown_ms: int, forget_ms: int | None):
        self.grid_ms, self.price, self.keys, self.forget_ms = grid_ms, price, keys, forget_ms
        (self.jump, self.jump_n), (self.crash, self.crash_n) = moves
        self.cooldown_ms = cooldown_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        whole = [T.StructField(c, T.LongType()) for c in ("tick", "done", "day", "crash_at")]
        self.last = handle.getValueState("last", T.StructType([*whole, T.StructField("price", T.DoubleType())]))
        self.ring = handle.getListState("ring", T.StructType([T.StructField("price", T.DoubleType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        g = self.grid_ms
        new = _sorted(rows, ["tick", "day"])
        tick, price = new["tick"].to_numpy(np.int64), new[self.price].to_numpy(float)
        day = pd.to_datetime(new["day"]).to_numpy("datetime64[D]").astype(np.int64)
        done = np.where(new["seen_ms"].to_numpy(np.int64) == tick, tick, tick - g)
        start, crash_at = tick, None
        if self.last.exists():
            held_tick, held_done, held_day, crash_at, held_price = self.last.get()
            tick, start, done = np.insert(tick, 0, held_tick), np.insert(start, 0, held_done + g), np.insert(done, 0, held_done)
            day, price = np.insert(day, 0, held_day), np.insert(price, 0, np.nan if held_price is None else held_price)
        # a row lasts up to the next one of its day; the last of a day ends with itself
        stop = np.append(np.where(day[1:] == day[:-1], tick[1:] - g, done[:-1]), done[-1])
        n = np.maximum((stop - start) // g + 1, 0)
        given = int(max(done[-1], start[-1] - g))
        ends = np.cumsum(n)
        old = np.array([x[0] for x in self.ring.get()] if self.ring.exists() else [], float)
        for first in range(0, int(ends[-1]), CHUNK):
            at = np.arange(first, min(first + CHUNK, int(ends[-1])))
            row = np.searchsorted(ends, at, "right")
            ts = start[row] + (at - (ends - n)[row]) * g
            prices = np.append(old, price[row])
            jump, crash = (self._move(prices, k)[len(old) :] for k in (self.jump_n, self.crash_n))
            crash = crash <= -self.crash
            last = np.maximum.accumulate(np.append(_NEVER if crash_at is None else crash_at, np.where(crash, ts, _NEVER)))
            crash_at = None if last[-1] == _NEVER else int(last[-1])
            blocked = (last[1:] != _NEVER) & (ts - last[1:] <= self.cooldown_ms)
            old = prices[-max(self.jump_n, self.crash_n) :]
            days = day[row].astype("datetime64[D]").astype(object)
            yield _keyed(self.keys, key, {"day": days, "ts_ms": ts, "price_jump": np.abs(jump) > self.jump, "crash": crash, "blocked": blocked})
        self.ring.put([(float(p),) for p in old])
        self.last.update((int(tick[-1]), given, int(day[-1]), crash_at, *_values(price[-1:])))
        if self.forget_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int(tick[-1]) + self.forget_ms)

    @staticmethod
    def _move(price: np.ndarray, n: int) -> np.ndarray:
        before = _lagged(price, n)
        return np.divide(price, before, out=np.full(len(price), np.nan), where=before != 0) - 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        self.ring.clear()
        yield from ()

    def close(self) -> None:
        pass


_NEVER = np.iinfo(np.int64).min


def price_alerts(
    ticks: DataFrame, grid_ms: int, jump: float, jump_ms: int, crash: float, crash_ms: int, cooldown_ms: int, price: str = "mid",
    by=("symbol",), forget_ms: int | None = None,
) -> DataFrame:
    """``price_jump``, ``crash`` and ``blocked`` per dense tick, as the batch operator of that name; midnight is no border.

    ``ticks`` are those of :func:`last_quotes` by symbol and ``day``.
    """
    by = list(by)
    moves = (jump, max(jump_ms // grid_ms, 1)), (crash, max(crash_ms // grid_ms, 1))
    flags = [T.StructField(c, T.BooleanType()) for c in ("price_jump", "crash", "blocked")]
    schema = T.StructType([ticks.schema[k] for k in by] + [ticks.schema["day"], T.StructField("ts_ms", T.LongType()), *flags])
    return _processed(ticks, by, _PriceAlerts(grid_ms, price, by, moves, cooldown_ms, forget_ms), schema)


class _BreachRuns(StatefulProcessor):
    """Flags the k-th and later values in a row above ``hi`` or below ``lo``; state is the last k - 1 values.

    Of the rows of a micro-batch only ticks and values are held, 16 bytes each; sorted chunks of
    them are flagged and handed on, with the last k - 1 values carried from chunk to chunk.
    """

    def __init__(self, hi: float, lo: float, k: int, keys: list[str]):
        self.hi, self.lo, self.k, self.keys = hi, lo, k, keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getListState("recent", T.StructType([T.StructField("value", T.DoubleType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        parts = [(f["tick"].to_numpy(np.int64), f["value"].to_numpy(float)) for f in rows]
        tick, value = (np.concatenate(x) for x in zip(*parts, strict=True))
        parts.clear()
        order = np.argsort(tick, kind="stable")
        carry = np.array([x[0] for x in self.recent.get()] if self.recent.exists() else [], float)
        for i in range(0, len(order), CHUNK):
            at = order[i : i + CHUNK]
            v = np.append(carry, value[at])
            breach = (_in_a_row(v > self.hi, self.k) | _in_a_row(v < self.lo, self.k))[len(carry) :]
            carry = v[len(v) - min(len(v), self.k - 1) :]
            yield _keyed(self.keys, key, {"tick": tick[at], "breach": breach})
        if self.k > 1:
            self.recent.put([(float(x),) for x in carry])

    def close(self) -> None:
        pass


def _in_a_row(hit: np.ndarray, k: int) -> np.ndarray:
    """Whether a place and the ``k - 1`` before it are all hits."""
    place = np.arange(len(hit))
    return place - np.maximum.accumulate(np.where(hit, -1, place)) >= k


def breach_runs(ticks: DataFrame, hi: float, lo: float, k: int, by=("symbol",)) -> DataFrame:
    by = list(by)
    schema = T.StructType([ticks.schema[c] for c in by] + [T.StructField("tick", T.LongType()), T.StructField("breach", T.BooleanType())])
    return ticks.groupBy(*by).transformWithStateInPandas(
        statefulProcessor=_BreachRuns(hi, lo, k, by), outputStructType=schema, outputMode="Append", timeMode="None"
    )


def moments(df: DataFrame, cols, by=("symbol",)) -> DataFrame:
    """Running mean and population deviation; run in update mode."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in cols:
        aggs += [F.avg(c).alias(f"mean_{c}"), F.stddev_pop(c).alias(f"std_{c}")]
    return df.groupBy(*by).agg(*aggs)


def live_zscore(df: DataFrame, wide_stats: DataFrame, features, clip: float, by=("symbol",), known: str | None = None) -> DataFrame:
    """Stream-static join with the statistics table, then z-score and clip.

    A row of a key without statistics stops the query. With ``known`` it stays instead,
    with missing features and ``false`` in the column of that name, for a reject sink.
    """
    found = F.lit(True).alias("_known")
    joined = df.join(wide_stats.select("*", found), list(by), "left")
    if known is None:
        missing = F.raise_error(F.concat_ws(" ", F.lit("no statistics for"), *[F.col(c).cast("string") for c in by]))
        first = features[0]
        joined = joined.withColumn(first, F.when(F.col("_known"), F.col(first)).otherwise(missing.cast("double")))
    else:
        joined = joined.withColumn(known, F.coalesce("_known", F.lit(False)))
        df = joined.select(*df.columns, known)
    cols = {f: zscore(F.col(f), F.col(f"mean_{f}"), F.col(f"std_{f}"), clip) for f in features}
    return joined.withColumns(cols).select(*df.columns)


def quality_split(good: Column):
    """Two sinks for one micro-batch: rows that pass and rows that do not."""
    ok = F.coalesce(good, F.lit(False))

    def split(frame: DataFrame) -> dict[str, DataFrame]:
        return {"passed": frame.where(ok), "rejected": frame.where(~ok)}

    return split
