"""Streaming bars and signals."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import kernels

BARS = "symbol string, seq bigint, ts timestamp_ntz, open double, high double, low double, close double, volume double"


def stream_time_bars(ticks: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """OHLCV per symbol and time window of a tick stream (symbol, ts, seq, price, volume); a window is final when the watermark passes."""
    at = F.struct("ts", "seq")
    timed = ticks.withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks need a time with a zone
    out = timed.withWatermark("ts", late).groupBy("symbol", F.window("ts", width).alias("w")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("volume").alias("volume"),
    )
    return out.select("symbol", F.col("w.start").cast("timestamp_ntz").alias("ts"), "open", "high", "low", "close", "volume")


class DollarBars(StatefulProcessor):
    """Per symbol: the last ``rows`` dollar volumes with their sum, and the open bar. The first ``rows`` ticks wait for the first full
    sum and are then scanned with it, as the batch operator does."""

    def __init__(self, rows: int = 210, divisor: int = 300) -> None:
        self.rows, self.divisor = rows, divisor

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("bars", "run array<bigint>, total bigint, seen bigint, cum bigint, bar bigint, o double, h double, l double, v double")
        self.waiting = handle.getListState("waiting", "ts timestamp_ntz, price double, volume double, dv bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        got = pd.concat(list(rows), ignore_index=True).sort_values("seq", kind="stable")
        now = self.state.get() if self.state.exists() else None
        run, total, seen, cum, bar, o, h, low, v = (list(now[0]), *now[1:]) if now else ([], 0, 0, 0, 0, None, None, None, 0.0)
        out = []
        queue = [tuple(x) for x in self.waiting.get()] if self.waiting.exists() and seen < self.rows else []

        def step(ts, price, volume, dv):
            nonlocal cum, bar, o, h, low, v
            o, h, low, v = (price, price, price, volume) if o is None else (o, max(h, price), min(low, price), v + volume)
            cum += dv
            if self.divisor * cum >= total:
                bar += 1
                out.append((key[0], bar, ts, o, h, low, price, v))
                cum, o, h, low, v = 0, None, None, None, 0.0

        for ts, price, volume, dv in got[["ts", "price", "volume", "dv"]].itertuples(index=False):
            run.append(int(dv))
            total += int(dv)
            seen += 1
            if len(run) > self.rows:
                total -= run.pop(0)
            queue.append((ts, float(price), float(volume), int(dv)))
            if seen >= self.rows:
                for tick in queue:
                    step(*tick)
                queue = []
        self.state.update((run, total, seen, cum, bar, o, h, low, v))
        if queue:
            self.waiting.put(queue)
        else:
            self.waiting.clear()
        if out:
            yield pd.DataFrame(out, columns=[x.split()[0] for x in BARS.split(", ")])

    def close(self) -> None:
        pass


class TimedDollarBars(DollarBars):
    """The same by event time: ticks wait in spans of ``span_ms`` until the watermark has passed a span's end, and are then scanned in order of time
    and number. A span's ticks are what is held at once. Ticks later than the watermark are dropped before they come here."""

    def __init__(self, rows: int = 210, divisor: int = 300, span_ms: int = 3_600_000) -> None:
        super().__init__(rows, divisor)
        self.span_ms = span_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.handle = handle
        self.spans = handle.getMapState("spans", "span bigint", "ticks array<struct<us: bigint, seq: bigint, price: double, volume: double, dv: bigint>>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        for frame in rows:
            for m, part in frame.groupby(frame["us"] // (self.span_ms * 1000)):
                ticks = [(int(t), int(q), float(p), float(v), int(d)) for t, q, p, v, d in part[["us", "seq", "price", "volume", "dv"]].itertuples(index=False)]
                if self.spans.containsKey((int(m),)):
                    ticks = [tuple(x) for x in self.spans.getValue((int(m),))[0]] + ticks
                else:
                    self.handle.registerTimer((int(m) + 1) * self.span_ms)
                self.spans.updateValue((int(m),), (ticks,))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """The span that ends at this timer is complete; a key's timers come in order of time."""
        span = (expiredTimerInfo.getExpiryTimeInMs() // self.span_ms - 1,)
        ticks = pd.DataFrame([tuple(x) for x in self.spans.getValue(span)[0]], columns=["us", "seq", "price", "volume", "dv"]).sort_values(["us", "seq"])
        self.spans.removeKey(span)
        ticks = ticks.assign(ts=pd.to_datetime(ticks["us"], unit="us"), seq=range(len(ticks)))  # in order already; the scan sorts by seq
        yield from super().handleInputRows(key, iter([ticks]), timerValues)


def stream_dollar_bars(ticks: DataFrame, rows: int = 210, divisor: int = 300, late: str | None = None) -> DataFrame:
    """Dollar bars of a tick stream (symbol, seq, ts, price, volume, dv), in order within a symbol. Needs the RocksDB state store.

    With ``late`` ticks are ordered by time: those up to so much behind the newest one are put in order, later ones dropped, and the
    last ``late`` of the stream waits. Without it a batch's ticks are taken in order of seq as they come.
    """
    if late is None:
        return ticks.groupBy("symbol").transformWithStateInPandas(DollarBars(rows, divisor), outputStructType=BARS, outputMode="Append", timeMode="None")
    timed = ticks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).withColumn("us", F.unix_micros("ts"))
    return timed.groupBy("symbol").transformWithStateInPandas(TimedDollarBars(rows, divisor), outputStructType=BARS, outputMode="Append", timeMode="EventTime")


class StreamFeatures(StatefulProcessor):
    """Per symbol: the last ``window`` bars, from which VPIN, Amihud, Kyle's lambda and SADF of each new bar are computed as the batch
    operators do. A batch's bars of a symbol are put in order by seq."""

    def __init__(self, short: int = 50, min_len: int = 30, window: int = 100) -> None:
        self.short, self.min_len, self.window = short, min_len, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getValueState("ring", "seq array<bigint>, close array<double>, volume array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        new = pd.concat(list(rows), ignore_index=True).sort_values("seq", kind="stable", ignore_index=True)
        past = pd.DataFrame(dict(zip(("seq", "close", "volume"), self.ring.get(), strict=True))) if self.ring.exists() else pd.DataFrame({"seq": [], "close": [], "volume": []})
        f = pd.concat([past, new[["seq", "close", "volume"]]], ignore_index=True).astype({"seq": "int64", "close": float, "volume": float})
        change = f["close"].diff()
        side = np.sign(change).where(change.notna(), np.nan)
        imbalance = np.where(side.isna() | (side == 0), 0.0, f["volume"])
        price = (f["close"].pct_change(fill_method=None)) / (f["close"] * f["volume"] + 1e-8)
        mean = lambda x: x.rolling(self.short).mean()
        got = pd.DataFrame({
            "vpin": pd.Series(imbalance).rolling(self.short).sum() / f["volume"].rolling(self.short).sum(), "amihud": mean(price.abs()), "kyles_lambda": mean(price),
            "sadf": kernels.sadf(f["close"].to_numpy(), self.min_len, self.window),
        })
        keep = f.tail(self.window + 1)
        self.ring.update((keep["seq"].tolist(), keep["close"].tolist(), keep["volume"].tolist()))
        out = pd.concat([new, got.tail(len(new)).reset_index(drop=True)], axis=1)
        yield out.astype(object).where(out.notna(), None)[[x.split()[0] for x in FEATURED.split(", ")]]

    def close(self) -> None:
        pass


FEATURED = BARS + ", vpin double, amihud double, kyles_lambda double, sadf double"


def stream_features(bars: DataFrame, **params) -> DataFrame:
    """Bars of a stream (symbol, seq, ts, open .. volume) with their features; null where a symbol has too few bars so far."""
    return bars.groupBy("symbol").transformWithStateInPandas(StreamFeatures(**params), outputStructType=FEATURED, outputMode="Append", timeMode="None")


def stream_signals(bars: DataFrame, score: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None]):
    """For each batch of a bar stream: score the rows and hand each symbol's newest one to ``sink``."""

    def each(batch: DataFrame, number: int) -> None:
        scored = score(batch)
        cols = F.struct(*[c for c in scored.columns if c != "symbol"])
        sink(scored.groupBy("symbol").agg(F.max_by(cols, "seq").alias("r")).select("symbol", "r.*"), number)

    return bars.writeStream.foreachBatch(each)
