"""The paper ledger as keyed streaming state, right for bars and picks in any order of delivery.

Input rows are either a pick (``kind`` 'pick') or a daily bar ('bar'), keyed by symbol.  The state of a symbol is

* a map from month to the bars of that month, so a batch only reads and writes the months it needs;
* the list of its positions with their results so far.

What arrives late is replayed: a bar of an earlier date changes the positions whose walk reaches that date, a pick
whose bars passed long ago walks the stored ones, and a bar delivered again with other prices replaces the first.  Each
change of a result is emitted once as a new revision, so the newest revisions (``latest_results``) are what one batch
over everything delivered would give, whatever the order.  Nothing is dropped for being late.

State grows by one bar per symbol and trading day (32 bytes) and one row per pick.  It lives in RocksDB on the
executors and in the checkpoint, not in memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..settings import DEFAULTS, Thresholds

EVENT_SCHEMA = ("kind string, symbol string, date date, high double, low double, close double, "
                "entry_price double, target double, stop double")
#: ``number`` counts the picks of a symbol as delivered, ``revision`` the results emitted for one of them.
RESULT_SCHEMA = ("symbol string, number int, revision int, entry_date date, status string, exit_date date, exit_price double, "
                 "realized_pct double, peak_pct double, days_held int")
BARS_SCHEMA = "days array<int>, high array<double>, low array<double>, close array<double>"
POSITION_SCHEMA = ("number int, entry_day int, entry double, target double, stop double, status string, exit_day int, level double, "
                   "peak double, days int, revision int")
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_EPOCH = date(1970, 1, 1)
_PRICES = ("high", "low", "close")


def ledger_events(picks: DataFrame, bars: DataFrame) -> DataFrame:
    """Picks and bars as one table of events."""
    p = picks.select(F.lit("pick").alias("kind"), "symbol", F.col("entry_date").alias("date"), "entry_price", "target", "stop")
    b = bars.select(F.lit("bar").alias("kind"), "symbol", "date", "high", "low", "close")
    names = [f.split()[0] for f in EVENT_SCHEMA.split(", ")]
    return b.unionByName(p, allowMissingColumns=True).select(*names)


def _month(day: int) -> int:
    d = _EPOCH + timedelta(days=int(day))
    return d.year * 12 + d.month - 1


def walk_bars(entry: float, target: float, stop: float, high: np.ndarray, low: np.ndarray, close: np.ndarray, limit: int):
    """(status, bars used, level, peak) of a position over the bars after its entry.

    A bar that touches both levels stops the position; bar number ``limit`` ends it at its close (None when unknown).
    """
    high, low, close = high[:limit], low[:limit], close[:limit]
    stopped, reached = low <= stop, high >= target
    ends = np.flatnonzero(stopped | reached)
    at = int(ends[0]) if len(ends) else limit - 1
    used = min(at + 1, len(high))
    seen = high[:used][~np.isnan(high[:used])]
    peak = max(0.0, (float(seen.max()) / entry - 1) * 100) if len(seen) else 0.0
    if at >= len(high):
        return "OPEN", used, None, peak
    if stopped[at]:
        return "STOPPED", used, stop, peak
    if reached[at]:
        return "TARGET", used, target, peak
    return "EXPIRED", used, None if np.isnan(close[at]) else float(close[at]), peak


class LedgerProcessor(StatefulProcessor):
    """Positions of one symbol. With ``skip_open`` a pick counts as SKIPPED while an earlier one is open.

    A position is held on the day of a pick unless a bar before that day closed it, as in a run that adds the picks of
    a day before it reads the day's bars.  Picks of one day follow in the order of delivery.
    """

    def __init__(self, limit: int, skip_open: bool):
        self.limit, self.skip_open = limit, skip_open

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.months = handle.getMapState("bars", "month int", BARS_SCHEMA)
        self.span = handle.getValueState("span", "first int, last int")
        self.positions = handle.getListState("positions", POSITION_SCHEMA)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = pd.concat(list(rows), ignore_index=True)
        new["day"] = [(d - _EPOCH).days for d in pd.to_datetime(new["date"]).dt.date]
        changed = self._store_bars(new[new["kind"] == "bar"])
        names = [f.split()[0] for f in POSITION_SCHEMA.split(", ")]
        held = [dict(zip(names, p, strict=True)) for p in self.positions.get()]
        picks = new[new["kind"] == "pick"]
        for k, r in enumerate(picks.itertuples(index=False), len(held)):
            held.append({"number": k, "entry_day": int(r.day), "entry": r.entry_price, "target": r.target, "stop": r.stop, "status": None,
                         "exit_day": None, "level": None, "peak": 0.0, "days": 0, "revision": 0})
        touched = [p for p in held if self._reached(p, changed)]
        if self.skip_open and touched:
            first = min(p["entry_day"] for p in touched)
            touched = [p for p in held if p["entry_day"] >= first]
        revised = self._replay(held, touched)
        if touched:
            self.positions.put([tuple(p[n] for n in names) for p in held])
        if revised:
            yield pd.DataFrame([self._result(key[0], p) for p in revised], columns=[f.split()[0] for f in RESULT_SCHEMA.split(", ")])

    def _store_bars(self, bars: pd.DataFrame) -> list[int]:
        """Merge bars into their months; the days whose prices are new or other than before."""
        changed: list[int] = []
        bars = bars.drop_duplicates("day", keep="last")
        for month, part in bars.groupby(bars["day"].map(_month)):
            days, prices = self._load(int(month))
            known = dict(zip(days.tolist(), prices.T.tolist(), strict=True))
            before = len(changed)
            for day, *bar in part[["day", *_PRICES]].astype({p: float for p in _PRICES}).itertuples(index=False):
                if day not in known or not np.array_equal(known[day], bar, equal_nan=True):
                    known[int(day)] = bar
                    changed.append(int(day))
            if len(changed) > before:
                order = sorted(known)
                columns = np.array([known[d] for d in order]).T.tolist()
                self.months.updateValue((int(month),), (order, *columns))
        if changed:
            low, high = _month(min(changed)), _month(max(changed))
            span = self.span.get()
            self.span.update((min(low, span[0]), max(high, span[1])) if span else (low, high))
        return changed

    def _load(self, month: int) -> tuple[np.ndarray, np.ndarray]:
        block = self.months.getValue((month,)) if self.months.containsKey((month,)) else None
        if block is None:
            return np.zeros(0, np.int64), np.zeros((3, 0))
        return np.array(block[0], np.int64), np.array([[np.nan if x is None else x for x in column] for column in block[1:]], float).reshape(3, -1)

    def _reached(self, p: dict, changed: list[int]) -> bool:
        if p["status"] is None:
            return True
        return any(day > p["entry_day"] and (p["exit_day"] is None or day <= p["exit_day"]) for day in changed)

    def _after(self, entry_day: int, cache: dict) -> tuple[np.ndarray, np.ndarray]:
        """Days and prices of the first ``limit`` bars after a day."""
        span = self.span.get() if "span" not in cache else cache["span"]
        cache["span"] = span
        days, prices, have, month = [], [], 0, _month(entry_day)
        while span and month <= span[1] and have < self.limit:
            month = max(month, span[0])
            if month not in cache:
                cache[month] = self._load(month)
            d, v = cache[month]
            later = d > entry_day
            days.append(d[later])
            prices.append(v[:, later])
            have += int(later.sum())
            month += 1
        return (np.concatenate(days), np.concatenate(prices, axis=1)) if days else (np.zeros(0, np.int64), np.zeros((3, 0)))

    def _replay(self, held: list[dict], touched: list[dict]) -> list[dict]:
        """Results of ``touched`` anew; those that changed and are, or were, more than open."""
        cache: dict = {}
        revised = []
        wanted = {p["number"] for p in touched}
        # the newest exit among accepted picks so far; a day later than all when one is open
        busy = -(2**31)
        for p in sorted(held, key=lambda p: (p["entry_day"], p["number"])):
            if p["number"] in wanted:
                before = (p["status"], p["exit_day"], p["level"], p["peak"], p["days"])
                if self.skip_open and busy >= p["entry_day"]:
                    p.update(status="SKIPPED", exit_day=None, level=None, peak=0.0, days=0)
                else:
                    days, (high, low, close) = self._after(p["entry_day"], cache)
                    status, used, level, peak = walk_bars(p["entry"], p["target"], p["stop"], high, low, close, self.limit)
                    p.update(status=status, exit_day=None if status == "OPEN" else int(days[used - 1]), level=level, peak=peak, days=used)
                now = (p["status"], p["exit_day"], p["level"], p["peak"], p["days"])
                # an open position is only reported where it takes back an earlier result
                if now != before and (p["status"] != "OPEN" or p["revision"] and before[0] != "OPEN"):
                    p["revision"] += 1
                    revised.append(p)
            if p["status"] != "SKIPPED":
                busy = max(busy, 2**31 if p["exit_day"] is None else p["exit_day"])
        return revised

    def _result(self, symbol: str, p: dict) -> tuple:
        day = lambda n: None if n is None else _EPOCH + timedelta(days=n)
        level = p["level"]
        gain = None if level is None else (level / p["entry"] - 1) * 100
        return (symbol, p["number"], p["revision"], day(p["entry_day"]), p["status"], day(p["exit_day"]), level, gain, p["peak"], p["days"])

    def close(self) -> None:
        pass


def ledger_stream(events: DataFrame, *, t: Thresholds = DEFAULTS, skip_open: bool = False) -> DataFrame:
    """Revisions of results (``RESULT_SCHEMA``), each emitted in the batch that brings it about.

    Picks and bars of one symbol meet in its state; nothing else is shuffled.  Equal symbols of different case or a
    null symbol are keys of their own.  The session's state store is set to RocksDB, which this kind of state needs.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    out = events.groupBy("symbol").transformWithStateInPandas(
        LedgerProcessor(t.time_stop_bars, skip_open), outputStructType=RESULT_SCHEMA, outputMode="Append", timeMode="None")
    return out.withColumns({
        "exit_price": F.round("exit_price", 2), "realized_pct": F.round("realized_pct", 1), "peak_pct": F.round("peak_pct", 1)})


def latest_results(revisions: DataFrame) -> DataFrame:
    """The newest revision of every pick that has one: closed, skipped, or open again after a correction."""
    others = [c for c in revisions.columns if c not in ("symbol", "number", "revision")]
    newest = revisions.groupBy("symbol", "number").agg(F.max_by(F.struct("revision", *others), "revision").alias("r"))
    return newest.select("symbol", "number", "r.*")
