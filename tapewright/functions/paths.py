"""Expressions over a forward path: an array of returns of the next bars.

Everything is a higher-order array expression, so outcomes are resolved inside the
JVM.  A path is short by construction (at most 40 entries).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..settings import DEFAULTS, Thresholds


def usable_prefix(returns: Column, max_abs: float | None) -> Column:
    """Cut a path at its first missing entry or, with ``max_abs``, implausible jump."""
    def broken(r: Column) -> Column:
        bad = r.isNull()
        return bad if max_abs is None else bad | (F.abs(r) > max_abs)

    at = F.array_position(F.transform(returns, broken), True)
    return F.when(at == 0, returns).otherwise(F.slice(returns, 1, F.greatest(at - 1, F.lit(0)).cast("int")))


def horizon_max(path: Column, bars: int) -> Column:
    return F.array_max(F.slice(path, 1, bars))


def first_hit_label(path: Column, tp: float, sl: float, bars: int) -> Column:
    """1 target first, 0 stop first or horizon used up, NULL while undecided.

    Within one bar the stop is looked at first.
    """
    seen = F.slice(path, 1, bars)
    hit = F.try_element_at(F.filter(seen, lambda r: (r <= sl) | (r >= tp)), F.lit(1))
    return (
        F.when(hit.isNotNull(), F.when(hit <= sl, 0).otherwise(1))
        .when(F.size(seen) >= bars, 0)
        .otherwise(F.lit(None).cast("int"))
    )


def resolve_trade(path: Column, tp: Column, sl: Column, bars: Column) -> Column:
    """struct(ret, hold, outcome): stop, win, or marked to market at the last bar seen."""
    seen = F.slice(path, F.lit(1), bars)
    at = F.array_position(F.transform(seen, lambda r: (r <= -sl) | (r >= tp)), True)
    hit = F.try_element_at(seen, at.cast("int"))
    last = F.try_element_at(seen, F.size(seen))
    stopped = hit <= -sl
    return F.when(
        F.size(seen) > 0,
        F.when(
            at > 0,
            F.struct(
                F.when(stopped, -sl).otherwise(tp).cast("double").alias("ret"),
                at.cast("int").alias("hold"),
                F.when(stopped, "stop").otherwise("win").alias("outcome"),
            ),
        ).otherwise(
            F.struct(
                last.cast("double").alias("ret"),
                F.size(seen).cast("int").alias("hold"),
                F.lit("timeout").alias("outcome"),
            )
        ),
    )


def _last(path: Column) -> Column:
    return F.try_element_at(path, F.size(path))


def _d(x: float) -> Column:
    return F.lit(float(x))


def _first_or_last(path: Column, hit, value) -> Column:
    """``value`` of the first return satisfying ``hit``, else the last return."""
    found = F.try_element_at(F.filter(path, hit), F.lit(1))
    return F.when(found.isNotNull(), value(found)).otherwise(_last(path))


def exit_fixed(path: Column) -> Column:
    return _first_or_last(
        path,
        lambda x: (x <= -0.05) | (x >= 0.25),
        lambda x: F.when(x <= -0.05, _d(-0.05)).otherwise(_d(0.25)),
    )


def exit_time_stopped(path: Column) -> Column:
    """Wider target with a ten-bar time stop at the close of that bar."""
    ten = F.slice(path, 1, 10)
    return _first_or_last(
        ten,
        lambda x: (x <= -0.05) | (x >= 0.30),
        lambda x: F.when(x <= -0.05, _d(-0.05)).otherwise(_d(0.30)),
    )


def _walk(path: Column, start: dict[str, Column], step, finish) -> Column:
    """Fold over the path; ``out`` freezes the state once an exit price is set."""
    keys = list(start)
    zero = F.struct(*[start[k].alias(k) for k in keys], F.lit(None).cast("double").alias("out"))

    def merge(acc: Column, x: Column) -> Column:
        new = step({k: acc[k] for k in keys}, x)
        moved = F.struct(*[new[k].alias(k) for k in keys], new["out"].alias("out"))
        return F.when(acc["out"].isNotNull(), acc).otherwise(moved)

    return F.aggregate(path, zero, merge, finish)


def exit_chandelier(path: Column, atr: Column) -> Column:
    def step(s, x):
        peak = F.greatest(s["peak"], x)
        stop = F.greatest(s["stop"], peak - atr * 3)
        return {"peak": peak, "stop": stop,
                "out": F.when(x <= stop, x).when(x >= 0.40, _d(0.40))}

    return _walk(path, {"peak": _d(0), "stop": atr * -1.5}, step,
                 lambda s: F.coalesce(s["out"], _last(path)))


def exit_breakeven(path: Column) -> Column:
    def step(s, x):
        stop = F.when(x >= 0.08, _d(0)).otherwise(s["stop"])
        return {"stop": stop, "out": F.when(x <= stop, stop).when(x >= 0.35, _d(0.35))}

    return _walk(path, {"stop": _d(-0.06)}, step, lambda s: F.coalesce(s["out"], _last(path)))


def exit_scale_out(path: Column, atr: Column) -> Column:
    """Half is sold at +15 %, the rest trails; the result averages both halves."""
    def step(s, x):
        peak = F.greatest(s["peak"], x)
        stop = F.greatest(s["stop"], peak - atr * 3)
        half = s["half"] | (x >= 0.15)
        return {"peak": peak, "stop": stop, "half": half, "out": F.when(x <= stop, x)}

    def finish(s):
        rest = F.coalesce(s["out"], _last(path))
        return F.when(s["half"], (rest + 0.15) / 2).otherwise(rest)

    return _walk(path, {"peak": _d(0), "stop": _d(-0.06), "half": F.lit(False)}, step, finish)


EXIT_RULES = {
    "A": ("fixed +25/-5", lambda p, a: exit_fixed(p)),
    "B": ("+30/-5 with ten-bar stop", lambda p, a: exit_time_stopped(p)),
    "C": ("chandelier trail", exit_chandelier),
    "D": ("breakeven move, +35", lambda p, a: exit_breakeven(p)),
    "E": ("half at +15, then trail", exit_scale_out),
}


def exit_results(path: Column, atr: Column, t: Thresholds = DEFAULTS) -> Column:
    """array(struct(rule, ret)) for the five exit rules over one path."""
    known = F.coalesce(atr, F.lit(t.exit_missing_atr))
    return F.array(*[
        F.struct(F.lit(k).alias("rule"), fn(path, known).cast("double").alias("ret"))
        for k, (_, fn) in EXIT_RULES.items()
    ])
