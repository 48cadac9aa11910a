"""Per-symbol operators against independent pandas or plain Python restatements."""

import re
from dataclasses import replace
from datetime import date, timedelta
from urllib.parse import urlparse
from urllib.request import url2pathname

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tapewright.functions import paths as P
from tapewright.operators import asof, labels, ranking
from tapewright.operators import timeseries as TS
from tapewright.operators.labels import exit_simulation
from tapewright.operators.timeseries import add_segments, forward_returns
from tapewright.plans.evaluation import pick_paths
from tapewright.settings import DEFAULTS, HORIZON_GRID


def random_bars(seed, symbols=4, n=320, gap_chance=0.01):
    rng = np.random.default_rng(seed)
    rows = []
    for s in range(symbols):
        day, close = date(2000, 1, 3), 100.0
        for _ in range(n):
            day += timedelta(days=int(rng.choice([1, 1, 1, 3])) + (20 if rng.random() < gap_chance else 0))
            close = max(1.0, round(close * (1 + rng.normal(0, 0.03)), 2))
            lo, hi = round(close * (1 - abs(rng.normal(0, 0.01))), 2), round(close * (1 + abs(rng.normal(0, 0.01))), 2)
            rows.append((f"S{s}", day, round(close * (1 + rng.normal(0, 0.01)), 2), hi, lo, close,
                         int(rng.integers(1, 10**6)), float(rng.integers(0, 100))))
    return pd.DataFrame(rows, columns=["symbol", "date", "open", "high", "low", "close", "volume", "deliv_per"])


def by_key(df):
    pdf = df.toPandas() if not isinstance(df, pd.DataFrame) else df
    return pdf.sort_values(["symbol", "date"]).reset_index(drop=True)


def expected_indicators(pdf):
    out = []
    for _, g in pdf.sort_values("date").groupby("symbol"):
        g = g.reset_index(drop=True)
        jump = pd.to_datetime(g["date"]).diff().dt.days.fillna(0) > 5
        bars = g.groupby(jump.cumsum()).cumcount() + 1
        prev = g.close.shift(1)
        tr = pd.concat([g.high - g.low, (g.high - prev).abs(), (g.low - prev).abs()], axis=1).max(axis=1)
        tr = tr.where(bars != 1, g.high - g.low)
        v = {
            "atr14": (tr.rolling(14, min_periods=7).mean(), 7),
            "sma20": (g.close.rolling(20).mean(), 20), "sma50": (g.close.rolling(50).mean(), 50),
            "sma150": (g.close.rolling(150).mean(), 150), "sma200": (g.close.rolling(200).mean(), 200),
            "pct_from_52w_high": ((g.close / g.close.rolling(252, min_periods=20).max() - 1) * 100, 20),
            "pct_from_52w_low": ((g.close / g.close.rolling(252, min_periods=20).min() - 1) * 100, 20),
            "range_contraction_ratio": (tr.rolling(5).mean() / tr.rolling(20).mean(), 20),
            "rel_volume": (g.volume / g.volume.rolling(20).mean(), 20),
            "ret_20d": (g.close / g.close.shift(20) - 1, 21),
        }
        res = g[["symbol", "date"]].assign(bars_since_gap=bars)
        for name, (series, need) in v.items():
            res[name] = series.where(bars >= need)
        out.append(res)
    return by_key(pd.concat(out))


@pytest.mark.parametrize("seed", [1, 2])
def test_indicators_equal_pandas(spark, seed):
    pdf = random_bars(seed)
    got = by_key(TS.add_indicators(spark.createDataFrame(pdf)))
    want = expected_indicators(pdf)
    for c in want.columns[2:]:
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=1e-9, atol=1e-9, err_msg=c)


def test_strict_segments_never_look_across_a_gap(spark):
    pdf = random_bars(3, symbols=1, n=60, gap_chance=0)
    late = pdf.date >= pdf.date.iloc[30]
    pdf.loc[late, "date"] = pdf.loc[late, "date"].map(lambda d: d + timedelta(days=40))
    df = spark.createDataFrame(pdf)
    loose, strict = by_key(TS.add_indicators(df)), by_key(TS.add_indicators(df, strict_segments=True))
    at = 30 + 7      # eight bars after the gap: ATR known, but mixed with old bars by default
    assert loose.bars_since_gap[at] == strict.bars_since_gap[at] == 8
    assert loose.atr14[at] != pytest.approx(strict.atr14[at])


def test_indicator_plan_has_one_symbol_shuffle_and_no_python(spark, tmp_path):
    path = str(tmp_path / "bars")
    spark.createDataFrame(random_bars(4)).write.parquet(path)
    df = TS.forward_returns(TS.add_indicators(spark.read.parquet(path)), 30)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Python" not in plan


def test_missing_benchmark_leaves_strength_unknown(spark):
    df = TS.add_relative_strength(TS.add_indicators(spark.createDataFrame(random_bars(5, 1, 40))))
    assert df.where(F.col("rs_vs_market").isNotNull()).count() == 0


def closes(spark, values, start=date(2020, 1, 1), gaps=None):
    gaps = gaps or {}
    day, rows = start, []
    for i, v in enumerate(values):
        day += timedelta(days=gaps.get(i, 1))
        rows.append(("A", day, v))
    return spark.createDataFrame(rows, "symbol string, date date, price double")


LABEL_CASES = [
    # values, gaps, (win, future_max_5d, touched) of the first row
    ([100, 96, 94, 130], {}, (0, 30.0, 1)),
    ([100, 126, 90], {}, (1, 26.0, 1)),
    ([100, 101, 102], {}, (None, 2.0, 0)),
    ([100, 101, 130], {2: 9}, (None, 1.0, 0)),
    ([100, 101, 230, 50], {}, (None, 1.0, 0)),
    ([100, 101, -5, 130], {}, (None, 1.0, 0)),
    ([100], {}, (None, None, None)),
    ([0, 101, 102], {}, (None, None, None)),
    ([100] + [101] * 30, {}, (0, 1.0, 0)),
    ([100, 95, 125], {}, (0, 25.0, 1)),
]


@pytest.mark.parametrize("values,gaps,want", LABEL_CASES)
def test_labels_of_the_first_row(spark, values, gaps, want):
    df = labels.add_labels(closes(spark, [float(v) for v in values], gaps=gaps))
    r = df.orderBy("date").first()
    assert r.tradable_win == want[0]
    assert r.future_max_5d == (want[1] if want[1] is None else pytest.approx(want[1]))
    assert r.upside_touched_5d == want[2]


def python_exit(rule, path, atr):
    if rule == "A":
        for x in path:
            if x <= -0.05:
                return -0.05
            if x >= 0.25:
                return 0.25
        return path[-1]
    if rule == "B":
        for i, x in enumerate(path, 1):
            if x <= -0.05:
                return -0.05
            if x >= 0.30:
                return 0.30
            if i == 10:
                return x
        return path[-1]
    if rule == "D":
        stop = -0.06
        for x in path:
            stop = 0.0 if x >= 0.08 else stop
            if x <= stop:
                return stop
            if x >= 0.35:
                return 0.35
        return path[-1]
    high, stop, sold, rest = 0.0, (-1.5 * atr if rule == "C" else -0.06), False, None
    for x in path:
        high = max(high, x)
        stop = max(stop, high - 3 * atr)
        sold = sold or x >= 0.15
        if x <= stop:
            rest = x
            break
        if rule == "C" and x >= 0.40:
            return 0.40
    rest = path[-1] if rest is None else rest
    return (0.15 + rest) / 2 if rule == "E" and sold else rest


def test_exit_rules_equal_a_plain_loop(spark):
    rng = np.random.default_rng(7)
    rows = [(i, [float(v) for v in np.cumsum(rng.normal(0.004, 0.05, rng.integers(2, 41)))], float(rng.uniform(0.01, 0.08)))
            for i in range(300)]
    df = spark.createDataFrame(rows, "i int, path array<double>, atr double")
    got = df.select("i", F.inline(P.exit_results(F.col("path"), F.col("atr")))).collect()
    assert len(got) == 1500
    for r in got:
        assert r.ret == pytest.approx(python_exit(r.rule, rows[r.i][1], rows[r.i][2]), abs=1e-12), (r.rule, r.i)


def test_trade_resolution_cases(spark):
    rows = [([1.0, -9.0], "stop", -8.0, 2), ([21.0], "win", 20.0, 1), ([3.0, 4.0], "timeout", 4.0, 2)]
    df = spark.createDataFrame([(p,) for p, *_ in rows], "p array<double>")
    got = [r.o for r in df.select(P.resolve_trade(F.col("p"), F.lit(20.0), F.lit(8.0), F.lit(30)).alias("o")).collect()]
    assert [(o.outcome, o.ret, o.hold) for o in got] == [(k, r, h) for _, k, r, h in rows]


def test_grid_outcomes_equal_single_resolution(spark):
    from tapewright.plans.evaluation import grid_outcomes, search_cells

    rng = np.random.default_rng(9)
    rows = [("A", date(2020, 1, 1) + timedelta(days=i), [float(v) for v in np.cumsum(rng.normal(0, 4, rng.integers(0, 31)))])
            for i in range(40)]
    df = spark.createDataFrame(rows, "symbol string, date date, path array<double>")
    got = grid_outcomes(df, search_cells()).join(df, ["symbol", "date"])
    one = P.resolve_trade(F.col("path"), F.col("tp"), F.col("sl"), F.col("h"))
    both = got.select("ret", "hold", "outcome", one.alias("o")).collect()
    assert len(both) == sum(len(p) > 0 for *_, p in rows) * len(search_cells())
    assert all((r.ret, r.hold, r.outcome) == (r.o.ret, r.o.hold, r.o.outcome) for r in both)


# ---- ranks under skew ----------------------------------------------------------------

def skewed(seed=11, n=4000):
    """One group holds most rows and one value holds a third of them."""
    rng = np.random.default_rng(seed)
    g = np.where(rng.random(n) < 0.7, "hot", rng.choice(["a", "b", "c"], n))
    v = np.where(rng.random(n) < 0.33, 7.0, np.round(rng.normal(0, 50, n), 1))
    pdf = pd.DataFrame({"g": g, "v": v, "symbol": [f"S{i:05d}" for i in range(n)]})
    pdf.loc[rng.random(n) < 0.02, "v"] = np.nan
    return pdf


def nullable(spark, pdf):
    return spark.createDataFrame(pdf).withColumn("v", F.nanvl("v", F.lit(None).cast("double")))


def test_percentile_rank_equals_pandas(spark):
    pdf = skewed()
    got = ranking.percentile_rank(nullable(spark, pdf), ["g"], "v", "pct").toPandas().sort_values("symbol")
    want = pdf.sort_values("symbol").groupby("g")["v"].rank(pct=True)
    np.testing.assert_allclose(got.pct.to_numpy(float), want.to_numpy(float), rtol=1e-12)


@pytest.mark.parametrize("q", [0.0, 0.33, 0.5, 1.0])
def test_group_quantile_equals_pandas(spark, q):
    pdf = skewed(12)
    got = ranking.group_quantile(nullable(spark, pdf), ["g"], "v", q, "x").toPandas().set_index("g").x
    pd.testing.assert_series_equal(got.sort_index(), pdf.groupby("g").v.quantile(q).sort_index(), check_names=False)


def test_positions_number_every_row_once(spark):
    pdf = skewed(13).fillna(0)
    df = spark.createDataFrame(pdf)
    got = ranking.positions(df, ["g"], [F.col("v").desc(), F.col("symbol")], "pos").toPandas().sort_values("symbol")
    want = pdf.sort_values(["v", "symbol"], ascending=[False, True]).groupby("g").cumcount() + 1
    assert (got.set_index("symbol").pos == want.set_axis(pdf.loc[want.index, "symbol"]).sort_index()).all()


def test_positions_of_one_hot_value_are_spread(spark):
    rows = [("d" if i % 10 else None, 5.0 if i % 7 else float(i), f"S{i:05d}") for i in range(4000)]
    df = spark.createDataFrame(rows, "g string, v double, symbol string").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ranking.positions(df, ["g"], [F.col("v").desc(), F.col("symbol")], "pos")
        pos = {r.symbol: r.pos for r in got.collect()}
        sizes = [pq.read_metadata(url2pathname(urlparse(f).path)).num_rows for f in got.inputFiles()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for group in ("d", None):
        order = sorted((r for r in rows if r[0] == group), key=lambda r: (-r[1], r[2]))
        assert [pos[s] for _, _, s in order] == list(range(1, len(order) + 1))
    assert sum(sizes) == len(rows) and max(sizes) < 2000
    none = ranking.positions(df.limit(0), [], [F.col("symbol")], "pos")
    assert none.columns == ["g", "v", "symbol", "pos"] and none.count() == 0
    whole = ranking.positions(df, [], [F.col("symbol").desc()], "pos").orderBy("pos").collect()
    assert [r.symbol for r in whole] == sorted((s for _, _, s in rows), reverse=True)


def test_order_bucket_never_decreases(spark):
    rng = np.random.default_rng(5)
    v = sorted(float(x) for x in np.concatenate([
        rng.normal(0, 1e6, 500), rng.normal(0, 1e-6, 500), rng.normal(0, 1, 500), [0.0, 1e300, -1e300]]))
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "i int, v double")
    b = [r.b for r in df.select("i", ranking.order_bucket(F.col("v")).alias("b")).orderBy("i").collect()]
    assert b == sorted(b)


def test_ranks_of_values_beyond_all_numbers(spark):
    values = [float("nan"), 2.0, float("inf"), float("-inf"), -1e308, 1e308, float("nan")]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v double").withColumn("g", F.lit(1))
    got = {r.i: r.pct * 7 for r in ranking.percentile_rank(df, ["g"], "v", "pct").collect()}
    assert got == pytest.approx({3: 1, 4: 2, 1: 3, 5: 4, 2: 5, 0: 6.5, 6: 6.5})


def test_deciles_equal_pandas_cut(spark):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"date": rng.integers(0, 30, 3000), "score": rng.integers(0, 60, 3000)})
    pdf.loc[pdf.date == 3, "score"] = 10          # a date with a single score is dropped
    counts = spark.createDataFrame(pdf).groupBy("date", "score").agg(F.count(F.lit(1)).alias("n"))
    got = ranking.add_deciles(counts, ["date"], "score", "n").toPandas()
    assert 3 not in set(got.date)
    keep = pdf[pdf.date != 3].copy()
    keep["d"] = keep.groupby("date").score.transform(lambda s: pd.qcut(s, 10, labels=False, duplicates="drop"))
    want = keep.drop_duplicates(["date", "score"])
    merged = got.merge(want, on=["date", "score"])
    assert len(merged) == len(got) == len(want) and (merged.decile == merged.d).all()


def test_deciles_of_continuous_scores_leave_out_a_null_group(spark):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b", None], 2000, p=[0.7, 0.2, 0.1]), "score": rng.normal(0, 1e3, 2000)})
    counts = spark.createDataFrame(pdf).groupBy("g", "score").agg(F.count(F.lit(1)).alias("n"))
    got = {(r.g, r.score): r.decile for r in ranking.add_deciles(counts, ["g"], "score", "n").collect()}
    assert len(got) == pdf.g.notna().sum()
    for g, scores in pdf.groupby("g").score:
        cut = pd.qcut(scores, 10, labels=False, duplicates="drop")
        assert all(got[g, s] == d for s, d in zip(scores, cut, strict=True))


def test_no_path_crosses_an_exchange(spark):
    pdf = random_bars(5, 4, 90)[["symbol", "date"]]
    pdf["close"] = np.random.default_rng(3).uniform(50, 150, len(pdf))
    pdf["atr_pct"] = 3.0
    bars = spark.createDataFrame(pdf)
    picks = bars.where("close > 120").select("date", "symbol", F.col("close").alias("score"))
    paths = pick_paths(picks, bars, price="close")
    assert paths.columns == ["symbol", "date", "score", "path"]
    full = forward_returns(add_segments(bars.select("symbol", "date", "close")), max(HORIZON_GRID), max_abs=DEFAULTS.max_abs_return)
    want = {(r.symbol, r.date): (r.close, r.path) for r in full.where("close > 120").collect()}
    assert {(r.symbol, r.date): (r.score, r.path) for r in paths.collect()} == want and want
    for df in (paths, exit_simulation(picks, bars)):
        text = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        moved = [x for x in text.split("\n\n") if re.search(r"\) (Exchange|BroadcastExchange|Sort)\b", x)]
        assert moved and not any(re.search(r"\b(path|_ahead)#", x) for x in moved)


def test_top_k_is_limited_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("g"), "id")
    plan = ranking.top_k(df, ["g"], [F.col("id").desc()], 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.index("Final") < plan.index("Partial")


# ---- as-of -----------------------------------------------------------------------------

def test_next_own_bar_equals_brute_force(spark):
    pdf = random_bars(21, 3, 40)[["symbol", "date"]]
    rng = np.random.default_rng(22)
    events = [(f"S{rng.integers(0, 4)}", date(2000, 1, 1) + timedelta(days=int(rng.integers(0, 120)))) for _ in range(200)]
    got = asof.next_bar_map(spark.createDataFrame(events, "symbol string, d date"), spark.createDataFrame(pdf), "d").collect()
    assert len(got) == len(set(events))
    for r in got:
        later = sorted(d for s, d in zip(pdf.symbol, pdf.date) if s == r.symbol and d >= r.d)
        assert r.date == (later[0] if later else None)


def test_snapshot_drops_stale_symbols(spark):
    rows = [("A", date(2020, 1, 1), 1.0), ("A", date(2020, 1, 20), 2.0), ("B", date(2020, 1, 1), 3.0)]
    df = spark.createDataFrame(rows, "symbol string, date date, close double")
    assert [(r.symbol, r.close) for r in TS.latest_as_of(df, "2020-01-22").collect()] == [("A", 2.0)]
    assert TS.latest_as_of(df, "2020-01-08", t=replace(DEFAULTS, stale_after_days=7)).count() == 2


def test_peak_date_is_the_earliest(spark):
    rows = [("A", date(2020, 1, d), c) for d, c in ((1, 9.0), (2, 5.0), (3, 8.0), (4, 8.0), (5, 7.0))]
    df = spark.createDataFrame(rows, "symbol string, date date, close double")
    r = TS.post_signal_stats(df, "2020-01-02").first()
    assert (r.peak_date, r.peak_price, r.latest_price) == (date(2020, 1, 3), 8.0, 7.0)
