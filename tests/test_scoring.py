"""Score expressions, phases, views and text rules on hand-made rows."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from tapewright.functions import scoring as S
from tapewright.functions import screeners as SC
from tapewright.functions import views as V
from tapewright.operators import text as X
from tapewright.plans import research as RS
from tapewright.plans import scorecard as P
from tapewright.plans import triage as TR
from tapewright.sources import readers
from tapewright.sources import tables as TB


def one(spark, **values):
    """A one-row frame; Python None becomes a NULL double unless a type is given as (value, type)."""
    cols = []
    for name, v in values.items():
        v, t = v if isinstance(v, tuple) else (v, None)
        if isinstance(v, list):
            c = F.array(*[F.lit(x) for x in v]).cast("array<string>")
        else:
            c = F.lit(v) if v is not None else F.lit(None).cast(t or "double")
        cols.append((c.cast(t) if t else c).alias(name))
    return spark.range(1).select(*cols)


def value(df, expr):
    return df.select(expr.alias("x")).first().x


@pytest.mark.parametrize("name,norm", [
    (" RT_VCP_20260713 ", "RT_VCP"), ("Gem - swing", "GEM_SWING"), ("_darvas_-20260713", "DARVAS"),
    ("x 123456", "X"), ("Premium_7.1", "PREMIUM_7.1"), ("RSI_65", "RSI_65"),
])
def test_normalize(spark, name, norm):
    assert value(one(spark, s=name), SC.normalize_screener(F.col("s"))) == norm


@pytest.mark.parametrize("norm,cat", [
    ("RT_52W_AWAY", "base"), ("RT_52W_BREAKOUT", "breakout"), ("RSI_X", "momentum"), ("OTHER", "base"),
    ("VCP", "breakout"), ("RT_READY_TO_REBOUND", "base"), ("RT_MULTIYEAR_RETEST", "momentum"),
])
def test_categorize(spark, norm, cat):
    assert value(one(spark, s=norm), SC.categorize_screener(F.col("s"))) == cat


def test_split_list_and_new_names(spark):
    assert value(one(spark, s=" a ,, b,"), SC.split_list(F.col("s"))) == ["a", "b"]
    assert value(one(spark, s=(None, "string")), SC.split_list(F.col("s"))) == []
    df = one(spark, t=["b", "a", "c"], y=["c"], n=(None, "array<string>"))
    assert value(df, SC.new_screeners(F.col("t"), F.col("y"))) == ["a", "b"]
    assert value(df, SC.new_screeners(F.col("t"), F.col("n"))) == ["b", "a", "c"]


def test_pattern_score_counts_distinct_names_and_caps(spark):
    df = one(spark, s=["VCP", "vcp_20260101", "unknown"])
    assert value(df, SC.pattern_score(F.col("s"))) == 2 + 3
    df = one(spark, s=["RT_RSI_85", "DARVAS", "RT_52W_BREAKOUT"])
    assert value(df, SC.pattern_score(F.col("s"))) == 30


@pytest.mark.parametrize("count,diff,triggers,want", [
    (2.0, 1.0, ["DARVAS"], 14), (9.0, 0.0, [], 10), (1.0, -1.0, [], 0), (None, None, ["x"], 5), (10.0, 1.0, ["x"], 20),
])
def test_confluence(spark, count, diff, triggers, want):
    df = one(spark, c=count, d=diff, f=triggers)
    assert value(df, S.confluence_score(F.col("c"), F.col("d"), F.col("f"))) == want


@pytest.mark.parametrize("chg,pct,want", [
    (1.0, None, 7), (8.0, 0.9, 10), (8.1, 0.5, 8), (15.1, 0.0, 1), (0.5, 0.0625, 0), (-3.0, 0.1875, 2), (None, 0.3125, 2),
])
def test_momentum_volume_rounds_half_even(spark, chg, pct, want):
    assert value(one(spark, c=chg, p=pct), S.momentum_volume_score(F.col("c"), F.col("p"))) == want


@pytest.mark.parametrize("buy,sell,want", [(5.0, 1.0, 10), (1.0, 5.0, -8), (2.0, 2.0, 0), (5.0, None, 0), (None, None, 0)])
def test_institutional_needs_both_sides(spark, buy, sell, want):
    assert value(one(spark, b=buy, s=sell), S.institutional_score(F.col("b"), F.col("s"))) == want


@pytest.mark.parametrize("rs,want", [(None, 0), (-4.0, 0), (14.9, 14), (80.0, 35)])
def test_relative_strength(spark, rs, want):
    assert value(one(spark, r=rs), S.relative_strength_score(F.col("r"))) == want


@pytest.mark.parametrize("atr,stop,target,basis", [
    (3.5, 5.25, 26.25, "ATR"), (5.0, 7.5, 37.5, "ATR"), (8.0, 10.0, 40.0, "ATR"), (1.0, 5.0, 25.0, "ATR"), (None, 6.0, 30.0, "flat"),
])
def test_risk_levels(spark, atr, stop, target, basis):
    r = value(one(spark, p=100.0, a=atr), S.risk_levels(F.col("p"), F.col("a")))
    assert (r.stop_pct, r.target_pct, r.basis) == (stop, target, basis)
    assert r.stop_price == pytest.approx(100 - stop) and r.target_price == pytest.approx(100 + target)


def test_no_levels_without_a_price(spark):
    assert value(one(spark, p=0.0, a=3.0), S.risk_levels(F.col("p"), F.col("a"))) is None


@pytest.mark.parametrize("text,diff,want", [
    ("Premium_7.1, RT_MAJOR_SUPPORT", 0, "Rebound Setup"), ("premium_7.1, X_BREAKOUT", 3, "Breakout Trigger"),
    ("premium_7.1, X_BREAKOUT", 2, "Momentum Continuation"), ("RESISTANCE", None, "Momentum Continuation"), ("VCP", 5, "Neutral"),
])
def test_rule_phase(spark, text, diff, want):
    assert value(one(spark, t=text, d=(diff, "int")), S.rule_phase(F.col("t"), F.col("d"))) == want


@pytest.mark.parametrize("fresh,names,vol,chg,rs,want", [
    (["DARVAS"], ["DARVAS"], True, 3.0, 6.0, "SOS"), (["DARVAS"], ["DARVAS"], False, 3.0, 6.0, ""),
    ([], ["RT_MAJOR_SUPPORT"], False, -4.0, 5.0, "LPS"), ([], ["VCP"], False, None, None, "Base"),
    (["darvas"], ["VCP"], True, 3.0, 6.0, "Base"),
])
def test_wyckoff_phase(spark, fresh, names, vol, chg, rs, want):
    df = one(spark, f=fresh, n=names, v=vol, c=chg, r=rs)
    assert value(df, S.wyckoff_phase(F.col("f"), F.col("n"), F.col("v"), F.col("c"), F.col("r"))) == want


def test_gates_differ_on_a_missing_sector(spark):
    rows = [("A", 25.0, 60000.0, None), ("B", 25.0, 60000.0, "IT"), ("NIFTYBEES", 25.0, 60000.0, "IT"),
            ("C", 25.0, 60000.0, "Equity"), ("D", 19.0, 60000.0, "IT"), ("E", 25.0, None, "IT")]
    df = spark.createDataFrame(rows, "symbol string, price double, volume double, sector string")
    assert [r.symbol for r in P.live_gate(df).collect()] == ["B"]
    assert [r.symbol for r in P.backtest_gate(df).collect()] == ["A", "B"]


def test_watchlist_without_history_and_tie_order(spark):
    rows = [("B", 30.0, 100000, 2.0, "IT", ["VCP"]), ("A", 30.0, 100000, 2.0, "IT", ["VCP"]), ("C", 30.0, 900000, 2.0, "IT", ["DARVAS"])]
    df = spark.createDataFrame(rows, "symbol string, price double, volume long, chg double, sector string, screeners array<string>")
    df = df.withColumns({"new_screeners": F.col("screeners"), "today_count": F.lit(1), "count_diff": F.lit(0),
                         "buy_qty": F.lit(None).cast("double"), "sell_qty": F.lit(None).cast("double")})
    out = P.score_watchlist(df).orderBy("rank").collect()
    assert [(r.symbol, r["rank"]) for r in out] == [("C", 1), ("A", 2), ("B", 3)]
    assert out[0].stop_basis == "flat" and out[0].chg_since_signal is None and out[0].rs_points == 0
    assert out[1].reasoning.startswith("patterns: VCP; fresh trigger today: VCP; healthy move today (+2.0%)")


def test_weight_tables_agree(spark):
    raw = spark.createDataFrame([("VCP", "2", 1), ("vcp_20260101", "9", 2), ("bad", "x", 3)], "screener string, weight string, i int")
    w = TB.clean_weights(raw, "i")
    assert {(r.screener, r.weight) for r in w.collect()} == {("VCP", 9), ("BAD", None)}
    sheet = spark.createDataFrame([("A", date(2020, 1, 1), ["VCP", "new"]), ("B", date(2020, 1, 1), [])],
                                  "symbol string, date date, screeners array<string>")
    known = w.dropna()
    joined = {r.symbol: r.pattern_points for r in TB.add_pattern_points(sheet, known).collect()}
    assert joined == {"A": 12, "B": 0}
    many = spark.range(3000).select(F.concat(F.lit("S"), F.col("id").cast("string")).alias("screener"), F.lit(2).alias("weight"))
    wide = sheet.limit(1).withColumn("screeners", F.array(F.lit("s2999"), F.lit("s7"), F.lit("none")))
    assert TB.add_pattern_points(wide, many).first().pattern_points == 7


@pytest.mark.parametrize("wins,n,want", [(26, 130, 11), (10, 130, 0), (100, 130, 12), (10, 40, 3)])
def test_generated_weight(spark, wins, n, want):
    rows = [(date(2020, 1, 1), ["S"], 1 if i < wins else 0) for i in range(n)]
    short = spark.createDataFrame(rows, "date date, screeners array<string>, win int")
    assert RS.screener_weights(short).first().weight == want


def test_split_test_counts_unknown_as_negative(spark):
    rows = [(1.0, 1, 1)] * 50 + [(None, 0, 0)] * 50
    df = spark.createDataFrame(rows, "f double, win int, touch int")
    r = RS.split_tests(df, {"t": (F.lit(True), F.col("f") > 0)}).first()
    assert (r.pos_n, r.neg_n, r.edge, r.verdict) == (50, 50, 100.0, "EDGE")
    few = RS.split_tests(df.limit(60), {"t": (F.lit(True), F.col("f") > 0)}).first()
    assert few.verdict == "n/a"


# ---- views -----------------------------------------------------------------------------

def test_position_size(spark):
    assert value(one(spark, p=100.0, s=95.0), V.shares_for(F.col("p"), F.col("s"), 100000.0, 1.0)) == 200
    assert value(one(spark, p=100.0, s=100.0), V.shares_for(F.col("p"), F.col("s"), 100000.0, 1.0)) is None
    assert value(one(spark, p=100.0, s=10.0), V.shares_for(F.col("p"), F.col("s"), 10.0, 1.0)) is None


@pytest.mark.parametrize("target,multiple,days,want", [
    (150.0, None, 10, ("live", 50.0)), (90.0, None, 10, ("reached", None)), (150.0, None, 200, ("historical", None)),
    (10.0, None, 10, (None, None)), (None, "2x", 10, ("multiple", None)), (None, None, None, (None, None)),
])
def test_target_state(spark, target, multiple, days, want):
    df = one(spark, p=100.0, t=target, m=(multiple, "string"), d=(days, "int"))
    r = value(df, V.target_state(F.col("p"), F.col("t"), F.col("m"), F.col("d")))
    assert (r.state, r.upside_pct) == want


def test_view_sorts_missing_last_when_descending(spark):
    rows = [("A", 1.0, "A", False), ("B", None, "B", False), ("C", 9.0, "C", True)]
    df = spark.createDataFrame(rows, "symbol string, rs double, tier string, lagging boolean")
    got = V.view(df, sort_key="rs", descending=True).collect()
    assert [r.symbol for r in got] == ["C", "A", "B"]
    assert [r.symbol for r in V.view(df, nolag=True, min_rs=0.5, sort_key="rs").collect()] == ["A"]


def test_private_fields_are_dropped(spark):
    df = spark.range(1).select(F.lit(1).alias("rank"), F.lit(2).alias("mentions"), F.lit(3).alias("call_tag"), F.lit(4).alias("ledger"))
    assert V.public_columns(df).columns == ["rank"]


def test_sheet_diff_states(spark):
    now = spark.createDataFrame([("A", 1, 90), ("N", 2, 80)], "symbol string, rank int, score int")
    before = spark.createDataFrame([("A", 3, 70), ("D", 1, 99)], "symbol string, rank int, score int")
    got = {r.symbol: (r.state, r.rank_delta, r.score_delta) for r in TR.sheet_diff(now, before).collect()}
    assert got == {"A": ("kept", 2, 20), "N": ("new", None, None), "D": ("dropped", None, None)}


# ---- text ------------------------------------------------------------------------------

def messages(spark, *texts, sender="-100"):
    rows = [("g", i, date(2020, 1, 1 + i), sender, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "group_id string, message_id long, date date, sender string, text string")


LISTED = [("SENCO", "Senco Gold Limited"), ("RELI", "Reliance Industries"), ("M&M", "Mahindra & Mahindra"), ("BUY", "Buyer Co"), ("GOLD", "Sencoish Ltd")]


def listed(spark):
    return spark.createDataFrame(LISTED, "symbol string, company_name string")


def test_recommendation_fields(spark):
    m = messages(spark, "buy senco above 380 tgt 420.5 sl 365", "EXIT reliance now", "nothing here", None)
    got = {(r.message_id, r.symbol): r for r in X.recommendations(m, listed(spark)).collect()}
    assert set(got) == {(0, "SENCO"), (1, "RELI")}
    r = got[(0, "SENCO")]
    assert (r.direction, r.entry, r.target, r.sl) == ("BUY", 380.0, 420.5, 365.0)
    assert got[(1, "RELI")].direction == "SELL"


def test_first_line_of_the_listing_has_a_shared_word(spark, tmp_path):
    path = tmp_path / "listing.csv"
    path.write_text("SYMBOL, NAME OF COMPANY\nZEE,Shared Word Ltd\nABC,Shared Other Ltd\n MID ,\"Alpine, Shoes\"\n")
    got = {r.token: r.symbol for r in X.company_words(readers.read_listing(spark, str(path))).collect()}
    assert got == {"SHARED": "ZEE", "ALPINE": "MID"}
    alone = readers.read_listing(spark, str(path)).drop("place")
    assert {r.symbol for r in X.company_words(alone).where("token = 'SHARED'").collect()} == {"ABC"}


def test_messages_are_shuffled_once(spark):
    m = messages(spark, "buy senco above 380", "EXIT reliance reliance now", "gold and senco")
    df = X.recommendations(m, listed(spark))
    assert sorted((r.message_id, r.symbol) for r in df.collect()) == [(0, "SENCO"), (1, "RELI"), (2, "GOLD"), (2, "SENCO")]
    again = X.recommendations(m.union(m), listed(spark))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert again.count() == 4 and sum("LogicalRDD" in x and "message_id" in x for x in plan.splitlines()) == 1


def test_message_files_are_read_by_place(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        'message_id,date_ist,sender,text\n1,2020-01-02 09:15:00,-100,"two\nlines, ""quoted""",g1\n2,2020-01-03,77,plain\nx,2020-01-03,77,no id,g1\n')
    got = sorted(tuple(r) for r in readers.read_messages(spark, str(tmp_path)).collect())
    assert got == [(1, date(2020, 1, 2), "-100", 'two\nlines, "quoted"', "g1"), (2, date(2020, 1, 3), "77", "plain", None)]


def test_last_named_sector_counts(spark, tmp_path):
    (tmp_path / "s.csv").write_text("Symbol,Sector\nAAA,Energy\nAAA,\nBBB, Metals \nAAA,Power\n")
    assert sorted(tuple(r) for r in readers.read_sectors(spark, str(tmp_path)).collect()) == [("AAA", "Power"), ("BBB", "Metals")]


def test_target_pattern_word_boundary_option(spark):
    m = messages(spark, "SENCO at 380 target 420")
    assert X.recommendations(m, listed(spark)).first().target == 380.0
    assert X.recommendations(m, listed(spark), word_boundary=True).first().target == 420.0


@pytest.mark.parametrize("text,want", [
    ("TARGET-260 AND 300+", (300.0, None)), ("target 2X soon", (None, "2x")), ("target 5", (None, None)), ("no", (None, None)),
])
def test_admin_target(spark, text, want):
    r = value(one(spark, t=text), X.admin_target(F.col("t")))
    assert (r.price, r.multiple) == want


def test_mentions_respect_boundaries(spark):
    m = messages(spark, "SENCO,RELI", "XSENCO SENCO9", "buy M&M now", "M&MX", "senco")
    got = {(r.message_id, r.symbol) for r in X.symbol_mentions(m, listed(spark)).collect()}
    assert got == {(0, "SENCO"), (0, "RELI"), (2, "M&M"), (2, "BUY")} - {(2, "BUY")}


def test_messages_meet_few_symbols_without_a_shuffle(spark, capsys):
    # the symbols come out of a join that Spark cannot size
    listing = listed(spark).join(messages(spark, "x").select("text"), F.col("symbol") != F.col("text"))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        X.symbol_mentions(spark.range(100).select(F.col("id").alias("message_id"), F.lit("buy SENCO").alias("text")), listing).explain()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    plan = capsys.readouterr().out
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_newest_call_needs_a_recent_mention(spark):
    m = messages(spark, "SENCO TARGET 500", "SENCO positional", "SENCO hello", "RELI TARGET 900")
    symbols = listed(spark)
    got = {r.symbol: r for r in X.group_mentions(m, symbols, "2020-01-04").collect()}
    assert (got["SENCO"].call_date, got["SENCO"].target, got["SENCO"].tag) == (date(2020, 1, 2), None, "POSITIONAL")
    assert got["SENCO"].mentions == 3 and got["RELI"].target == 900.0
    assert X.group_mentions(m, symbols, "2020-03-30").count() == 0


def test_at_most_three_symbols_alphabetical(spark):
    many = spark.createDataFrame([(s, "x") for s in ("DDD", "AAA", "CCC", "BBB")], "symbol string, company_name string")
    got = X.precedence_mentions(messages(spark, "ddd ccc bbb aaa buy"), many).collect()
    assert sorted(r.symbol for r in got) == ["AAA", "BBB", "CCC"]


@pytest.mark.parametrize("late,verdict,rho", [(lambda i: 1, "n/a", None), (lambda i: 1 if i > 4 else 0, "STABLE", 1.0)])
def test_split_half_of_equal_win_rates(spark, late, verdict, rho):
    halves = [(date(2020, 1, 1), lambda i: 1 if i > 4 else 0), (date(2020, 1, 2), late)]
    rows = [(day, [f"S{chr(65 + i)}"], win(i)) for day, win in halves for i in range(10)]
    short = spark.createDataFrame(rows, "date date, screeners array<string>, win int")
    got = RS.split_half_stability(short, min_n=1).first()
    assert (got.common, got.verdict) == (10, verdict)
    assert got.rank_corr == (None if rho is None else pytest.approx(rho))
