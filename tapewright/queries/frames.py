"""Frames shared by the registered queries, derived from the given tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from ..operators.sheets import sheet_history
from ..operators.timeseries import add_indicators, add_relative_strength
from ..plans.scorecard import backtest_gate, labeled_history
from ..session import cut_lineage
from ..settings import DEFAULTS
from ..sources import market_tables as M

T = replace(DEFAULTS, benchmark=M.BENCHMARK)


def indicators(spark: SparkSession, sf: str, t=T) -> DataFrame:
    return add_relative_strength(add_indicators(M.bars(spark, sf), t=t), t=t)


def sheet(spark: SparkSession, sf: str) -> DataFrame:
    """The sheet history as a stored table, as the daily run leaves it: it is read repeatedly."""
    return cut_lineage(
        sheet_history(M.screener_hits(spark, sf), M.bars(spark, sf), M.deals(spark, sf), M.sectors(spark, sf)), "sheet")


def labeled(spark: SparkSession, sf: str, t=T) -> DataFrame:
    return labeled_history(sheet(spark, sf), indicators(spark, sf, t), t=t)


def gated(spark: SparkSession, sf: str, t=T) -> DataFrame:
    return backtest_gate(labeled(spark, sf, t), t=t)


def stored_indicators(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """The needed indicator columns as a stored table, for queries that read them repeatedly."""
    return cut_lineage(indicators(spark, sf).select("symbol", "date", *columns), "indicators")
