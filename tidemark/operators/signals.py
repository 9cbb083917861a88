"""Signals, sizes and costs as column expressions. A strategy is three of them over the feature table."""

from __future__ import annotations

from dataclasses import dataclass, replace
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Costs:
    """Share of a notional per side, and slippage against the price."""

    fee: Decimal = Decimal("0.001")
    slippage: float = 0.0005

    def __post_init__(self) -> None:
        if not (0 <= self.fee < 1 and 0 <= self.slippage < 1):
            raise ValueError("fee and slippage are shares from 0 to under 1")

    def filled(self, price: Column, side: Column) -> Column:
        """The price that a buy or sell gets."""
        return price * F.when(side == "buy", 1 + self.slippage).otherwise(1 - self.slippage)

    def of(self, notional: Column) -> Column:
        return notional * F.lit(self.fee)


@dataclass(frozen=True)
class Risk:
    """Shares of equity: at risk in a trade, and at most in a position."""

    per_trade: float = 0.01
    max_exposure: float = 0.2

    def __post_init__(self) -> None:
        if not (0 < self.per_trade <= 1 and 0 < self.max_exposure <= 1):
            raise ValueError("risk shares are over 0 and at most 1")

    def size(self, equity: Column, price: Column, stop: Column) -> Column:
        """Units of which a stop loses per_trade of equity, capped by exposure; null without a stop, equity or price."""
        ok = (stop > 0) & (equity > 0) & (price > 0)
        return F.when(ok, F.least(equity * self.per_trade / F.when(ok, price * stop), equity * self.max_exposure / F.when(ok, price)))

    def rejection(self, equity: Column, price: Column, stop: Column) -> Column:
        return F.when(~F.coalesce(stop > 0, F.lit(False)), "missing_stop").when(~F.coalesce((equity > 0) & (price > 0), F.lit(False)), "not_positive")


@dataclass(frozen=True)
class Strategy:
    """enter and exit are flags and stop a share of the price, over the columns of a feature table."""

    enter: Column
    exit: Column
    stop: Column

    def gated(self, allowed: Column) -> Strategy:
        """The same, but entering only where allowed holds; exits are untouched and null allows nothing."""
        return replace(self, enter=self.enter & F.coalesce(allowed, F.lit(False)))

    def signals(self, features: DataFrame) -> DataFrame:
        flag = lambda c: F.coalesce(c, F.lit(False))
        return features.withColumns({"enter": flag(self.enter), "exit": flag(self.exit), "stop_loss_pct": self.stop})


def rsi_bollinger(stop: float = 0.02) -> Strategy:
    """Enter below the lower band while oversold, exit at a neutral RSI."""
    return Strategy((F.col("rsi") < 30) & (F.col("pct_b") <= 0), F.col("rsi") >= 50, F.lit(stop))


def model_strategy(required: list[str], entry: float, exit_: float, stop: float = 0.02) -> Strategy:
    """Enter at a raw score of entry or more, exit under exit_; a row that lacks a required feature does neither."""
    warm = F.lit(True)
    for c in required:
        warm = warm & F.col(c).isNotNull()
    return Strategy(warm & (F.col("score") >= entry), warm & (F.col("score") < exit_), F.lit(stop))


def regime_gate(least: float) -> Column:
    return F.col("trend_regime_pct") >= least


def depth_fields(bids: Column, asks: Column) -> dict[str, Column]:
    """Best prices, spread over the bid, quantity per side and imbalance, which is 0 for an empty book."""
    total = lambda side: F.aggregate(side, F.lit(0.0), lambda a, x: a + x["qty"])
    bid, ask = F.get(bids, F.lit(0))["price"], F.get(asks, F.lit(0))["price"]
    b, a = total(bids), total(asks)
    return {
        "best_bid": bid, "best_ask": ask, "spread_pct": F.when(bid != 0, (ask - bid) / F.when(bid != 0, bid)), "bid_depth": b, "ask_depth": a,
        "imbalance": F.when(b + a != 0, (b - a) / F.when(b + a != 0, b + a)).otherwise(0.0),
    }
