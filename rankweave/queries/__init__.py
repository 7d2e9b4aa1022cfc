"""Registered queries of the ranking and back-test operators, each over whole tables, with SQL oracles."""

from . import backtest, fundamentals, portfolio, ranking, series, sources
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "backtest", "fundamentals", "portfolio", "ranking", "series", "sources"]
