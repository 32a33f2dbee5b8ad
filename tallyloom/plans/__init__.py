"""Named queries over the driver's tables, each with its SQL."""

from tallyloom.plans import aggregates, evaluation, graphs, packets, questions, scan_join, statistics, texts, windows
from tallyloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "aggregates", "evaluation", "graphs", "packets", "questions", "scan_join", "statistics", "texts", "windows"]
