"""All queries outside the subpackage for training data. A module of operators has QUERIES, and SQL for those that SQL can say."""

from __future__ import annotations

from lexatlas.operators import graph, intervals, keywords, people, scoring, space, texts, themes, trajectories
from lexatlas.streaming import events

MODULES = [intervals, texts, scoring, graph, keywords, people, space, themes, trajectories, events]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def sql() -> dict[str, str]:
    return {name: text for m in MODULES for name, text in m.SQL.items()}
