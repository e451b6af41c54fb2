"""Registered queries, grouped by operator family."""

from importlib import import_module

FAMILIES = ["q_islands", "q_intervals", "q_timebase", "q_signal", "q_budgets", "q_beats", "q_review"]


def register_all() -> None:
    for f in FAMILIES:
        import_module(f"{__name__}.{f}")
