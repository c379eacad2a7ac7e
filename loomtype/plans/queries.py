"""All registered queries of the typing library."""

from __future__ import annotations

from importlib import import_module

from .registry import ORACLE, QUERIES

for _module in ("q_names", "q_pairs", "q_align", "q_evaluate", "q_score", "q_reads", "q_files", "q_merge"):
    import_module(f"{__package__}.{_module}")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)

from .q_pairs import flagship  # noqa: E402, F401
