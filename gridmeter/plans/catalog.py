"""Registry of every query: name -> (Spark callable, DuckDB oracle SQL or None)."""

from __future__ import annotations

from importlib import import_module

_MODULES = ["q_clean", "q_usage", "q_grid", "q_release", "q_quality", "q_stream"]


def _load():
    qs, sql = {}, {}
    for m in _MODULES:
        mod = import_module(f"{__package__}.{m}")
        for k, fn in mod.QUERIES.items():
            if k in qs:
                raise ValueError(f"duplicate query {k}")
            qs[k] = fn
        sql.update(getattr(mod, "SQL", {}))
    return qs, sql


def queries():
    return _load()[0]


def oracle_sql():
    qs, sql = _load()
    return {k: v for k, v in sql.items() if k in qs}
