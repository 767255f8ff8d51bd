"""Registry of every query exposed to the driver: name -> Spark callable and
name -> DuckDB oracle text."""

from __future__ import annotations

import importlib

_MODULES = ["affect.plans.q_profile", "affect.plans.q_prepare", "affect.plans.q_evaluate", "affect.plans.q_study", "affect.plans.q_text", "affect.plans.q_adapt", "affect.plans.q_sources"]


def _load():
    qs, os_ = {}, {}
    for m in _MODULES:
        mod = importlib.import_module(m)
        qs.update(mod.Q)
        os_.update(mod.O)
    return qs, os_


def all_queries() -> dict:
    return _load()[0]


def _bigint_count_if(sql: str) -> str:
    """DuckDB's ``count_if`` returns HUGEINT; Spark's returns BIGINT.  Wrap
    every call in a BIGINT cast so result schemas agree."""
    out, i, key = [], 0, "count_if("
    while True:
        j = sql.find(key, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        depth, k = 0, j + len(key) - 1
        while True:
            if sql[k] == "(":
                depth += 1
            elif sql[k] == ")":
                depth -= 1
                if depth == 0:
                    break
            k += 1
        out.append(sql[i:j] + "CAST(" + sql[j:k + 1] + " AS BIGINT)")
        i = k + 1


def all_oracles() -> dict:
    q, o = _load()
    return {k: _bigint_count_if(v) for k, v in o.items() if k in q}
