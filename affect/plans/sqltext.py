"""DuckDB text of the column helpers, used to write the oracle queries that
check every registered Spark query (the DuckDB side is an independent
formulation of the same semantics, not generated from the Spark plan)."""

from __future__ import annotations

from affect.functions.clean import WS_CLASS

STRIP_RE = rf"^{WS_CLASS}+|{WS_CLASS}+$"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '{STRIP_RE}', '', 'g')"


def lenient(x: str) -> str:
    v = f"lower({strip(x)})"
    return f"(CASE WHEN {v} <> '' THEN {v} END)"


def strict(x: str) -> str:
    v = f"lower({strip(x)})"
    return (f"(CASE WHEN {v} NOT IN ('', 'neutral', 'nan') AND regexp_full_match({v}, '\\p{{L}}+') "
            f"THEN {v} END)")


def to_num(x: str) -> str:
    v = f"TRY_CAST(trim(CAST({x} AS VARCHAR)) AS DOUBLE)"
    return f"(CASE WHEN NOT isnan({v}) THEN {v} END)"


def finite(x: str) -> str:
    v = to_num(x)
    return f"(CASE WHEN abs({v}) <> 'inf'::DOUBLE THEN {v} END)"


def py_int(x: str) -> str:
    """int() truncation of a finite double (DuckDB casts round, so trunc)."""
    return f"(CASE WHEN {x} IS NOT NULL THEN CAST(trunc(least(greatest({x}, -1e9), 1e9)) AS INTEGER) END)"


def trunc_int(x: str) -> str:
    return py_int(finite(x))


def bround(x: str, d: int = 2) -> str:
    return f"round_even({x}, {d})"


def sentiment_code(x: str) -> str:
    k = f"lower({strip(f'CAST({x} AS VARCHAR)')})"
    num = py_int(finite(k))
    return (f"CAST(coalesce(CASE WHEN {k} IN ('neg','negative','0') THEN 0 "
            f"WHEN {k} IN ('neu','neutral','1') THEN 1 WHEN {k} IN ('pos','positive','2') THEN 2 END, "
            f"CASE WHEN {num} IS NOT NULL THEN least(greatest({num}, 0), 2) END, 1) AS INTEGER)")


def to_flag(x: str, name: str) -> str:
    s = f"lower({strip(f'CAST({x} AS VARCHAR)')})"
    return (f"CAST(CASE WHEN {x} IS NULL THEN 0 WHEN {s} IN ('1','1.0','true','t','yes','y') "
            f"OR {s} = '{name.lower()}' THEN 1 ELSE 0 END AS INTEGER)")


def intensity_class(x: str) -> str:
    v = py_int(finite(f"CAST({x} AS VARCHAR)"))
    return f"CAST(coalesce(CASE WHEN {v} < 1 THEN 0 WHEN {v} > 3 THEN 2 ELSE {v} - 1 END, 0) AS INTEGER)"


def word_count(x: str) -> str:
    return f"len(list_filter(regexp_split_to_array({x}, '{WS_CLASS}+'), lambda w: w <> ''))"


def emotions_array() -> str:
    return (f"list_filter([{strict('emotion1')}, {strict('emotion2')}, {strict('emotion3')}], "
            f"lambda x: x IS NOT NULL)")
