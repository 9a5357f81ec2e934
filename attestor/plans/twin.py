"""SQL text of the library's word rules and sample columns, for DuckDB to compare with."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def lit(value: object) -> str:
    return "NULL" if value is None else "'" + str(value).replace("'", "''") + "'" if isinstance(value, str) else str(value)


def has(text: str, words: Sequence[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {lit(w)})" for w in words) + ")"


def first(text: str, rules, otherwise: str | None) -> str:
    return "CASE " + " ".join(f"WHEN {has(text, words)} THEN {lit(v)}" for v, words in rules) + f" ELSE {lit(otherwise)} END"


def whole(text: str, words: Sequence[str], beside: str = "a-z0-9") -> str:
    spelled = "|".join(w.replace(".", r"\.").replace("(", r"\(").replace(")", r"\)") for w in words)
    return f"regexp_matches({text}, {lit(f'(?:^|[^{beside}])(?:{spelled})(?:[^{beside}]|$)')})"


def status(c: str) -> str:
    return f"replace(replace(upper(trim(coalesce({c}, ''))), ' ', '_'), '-', '_')"


def pick(number: Column, values: Sequence[str | None]) -> Column:
    """One of the values for each number."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(number, F.lit(len(values))) + 1).cast("int"))


def picked(number: str, values: Sequence[str | None]) -> str:
    return f"([{', '.join(map(lit, values))}])[({number}) % {len(values)} + 1]"
