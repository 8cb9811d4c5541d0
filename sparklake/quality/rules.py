"""Rules are predicates over columns; all rules of a report are counted in one pass.

A null predicate is no violation unless the rule says so.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``predicate`` is SQL or a function of the DataFrame; up to ``threshold`` (a share of rows) violations pass."""

    name: str
    predicate: str | Callable[[DataFrame], Column]
    severity: str = "error"
    threshold: float = 0.0
    null_is_violation: bool = False
    description: str = ""

    def __post_init__(self):
        if self.severity not in ("error", "warn"):
            raise ValueError(f"severity is error or warn, not {self.severity}")

    def violated(self, df: DataFrame) -> Column:
        holds = F.expr(self.predicate) if isinstance(self.predicate, str) else self.predicate(df)
        return ~F.coalesce(holds, F.lit(not self.null_is_violation))


@dataclass(frozen=True)
class Result:
    name: str
    severity: str
    violations: int
    total: int
    threshold: float

    @property
    def rate(self) -> float:
        return self.violations / self.total if self.total else 0.0

    @property
    def passed(self) -> bool:
        return self.rate <= self.threshold


@dataclass(frozen=True)
class Report:
    results: tuple[Result, ...]

    @property
    def has_errors(self) -> bool:
        return any(not r.passed and r.severity == "error" for r in self.results)

    @property
    def has_warnings(self) -> bool:
        return any(not r.passed and r.severity == "warn" for r in self.results)

    def as_dict(self) -> dict:
        return {"has_errors": self.has_errors, "has_warnings": self.has_warnings, "results": [asdict(r) | {"rate": r.rate, "passed": r.passed} for r in self.results]}

    def as_json(self) -> str:
        return json.dumps(self.as_dict(), sort_keys=True)


def run(df: DataFrame, rules: list[Rule]) -> Report:
    """Count every rule's violations in a single aggregation."""
    row = df.agg(F.count("*").alias("n"), *[F.count_if(r.violated(df)).alias(f"r{i}") for i, r in enumerate(rules)]).first()
    return Report(tuple(Result(r.name, r.severity, row[f"r{i}"], row["n"], r.threshold) for i, r in enumerate(rules)))


def with_flags(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """df with _dq_flags (names of all violated rules) and _dq_pass (no violated error rule)."""
    named = lambda some: F.array_compact(F.array(*[F.when(r.violated(df), F.lit(r.name)) for r in some])) if some else F.array().cast("array<string>")
    return df.withColumns({"_dq_flags": named(rules), "_dq_pass": F.size(named([r for r in rules if r.severity == "error"])) == 0})


def split(df: DataFrame, rules: list[Rule]) -> tuple[DataFrame, DataFrame]:
    """(good, bad): bad rows break an error rule and carry _dq_reasons; warnings don't count."""
    errors = [r for r in rules if r.severity == "error"]
    marked = with_flags(df, errors)
    return marked.where("_dq_pass").drop("_dq_flags", "_dq_pass"), marked.where("NOT _dq_pass").withColumnRenamed("_dq_flags", "_dq_reasons").drop("_dq_pass")


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def orphans(df: DataFrame, parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Rows whose non-null key has no parent."""
    return df.where(F.col(key).isNotNull()).join(parents.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def row_count_within(df: DataFrame, least: int, most: int) -> bool:
    return least <= df.count() <= most


def rules_from(rows: list[dict]) -> list[Rule]:
    """Rules from configuration: dicts with name, predicate (SQL) and the other fields of a rule."""
    return [Rule(**row) for row in rows]
